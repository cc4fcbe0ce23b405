"""Where published definitions and the established behaviour of analog reconstruction
tools differ, both can be asked for; this says which."""

from __future__ import annotations

from dataclasses import dataclass

REFERENCE, STANDARD = "reference", "standard"


@dataclass(frozen=True)
class Semantics:
    """``reference``: as such tools compute; ``standard``: as documented by the WMO or textbooks."""

    mode: str = REFERENCE

    def __post_init__(self) -> None:
        if self.mode not in (REFERENCE, STANDARD):
            raise ValueError(f"mode must be {REFERENCE} or {STANDARD}, not {self.mode}")

    @property
    def reference(self) -> bool:
        return self.mode == REFERENCE


def is_reference(mode: str) -> bool:
    return Semantics(mode).reference
