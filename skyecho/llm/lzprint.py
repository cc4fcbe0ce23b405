"""Fingerprints of Lempel-Ziv phrases.

A text is parsed into phrases, each the shortest beginning of what remains that
is not in the dictionary yet (and then joins it). The fingerprint is the
minimum-hash signature of the set of phrases: two texts agree in as large a
share of its components as their phrase sets overlap, which follows how well
one text's dictionary would compress the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyecho.llm.common import U64, enter, segment_hashes, shuffle_width, small_batches

COMPONENTS = 64
_random = np.random.default_rng(20)
_FACTORS = (_random.integers(1 << 62, 1 << 63, (COMPONENTS, 1), np.uint64) << U64(1)) | U64(1)
_SHIFTS = _random.integers(0, 1 << 63, (COMPONENTS, 1), np.uint64)
NOTHING = np.full(COMPONENTS, 0xFFFFFFFF, np.uint32)


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _parse(text: str, ends: list[int], seen: set[str], open_: str, at: int) -> str:
    """Parses on from place ``at`` with the unfinished phrase ``open_``; returns what is unfinished at the end."""
    add, end = seen.add, ends.append
    for i, c in enumerate(text[at:] if at else text, at + 1):
        open_ += c
        if open_ not in seen:
            add(open_)
            end(i)
            open_ = ""
    return open_


def signature(data: np.ndarray, begin: int, ends: list[int]) -> np.ndarray:
    """Of the phrases that end at ``ends``, the first beginning at ``begin``."""
    if not ends:
        return NOTHING
    stop = np.array(ends)
    hashes = segment_hashes(data[begin : stop[-1]], np.concatenate(([begin], stop[:-1])) - begin, stop - begin)
    out = NOTHING
    for k in range(0, len(hashes), 4096):
        out = np.minimum(out, ((hashes[k : k + 4096] * _FACTORS + _SHIFTS) >> U64(32)).min(axis=1).astype(np.uint32))
    return out


class Parsed:
    """A text's signature, and what parsing a text with the same first ``keep`` characters goes on from."""

    def __init__(self, text: str, keep: int) -> None:
        self.text, self.keep = text, keep
        self.seen: set[str] = set()
        ends: list[int] = []
        self.open = _parse(text[:keep], ends, self.seen, "", 0)
        self.end = ends[-1] if ends else 0
        data = points(text)
        self.first = signature(data, 0, ends)
        if keep < len(text):
            more: list[int] = []
            _parse(text, more, self.seen, self.open, keep)
            self.signature = np.minimum(self.first, signature(data, self.end, more))
            self.seen.difference_update([text[a:b] for a, b in zip([self.end, *more], more, strict=False)])
        else:
            self.signature = self.first

    def edited(self, rest: str) -> tuple[str, np.ndarray]:
        """The first ``keep`` characters followed by ``rest``, and its signature."""
        text = self.text[: self.keep] + rest
        more: list[int] = []
        _parse(text, more, self.seen, self.open, self.keep)
        return text, np.minimum(self.first, signature(points(text), self.end, more))


def encoded(signature: np.ndarray) -> str:
    return signature.astype(">u4").tobytes().hex()


def likeness(one: np.ndarray, other: np.ndarray) -> float:
    """The share of equal components: 1 for equal phrase sets (two empty ones too)."""
    return float((one == other).mean())


def fingerprints(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``fingerprint`` of every row's whole text (null: empty); equal texts have equal ones."""
    kept = df.select(*keep, text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name in keep) + ", fingerprint string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("lzprint")
        for batch in batches:
            made = [encoded(Parsed(t or "", len(t or "")).signature) for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(made, pa.string())], [*keep, "fingerprint"])

    return kept.mapInArrow(run, schema)


OUT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
LEAST = -(1 << 63)


def with_edits(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text beside its neighbour: the fingerprints of the text and of the text whose last
    floor(n/2) characters are replaced by as many of the next row's first ones (or all of
    them), and the likeness of the text to that and to the next text.

    The next row is the one that follows by ascending ``key`` (an integer; nulls
    first), after the last the first; rows that repeat a key follow by text. One
    shuffle of the texts: rows are dealt to ranges of keys, one per partition, and
    the first row of each range also goes to the range before it, so each range is
    streamed once in order and no range has to fit into memory.
    """
    spark = df.sparkSession
    small_batches(spark)
    rows = df.select(F.col(key), F.coalesce(F.col(key).cast("long"), F.lit(LEAST)).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    kind = df.schema[key].dataType.simpleString()
    width = shuffle_width(spark)
    keys = rows.select("_key")
    found = keys.agg(F.percentile_approx("_key", [i / width for i in range(1, width)], 8 * width)).first()[0] if width > 1 else []
    bounds = sorted(set(found or []))
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    # Binary search over the bounds: how many of them are at most the key.
    block = F.lit(0) if not bounds else F.expr(f"aggregate(array({','.join(map(str, steps))}), 0, (n, s) -> if(n + s <= {len(bounds)} and element_at(cast(split('{','.join(map(str, bounds))}', ',') as array<bigint>), least(n + s, {len(bounds)})) <= _key, n + s, n))")
    rows = rows.withColumn("_block", block)
    first = sorted((r["_block"], r["_first"]) for r in rows.groupBy("_block").agg(F.min("_key").alias("_first")).collect())  # a row per partition
    if not first:
        return spark.createDataFrame([], f"`{key}` {kind}, {OUT}")
    into = [(first[i][1], first[i - 1][0]) for i in range(len(first))]  # the first row of all follows the last
    ahead = spark.createDataFrame(into, "_key long, _into int")
    rows = rows.join(F.broadcast(ahead), "_key", "left")
    places = F.array_compact(F.array(F.struct(F.col("_block").alias("b"), F.lit(0).alias("g")), F.when(F.col("_into").isNotNull(), F.struct(F.col("_into").alias("b"), F.lit(1).alias("g")))))
    dealt = rows.select(key, "_key", "_text", F.explode(places).alias("_at")).select(key, "_key", "_text", F.col("_at.b").alias("_block"), F.col("_at.g").alias("_ahead"))
    ordered = dealt.repartitionById(len(bounds) + 1, F.col("_block")).sortWithinPartitions("_block", "_ahead", "_key", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("lzprint")
        before: tuple[object, Parsed] | None = None
        block = None
        for batch in batches:
            out: list[tuple] = []
            for own, text, at, ahead in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                if at != block:
                    before, block = None, at
                elif before is None:
                    continue  # a further row with the key of the first one ahead
                now = Parsed(text, len(text) - len(text) // 2)
                if before is not None:
                    left, last = before
                    n = len(last.text)
                    changed, edited = last.edited(text[: n // 2])
                    out.append((left, n, hashlib.sha256(changed.encode("utf-8", "replace")).hexdigest(), encoded(last.signature), encoded(edited), likeness(last.signature, edited), likeness(last.signature, now.signature)))
                before = None if ahead else (own, now)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 7, [batch.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()], strict=True)], [key, *(c.split()[0] for c in OUT.split(", "))])

    return ordered.mapInArrow(run, f"`{key}` {kind}, {OUT}")
