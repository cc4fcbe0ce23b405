"""Byte-pair encoding and decoding by batched merge rounds.

The symbols of many words stand in one flat array. A round looks every
neighbouring pair up by binary search over the sorted pair keys, takes each
word's lowest rank by a segmented minimum and merges there; words without a
pair left drop out. Only distinct words are merged: texts are cut in front of
single spaces, a boundary that the pattern below always respects, and each
distinct piece is encoded once per worker and remembered.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from skyecho.llm.common import blocks, clashing, drops, enter, small_batches

#: The public pre-tokenization pattern of byte-level vocabularies.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?=\p{White_Space}|\Z)|\p{White_Space}+")
NEVER = np.iinfo(np.int64).max
#: Characters of text that are cut into pieces at a time.
BLOCK_CHARS = 2_000_000
#: Distinct pieces, and words of them, that a worker remembers.
KEEP_PIECES, KEEP_WORDS = 1_200_000, 800_000


@lru_cache(1)
def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars, extra = [""] * 256, 0
    for b in range(256):
        chars[b] = chr(b) if b in shown else chr(256 + extra)
        extra += b not in shown
    return chars


class MergeRounds:
    """Encoder and decoder for a byte-level vocabulary file (tokenizer JSON)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        chars = byte_characters()
        to_byte = {c: b for b, c in enumerate(chars)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        self.marks = min(self.special, key=len)[:2] if len({s[:2] for s in self.special}) == 1 else ""
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words: dict[str, bytes] = {}
        self.special_ids = {s: i.to_bytes(4, "little") for s, i in self.special.items()}
        self.byte_ids = np.array([vocab[c] for c in chars], np.int64)
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token_bytes = [b""] * size
        for token, i in [*vocab.items(), *self.special.items()]:
            self.token_bytes[i] = bytes(to_byte[c] for c in token) if all(c in to_byte for c in token) else token.encode()
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left, right, new = (np.array(x, np.int64) for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in merges), strict=True))
        self.shift = int(size).bit_length()
        keys = (left << self.shift) | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.new_of_rank = keys[order], order.astype(np.int64), new
        # All places of a word's lowest pair may merge in one round if a new symbol's pairs always rank later.
        made = np.full(size, -1, np.int64)
        made[new[::-1]] = np.arange(len(new))[::-1]
        at = np.arange(len(new))
        self.ordered = len(np.unique(new)) == len(new) and bool((made[left] < at).all() and (made[right] < at).all())

    def ranked(self, symbols: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The rank of the pair that starts at each symbol, NEVER if there is none in its word."""
        out = np.full(len(symbols), NEVER)
        if len(symbols) > 1:
            key = (symbols[:-1] << self.shift) | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = (self.keys[at] == key) & (word[:-1] == word[1:])
            out[:-1][hit] = self.ranks[at[hit]]
        return out

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word (non-empty bytes)."""
        if not words:
            return []
        symbols = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        done_symbols, done_words = [], []
        while len(symbols):
            rank = self.ranked(symbols, word)
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            count = np.diff(np.append(first, len(symbols)))
            lowest = np.repeat(np.minimum.reduceat(rank, first), count)
            over = lowest == NEVER
            done_symbols.append(symbols[over])
            done_words.append(word[over])
            here = (rank == lowest) & ~over
            at = np.flatnonzero(here)
            if self.ordered:  # of a run of overlapping places every second one
                start = np.concatenate(([True], np.diff(at) != 1))[: len(at)]
                run = np.maximum.accumulate(np.where(start, np.arange(len(at)), 0)) if len(at) else at
                at = at[(np.arange(len(at)) - run) % 2 == 0]
            else:
                at = at[np.concatenate(([True], np.diff(word[at]) != 0))[: len(at)]]
            symbols[at] = self.new_of_rank[rank[at]]
            keep = ~over
            keep[at + 1] = False
            symbols, word = symbols[keep], word[keep]
        flat, owner = np.concatenate(done_symbols), np.concatenate(done_words)
        order = np.argsort(owner, kind="stable")
        return np.split(flat[order].astype("<u4"), np.cumsum(np.bincount(owner, minlength=len(words)))[:-1])

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece, as little-endian unsigned 32-bit integers."""
        if len(self.words) > KEEP_WORDS:
            self.words.clear()
        words, cut = self.words, []
        for piece in pieces:
            if self.split_special and self.marks in piece:
                cut.append([w for text in self.split_special.split(piece) if text for w in ([text] if text in self.special else PATTERN.findall(text))])
            else:
                cut.append(PATTERN.findall(piece))
        words.update(self.special_ids)
        fresh = list({w for parts in cut for w in parts if w not in words})
        for part in blocks([len(w) for w in fresh], 1_000_000):
            ids = self.merge([w.encode("utf-8", "replace") for w in fresh[part]])
            words.update((w, x.tobytes()) for w, x in zip(fresh[part], ids, strict=True))
        return [b"".join([words[w] for w in parts]) for parts in cut]

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids; broken byte sequences become U+FFFD."""
        get = self.token_bytes
        return b"".join([get[i] for i in ids.tolist()]).decode("utf-8", "replace")


class Remembered:
    """Ids of whole texts out of the remembered ids of their pieces.

    ``encode_pieces`` gives the ids of pieces. With ``lead``, the space in front
    belongs to a piece, and texts in which white space follows a space are
    encoded whole, since their pieces can't stand alone.
    """

    def __init__(self, encode_pieces: Callable[[list[str]], list[bytes]], lead: bool, keep: int = KEEP_PIECES) -> None:
        self.encode_pieces, self.lead, self.keep = encode_pieces, lead, keep
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes | None] = {}

    def learn(self, firsts: set[str], laters: set[str]) -> None:
        """Room is made only before a block, so that all of a block's pieces are there."""
        if len(self.first) + len(self.later) > self.keep:
            self.first.clear()
            self.later.clear()
        firsts = [w for w in firsts if w not in self.first]
        fit = [w for w in laters if w not in self.later]
        alone = [w for w in fit if not self.lead or w and not w[0].isspace()]
        if len(alone) < len(fit):
            self.later.update(dict.fromkeys(set(fit) - set(alone)))
        ids = self.encode_pieces(firsts + [" " + w if self.lead else w for w in alone])
        self.first.update(zip(firsts, ids, strict=False))
        self.later.update(zip(alone, ids[len(firsts) :], strict=True))

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        for part in blocks([len(t) for t in texts], BLOCK_CHARS):
            cut = [t.split(" ") for t in texts[part]]
            firsts, laters = {p[0] for p in cut}, set()
            for p in cut:
                laters.update(p)
            self.learn(firsts, laters)
            first, later = self.first, self.later
            for text, p in zip(texts[part], cut, strict=True):
                ids = [later[w] for w in p[1:]]
                if None in ids:
                    yield self.encode_pieces([text])[0]
                else:
                    yield first[p[0]] + b"".join(ids)


@lru_cache(2)
def encoder(path: str) -> tuple[MergeRounds, Remembered]:
    rounds = MergeRounds(path)
    return rounds, Remembered(rounds.encode_pieces, lead=True)


drops(encoder.cache_clear)


def encode(df: DataFrame, vocabulary: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), decode: bool = True) -> DataFrame:
    """``keep`` columns of every row, ``ids`` (array of long) of its whole text (null:
    empty) and, with ``decode``, the ``decoded`` text of those ids.

    One pass without a shuffle. A word's cost grows with its length times the
    number of different merges in it; memory with one batch of rows. Repeated rows
    are coded each; a kept column named as one of the results is an error.
    """
    return _coded(df, vocabulary, text, keep, decode, digests=False)


def digests(df: DataFrame, vocabulary: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """As ``encode`` with ``decode``, but with the number and SHA-256 of the ids and the
    SHA-256 of the decoded text in place of both."""
    return _coded(df, vocabulary, text, keep, True, digests=True)


def _coded(df: DataFrame, vocabulary: str, text: str, keep: tuple[str, ...], decode: bool, digests: bool) -> DataFrame:
    clashing(df.select(*keep), "ids", "decoded", "n_tokens", "ids_sha256", "decoded_sha256")
    small_batches(df.sparkSession)
    kept = df.select(*keep, text)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name in keep)
    more = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<long>" + ", decoded string" * decode

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("bpe")
        rounds, remembered = encoder(vocabulary)
        for batch in batches:
            column = batch.column(len(keep))
            for part in blocks(pc.fill_null(pc.binary_length(column), 0).to_pylist(), BLOCK_CHARS):
                texts = [t or "" for t in column.slice(part.start, part.stop - part.start).to_pylist()]
                ids = [np.frombuffer(x, "<u4") for x in remembered.encode(texts)]
                front = [batch.column(i).slice(part.start, part.stop - part.start) for i in range(len(keep))]
                if digests:
                    made = [pa.array([len(x) for x in ids], pa.int64()), pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids]), pa.array([hashlib.sha256(rounds.decode(x).encode()).hexdigest() for x in ids])]
                    names = ["n_tokens", "ids_sha256", "decoded_sha256"]
                else:
                    made = [pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64()))] + [pa.array([rounds.decode(x) for x in ids])] * decode
                    names = ["ids", "decoded"][: 1 + decode]
                yield pa.RecordBatch.from_arrays(front + made, [*keep, *names])

    return kept.mapInArrow(run, f"{fields}, {more}")
