"""Best-fit packing of token sequences by linear grouping.

Documents are tokenized in one pass into pieces of at most ``capacity`` tokens;
from then on only narrow rows move. Pieces are dealt by hash into shards of
bounded size, so a task holds a bounded number of them at any scale, and each
shard is packed by an asymptotic scheme:

1. sizes over ``large`` are sorted and cut into groups of equal cardinality,
   each rounded up to its largest size;
2. the few rounded sizes are covered by configurations (multisets that fit one
   sequence), chosen by column generation: a small linear program priced by a
   knapsack over at most ``capacity // large`` items;
3. whole multiples of the configurations become sequences, and the actual
   documents of each group take their places, which always fit;
4. what the rounding of the program leaves over, and then the small documents,
   go by decreasing size to the sequence in which they leave least room.

Several group counts are tried and the packing with the fewest sequences is
kept. A shard ends with at most a few sequences that are not full, so shards
cost about one sequence in a thousand.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyecho.llm.bpe import KEEP_PIECES, Remembered
from skyecho.llm.common import blocks, clashing, drops, enter, small_batches, trim, written

#: Pieces in a shard, on average.
SHARD_PIECES = 16_384
GROUP_COUNTS = (12, 32)
#: A word of letters that stay as they are when composed, and ASCII signs that start no special token or contraction.
SIMPLE = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?#$%&*|()]*)")


@lru_cache(2)
def tokenizer(path: str, keep: int = KEEP_PIECES) -> Remembered:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(path)
    one.no_truncation()
    one.no_padding()
    ends = np.zeros(max(one.get_vocab().values()) + 1, bool)
    ends[[i for token, i in one.get_vocab().items() if token.endswith("</w>")]] = True
    known: dict[str, bytes] = {}

    def alone(pieces: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in one.encode_batch_fast(pieces, add_special_tokens=False)]

    def learn(words: list[str]) -> None:
        """Lower-case words of letters are encoded many at a time: each ends with the one id that ends a word."""
        for part in blocks([len(w) for w in words], 100_000):
            ids = np.array(one.encode_batch_fast([" ".join(words[part])], add_special_tokens=False)[0].ids, "<u4")
            at = np.flatnonzero(ends[ids]) + 1
            split = [x.tobytes() for x in np.split(ids, at[:-1])] if len(at) == part.stop - part.start else alone(words[part])
            known.update(zip(words[part], split, strict=True))

    def encode_pieces(pieces: list[str]) -> list[bytes]:
        if len(known) > keep * 2 // 3:
            known.clear()
        out: list[bytes | list[str]] = []
        words, odd = set(), set()
        for piece in pieces:
            parts = []
            for line in piece.split("\n"):
                if m := SIMPLE.fullmatch(line):
                    word = m[1].lower()
                    words.add(word)
                    parts.append(word)
                    if m[2]:
                        odd.add(m[2])
                        parts.append(m[2])
                elif line:
                    odd.add(line)
                    parts.append(line)
            out.append(parts)
        learn([w for w in words if w not in known])
        odd = [w for w in odd if w not in known]
        known.update(zip(odd, alone(odd), strict=True))
        return [b"".join([known[w] for w in parts]) for parts in out]

    # This vocabulary drops white space, so no word reaches over a space and pieces between spaces stand alone.
    return Remembered(encode_pieces, lead=False, keep=keep)


drops(tokenizer.cache_clear)


def token_pieces(df: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text: str = "text", with_ids: bool = False, keep: int = KEEP_PIECES) -> DataFrame:
    """Every document (null text: empty) as ids with ``end_id`` behind, cut into pieces of at most
    ``capacity``: id, piece, start, length, ids_crc32 and, with ``with_ids``, the ids. A worker remembers the
    ids of about ``keep`` pieces of text, some 300 bytes each: time against memory."""
    kept = df.select(id_col, text)
    kind = kept.schema[id_col].dataType.simpleString()
    last = int(end_id).to_bytes(4, "little")
    step = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("packing")
        remembered = tokenizer(vocabulary, keep)
        for batch in batches:
            ids_of, column = batch.column(0), batch.column(1)
            for part in blocks(pc.fill_null(pc.binary_length(column), 0).to_pylist(), 2_000_000):
                texts = [t or "" for t in column.slice(part.start, part.stop - part.start).to_pylist()]
                row, piece, start, length, crc, ids = [], [], [], [], [], []
                for i, got in enumerate(remembered.encode(texts), part.start):
                    got += last
                    for k, at in enumerate(range(0, len(got), step)):
                        own = got[at : at + step]
                        row.append(i)
                        piece.append(k)
                        start.append(at // 4)
                        length.append(len(own) // 4)
                        crc.append(zlib.crc32(own))
                        if with_ids:
                            ids.append(np.frombuffer(own, "<u4").astype(np.int64))
                columns = [ids_of.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = [id_col, "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)
        trim()

    return kept.mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids)


def best_configuration(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes that fits the capacity and is worth most, as counts per size."""
    most = int(capacity // sizes.min())
    value = np.zeros(capacity + 1)
    picks = []
    for _ in range(most):
        best, pick = value.copy(), np.full(capacity + 1, -1)
        for g, s in enumerate(sizes):
            got = value[: capacity + 1 - s] + worth[g]
            better = got > best[s:] + 1e-12
            best[s:][better] = got[better]
            pick[s:][better] = g
        picks.append(pick)
        if (pick < 0).all():
            break
        value = best
    counts = np.zeros(len(sizes), np.int64)
    room = capacity
    for pick in reversed(picks):
        if (g := pick[room]) >= 0:
            counts[g] += 1
            room -= sizes[g]
    return float(counts @ worth), counts


def configurations(sizes: np.ndarray, need: np.ndarray, capacity: int, rounds: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Configurations (columns) and how often each is used, fractions allowed, to cover
    ``need`` of each size with the fewest sequences."""
    basis = np.diag(capacity // sizes).astype(float)
    used = need / np.diag(basis)
    for _ in range(rounds):
        worth = np.linalg.solve(basis.T, np.ones(len(sizes)))
        gain, column = best_configuration(sizes, np.maximum(worth, 0), capacity)
        if gain <= 1 + 1e-9:
            break
        step = np.linalg.solve(basis, column.astype(float))
        able = step > 1e-9
        if not able.any():
            break
        ratio = np.full(len(sizes), np.inf)
        ratio[able] = used[able] / step[able]
        out = int(ratio.argmin())
        used = np.maximum(used - ratio[out] * step, 0)
        used[out] = ratio[out]
        basis[:, out] = column
    return basis.astype(np.int64), used


def _grouped(order: np.ndarray, lengths: np.ndarray, capacity: int, groups: int) -> tuple[list[list[int]], list[int]]:
    """Sequences that the configurations make of the large pieces (``order``: by decreasing length), and the rest."""
    per = -(-len(order) // groups)
    members = [order[i : i + per] for i in range(0, len(order), per)]
    tops = np.array([lengths[m[0]] for m in members], np.int64)
    sizes = np.unique(tops)[::-1]
    pools = [np.concatenate([m for m, top in zip(members, tops, strict=True) if top == s]).tolist()[::-1] for s in sizes]
    columns, used = configurations(sizes, np.array([len(p) for p in pools], float), capacity)
    sequences = []
    for k in np.argsort(-used, kind="stable"):
        for _ in range(int(used[k] + 1e-9)):
            if any(len(p) < c for p, c in zip(pools, columns[:, k], strict=True)):
                break
            sequences.append([p.pop() for p, c in zip(pools, columns[:, k], strict=True) for _ in range(c)])
    return sequences, [i for p in pools for i in p]


def _best_fit(sequences: list[list[int]], rest: list[int], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Adds ``rest`` by decreasing length, each where it leaves least room."""
    by_room: dict[int, list[int]] = {}
    rooms = 0
    for k, own in enumerate(sequences):
        if room := capacity - int(lengths[own].sum()):
            by_room.setdefault(room, []).append(k)
            rooms |= 1 << room
    for i in sorted(rest, key=lambda i: (-lengths[i], i)):
        n = int(lengths[i])
        if fit := rooms >> n:
            room = n + (fit & -fit).bit_length() - 1
            k = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
            sequences[k].append(i)
        else:
            room, k = capacity, len(sequences)
            sequences.append([i])
        if left := room - n:
            by_room.setdefault(left, []).append(k)
            rooms |= 1 << left
    return sequences


def pack_lengths(lengths: np.ndarray, capacity: int = 4096, large: int | None = None, group_counts: tuple[int, ...] = GROUP_COUNTS) -> list[list[int]]:
    """Places in ``lengths`` (1 to ``capacity`` each), one list per sequence."""
    large = large or max(1, capacity // 8)
    lengths = np.asarray(lengths, np.int64)
    order = np.lexsort((np.arange(len(lengths)), -lengths))
    full = [[int(i)] for i in order[lengths[order] == capacity]]
    order = order[lengths[order] < capacity]
    big, small = order[lengths[order] > large], order[lengths[order] <= large]
    best: list[list[int]] | None = None
    for groups in group_counts if len(big) else (1,):
        made, rest = _grouped(big, lengths, capacity, groups) if len(big) else ([], [])
        packed = _best_fit(made, rest + small.tolist(), lengths, capacity)
        if best is None or len(packed) < len(best):
            best = packed
    return full + (best or [])


def pack(pieces: DataFrame, capacity: int = 4096, id_col: str = "doc_id", shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """``pieces`` (id, piece, length from 1 to ``capacity``, any other columns) with
    ``sequence_id`` and ``offset``. Equal rows stay separate pieces. Reads ``pieces``
    twice (a count, then the packing): give it a stored table. Columns named ``sequence_id``, ``offset`` or ``_shard`` are an error."""
    clashing(pieces, "sequence_id", "offset", "_shard")
    n = pieces.count()
    shards = max(1, round(n / shard_pieces))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)

    def run(own: pd.DataFrame) -> pd.DataFrame:
        shard = int(own.pop("_shard").iloc[0])
        own = own.sort_values([id_col, "piece"], kind="stable", ignore_index=True)
        lengths = own["length"].to_numpy()
        sequence, offset = np.empty(len(own), np.int64), np.empty(len(own), np.int64)
        for k, places in enumerate(pack_lengths(lengths, capacity)):
            sequence[places] = (shard << 32) + k
            offset[places] = np.cumsum([0, *lengths[places[:-1]]])
        return own.assign(sequence_id=sequence, offset=offset)

    dealt = pieces.withColumn("_shard", F.pmod(F.xxhash64(id_col, "piece"), F.lit(shards)))
    return dealt.groupBy("_shard").applyInPandas(run, f"{schema}, sequence_id long, offset long")


def pack_documents(df: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text: str = "text", keep: int = KEEP_PIECES) -> DataFrame:
    """Tokenizes and packs: id, piece, start, length, ids_crc32, sequence_id, offset.

    Null texts count as empty (one piece: the end id). Rows that repeat an id are
    packed as documents of their own. Other columns are left out.
    """
    small_batches(df.sparkSession)
    return pack(written(token_pieces(df, vocabulary, capacity, end_id, id_col, text, keep=keep), "pieces"), capacity, id_col)
