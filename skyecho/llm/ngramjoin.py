"""Documents linked by the Jaccard similarity of their n-gram sets, exactly, with
vertical partitioning.

1. One pass hashes each text's set of word n-grams and counts all n-grams in a
   table of fixed size; the count, then the hash, is the global order (rare
   first). Equal sets become one class.
2. Two sets that are similar enough share an n-gram of their prefixes in this
   order. Prefix entries meet by n-gram; pairs pass length and position filters.
   Of an n-gram with more than ``HOT`` sets, every set is paired with the
   first ones only, those with the fewest rarer n-grams and so the least changed
   of a crowd; its entries are kept for step 4.
3. Sets of candidate pairs are cut vertically at pivots of the global order, all
   of them, into fragments of equal weight; each fragment counts its part of every
   pair's overlap, the parts are summed per pair, and links give components. Pairs
   are gathered by cluster; the fragments of a large cluster are cut further.
4. Of the kept entries, pairs of sets that are not in one component yet are
   verified the same way. First in a few turns, in which every set meets some
   others of its n-gram and size; then those outside an n-gram's largest component
   meet all of it that have about their size, in blocks. So no link that could
   join two components is missed, while a large group of near copies costs a few
   pairs per member.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from skyecho.llm.common import U64, enter, mix64, shuffle_width, small_batches, text_blocks, trim, word_hashes, written
from skyecho.llm.graph import components

SKETCH_BITS = 22
CHUNK = 1 << 16
FILTER_BITS = 26
HOT, LEADERS = 48, 2
#: Partners in the turns before all pairs across components are compared.
TURNS = (2, 4, 6)
#: Sets of an n-gram and range of sizes that are compared with each other at once.
BLOCK = 4096
#: Fragments of every set, and n-grams of a cluster in one of them; those of a larger cluster are cut further by hash.
FRAGMENTS, FRAGMENT = 8, 1 << 20
#: Entries of frequent n-grams in one task, as far as blocks of one n-gram allow.
UNIT = 1 << 15
#: Members of clusters (24 bytes each) that may be broadcast; beyond, the sets are shuffled to meet them.
BROADCAST_ROWS = 500_000
BLOCK_BYTES = 1_000_000


def ngram_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text; of a text with fewer words, that of all of them."""
    words, at = word_hashes(texts)
    grams = np.zeros(len(words), U64)
    if len(words) >= n:
        full = np.zeros(len(words) - n + 1, U64)
        for j in range(n):
            full = mix64(full * U64(0x9E3779B97F4A7C15) + words[j : len(words) - n + 1 + j])
        grams[: len(full)] = full
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            h = np.full(1, 7919 * (b - a), U64)
            for w in words[a:b]:
                h = mix64(h * U64(0x9E3779B97F4A7C15) + w)
            out.append(h)
        else:
            out.append(np.empty(0, U64))
    return out


def set_key(grams: np.ndarray) -> int:
    """A 64-bit key of the set (signed)."""
    total = int(mix64(grams * U64(0xC2B2AE3D27D4EB4F) + U64(len(grams))).sum(dtype=U64))
    return int(mix64(np.array([total ^ len(grams)], U64)).astype(np.int64)[0])


def _described(n: int, bits: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("ngramjoin")
        counts = np.zeros(1 << bits, np.uint32)
        kind = pa.int64()
        nulls = lambda k, t: pa.nulls(k, t)
        held: list[np.ndarray] = []

        def count(least: int) -> None:
            """Counts what is held, once it is so much that the table is worth a pass."""
            if sum(map(len, held)) > least:
                counts[:] += np.bincount(np.concatenate(held), minlength=1 << bits).astype(np.uint32)
                held.clear()

        for batch in batches:
            for part, texts in text_blocks(batch.column(1), BLOCK_BYTES):
                sets = ngram_sets(texts, n)
                keys = [set_key(s) for s in sets]
                held.extend((own >> U64(64 - bits)).astype(np.uint32) for own in sets)
                count(1 << 20)
                k = len(sets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.start, k), pa.array([len(s) for s in sets], kind), pa.array(keys, kind), nulls(k, pa.int32()), nulls(k, pa.binary())], ["id", "n", "key", "chunk", "counts"])
        count(0)
        if counts.any():
            small = np.minimum(counts, 255).astype(np.uint8)
            for c in range(0, 1 << bits, CHUNK):
                yield pa.RecordBatch.from_arrays([nulls(1, kind), nulls(1, kind), nulls(1, kind), pa.array([c // CHUNK], pa.int32()), pa.array([small[c : c + CHUNK].tobytes()], pa.binary())], ["id", "n", "key", "chunk", "counts"])

    return run


def _summed(chunk: pa.Table) -> pa.Table:
    """The counts of a chunk over all partitions, as steps of a quarter of a power of two."""
    total = np.zeros(CHUNK, np.int64)
    for x in chunk.column("counts"):
        own = np.frombuffer(x.as_py(), np.uint8)
        total[: len(own)] += own
    steps = (4 * np.log2(1.0 + total)).astype(np.uint8)
    return pa.table({"chunk": chunk.column("chunk").slice(0, 1), "counts": pa.array([steps.tobytes()], pa.binary())})


def _prefixes(n: int, percent: int, bits: int, sketch: Broadcast) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("ngramjoin")
        often: np.ndarray = sketch.value
        seen: set[int] = set()
        for batch in batches:
            for _, texts in text_blocks(batch.column(0), BLOCK_BYTES):
                tokens, keys, sizes, places = [], [], [], []
                for grams in ngram_sets(texts, n):
                    size = len(grams)
                    if not size or (key := set_key(grams)) in seen:
                        continue
                    seen.add(key)
                    if len(seen) > 2_000_000:
                        seen.clear()
                    least = -(-percent * size // 100)
                    rank = often[(grams >> U64(64 - bits)).astype(np.int64)]
                    first = grams[np.argsort(rank, kind="stable")[: size - least + 1]]
                    tokens.append(first.view(np.int64))
                    keys.append(np.full(len(first), key))
                    sizes.append(np.full(len(first), size, np.int32))
                    places.append(np.arange(len(first), dtype=np.int32))
                if tokens:
                    columns = [np.concatenate(x) for x in (tokens, keys, sizes, places)]
                    for at in range(0, len(columns[0]), 100_000):
                        yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 100_000]) for c in columns], ["token", "key", "n", "pos"])

    return run


def pivots(sketch: np.ndarray, ranges: int) -> np.ndarray:
    """Where the global order (step, then hash) is cut: ``ranges`` parts with about as many n-grams each."""
    weight = np.bincount(sketch, minlength=256) * (np.exp2(np.arange(256) / 4) - 1)
    ends = np.cumsum(weight)
    at = np.arange(1, ranges) * (ends[-1] / ranges) if ends[-1] else np.zeros(0)
    step = np.minimum(np.searchsorted(ends, at, side="left"), 255)
    part = np.clip((at - (ends[step] - weight[step])) / np.maximum(weight[step], 1e-9), 0, 1)
    return (step.astype(U64) << U64(56)) | (part * ((1 << 56) - 1)).astype(U64)


def _able(na: np.ndarray, nb: np.ndarray, pa_: np.ndarray, pb: np.ndarray, percent: int) -> np.ndarray:
    """Whether the sizes allow a link, and the places do if this is the first n-gram in common."""
    na, nb = na.astype(np.int64), nb.astype(np.int64)
    most = 1 + np.minimum(na - 1 - pa_, nb - 1 - pb)
    return (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & ((100 + percent) * most >= percent * (na + nb))


FOUND = "kind byte, a long, b long, token long, n int, pos int"


def _candidates(percent: int, hot: int, leaders: int) -> Callable:
    """From entries sorted by n-gram, place and key: pairs (kind 0), entries of frequent n-grams (1)
    and ties of their sets to the leaders (2), which only keep a cluster together."""

    def starred(rows: list[np.ndarray], lead: list[np.ndarray], out: list) -> None:
        token, key, n, pos = rows
        out[1].append(rows)
        for j in range(len(lead[1])):
            able = _able(n, np.full(len(n), lead[2][j]), pos, np.full(len(n), lead[3][j]), percent) & (key != lead[1][j])
            if able.any():
                out[0].append((key[able], np.full(int(able.sum()), lead[1][j])))
        other = key != lead[1][0]
        if other.any():
            out[2].append((key[other], np.full(int(other.sum()), lead[1][0])))

    def flushed(out: list) -> Iterator[pa.RecordBatch]:
        names = ["kind", "a", "b", "token", "n", "pos"]
        for kind in (0, 2):
            if out[kind]:
                a, b = (np.concatenate(x) for x in zip(*out[kind], strict=True))
                a, b = np.minimum(a, b), np.maximum(a, b)
                order = np.lexsort((b, a))
                a, b = a[order], b[order]
                new = np.ones(len(a), bool)
                new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
                k = int(new.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, kind, np.int8)), pa.array(a[new]), pa.array(b[new]), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int32())], names)
        if out[1]:
            token, key, n, pos = (np.concatenate(x) for x in zip(*out[1], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), 1, np.int8)), pa.array(key), pa.nulls(len(key), pa.int64()), pa.array(token), pa.array(n), pa.array(pos)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("ngramjoin")
        carry: list[np.ndarray] | None = None
        lead: list[np.ndarray] | None = None  # of the frequent n-gram that the last batch ended in
        last: tuple[int, int] | None = None

        def small(rows: list[np.ndarray], out: list) -> None:
            token, key, n, pos = rows
            for d in range(1, hot):
                same = np.flatnonzero(token[:-d] == token[d:]) if len(token) > d else ()
                if not len(same):
                    break
                able = same[_able(n[same], n[same + d], pos[same], pos[same + d], percent)]
                if len(able):
                    out[0].append((key[able], key[able + d]))

        out: list[list] = [[], [], []]
        for batch in batches:
            yield from flushed(out)
            out = [[], [], []]
            rows = [batch.column(i).to_numpy() for i in range(4)]
            token, key = rows[0], rows[1]
            fresh = np.ones(len(token), bool)  # a class has an entry for each partition that it occurs in
            fresh[1:] = (token[1:] != token[:-1]) | (key[1:] != key[:-1])
            if last is not None and len(token):
                fresh[0] = (int(token[0]), int(key[0])) != last
            if len(token):
                last = (int(token[-1]), int(key[-1]))
            rows = [x[fresh] for x in rows]
            if not len(rows[0]):
                continue
            if lead is not None:
                more = int(np.searchsorted(rows[0] != lead[0][0], True))
                if more:
                    starred([x[:more] for x in rows], lead, out)
                    rows = [x[more:] for x in rows]
                if not len(rows[0]):
                    continue
                lead = None
            if carry is not None:
                rows = [np.concatenate(x) for x in zip(carry, rows, strict=True)]
                carry = None
            token = rows[0]
            first = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
            size = np.diff(np.append(first, len(token)))
            often = size > hot
            for g in np.flatnonzero(often):
                own = [x[first[g] : first[g] + size[g]] for x in rows]
                top = [x[:leaders] for x in own]
                starred(own, top, out)
                if g == len(first) - 1:
                    lead = top
            rest = np.repeat(~often & (size > 1), size)
            if lead is None:
                rest[first[-1] :] = False
                carry = [x[first[-1] :] for x in rows]
            small([x[rest] for x in rows], out)
        if carry is not None:
            small(carry, out)
        yield from flushed(out)

    return run


def _cross(percent: int, partners: int = 0, turn: int = 0) -> Callable:
    """Pairs, each once, between sets of different components that are in one group (``token``), of one unit of groups.
    With ``partners``, of each set outside an n-gram's largest component at most so many, chosen by hash."""

    def run(table: pa.Table) -> pa.Table:
        token, key, n, pos, root, side = (table.column(c).to_numpy() for c in ("token", "key", "n", "pos", "root", "side"))
        order = np.lexsort((key, n, token))
        token, key, n, pos, root, side = (x[order] for x in (token, key, n, pos, root, side))
        draw = mix64(key.view(U64) + U64(turn))
        bounds = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1], [True]))) if len(token) else np.zeros(1, int)
        found = np.empty((2, 0), np.int64)
        fresh: list[np.ndarray] = []
        for first, last in zip(bounds[:-1], bounds[1:], strict=True):
            own = root[first:last]
            if (own == own[0]).all():
                continue
            stop = first + np.searchsorted(n[first:last], n[first:last] * 100 // percent, side="right")
            rows = range(first, last)
            if partners:
                names, count = np.unique(own, return_counts=True)
                rows = first + np.flatnonzero(own != names[count.argmax()])
                start = first + np.searchsorted(n[first:last], -(-percent * n[first:last] // 100), side="left")
            for i in rows:
                j = slice(start[i - first] if partners else i + 1, stop[i - first])
                able = root[j] != root[i]
                if able.any():
                    able &= ((side[j] != side[i]) | (side[i] == 2)) & _able(n[j], np.full(len(able), n[i]), pos[j], pos[i], percent)
                    at = j.start + np.flatnonzero(able)
                    if partners and len(at) > partners:
                        at = at[np.argpartition(draw[at] ^ draw[i], partners)[:partners]]
                    if len(at):
                        fresh.append(np.stack([np.minimum(key[at], key[i]), np.maximum(key[at], key[i])]))
            if len(fresh) > 2000:
                found, fresh = _unique(found, *fresh), []
        found = _unique(found, *fresh)
        return pa.table({"a": pa.array(found[0]), "b": pa.array(found[1])})

    return run


def _unique(*pairs: np.ndarray) -> np.ndarray:
    a, b = np.concatenate(pairs, axis=1)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return np.stack([a[new], b[new]])


def _sets(n: int, wanted: Broadcast, bits: int, sketch: Broadcast) -> Callable:
    """The fragments of each wanted set: its n-grams between two pivots of the global order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("ngramjoin")
        marks = np.frombuffer(wanted.value, np.uint8)
        often: np.ndarray = sketch.value
        cuts = pivots(often, FRAGMENTS)
        seen: set[int] = set()
        for batch in batches:
            for _, texts in text_blocks(batch.column(0), BLOCK_BYTES):
                out: list[tuple] = []
                for grams in ngram_sets(texts, n):
                    if not len(grams) or (key := set_key(grams)) in seen:
                        continue
                    at = key % (1 << FILTER_BITS)
                    if not marks[at >> 3] >> (at & 7) & 1:
                        continue
                    seen.add(key)
                    place = (often[(grams >> U64(64 - bits)).astype(np.int64)].astype(U64) << U64(56)) | (grams >> U64(8))
                    part = np.searchsorted(cuts, place, side="right")
                    order = np.argsort(part, kind="stable")
                    own, first = grams[order].view(np.int64), np.searchsorted(part[order], np.arange(FRAGMENTS + 1))
                    out += [(key, len(own), k, own[a:b]) for k, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)) if b > a]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64())), strict=True)], ["key", "n", "part", "grams"])
        trim()

    return run


def _overlaps(percent: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """How much of each pair's sets is equal within a fragment. A pair that differs here alone in more n-grams than a link
    may in all is left out: without this part its sum stays below that of a link, as it would with it."""

    def run(pairs: pa.Table, segments: pa.Table) -> pa.Table:
        flat = segments.column("grams").combine_chunks()
        offsets, values = flat.offsets.to_numpy(), flat.values.to_numpy().view(U64)
        place = {k: i for i, k in enumerate(segments.column("key").to_pylist())}
        size = segments.column("n").to_pylist()
        # One number for each different n-gram, so that a pair's overlap is a look-up in a table of marks.
        ids = np.unique(values, return_inverse=True)[1]
        marked = np.zeros(int(ids.max()) + 1 if len(ids) else 1, bool)
        own = lambda k: ids[offsets[place[k]] : offsets[place[k] + 1]]
        out: list[tuple] = []
        previous = None
        for a, b in sorted((a, b) for a, b in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist(), strict=True) if a in place and b in place):
            if a != previous:
                if previous is not None:
                    marked[own(previous)] = False
                previous = a
                marked[own(previous)] = True
            one, other = own(a), own(b)
            count = int(np.count_nonzero(marked[other]))
            if count and (100 + percent) * (len(one) + len(other) - 2 * count) <= (100 - percent) * (size[place[a]] + size[place[b]]):
                out.append((a, b, size[place[a]], size[place[b]], count))
        return pa.table({n: pa.array(x, pa.int64()) for n, x in zip(("a", "b", "na", "nb", "common"), zip(*out, strict=True) if out else [[]] * 5, strict=True)})

    return run


def _links(pairs: DataFrame, members: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets are similar enough: partial overlaps by fragment, summed per pair."""
    placed = pairs.join(members.withColumnRenamed("key", "a"), "a").select("a", "b", "bucket", F.explode(F.sequence(F.lit(0), F.lit(FRAGMENTS) * F.col("subs") - 1)).alias("fragment"))
    parts = placed.groupBy("bucket", "fragment").cogroup(segments.groupBy("bucket", "fragment")).applyInArrow(_overlaps(percent), "a long, b long, na long, nb long, common long")
    total = parts.groupBy("a", "b").agg(F.sum("common").alias("c"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    return total.where(F.lit(100) * F.col("c") >= F.lit(percent) * (F.col("na") + F.col("nb") - F.col("c"))).select("a", "b")


def _with_few(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """An inner join with counts of n-grams, broadcast only if they are few."""
    stored = written(right, "counts")
    return left.join(F.broadcast(stored) if stored.count() <= BROADCAST_ROWS else stored, on)


ENTRY = ("key", "n", "pos", "root")


def _mixed(entries: DataFrame, turn: int, block: int) -> DataFrame:
    """Each entry in one group (``token``) of at most about ``block`` of its n-gram and two neighbouring ranges of sizes, others each turn."""
    slot = entries.withColumn("slot", F.floor((F.col("range") + turn % 2) / 2))
    counted = _with_few(slot, slot.groupBy("token", "slot").agg(_blocks_of(block).alias("blocks")), ["token", "slot"])
    group = F.xxhash64("token", "slot", F.pmod(F.xxhash64("key", F.lit(turn)), F.col("blocks")))
    return counted.select(group.alias("token"), *ENTRY, F.lit(2).alias("side"))


def _blocks_of(block: int) -> Column:
    return F.ceil(F.count("*") / block).cast("int")


def _outside(entries: DataFrame, block: int) -> DataFrame:
    """Of each n-gram the entries outside its largest component (side 0) in groups with all (side 1) of their range of sizes
    and its neighbours: every block of the ones with every block of the others."""
    roots = entries.groupBy("token", "root").agg(F.count("*").alias("c"))
    top = roots.groupBy("token").agg(F.max_by("root", F.struct("c", "root")).alias("top"), F.count("*").alias("roots")).where("roots > 1").select("token", "top")
    open_ = _with_few(entries, top, ["token"])
    outside = open_.where("root <> top").withColumn("slot", F.col("range"))
    all_ = open_.withColumn("slot", F.explode(F.array(F.col("range") - 1, F.col("range"), F.col("range") + 1)))
    n_out = outside.groupBy("token", "slot").agg(_blocks_of(block).alias("b_out"))
    n_all = all_.groupBy("token", "slot").agg(_blocks_of(block).alias("b_all"))
    counts = written(n_out.join(n_all, ["token", "slot"]), "counts")
    few = F.broadcast(counts) if counts.count() <= BROADCAST_ROWS else counts
    other = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    left = outside.join(few, ["token", "slot"]).withColumns({"x": own("b_out"), "y": other("b_all")})
    right = all_.join(few, ["token", "slot"]).withColumn("x", other("b_out")).withColumn("y", own("b_all"))
    side = lambda df, k: df.select(F.xxhash64("token", "slot", "x", "y").alias("token"), *ENTRY, F.lit(k).alias("side"))
    return side(left, 0).unionByName(side(right, 1))


def similar(df: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text", sketch_bits: int = SKETCH_BITS, hot: int = HOT, block: int = BLOCK, fragment: int = FRAGMENT, unit: int = UNIT) -> DataFrame:
    """Each row's id, ``n_shingles`` (the size of its set of word ``n``-grams) and
    ``component_id``, the smallest id that it reaches over links: pairs of sets with
    100 * common >= ``percent`` * united.

    Words are runs of bytes other than ASCII white space, A-Z as a-z. A text with
    fewer than ``n`` words has one n-gram, all of them; one without words (or null)
    has none and is linked with nothing. Rows with equal sets are linked. Sets are
    compared by 64-bit hashes of their n-grams. Ids are integers (another type is an error); of rows that repeat an id each has its
    own, equal, result if their texts are equal. Other columns are left out.
    """
    spark = df.sparkSession
    if not isinstance(df.schema[id_col].dataType, IntegralType):
        raise ValueError(f"{id_col} must be an integer column")
    small_batches(spark)
    docs = df.select(F.col(id_col).cast("long").alias("id"), text)
    width = shuffle_width(spark)
    described = written(docs.mapInArrow(_described(n, sketch_bits), "id long, n long, key long, chunk int, counts binary"), "described")
    rows = described.where("chunk is null").select("id", "n", "key")
    sketch = np.zeros(1 << sketch_bits, np.uint8)  # of fixed size
    for r in described.where("chunk is not null").select("chunk", "counts").groupBy("chunk").applyInArrow(_summed, "chunk int, counts binary").collect():
        own = np.frombuffer(r["counts"], np.uint8)[: len(sketch)]
        sketch[r["chunk"] * CHUNK : r["chunk"] * CHUNK + len(own)] = own[: len(sketch) - r["chunk"] * CHUNK]
    table = spark.sparkContext.broadcast(sketch)
    entries = docs.select(text).mapInArrow(_prefixes(n, percent, sketch_bits, table), "token long, key long, n int, pos int")
    found = written(entries.repartition(width, "token").sortWithinPartitions("token", "pos", "key").mapInArrow(_candidates(percent, hot, LEADERS), FOUND), "candidates")
    classes = rows.where("n > 0").groupBy("key").agg(F.min("id").alias("first"), F.first("n").alias("n"))
    pairs = written(found.where("kind = 0").select("a", "b").distinct(), "pairs")
    clusters = components(found.where("kind <> 1"))
    cluster = clusters.select(F.col("v").alias("key"), "root").unionByName(clusters.select(F.col("root").alias("key"), "root").distinct())
    sized = cluster.join(classes.select("key", "n"), "key")
    volume = written(sized.groupBy("root").agg(F.sum("n").alias("volume")), "volume")
    total = volume.agg(F.sum("volume")).first()[0] or 0
    if total:
        buckets = max(1, int(total // (FRAGMENTS * fragment)))
        # Small clusters share a bucket; one larger than a fragment is cut into several.
        spread = volume.select("root", F.pmod(F.xxhash64("root"), F.lit(buckets)).alias("bucket"), F.ceil(F.col("volume") / (FRAGMENTS * fragment)).cast("int").alias("subs")).withColumn("bucket", F.when(F.col("subs") > 1, F.col("root")).otherwise(F.col("bucket")))
        members = written(cluster.join(spread, "root").select("key", "bucket", "subs"), "members")
        position = F.pmod(F.col("key"), F.lit(1 << FILTER_BITS))
        bitmap = bytearray(1 << (FILTER_BITS - 3))  # of fixed size
        for r in members.groupBy(F.bitmap_bucket_number(position + 1).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(position + 1)).alias("bits")).toLocalIterator():
            at = (r["k"] - 1) * 4096  # Spark counts positions and buckets of 4096 bytes from 1
            bitmap[at : at + len(r["bits"])] = r["bits"]
        sets = docs.select(text).mapInArrow(_sets(n, spark.sparkContext.broadcast(bytes(bitmap)), sketch_bits, table), "key long, n long, part int, grams array<long>")
        few = members.count() <= BROADCAST_ROWS
        placed = sets.join(F.broadcast(members) if few else members, "key").select("key", "n", "bucket", "part", "subs", "grams", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub"))
        # A set that was read in several partitions is the same each time.
        cut = F.when(F.col("subs") == 1, F.col("grams")).otherwise(F.filter("grams", lambda h: F.pmod(F.xxhash64(h), F.col("subs")) == F.col("sub")))
        segments = written(placed.select("key", "n", "bucket", (F.col("part") * F.col("subs") + F.col("sub")).alias("fragment"), cut.alias("grams")), "segments")
        links = written(_links(pairs, members, segments, percent), "links")
        # Sizes that differ by up to 100 / percent fall into one range or two neighbours.
        size = F.floor(F.log("n") / math.log(100.0001 / percent)).cast("int")
        often = written(found.where("kind = 1").select("token", F.col("a").alias("key"), "n", "pos", size.alias("range")), "entries")
        joined = components(links)
        units = max(1, -(-often.count() // unit))
        # In turns with chosen partners most sets are drawn into their component; then those outside meet all of their size.
        for turn, partners in enumerate((*TURNS, 0)) if not often.isEmpty() else ():
            rooted = often.join(joined.withColumnRenamed("v", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
            dealt = _mixed(rooted, turn, block) if partners else _outside(written(rooted, "rooted"), block)
            met = dealt.groupBy(F.pmod("token", F.lit(units)).alias("unit")).applyInArrow(_cross(percent, partners, turn), "a long, b long").distinct()
            more = written(met.join(pairs, ["a", "b"], "left_anti"), "pairs")
            late = written(_links(more, members, segments, percent), "links")
            pairs = pairs.unionByName(more)
            if not late.isEmpty():
                links = links.unionByName(late)
                joined = components(links)
        classes = classes.join(joined.withColumnRenamed("v", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
        ids = classes.groupBy("root").agg(F.min("first").alias("component_id"))
        classes = classes.join(ids, "root").select("key", "component_id")
    else:
        classes = classes.select("key", F.col("first").alias("component_id"))
    named = rows.join(classes, "key", "left")
    return named.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component_id", "id")).otherwise(F.col("id")).alias("component_id"))

