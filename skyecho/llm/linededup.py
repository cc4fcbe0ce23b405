"""Removal of lines that match an earlier line, by an exact set-similarity join in
DataFrame expressions only.

1. Lines that repeat an earlier line letter by letter are found by hash; only the
   first of each goes on.
2. A line is the set of its words. All words are counted exactly; a table of fixed
   size keeps the largest count of each bucket of words, which orders the words of
   every line, rare first. Words of a single line are left out.
3. Crowds of near copies are thinned first: lines of about one size that agree in
   a signature (two of the least or greatest of their word hashes) are compared
   with the first of them only. What that removes is looked up no more,
   except as the earlier line of another.
4. Prefix entries meet by word. The join itself tests size, place and a bitmap of
   the words' parities before it makes a row: the longer line brings its whole
   prefix, the shorter one only the part that suffices for it. Frequent words are
   dealt by ranges of line sizes, of which only neighbours meet.
5. The pairs left are verified on their whole sets, and the later line of each
   match goes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyecho.llm.common import clashing, discard, written

#: Eight buckets of words to each of 2^20 numbers.
SKETCH_BITS = 23
#: Words of so many lines are dealt by ranges of line sizes; so many lines with one signature are a crowd.
HOT = 128
#: Rows of a table with up to a few dozen bytes each that may be broadcast; beyond it both sides are shuffled.
BROADCAST_ROWS = 400_000
#: How arrays of hashes are written: a dictionary of them would overflow.
HASHES = {"compression": "zstd", "parquet.compression.codec.zstd.level": "1", "parquet.enable.dictionary": "false"}
#: What an entry must not be met as (the longer line; the shorter one), and whether its line is already gone.
NOT_PROBE, NOT_INDEX, GONE = 1, 2, 4


def _joined(left: DataFrame, right: DataFrame, rows: int, on: list[str] | Column, how: str) -> DataFrame:
    """Joins with a side of ``rows`` rows, broadcast only if these are few."""
    return left.join(F.broadcast(right) if rows <= BROADCAST_ROWS else right, on, how)


def _rarity(sets: DataFrame, bits: int) -> DataFrame:
    """The table (one row ``t``, an array of 2^(``bits`` - 3) numbers) of eight steps a number: for each bucket of words
    1 + four times log2 of the largest count of any of its words, 0 if each is in one line only."""
    counts = sets.select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("c")).where("c > 1")
    step = F.least(F.lit(120), F.floor(F.log2(F.col("c")) * 4) + 1).cast("long")
    places = 1 << (bits - 3)
    found = counts.select(F.shiftright("w", 6).bitwiseAND(F.lit(places - 1)).cast("int").alias("at"), F.col("w").bitwiseAND(F.lit(56)).cast("int").alias("turn"), step.alias("s"))
    # Of fixed size: a number for each place, whether any word is there or not.
    packed = found.groupBy("at", "turn").agg(F.max("s").alias("s")).groupBy("at").agg(F.bit_or(F.expr("shiftleft(s, turn)")).alias("x"))
    table = written(packed, "line-rarity")
    every = table.sparkSession.range(places).select(F.col("id").cast("int").alias("at"), F.lit(0).cast("long").alias("x")).unionByName(table)
    whole = every.groupBy("at").agg(F.max(F.struct(F.col("x") != 0, "x"))["x"].alias("x"))
    return written(whole.agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda p: p["x"]).alias("t")), "line-rarity")


def _spaced(text: Column) -> Column:
    """The text with a space for every tab and carriage return; mostly there is none."""
    some = F.contains(text, F.lit("\t")) | F.contains(text, F.lit("\r"))
    return F.when(some, F.translate(text, "\t\r", "  ")).otherwise(text)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The ids of the later lines of the pairs (a, b) whose whole sets are similar enough."""
    wanted = written(pairs.select(F.col("a").alias("line_id")).union(pairs.select("b")).distinct(), "line-ids")
    own = _joined(sets, wanted, wanted.count(), ["line_id"], "left_semi").select("line_id", F.struct("_id", "_hash", "no").alias("place"), "n", "words")
    side = lambda x: own.select(*(F.col(c).alias(f"{c}_{x}") for c in own.columns))
    both = pairs.join(side("a"), F.col("a") == F.col("line_id_a")).join(side("b"), F.col("b") == F.col("line_id_b"))
    common = F.size(F.array_intersect("words_a", "words_b"))
    match = (F.lit(100) * common >= F.lit(percent) * (F.col("n_a") + F.col("n_b") - common)) & ~F.col("place_a").eqNullSafe(F.col("place_b"))
    late = written(both.where(match).select(F.when(F.col("place_a") < F.col("place_b"), F.col("b")).otherwise(F.col("a")).alias("line_id")).distinct(), "lines-gone")
    discard(wanted)
    return late


def _alike(n: Column, m: Column, bits: Column, other: Column, percent: int) -> Column:
    """Whether sets of m <= n words with these parities can be similar enough: the parities that differ are at most
    as many as the words that only one of the sets has."""
    differ = F.bit_count(bits.getField("lo").bitwiseXOR(other.getField("lo"))) + F.bit_count(bits.getField("hi").bitwiseXOR(other.getField("hi")))
    return (F.lit(100) * m >= F.lit(percent) * n) & (F.lit(100 + percent) * differ <= F.lit(100 - percent) * (n + m))


def _size_range(n: Column, percent: int) -> Column:
    """Sizes that differ by up to 100 / ``percent`` fall into one range or two neighbours."""
    return F.floor(F.log(n) / math.log(100.0001 / percent)).cast("int")


def _thinned(sets: DataFrame, percent: int, hot: int) -> DataFrame:
    """The ids of lines that match the first line with the same signature and range of sizes, of ``hot`` or more such lines."""
    signed = sets.withColumn("range", _size_range(F.col("n"), percent)).select("line_id", "_id", "_hash", "no", "n", "bits", "range", F.explode("signs").alias("sign"))
    signed = signed.withColumn("sign", F.xxhash64("sign", "range")).drop("range")
    several = written(signed.groupBy("sign").agg(F.count("*").alias("c")).where(F.col("c") >= hot).select("sign"), "line-signs")
    crowd = _joined(signed, several, several.count(), ["sign"], "left_semi").select("sign", "line_id", F.struct("_id", "_hash", "no").alias("place"), "n", "bits")
    crowd = written(crowd, "line-crowds")
    lead = written(crowd.groupBy("sign").agg(F.min(F.struct("place", "line_id", "n", "bits")).alias("x")).select("sign", F.col("x.line_id").alias("a"), F.col("x.n").alias("n_a"), F.col("x.bits").alias("bits_a")), "line-leads")
    long, short = F.greatest("n", "n_a"), F.least("n", "n_a")
    pairs = _joined(crowd, lead, lead.count(), ["sign"], "inner").where((F.col("line_id") != F.col("a")) & _alike(long, short, F.col("bits"), F.col("bits_a"), percent))
    pairs = written(pairs.select("a", F.col("line_id").alias("b")).distinct(), "line-pairs")
    gone = _verified(pairs, sets, percent)
    discard(several, crowd, lead, pairs)
    return gone


def _met(sets: DataFrame, gone: DataFrame, percent: int, bits: int, hot: int) -> DataFrame:
    """Pairs (a, b) of lines, not both gone, that share a word of their prefixes and pass the filters."""
    flagged = _joined(sets, gone.withColumn("gone", F.lit(GONE)), gone.count(), ["line_id"], "left")
    table = _rarity(sets, bits)
    places = (1 << (bits - 3)) - 1
    # A step of rarity above 56 bits of hash. The least word that a similar line must share stands among the first n - least + 1.
    # Never null, so that the arrays are sorted as plain numbers.
    step = "coalesce(shiftleft(shiftrightunsigned(get(t, cast(shiftright(w, 6) & {0} as int)), cast(w & 56 as int)), 56) | w, 0L)".format(places)
    ordered = F.sort_array(F.expr(f"transform(words, w -> {step})"))
    ranked = flagged.withColumn("t", table.scalar()).select("line_id", "n", "bits", F.coalesce("gone", F.lit(0)).alias("gone"), F.slice(ordered, F.lit(1), F.expr(f"n - cast(ceil(n * {percent} / 100) as int) + 1")).alias("prefix"))
    entries = ranked.select("line_id", "n", "bits", "gone", F.posexplode_outer("prefix").alias("pos", "word")).where(F.shiftrightunsigned("word", 56) > 0)
    # As the shorter line: what remains from this word on must reach the overlap of two sets of n words.
    index = F.expr(f"{100 + percent}L * (n - pos) >= {2 * percent}L * n")
    often = F.shiftrightunsigned("word", 56) > 4 * math.log2(hot)
    size = _size_range(F.col("n"), percent)
    place = F.shiftleft(F.col("n").cast("long"), 32) + F.shiftleft(F.col("pos").cast("long"), 3)
    entry = lambda key, flags: F.struct(key.alias("key"), (place + flags + F.col("gone")).alias("place"))
    word = F.col("word").bitwiseAND(F.lit((1 << 40) - 1))
    own = F.when(often, F.xxhash64("word", size)).otherwise(word)
    role = F.when(index, F.lit(0)).otherwise(F.lit(NOT_INDEX))
    dealt = F.when(often & index, F.array(entry(own, role), entry(F.xxhash64("word", size + 1), F.lit(NOT_PROBE)))).otherwise(F.array(entry(own, role)))
    entries = entries.select("line_id", "bits", F.explode_outer(dealt).alias("e")).select(F.col("e.key").alias("key"), F.col("e.place").alias("place"), "line_id", F.col("bits.lo").alias("lo"), F.col("bits.hi").alias("hi"))
    x, y = (entries.select(*(F.col(c).alias(f"{c}_{s}") for c in entries.columns)) for s in "xy")
    n, m = F.shiftright("place_x", 32), F.shiftright("place_y", 32)
    at = lambda p: F.shiftrightunsigned(F.col(p), 3).bitwiseAND(F.lit((1 << 29) - 1))
    parities = lambda s: F.struct(F.col(f"lo_{s}").alias("lo"), F.col(f"hi_{s}").alias("hi"))
    # Conditions of both sides, so that both read the same exchange.
    roles = F.col("place_x").bitwiseAND(F.lit(NOT_PROBE)) + F.col("place_y").bitwiseAND(F.lit(NOT_INDEX)) == 0
    live = F.col("place_x").bitwiseAND(F.col("place_y")).bitwiseAND(F.lit(GONE)) == 0
    once = (m < n) | ((m == n) & (F.col("line_id_x") < F.col("line_id_y")))
    reach = F.lit(100 + percent) * F.least(n - at("place_x"), m - at("place_y")) >= F.lit(percent) * (n + m)
    met = x.join(y, (F.col("key_x") == F.col("key_y")) & once & roles & live & _alike(n, m, parities("x"), parities("y"), percent) & reach)
    return written(met.select(F.col("line_id_x").alias("a"), F.col("line_id_y").alias("b")).distinct(), "line-pairs")


def removals(df: DataFrame, percent: int = 80, id_col: str = "doc_id", text: str = "text", sketch_bits: int = SKETCH_BITS, hot: int = HOT) -> DataFrame:
    """The numbers (from 0) of the lines that match an earlier line, one row per document
    that has any: ``_id``, ``_hash`` (of the text) and ``lines``.

    The order is by id (nulls first), then the text's hash, then line. Rows that
    repeat id and text are one document here: all keep and lose the same lines.
    Lines without a word match nothing. Words are runs of characters other than
    spaces, tabs and line ends, in lower case.
    """
    docs = df.where(F.col(text).isNotNull()).select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_hash"), F.split(_spaced(F.col(text)), "\n", -1).alias("_lines"))
    place = F.struct("_id", "_hash", "no")
    # Outer generators all over: the filters inferred for inner ones would make their arrays again.
    lines = docs.select("_id", "_hash", F.posexplode_outer("_lines").alias("no", "line"))
    same = ["h1", "h2"]
    hashed = lines.select("_id", "_hash", "no", F.xxhash64("line").alias("h1"), F.hash("line").alias("h2"), F.trim("line").alias("_bare")).where("_bare <> ''").drop("_bare")
    hashed = written(hashed, "line-hashes", HASHES)
    several = written(hashed.groupBy(*same).agg(F.count("*").alias("c")).where("c > 1").select(*same), "line-copies")
    met = written(_joined(hashed, several, several.count(), same, "left_semi"), "line-copies")
    first = written(met.groupBy(*same).agg(F.min(place).alias("first")), "line-copies")
    later = _joined(met, first, first.count(), same, "inner").where(~place.eqNullSafe(F.col("first")))
    copies = written(later.groupBy("_id", "_hash").agg(F.collect_set("no").alias("copies")), "line-copies")
    discard(hashed, several, met, first)
    # What goes on: first occurrences, as hashes of their words (56 bits, a step of rarity fits above them).
    both = (docs["_hash"] == F.col("_h")) & docs["_id"].eqNullSafe(F.col("_i"))
    rest = _joined(docs, copies.select(F.col("_id").alias("_i"), F.col("_hash").alias("_h"), "copies"), copies.count(), both, "left")
    kept = F.when(F.col("copies").isNull(), F.sequence(F.lit(0), F.size("_lines") - 1)).otherwise(F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("copies")))
    fresh = rest.select("_id", "_hash", F.explode_outer(F.transform(kept, lambda i: F.struct(i.alias("no"), F.get("_lines", i).alias("line")))).alias("x"))
    hashed_word = lambda w: F.shiftrightunsigned(F.xxhash64(w), 8)
    words = F.array_remove(F.array_distinct(F.transform(F.split(F.lower("x.line"), " ", -1), hashed_word)), hashed_word(F.lit("")))
    # A filter on the words themselves would make them twice.
    sets = fresh.where(F.trim("x.line") != "").select("_id", "_hash", "x.no", F.sort_array(words).alias("words"))
    # Parities of 128 kinds of words, by seven bits of each: ``every`` has them by the first six, ``high`` those of words with
    # the seventh bit (as far as there is room behind it), which ``lo`` then leaves out.
    every = F.expr("aggregate(words, 0L, (all, w) -> all ^ shiftleft(1L, cast(w & 63 as int)))").alias("every")
    high = F.expr("aggregate(words, 0L, (all, w) -> all ^ shiftleft(w & 64, cast(w & 63 as int)))").alias("high")
    ends = lambda a, b: F.xxhash64(F.get("words", F.lit(a) if a >= 0 else F.size("words") + a), F.get("words", F.lit(b) if b >= 0 else F.size("words") + b), F.lit(a))
    sets = sets.select("_id", "_hash", "no", "words", every, high, F.transform("words", lambda w: F.xxhash64(w)).alias("turned"))
    bits = F.struct(F.col("every").bitwiseXOR(F.shiftrightunsigned("high", 6)).alias("lo"), F.col("high").alias("hi"))
    signs = F.array(ends(0, 1), ends(-1, -2), F.xxhash64(F.array_min("turned"), F.array_max("turned")))
    sets = sets.select(F.monotonically_increasing_id().alias("line_id"), "_id", "_hash", "no", F.size("words").alias("n"), "words", bits.alias("bits"), signs.alias("signs"))
    sets = written(sets, "line-sets", HASHES)
    gone = _thinned(sets, percent, hot)
    pairs = _met(sets, gone, percent, sketch_bits, hot)
    gone = gone.unionByName(_verified(pairs, sets, percent)).distinct()
    near = written(sets.join(gone, "line_id", "left_semi").groupBy("_id", "_hash").agg(F.collect_set("no").alias("copies")), "line-near")
    discard(sets, pairs)
    return copies.unionByName(near).groupBy("_id", "_hash").agg(F.array_distinct(F.flatten(F.collect_list("copies"))).alias("lines"))


def dedup(df: DataFrame, percent: int = 80, id_col: str = "doc_id", text: str = "text", counts: bool = False, **options: int) -> DataFrame:
    """``df`` without the lines that ``removals`` names; with ``counts`` also ``n_lines`` and
    ``n_removed``. Null texts stay null; a text may end up empty, its row stays.
    Column names that begin with __line are an error, as are ``n_lines`` and ``n_removed`` with ``counts``."""
    clashing(df, *(("n_lines", "n_removed") if counts else ()), prefix="__line")
    found = removals(df, percent, id_col, text, **options)
    found = written(found.select(F.col("_id").alias("__line_id"), F.col("_hash").alias("__line_hash"), F.col("lines").alias("__line_gone")), "line-removals")
    keyed = df.withColumn("__line_key", F.xxhash64(text))
    both = (F.col("__line_key") == F.col("__line_hash")) & F.col(id_col).eqNullSafe(F.col("__line_id"))
    joined = _joined(keyed, found, found.count(), both, "left")
    lines = F.split(text, "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__line_gone"))
    # split() stands in a column of its own, as the transform reads it for every line.
    joined = joined.withColumn("__line_all", F.when(F.col("__line_gone").isNotNull(), lines)).withColumn(text, F.when(F.col("__line_gone").isNotNull(), F.array_join(F.transform(kept, lambda i: F.get("__line_all", i)), "\n")).otherwise(F.col(text)))
    out = list(df.columns)
    if counts:
        joined = joined.withColumns({"n_removed": F.coalesce(F.size("__line_gone"), F.lit(0)), "n_lines": F.coalesce(F.size("__line_all"), F.size(F.split(text, "\n", -1)), F.lit(0))})
        out += ["n_lines", "n_removed"]
    return joined.select(*out)
