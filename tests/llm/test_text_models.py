"""Language, quality, byte-pair encoding, packing and fingerprints."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skyecho.llm import bpe, langid, lzprint, packing, quality
from skyecho.llm.common import held_out, word_hashes

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = list("ab sS'tre  \n\n\t\r\x1c\x1d\x85 ᠎﻿éΣς漢字ñ12İ3٣²½!?$#%.,’<|>|endoftext|>́ͅ\U0001f600‍") + ["<|endoftext|>", "<|startoftext|>", "'ll", "'s", " the", "  "]


def fuzz(n: int, seed: int = 5) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choices(ODD, k=rng.randint(0, 60))) for _ in range(n)] + ["", "a" * 3000, "ab" * 1500, "\n" * 700, "x" + " " * 300 + "y"]


def test_word_hashes_tell_words_apart():
    hashes, at = word_hashes([b"A b  a", b"", b"\tb\x0b\x0ca"])
    assert at.tolist() == [0, 3, 3, 5] and hashes[0] == hashes[2] == hashes[4] and hashes[1] == hashes[3] != hashes[0]


def test_byte_pairs_equal_the_library():
    texts = fuzz(4000)
    library = Tokenizer.from_file(BYTE)
    rounds, remembered = bpe.encoder(BYTE)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in remembered.encode(texts)] == want
    assert [rounds.decode(np.array(x, int)) for x in want] == [library.decode(x, skip_special_tokens=False) for x in want]
    rng = random.Random(1)
    some = [[rng.randrange(50257) for _ in range(rng.randint(0, 30))] for _ in range(500)]
    assert [rounds.decode(np.array(x, int)) for x in some] == [library.decode(x, skip_special_tokens=False) for x in some]


def test_leftmost_merges_where_ranks_are_not_ordered():
    rounds = bpe.MergeRounds(BYTE)
    words = [t.encode() for t in ("aaaaaaa", "banana", "thethethe", "漢漢")]
    want = [x.tolist() for x in rounds.merge(words)]
    rounds.ordered = False
    assert [x.tolist() for x in rounds.merge(words)] == want


def test_encode_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "The cat", "z"), (3, "The cat", "z")], "doc_id long, text string, ids string")
    got = sorted((r.doc_id, r.ids, r.decoded) for r in bpe.encode(df, BYTE).collect())
    assert got == [(1, [], ""), (2, [], ""), (3, [464, 3797], "The cat"), (3, [464, 3797], "The cat")]
    d = bpe.digests(df.where("doc_id = 3"), BYTE).first()
    assert d.n_tokens == 2 and d.ids_sha256 == hashlib.sha256(np.array([464, 3797], "<u4").tobytes()).hexdigest() and d.decoded_sha256 == hashlib.sha256(b"The cat").hexdigest()
    assert bpe.digests(df.limit(0), BYTE).count() == 0


def test_pieces_equal_the_library(spark):
    texts = fuzz(1500, 6)
    library = Tokenizer.from_file(WORD)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in packing.tokenizer(WORD).encode(texts)] == want
    df = spark.createDataFrame([(1, "a b c d e"), (2, None)], "doc_id long, text string")
    got = sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, r.ids) for r in packing.token_pieces(df, WORD, capacity=4, with_ids=True).collect())
    ids = [*library.encode("a b c d e", add_special_tokens=False).ids, 1]
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    assert got == [(1, 0, 0, 4, crc(ids[:4]), ids[:4]), (1, 1, 4, 2, crc(ids[4:]), ids[4:]), (2, 0, 0, 1, crc([1]), [1])]


@pytest.mark.parametrize("lengths", [[4096], [1] * 5000, [1366] * 90 + [2000] * 10, list(range(1, 4097, 7)), [2049] * 5 + [2047] * 5, []])
def test_sequences_hold_every_piece_once(lengths):
    packed = packing.pack_lengths(np.array(lengths, np.int64))
    assert sorted(i for q in packed for i in q) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in q) <= 4096 for q in packed)


def test_few_sequences():
    rng = np.random.default_rng(3)
    for lengths in (np.minimum(4096, rng.lognormal(6.2, 1.1, 6000).astype(int) + 1), rng.integers(1, 4097, 3000)):
        packed = packing.pack_lengths(lengths)
        plain = packing._best_fit([], list(range(len(lengths))), lengths, 4096)
        assert len(packed) <= 1.04 * len(plain) and len(packed) >= -(-lengths.sum() // 4096)


def test_packing_rows(spark):
    rows = [(i % 70, "word " * (i * 37 % 900)) for i in range(80)] + [(500, None), (None, "a"), (501, "long " * 9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("offset", F.lit("clash"))
    out = packing.pack_documents(df, WORD).toPandas()
    for _, own in out.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert own["length"].sum() <= 4096 and own["offset"].tolist() == [0, *own["length"].cumsum().tolist()[:-1]]
    long = out[out.doc_id == 501].sort_values("piece")
    assert long["length"].tolist() == [4096, 4096, 9001 - 8192] and long["start"].tolist() == [0, 4096, 8192]
    assert len(out) == 80 + 2 + 3 and packing.pack_documents(df.limit(0), WORD).count() == 0


DE, EN = "der hund und die katze schlafen im haus ", "the dog and the cat are sleeping in house "


def test_suffix_automaton_finds_longest_matches():
    text, query = [1, 2, 1, 1, 2, 3, 1], [1, 1, 2, 1, 3, 3, 1, 4]
    model = langid.Model(["x"], langid.Codes("abcd"), [langid.suffix_automaton(text)], [1.0])
    inside = lambda part: any(text[i : i + len(part)] == part for i in range(len(text)))
    count, at = 0, 0
    while at < len(query):
        end = at + 1
        while end < len(query) and inside(query[at : end + 1]):
            end += 1
        count, at = count + 1, end
    assert model.phrases(np.array(query, np.uint8), np.array([0, len(query)]))[0, 0] == count


def test_letters_of_any_script_and_whole_texts(spark):
    zh, ja, ko = "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏", "いろはにほへとちりぬるをわかよたれそつねならむ", "가나다라마바사아자차카타파하거너더러머버서어저처"
    rng = random.Random(3)
    rows = [(i, "".join(rng.choices(own, k=90)), lang) for i, (lang, own) in enumerate((("zh", zh), ("zt", zh[::-1][:12]), ("ja", ja), ("ko", ko)) * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df, F.col("doc_id") % 5 != 2, codes_per_language=2000)
    got = langid.identify(df, model, keep=("doc_id", "lang")).toPandas()
    assert (got["lang_pred"] == got["lang"]).mean() > 0.95 and model.codes.size > 60
    one = spark.createDataFrame([(1, "ab " * 900, "x"), (2, "ab " * 1000, "x")], df.schema)
    assert langid.train(one, F.lit(True), codes_per_language=50).log_length[0] == pytest.approx(np.log2(2701))
    with pytest.raises(ValueError, match="score"):
        langid.identify(df.withColumn("score", F.lit(1)), model, keep=("doc_id", "score"))


def test_names_that_clash(spark):
    df = spark.createDataFrame([(1, 0, 5)], "doc_id long, piece int, length int")
    for name in ("_shard", "offset"):
        with pytest.raises(ValueError, match=name):
            packing.pack(df.withColumn(name, F.lit(1)))
    with pytest.raises(ValueError, match="n_tokens"):
        bpe.encode(df.withColumns({"n_tokens": F.lit(1), "text": F.lit("x")}), BYTE, keep=("doc_id", "n_tokens"))


def test_language(spark):
    rows = [(i, (DE if i % 2 else EN) * (1 + i % 5), "de" if i % 2 else "en", "s") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = langid.train(df, ~held_out())
    more = spark.createDataFrame([(100, None, None, None), (101, "", None, None), (102, "12 !?", None, None), (103, EN * 400, "de", None), (103, EN * 400, "de", None), (None, DE, None, None)], df.schema)
    got = {(r.doc_id, r.lang_pred) for r in langid.identify(df.unionByName(more), model).collect()}
    assert {(i, lang) for i, _, lang, _ in rows} <= got and {(100, "und"), (101, "und"), (102, "und"), (103, "en"), (None, "de")} <= got
    assert langid.identify(df, model).where("score < 0 or score > 1").count() == 0
    assert langid.train(df.limit(0), ~held_out()) is None and langid.train(df.withColumn("lang", F.lit(None).cast("string")), ~held_out()) is None
    assert {r.lang_pred for r in langid.identify(df, None).collect()} == {"und"}


def test_quality(spark):
    rng = random.Random(2)
    words = ["stone", "river", "light", "green", "walk", "under", "seven", "house", "quiet", "paper"]
    good = lambda: " ".join(rng.choice(words) for _ in range(60)) + "."
    bad = lambda: "!!! ".join(w.upper() for w in [rng.choice(words)] * 60)
    rows = [(i, bad() if i % 4 == 0 else good(), "clash") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(0, 400, 3)], "doc_id long, quality int")
    model = quality.train(df, labels, ~held_out())
    got = {r.doc_id: r.score for r in quality.score(df.drop("score"), model).collect()}
    assert np.mean([(got[i] >= 0.7) == (i % 4 != 0) for i in got]) > 0.97
    odd = spark.createDataFrame([(900, None), (901, ""), (902, "x" * 50_000), (902, "x" * 50_000)], "doc_id long, text string")
    scores = [r.score for r in quality.score(odd, model).collect()]
    assert len(scores) == 4 and all(0 <= s <= 1 for s in scores) and scores[0] == scores[1] and scores[2] == scores[3]
    kept = quality.accepted(df, model)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, s in got.items() if s >= 0.7}
    assert quality.train(df, labels.where("quality = 0"), ~held_out()) is None and quality.train(df.limit(0), labels.limit(0), ~held_out()) is None
    assert {r.score for r in quality.score(odd, None).collect()} == {0.5} and quality.accepted(df, None).count() == 400


def test_risk_against_a_plain_version():
    rng = np.random.default_rng(4)
    for shift, prior in ((0.0, 0.3), (1.5, 0.6), (-2.5, 0.9)):
        zp, zu = rng.normal(1, 1, 7), rng.normal(shift, 1, 11)
        plus, minus = (lambda z: np.log(1 + np.exp(-z))), (lambda z: np.log(1 + np.exp(z)))
        negative = minus(zu).mean() - prior * minus(zp).mean()
        assert quality.risk(zp, zu, prior) == pytest.approx(prior * plus(zp).mean() + max(0, negative))
        # Where the negative part holds, the step is the risk's gradient; below 0 it is that part's gradient turned round.
        of = (lambda a, b: quality.risk(a, b, prior)) if negative >= 0 else (lambda a, b: -(minus(b).mean() - prior * minus(a).mean()))
        z, got = np.concatenate([zp, zu]), quality.risk_gradient(zp, zu, prior)
        for i in range(len(z)):
            up, down = z.copy(), z.copy()
            up[i] += 1e-6
            down[i] -= 1e-6
            assert got[i] == pytest.approx((of(up[:7], up[7:]) - of(down[:7], down[7:])) / 2e-6, abs=1e-8)


@pytest.mark.parametrize("prior", [0.15, 0.5, 0.85])
def test_prior_from_good_and_unlabelled_rows(prior):
    rng = np.random.default_rng(6)
    rows = lambda n, at: rng.normal(at, 1, (n, 6))
    n = int(4000 * prior)
    unlabelled = rng.permutation(np.concatenate([rows(n, 1.5), rows(4000 - n, -1.5)]))
    assert quality.estimate_prior(rows(2000, 1.5), unlabelled) == pytest.approx(prior, abs=0.06)


def test_quality_without_bad_labels_and_with_string_ids(spark):
    rng = random.Random(8)
    words = ["stone", "river", "light", "green", "walk", "under", "seven", "house", "quiet", "paper"]
    rows = [(f"d{i}", "!!! ".join([rng.choice(words).upper()] * 50) if i % 4 == 0 else " ".join(rng.choice(words) for _ in range(60)) + ".") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    trusted = spark.createDataFrame([(f"d{i}", 1) for i in range(600) if i % 4 and i % 3 == 0], "doc_id string, quality int")
    model = quality.train(df, trusted, F.lit(True))
    assert model.prior == pytest.approx(0.75, abs=0.12)
    got = {r.doc_id: r.score for r in quality.score(df, model).collect()}
    assert np.mean([(got[f"d{i}"] >= 0.5) == (i % 4 != 0) for i in range(600)]) > 0.97
    with pytest.raises(ValueError, match="score"):
        quality.score(df.withColumn("score", F.lit(1)), model, keep=("doc_id", "score"))


def test_bounds_of_quality_training(spark, monkeypatch):
    drawn = []
    monkeypatch.setattr(quality, "estimate_prior", lambda good, unlabelled: 0.5)
    monkeypatch.setattr(quality, "fit", lambda good, unlabelled, prior: drawn.append((len(good), len(unlabelled))))
    df = spark.range(20_500).select(F.col("id").alias("doc_id"), F.lit("a text").alias("text"))
    labels = spark.range(7000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    quality.train(df, labels, F.lit(True))
    assert drawn == [(6000, 12_000)]


def brute_phrases(text: str) -> set[str]:
    seen, at = set(), 0
    while at < len(text):
        end = at + 1
        while end <= len(text) and text[at:end] in seen:
            end += 1
        if end > len(text):
            break
        seen.add(text[at:end])
        at = end
    return seen


def test_phrases_and_edits():
    rng = random.Random(4)
    for _ in range(60):
        text, other = ("".join(rng.choices("abé \U0001f600", k=rng.randint(0, 80))) for _ in range(2))
        keep = len(text) - len(text) // 2
        parsed = lzprint.Parsed(text, keep)
        seen: set[str] = set()
        lzprint._parse(text, [], seen, "", 0)
        assert seen == brute_phrases(text) and (parsed.signature == lzprint.Parsed(text, len(text)).signature).all()
        edited, signature = parsed.edited(other[: len(text) // 2])
        assert edited == text[:keep] + other[: len(text) // 2] and (signature == lzprint.Parsed(edited, len(edited)).signature).all()


def test_fingerprints_of_neighbours(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choices("abcde ", k=rng.randint(0, 400))) for _ in range(90)]
    rows = [(i * 7 - 100, t) for i, t in enumerate(texts)] + [(10**17, None), (10**17 + 1, "\U0001f600" * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumn("_key", F.lit(1))
    got = {r.doc_id: r for r in lzprint.with_edits(df).collect()}
    assert len(got) == len(rows)
    order = sorted(rows)
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1], strict=True):
        t, nxt = t or "", nxt or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        of = lambda x: lzprint.Parsed(x, len(x)).signature
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert got[i].fingerprint == lzprint.encoded(of(t)) and got[i].edited_fingerprint == lzprint.encoded(of(edited))
        assert got[i].near_edited == lzprint.likeness(of(t), of(edited)) and got[i].near_next == lzprint.likeness(of(t), of(nxt))
    alone = lzprint.with_edits(spark.createDataFrame([(3, "abcabc")], "doc_id long, text string")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1 and lzprint.with_edits(df.limit(0)).count() == 0
    same = lzprint.fingerprints(spark.createDataFrame([(1, "abcab"), (2, "abcab"), (3, None)], "doc_id long, text string")).collect()
    assert same[0].fingerprint == same[1].fingerprint != same[2].fingerprint
