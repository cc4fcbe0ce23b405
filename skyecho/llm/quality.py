"""Quality by learning from positive and unlabelled text.

Trusted good documents and unlabelled web text as it comes train a small network
under the non-negative risk: with p the class prior, p * loss+(good) plus
max(0, loss-(unlabelled) - p * loss-(good)). The prior is estimated from the same
two samples: a network that tells good from unlabelled orders held-out rows, and
where it is surest the share of unlabelled rows over that of good ones is least,
which is the prior. Labels of bad documents are used for nothing. Features are shares of characters and character pairs and
measures of words and repetition over the whole text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyecho.llm.common import IS_SPACE, clashing, enter, mix64, small_batches, text_blocks, trim, word_hashes

PAIR_BUCKETS = 128
#: Bytes of texts that are described at once.
BLOCK_BYTES = 1_000_000
#: Kinds of bytes: lower case, upper case, digits, white space, other ASCII, beyond ASCII.
KIND = np.full(256, 4, np.uint8)
KIND[ord("a") : ord("z") + 1] = 0
KIND[ord("A") : ord("Z") + 1] = 1
KIND[ord("0") : ord("9") + 1] = 2
KIND[IS_SPACE] = 3
KIND[128:] = 5
#: Features: kinds, single signs, hashed pairs of bytes, then measures of words.
SIGNS = [b for b in range(33, 127) if KIND[b] == 4]
MEASURES = 14
WIDTH = 6 + 36 + len(SIGNS) + PAIR_BUCKETS + MEASURES


def _pair_bucket() -> np.ndarray:
    pairs = np.arange(1 << 16, dtype=np.uint64) + np.uint64(1)
    return (mix64(pairs) % np.uint64(PAIR_BUCKETS)).astype(np.int64)


PAIR_BUCKET = _pair_bucket()


def features(texts: list[bytes]) -> np.ndarray:
    """A row of WIDTH numbers for each text."""
    out = np.zeros((len(texts), WIDTH), np.float32)
    words, at = word_hashes(texts)
    for i, text in enumerate(texts):
        data = np.frombuffer(text, np.uint8)
        n = max(1, len(data))
        seen = np.bincount(data, minlength=256)
        kinds = np.bincount(KIND, seen, 6) / n
        moves = pairs = ()
        if len(data) > 1:
            k = KIND[data]
            moves = np.bincount(k[:-1].astype(np.int64) * 6 + k[1:], minlength=36) / n
            pair = np.bincount((data[:-1].astype(np.int64) << 8) | data[1:], minlength=1 << 16)
            pairs = np.bincount(PAIR_BUCKET, pair, PAIR_BUCKETS) / n
        own = words[at[i] : at[i + 1]]
        w = len(own)
        row = [np.log1p(n) / 10, np.log1p(w) / 10, n / max(1, w) / 10]
        for size in (1, 2, 5):
            grams = own[: max(0, w - size + 1)].copy()
            for j in range(1, size):
                grams = grams * np.uint64(0x9E3779B97F4A7C15) + own[j : w - size + 1 + j]
            distinct, count = np.unique(grams, return_counts=True)
            row += [len(distinct) / max(1, len(grams)), (count.max() if len(count) else 0) / max(1, len(grams)), float((count[count > 1]).sum()) / max(1, len(grams))]
        lines = text.split(b"\n")
        row += [len(set(lines)) / len(lines), len(lines) / max(1, w)]
        out[i, :6] = kinds
        out[i, 6 : 6 + len(moves)] = moves
        out[i, 42 : 42 + len(SIGNS)] = seen[SIGNS] / n
        if len(pairs):
            out[i, 42 + len(SIGNS) : 42 + len(SIGNS) + PAIR_BUCKETS] = pairs
        out[i, -MEASURES:] = row
    return np.sqrt(np.maximum(out, 0))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    prior: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.layers
        return np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ a + b) @ c + d

    def score(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(features(texts)), -30, 30)))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def risk(zp: np.ndarray, zu: np.ndarray, prior: float) -> float:
    """The non-negative risk of logits of good and of unlabelled rows under the logistic loss."""
    return prior * np.logaddexp(0, -zp).mean() + max(0.0, np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean())


def risk_gradient(zp: np.ndarray, zu: np.ndarray, prior: float) -> np.ndarray:
    """What a step goes against, by logit, good ones first: the gradient of the whole risk, or where its negative part has
    fallen below 0 that part's alone, turned round."""
    sp, su = sigmoid(zp), sigmoid(zu)
    if np.logaddexp(0, zu).mean() >= prior * np.logaddexp(0, zp).mean():
        return np.concatenate([prior * (sp - 1) / len(zp) - prior * sp / len(zp), su / len(zu)])
    return np.concatenate([prior * sp / len(zp), -su / len(zu)])


def apart_gradient(zp: np.ndarray, zu: np.ndarray, _: float) -> np.ndarray:
    """The gradient of the plain logistic loss that tells good rows from unlabelled ones, both kinds weighing the same."""
    return np.concatenate([(sigmoid(zp) - 1) / (2 * len(zp)), sigmoid(zu) / (2 * len(zu))])


def fit(good: np.ndarray, unlabelled: np.ndarray, prior: float, hidden: int = 16, epochs: int = 60, batch: int = 512, rate: float = 3e-3, decay: float = 1e-3, seed: int = 11, gradient: Callable[[np.ndarray, np.ndarray, float], np.ndarray] = risk_gradient) -> Model:
    """Follows the gradient, by default that of the non-negative risk, by Adam; deterministic."""
    rng = np.random.default_rng(seed)
    both = np.concatenate([good, unlabelled]).astype(float)
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-3
    good, unlabelled = (np.clip((x - mean) / scale, -8, 8) for x in (good.astype(float), unlabelled.astype(float)))
    layers = [rng.normal(0, 1 / np.sqrt(good.shape[1]), (good.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(())]
    first, second = [np.zeros_like(x) for x in layers], [np.zeros_like(x) for x in layers]
    steps = max(1, len(unlabelled) // batch)
    average = [np.zeros_like(x) for x in layers]
    for t in range(1, epochs * steps + 1):
        p = good[rng.integers(0, len(good), min(batch, len(good)))]
        u = unlabelled[rng.integers(0, len(unlabelled), min(batch, len(unlabelled)))]
        x = np.concatenate([p, u])
        h = np.tanh(x @ layers[0] + layers[1])
        z = h @ layers[2] + layers[3]
        gz = gradient(z[: len(p)], z[len(p) :], prior)
        gh = np.outer(gz, layers[2]) * (1 - h * h)
        grads = [x.T @ gh + decay * layers[0], gh.sum(axis=0), h.T @ gz + decay * layers[2], gz.sum()]
        for k, g in enumerate(grads):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            layers[k] = layers[k] - rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
            average[k] = average[k] + layers[k] / (epochs * steps - epochs * steps // 2) if t > epochs * steps // 2 else average[k]
    return Model(mean, scale, average, prior)


def least_ratio(good: np.ndarray, unlabelled: np.ndarray, doubt: float = 0.1) -> float:
    """The share of good rows among unlabelled ones, from held-out scores of both: of all thresholds, the least share of
    unlabelled scores over that of good ones above it, where too few scores for a sure share count against a threshold."""
    at = np.sort(good)[::-1]
    above_good = np.searchsorted(-np.sort(good)[::-1], -at, side="right") / len(good)
    above = np.searchsorted(-np.sort(unlabelled)[::-1], -at, side="right") / len(unlabelled)
    width = np.sqrt(np.log(4 / doubt) / (2 * len(unlabelled))) + np.sqrt(np.log(4 / doubt) / (2 * len(good)))
    best = int(np.argmin((above + width) / above_good))
    return float(above[best] / above_good[best])


def estimate_prior(good: np.ndarray, unlabelled: np.ndarray, epochs: int = 12) -> float:
    """The mean of two estimates, each on the half of the rows that its network hasn't seen; 0.01 to 0.99."""
    if min(len(good), len(unlabelled)) < 2:
        return 0.5
    found = []
    for own in (0, 1):
        model = fit(good[own::2], unlabelled[own::2], 0.5, epochs=epochs, gradient=apart_gradient)
        found.append(least_ratio(model.logit(good[1 - own :: 2]), model.logit(unlabelled[1 - own :: 2])))
    return min(0.99, max(0.01, sum(found) / 2))


def train(df: DataFrame, labels: DataFrame, learn: Column, text: str = "text", key: str = "doc_id", label: str = "quality", most_good: int = 6000, most_unlabelled: int = 12_000, prior: float | None = None) -> Model | None:
    """A model from rows of ``df`` where ``learn`` (over ``key``) holds; None without a trusted positive.

    The bound of what is learned from: ``most_good`` rows that all their labels call
    1, and ``most_unlabelled`` rows of all, whatever their label, those with the
    smallest hashes (ties by key). The class prior, unless given, is estimated from those two
    samples; labels of 0 only keep a row from being trusted. Rows that repeat a key count one by one. Keys
    are of any type that can be ordered; null keys are not learned from.
    """
    spark = df.sparkSession
    small_batches(spark)
    known = labels.where(learn & F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.min(label).alias("_label")).where("_label = 1")
    ones = known.count()
    if not ones:
        return None
    spread = F.pmod(F.xxhash64(key, F.lit(5)), F.lit(1 << 24))
    ids = df.select(key).where(learn & F.col(key).isNotNull())
    total = ids.count()
    rate = lambda most, of: int(min(1.0, 1.5 * most / max(1, of)) * (1 << 24)) + 1
    smallest = lambda x, most: [r[0] for r in x.withColumn("_at", spread).orderBy("_at", key).limit(most).select(key).collect()]  # noqa: E731  at most `most` ids
    good = smallest(known.where(spread < rate(most_good, ones)).select(key), most_good)
    other = smallest(ids.where(spread < rate(most_unlabelled, total)).distinct(), most_unlabelled)
    if not other:
        return None
    kind = df.schema[key].dataType.simpleString()
    chosen = spark.createDataFrame([(i, k) for k, own in enumerate((good, other)) for i in own], f"`{key}` {kind}, _kind int")
    texts = df.select(key, text).join(F.broadcast(chosen), key).select("_kind", key, text)  # as many ids as the two bounds at most
    drawn = texts.mapInArrow(_described, f"_kind int, _key {kind}, x binary").orderBy("_kind", "_key", "x").collect()
    x = [np.frombuffer(b"".join(r["x"] for r in drawn if r["_kind"] == k), np.float32).reshape(-1, WIDTH) for k in (0, 1)]
    if not len(x[0]) or not len(x[1]):
        return None
    return fit(x[0], x[1], estimate_prior(x[0], x[1]) if prior is None else prior)


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    enter("quality")
    for batch in batches:
        for part, texts in text_blocks(batch.column(2), BLOCK_BYTES):
            x = features(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.start, len(x)), batch.column(1).slice(part.start, len(x)), pa.array([row.tobytes() for row in x], pa.binary())], ["_kind", "_key", "x"])


def score(df: DataFrame, model: Model | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``score`` (0 to 1, higher is better) of every row's whole text.

    Null texts score as empty ones; without a model every score is 0.5. Repeated rows score
    alike, each in a row of its own. A kept column named ``score`` is an error.
    """
    clashing(df.select(*keep), "score")
    small_batches(df.sparkSession)
    kept = df.select(*keep, text)
    at = kept.columns.index(text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name in keep) + ", score double"
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("quality")
        model: Model | None = shared.value
        for batch in batches:
            out = np.full(batch.num_rows, 0.5)
            for part, texts in text_blocks(batch.column(at), BLOCK_BYTES) if model else ():
                out[part] = model.score(texts)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(out)], [*keep, "score"])
        trim()

    return kept.mapInArrow(run, schema)


def accepted(df: DataFrame, model: Model | None, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """The rows of ``df``, with all their columns, whose text scores ``threshold`` or more; without a model all."""
    if model is None:
        return df
    small_batches(df.sparkSession)
    at = df.columns.index(text)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("quality")
        model: Model = shared.value
        for batch in batches:
            # Part by part, so that a worker holds few texts beside the batch.
            for part, texts in text_blocks(batch.column(at), BLOCK_BYTES):
                own = batch.slice(part.start, part.stop - part.start)
                yield own.filter(pa.array(model.score(texts) >= threshold))
        trim()

    return df.mapInArrow(run, df.schema)
