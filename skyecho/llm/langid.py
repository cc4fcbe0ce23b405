"""Language by cross-parsing entropy.

For each language a suffix automaton is built over a bounded amount of whole
labelled texts. A document is parsed against it into phrases, each the longest match of
what remains with any place of that text; phrases times log2 of the text's
length, per character, estimate the cross entropy, and the language with the
fewest such normalised phrases wins.

Texts become letter codes first: lower case, every run of other characters one
separator. Codes are parsed in blocks of ``BLOCK`` (a phrase ends with its
block), many blocks and all languages at once: a look-up moves every lane a
character on. Most states of an automaton lead on by one letter only; that one
stands beside the state. The others have a short row for the most frequent
letters, and rarer ones are in one sorted array.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyecho.llm.common import blocks, clashing, enter, small_batches

BLOCK = 1024
#: Codes, the most frequent ones, that have a place in the rows of states that lead on by several letters.
FREQUENT = 32
UNDETERMINED = "und"


@lru_cache(1)
def letters() -> np.ndarray:
    """Whether a code point is a letter (category L)."""
    return np.array([unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)])


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each with a separator in front, and their first places (one more at the end)."""
    joined = "".join(" " + t for t in texts)
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4"), np.cumsum([0, *(len(t) + 1 for t in texts)])


@dataclass
class Codes:
    """Code 0 is the separator, 1 to ``len(alphabet)`` the letters learned, the last one any other letter."""

    alphabet: str

    @property
    def size(self) -> int:
        return len(self.alphabet) + 2

    def table(self) -> np.ndarray:
        out = np.where(letters(), self.size - 1, 0).astype(np.int32)
        out[[ord(c) for c in self.alphabet]] = np.arange(1, len(self.alphabet) + 1)
        return out

    def __call__(self, texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all texts and their first places (one more at the end); each text starts with a separator."""
        points, first = code_points([t.lower() for t in texts])
        codes = table[points]
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
        keep[first[:-1]] = True
        place = np.concatenate(([0], np.cumsum(keep)))
        return codes[keep], place[first]


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions by state; state 0 is the start."""
    to: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in codes:
        new = len(to)
        to.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and c not in to[at]:
            to[at][c] = new
            at = link[at]
        if at >= 0:
            there = to[at][c]
            if length[at] + 1 == length[there]:
                link[new] = there
            else:
                twin = len(to)
                to.append(to[there].copy())
                length.append(length[at] + 1)
                link.append(link[there])
                link[there] = link[new] = twin
                while at >= 0 and to[at].get(c) == there:
                    to[at][c] = twin
                    at = link[at]
        last = new
    return to


class Model:
    """Automata of all languages, state after state in the same arrays."""

    def __init__(self, languages: list[str], codes: Codes, automata: list[list[dict[int, int]]], log_length: list[float]) -> None:
        self.languages, self.codes, self.log_length = languages, codes, np.array(log_length)
        self.start = np.cumsum([0, *map(len, automata)])[:-1]
        states = sum(map(len, automata))
        #: A state's first letter (-1: none) and where it leads, its row if it has more, and from each start by letter (-1: nowhere).
        self.letter, self.lead = np.full(states, -1, np.int32), np.zeros(states, np.int32)
        self.row = np.full(states, -1, np.int32)
        self.begin = np.full((len(automata), codes.size), -1, np.int32)
        several = [base + state for base, to in zip(self.start.tolist(), automata, strict=True) for state, own in enumerate(to) if len(own) > 1]
        self.row[several] = np.arange(len(several))
        self.rows = np.full((len(several) + 1) * FREQUENT, -1, np.int32)
        rare: list[tuple[int, int]] = []
        for k, (base, to) in enumerate(zip(self.start.tolist(), automata, strict=True)):
            for c, there in to[0].items():
                self.begin[k, c] = base + there
            for state, own in enumerate(to, base):
                for c, there in own.items():
                    if self.letter[state] < 0:
                        self.letter[state], self.lead[state] = c, base + there
                    elif c < FREQUENT:
                        self.rows[self.row[state] * FREQUENT + c] = base + there
                    else:
                        rare.append((state * codes.size + c, base + there))
        rare.sort()
        self.keys = np.array([x[0] for x in rare] + [np.iinfo(np.int64).max], np.int64)
        self.values = np.array([x[1] for x in rare] + [0], np.int32)

    def step(self, at: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Where each lane (languages by blocks) gets with its block's letter, -1 for nowhere."""
        row = self.row[at]
        # A state without a row reads the spare last one, which leads nowhere.
        to = self.rows[np.where(row < 0, len(self.rows) // FREQUENT - 1, row) * FREQUENT + np.minimum(codes, FREQUENT - 1)]
        if (seldom := codes >= FREQUENT).any():
            own = at[:, seldom]
            key = own.astype(np.int64) * self.codes.size + codes[seldom]
            place = np.searchsorted(self.keys, key)
            to[:, seldom] = np.where(self.keys[place] == key, self.values[place], -1)
        return np.where(self.letter[at] == codes, self.lead[at], to)

    def phrases(self, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Phrases of each text (rows) in each language (columns)."""
        begin = np.concatenate([np.arange(a, b, BLOCK) for a, b in zip(first[:-1], first[1:], strict=True)] or [np.empty(0, np.int64)])
        owner = np.repeat(np.arange(len(first) - 1), -(-np.diff(first) // BLOCK))
        size = np.minimum(BLOCK, first[owner + 1] - begin)
        order = np.argsort(-size, kind="stable")
        begin, owner, size = begin[order], owner[order], size[order]
        live = len(begin) - np.searchsorted(size[::-1], np.arange(1, BLOCK + 1), side="left")
        start = self.start[:, None].astype(np.int32)
        at = np.repeat(start, len(begin), axis=1)
        count = np.ones((len(self.languages), len(begin)), np.int32)
        for t in range(int(size[0]) if len(size) else 0):
            n = live[t]
            c = codes[begin[:n] + t]
            to = self.step(at[:, :n], c)
            if (miss := to < 0).any():
                count[:, :n] += miss
                again = self.begin[:, c]
                to = np.where(miss, np.where(again < 0, start, again), to)
            at[:, :n] = to
        out = np.zeros((len(first) - 1, len(self.languages)))
        for k in range(len(self.languages)):
            out[:, k] = np.bincount(owner, count[k], len(first) - 1)
        return out

    def predict(self, texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best language's place (-1: no letter) and its score for each text."""
        codes, first = self.codes(texts, table)
        seen = np.concatenate(([0], np.cumsum(codes != 0)))[first]
        bits = self.phrases(codes, first) * self.log_length / np.maximum(np.diff(first), 1)[:, None]
        best = bits.argmin(axis=1)
        weight = np.minimum(np.diff(first), 256) / 16
        odds = np.exp2(-(bits - bits.min(axis=1, keepdims=True)) * weight[:, None])
        score = odds.max(axis=1) / odds.sum(axis=1)
        none = np.diff(seen) == 0
        return np.where(none, -1, best), np.where(none, 0.0, score)


def train(df: DataFrame, learn: Column, text: str = "text", lang: str = "lang", key: str = "doc_id", codes_per_language: int = 65_536) -> Model | None:
    """A model of the rows where ``learn`` holds and the language isn't null; None if there are none.

    The bound of what is learned from: of each language whole texts, in the order of the
    hash of ``key`` (ties by key and text), as long as they have ``codes_per_language``
    characters together; a longer text is passed over, but for the shortest of a language
    that has no other. Every letter of those texts has a code of its own. The model takes about
    characters x 100 bytes a language.
    """
    own = df.where(learn & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(lang, text, F.col(key).alias("_key"), F.length(text).cast("long").alias("_len"))
    sums = own.groupBy(lang).agg(F.sum(F.when(F.col("_len") <= codes_per_language, F.col("_len") + 1)).alias("n"), F.min("_len").alias("least")).collect()  # a row per language
    if not sums:
        return None
    spread = F.pmod(F.xxhash64("_key", F.lit(7)), F.lit(1 << 24))
    # About twice as much as is taken leaves the scan; longer texts than the bound stay only where there is no other.
    rate = F.create_map(*(F.lit(x) for r in sums for x in (r[lang], int(min(1.0, (2 * codes_per_language + 65_536) / max(1, r["n"] or 1)) * (1 << 24)) + 1)))
    most = F.create_map(*(F.lit(x) for r in sums for x in (r[lang], codes_per_language if r["n"] else r["least"])))
    some = own.withColumn("_at", spread).where((F.col("_at") < rate[F.col(lang)]) & (F.col("_len") <= most[F.col(lang)]))
    order = Window.partitionBy(lang).orderBy("_at", "_key", text)
    upto = F.sum(F.col("_len") + 1).over(order.rowsBetween(Window.unboundedPreceding, 0))
    taken = some.withColumns({"_sum": upto, "_n": F.row_number().over(order)}).where((F.col("_sum") <= codes_per_language) | (F.col("_n") == 1))
    texts: dict[str, list[str]] = {}
    for r in taken.select(lang, text, "_n").orderBy(lang, "_n").collect():  # of bounded length
        texts.setdefault(r[lang], []).append(r[text])
    seen = Counter(c for own in texts.values() for t in own for c in t.lower() if unicodedata.category(c)[0] == "L")
    codes = Codes("".join(sorted(seen, key=lambda c: (-seen[c], c))))  # frequent ones first
    table = codes.table()
    languages, automata, lengths = [], [], []
    for language in sorted(texts):
        sample, _ = codes(texts[language], table)
        if sample.any():
            languages.append(language)
            automata.append(suffix_automaton(sample.tolist()))
            lengths.append(math.log2(max(2, len(sample))))
    return Model(languages, codes, automata, lengths) if languages else None


def identify(df: DataFrame, model: Model | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``lang_pred`` and ``score`` of every row's whole text.

    ``und`` and 0 for null texts, texts without a letter, and without a model.
    Equal entropies go to the language that sorts first. Repeated rows get a row each; kept
    columns named as the results are an error.
    """
    clashing(df.select(*keep), "lang_pred", "score")
    small_batches(df.sparkSession)
    kept = df.select(*keep, text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name in keep) + ", lang_pred string, score double"
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("langid")
        model: Model | None = shared.value
        table = model.codes.table() if model else None
        names = [*model.languages, UNDETERMINED] if model else [UNDETERMINED]
        for batch in batches:
            texts = [t or "" for t in batch.column(len(keep)).to_pylist()]
            best, score = np.full(len(texts), -1), np.zeros(len(texts))
            for part in blocks([len(t) for t in texts], 4_000_000) if model else ():
                best[part], score[part] = model.predict(texts[part], table)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array([names[i] for i in best], pa.string()), pa.array(score)], [*keep, "lang_pred", "score"])

    return kept.mapInArrow(run, schema)
