"""Language identification: known words first, then ever shorter character n-grams.

Training reads labelled rows: all where a language has at most `sample_docs` of them, else about that many, chosen by a
hash of the id; this sample is the model's only bound. Spark counts its words per language, and these words with all their
n-grams make the model. A word of the model adds the logarithm of
its smoothed relative frequency in each language. Any other word adds, for the longest n (5 down to 1) of which the model
knows an n-gram of the word, the mean over these n-grams. The language with the highest sum, its share of labelled rows
included, wins; equal sums go to the first code.

Defined cases: null text or text without a letter gives `und` and score 0; so does a model without training rows; a word
of no known n-gram adds nothing; repeated rows each get a row; rows with a null id are predicted, not learned from, and
not held out; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MEMO_ENTRIES, id_column, raw, rows_of, ship

SAMPLE_DOCS, LONGEST = 1000, 5

_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def words_of(token: str) -> list[str]:
    return _WORD.findall(token.lower())


def ngrams(word: str, n: int) -> list[str]:
    """n-grams of a word between boundary signs; single characters without them."""
    x = f"<{word}>" if n > 1 else word
    return [x[i : i + n] for i in range(len(x) - n + 1)]


_COUNT = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])


def _count(batches):
    for b in batches:
        by: dict[str, Counter] = defaultdict(Counter)
        for lang, text in zip(b.column(0).to_pylist(), raw(b.column(1)), strict=True):
            by[lang].update(text.split())
        out: Counter = Counter()
        for lang, tokens in by.items():
            for t, n in tokens.items():
                for w in words_of(t.decode()):
                    out[lang, w] += n
        yield rows_of(_COUNT, lang=[k for k, _ in out], word=[w for _, w in out], n=list(out.values()))


class Model:
    """Per-language log frequencies of words and n-grams: `logs` has a row over langs for each, `at` says which."""

    def __init__(self, langs: list[str], prior: list[float], counts: list[tuple[str, str, int]], longest: int = LONGEST):
        self.langs, self.prior, self.longest = langs, np.array(prior), longest
        column = {x: i for i, x in enumerate(langs)}
        self.at: list[dict[str, int]] = []
        logs = [np.zeros((0, len(langs)))]
        rows = 0
        for n in range(longest + 1):  # 0: whole words
            seen: dict[str, list[float]] = {}
            for lang, word, c in counts:
                for g in ngrams(word, n) if n else [word]:
                    if g not in seen:
                        seen[g] = [0.0] * len(langs)
                    seen[g][column[lang]] += c
            self.at.append({g: rows + i for i, g in enumerate(seen)})
            if seen:
                table = np.array([*seen.values()])
                logs.append(np.log((table + 0.1) / (table.sum(axis=0) + 0.1 * (len(seen) + 1))))
            rows += len(seen)
        self.logs = np.concatenate(logs)

    def rows(self, w: str) -> list[int]:
        """The rows whose mean is the score of a word; none for a word of no known n-gram."""
        if (i := self.at[0].get(w)) is not None:
            return [i]
        for n in range(self.longest, 0, -1):
            t = self.at[n]
            if found := [i for g in ngrams(w, n) if (i := t.get(g)) is not None]:
                return found
        return []


class Scorer:
    """Sums a text's word scores; remembers those of white-space tokens."""

    def __init__(self, model: Model):
        self.model = model
        self._reset()

    def _reset(self):
        self.at: dict[bytes, int] = {}
        self.letters: list[bool] = []
        self.table = np.zeros((0, len(self.model.langs)))

    def learn(self, tokens: set[bytes]) -> None:
        rows: list[int] = []
        weights: list[float] = []
        owners: list[int] = []
        for t in tokens:
            i = self.at[t] = len(self.letters)
            words = words_of(t.decode())
            self.letters.append(bool(words))
            for w in words:
                if found := self.model.rows(w):
                    rows += found
                    weights += [1 / len(found)] * len(found)
                    owners += [i] * len(found)
        old = len(self.table)
        new = np.zeros((len(self.letters) - old, len(self.model.langs)))
        part, own = self.model.logs[rows] * np.array(weights)[:, None] if rows else np.zeros((0, len(self.model.langs))), np.array(owners, np.int64) - old
        for k in range(len(self.model.langs)):
            new[:, k] = np.bincount(own, part[:, k], len(new))
        self.table = np.concatenate([self.table, new])

    def texts(self, texts: list[bytes]) -> list[tuple[str, float]]:
        if len(self.letters) > MEMO_ENTRIES:
            self._reset()
        tokens = [t.split() for t in texts]
        if new := set().union(*tokens) - self.at.keys():
            self.learn(new)
        return [self.one(np.fromiter(map(self.at.__getitem__, x), np.int64, len(x))) for x in tokens]

    def one(self, at: np.ndarray) -> tuple[str, float]:
        if not self.model.langs or not any(self.letters[i] for i in at):
            return "und", 0.0
        s = self.table[at].sum(axis=0) + self.model.prior
        best = int(np.argmax(s))
        return self.model.langs[best], float(1 / np.exp(s - s[best]).sum())


_SAID = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def _predict(model):
    def run(batches):
        score = Scorer(model.value)
        for b in batches:
            texts = raw(b.column(2))
            said = [x for i in range(0, len(texts), 500) for x in score.texts(texts[i : i + 500])]
            yield rows_of(_SAID, doc_id=b.column(0), held_out=b.column(1), lang_pred=[x for x, _ in said], score=[p for _, p in said])

    return run


def train(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """A model of rows (doc_id, text, lang)."""
    ship(labelled.sparkSession)
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row per language
    if not sizes:
        return Model([], [], [])
    share = F.coalesce(*[F.when(F.col("lang") == x, min(1.0, sample_docs / n)) for x, n in sizes.items()])
    at = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    counts = labelled.where(at < share).select("lang", "text").mapInArrow(_count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    langs, total = sorted(sizes), sum(sizes.values())
    found = counts.toArrow().sort_by([("lang", "ascending"), ("word", "ascending")])  # bounded by the sample
    rows = [*zip(*(found[c].to_pylist() for c in ("lang", "word", "n")), strict=True)]
    return Model(langs, [math.log(sizes[x] / total) for x in langs], rows)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row of docs (doc_id, text, and held_out if there is one)."""
    spark = docs.sparkSession
    ship(spark)
    held = F.col("held_out") if "held_out" in docs.columns else F.lit(False)
    rows = docs.select(id_column(docs, "doc_id").alias("doc_id"), held.alias("held_out"), "text")
    return rows.mapInArrow(_predict(spark.sparkContext.broadcast(model)), "doc_id long, held_out boolean, lang_pred string, score double")


def language_id(docs: DataFrame) -> DataFrame:
    """Learn from labelled rows that aren't held out (crc32 of the id modulo 3 is not 1) and predict every row."""
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    docs = docs.select("doc_id", "text", "lang", out.alias("held_out"))
    return identify(docs.select("doc_id", "text", "held_out"), train(docs.where("lang is not null and doc_id is not null and not held_out")))
