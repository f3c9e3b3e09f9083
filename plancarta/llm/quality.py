"""Quality rules: counts per text, and perplexity under a character n-gram model with bands per language.

The model is an interpolated modified Kneser-Ney model of the characters of words (white-space tokens between two
boundary signs), of orders 1 to `order`, one per language. Spark counts it over all documents: map tasks count words,
then the n-grams of distinct words, and the sums meet in an aggregate. Discounts, continuation counts, probabilities and
the weights of contexts are DataFrame aggregates and joins too, so nothing of the model but its finished entries can reach
the driver. Entries are hashes of (language, n-gram) with log probability and back-off weight. Where there are at most
`held` of them (16 bytes each), they go to the executors as sorted arrays; since a word's probability does not depend on
its neighbours, each distinct word is scored once per task, by binary search. Where there are more, distinct words are
scored by a join with the entries instead: the model, the order and the scores are the same at every size.

A text's score is its log probability divided by its letters and words, so that other signs cost but don't count: the
perplexity is per letter and word end. (Divided by all signs, texts full of signs score like prose: see the README.) A
language's band is its median plus and minus `width` times the median distance from it, over all texts with a word,
and at least `least` each side; texts outside are rejected.

Defined cases: null or empty text has no words, fails the base rules, and has no score; null lang counts as a language
of its own; repeated rows each get a row and each count; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import sys
import unicodedata
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, grams, id_column, places_hashes, raw, rows_of, ship, store, texts_of, tidied, word_places

ORDER, WIDTH, LEAST = 5, 8.0, 0.2
HELD = 8_000_000
MIN_WORDS, REPEATS, REPEAT_WORDS = 10, 20, 5
START, END = "\x02", "\x03"
#: Distinct words of a language that a map task gathers before it sends on what it has, and words whose scores it remembers.
GATHERED, REMEMBERED = 100_000, 200_000
#: Log probability of a character where there is no model at all.
UNKNOWN = -10.0
#: Discounts where counts of counts are too few to estimate them.
USUAL = 0.5, 1.0, 1.5

_GRAM = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("n", pa.int64())])


def _codes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of START word END, one word after the other, and each word's number of them."""
    text = "".join(f"{START}{w.decode()}{END}" for w in words)
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    # words hold neither sign: both are stripped when texts are read
    return codes, np.diff(np.flatnonzero(np.r_[codes == ord(START), True]))


@cache
def _letters() -> np.ndarray:
    """Whether a code point is a letter or a mark."""
    return np.array([unicodedata.category(chr(i))[0] in "LM" for i in range(sys.maxunicode + 1)])


def _lengths(words: list[bytes]) -> np.ndarray:
    """Letters of each word, and one for its end."""
    codes, lengths = _codes(words)
    return np.add.reduceat(_letters()[codes].astype(np.int64), np.cumsum(lengths) - lengths) + 1


def _strings(codes: np.ndarray) -> pa.Array:
    """Rows of code points as strings, without an object for each."""
    size = (1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)).sum(axis=1)
    data = np.ascontiguousarray(codes).tobytes().decode("utf-32-le").encode()
    return pa.Array.from_buffers(pa.string(), len(codes), [None, pa.py_buffer(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.py_buffer(data)])


def _word_grams(words: list[bytes], counts: np.ndarray, order: int):
    """Strings and counts of the order-grams of words, and of shorter ones that begin with START, which nothing can precede:
    a pair for each length."""
    codes, lengths = _codes(words)
    ends = np.repeat(np.cumsum(lengths), lengths)
    weight, at = np.repeat(counts, lengths), np.arange(len(codes))
    first = codes == ord(START)
    for n in range(min(2, order), order + 1):
        ok = at + n <= ends
        if n < order:
            ok &= first
        if n == 1:
            ok &= ~first  # START is given, never guessed
        i = np.flatnonzero(ok)
        key = np.zeros(len(i), np.uint64)
        for k in range(n):
            key = key * np.uint64(0x9E3779B97F4A7C15) + codes[i + k] + np.uint64(1)
            key ^= key >> np.uint64(29)
        _, one, back = np.unique(key, return_index=True, return_inverse=True)
        yield _strings(codes[i[one][:, None] + np.arange(n)]), np.bincount(back, weight[i], len(one)).astype(np.int64)


def _tokens(text: bytes) -> list[bytes]:
    return text.translate(None, b"\x02\x03").split()


def _without_signs(column: pa.Array) -> pa.Array:
    """Texts as the model reads them: neither START nor END is in them."""
    return pa.array([x.translate(None, b"\x02\x03") for x in raw(column)], pa.large_binary())


class Words:
    """The distinct words of some texts of each language, as hashes and their places, with every word's own."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, langs: list[str]):
        self.data, (self.begin, self.end) = data, word_places(data, ends)
        first = np.searchsorted(self.begin, ends)
        self.of = np.repeat(np.arange(len(langs)), np.diff(first))
        self.hashes = places_hashes(data, self.begin, self.end)
        names, self.lang = np.unique(np.array(langs, object), return_inverse=True) if langs else (np.zeros(0, object), np.zeros(0, int))
        self.names = names.tolist()

    def by_lang(self):
        """Language, places of its words, distinct hashes, a place of each, and each word's own among them."""
        lang = self.lang[self.of]
        for k, name in enumerate(self.names):
            at = np.flatnonzero(lang == k) if len(self.names) > 1 else np.arange(len(lang))
            if len(at):
                distinct, one, own = np.unique(self.hashes[at], return_index=True, return_inverse=True)
                yield name, at, distinct, at[one], own

    def bytes_at(self, places: np.ndarray) -> list[bytes]:
        data = self.data.tobytes()
        return [data[a:b] for a, b in zip(self.begin[places].tolist(), self.end[places].tolist(), strict=True)]


def _count(order: int):
    def sent(words: Counter, lang):
        for grams, n in _word_grams([*words], np.fromiter(words.values(), np.int64, len(words)), order):
            yield rows_of(_GRAM, lang=pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(n), np.int32)), pa.array([lang])).cast(pa.string()), gram=grams, n=n)

    def run(batches):
        by: dict[str, Counter] = defaultdict(Counter)
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), raw(b.column(1)), strict=True):
                by[lang].update(_tokens(text))
                if len(by[lang]) >= GATHERED:
                    yield from sent(by.pop(lang), lang)
        for lang, words in by.items():
            yield from sent(words, lang)

    return run


def _orders(top: DataFrame, order: int) -> dict[int, DataFrame]:
    """(lang, gram, n) by order: what was counted, or for what can be preceded the number of different predecessors."""
    out = {order: top.where(F.length("gram") == order)}
    for n in range(order - 1, 0, -1):
        follow = out[n + 1].groupBy("lang", F.substring("gram", 2, n).alias("gram")).agg(F.count("*").cast("long").alias("n"))
        begin = top.where((F.length("gram") == n) & F.col("gram").startswith(START)) if n > 1 else top.limit(0)
        out[n] = follow.unionByName(begin.select("lang", "gram", "n"))
    return out


class KneserNey:
    """Sorted hashes of language and n-gram, with log probability and the log weight of the n-gram as a context. The n-gram
    of order 0 has the log probability of an unknown character."""

    def __init__(self, keys: np.ndarray, logs: np.ndarray, weights: np.ndarray, order: int):
        sort = np.argsort(keys, kind="stable")
        self.keys, self.logs, self.weights, self.order = keys[sort], logs[sort], weights[sort], order
        self.scorer: Scorer | None = None

    @staticmethod
    def hashes(lang: str, codes: np.ndarray) -> np.ndarray:
        """Of each row of code points, under a language."""
        key = np.full(len(codes), xxhash.xxh3_64_intdigest(f"{codes.shape[1]} {lang}"), np.uint64)
        for k in range(codes.shape[1]):
            key = (key ^ codes[:, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(32)
        return key

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of hashes, and whether they are there."""
        if not len(self.keys):
            return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return at, self.keys[at] == key

    def words(self, lang: str, words: list[bytes]) -> np.ndarray:
        """Log probability of each word: the characters after START, END included."""
        codes, lengths = _codes(words)
        if not len(codes):
            return np.zeros(0)
        at, known = self.find(self.hashes(lang, np.zeros((1, 0), np.uint32)))
        unknown = float(self.logs[at[0]]) if known[0] else UNKNOWN
        begins = np.repeat(np.cumsum(lengths) - lengths, lengths)
        here = np.arange(len(codes)) - begins  # characters before, START included
        log, weight = np.zeros(len(codes)), np.zeros(len(codes))
        todo = np.flatnonzero(here > 0)
        for n in range(self.order, 0, -1):
            use = todo[here[todo] >= n - 1]
            rest = todo[here[todo] < n - 1]
            window = np.lib.stride_tricks.sliding_window_view(codes, n)[use - n + 1] if len(use) else np.zeros((0, n), np.uint32)
            at, hit = self.find(self.hashes(lang, window))
            log[use[hit]] = self.logs[at[hit]] + weight[use[hit]]
            left = use[~hit]
            if n > 1:
                at, known = self.find(self.hashes(lang, window[~hit][:, :-1]))
                weight[left[known]] += self.weights[at[known]]
            else:
                log[left] = unknown + weight[left]
            todo = np.concatenate([rest, left])
        return np.add.reduceat(log, np.cumsum(lengths) - lengths)


def _discounts(every: DataFrame) -> DataFrame:
    """lang, k, d1, d2, d3: modified Kneser-Ney discounts from counts of counts; where those are too few, the usual ones."""
    n = every.groupBy("lang", "k").agg(*[F.count_if(F.col("n") == i).alias(f"c{i}") for i in range(1, 5)])
    y = F.col("c1") / (F.col("c1") + 2 * F.col("c2"))
    enough = (F.col("c1") > 0) & (F.col("c2") > 0) & (F.col("c3") > 0)
    said = [i - (i + 1) * y * F.try_divide(F.col(f"c{i + 1}"), F.col(f"c{i}")) for i in range(1, 4)]
    return n.select("lang", "k", *[F.when(enough, F.least(F.greatest(d, F.lit(0.1)), F.lit(i + 0.9))).otherwise(USUAL[i]).alias(f"d{i + 1}") for i, d in enumerate(said)])


def train(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Entries (lang, k, gram, log, weight) of the model of all rows of docs (text, lang)."""
    ship(docs.sparkSession)
    lang = F.coalesce("lang", F.lit("")).alias("lang")
    top = store(docs.select(lang, "text").mapInArrow(tidied(_count(order)), "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    every = store(_all(_orders(top, order)), "orders")
    context = F.expr("substring(gram, 1, k - 1)").alias("context")
    sums = every.groupBy("lang", "k", context).agg(F.sum("n").alias("total"), *[F.count_if(F.col("n") == i).alias(f"n{i}") for i in (1, 2)], F.count_if(F.col("n") > 2).alias("n3"))
    discounts = F.broadcast(_discounts(every))  # a row for each language and order
    gamma = F.col("d1") * F.col("n1") + F.col("d2") * F.col("n2") + F.col("d3") * F.col("n3")
    sums = store(sums.join(discounts, ["lang", "k"]).withColumn("gamma", gamma / F.col("total")).drop("n1", "n2", "n3"), "sums")
    first = sums.where("k = 1").join(every.where("k = 1").groupBy("lang").agg(F.count("*").alias("v")), "lang")
    unknown = store(first.select("lang", (F.col("gamma") / (F.col("v") + 1)).alias("u")), "unknown")
    less = F.col("n") - F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    out, lower = unknown.select("lang", F.lit(0).alias("k"), F.lit("").alias("gram"), F.col("u").alias("p")), None
    # START is never guessed, but its weight as a context needs a place
    out = out.unionByName(unknown.select("lang", F.lit(1).alias("k"), F.lit(START).alias("gram"), F.lit(0.0).alias("p")))
    for k in range(1, order + 1):
        rows = every.where(F.col("k") == k).withColumn("context", context).join(sums.where(F.col("k") == k).drop("k"), ["lang", "context"])
        if lower is None:
            rows = rows.join(F.broadcast(unknown), "lang").withColumn("below", F.col("u"))
        else:
            suffix = lower.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("q"))
            rows = rows.withColumn("suffix", F.substring("gram", 2, k - 1)).join(suffix, ["lang", "suffix"], "left").join(F.broadcast(unknown), "lang")
            rows = rows.withColumn("below", F.col("gamma") * F.coalesce("q", "u"))
        lower = store(rows.select("lang", "k", "gram", (F.greatest(less, F.lit(0.0)) / F.col("total") + F.col("below")).alias("p")), "order")
        out = out.unionByName(lower)
    weights = sums.where("k > 1").select("lang", (F.col("k") - 1).alias("k"), F.col("context").alias("gram"), "gamma")
    least = F.lit(1e-300)
    entries = out.join(weights, ["lang", "k", "gram"], "left")
    return store(entries.select("lang", "k", "gram", F.log(F.greatest("p", least)).cast("float").alias("log"), F.coalesce(F.log(F.greatest("gamma", least)), F.lit(0.0)).cast("float").alias("weight")), "entries")


def _all(orders: dict[int, DataFrame]) -> DataFrame:
    out = None
    for k, df in orders.items():
        df = df.select("lang", F.lit(k).alias("k"), "gram", "n")
        out = df if out is None else out.unionByName(df)
    return out


def _codes_of(grams: pa.Array, k: int) -> np.ndarray:
    """Code points of n-grams of one order, a row each, without an object for each."""
    grams = grams.cast(pa.large_string())
    if not len(grams) or not k:
        return np.zeros((len(grams), k), np.uint32)
    _, offsets, data = grams.buffers()
    ends = np.frombuffer(offsets, np.int64)[grams.offset : grams.offset + len(grams) + 1]
    text = memoryview(data)[int(ends[0]) : int(ends[-1])].tobytes().decode()
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).reshape(-1, k)


_ENTRY = pa.schema([("key", pa.int64()), ("log", pa.float32()), ("weight", pa.float32())])
_ENTRY_SQL = "key long, log float, weight float"


def _hashed(batches):
    """Entries by the hash of their language and n-gram."""
    for b in batches:
        t = pa.Table.from_batches([b])
        for k in pc.unique(t["k"]).to_pylist():
            of = t.filter(pc.equal(t["k"], k))
            for lang in pc.unique(of["lang"]).to_pylist():
                part = of.filter(pc.equal(of["lang"], lang)).combine_chunks()
                key = KneserNey.hashes(lang, _codes_of(part["gram"].combine_chunks(), k)).view(np.int64)
                yield rows_of(_ENTRY, key=key, log=part["log"].combine_chunks(), weight=part["weight"].combine_chunks())


def held_model(hashed: DataFrame, order: int) -> KneserNey:
    """The model as sorted arrays, of rows _ENTRY whose number has been checked."""
    t = hashed.toArrow()
    return KneserNey(t["key"].to_numpy().view(np.uint64), t["log"].to_numpy(), t["weight"].to_numpy(), order)


_SCORE = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), *[(x, pa.int64()) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_scored")], ("log_prob", pa.float64())])


_SCORE_SQL = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_scored long, log_prob double"


def repeat_words(h: np.ndarray, size: int = REPEAT_WORDS) -> int:
    """Words inside windows of size words that are found twice or more, the first included."""
    if len(h) <= size:
        return 0
    g = grams(h, size)
    sort = np.argsort(g, kind="stable")
    same = g[sort][1:] == g[sort][:-1]
    if not same.any():
        return 0
    hit = np.zeros(len(g), bool)
    hit[sort[1:][same]] = hit[sort[:-1][same]] = True
    step = np.zeros(len(h) + 1, np.int64)
    step[: len(hit)] += hit
    step[size : size + len(hit)] -= hit
    return int((np.cumsum(step[:-1]) > 0).sum())


class Scorer:
    """Log probabilities and lengths of words; remembers those of each language by hash. Without a model it has lengths."""

    def __init__(self, model: KneserNey | None):
        self.model = model
        if model:
            model.scorer = self
        self.known: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def __call__(self, lang: str, hashes: np.ndarray, words) -> tuple[np.ndarray, np.ndarray]:
        """For sorted hashes; words(places) gives the words at some of them."""
        none = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.int64)
        known, logs, lengths = self.known.get(lang, none)
        at = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
        new = known[at] != hashes if len(known) else np.ones(len(hashes), bool)
        if new.any():
            fresh = words(np.flatnonzero(new))
            own = self.model.words(lang, fresh) if self.model else np.zeros(len(fresh))
            if len(known) + len(fresh) > REMEMBERED:
                # what this text run needs stays, the rest is learned again
                known, logs, lengths = known[at[~new]], logs[at[~new]], lengths[at[~new]]
            known = np.concatenate([known, hashes[new]])
            order = np.argsort(known, kind="stable")
            known, logs, lengths = known[order], np.concatenate([logs, own])[order], np.concatenate([lengths, _lengths(fresh)])[order]
            self.known[lang] = known, logs, lengths
            at = np.searchsorted(known, hashes)
        return logs[at], lengths[at]


def _sums(score: Scorer, data: np.ndarray, ends: np.ndarray, langs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of texts without START and END: letters and words, and the log probability."""
    words = Words(data, ends, langs)
    n, log = np.zeros(len(langs), np.int64), np.zeros(len(langs))
    for lang, at, distinct, one, own in words.by_lang():
        logs, lengths = score(lang, distinct, lambda k, one=one: words.bytes_at(one[k]))
        n += np.bincount(words.of[at], lengths[own], len(langs)).astype(np.int64)
        log += np.bincount(words.of[at], logs[own], len(langs))
    return n, log


#: Whether a byte is a sign that is counted, and whether it begins a character of a word.
_SIGN = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_STARTS = ~SPACE & ((np.arange(256) & 0xC0) != 0x80)


def _dup_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len({*lines})


def _score(model, carried: int):
    """Scores of rows (doc_id, lang, text, and others), with the columns from `carried` on."""

    def run(batches):
        # a worker serves many tasks, so what it remembers stays with the model
        score = (model.value.scorer or Scorer(model.value)) if model else Scorer(None)
        for b in batches:
            langs, ids = b.column(1).to_pylist(), b.column(0)
            for row, data, ends in texts_of(b.column(2)):
                size = len(ends) - 1
                part = b.slice(row, size)
                begin, end = word_places(data, ends)
                h = places_hashes(data, begin, end)
                first = np.searchsorted(begin, ends)
                per = lambda on: np.diff(np.r_[0, np.cumsum(on[: ends[-1]])][ends])
                clean = texts_of(_without_signs(part.column(2)), 1 << 62) if np.isin(data, (2, 3)).any() else [(0, data, ends)]
                n, log = next(_sums(score, d, e, langs[row : row + size]) for _, d, e in clean)
                whole = data.tobytes()
                scores = rows_of(
                    _SCORE, doc_id=ids.slice(row, size), lang=langs[row : row + size], n_words=np.diff(first), word_chars=per(_STARTS[data]), n_symbols=per(_SIGN[data]),
                    n_dup_lines=[_dup_lines(whole[x:y]) for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)],
                    n_repeat_words=[repeat_words(h[x:y]) for x, y in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)], n_scored=n, log_prob=log,
                )
                yield pa.RecordBatch.from_arrays([*scores.columns, *part.columns[carried:]], [*scores.schema.names, *part.schema.names[carried:]])

    return run


_WORD = pa.schema([("id", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("c", pa.int64())])
_ASK = pa.schema([("lang", pa.string()), ("word", pa.string()), ("at", pa.int32()), ("n", pa.int32()), ("key", pa.int64()), ("before", pa.int64())])


def _words(batches):
    """Distinct words of rows (id, lang, text), with their number."""
    for b in batches:
        out: dict[str, list] = {f.name: [] for f in _WORD}
        for i, lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), raw(b.column(2)), strict=True):
            for w, c in Counter(_tokens(text)).items():
                for name, v in zip(out, (i, lang, w.decode(), c), strict=True):
                    out[name].append(v)
        yield rows_of(_WORD, **out)


def _asked(order: int):
    """For each character of words (lang, word) after START, and END, the n-grams that end there and their contexts."""

    def run(batches):
        for b in batches:
            for lang, word in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                codes, _ = _codes([word.encode()])
                out: dict[str, list] = {f.name: [] for f in _ASK}
                for n in range(1, order + 1):
                    if len(codes) >= max(n, 2):
                        window = np.lib.stride_tricks.sliding_window_view(codes, n)[1 if n == 1 else 0 :]
                        values = np.full(len(window), lang), np.full(len(window), word), np.arange(len(codes) - len(window), len(codes)), np.full(len(window), n), KneserNey.hashes(lang, window).view(np.int64), KneserNey.hashes(lang, window[:, :-1]).view(np.int64)
                        for name, v in zip(out, values, strict=True):
                            out[name] += v.tolist()
                yield rows_of(_ASK, **out)

    return run


def joined_scores(rows: DataFrame, hashed: DataFrame, order: int) -> DataFrame:
    """id and log_prob of rows (id, lang, text) by a join of their distinct words with the model's entries."""
    words = store(rows.dropDuplicates(["id"]).mapInArrow(_words, "id long, lang string, word string, c long"), "words")
    asks = words.select("lang", "word").distinct().mapInArrow(_asked(order), "lang string, word string, at int, n int, key long, before long")
    grams, contexts = hashed.select("key", "log"), hashed.select(F.col("key").alias("before"), "weight")
    found = asks.join(grams, "key", "left").join(contexts, "before", "left")
    by = found.groupBy("lang", "word", "at").agg(F.max(F.when(F.col("log").isNotNull(), F.struct("n", F.col("log").cast("double").alias("log")))).alias("hit"), F.collect_list(F.struct("n", F.col("weight").cast("double").alias("w"))).alias("steps"), F.max_by("before", -F.col("n")).alias("unigram"))
    below = hashed.select(F.col("key").alias("unigram"), F.col("log").cast("double").alias("u"))
    paid = F.aggregate(F.filter("steps", lambda s: (s.n > F.coalesce("hit.n", F.lit(0))) & (s.n > 1) & s.w.isNotNull()), F.lit(0.0), lambda a, s: a + s.w)
    each = by.join(below, "unigram", "left").select("lang", "word", (F.coalesce("hit.log", "u", F.lit(UNKNOWN)) + paid).alias("log"))
    scored = each.groupBy("lang", "word").agg(F.sum("log").alias("log"))
    return words.join(scored, ["lang", "word"]).groupBy("id").agg(F.sum(F.col("log") * F.col("c")).alias("log_prob"))


def _middle(rows: DataFrame, x: str) -> DataFrame:
    """Weighted median by language over bins (lang, x, n)."""
    w = Window.partitionBy("lang").orderBy(x)
    all_ = Window.partitionBy("lang")
    run = rows.select("lang", x, F.sum("n").over(w).alias("to"), F.sum("n").over(all_).alias("of"))
    return run.where(F.col("to") * 2 >= F.col("of")).groupBy("lang").agg(F.min(x).alias("middle"))


def bands(scores: DataFrame, width: float = WIDTH, least: float = LEAST) -> DataFrame:
    """lang, low, high of the score, from thousandths counted over all scored rows."""
    bins = store(scores.where("n_scored > 0").groupBy("lang", F.round(F.col("log_prob") / F.col("n_scored") * 1000).cast("long").alias("x")).agg(F.count("*").alias("n")), "bins")
    mid = _middle(bins, "x")
    far = bins.join(mid, "lang").select("lang", F.abs(F.col("x") - F.col("middle")).alias("y"), "n").groupBy("lang", "y").agg(F.sum("n").alias("n"))
    spread = _middle(far, "y").withColumnRenamed("middle", "spread")
    side = F.greatest(F.col("spread") * width, F.lit(least * 1000)) / 1000
    return store(mid.join(spread, "lang").select("lang", (F.col("middle") / 1000 - side).alias("low"), (F.col("middle") / 1000 + side).alias("high")), "bands")


def judge(docs: DataFrame, carried: list[str], order: int, width: float, least: float, held: int = HELD) -> DataFrame:
    """Scores of docs (doc_id, text, lang) with base_failed, kept and perplexity, and the columns to carry: text as it is,
    others by their place among those to carry as c0, c1, ..."""
    spark = docs.sparkSession
    others = [F.col(c).alias(f"c{i}") for i, c in enumerate(carried) if c != "text"]
    rows = docs.select(id_column(docs, "doc_id").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("lang"), "text", *others)
    hashed = store(train(rows, order).mapInArrow(_hashed, _ENTRY_SQL), "model")
    begin = 2 if "text" in carried else 3
    schema = T.StructType([*T.StructType.fromDDL(_SCORE_SQL), *rows.schema[begin:]])
    if hashed.count() <= held:
        scores = rows.mapInArrow(tidied(_score(spark.sparkContext.broadcast(held_model(hashed, order)), begin)), schema)
    else:
        # equal texts of a language have equal scores, so a hash of both tells whose words they are
        known = F.xxhash64("lang", "text").alias("id")
        logs = joined_scores(rows.select(known, "lang", "text").where("text is not null"), hashed, order)
        counted = rows.select("*", known).mapInArrow(_score(None, begin), T.StructType([*schema, T.StructField("id", T.LongType())]))
        scores = counted.drop("log_prob").join(logs, "id", "left").withColumn("log_prob", F.coalesce("log_prob", F.lit(0.0))).select(*schema.names)
    scores = store(scores, "scores")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEATS * F.col("n_words"))
    mean = F.when(F.col("n_scored") > 0, F.round(F.col("log_prob") / F.col("n_scored"), 6))
    inside = F.coalesce(mean.between(F.col("low"), F.col("high")), F.lit(False))
    out = scores.join(bands(scores, width, least), "lang", "left")
    return out.select("*", failed.alias("base_failed"), (~failed & inside).alias("kept"), F.exp(-mean).alias("perplexity"))


def quality_rules(docs: DataFrame, order: int = ORDER, width: float = WIDTH, least: float = LEAST) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, and the perplexity per letter and word, of docs (doc_id, text, lang)."""
    return judge(docs, [], order, width, least).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "perplexity")


def kept_documents(docs: DataFrame, order: int = ORDER, width: float = WIDTH, least: float = LEAST) -> DataFrame:
    """The rows of docs (doc_id, text, lang and others) that the rules keep, whole."""
    judged = judge(docs, docs.columns, order, width, least).where("kept")
    return judged.select(*[F.col("text" if c == "text" else f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
