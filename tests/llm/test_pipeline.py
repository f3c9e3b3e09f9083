"""The pipeline's stages on documents with planted copies and junk."""

from __future__ import annotations

import random

import pytest

from plancarta.llm.common import store

RNG = random.Random(3)
WORDS = ["".join(RNG.choice("abcdefghijklmno") for _ in range(RNG.randint(2, 7))) for _ in range(400)]
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def prose(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def stages(spark):
    import corpus_pipeline

    texts = {i: "\n".join(prose(30) for _ in range(4)) for i in range(60)}
    texts |= {100: texts[3], 101: texts[4] + "\n" + prose(20), 102: "short", 103: None, 104: " ".join(["same words again and again"] * 20)}
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(store(stage(spark, out[-1], ""), "test"))
    return out


def test_stages(stages):
    docs, kept, lines, near, mixed, packed = stages
    assert all(x.columns == COLUMNS for x in (kept, lines, near, mixed))
    ids = {r.doc_id for r in kept.collect()}
    assert not ids & {102, 103, 104} and len(ids & {*range(60)}) >= 54
    by = {r.doc_id: r for r in lines.collect()}
    assert by.keys() == ids and by[100].text == "" and by[101].text.count("\n") == 0 and by[101].text
    assert all(r.n_chars == len(r.text) for r in by.values())
    left = [r.doc_id for r in near.collect()]
    assert sorted(left) == sorted({*left}) and {*left} <= ids and len(left) >= len(ids) - 2
    assert {r.doc_id for r in mixed.collect()} <= {*left}
    pieces = packed.collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in mixed.collect()}
    assert len(pieces) >= mixed.count()


def test_near_copies(spark):
    import corpus_pipeline

    def shingles(w):
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    texts = {}
    for i in range(30):
        base = prose(200).split()
        texts[i] = base
        for k, changed in ((100, 1), (200, 3), (300, 4), (400, 6), (500, 12)):
            copy = [*base]
            for at in RNG.sample(range(200), changed):
                copy[at] = "other"
            texts[k + i] = copy
    root = {i: i for i in texts}
    ids, sets = sorted(texts), {i: shingles(w) for i, w in texts.items()}
    top = lambda i: i if root[i] == i else top(root[i])
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    rows = [(i, " ".join(w), "en", "s", len(" ".join(w))) for i, w in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = {i for i in ids if top(i) == i}
    assert len(want) < len(ids) - 60
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == want


def test_empty(spark, stages):
    import corpus_pipeline

    docs = stages[0].where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = store(stage(spark, docs, ""), "empty")
        assert docs.count() == 0


def test_names():
    import __spark_entry__ as entry

    names = [*entry.queries()]
    for n in range(1, 11):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1
    assert "pipeline" in names


def test_each_stage_on_odd_rows(spark):
    import corpus_pipeline

    long = "\n".join(prose(25) for _ in range(60))
    rows = [(i, "\n".join(prose(20) for _ in range(3)), "en", f"s{i % 2}") for i in range(20)]
    rows += [(None, prose(40), None, None), (None, "", "en", "s0"), (30, None, "en", "s1"), (31, "", None, None), (32, long, "fr", "s1"), (33, rows[2][1], "en", "s0"), (33, rows[2][1], "en", "s0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    names = ["n_words", "gone", "row", "id", "key", "fp", "band", "c", "m", "i", "copies", "shard", "group", "kept", "lines", "_gone", "n_lines"]
    for name in names:
        docs = docs.withColumn(name, docs["source"])
    docs = store(docs.repartition(3), "odd")
    counts = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        got = out.collect()
        counts[name] = len(got)
        if name != "packing":
            assert out.columns == docs.columns
            assert all(r[n] == r.source for r in got for n in names)
            by = {(r.doc_id, r.source) for r in got}
            assert by <= {(r[0], r[3]) for r in rows}
        assert stage(spark, docs.where("false"), "").count() == 0
    assert counts["line dedup"] == len(rows) and counts["packing"] >= len(rows)
    assert counts["SimHash near-dedup"] == len(rows) - 3  # the copies and the second of the empty texts that have an id
