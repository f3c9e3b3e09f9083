"""Embedding near-dedup: what goes to the lists, and links by brute force."""

from __future__ import annotations

import collections

import numpy as np

from plancarta.llm import embeddings


def planted(n: int, pairs: int) -> np.ndarray:
    """Directions by chance; the last `pairs` lie at cosines from 0.85 to 1 of the first."""
    rng = np.random.default_rng(11)
    x = embeddings.unit(rng.normal(size=(n, 64)))
    a, o = x[:pairs], x[-pairs:]
    o = embeddings.unit(o - (o * a).sum(1, keepdims=True) * a)
    c = np.linspace(0.85, 1, pairs)[:, None]
    x[-pairs:] = c * a + np.sqrt(1 - c * c) * o
    return x.astype(np.float32)


def shuffled(spark) -> int:
    return spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()


def test_few_bytes_a_vector_are_shuffled_and_links_are_those_of_brute_force(spark):
    x = planted(6000, 600)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>").repartition(2).cache()
    df.count()
    before = shuffled(spark)
    got = {r.vec_id: r for r in embeddings.embedding_groups(df).collect()}
    assert shuffled(spark) - before < 8 * x.nbytes
    u = embeddings.unit(x.astype(float))
    a, b = np.nonzero(np.triu(u @ u.T >= 0.9, 1))
    assert 350 < len(a) < 450
    want = {i: (0, i) for i in range(len(x))} | {int(i): (1, int(min(i, j))) for p in zip(a, b, strict=True) for i, j in (p, p[::-1])}
    assert all(got[i].n_links <= want[i][0] and got[i].kept == (got[i].component_id == i) for i in want)
    missed = [i for i in want if (got[i].n_links, got[i].component_id) != want[i]]
    assert len(missed) <= 0.01 * 2 * len(a)


def test_one_of_two_partners_asks_the_list_of_the_other():
    rng = np.random.default_rng(5)
    index = embeddings.Index(embeddings.unit(rng.normal(size=(8000, 64))), 1000)
    assert len(index.coarse) == 1000
    x = embeddings.unit(rng.normal(size=(2000, 64)))
    o = rng.normal(size=x.shape)
    o = embeddings.unit(o - (o * x).sum(1, keepdims=True) * x)
    asked, home = [], []
    for v in (x, 0.9 * x + np.sqrt(0.19) * o):
        h, row, cell = index.ask(v.astype(np.float32))
        of = collections.defaultdict(set)
        for i, c in zip(row.tolist(), cell.tolist(), strict=True):
            of[i].add(c)
        assert all(h[i] in of[i] for i in range(len(x)))
        asked.append(of)
        home.append(h)
    found = sum(home[1][i] in asked[0][i] or home[0][i] in asked[1][i] for i in range(len(x)))
    assert found >= 0.985 * len(x)
    assert sum(map(len, asked[0].values())) < 30 * len(x)


def test_lists_grow_in_number_with_the_table(spark):
    x = embeddings.unit(np.random.default_rng(6).normal(size=(12_000, 6))).astype(np.float32)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, v array<float>")
    assert len(embeddings.fit(df)[6].coarse) == 3 * 109


def test_equal_vectors_whatever_the_sign_of_zero_and_unusable_rows(spark):
    rows = [(5, [0.0, 1.0]), (3, [-0.0, 1.0]), (4, [-0.0, 2.0]), (6, [1.0, 0.0]), (7, [-0.0, 0.0]), (8, [None, 1.0]), (9, [-np.inf, 1.0]), (10, [np.nan, 1.0]), (11, [-1.0, -1.0]), (None, [0.0, 1.0])]
    for kind in ("float", "double"):
        got = embeddings.embedding_groups(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")).collect()
        assert sorted(map(tuple, got), key=str) == sorted([(5, 2, 3, False), (3, 2, 3, True), (4, 2, 3, False), *[(i, 0, i, True) for i in (6, 7, 8, 9, 10, 11, None)]], key=str)


def test_parts_of_split_lists_meet_each_other(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([embeddings.unit(rng.normal(size=(4, 16)))[k % 4][None] + rng.normal(size=(1, 16)) * 0.02 for k in range(240)])
    u = embeddings.unit(x)
    near = u @ u.T >= 0.9
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    for r in embeddings.embedding_groups(df, block=3).collect():
        assert r.n_links == near[r.vec_id].sum() - 1
