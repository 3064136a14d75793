"""Neighbours against brute force: exact with factor 1, and recall of the default."""

import numpy as np

from treemill.llm import neighbours

SCHEMA = "id long, v array<float>, query string, vec string"


def brute(rows, k, least):
    usable = [(i, np.float32(v) / np.linalg.norm(np.float64(v))) for i, v, *_ in rows if v is not None and len(v) and any(v) and None not in v]
    out = {}
    for i, a in usable:
        close = sorted(((-float(np.float64(np.float32(a)) @ np.float64(np.float32(b))), j) for j, b in usable if j != i and len(a) == len(b)))
        out[i] = [j for c, j in close[:k] if -c >= least]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query", "cosine").collect():
        out.setdefault(r["query"], set()).add(r.other)
    return out


def clustered(seed, n=900, dim=24):
    rng = np.random.default_rng(seed)
    topics = rng.normal(size=(6, dim))
    rows = []
    for i in range(n):
        v = topics[min(int(rng.exponential(1.5)), 5)] * 0.7 + rng.normal(size=dim)
        if i % 3 == 0 and rows:
            v = np.array(rows[rng.integers(len(rows))][1]) + rng.normal(size=dim) * 0.15
        rows.append((i, [float(x) for x in np.float32(v * rng.uniform(0.2, 9))], "q", "v"))
    return rows


def test_factor_one_is_exact_and_the_default_close(spark):
    rows = clustered(1)
    df = spark.createDataFrame(rows, SCHEMA)
    want = {i: set(x) for i, x in brute(rows, 10, 0.9).items() if x}
    assert found(neighbours.nearest(df, "id", "v", factor=1.0)) == want
    got = found(neighbours.nearest(df, "id", "v"))
    hits = sum(len(got.get(i, set()) & x) for i, x in want.items())
    assert hits >= 0.9 * sum(map(len, want.values()))
    pairs = {tuple(r) for r in neighbours.mutual(neighbours.nearest(df, "id", "v", factor=1.0)).collect()}
    assert pairs == {(i, j) for i, x in want.items() for j in x if i < j and i in want.get(j, ())}


def test_large_cells_are_split(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD_ROWS", 60)
    rows = clustered(2, 400)
    df = spark.createDataFrame(rows, SCHEMA)
    want = {i: set(x) for i, x in brute(rows, 10, 0.9).items() if x}
    assert found(neighbours.nearest(df, "id", "v", factor=1.0)) == want


def test_copies_ties_nulls_and_lengths(spark):
    same = [1.0, 2.0, 3.0]
    rows = [(i, same, None, None) for i in range(30)] + [(40, [0.0, 0.0, 0.0], None, None), (41, None, None, None), (42, [1.0, None, 2.0], None, None), (43, [], None, None), (44, [1.0, 2.0], None, None), (45, [2.0, 4.0], None, None), (46, [float("nan")] * 3, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = found(neighbours.nearest(df, "id", "v", k=3, factor=1.0))
    assert got == {i: set([0, 1, 2, 3]) - {i} - ({3} if i not in (0, 1, 2) else set()) for i in range(30)} | {44: {45}, 45: {44}}
    short = neighbours.nearest(df, "id", "v", k=3, factor=1.0, all_copies=False)
    assert {tuple(r) for r in neighbours.mutual(short).collect()} == {tuple(r) for r in neighbours.mutual(neighbours.nearest(df, "id", "v", k=3, factor=1.0)).collect()}
    assert set(found(neighbours.nearest(df, "id", "v", k=3, asking="id % 10 = 0"))) == {0, 10, 20}
    assert neighbours.nearest(df.limit(0), "id", "v").collect() == []


def test_every_asking_row_gets_k_others_without_a_floor(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD_ROWS", 120)
    rows = clustered(3, 700)
    df = spark.createDataFrame(rows, SCHEMA)
    want = {i: set(x) for i, x in brute(rows, 10, -2.0).items() if i % 7 == 0}
    ask = {"least": None, "asking": "id % 7 = 0"}
    assert found(neighbours.nearest(df, "id", "v", factor=1.0, **ask)) == want
    got = found(neighbours.nearest(df, "id", "v", factor=3.0, **ask))
    assert {i: len(x) for i, x in got.items()} == {i: 10 for i in want} and sum(len(got[i] & x) for i, x in want.items()) >= 0.9 * 10 * len(want)


def test_few_rows_and_hot_vectors_without_a_floor(spark):
    rows = [(i, [1.0, 2.0, 3.0], None, None) for i in range(200)] + [(300, [3.0, 2.0, 1.0], None, None), (301, [-1.0, -2.0, -3.0], None, None), (302, [5.0, 1.0], None, None)]
    got = found(neighbours.nearest(spark.createDataFrame(rows, SCHEMA), "id", "v", k=3, least=None, factor=1.0))
    assert set(got) == set(range(200)) | {300, 301} and all(got[i] == set([0, 1, 2, 3]) - {i} - ({3} if i > 2 else set()) for i in range(200))
    assert got[300] == {0, 1, 2} and got[301] == {300, 0, 1}
