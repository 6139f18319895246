import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import forest, queries

SF = "/root/testdata/sf0.001"


def table(spark, vectors, kind="array<double>", ids=None):
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v], 1, "x") for i, v in zip(ids or range(len(vectors)), vectors)]
    return spark.createDataFrame(rows, f"vec_id {'string' if ids else 'long'}, embedding {kind}, key int, q string").repartition(3)


def brute(vectors, asks, n):
    out = {}
    for k in asks:
        score = vectors @ vectors[k]
        order = [i for i in sorted(range(len(vectors)), key=lambda i: (-score[i], i)) if i != k][:n]
        out[k] = [(rank + 1, i, score[i]) for rank, i in enumerate(order)]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return out


def clustered(rng, n, size, spread):
    centres = rng.standard_normal((n // 25, size))
    vectors = centres[rng.integers(0, len(centres), n)] + spread * rng.standard_normal((n, size))
    return vectors * rng.uniform(0.3, 2, (n, 1))


@pytest.mark.parametrize("cell,most,asked,spread", [(4096, 1 << 14, 1024, 0.3), (60, 40, 7, 0.3), (100, 1 << 14, 1024, 5.0)])
def test_recall(spark, cell, most, asked, spread, monkeypatch):
    """Vectors of many lengths, in groups and without any, in one cell and in many."""
    monkeypatch.setattr(forest, "CELL_ROWS", cell)
    monkeypatch.setattr(forest, "MOST_ROWS", most)
    monkeypatch.setattr(forest, "MOST_QUERIES", asked)
    vectors = clustered(np.random.default_rng(cell), 1500, 24, spread)
    got = found(forest.nearest(table(spark, vectors), F.col("vec_id") % 10 == 0, n=10))
    due = brute(vectors, range(0, 1500, 10), 10)
    assert got.keys() == due.keys() and all([r for r, _, _ in x] == list(range(1, 11)) for x in got.values())
    assert np.mean([len({i for _, i, _ in got[k]} & {i for _, i, _ in due[k]}) / 10 for k in due]) >= 0.93
    assert all(abs(vectors[k] @ vectors[i] - s) < 1e-9 for k in got for _, i, s in got[k])


def test_a_chance_of_almost_nothing_misses_nothing(spark, monkeypatch):
    monkeypatch.setattr(forest, "CELL_ROWS", 80)
    vectors = clustered(np.random.default_rng(1), 400, 16, 1.0)
    vectors[5:60] = vectors[5]  # a vector that very many rows have, some of them queries
    vectors[70] = 40 * vectors[71]
    got, due = found(forest.nearest(table(spark, vectors), F.col("vec_id") % 9 == 0, n=12, miss=1e-12)), brute(vectors, range(0, 400, 9), 12)
    assert got.keys() == due.keys()
    for k in due:
        assert [(r, i) for r, i, _ in got[k]] == [(r, i) for r, i, _ in due[k]]
        assert np.allclose([s for *_, s in got[k]], [s for *_, s in due[k]], rtol=1e-12)


def test_odd_vectors(spark):
    vectors = [[1, 0], [1, 0], None, [0, 0], [None, 1], [float("nan"), 1], [float("inf"), 1], [], [1, 0, 0], [-1, 0], [0, 3], [-0.0, 3]]
    got = found(forest.nearest(table(spark, vectors), F.lit(True), n=3))
    assert got == {
        0: [(1, 1, 1.0), (2, 10, 0.0), (3, 11, 0.0)],
        1: [(1, 0, 1.0), (2, 10, 0.0), (3, 11, 0.0)],
        9: [(1, 10, 0.0), (2, 11, 0.0), (3, 0, -1.0)],
        10: [(1, 11, 9.0), (2, 0, 0.0), (3, 1, 0.0)],
        11: [(1, 10, 9.0), (2, 0, 0.0), (3, 1, 0.0)],
    }
    assert forest.nearest(table(spark, [[1.0]]).filter("false"), F.lit(True)).count() == 0
    assert forest.nearest(table(spark, [[1.0], [2.0]]), F.lit(False)).count() == 0
    named = found(forest.nearest(table(spark, [[1, 0], [1, 1], [0, 1]], ids=["a", "b", "c"]), F.col("vec_id") == "a", n=5))
    assert named == {"a": [(1, "b", 1.0), (2, "c", 0.0)]}


def test_ranges_of_a_sorted_array():
    rng = np.random.default_rng(4)
    strings = np.sort(np.append(rng.integers(-(1 << 63), 1 << 63, 300), rng.integers(0, 50, 40)))
    own = np.append(strings[::17], rng.integers(-(1 << 63), 1 << 63, 20))
    bits = lambda x: f"{int(x) & (1 << 64) - 1:064b}"
    for level in (0, 1, 2, 5, 9, 60, 64):
        low, high = forest.sharing(strings, own, np.full(len(own), level))
        assert [h - lo for lo, h in zip(low, high)] == [sum(bits(s)[:level] == bits(o)[:level] for s in strings) for o in own]
    for o, x in zip(own, forest.longest(strings, own, 6, 1)):
        share = sorted((next((k for k in range(64) if bits(s)[k] != bits(o)[k]), 64) for s in strings), reverse=True)
        assert x == max(1, share[5])


def test_query(spark):
    """The whole table against brute force."""
    rows = sorted((r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect())
    vectors = np.array([v for _, v in rows], float)
    assert [i for i, _ in rows] == list(range(len(rows)))
    got, due = found(queries.QUERIES["op13_hash_prefix_forest"](spark, SF)), brute(vectors, range(0, len(rows), 20), 20)
    assert got.keys() == due.keys()
    assert np.mean([len({i for _, i, _ in got[k]} & {i for _, i, _ in due[k]}) / 20 for k in due]) >= 0.9
