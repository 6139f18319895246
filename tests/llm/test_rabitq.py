import numpy as np
import pytest

from ledgerloom.llm import rabitq


def table(spark, vectors, kind="array<float>"):
    return spark.createDataFrame([(k, None if v is None else [None if x is None else float(x) for x in v], 1) for k, v in enumerate(vectors)], f"vec_id long, embedding {kind}, n_links int").repartition(3)


@pytest.mark.parametrize("size,dense", [(16, 4), (64, 4), (100, 0), (64, 0)])
def test_matches_brute_force(spark, size, dense, monkeypatch):
    """Also with every pair of cells that has undecided pairs computed again as a whole."""
    monkeypatch.setattr(rabitq, "LEAST_ROWS", 40)
    monkeypatch.setattr(rabitq, "DENSE", dense)
    rng = np.random.default_rng(size)
    base = rng.standard_normal((120, size))
    near = base[:30] + 0.4 * rng.standard_normal((30, size))
    vectors = np.concatenate([base, near, base[:5], 3 * base[5:8], base[:3] + 0.45 * rng.standard_normal((3, size))]).astype(np.float32)
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    label = np.arange(len(vectors))
    for _ in range(20):
        label = np.array([min(label[i], label[linked[i]].min(initial=label[i])) for i in range(len(label))])
    found = {r.vec_id: r for r in rabitq.near_copies(table(spark, vectors)).collect()}
    for k in range(len(vectors)):
        assert (found[k].n_links, found[k].component_id, found[k].kept) == (linked[k].sum(), label[k], label[k] == k)
    assert linked.any()


def test_odd_vectors(spark):
    vectors = [[1, 0], [1, 0], None, [0, 0], [None, 1], [float("nan"), 1], [float("inf"), 1], [], [1, 0, 0], [1e-30, 0], [1e30, 1e30]]
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in rabitq.near_copies(table(spark, vectors)).collect()}
    assert found == {0: (2, 0, True), 1: (2, 0, False), 9: (2, 0, False)} | {k: (0, k, True) for k in (2, 3, 4, 5, 6, 7, 8, 10)}
    assert rabitq.near_copies(table(spark, [[1.0]]).filter("false")).count() == 0
    no_id = spark.createDataFrame([(None, [1.0, 0.0]), (4, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert {tuple(r) for r in rabitq.near_copies(no_id).collect()} == {(None, 0, None, False), (4, 0, 4, True)}


def test_estimates_are_unbiased_and_bounds_hold():
    rng = np.random.default_rng(3)
    a, b = rng.standard_normal((2, 1, 64))
    b = 0.7 * a + 0.5 * b
    true = float(a[0] @ b[0] / np.linalg.norm(a) / np.linalg.norm(b))
    got = []
    for seed in range(300):
        (code, _, _, own), (_, steps, _, factors) = rabitq.encode(a, seed), rabitq.encode(b, seed)
        got.append(rabitq.estimate(code, own[:, 0], steps, factors, 64)[0, 0])
        exact = np.cos(max(0.0, np.arccos(np.clip(rabitq.code_products(code, steps, factors, 64)[0, 0] + factors[0, 3], -1, 1)) - np.arccos(own[0, 0])))
        assert true <= exact + 1e-5
    assert abs(np.mean(got) - true) < 3 * np.std(got) / np.sqrt(len(got)) + 0.01


def test_thousands_of_links(spark, monkeypatch):
    """Groups of near vectors that are all different, one with a third of all rows."""
    monkeypatch.setattr(rabitq, "LEAST_ROWS", 100)
    rng = np.random.default_rng(1)
    base = rng.standard_normal((20, 64))
    of = np.append(np.zeros(200, int), rng.integers(0, 20, 400))
    vectors = base[of] + 0.3 * rng.standard_normal((600, 64))
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    assert linked.sum() > 10_000
    found = {r.vec_id: r.n_links for r in rabitq.near_copies(table(spark, vectors, "array<double>")).collect()}
    assert [found[k] for k in range(600)] == linked.sum(1).tolist()


def test_bounds_leave_out_no_link_and_most_others():
    """The estimate's confidence bound decides: what it leaves out has no cosine of 0.9, and that is nearly all of unrelated pairs."""
    rng = np.random.default_rng(2)
    a = rng.standard_normal((400, 64))
    b = np.concatenate([a[:200] + rng.uniform(0.1, 0.7, (200, 1)) * rng.standard_normal((200, 64)), rng.standard_normal((200, 64))])
    cell = lambda v: rabitq._Cell(np.arange(len(v)), *rabitq.encode(v))
    true = rabitq._unit(a) @ rabitq._unit(b).T >= 0.9
    for eps in (None, 6.0):
        i, j = rabitq.undecided(cell(a), cell(b), 0.9, False, eps, 1 << 30)
        left = np.zeros_like(true)
        left[i, j] = True
        assert not (true & ~left).any() and true.sum() <= left.sum() < true.sum() + 20


def test_ids_of_any_type(spark):
    rows = [("x9", [1.0, 0.0]), ("x10", [1.0, 0.1]), ("y", [0.0, 1.0]), ("x9", [2.0, 0.0])]
    found = rabitq.near_copies(spark.createDataFrame(rows, "vec_id string, embedding array<double>"))
    assert sorted(map(tuple, found.collect())) == [("x10", 2, "x10", True), ("x9", 2, "x10", False), ("x9", 2, "x10", False), ("y", 0, "y", True)]


def test_cells_that_are_too_far_apart_do_not_meet(spark, monkeypatch):
    """Groups of vectors: links are those of brute force, and few pairs of cells are left; with vectors of two lengths."""
    for name in ("LEAST_ROWS", "MOST_ROWS"):
        monkeypatch.setattr(rabitq, name, 20)
    monkeypatch.setattr(rabitq, "PIVOTS", 40)
    rng, left = np.random.default_rng(8), []
    centres = rng.standard_normal((12, 32))
    vectors = centres[rng.integers(0, 12, 480)] + 0.25 * rng.standard_normal((480, 32))
    near_cells = rabitq.near_cells

    def counted(cells, between, least):
        pairs = near_cells(cells, between, least)
        left.append((pairs.count(), cells.filter("d = 32").count()))
        return pairs

    monkeypatch.setattr(rabitq, "near_cells", counted)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.9).sum(1) - 1
    found = {r.vec_id: r.n_links for r in rabitq.near_copies(table(spark, [*vectors, [1.0, 0.0], [2.0, 0.1]], "array<double>")).collect()}
    assert found == dict(enumerate(links)) | {480: 1, 481: 1} and links.max() > 5
    pairs, cells = left[0]
    assert cells >= 24 and pairs < 0.5 * cells * (cells + 1) / 2
