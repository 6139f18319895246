import re

import numpy as np
import xxhash

from ledgerloom.llm import simhash


def brute(texts, words):
    out = []
    for t in texts:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        runs = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
        out.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    return out


def groups_of(keys, linked):
    root = {k: k for k in keys}
    changed = True
    while changed:
        changed = False
        for a in keys:
            for b in keys:
                if linked(a, b) and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    return root


def test_groups_match_brute_force(docs, monkeypatch):
    monkeypatch.setattr(simhash, "TILE_ROWS", 3)
    rows = docs.collect()
    prints = dict(zip((r.doc_id for r in rows), brute([r.text for r in rows], 3)))
    for radius in (2, 12):
        root = groups_of([k for k in prints if k is not None], lambda a, b: (prints[a] ^ prints[b]).bit_count() <= radius)
        found = simhash.groups(docs, words=3, lanes=1, radius=radius).collect()
        assert len(found) == len(rows)
        for r in found:
            assert r.fp[0] & (1 << 64) - 1 == prints[r.doc_id]
            assert r.component_id == (root[r.doc_id] if r.doc_id is not None else None)


def test_near_copies_out_keeps_one_of_each_group(docs, no_docs):
    sets = {r.doc_id: set(runs_of(r.text, 5)) for r in docs.collect()}
    kept = simhash.near_copies_out(docs)
    assert kept.columns == docs.columns
    left = [r.doc_id for r in kept.collect()]
    like = lambda a, b: len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b])) if sets[a] or sets[b] else 1.0
    alone = [a for a in sets if a is not None and all(a == b or b is None or like(a, b) < 0.4 for b in sets)]
    assert set(alone) <= set(left) and None in left
    assert not [(a, b) for a in left for b in left if None not in (a, b) and a < b and like(a, b) >= 0.85]
    assert simhash.near_copies_out(no_docs).count() == 0 and simhash.groups(no_docs).count() == 0


def runs_of(text, words):
    return [r for runs in simhash.shingles(text, words) for r in runs]


def test_sets_of_runs_are_those_of_shingles(texts, monkeypatch):
    monkeypatch.setattr(simhash, "TEXTS_AT_ONCE", 7)
    texts = [*texts, "a b c d", "a b c", "A B c d e a b C d e f", None]
    for words in (1, 3, 5):
        found = list(simhash.run_sets(texts, words))
        runs = [set(runs_of(t, words)) for t in texts]
        assert list(map(len, found)) == list(map(len, runs))
        for a in range(len(texts)):
            for b in range(a):
                assert len(np.intersect1d(found[a], found[b])) == len(runs[a] & runs[b])


def test_long_texts_are_split_in_slices(monkeypatch):
    text = "One two\n\nTHREE four five  six seven eight nine " * 40 + "x" * 300 + " end"
    for words in (1, 3, 5):
        whole = runs_of(text, words)
        monkeypatch.setattr(simhash, "SLICE", 11)
        assert runs_of(text, words) == whole and len(whole) == len(text.split()) - words + 1
        assert [runs_of(t, words) for t in (None, " \n", "a")] == [[], [], [b"a"]]
        monkeypatch.setattr(simhash, "SLICE", 1 << 20)


def test_lanes_and_slices(spark):
    a = np.random.default_rng(0).integers(0, 1 << 63, (50, 4)).astype(np.uint64)
    a[7] = a[3] ^ np.uint64(5)
    found = {(int(x), int(y)) for i, j in simhash._compare(a, a, 8) for x, y in zip(i, j) if x < y}
    assert found == {(3, 7)}
    root = simhash.spanning(6, iter([(np.array([5, 4]), np.array([3, 5])), (np.array([0]), np.array([1]))]))
    assert root.tolist() == [0, 0, 2, 3, 3, 3]


def test_components(spark):
    from ledgerloom.llm.components import components
    from ledgerloom.llm.scratch import Scratch

    chain = [(k, k + 1) for k in range(0, 40)] + [(60, 50), (50, 70), (60, 50), (5, 5), (None, 3)]
    found = {r.id: r.component for r in components(spark.createDataFrame(chain, "a long, b long"), Scratch(spark)).collect()}
    assert found == {k: 0 for k in range(1, 41)} | {60: 50, 70: 50}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark)).count() == 0


def test_near_copies_are_those_of_the_exact_similarity(spark, monkeypatch):
    """Sets of few shingles and of many, at, just under and well under 0.8: SimHash distances of these overlap."""
    monkeypatch.setattr(simhash, "SET_ROWS", 2)
    monkeypatch.setattr(simhash, "SET_WIDTH", 64)
    names = (f"w{k}" for k in range(10**7))
    prose = lambda n: [next(names) for _ in range(n)]
    texts = []
    for _ in range(12):
        few, some, many = prose(8), prose(8), prose(404)
        texts += [few, few + prose(1)]  # 4 of 5 shingles
        texts += [prose(1) + some, some + prose(1)]  # 4 of 6
        texts += [many, many + prose(100), many + prose(101)]  # 400 of 500, 400 of 501
        texts += [many[:4] + prose(4)]
        base = prose(304)
        texts += [base + prose(50), base + prose(50)]  # 300 of 400: 0.75
    texts += [prose(3), [], []]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    runs = [set(runs_of(" ".join(t), 5)) for t in texts]
    like = lambda a, b: len(runs[a] & runs[b]) >= 0.8 * len(runs[a] | runs[b])
    root = groups_of(range(len(texts)), like)
    assert sorted(r.doc_id for r in simhash.near_copies_out(docs).collect()) == [k for k, r in root.items() if k == r]


def test_ids_of_any_type(spark):
    """Ids that are no numbers, where the order of strings is not that of the rows."""
    base = " ".join(f"w{k}" for k in range(60))
    rows = [("b-10", base), ("b-9", base), ("a-x", base + " more"), ("c", None), ("d", ""), ("e", "something else"), (None, base)]
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(3)
    found = {r.doc_id: r.component_id for r in simhash.groups(docs, radius=0).collect()}
    assert found == {"b-10": "b-10", "b-9": "b-10", "a-x": "a-x", "c": "c", "d": "c", "e": "e", None: None}
    assert sorted(str(r.doc_id) for r in simhash.near_copies_out(docs).collect()) == ["None", "a-x", "c", "e"]


def test_recall_by_kind_of_edit(spark):
    """Copies of the driver's own documents, edited in five ways to similarities of 0.8 to 1: every one of some hundreds goes."""
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()]
    rng, rows, due = np.random.default_rng(6), [], {}
    words = [t.split() for t in texts if t and 60 <= len(t.split()) <= 1500]
    some = [words[k] for k in rng.permutation(len(words))[:60]]
    for w in some:
        rows.append((len(rows), " ".join(w)))
        base, n = len(rows) - 1, len(w)
        for kind in ("replaced", "inserted", "deleted", "cut", "moved"):
            for share in (0.03, 0.08, 0.15):
                own, k = list(w), max(1, int(share * n / 5))
                if kind in ("replaced", "inserted"):
                    for at in rng.choice(n, k, replace=False):
                        own[at] = f"new{at}" if kind == "replaced" else f"{own[at]} new{at}"
                elif kind == "deleted":
                    own = [x for at, x in enumerate(w) if at not in set(rng.choice(n, k, replace=False).tolist())]
                elif kind == "cut":
                    own = own[: n - int(share * n)]
                else:
                    at, size = int(rng.integers(0, n // 2)), n // 4
                    own = own[:at] + own[at + size :] + own[at : at + size]
                a, b = (set(runs_of(" ".join(x), 5)) for x in (w, own))
                if 0.8 <= len(a & b) / len(a | b) < 1:
                    due[len(rows)] = (kind, base)
                    rows.append((len(rows), " ".join(own)))
    kept = {r.doc_id for r in simhash.near_copies_out(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).select("doc_id").collect()}
    assert len(due) >= 400 and {k for k, _ in due.values()} == {"replaced", "inserted", "deleted", "cut", "moved"}
    missed = [(kind, k) for k, (kind, _) in due.items() if k in kept]
    assert not missed
