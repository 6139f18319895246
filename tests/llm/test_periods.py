import hashlib
import random
import re
import zlib

import pytest

from ledgerloom.llm import periods, queries

SF = "/root/testdata/sf0.001"


def brute_runs(w, least, times):
    """Every lag's stretches of matches; of equal stretches the smallest lag."""
    found = {}
    for q in range(1, len(w) // times + 1):
        i = q
        while i < len(w):
            j = i
            while j < len(w) and w[j] == w[j - q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                found.setdefault((i - q, j - i + q), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def collapsed(w, runs):
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in dropped)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def repeating(rng, n):
    w = []
    while len(w) < n:
        part = [rng.choice("abc") for _ in range(rng.randint(1, 9))]
        w += part * rng.choice([1, 1, 2, 3, 4, 5, 9]) + part[: rng.randint(0, len(part))]
    return w


@pytest.mark.parametrize("least,times,at_once", [(6, 4, 1 << 20), (6, 4, 100), (3, 3, 1), (1, 5, 300), (40, 4, 50)])
def test_runs_match_brute_force(spark, texts, least, times, at_once, monkeypatch):
    monkeypatch.setattr(periods, "BYTES_AT_ONCE", at_once)
    monkeypatch.setattr(periods, "SLICE", at_once)
    rng = random.Random(least + times)
    some = texts + [rng.choice([" ", "\n", "\t "]).join(repeating(rng, rng.randint(1, 400))) for _ in range(60)]
    some += ["a " * 999, "a b " * 500 + "c " + "a b " * 500, "x\x1cy\x85z " * 3 + " é é é é é é"]
    rows = [(k if k % 9 else None, t, 7, k) for k, t in enumerate(some)] + [(1, some[1], 7, 1)] * 2
    docs = spark.createDataFrame(rows, "doc_id int, text string, runs int, n_words int").repartition(3)
    due = []
    for k, t, *_ in rows:
        runs = brute_runs(words(t), least, times)
        due.append((str(k), len(words(t)), runs, collapsed(words(t), runs)))
    found = [(str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periods.periodic_runs(docs, least, times).collect()]
    assert sorted(found) == sorted(due)
    assert sum(len(d[2]) for d in due) > 30


def test_empty_and_refused(no_docs):
    found = periods.periodic_runs(no_docs)
    assert found.count() == 0 and found.columns == ["doc_id", "n_words", "runs", "collapsed"]
    with pytest.raises(ValueError):
        periods.periodic_runs(no_docs, times=2)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query(spark):
    """The whole table against brute force: planted periods, digests and the longest run."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    found = {r.doc_id: r for r in queries.QUERIES["op11_periodic_runs"](spark, SF).collect()}
    assert len(found) == len(docs)
    n_planted = 0
    for d in docs:
        w = words(d.text)
        n, h = len(w), zlib.crc32(str(d.doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
            n_planted += 1
        if len(w) > 1500:
            continue  # brute force takes too long
        runs = brute_runs(w, 6, 4)
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
        milli = best[0] is not None and 1000 * best[1] // best[2] or None
        due = (d.doc_id, len(runs), *best, milli, digest("".join(f"{s},{m},{q}\n" for s, m, q in runs)), digest(collapsed(w, runs)))
        assert tuple(found[d.doc_id]) == due
    assert n_planted > 10 and sum(r.n_runs for r in found.values()) > 5
