import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from ledgerloom.llm import queries, spelling
from ledgerloom.llm.scratch import Scratch

SF = "/root/testdata/sf0.001"
UPPER = {k: k + 32 for k in range(65, 91)}


def one_away(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    a, b = sorted((a, b), key=len)
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def brute_near(words):
    """Pairs by their common results of one deletion, each checked."""
    by = defaultdict(set)
    for w in words:
        for x in {w} | {w[:k] + w[k + 1 :] for k in range(len(w))}:
            by[x].add(w)
    return {(a, b) for group in by.values() for a in group for b in group if one_away(a, b)}


def brute_variants(counts, times):
    near, best = defaultdict(list), {}
    for a, b in brute_near(set(counts)):
        near[a].append(b)
    for w, found in near.items():
        top = min(found, key=lambda x: (-counts[x], x))
        if counts[top] >= times * counts[w]:
            best[w] = top
    rows = {}
    for w, n in counts.items():
        root = w
        while root in best:
            root = best[root]
        rows[w] = (best.get(w), root, n, len(near[w]), counts.get(best.get(w)))
    return rows


def invented(rng, n, letters, sizes):
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(*sizes))) for _ in range(n)}
    for w in sorted(words)[: n // 2]:
        k = rng.randint(0, len(w))
        words.add(rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1 :]]) or "a")
    return words


@pytest.mark.parametrize("letters,sizes,half_rows,cells", [("ab", (1, 9), 1 << 15, 1 << 21), ("abcdé÷", (3, 7), 20, 50), ("abc", (6, 12), 3, 30), ("xyz\U0001f600", (2, 5), 40, 1 << 21)])
def test_near_words_match_brute_force(spark, letters, sizes, half_rows, cells, monkeypatch):
    """Also with most halves dealt to several shards, and few patterns at once."""
    monkeypatch.setattr(spelling, "HALF_ROWS", half_rows)
    monkeypatch.setattr(spelling, "CELLS", cells)
    words = invented(random.Random(len(letters)), 300, letters, sizes)
    rows = spark.createDataFrame([(w, k + 1, "x") for k, w in enumerate(sorted(words))] + [(None, 3, "x"), ("", 4, "x")], "word string, n long, half string").repartition(4)
    found = [(r.word, r.near, r.near_n) for r in spelling.near_words(rows, Scratch(spark)).collect()]
    place = {w: k + 1 for k, w in enumerate(sorted(words))}
    assert sorted(found) == sorted((a, b, place[b]) for a, b in brute_near(words))
    assert len(found) > 100


def test_intervals_are_those_of_the_sorted_suffixes():
    rng = random.Random(2)
    words = sorted(invented(rng, 80, "abc", (1, 6)))
    index = spelling.SuffixRanks(words)
    suffixes = [w[k:] for w in words for k in range(len(w))]
    for pattern in {s[: rng.randint(1, 4)] for s in suffixes}:
        low, high = np.array([0]), np.array([index.size])
        for symbol in index.symbols(pattern)[::-1]:
            low, high = index.extend(np.array([symbol]), low, high)
        assert high[0] - low[0] == sum(s.startswith(pattern) for s in suffixes)
    low, high = index.extend(index.symbols("z"), np.array([0]), np.array([index.size]))
    assert low[0] == high[0]


@pytest.mark.parametrize("times", [2, 5])
def test_variants_match_brute_force(spark, times):
    rng = random.Random(times)
    counts = {w: int(5 ** rng.uniform(0, 6)) for w in invented(rng, 250, "abc", (3, 6))}
    rows = spark.createDataFrame([(w, n, w) for w, n in counts.items()], "word string, n int, form string")
    found = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(rows, times).collect()}
    assert found == brute_variants(counts, times)
    assert any(f and r not in (f, w) for w, (f, r, *_) in found.items())


def test_odd_words(spark):
    nothing = spark.createDataFrame([], "word string, n long")
    assert spelling.variants(nothing).count() == 0
    alone = spelling.variants(spark.createDataFrame([("word", 9), (None, 9), ("", 9)], "word string, n long")).collect()
    assert [tuple(r) for r in alone] == [("word", None, "word", 9, 0, None)]
    long = "ab" * 3000
    pair = spelling.variants(spark.createDataFrame([(long, 9), (long + "c", 50)], "word string, n long")).collect()
    assert {(r.n, r.n_near, r.form_n, r.root == long + "c") for r in pair} == {(9, 1, 50, True), (50, 1, None, True)}
    with pytest.raises(ValueError):
        spelling.variants(nothing, times=1)


def due(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 and doc_id is not None else run] += 1
    return brute_variants({w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}, 5)


def test_query(spark):
    """The whole table against brute force."""
    found = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in queries.QUERIES["op12_spelling_variants"](spark, SF).collect()}
    assert found == due([(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()])
    assert len(found) > 100


def test_query_on_odd_documents(spark, tmp_path):
    long = "ÀÉabcdeF" * 2000
    rows = [(k, f"Straßen straßen STRAßEN Àbcdefg Bbcdefg bbcdefg {long} bbcdefgh x{k}", "l") for k in range(6)] + [(None, "Bbcdefg", "l"), (9, None, "l"), (9, "", "l"), (9, "bbcdefg", "l"), (9, "bbcdefg", "l")]
    spark.createDataFrame(rows, "doc_id long, text string, run string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in queries.QUERIES["op12_spelling_variants"](spark, str(tmp_path)).collect()}
    assert found == due([r[:2] for r in rows]) and len(found) > 4
