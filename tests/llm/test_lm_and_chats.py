import math
from collections import Counter

import duckdb
import pytest

from ledgerloom.llm import lm, preference, queries

SF = "/root/testdata/sf0.001"


def brute(texts, order, least):
    texts = [t.encode().split() for t in texts]
    counts = Counter(tuple(t[i : i + k]) for t in texts for k in range(1, order + 1) for i in range(len(t) - k + 1))
    total, out = sum(map(len, texts)), []
    for t in texts:
        score = backed = 0
        for i in range(len(t)):
            ratio, longest = counts[(t[i],)] / total, 1
            for k in range(2, min(order, i + 1) + 1):
                gram = tuple(t[i - k + 1 : i + 1])
                if counts[gram] >= least:
                    ratio, longest = counts[gram] / counts[gram[:-1]], k
                else:
                    ratio *= lm.BACKOFF
            score += round(math.log(ratio) * lm.MICRO)
            backed += longest < min(order, i + 1)
        out.append((len(t), backed, score))
    return out


@pytest.mark.parametrize("order,least,size", [(3, 2, 1 << 20), (5, 2, 100), (1, 2, 7), (4, 3, 50), (3, 1, 1000)])
def test_scores_match_brute_force(docs, no_docs, order, least, size, monkeypatch):
    monkeypatch.setattr(lm, "SLICE", size)
    monkeypatch.setattr(lm, "BLOCK_ROWS", 6)
    docs = docs.withColumnRenamed("source", "part").withColumnRenamed("n_chars", "n")
    rows = docs.collect()
    expected = sorted((str(r.doc_id), *x) for r, x in zip(rows, brute([r.text or "" for r in rows], order, least)))
    found = sorted((str(r.doc_id), r.n_words, r.n_backed_off, r.log_score_micro, r.score) for r in lm.scores(docs, order, least).collect())
    assert [f[:3] for f in found] == [e[:3] for e in expected]
    assert all(abs(f[3] - e[3]) <= 2 for f, e in zip(found, expected))
    assert all(f[4] == (f[3] / f[1] / 1e6 if f[1] else None) for f in found)
    assert lm.scores(no_docs).count() == 0


def test_copies_score_above_others(spark):
    """The area under the curve of the mean score for documents that come twice, among all of the smallest table."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("n_chars > 100")
    copied = docs.groupBy("text").count().filter("count > 1").select("text")
    twice = {r.doc_id for r in docs.join(copied, "text", "left_semi").collect()}
    scores = [(r.score, r.doc_id in twice) for r in lm.scores(docs).collect()]
    ones, others = [s for s, c in scores if c], [s for s, c in scores if not c]
    assert len(ones) >= 4
    assert sum((a > b) + (a == b) / 2 for a in ones for b in others) / len(ones) / len(others) > 0.85


def test_words_of_long_texts(monkeypatch):
    monkeypatch.setattr(lm, "SLICE", 64)
    raws = [b"a" * 1000 + b" b  " + "é".encode() * 40, b"", b" \t", b"x y x", b"a" * 1000]
    hashes, n = lm.words(raws)
    assert n.tolist() == [3, 0, 0, 3, 1]
    seen = {}
    assert all(seen.setdefault(w, h) == h for w, h in zip([w for r in raws for w in r.split()], hashes.tolist()))
    assert len(set(seen.values())) == len(seen) == 5


def chats(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_preference_rows(spark):
    hello = [(0, "user", "hi"), (1, "assistant", "yes")]
    rows = [(1, *t) for t in [*hello, (2, "user", "more"), (3, "assistant", "A")]] + [(5, *t) for t in [*hello, (2, "user", "other"), (3, "assistant", "B"), (4, None, None)]]
    rows += [(7, *t) for t in hello] + [(8, *t) for t in hello] + [(9, 0, "user", "alone"), (9, 0, "user", "alone"), (None, 0, "user", "hi")]
    found = {r.pair_id: r for r in preference.preference_rows(chats(spark, rows).selectExpr("*", "1 AS idx", "'x' AS side", "2 AS pair_id", "3 AS prompt")).collect()}
    assert set(found) == {1, 7, 9}
    r = found[1]
    assert (r.n_common, r.prompt) == (2, "<|user|>\nhi<|end|>\n<|assistant|>\nyes<|end|>\n")
    assert r.chosen == "<|user|>\nmore<|end|>\n<|assistant|>\nA<|end|>\n" and r.rejected.endswith("<|assistant|>\nB<|end|>\n<||>\n<|end|>\n")
    start, stop = map(int, r.chosen_mask.split("-"))
    assert r.chosen[start:stop] == "A<|end|>\n"
    start, stop = map(int, r.rejected_mask.split("-"))
    assert r.rejected[start:stop] == "B<|end|>\n"
    assert (found[7].n_common, found[7].chosen, found[7].rejected) == (2, "", "")
    assert (found[9].n_common, found[9].prompt, found[9].rejected) == (0, "", "") and found[9].chosen.count("alone") == 2
    assert preference.preference_rows(chats(spark, [])).count() == 0


def test_one_opening_of_many_parts(spark, monkeypatch):
    monkeypatch.setattr(preference, "PART", 4)
    rows = [(k, 0, "user", "hi") for k in range(0, 60, 3)]
    assert sorted(r.pair_id for r in preference.preference_rows(chats(spark, rows)).collect()) == list(range(0, 60, 6))


@pytest.mark.parametrize("name", ["op1_stupid_backoff", "op7_preference_rows"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    expected = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in expected.description]
    found = queries.QUERIES[name](spark, SF).select(columns).collect()
    assert sorted(map(tuple, found), key=str) == sorted(expected.fetchall(), key=str)
