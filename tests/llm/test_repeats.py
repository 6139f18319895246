import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import zstandard

from ledgerloom.llm import queries, repeats
from ledgerloom.llm.scratch import Scratch
from ledgerloom.workspace import new_path


def brute(raws, length):
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(r), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(r, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("length", [400, 200, 64])
def test_matches_brute_force(docs, length, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK_ROWS", 7)
    rows = docs.collect()
    expected = sorted(zip((str(r.doc_id) for r in rows), brute([(r.text or "").encode() for r in rows], length)))
    found = repeats.without_repeats(docs, length).collect()
    assert sorted((str(r.doc_id), (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in found) == expected
    assert all(r.source == "s" for r in found) and any(r.n_removed for r in found)


def test_long_texts_and_overlaps(spark, monkeypatch):
    """Texts of many kilobytes with repeats at all distances, some of which overlap themselves, and columns whose names clash."""
    monkeypatch.setattr(repeats, "MEMBERS_AT_ONCE", 50)
    monkeypatch.setattr(repeats, "TEXTS_AT_ONCE", 3)
    rng = random.Random(8)
    letters = lambda n: "".join(rng.choices("abcdefé", k=n))
    shared = [letters(n) for n in (399, 400, 401, 900, 5000)]
    texts = ["".join(x for _ in range(8) for x in (letters(rng.randint(0, 700)), rng.choice(shared)[rng.randint(0, 30) :])) for _ in range(12)]
    texts += [letters(120_000), "ab" * 700, letters(5000) + shared[4], shared[4][:-1] + "x"]
    rows = [(k, t, "p", 1, b"z") for k, t in enumerate(texts)]
    found = repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string, part string, row int, packed binary").repartition(3)).collect()
    assert sorted((r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in found) == list(enumerate(brute([t.encode() for t in texts], 400)))


def test_tiles_give_the_same_anchors(monkeypatch):
    raw = bytes(np.random.default_rng(1).integers(97, 101, 5000, dtype=np.uint8))
    whole = repeats.anchors([raw, b"", b"x" * 399, raw[:450]], 400, 256)
    monkeypatch.setattr(repeats, "TILE", 700)
    tiled = repeats.anchors([raw, b"", b"x" * 399, raw[:450]], 400, 256)
    assert [w.tolist() for w in whole] == [t.tolist() for t in tiled]
    # every start has an anchor among its first 256 places
    assert all(((whole[0] >= p) & (whole[0] < p + 256)).any() for p in range(len(raw) - 399))


def test_memory_does_not_follow_the_size_of_batches():
    """A worker holds the members of some texts, not those of a whole batch."""
    rng = np.random.default_rng(3)
    n = 4 * repeats.TEXTS_AT_ONCE
    packed = [zstandard.compress(rng.integers(97, 123, 2000, dtype=np.uint8).tobytes()) for _ in range(n)]
    batch = pd.DataFrame({"part": 7, "row": np.arange(n, dtype=np.int32), "packed": packed})
    members, peaks = repeats._members(200, 128), []
    for size in (repeats.TEXTS_AT_ONCE, n):
        tracemalloc.start()
        found = [(m["row"].nunique(), len(m)) for m in members(iter([batch[:size]]))]
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert max(rows for rows, _ in found) <= repeats.TEXTS_AT_ONCE and sum(rows for rows, _ in found) == size
    assert peaks[1] < 1.5 * peaks[0]


def test_empty_table_and_short_length(no_docs):
    assert repeats.without_repeats(no_docs).count() == 0
    with pytest.raises(ValueError):
        repeats.without_repeats(no_docs, 10)


def test_query_tells_what_is_left(spark):
    """Passages of over 50 words in two documents go, and texts without any stay as they are, of ASCII letters alone or not."""
    rng = random.Random(4)
    prose = lambda n, letters: " ".join("".join(rng.choices(letters, k=rng.randint(6, 10))) for _ in range(n))
    passages = [prose(60, "abcdefgh"), prose(60, "abcdéfgü")]
    clean = [prose(80, "abcdefgh"), prose(80, "abcdéfgü"), None, ""]
    ends = [(prose(9, "ijkl"), prose(9, "mnop")) for _ in range(4)]
    rows = [f"{a} {k} {passages[k % 2]} {k} {b}" for k, (a, b) in enumerate(ends)] + clean
    folder = new_path(spark, "tables")
    spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    found = queries.QUERIES["op3_repeated_strings"](spark, folder)
    assert found.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"]
    found = sorted(found.collect())
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found] == brute([(t or "").encode() for t in rows], 400)
    assert [r.text for r in found[4:]] == [t or "" for t in clean] and not any(r.n_removed for r in found[4:])
    assert [r.text for r in found[:4]] == [f"{a} {k}{k} {b}" for k, (a, b) in enumerate(ends)]
    assert all(hashlib.sha256(r.text.encode()).hexdigest() == r.kept_sha256 and r.n_bytes - r.n_removed == len(r.text.encode()) for r in found)


def test_core_in_very_many_hulls_is_dealt_out(spark):
    """A core with very many classes is split among tasks, and its members stay open like those of others."""
    conf = {"autoBroadcastJoinThreshold": "-1", "files.maxPartitionBytes": "16k", "files.openCostInBytes": "1k", "shuffle.partitions": "8", "adaptive.coalescePartitions.enabled": "false", "adaptive.advisoryPartitionSizeInBytes": "16k", "adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    before, plans = {k: spark.conf.get(f"spark.sql.{k}") for k in conf}, {}

    class Watched(Scratch):
        def keep(self, df, name):
            df.collect()
            plans[name] = df._jdf.queryExecution().executedPlan().toString()
            return super().keep(df, name)

    many, few = 20_000, 2_000
    rows = pd.DataFrame({"part": 0, "row": 0, "pos": range(many + few), "node": 0, "core": [7] * many + [8 + k // 2 for k in range(few)], "hull": range(many + few), "whole": True})
    rows.loc[1, "hull"] = 0
    try:
        for k, v in conf.items():
            spark.conf.set(f"spark.sql.{k}", v)
        spans, still = repeats._resolve(spark.createDataFrame(rows, repeats.MEMBER).repartition(8), 256, 400, Watched(spark))
        assert "skew=true" in plans["open"]
        assert spans.count() == 2 and still.count() == many + few - 1
    finally:
        for k, v in before.items():
            spark.conf.set(f"spark.sql.{k}", v)


def test_columns_with_the_names_in_use_stay(spark):
    more = ["part", "row", "packed", "pos", "node", "core", "start", "stop", "c0", "a.b"]
    text = "0123456789abcdefghijklmnopqrstuvwxyz" * 3
    rows = spark.createDataFrame([(k, text, *(f"{c}{k}" for c in more), k, k) for k in range(3)], "doc_id int, text string, " + ", ".join(f"`{c}` string" for c in more) + ", n_bytes int, kept_text int")
    found = repeats.without_repeats(rows, length=64)
    assert found.columns == ["doc_id", *more, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
    assert sorted(tuple(r)[:-2] for r in found.collect()) == [(k, *(f"{c}{k}" for c in more), 108, 108, 1) for k in range(3)]
