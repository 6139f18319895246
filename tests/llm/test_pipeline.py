"""The stages of the corpus pipeline and the whole of it, against plain versions of each."""

import bisect
import math
import zlib
from collections import Counter
from concurrent.futures import ThreadPoolExecutor

import corpus_pipeline
import numpy as np
import pytest
import regex
from test_langid import bag
from test_repeats import brute as cut
from test_simhash import groups_of
from tokenizers import Tokenizer

from ledgerloom.llm import langid, simhash
from ledgerloom.llm.queries import tokenizer_file
from ledgerloom.llm.scratch import left, released
from ledgerloom.workspace import new_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def with_language(rows):
    """Rows whose text has a letter and a language with half of the posterior, learned from the rows that aren't held out."""
    learned = [r for r in rows if r.lang is not None and r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5]
    kinds = sorted({r.lang for r in learned})
    counts = {k: sum((bag(r.text or "") for r in learned if r.lang == k), Counter()) for k in kinds}
    size = {k: counts[k].total() + langid.SMOOTHING * langid.BUCKETS for k in kinds}
    out = []
    for r in rows:
        if r.text and regex.search(r"\p{L}", r.text):
            logs = [math.log(sum(x.lang == k for x in learned) / len(learned)) + sum(n * math.log((counts[k][b] + langid.SMOOTHING) / size[k]) for b, n in bag(r.text).items()) for k in kinds]
            if 1 / sum(math.exp(x - max(logs)) for x in logs) >= 0.5:
                out.append(r)
    return out


def one_of_each_group(rows):
    runs = {r.doc_id: {x for runs in simhash.shingles(r.text, 5) for x in runs} for r in rows if r.doc_id is not None}
    root = groups_of(sorted(runs), lambda a, b: len(runs[a] & runs[b]) >= 0.8 * len(runs[a] | runs[b]))
    return [r for r in rows if r.doc_id is None or root[r.doc_id] == r.doc_id]


def without_repeats(rows, length=200):
    raws = [(r.text or "").encode() for r in rows]
    seen, out = Counter(x[i : i + length] for x in raws for i in range(len(x) - length + 1)), []
    for r, raw, due in zip(rows, raws, cut(raws, length)):
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            gone[i : i + length] |= seen[raw[i : i + length]] > 1
        assert gone.sum() == due[1]
        text = np.frombuffer(raw, np.uint8)[~gone].tobytes().decode(errors="ignore")
        out.append((r.doc_id, text, r.lang, r.source, len(text)))
    return out


def pieces_of(rows, capacity=1024):
    tokenizer, out = Tokenizer.from_file(tokenizer_file()), []
    for key, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        starts = [0, *range(len(ids) % capacity or capacity, len(ids), capacity)]
        out += [(key, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)]))]
    return out


def held(found):
    """What a packing says of pieces, once its sequences are found to have neither holes nor overlaps, and to be few."""
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append(r)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    gaps = []
    for length in sorted((r.length for r in found), reverse=True):
        at = bisect.bisect_left(gaps, length)
        bisect.insort(gaps, (gaps.pop(at) if at < len(gaps) else 1024) - length)
    assert len(sequences) <= 1.02 * len(gaps) + 1
    return plain((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found)


def plain(rows):
    return sorted(map(str, map(tuple, rows)))


@pytest.fixture
def labelled(spark, texts):
    """The texts in languages that tell them apart or don't, with repeated rows, ties, odd texts, one without an id, and a long one."""
    lang = lambda k, t: None if k % 9 == 4 else "x" if t and "th" in t else "y" if t and "éu" in t else "z" if k % 2 else "x"
    rows = [(3 * k + 1, t, lang(k, t), "s", len(t or "")) for k, t in enumerate(texts)]
    rows += [rows[2], (None, "the thing without an id", "x", "s", 23), (1000, "thing " * 9000, "x", "s", 54000), (1001, "日本語" * 30, None, "s", 90)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def test_each_stage_on_its_own_input(spark, labelled):
    language, near, repeated, packing = (f for _, f in corpus_pipeline.STAGES)
    rows = labelled.collect()
    kept = language(spark, labelled, "").collect()
    assert plain(kept) == plain(with_language(rows)) and 0 < len(kept) < len(rows)
    kept = near(spark, labelled, "").collect()
    assert plain(kept) == plain(one_of_each_group(rows)) and 0 < len(kept) < len(rows)
    assert plain(repeated(spark, labelled, "").collect()) == plain(without_repeats(rows))
    assert held(packing(spark, labelled, "").collect()) == plain(pieces_of((r.doc_id, r.text) for r in rows))


def test_whole(spark, labelled):
    sf_dir = new_path(spark, "tables")
    labelled.write.parquet(f"{sf_dir}/documents.parquet")
    others = left(spark)
    due = plain(pieces_of(r[:2] for r in without_repeats(one_of_each_group(with_language(labelled.collect())))))
    # two at once, and a result of an operator that is read when both are through
    waiting = simhash.groups(labelled, radius=0)

    def whole():
        with released(spark):
            return held(corpus_pipeline.run(spark, sf_dir).collect())

    with ThreadPoolExecutor(2) as pool:
        assert [x.result() for x in [pool.submit(whole), pool.submit(whole)]] == [due, due]
    assert waiting.count() == labelled.count()
    with released(spark):
        assert simhash.groups(labelled, radius=0).count() == labelled.count()
    # what is left is what the waiting result is read from
    assert 0 < len(left(spark) - others) <= 6 and waiting.count() == labelled.count()


def test_empty_tables_and_more_columns(spark, labelled):
    nothing = labelled.filter("false")
    more = labelled.selectExpr("*", "1 AS id", "2 AS grp", "'a' AS part", "3 AS score", "4 AS n_bytes")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, "").count() == 0
    for _, stage in corpus_pipeline.STAGES[:3]:
        found = stage(spark, more, "")
        assert found.columns == more.columns
        assert {(r.part, r.score, r.n_bytes) for r in found.collect()} == {("a", 3, 4)}
    assert corpus_pipeline.STAGES[3][1](spark, more, "").count() >= labelled.count()


def test_packing_keeps_documents_without_text(spark):
    docs = spark.createDataFrame([(1, "some text", "en", "s", 9), (2, "", "en", "s", 0), (3, None, None, "s", 0)], SCHEMA)
    found = corpus_pipeline.packing_plan(spark, docs, "").collect()
    assert sorted(r.doc_id for r in found) == [1, 2, 3]
    assert [r.length for r in sorted(found, key=lambda r: r.doc_id)][1:] == [1, 1]
