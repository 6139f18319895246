import math
import random
import zlib
from collections import Counter

import pytest
import regex

from ledgerloom.llm import langid


def test_identify_learns_only_from_its_folds(spark, no_docs):
    words = {"aa": ["le", "de", "queux"], "bb": ["und", "schie", "keit"], "cc": ["the", "thing", "wh"]}
    rows = [(k, " ".join(words[lang][(k + j) % 3] for j in range(9)), lang if k % 4 else None, "s") for k in range(150) for lang in [list(words)[k % 3]]]
    rows += [(900, None, "aa", "s"), (901, "12 !! ", "bb", "s"), (902, "", None, "s"), (None, "the thing", "cc", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    found = langid.identify(docs).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        if r.text is None or not regex.search(r"\p{L}", r.text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred == next(x for x in words if r.text.split()[0] in words[x]) and 0.5 < r.score <= 1
    # labels and ids of what is predicted do not matter
    other = docs.selectExpr("doc_id", "text", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0 THEN 'zz' ELSE lang END AS lang")
    assert {(r.doc_id, r.lang_pred, r.score) for r in langid.identify(other).collect()} == {(r.doc_id, r.lang_pred, r.score) for r in found}
    assert langid.identify(no_docs).count() == 0
    kept = langid.with_language(docs)
    assert kept.columns == docs.columns and {900, 901, 902}.isdisjoint({r.doc_id for r in kept.collect()})


def bucket(gram):
    """Of an n-gram, by plain integers."""
    h = len(gram)
    for c in gram:
        h = (h ^ ord(c)) * 0x9E3779B97F4A7C15 % 2**64
        h ^= h >> 32
    return h % langid.BUCKETS


def bag(text):
    text = f" {text.lower()} "
    return Counter(bucket(text[i : i + n]) for n in langid.ORDERS for i in range(len(text) - n + 1))


def test_matches_a_plain_naive_bayes(spark, monkeypatch):
    """Counts, priors, posteriors and ties, worked out anew from the text of the contract."""
    rng = random.Random(7)
    speech = {"l1": ["ka", "to", "mi"], "l2": ["ka", "re", "ßu"], "l3": ["日本", "re", "İx"]}
    make = lambda lang, n: " ".join(rng.choice(speech[lang]) + rng.choice(["", "a", "o"]) for _ in range(n))
    labelled = [(make(lang, rng.randint(1, 30)), lang) for lang in rng.choices(list(speech), [5, 2, 1], k=60)] + [(None, "l1"), ("", "l2")]
    labelled += [(t, "l0") for t, lang in labelled if lang == "l1"]  # l0 and l1 tie everywhere
    docs = spark.createDataFrame(labelled + [("never", None)], "text string, lang string").repartition(3)
    texts = [make(lang, n) for lang in speech for n in (1, 5, 200)] + ["x", "Καλός ΣΑΣ", "a" * 500]

    kinds = sorted({lang for _, lang in labelled})
    counts = {k: sum((bag(t or "") for t, lang in labelled if lang == k), Counter()) for k in kinds}
    prior = {k: sum(lang == k for _, lang in labelled) / len(labelled) for k in kinds}
    size = {k: counts[k].total() + langid.SMOOTHING * langid.BUCKETS for k in kinds}
    for size_, at_once in ((1 << 18, 16), (40, 1)):
        monkeypatch.setattr(langid, "SLICE", size_)
        monkeypatch.setattr(langid, "LANGUAGES_AT_ONCE", at_once)
        monkeypatch.setattr(langid, "BATCH", 4)
        model = langid.fit(docs)
        assert model.languages == kinds
        for text, (lang, score) in zip(texts, model.predict(texts)):
            logs = {k: math.log(prior[k]) + sum(n * math.log((counts[k][b] + langid.SMOOTHING) / size[k]) for b, n in bag(text).items()) for k in kinds}
            top = max(logs.values())
            assert lang == next(k for k in kinds if logs[k] >= top - 1e-9) and lang != "l1"
            assert abs(score - 1 / sum(math.exp(x - top) for x in logs.values())) < 1e-9
    assert model.predict([None, "", "12 !"]) == [("und", 0.0)] * 3
    with pytest.raises(ValueError):
        langid.fit(docs, most=3)


def test_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = langid.identify(docs).filter("held_out and lang_pred <> 'und'")
    assert held.filter("lang = lang_pred").count() >= 0.97 * held.count() > 0


def test_no_labels(spark, docs):
    assert {r.lang_pred for r in langid.identify(docs.selectExpr("doc_id", "text", "cast(NULL AS string) AS lang")).collect()} == {"und"}


def test_the_number_of_languages_is_a_parameter(spark):
    docs = spark.createDataFrame([(k, "word " * 3 + f"l{k}x", f"l{k}") for k in range(40)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="more than 5"):
        langid.identify(docs, most=5)
    assert langid.identify(docs, most=40).count() == 40 and langid.with_language(docs, most=64).columns == docs.columns
