import hashlib
import random

import numpy as np
import pytest

from ledgerloom.llm import omh


@pytest.mark.parametrize("rows_in_range", [4, 4096])
def test_next_documents(docs, no_docs, rows_in_range, monkeypatch):
    monkeypatch.setattr(omh, "RANGE_ROWS", rows_in_range)
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (-(r[0] if r[0] is not None else -(1 << 62)), r[1]))
    expected = []
    for k, (key, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        third = len(text) // 3
        other = text[: len(text) - third] + after[:third]
        own, changed, following = (omh.fingerprint(omh.points_of(t)) for t in (text, other, after))
        expected.append((str(key), len(text), hashlib.sha256(other.encode()).hexdigest(), omh.written(own), omh.written(changed), omh.likeness(own, changed), omh.likeness(own, following)))
    found = [(str(r[0]), *r[1:]) for r in omh.compare_with_next(docs).collect()]
    assert sorted(found) == sorted(expected)
    assert omh.compare_with_next(no_docs).count() == 0


def test_one_row_is_its_own_next(spark):
    r = omh.compare_with_next(spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")).first()
    assert r.near_next == 1.0 and r.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()


def test_likeness_follows_edits_and_order():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    print_of = lambda w: omh.fingerprint(omh.points_of(" ".join(w)))
    near = lambda w: omh.likeness(print_of(words), print_of(w))
    few = [*words[:200], "zz", *words[201:]]
    many = [w if k % 8 else "zz" for k, w in enumerate(words)]
    moved = words[200:] + words[:200]
    assert near(words) == 1.0 and near(few) > 0.85 > near(many) and near(few) > near(moved) and near(words[::-1]) < 0.2
    assert omh.likeness(print_of(["a"]), print_of(["b"])) < 1 and omh.fingerprint(omh.points_of("")).sum() == 0
    # repeated k-mers are numbered
    assert omh.likeness(omh.fingerprint(omh.points_of("ab" * 20)), omh.fingerprint(omh.points_of("ab" * 400))) < 1
    assert len(np.unique(print_of(words))) > 50


@pytest.mark.parametrize("text", ["ab" * 60, "x", "abcdefghi", "aaaaaaaaaaaaaaaaaaaaa", "the cat and the dog and the cat and the bird " * 5, "日本語の文章。" * 9])
def test_matches_a_plain_version(text):
    points, gram = omh.points_of(text), min(omh.GRAM, len(text))
    one = lambda x: int(omh._mix(np.array([x & (1 << 64) - 1], np.uint64))[0])
    h = [one(sum((int(p) + 1) * pow(int(omh.SEED), k + 1, 1 << 64) for k, p in enumerate(points[i : i + gram]))) for i in range(len(text) - gram + 1)]
    bins, seen = [[] for _ in range(omh.BINS)], {}
    for i, x in enumerate(h):
        seen[x] = seen.get(x, -1) + 1
        key = one(x + seen[x] * int(omh.SEED))
        bins[key >> 58].append((key, i))
    tuples = []
    for members in bins:
        value, places = 0, sorted(i for _, i in sorted(members)[: omh.SMALLEST])
        for k in range(omh.SMALLEST):
            value = one(value * int(omh.SEED) + (h[places[k]] if k < len(places) else 0) + k + 1)
        tuples.append(value if members else None)
    expected = []
    for b in range(omh.BINS):
        far = next(d for d in range(omh.BINS) if tuples[(b + d) % omh.BINS] is not None)
        value = tuples[(b + far) % omh.BINS]
        expected.append((one(value + far) if far else value) >> 48)
    assert omh.fingerprint(points).tolist() == expected


def test_ids_that_are_no_integers_are_refused(spark):
    with pytest.raises(TypeError, match="integer"):
        omh.compare_with_next(spark.createDataFrame([("a", "text")], "doc_id string, text string"))
