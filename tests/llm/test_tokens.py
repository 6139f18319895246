"""Encoding, packing and the store against the tokenizers library."""

import bisect
import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerloom.llm import bpe, packing, store
from ledgerloom.llm.queries import tokenizer_file
from ledgerloom.llm.scratch import Scratch
from ledgerloom.workspace import new_path

PATH = tokenizer_file()


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([*"abzZ019 .,'!|<>\n\t\r\0éàß　\u2028\u0085\u00a0日", "'s", "<|endoftext|>", "  ", "\n\n", " the", "ing"]), max_size=60).map("".join))
def test_fragments_encode_like_the_whole(text):
    encoder = bpe.encoder(PATH)
    whole = encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == whole
    assert encoder.decode(np.array(whole, "<u4")) == encoder.tokenizer.decode(whole, skip_special_tokens=False)


def test_very_long_texts(monkeypatch, tokenizer):
    """Slices of one text, with and without cuts, with bytes that are encoded as a whole, and longer than a group."""
    monkeypatch.setattr(bpe, "GROUP_CHARS", 200)
    rng = random.Random(2)
    prose = "".join(rng.choice(["the ", "ing", " éu", "ß. ", "12", ", it's ", "\n\n  ", "日本"]) for _ in range(4000))
    texts = [prose, "a" * 5000, prose + "\0" + prose, prose + "<|endoftext|>" + prose, "短い", "é" * 3000 + prose[:600], None]
    encoder = bpe.Encoder(PATH)
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [ids_of(tokenizer, t) for t in texts]


def test_digests(docs, no_docs, tokenizer):
    for r, d in zip(*(sorted(df.collect(), key=lambda r: (str(r.doc_id), r.n_tokens if "n_tokens" in r else 0)) for df in (bpe.digests(docs, PATH), docs))):
        ids = ids_of(tokenizer, d.text)
        assert (r.doc_id, r.n_tokens, r.ids_sha256) == (d.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = {r.doc_id: r.text for r in bpe.decoded(bpe.encoded(docs, PATH), PATH).collect()}
    assert all(back[d.doc_id] == (d.text or "") for d in docs.collect())
    assert bpe.digests(no_docs, PATH).count() == 0


def test_encoder_forgets_nothing_it_needs(monkeypatch, tokenizer):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    encoder = bpe.Encoder(PATH)
    texts = ["one two three, four five", "six seven eight", "one nine ten"] * 200
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [ids_of(tokenizer, t) for t in texts]


@pytest.mark.parametrize("capacity", [64, 1024])
def test_packing(docs, tokenizer, capacity):
    found = packing.pack_documents(docs.withColumnRenamed("source", "size"), PATH, capacity, 2).collect()
    by_doc, by_sequence = {}, {}
    for r in found:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    repeated = {r.doc_id for r in docs.groupBy("doc_id").count().filter("count > 1").collect()}
    for d in docs.collect():
        ids, at = [*ids_of(tokenizer, d.text), 2], 0
        if d.doc_id in repeated:
            continue
        pieces = sorted(by_doc[d.doc_id], key=lambda r: r.piece)
        for k, r in enumerate(pieces):
            assert (r.piece, r.start) == (k, at) and (r.length == capacity or k == 0)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids) and (len(pieces) == 1 or len(ids) > capacity)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    gaps = []
    for length in sorted((r.length for r in found), reverse=True):  # best-fit decreasing, one after the other
        at = bisect.bisect_left(gaps, length)
        bisect.insort(gaps, (gaps.pop(at) if at < len(gaps) else capacity) - length)
    assert len(by_sequence) <= 1.02 * len(gaps) + 1


def test_sweep_takes_the_longest_that_fits(spark, monkeypatch):
    """Against a stack: from the smallest slot on, each takes the longest piece left that fits it."""
    monkeypatch.setattr(packing, "ROWS_AT_ONCE", 40)
    rng = np.random.default_rng(3)
    lengths, rooms, slots = rng.integers(1, 40, 150).tolist(), rng.integers(1, 90, 60).tolist(), rng.integers(1, 4, 60).tolist()
    pieces = spark.createDataFrame(list(enumerate(lengths)), "pid long, length long")
    gaps = spark.createDataFrame([(k, g, s) for k, (g, s) in enumerate(zip(rooms, slots))], "sequence_id long, gap long, slots long")
    found = {r.pid: (r.sequence_id, r.slot) for r in packing._swept(pieces, gaps, 210, Scratch(spark)).collect() if r.sequence_id is not None}
    events = sorted([(n, 0, k, 1) for k, n in enumerate(lengths)] + [(g // s, 1, k, s) for k, (g, s) in enumerate(zip(rooms, slots))])
    stack, due = [], {}
    for _, kind, key, n in events:
        if kind == 0:
            stack.append(key)
        else:
            due |= {stack.pop(): (key, slot) for slot in range(min(n, len(stack)))}
    assert found == due


def test_packing_of_nothing(no_docs):
    assert packing.pack_documents(no_docs, PATH).count() == 0


def test_store(spark, docs, no_docs, tokenizer):
    folder = new_path(spark, "store")
    store.write_store(docs.withColumnsRenamed({"source": "row", "n_chars": "addresses"}), PATH, folder, end_id=0, mean=8, most=32)
    rows = sorted(store.digests(spark, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((d.doc_id for d in docs.collect()), key=lambda k: (k is not None, k))
    text_of, at = {d.doc_id: d.text for d in docs.collect()}, 0
    whole = {r.start: r.ids for r in store.documents(spark, folder).collect()}
    for r in rows:
        ids = np.array([*ids_of(tokenizer, text_of[r.doc_id]), 0], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        assert bytes(whole[at]) == ids.tobytes()
        at += len(ids)
    chunks, recipes = (spark.read.parquet(f"{folder}/{t}") for t in ("chunks", "recipes"))
    assert chunks.count() == chunks.select("address").distinct().count() < recipes.count()
    empty = new_path(spark, "store")
    store.write_store(no_docs, PATH, empty)
    assert store.digests(spark, empty).count() == 0


def test_store_finds_damage(spark, docs):
    folder, broken = new_path(spark, "store"), new_path(spark, "store")
    store.write_store(docs, PATH, folder)
    for name in ("recipes", "manifest", "chunks"):
        table = spark.read.parquet(f"{folder}/{name}")
        if name == "chunks":
            first = bytes(table.agg({"address": "min"}).first()[0]).hex()
            table = table.selectExpr("address", "n", "width", f"IF(address = unhex('{first}'), cast(rpad('', n * width, 'x') AS binary), data) AS data")
        table.write.parquet(f"{broken}/{name}")
    with pytest.raises(Exception, match="does not have its address"):
        store.digests(spark, broken).collect()


def test_checksums_of_parts():
    parts = [b"abc", b"", b"x" * 5000, b"yz"]
    after = np.cumsum([len(p) for p in parts][::-1])[::-1] - [len(p) for p in parts]
    moved = store.moved_crc(np.array([zlib.crc32(p) for p in parts], np.uint64), after.astype(np.uint64))
    assert int(np.bitwise_xor.reduce(moved)) == zlib.crc32(b"".join(parts))
