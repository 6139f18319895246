"""Byte-level BPE of whole texts, cut beforehand where no token can reach across.

A pair of bytes that comes inside no token of the vocabulary marks a forced boundary: no merge can join its two bytes.
A text is cut there if the pre-tokenizer has a boundary at that place in any case, the fragments are encoded on their
own, each distinct one once while it is remembered, and their ids are concatenated.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer

REMEMBERED = 1_000_000
SLOTS = 1 << 21
GROUP_CHARS = 1 << 20
NEVER = np.iinfo(np.int32).max
# fragments that the merges here take on: of white space, ASCII and Latin letters alone, whose classes no table disputes
LATIN = re.compile(rb"(?:[\t\n\r -~]|[\xc3-\xc9][\x80-\xbf])+").fullmatch
WORD = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+").fullmatch
# Fixed value: the pattern of the byte-level pre-tokenizer.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
# next to last bytes of the white space beyond ASCII: U+0085, U+00A0, U+1680, U+2000 to U+205F and U+3000
SPACE_LEADS = np.isin(np.arange(256), [0xC2, 0x9A, 0x80, 0x81])


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, the rest from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


class Merges:
    """The merges of a vocabulary, carried out on many pieces at once."""

    def __init__(self, byte_ids: np.ndarray, rules: list[tuple[int, int, int]]):
        """rules: (left id, right id, merged id) by rank."""
        self.byte_ids = byte_ids
        left, right, new = (np.array(x, np.int64) for x in zip(*rules))
        self.bits = max(4, (4 * len(rules)).bit_length())
        self.keys, self.rank = np.full(1 << self.bits, -1), np.full(1 << self.bits, NEVER, np.int32)
        self.new = new.astype(np.int32)
        keys, todo = left << 32 | right, np.arange(len(rules))
        at = self._slots(keys)
        while len(todo):  # of those that want a free slot the last one has it, the others go on
            free = todo[self.keys[at[todo]] < 0]
            self.keys[at[free]] = keys[free]
            todo = todo[self.keys[at[todo]] != keys[todo]]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
        self.rank[at] = np.arange(len(rules))

    @staticmethod
    def in_order(rules: list[tuple[int, int, int]]) -> bool:
        """Whether no merge makes a pair of a lower rank than its own, so that all pairs of the lowest rank can be merged at once."""
        made: dict[int, int] = {}
        for rank, (_, _, new) in enumerate(rules):
            made[new] = rank
        return all(max(made.get(a, -1), made.get(b, -1)) < rank for rank, (a, b, _) in enumerate(rules))

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        at = self._slots(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.rank[at], NEVER)
        todo = np.flatnonzero((found != keys) & (found >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.rank[at[todo[hit]]]
            todo = todo[~hit & (found >= 0)]
        return out

    def apply(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that aren't empty, one after the other, and how many each has. In each turn every piece merges its pairs of the lowest rank."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)].astype(np.int64)
        piece, done = np.repeat(np.arange(len(pieces)), sizes), []
        ranks = np.full(len(ids), NEVER, np.int32)
        inner = np.flatnonzero(piece[1:] == piece[:-1])
        ranks[inner] = self._ranks(ids[inner], ids[inner + 1])
        while len(ids):
            first = np.append(True, piece[1:] != piece[:-1])
            starts = np.flatnonzero(first)
            lowest = np.minimum.reduceat(ranks, starts)
            own = np.cumsum(first) - 1
            ended = (lowest == NEVER)[own]
            if ended.any():
                done.append((piece[ended], ids[ended]))
                keep = ~ended
                ids, piece, ranks, own = ids[keep], piece[keep], ranks[keep], own[keep]
                if not len(ids):
                    break
            at = np.flatnonzero(ranks == lowest[own])
            run = np.flatnonzero(np.append(True, np.diff(at) != 1))  # of overlapping pairs every other one
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0]
            ids[at] = self.new[ranks[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            changed = np.zeros(len(ids), bool)
            changed[at] = True
            before = at[at > 0] - 1
            before = np.where(keep[before], before, before - 1)  # a pair that ended there was merged as well
            changed[before] = True
            ids, piece, ranks, changed = ids[keep], piece[keep], ranks[keep], np.flatnonzero(changed[keep])
            ranks[changed] = NEVER
            changed = changed[changed + 1 < len(ids)]
            changed = changed[piece[changed] == piece[changed + 1]]
            ranks[changed] = self._ranks(ids[changed], ids[changed + 1])
        if not done:
            return np.zeros(0, np.uint32), np.zeros(len(pieces), np.int64)
        piece, ids = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(piece, kind="stable")
        return ids[order].astype(np.uint32), np.bincount(piece, minlength=len(pieces))


class Memory:
    """Ids of fragments. Those of up to 16 bytes are found by their bytes, as two integers; longer ones in a dictionary. Place 0 is the empty fragment."""

    def __init__(self):
        self.low, self.high, self.slot = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.uint64), np.full(SLOTS, -1, np.int32)
        self.long: dict[bytes, int] = {}
        self.ids, self.edges, self.n = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), 1

    def _slots(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        h = low * np.uint64(0x9E3779B97F4A7C15) ^ high * np.uint64(0xC2B2AE3D27D4EB4F)
        return ((h ^ h >> np.uint64(29)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Places of short fragments, -1 where unknown."""
        at = self._slots(low, high)
        out = self.slot[at]
        todo = np.flatnonzero((out >= 0) & ((self.low[at] != low) | (self.high[at] != high)))
        while len(todo):
            at[todo] = (at[todo] + 1) & (SLOTS - 1)
            out[todo] = self.slot[at[todo]]
            todo = todo[(out[todo] >= 0) & ((self.low[at[todo]] != low[todo]) | (self.high[at[todo]] != high[todo]))]
        return out

    def hold(self, ids: np.ndarray, counts: np.ndarray) -> int:
        """Append the ids of fragments, so many each, and return the place of the first one."""
        first, at = self.n, int(self.edges[self.n])
        self.n += len(counts)
        while self.n >= len(self.edges):
            self.edges = np.append(self.edges, np.zeros_like(self.edges))
        while at + len(ids) > len(self.ids):
            self.ids = np.append(self.ids, np.zeros_like(self.ids))
        self.ids[at : at + len(ids)] = ids
        self.edges[first + 1 : self.n + 1] = at + np.cumsum(counts)
        return first

    def remember(self, low: np.ndarray, high: np.ndarray, place: np.ndarray) -> None:
        """Short fragments that aren't there yet, each once."""
        at, todo = self._slots(low, high), np.arange(len(place))
        while len(todo):  # of those that want a free slot the last one has it, the others go on
            free = todo[self.slot[at[todo]] < 0]
            self.slot[at[free]] = place[free]
            won = self.slot[at[todo]] == place[todo]
            own, todo = todo[won], todo[~won]
            self.low[at[own]], self.high[at[own]] = low[own], high[own]
            at[todo] = (at[todo] + 1) & (SLOTS - 1)


class Encoder:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        split = model["pre_tokenizer"] or {}
        if model["model"]["type"] != "BPE" or model["normalizer"] or (split.get("type"), split.get("use_regex"), split.get("add_prefix_space")) != ("ByteLevel", True, False):
            raise ValueError("a byte-level BPE without normalizer or prefix space is needed")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = {t["content"]: t["id"] for t in model["added_tokens"]}
        letters = _byte_letters()
        plain = {i: bytes(letters[c] for c in t) for t, i in model["model"]["vocab"].items() if t not in self.added}
        self.bytes_of = plain | {i: t.encode() for t, i in self.added.items()}
        self.decimal = {i: str(i).encode() for i in self.bytes_of}
        self.merges = self._merges(model["model"], letters)
        self.cuts = self._forced(plain.values())
        # a zero byte stands between texts there
        self.inner_cuts = self.cuts.reshape(256, 256).copy()
        self.inner_cuts[0, :] = self.inner_cuts[:, 0] = 0
        self.inner_cuts = self.inner_cuts.reshape(-1)
        self.memory = Memory()

    @staticmethod
    def _merges(model: dict, letters: dict[str, int]) -> Merges | None:
        """None for models whose merges cannot be carried out by rank alone; the library encodes all of their fragments."""
        vocab, rules = model["vocab"], []
        if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")) or any(c not in vocab for c in letters):
            return None
        for rule in model["merges"]:
            a, b = rule.split(" ") if isinstance(rule, str) else rule
            rules.append((vocab[a], vocab[b], vocab[a + b]))
        if not rules or not Merges.in_order(rules):
            return None
        byte_ids = np.zeros(256, np.int64)
        for letter, byte in letters.items():
            byte_ids[byte] = vocab[letter]
        return Merges(byte_ids, rules)

    @staticmethod
    def _forced(tokens) -> np.ndarray:
        """By pair of bytes: 1 where a text may be cut, 2 where it may unless the first byte ends a white space."""
        inside = np.zeros((256, 256), bool)
        for t in tokens:
            v = np.frombuffer(t, np.uint8)
            inside[v[:-1], v[1:]] = True
        kind = np.full(256, 3)  # of ASCII: 0 white space, 1 letters, 2 digits, 3 others
        kind[[9, 10, 11, 12, 13, 32]] = 0
        kind[48:58] = 2
        kind[[*range(65, 91), *range(97, 123)]] = 1
        kind[128:] = 4
        change = (kind[:, None] != kind[None, :]) & (kind[:, None] > 0) & (kind[:, None] < 4) & (kind[None, :] < 4)
        out = (change & ~inside).astype(np.uint8)
        for y in (10, 32):
            out[128:192, y] = 2 * ~inside[128:192, y]
        return out.reshape(-1)

    def _cut(self, v: np.ndarray, inner: np.ndarray) -> np.ndarray:
        """Whether a text may be cut after each of its bytes but the last."""
        kind = inner[(v[:-1].astype(np.uint16) << 8) | v[1:]]
        cut = kind == 1
        maybe = np.flatnonzero(kind == 2)
        cut[maybe[(maybe > 0) & ~SPACE_LEADS[v[maybe - 1]]]] = True
        return cut

    def fragments(self, raw: bytes) -> list[bytes]:
        if len(raw) < 2:
            return [raw] if raw else []
        edges = [0, *(np.flatnonzero(self._cut(np.frombuffer(raw, np.uint8), self.cuts)) + 1).tolist(), len(raw)]
        return [raw[a:b] for a, b in zip(edges, edges[1:])]

    def _learn(self, fragments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of fragments, one after the other, and how many each has: by the merges here or by the library."""
        own, counts = np.full(len(fragments), self.merges is not None), np.zeros(len(fragments), np.int64)
        pieces, n_pieces = [], []
        for k, f in enumerate(fragments if self.merges else []):
            if WORD(f):
                pieces.append(f)
                n_pieces.append(1)
            elif LATIN(f):
                found = [x.encode() for x in PIECES(f.decode())]
                pieces += found
                n_pieces.append(len(found))
            else:
                own[k] = False
        merged, n = self.merges.apply(pieces) if pieces else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        counts[own] = np.add.reduceat(n, np.cumsum([0, *n_pieces[:-1]])) if n_pieces else 0
        others = [f.decode() for f, mine in zip(fragments, own.tolist()) if not mine]
        if not others:
            return merged, counts
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(others, add_special_tokens=False)]
        counts[~own] = list(map(len, ids))
        out, mine = np.zeros(counts.sum(), np.uint32), np.repeat(own, counts)
        out[mine] = merged
        out[~mine] = [x for e in ids for x in e]
        return out, counts

    def _encode(self, texts: list[str]) -> list[bytes]:
        raws = [t.encode() for t in texts]
        whole = [b"\0" in r or any(a in t for a in self.added) for r, t in zip(raws, texts)]
        # a zero byte stands between texts, and some more at the end
        joined = b"\0".join(b"" if w else r for r, w in zip(raws, whole))
        n, v = len(joined), np.frombuffer(joined + bytes(16), np.uint8)
        cuts = np.flatnonzero(self._cut(v[:n], self.inner_cuts)) + 1 if n > 1 else np.zeros(0, np.int64)
        zeros = np.flatnonzero(v[:n] == 0)
        starts, ends = np.sort(np.concatenate([[0], cuts, zeros + 1])), np.sort(np.concatenate([cuts, zeros, [n]]))
        size = ends - starts

        eight = np.ndarray(n + 9, "<u8", v.tobytes(), strides=(1,))
        mask = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
        low, high = eight[starts] & mask[np.minimum(size, 8)], eight[np.minimum(starts + 8, n + 8)] & mask[np.clip(size - 8, 0, 8)]
        memory, place = self.memory, np.zeros(len(starts), np.int32)
        short = np.flatnonzero((size > 0) & (size <= 16))
        place[short] = memory.find(low[short], high[short])
        long = np.flatnonzero(size > 16)
        place[long] = [memory.long.get(joined[a:b], -1) for a, b in zip(starts[long].tolist(), ends[long].tolist())]
        kept = memory.n
        missing = np.flatnonzero(place < 0)
        if len(missing):
            names = [joined[a:b] for a, b in zip(starts[missing].tolist(), ends[missing].tolist())]
            first = dict(zip(reversed(names), reversed(missing.tolist())))
            new, at = list(first), np.fromiter(first.values(), np.int64, len(first))
            begin = memory.hold(*self._learn(new))
            own = dict(zip(new, range(begin, memory.n)))
            place[missing] = list(map(own.get, names))
            # those met first are the most frequent ones, so they stay
            if kept + len(new) < REMEMBERED:
                kept, few = memory.n, size[at] <= 16
                memory.remember(low[at[few]], high[at[few]], place[at[few]])
                memory.long |= {f: own[f] for f, s in zip(new, few.tolist()) if not s}
        count = memory.edges[place + 1] - memory.edges[place]
        stops = np.cumsum(count)
        ids = memory.ids[np.repeat(memory.edges[place] - stops + count, count) + np.arange(stops[-1])]
        memory.n = kept
        edges = np.append(0, stops)[np.searchsorted(starts, np.concatenate([[0], zeros + 1, [n + 1]]))].tolist()
        return [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() if w else ids[a:b].tobytes() for t, w, a, b in zip(texts, whole, edges, edges[1:])]

    def _slices(self, text: str) -> list[str]:
        """A very long text in slices that end at certain cuts; none if the library has to encode it as a whole."""
        raw, out, at, size = text.encode(), [], 0, GROUP_CHARS
        if b"\0" in raw or any(a in text for a in self.added):
            return []
        while at < len(raw):
            part = raw[at : at + size]
            cuts = np.flatnonzero(self._cut(np.frombuffer(part, np.uint8), self.cuts)) if at + size < len(raw) else [len(part) - 1]
            if not len(cuts):
                size *= 2  # no cut in the slice
                continue
            out.append(part[: cuts[-1] + 1].decode())
            at, size = at + int(cuts[-1]) + 1, GROUP_CHARS
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; null counts as empty."""
        out, some, size = [], [], 0
        for text in texts:
            if len(text or "") > 2 * GROUP_CHARS and (slices := self._slices(text)):
                out += self._encode(some) if some else []
                out.append(b"".join(self._encode([x])[0] for x in slices))
                some, size = [], 0
                continue
            some.append(text or "")
            size += len(some[-1])
            if size > GROUP_CHARS:
                out += self._encode(some)
                some, size = [], 0
        return out + (self._encode(some) if some else [])

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, added tokens as they are written; ids without a token give nothing."""
        return b"".join(map(self.bytes_of.get, ids.tolist(), [b""] * len(ids))).decode(errors="replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each file in a worker, with what it remembers."""
    return Encoder(path)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of docs (doc_id, text, ...); ids hold little-endian unsigned 32-bit integers.

    Null texts count as empty and give no ids. Repeated rows are encoded each; an empty table gives none.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = encoder(path).encode(batch["text"].tolist())
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": [len(x) // 4 for x in ids], "ids": ids})

    schema = T.StructType([docs.select("doc_id").schema[0], *T.StructType.fromDDL("n_tokens long, ids binary")])
    return docs.select("doc_id", "text").mapInPandas(run, schema)


def decoded(tokens: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of tokens (doc_id, ids, ...), special tokens kept; null ids give null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [None if x is None else encoder(path).decode(np.frombuffer(x, "<u4")) for x in batch["ids"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": texts})

    schema = T.StructType([tokens.select("doc_id").schema[0], T.StructField("text", T.StringType())])
    return tokens.select("doc_id", "ids").mapInPandas(run, schema)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encoded() and decoded() in one pass, for comparing without moving ids.

    ids_sha256 is of the decimal ids joined by commas. Nulls, repeats and empty tables as in encoded().
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            e, rows = encoder(path), []
            for data in e.encode(batch["text"].tolist()):
                ids = np.frombuffer(data, "<u4")
                listed = b",".join(map(e.decimal.__getitem__, ids.tolist()))
                rows.append((len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256(e.decode(ids).encode()).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"]).assign(doc_id=batch["doc_id"].to_numpy())

    schema = T.StructType([*T.StructType.fromDDL("n_tokens long, ids_sha256 string, decoded_sha256 string"), docs.select("doc_id").schema[0]])
    return docs.select("doc_id", "text").mapInPandas(run, schema).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
