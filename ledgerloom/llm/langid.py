"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.scratch import Scratch

ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
MAX_LANGUAGES = 512
SMOOTHING = 0.5
UNDECIDED = "und"
SLICE = 1 << 18
BATCH = 32
KEYS_HELD = 1 << 21
LANGUAGES_AT_ONCE = 16
LETTER = regex.compile(r"\p{L}")


def features(texts: list[str]) -> Iterator[np.ndarray]:
    """row * BUCKETS + bucket of the character n-grams of lower-cased texts between two spaces, up to SLICE code points at a time."""
    row = 0
    while row < len(texts):
        # texts that fit into a slice, or slices of one that doesn't; only these are widened to code points
        group, size = [], 0
        while row + len(group) < len(texts) and (not group or size + len(texts[row + len(group)]) < SLICE):
            group.append(f" {texts[row + len(group)].lower()} ")
            size += len(group[-1])
        for at in range(0, max(1, size), SLICE) if len(group) == 1 else [0]:
            parts = [group[0][at : at + SLICE + ORDERS[-1] - 1]] if len(group) == 1 else group
            points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
            of = np.repeat(np.arange(row, row + len(parts)), list(map(len, parts)))
            for order in ORDERS:
                n = min(len(points) - order + 1, SLICE if len(parts) == 1 else len(points))
                if n > 0:
                    h = np.full(n, order, np.uint64)
                    for k in range(order):
                        h = (h ^ points[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
                        h ^= h >> np.uint64(32)
                    within = of[:n] == of[order - 1 : order - 1 + n]
                    yield of[:n][within] * BUCKETS + (h[within] % np.uint64(BUCKETS)).astype(np.int64)
        row += len(group)


def counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A sparse matrix of texts and buckets: where each text's entries begin, their buckets, and how often each comes."""
    seen, held, size = 0, [], 0
    for keys in features(texts):
        held.append(keys)
        size += len(keys)
        if size > KEYS_HELD:
            seen, held, size = seen + np.bincount(np.concatenate(held), minlength=len(texts) * BUCKETS), [], 0
    seen = seen + np.bincount(np.concatenate([np.zeros(0, np.int64), *held]), minlength=len(texts) * BUCKETS)
    used = np.flatnonzero(seen)
    return np.searchsorted(used, np.arange(len(texts)) * BUCKETS), used % BUCKETS, seen[used]


def _counted(most: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, own in batch.groupby("lang")["text"]:
                total = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for keys in features([t or "" for t in own]):
                    total += np.bincount(keys % BUCKETS, minlength=BUCKETS)
            if len(counts) > most:
                raise ValueError(f"more than {most} languages")
        for lang, total in counts.items():
            used = np.flatnonzero(total)
            yield pd.DataFrame({"lang": lang, "bucket": used, "n": total[used]})

    return run


class Model:
    """Languages in alphabetical order, their log priors, and log probabilities by bucket and language."""

    def __init__(self, languages: list[str], prior: np.ndarray, matrix: np.ndarray):
        self.languages, self.prior, self.matrix = languages, prior, matrix

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The likeliest language of each text (the first of ties) and its posterior probability; und and 0 without a letter or languages."""
        out = [(UNDECIDED, 0.0)] * len(texts)
        some = [k for k, t in enumerate(texts) if self.languages and t is not None and LETTER.search(t)]
        for at in range(0, len(some), BATCH):
            own = some[at : at + BATCH]
            total = self.scores([texts[k] for k in own])
            best = total.argmax(1)
            sure = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
            for k, b, p in zip(own, best.tolist(), sure.tolist()):
                out[k] = (self.languages[b], p)
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        """Log joint probabilities of texts that aren't empty, by language: counts of a batch times the matrix."""
        starts, buckets, counts = counted(texts)
        total = np.empty((len(texts), len(self.languages)))
        for k in range(0, len(self.languages), LANGUAGES_AT_ONCE):
            part = slice(k, k + LANGUAGES_AT_ONCE)
            total[:, part] = np.add.reduceat(counts[:, None] * self.matrix[buckets, part], starts) + self.prior[part]
        return total


def fit(labelled: DataFrame, most: int = MAX_LANGUAGES) -> Model:
    """Learn from all rows of labelled (text, lang, ...) with a lang; null texts count as empty, repeated rows count each. No rows give a model that is always undecided.

    What the driver gets is bounded: BUCKETS counts for each of at most `most` languages; more than that raise an error.
    """
    scratch = Scratch(labelled.sparkSession)
    labelled = labelled.filter("lang is not null").select("lang", "text")
    sizes = {r[0]: r[1] for r in labelled.groupBy("lang").count().limit(most + 1).collect()}
    if len(sizes) > most:
        raise ValueError(f"more than {most} languages")
    parts = labelled.mapInPandas(_counted(most), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    parts = scratch.keep(parts, "counts")
    counts = parts.toPandas()
    scratch.drop(parts)
    languages = sorted(sizes)
    matrix = np.full((BUCKETS, len(languages)), SMOOTHING)
    for k, lang in enumerate(languages):
        own = counts[counts["lang"] == lang]
        matrix[own["bucket"].to_numpy(), k] += own["n"].to_numpy()
    total = np.array([sizes[x] for x in languages], float)
    return Model(languages, np.log(total / max(total.sum(), 1)), np.log(matrix / matrix.sum(0)))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs (text, ...) with lang_pred and score; columns of these names are replaced, all others stay and are not looked at.

    The model is broadcast: BUCKETS doubles for each language, which fit() bounds. Texts that are null or have no letter are und, score 0.
    """
    docs = docs.drop("lang_pred", "score")
    sent = docs.sparkSession.sparkContext.broadcast((model.languages, model.prior, model.matrix))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Model(*sent.value)
        for batch in batches:
            found = own.predict(batch["text"].tolist())
            yield batch.assign(lang_pred=[x[0] for x in found], score=[x[1] for x in found])

    return docs.mapInPandas(run, T.StructType([*docs.schema, *T.StructType.fromDDL("lang_pred string, score double")]))


def held_out(doc_id: str = "doc_id"):
    """True for the fifth of documents that is not learned from; a null id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def identify(docs: DataFrame, most: int = MAX_LANGUAGES) -> DataFrame:
    """docs (doc_id, text, lang, ...) with held_out, lang_pred and score; learned from rows that are not held out and have a lang, of `most` languages at most (see fit())."""
    docs = docs.drop("held_out").withColumn("held_out", held_out())
    return predict(docs, fit(docs.filter("not held_out"), most))


def with_language(docs: DataFrame, most: int = MAX_LANGUAGES) -> DataFrame:
    """The rows of docs whose text has a language: a letter, and a score of at least a half for some learned language, of which there are `most` at most."""
    own = {c: f"{c} of the input" for c in ("held_out", "lang_pred", "score") if c in docs.columns}
    found = identify(docs.withColumnsRenamed(own), most).filter(F.col("score") >= 0.5)
    return found.select(*(F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns))
