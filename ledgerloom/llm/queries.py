"""The corpus queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, forest, langid, lm, omh, packing, periods, preference, rabitq, repeats, simhash, spelling, store
from ledgerloom.workspace import new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]):
    QUERIES[run.__name__] = run
    return run


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op8_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(table(spark, sf_dir, "documents"), words=3, lanes=1, radius=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex(F.col("fp")[0])), 16, "0").alias("fingerprint"), "component_id")


@query
def op3_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_bytes are those of the input. text, after the columns that are fixed, is what is left, by which a removal can be judged."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return repeats.without_repeats(docs, length=400).withColumnRenamed("kept_text", "text")


@query
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file(), capacity=1024, end_id=2)


@query
def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_file())


@query
def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "token-store")
    store.write_store(table(spark, sf_dir, "documents"), tokenizer_file(), folder, end_id=0)
    return store.digests(spark, folder)


@query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.identify(docs).select("doc_id", "held_out", "lang_pred", "score")


@query
def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return omh.compare_with_next(table(spark, sf_dir, "documents"))


@query
def op2_rabitq_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rabitq.near_copies(table(spark, sf_dir, "embeddings"), least=0.9)


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", periods.with_period().alias("text"))
    found = periods.periodic_runs(docs, least=6, times=4)
    # the longest; of those of one length the first, then the one of the smallest period
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    start, length, period = -best["col2"], best["length"], -best["col3"]
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One in 199 of a document's runs, by checksum, loses a code point, so that there are misspellings."""
    runs = spelling.runs_of_letters(table(spark, sf_dir, "documents"), least=6)
    runs = runs.withColumn("h", F.crc32(F.encode(F.concat(F.col("doc_id").cast("string"), F.lit(":"), "run"), "utf-8")))
    place = F.pmod("h", F.char_length("run").cast("long")).cast("int")
    run = F.when(F.pmod("h", F.lit(199)) == 0, F.concat(F.substring("run", F.lit(1), place), F.substr("run", place + 2))).otherwise(F.col("run"))
    return spelling.variants(spelling.counted(runs.select(run.alias("run")), least=6, often=5), times=5)


@query
def op13_hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, n=20)


@query
def op7_preference_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.preference_rows(table(spark, sf_dir, "conversations"))


ORACLES["op7_preference_rows"] = """
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS idx,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
places AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY role, text ORDER BY conv_id) - 1 AS place FROM turns WHERE idx = 0),
sides AS (
  SELECT conv_id, CASE WHEN place % 2 = 0 THEN 'chosen' ELSE 'rejected' END AS side,
         min(conv_id) OVER (PARTITION BY role, text, place // 2) AS pair_id
  FROM places),
paired AS (SELECT s.pair_id, s.side, t.idx, t.role, t.text, '<|' || t.role || '|>' || chr(10) AS head FROM turns t JOIN sides s USING (conv_id)),
shared AS (
  SELECT pair_id, idx, bool_and(n = 2) AS same
  FROM (SELECT pair_id, idx, role, text, count(*) AS n FROM paired GROUP BY ALL) GROUP BY ALL),
common AS (SELECT pair_id, coalesce(min(idx) FILTER (WHERE NOT same), max(idx) + 1) AS n_common FROM shared GROUP BY pair_id),
pieces AS (
  SELECT p.*, c.n_common, p.idx >= c.n_common AS later, head || text || '<|end|>' || chr(10) AS piece FROM paired p JOIN common c USING (pair_id)),
spans AS (
  SELECT *, sum(CASE WHEN later THEN length(piece) ELSE 0 END) OVER (PARTITION BY pair_id, side ORDER BY idx) AS stop FROM pieces)
SELECT pair_id, max(n_common)::BIGINT AS n_common,
  coalesce(string_agg(piece, '' ORDER BY idx) FILTER (WHERE side = 'chosen' AND NOT later), '') AS prompt,
  coalesce(string_agg(piece, '' ORDER BY idx) FILTER (WHERE side = 'chosen' AND later), '') AS chosen,
  coalesce(string_agg(piece, '' ORDER BY idx) FILTER (WHERE side = 'rejected' AND later), '') AS rejected,
  coalesce(string_agg((stop - length(piece) + length(head))::BIGINT || '-' || stop::BIGINT, ',' ORDER BY idx) FILTER (WHERE side = 'chosen' AND later AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg((stop - length(piece) + length(head))::BIGINT || '-' || stop::BIGINT, ',' ORDER BY idx) FILTER (WHERE side = 'rejected' AND later AND role = 'assistant'), '') AS rejected_mask
FROM spans GROUP BY pair_id
"""


@query
def op1_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(table(spark, sf_dir, "documents"), order=3, least=2)


ORACLES["op1_stupid_backoff"] = r"""
WITH listed AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\v\f\r]+') AS w FROM documents),
points AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM listed),
grams AS (SELECT doc_id, i, k, w[i - k + 1 : i] AS gram FROM points, (SELECT unnest(range(1, 4)) AS k) WHERE k <= i),
counts AS (SELECT gram, count(*) AS n FROM grams GROUP BY gram),
total AS (SELECT count(*) AS n FROM points),
ratios AS (
  SELECT g.doc_id, g.i, g.k, c.n, CASE WHEN g.k = 1 THEN c.n / t.n WHEN c.n >= 2 THEN c.n / h.n END AS ratio
  FROM grams g JOIN counts c USING (gram) CROSS JOIN total t LEFT JOIN counts h ON g.k > 1 AND h.gram = g.gram[1 : g.k - 1]),
best AS (
  SELECT doc_id, i, max(k) AS most, max(k) FILTER (WHERE ratio IS NOT NULL) AS k, arg_max(ratio, k) FILTER (WHERE ratio IS NOT NULL) AS ratio
  FROM ratios GROUP BY doc_id, i),
scored AS (
  SELECT doc_id, k < most AS backed, CAST(round_even(ln(CASE most - k WHEN 0 THEN ratio WHEN 1 THEN 0.4::DOUBLE * ratio
    ELSE 0.4::DOUBLE * (0.4::DOUBLE * ratio) END) * 1000000, 0) AS BIGINT) AS micro
  FROM best)
SELECT d.doc_id, count(s.micro) AS n_words, count(*) FILTER (WHERE s.backed) AS n_backed_off, coalesce(sum(s.micro), 0)::BIGINT AS log_score_micro,
  sum(s.micro)::DOUBLE / nullif(count(s.micro), 0) / 1000000 AS score
FROM documents d LEFT JOIN scored s USING (doc_id) GROUP BY d.doc_id
"""
