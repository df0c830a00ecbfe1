"""One registered query per operator, each over its whole tables, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.llm import (
    audit,
    bpe,
    cotrain,
    fmindex,
    hilbert,
    jaccard,
    lm,
    mixing,
    neighbours,
    ordinal,
    surrogates,
    warc,
    whitening,
)

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    def wrap(plan):
        QUERIES[name] = (plan, sql)
        return plan

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op4_hilbert_sharding")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = hilbert.shard_documents(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "curve",
    )


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source,
    CASE WHEN text IS NULL THEN 0
      ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size
  FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, 1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS weight FROM sums),
steps AS (
  SELECT *,
    sum(3 * source_size) OVER (ORDER BY 3.0 * source_size / weight, source
      ROWS UNBOUNDED PRECEDING) - 3 * source_size AS held,
    sum(weight) OVER (ORDER BY 3.0 * source_size / weight, source
      ROWS UNBOUNDED PRECEDING) - weight AS held_weight,
    row_number() OVER (ORDER BY 3.0 * source_size / weight, source) AS place,
    sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weight
  FROM weighed),
level AS (
  SELECT (total - held)::BIGINT AS left_over, (all_weight - held_weight)::BIGINT AS free FROM steps
  WHERE 3 * source_size * (all_weight - held_weight) >= (total - held) * weight
  ORDER BY place LIMIT 1),
targets AS (
  SELECT source, source_size,
    least(CAST(left_over * weight AS DOUBLE) / CAST(free AS DOUBLE),
      CAST(3 * source_size AS DOUBLE)) AS target
  FROM steps, level),
rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 1.0::DOUBLE END AS rate
  FROM targets)
SELECT doc_id, size, source_size, target,
  (size * (floor(rate) + CASE WHEN
     CAST(('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT AS DOUBLE)
       / 4503599627370496.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized JOIN rates ON sized.source IS NOT DISTINCT FROM rates.source"""


@query("op5_source_mixing", MIX_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix_plan(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


LEAK_SQL = r"""
WITH dw AS (
  SELECT row_id, doc_id, words FROM (
    SELECT row_number() OVER () AS row_id, doc_id,
      regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM documents)),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark),
phrases AS (
  SELECT DISTINCT item_id, least(10, len(words)) AS size,
    array_to_string(list_slice(words, pos, pos + 9), ' ') AS phrase
  FROM (SELECT *, unnest(range(1, greatest(1, len(words) - 9) + 1)) AS pos FROM bw
    WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT size FROM phrases),
stretches AS (
  SELECT row_id, pos, size, array_to_string(list_slice(words, pos, pos + size - 1), ' ') AS phrase
  FROM (SELECT row_id, words, size, unnest(range(1, len(words) - size + 2)) AS pos
    FROM dw, sizes WHERE len(words) >= size)),
found AS (
  SELECT s.row_id, s.pos, s.size, p.item_id FROM stretches s JOIN phrases p
    ON s.phrase = p.phrase AND s.size = p.size),
hits AS (
  SELECT row_id, count(DISTINCT word) AS n_hit
  FROM (SELECT row_id, unnest(range(pos, pos + size)) AS word FROM found) GROUP BY row_id),
named AS (
  SELECT row_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT row_id, item_id::VARCHAR AS item FROM found WHERE item_id IS NOT NULL)
  GROUP BY row_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hits USING (row_id) LEFT JOIN named USING (row_id)"""


@query("op10_fm_decontamination", LEAK_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fmindex.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end_word"] - s["first_word"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


JACCARD_SQL = r"""
WITH RECURSIVE dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(words, pos, pos + 3), ' ') AS shingle
  FROM (SELECT *, unnest(range(1, greatest(1, len(words) - 3) + 1)) AS pos FROM dw
    WHERE len(words) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * common >= 85 * (x.n + y.n - common)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS start, doc_id AS stop FROM documents
  UNION SELECT start, b FROM reach JOIN edges ON a = stop)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, r.component_id
FROM documents d LEFT JOIN sizes USING (doc_id)
JOIN (SELECT start AS doc_id, min(stop) AS component_id FROM reach GROUP BY start) r USING (doc_id)"""


@query("op6_jaccard_join", JACCARD_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


@query("op9_gru_scoring")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


@query("op2_cotraining_quality")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotrain.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_ordinal_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return ordinal.score(docs, ordinal.train(docs, table(spark, sf_dir, "labels")))


@query("op1_warc_derivatives")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.responses(table(spark, sf_dir, "pages")))


#: A key of the caller's own in production; a fixed one here, so that reruns agree.
SURROGATE_KEY = b"example key, to be replaced"


@query("op7_pii_surrogates")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = surrogates.replace(table(spark, sf_dir, "documents").select("doc_id", "text"), SURROGATE_KEY)
    return found.select("doc_id", "text", "n_entities", "kinds")


@query("op3_learned_partitions")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"))


@query("op11_exact_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_components(table(spark, sf_dir, "embeddings"))


@query("op12_byte_bpe")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


AUDIT_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
least_ids AS (SELECT text, min(doc_id) AS low FROM words GROUP BY text),
named AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
    max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
fails AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(named.toxic, 0) AS toxic,
    len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
    100 * len(regexp_replace(words.text, '[^A-Z]', '', 'g')) > 3 * len(words.text) AS c,
    regexp_matches(words.text, '[#$%&*|]') AS d, coalesce(words.doc_id > low, false) AS e
  FROM words JOIN least_ids USING (text) LEFT JOIN named ON words.doc_id = named.doc_id),
masks AS (
  SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask,
    count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM fails GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
  SELECT v.l || w.l || x.l || y.l || z.l AS filter_order,
    [v.bit, w.bit, x.bit, y.bit, z.bit] AS bits
  FROM letters v, letters w, letters x, letters y, letters z
  WHERE v.bit + w.bit + x.bit + y.bit + z.bit = 31
    AND v.bit | w.bit | x.bit | y.bit | z.bit = 31),
steps AS (
  SELECT filter_order, step::INT AS step, bits[step] AS own,
    coalesce(list_sum(list_slice(bits, 1, step - 1)), 0)::INT AS earlier
  FROM orders, range(1, 6) r(step)),
counted AS (
  SELECT part, filter_order, step, own,
    sum(CASE WHEN mask & (own | earlier) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN mask & own > 0 AND mask & earlier = 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN mask & own > 0 AND mask & earlier > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN mask = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN mask & own > 0 AND mask & earlier = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN mask & own > 0 AND mask & earlier = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM masks, steps GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM counted"""


@query("op13_filter_audit", AUDIT_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = audit.read_stream(spark, f"{sf_dir}/documents.parquet")
    return audit.audit(docs, table(spark, sf_dir, "labels"))
