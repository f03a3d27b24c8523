"""The operators applied to the given tables, with equivalent SQL where there is one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from loamframe.llm import (
    common, common_lines, decontaminate, licence_templates, license_scan, pieces, rule_lists, sharding, simhash, spelling,
    substring_dedup, token_counts, token_store, vector_codes, warc)

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents encoded, written as seekable zstandard files and read back."""
    folder = common.new_folder(spark, "tokens")
    index = token_store.write_token_store(
        read(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_store.read_token_store(index)


@query()
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in 16 shards of near equal bytes, written and read back."""
    folder = common.new_folder(spark, "shards")
    written = sharding.write_shards(read(spark, sf_dir, "documents"), folder, 16)
    return written.select(
        "doc_id", "size", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query()
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    counted = token_counts.count_tokens(
        read(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


@query()
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document, those inside repeated windows of 35, and a digest of the rest."""
    out = substring_dedup.remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


_PASSAGES = r"""
WITH words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
items AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
grams AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, (SELECT DISTINCT n FROM wins) WHERE len(w) >= n)),
hits AS (SELECT g.doc_id, g.i, g.n, w.item_id FROM grams g JOIN wins w ON g.n = w.n AND g.win = w.win),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id)), ',') AS ids FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""


@query(_PASSAGES)
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside occurrences of benchmark windows, and the items they belong to."""
    out = decontaminate.mark_overlaps(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


_ARCHIVE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
h AS (SELECT digest, min(page_id) AS head FROM p WHERE n >= 100 GROUP BY digest)
SELECT page_id, n AS payload_bytes, p.digest AS payload_digest,
  CASE WHEN head IS NOT NULL AND page_id <> head THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN head IS NOT NULL AND page_id <> head THEN head END AS refers_to
FROM p LEFT JOIN h USING (digest)
"""


@query(_ARCHIVE)
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC archives and read back: one row per record, with the digest its chunks add up to."""
    pages = read(spark, sf_dir, "pages").select(
        F.col("page_id").alias("record_id"), F.col("url").alias("uri"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    files = warc.write_warc(warc.record_chunks(warc.decide_revisits(pages)), common.new_folder(spark, "warc"))
    chunks = warc.read_warc(files, with_data=False).where("is_last")
    return chunks.select(F.col("record_id").alias("page_id"), "payload_bytes", F.col("running_digest").alias("payload_digest"), "record_type", "refers_to")


@query()
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every document."""
    return simhash.near_duplicates(read(spark, sf_dir, "documents"), keep=["doc_id"]).drop("is_head")


@query()
def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram pieces of every document, and whether they decode to its text."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"), with_ids=False)


@query()
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every document and the verdict of the learned rules."""
    counted = common.durable(rule_lists.with_statistics(read(spark, sf_dir, "documents"), keep=["doc_id"]))
    judged = rule_lists.judge(counted, rule_lists.rules_from_labels(counted, read(spark, sf_dir, "labels")))
    return judged.select("doc_id", *[f"_statistics.{c}" for c in rule_lists.STATISTICS], "base_failed", "kept", "rule")


@query()
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence templates found in documents, with the best passage of each."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return license_scan.scan_licences(docs, templates=licence_templates.ALL_TEMPLATES, whole_lines=False)


def _vector_code_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """The rounds written out: components as rows, codebooks as rows, one pair of steps a round."""
    near = """
near{r} AS MATERIALIZED (
  SELECT row, part, entry, dist FROM (
    SELECT row, part, entry, sum((v.x - b.x) * (v.x - b.x)) AS dist, row_number() OVER (PARTITION BY row, part ORDER BY sum((v.x - b.x) * (v.x - b.x)), entry) AS nth
    FROM comp v JOIN book{r} b USING (part, pos) GROUP BY row, part, entry) WHERE nth = 1),"""
    moved = """
sums{r} AS (SELECT part, entry, pos, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM comp JOIN near{r} USING (row, part) GROUP BY part, entry, pos),
book{q} AS MATERIALIZED (SELECT part, entry, pos, CASE WHEN n IS NULL THEN x ELSE (s - ((s % n) + n) % n) // n END AS x FROM book{r} LEFT JOIN sums{r} USING (part, entry, pos)),"""
    steps = "".join(near.format(r=r) + moved.format(r=r, q=r + 1) for r in range(rounds)) + near.format(r=rounds)
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id) - 1 AS row FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
comp AS MATERIALIZED (
  SELECT row, (i - 1) // (len(embedding) // {parts}) AS part, (i - 1) % (len(embedding) // {parts}) AS pos,
    CAST(floor(1024 * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS x FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM kept)),
book0 AS (SELECT part, row AS entry, pos, x FROM comp WHERE row < {entries}),{steps}
coded AS (SELECT row, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(dist) AS BIGINT) AS error FROM near{rounds} GROUP BY row),
digest AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM book{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN coded USING (row), digest
"""


@query(_vector_code_sql())
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and error of every usable vector, and a digest of the codebooks."""
    rows, books = vector_codes.compress_vectors(read(spark, sf_dir, "embeddings"), keep=["vec_id"])
    return rows.withColumn("codebooks_sha256", F.lit(vector_codes.codebook_digest(books)))


_COMMON_LINES = r"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents),
lines AS (
  SELECT doc_id, i, s[i] AS line, translate(trim(s[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM split)),
common AS (SELECT key, max(doc_id) AS holder FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (holder <> doc_id) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (holder IS NULL OR holder = doc_id), '')) AS kept_sha256
FROM lines LEFT JOIN common USING (key) GROUP BY doc_id
"""


@query(_COMMON_LINES)
def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document, those dropped as common, and a digest of the rest."""
    out = common_lines.drop_common_lines(read(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@query()
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the documents with the more frequent spelling they are a variant of."""
    return spelling.variant_forms(spelling.word_counts(read(spark, sf_dir, "documents"), alter=spelling.slip))
