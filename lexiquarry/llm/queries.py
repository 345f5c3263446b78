"""The registered queries opN_<name>, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .class_lm import class_lm_scores
from .decontamination import find_contamination
from .exact_dedup import exact_dedup
from .html_extraction import extract_pages
from .language_id import fit, identify, training_row
from .line_dedup import line_dedup
from .near_dedup import near_duplicates
from .packing import pack_documents
from .sharding import byte_shards
from .substring_dedup import substring_dedup

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
#: CRC-32 of a blob: the table of 256 values comes from the polynomial 0xEDB88320.
_CRC_TABLE = """crc_bits(n, c, k) AS (
  SELECT n::BIGINT, n::BIGINT, 0 FROM range(256) t(n)
  UNION ALL
  SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc_bits WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY n) AS t FROM crc_bits WHERE k = 8)"""
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(regexp_extract_all(hex(encode({0})), '..'), lambda h: ('0x' || h)::BIGINT)),
  lambda c, b: xor(c >> 8, list_extract({1}, (xor(c, b) & 255) + 1))), 4294967295)"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), threshold=0.8, width=5)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = fit(docs.filter(training_row()), tokenizer_file("piece_bpe_32k.model"))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", (~training_row()).alias("held_out"), "lang_pred", "score", "lift")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op4_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm_scores(_documents(spark, sf_dir))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(_documents(spark, sf_dir), min_docs=10, min_chars=1)
    return out.select("doc_id", F.col("__lq_lines").alias("n_lines"), F.col("__lq_dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


OP5_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (SELECT *, {_LOWER.format(f"trim(line, {_SPACE})")} AS key FROM lines),
frequent AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(f.key)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN frequent f USING (key) GROUP BY doc_id"""


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_documents(spark, sf_dir), width=50).drop("kept")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_shards(_documents(spark, sf_dir), shards=40, overhead=16)


OP7_SQL = f"""
WITH RECURSIVE {_CRC_TABLE},
sized AS (SELECT doc_id, (strlen(coalesce(text, '')) + 16)::BIGINT AS size, coalesce(text, '') AS text FROM documents),
summed AS (SELECT *, sum(size) OVER (ORDER BY doc_id)::BIGINT AS upto, (sum(size) OVER ())::BIGINT AS total FROM sized),
dealt AS (SELECT *, least(39, ((2 * upto - size) * 40) // (2 * total))::INTEGER AS shard FROM summed)
SELECT doc_id, size, {_CRC.format("text", "t")}::BIGINT AS text_crc32, 'bytes' AS law, shard,
  (row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1)::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM dealt, crc_table"""


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_documents(spark, sf_dir))


OP8_SQL = f"""
WITH normed AS (SELECT doc_id, sha256({_LOWER.format("coalesce(text, '')")}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM normed WINDOW w AS (PARTITION BY text_sha256)"""


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"), capacity=4096, end_id=1)


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir), threshold=0.8, width=5).select("doc_id", "class_id", "class_size", "kept")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # stands beside the package

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_decontamination, op2_language_id, op3_html_extraction, op4_class_lm, op5_line_dedup, op6_suffix_dedup, op7_sharding, op8_exact_dedup, op9_packing, op10_near_dedup)
    return {f.__name__: f for f in found} | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return {"op5_line_dedup": OP5_SQL, "op7_sharding": OP7_SQL, "op8_exact_dedup": OP8_SQL}
