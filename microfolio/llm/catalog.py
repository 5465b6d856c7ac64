"""Registered queries of the numbered operators over whole tables, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, conversations, exact_dedup, fingerprints, language, merkle, mixing, near_dedup, packing, suffix_dedup, token_count, token_files, toxicity
from .common import crc_of, documents, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, sf_dir))


ORACLE["op2_exact_dedup"] = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM d
"""


@query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"))


@query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), added_tokens=True)


@query
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks, ranks = token_files.write(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), added_tokens=True)
    return token_files.read(blocks, ranks, digest=True)


@query
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(documents(spark, sf_dir), vocabulary("byte_bpe_50k.tiktoken"))


@query
def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal_digests(documents(spark, sf_dir))


@query
def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(documents(spark, sf_dir))


@query
def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir))


def toxicity_model(spark: SparkSession, sf_dir: str):
    """Trained on labelled documents outside the held-out quarter."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.train(documents(spark, sf_dir), labels, crc_of("doc_id", 4) != 2)


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(documents(spark, sf_dir), toxicity_model(spark, sf_dir))
    return scored.select("doc_id", F.coalesce(crc_of("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")


@query
def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = language.identify(docs, language.train(docs, crc_of("doc_id", 3) != 1))
    return found.select("doc_id", F.coalesce(crc_of("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(table(spark, sf_dir, "conversations"))


@query
def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).drop("copies")


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verification(documents(spark, sf_dir))


def _leaf_sql(text: str) -> str:
    columns = ["doc_id", "source", "lang", "n_chars", text]
    return "sha256(" + " || ".join(f"coalesce(strlen(({c})::VARCHAR) || ':' || ({c})::VARCHAR, '-')" for c in columns) + ")"


def _levels_sql(leaves: str) -> str:
    return f"""
  SELECT tree, 0 AS lvl, pos AS idx, n AS width, digest FROM {leaves}
  UNION ALL
  SELECT tree, lvl + 1, idx // 3, (width + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx))
  FROM {leaves}_up WHERE width > 1 GROUP BY tree, lvl, idx // 3, width"""


def _siblings_sql(leaves: str, offset: int) -> str:
    own = "(a.pos // power(3, u.lvl)::BIGINT)"
    return f"""
  SELECT a.row, u.lvl + {offset} AS lvl,
         coalesce(string_agg(u.digest, '' ORDER BY u.idx) FILTER (u.idx < {own}), '') AS l,
         coalesce(string_agg(u.digest, '' ORDER BY u.idx) FILTER (u.idx > {own}), '') AS r
  FROM {leaves} a JOIN {leaves}_up u ON a.tree = u.tree AND u.width > 1 AND u.idx // 3 = {own} // 3
  GROUP BY a.row, u.lvl"""


#: crc32 of the decimal id, bit by bit.
_CRC_SQL = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda crc, c: list_reduce([xor(crc, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)"""

ORACLE["op13_merkle_manifest"] = f"""
WITH RECURSIVE hashed AS (
  SELECT doc_id, coalesce('1' || source, '0') AS tree, {_leaf_sql("text")} AS digest,
         CASE WHEN {_CRC_SQL} % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} ELSE {_leaf_sql("text")} END AS changed
  FROM documents),
docs AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS pos,
         count(*) OVER (PARTITION BY tree) AS n, row_number() OVER (ORDER BY tree, doc_id NULLS FIRST, digest) AS row
  FROM hashed),
docs_up AS ({_levels_sql("docs")}),
sources AS (
  SELECT '' AS tree, tree AS row, digest, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n
  FROM docs_up WHERE width = 1),
sources_up AS ({_levels_sql("sources")}),
steps AS (
  SELECT * FROM ({_siblings_sql("docs", 0)})
  UNION ALL
  SELECT d.row, s.lvl, s.l, s.r FROM docs d JOIN ({_siblings_sql("sources", 1000)}) s ON d.tree = s.row),
paths AS (
  SELECT row, string_agg(l || r, '' ORDER BY lvl) AS proof, list(l || ',' || r ORDER BY lvl) AS steps FROM steps GROUP BY row),
folded AS (
  SELECT d.doc_id, d.digest AS leaf, s.digest AS subroot, (SELECT digest FROM sources_up WHERE width = 1) AS root,
         sha256(coalesce(p.proof, '')) AS proof_sha256,
         list_reduce(list_concat([d.changed], coalesce(p.steps, [])),
                     lambda a, x: sha256(split_part(x, ',', 1) || a || split_part(x, ',', 2))) AS folded_root
  FROM docs d JOIN sources s ON d.tree = s.row LEFT JOIN paths p ON p.row = d.row)
SELECT *, folded_root = root AS verified FROM folded
"""
