"""Registered queries of this folder; each derives its columns from what an operator returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from periodlens.llm import (
    chat, language, lattice, leaks, mixing, nearest, packing, periodic, quality, repair, secret_scan, sharding, simhash, sql,
)
from periodlens.llm.common import read


def _fold(modulus: int):
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus


def op1_nearest(spark: SparkSession, sf: str) -> DataFrame:
    index = nearest.build(read(spark, sf, "embeddings"))
    queries = index.rows.filter(F.col("id") % 100 == 0).withColumnRenamed("id", "query")
    return nearest.search(index, queries).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op2_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.judged(read(spark, sf, "documents")).withColumnRenamed("id", "doc_id")


def op3_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.shard(read(spark, sf, "documents")).select(
        F.col("id").alias("doc_id"), "size", F.col("checksum").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.groups(read(spark, sf, "documents")).select(
        F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def op5_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(read(spark, sf, "documents")).select(
        F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op6_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.taken(read(spark, sf, "documents")).withColumnRenamed("id", "doc_id")


def op7_lattice(spark: SparkSession, sf: str) -> DataFrame:
    return lattice.score(read(spark, sf, "documents"), _fold(7) == 2).withColumnRenamed("id", "doc_id")


def op8_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents")
    held_out = _fold(4) == 2
    model = language.train(docs.filter(~held_out))
    return language.predict(docs, model, columns={"doc_id": "doc_id"}).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score"
    )


def op9_chat(spark: SparkSession, sf: str) -> DataFrame:
    turns = read(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], turns.schema)
    formatted = chat.format_turns(turns.unionByName(probe))
    return chat.digests(chat.read_turns(formatted)).withColumnRenamed("conv", "conv_id")


def op10_secrets(spark: SparkSession, sf: str) -> DataFrame:
    kinds = F.array(*map(F.lit, secret_scan.KINDS[:3]))
    written = F.transform("spans", lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"]))
    base = F.transform(
        F.filter("spans", lambda x: F.array_contains(kinds, x["kind"])),
        lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"]),
    )

    def count(kind: str):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")

    return secret_scan.spans(read(spark, sf, "documents")).select(
        F.col("id").alias("doc_id"), count("assign").alias("n_assign"), count("access").alias("n_access"),
        count("hex").alias("n_hex"), F.sha2(F.concat_ws(",", base), 256).alias("base_sha256"),
        F.concat_ws(",", written).alias("spans"),
    )


def op11_periodic(spark: SparkSession, sf: str) -> DataFrame:
    found = periodic.runs(periodic.planted(read(spark, sf, "documents")), "id", "text")
    # The longest run; of equal ones the first, then the one of smaller period.
    ranked = F.transform("runs", lambda r: F.struct(r["length"].alias("length"), -r["start"], -r["period"]))
    found = found.withColumn("best", F.array_max(ranked))
    start, length, period = -F.col("best.col2"), F.col("best.length"), -F.col("best.col3")
    written = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines = F.array_join(F.transform(written, lambda x: F.concat(x, F.lit("\n"))), "")
    return found.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"),
        period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_repair(spark: SparkSession, sf: str) -> DataFrame:
    turns = repair.turns_of(read(spark, sf, "conversations"))
    return repair.report(turns, repair.damaged(turns)).withColumnRenamed("conv", "conv_id")


def op13_leaks(spark: SparkSession, sf: str) -> DataFrame:
    found = leaks.scan(read(spark, sf, "documents"), read(spark, sf, "benchmark"))
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select(
        F.col("id").alias("doc_id"), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


# The written form adds 20 characters of control strings to a turn, and a backslash to each control string inside it.
OP9_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
escaped AS (
  SELECT *, len(role) + len(text) + 20 + len(regexp_extract_all(role || chr(10) || text,
    '<\\*(s>|/s>|\|endoftext\|>)|\[\\*(INST\]|/INST\]|s>)|<\\*(INST\]|/INST\])|\[\\*(/s>|\|endoftext\|>)')) AS chars
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN len(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""

QUERIES = {
    "op1_nearest": op1_nearest, "op2_quality": op2_quality, "op3_sharding": op3_sharding, "op4_simhash": op4_simhash, "op5_packing": op5_packing,
    "op6_mixing": op6_mixing, "op7_lattice": op7_lattice, "op8_language": op8_language, "op9_chat": op9_chat,
    "op10_secrets": op10_secrets, "op11_periodic": op11_periodic, "op12_repair": op12_repair, "op13_leaks": op13_leaks,
}
ORACLES: dict[str, str] = {
    "op6_mixing": mixing.SQL, "op9_chat": OP9_SQL, "op11_periodic": sql.OP11, "op12_repair": sql.OP12, "op13_leaks": sql.OP13,
}
