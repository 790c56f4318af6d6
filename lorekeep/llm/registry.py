"""The queries of the corpus operators, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm import chat, decontaminate, infill, jaccard, louds, packing, pieces, pseudonyms, quality, runtime, secrets, sharding, sql, warc, wordpiece

Query = Callable[[SparkSession, str], DataFrame]


def op7_wordpiece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.piece_counts(runtime.table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op8_concat_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(runtime.table(spark, sf_dir, "documents"), *bpe_50k())


def bpe_50k() -> tuple[str, str, dict[str, int]]:
    """The rank file with the vocabulary of byte_bpe_50k.json, its word pattern and its special token."""
    import public_tokenizers

    return tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, {"<|endoftext|>": 50256}


def op9_prefix_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(runtime.table(spark, sf_dir, "documents"))


def op10_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = runtime.table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.quality_report(docs).drop("text", "rejected_by")


def op11_infill_buffers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digest_columns(infill.transform(runtime.table(spark, sf_dir, "documents")))


def op12_louds_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return louds.prefix_trie(runtime.table(spark, sf_dir, "conversations"))


def op13_sentencepiece_backtracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_file("piece_bpe_32k.model")
    return pieces.digest_columns(pieces.encode(runtime.table(spark, sf_dir, "documents"), path), path)


def tokenizer_file(name: str) -> str:
    """Where the public tokenizers are installed, on the driver as on executors; LOREKEEP_TOKENIZERS overrides it."""
    folder = os.environ.get("LOREKEEP_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table against a replica of it with known faults."""
    pages = runtime.table(spark, sf_dir, "pages")
    return warc.audit(pages, warc.damaged(pages))


def pseudonym_key() -> str:
    """The secret of the permutations. Deployments set their own; without one, results can be repeated by anyone."""
    return os.environ.get("LOREKEEP_PSEUDONYM_KEY", "no secret: for tests and checks")


def op2_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = runtime.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pseudonyms.pseudonymise(docs, pseudonym_key())
    return out.withColumnRenamed(pseudonyms.P + "kinds", "kinds")


def op3_secret_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest_columns(secrets.scan(runtime.table(spark, sf_dir, "documents")))


def op4_typed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = runtime.table(spark, sf_dir, "conversations").selectExpr("CAST(conv_id AS long) conv_id", "CAST(turn AS long) turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    fixed = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], turns.schema)
    parts = turns.unionByName(fixed).select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts"))
    return chat.read_back(chat.format_turns(parts))


def op5_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(runtime.table(spark, sf_dir, "documents"), runtime.table(spark, sf_dir, "benchmark"))


def op6_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(runtime.table(spark, sf_dir, "documents"), shards=24)


QUERIES: tuple[Query, ...] = (
    op1_merkle_fixity,
    op2_feistel_pseudonyms,
    op3_secret_structure,
    op4_typed_parts,
    op5_spaced_seeds,
    op6_minimax_shards,
    op7_wordpiece_counts,
    op8_concat_and_cut,
    op9_prefix_tree_join,
    op10_quality_cascade,
    op11_infill_buffers,
    op12_louds_prefix_trie,
    op13_sentencepiece_backtracking,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op1_merkle_fixity": sql.OP1, "op4_typed_parts": sql.OP4, "op10_quality_cascade": sql.OP10, "op11_infill_buffers": sql.OP11, "op12_louds_prefix_trie": sql.OP12}
