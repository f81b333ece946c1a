"""The queries of this subpackage: name -> function of (spark, sf_dir), and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.sql import SQL

__all__ = ["QUERIES", "SQL"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tessella.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.mixing import mix

    out = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.quality_rules import judge, learn

    docs = table(spark, sf_dir, "documents")
    out = judge(docs, learn(docs, table(spark, sf_dir, "labels")), F.col("doc_id"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.common import in_fold
    from tessella.llm.kneser_ney import learn, score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, learn(docs.filter(F.crc32(F.col("doc_id").cast("string")) % 7 != 2)))
    return out.select("doc_id", in_fold(F.col("doc_id"), 7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.jaccard_join import join

    return join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op9_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.pii import pseudonymise

    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.common import in_fold
    from tessella.llm.language_id import learn, predict

    docs = table(spark, sf_dir, "documents")
    train = docs.filter((F.crc32(F.col("doc_id").cast("string")) % 4 != 2) & F.col("lang").isNotNull())
    out = predict(docs, learn(train.select("doc_id", "text", "lang")))
    return out.select("doc_id", in_fold(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.suffix_dedup import repeated_spans

    return repeated_spans(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tessella.llm.token_counts import count_tokens, learn, vocabulary

    docs = table(spark, sf_dir, "documents")
    return count_tokens(docs, learn(docs, vocabulary(public_tokenizers.path("piece_bpe_32k.model"))))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.metric_tree import top_k

    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.prefix_trie import of_blocks

    out = of_blocks(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.merkle import manifest

    return manifest(table(spark, sf_dir, "documents"), tampered=F.crc32(F.col("doc_id").cast("string")) % 3 == 0)


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.warc import archived

    return archived(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_best_fit_packing, op2_source_mixing, op3_language_id, op4_quality_rules, op5_suffix_array_dedup, op6_token_counts, op7_lm_scoring, op8_ngram_jaccard_join, op9_pii_pseudonyms, op10_exact_top_k, op11_conversation_trie, op12_merkle_manifest, op13_warc)}
