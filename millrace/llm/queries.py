"""The registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bytebpe, editcounts, exact, fingerprints, jaccard, linededup, oracles, packing, phrases, pii, quality, sharding, substrings, veccodes
from millrace.llm.common import documents

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
RANK_FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SHARDS = 40


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), WORD_TOKENIZER, carry={"ids_crc32": F.crc32("ids")})


def op2_bloom_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.fingerprint(documents(spark, sf_dir))
    return found.select("doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.dedup(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op4_pii_semi_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(documents(spark, sf_dir))

    def joined(column: str):
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(documents(spark, sf_dir))
    n_removed = (F.col("n_bytes") - F.octet_length("kept")).cast("long")
    own = ("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
    n_words = F.aggregate("passages", F.lit(0).cast("long"), lambda n, p: n + p["end"] - p["start"])
    return found.select(*own, F.size("passages").cast("long").alias("n_passages"), n_words.alias("passage_bytes"))


def op6_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.byte_shards(documents(spark, sf_dir), SHARDS)
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_edit_aware_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document before and after a script of edits: one in each third, and an addition at the end."""
    pattern = public_tokenizers.PATTERN
    trees = editcounts.count_trees(documents(spark, sf_dir), RANK_FILE, pattern)
    n = F.char_length("text")

    def edit(at, removed: int, inserted):
        return F.struct(at.cast("long").alias("position"), F.lit(removed).cast("long").alias("removed"), inserted.alias("inserted"))

    script = F.array(
        edit(F.floor(n / 6), 16, F.substring("text", -12, 12)),
        edit(F.floor(n / 2), 9, F.lit("")),
        edit(F.floor(n * 5 / 6), 0, F.concat(F.lit("\n"), F.substring("text", 1, 24))),
        edit(n + 24, 0, F.lit(" edited")),
    )
    counted = editcounts.apply_edits(trees.withColumn("edits", script), RANK_FILE, pattern)
    return counted.select("doc_id", "n_chars", "n_tokens", F.char_length("edited").cast("long").alias("edited_chars"), "edited_tokens", "encoded_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(documents(spark, sf_dir)).select("doc_id", "class_id", "n_links", "n_different", "copies")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    pattern = public_tokenizers.PATTERN
    both = bytebpe.decode(bytebpe.encode(documents(spark, sf_dir), RANK_FILE, pattern), RANK_FILE, pattern)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = veccodes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return coded.select("vec_id", veccodes.hex_code().alias("code"), "error", "label_error", F.lit(veccodes.digest(books)).alias("codebooks_sha256"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.dedup_lines(documents(spark, sf_dir), carry=("text",))
    text = F.coalesce(F.col("text"), F.lit(""))
    kept = F.when(F.col("n_dropped") == 0, text).otherwise(linededup.kept_text(text, F.col("keep")))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode(kept, "UTF-8"), 256).alias("kept_sha256"), F.array_join("keep", ",").alias("keep_runs"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_exact_dedup": oracles.DEDUP,
        "op5_suffix_array_dedup": oracles.repeats(),
        "op6_byte_shards": oracles.shards(SHARDS),
        "op8_ngram_jaccard_join": oracles.join(),
        "op11_phrase_collocations": oracles.collocations(),
        "op12_vector_codes": oracles.codes(),
        "op13_line_dedup": oracles.lines(),
    }
