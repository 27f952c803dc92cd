"""The queries of the corpus operators: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_cnn, cost_packing, cube_mixing, fill_in_middle, jaccard_join, merkle_manifest, multi_index, norm_sorted, perspectives, pii, quality_forest, repair_codec, warc_revisits
from .common import table


def op1_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words a mix at target weights takes of each document."""
    return cube_mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: fixed patterns, and what the character tagger adds."""
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents whose 4-word shingle sets have a Jaccard similarity of 0.85 or more."""
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), k=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op3_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens, balanced by attention cost."""
    return cost_packing.packed(table(spark, sf_dir, "documents"))


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was asked for with every page (a folder of its host, with parameters), some answered as not modified: the response each such answer belongs to, and the merged headers."""
    found = warc_revisits.resolved(*warc_revisits.captures(table(spark, sf_dir, "pages")))
    lines = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(":"), e["value"]))), "|")
    return found.select("record_id", "url_key", "status", "response_id", F.when(F.col("headers").isNotNull(), lines).alias("headers"))


def op5_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors found of every vector whose id is divisible by 50, among all others."""
    vectors = table(spark, sf_dir, "embeddings")
    return multi_index.nearest(vectors, vectors.where("vec_id % 50 = 0"))


def op6_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every dialogue, of up to four people and the system, from the perspective of each of its participants, a row per turn."""
    found = perspectives.rotated(perspectives.several_parties(table(spark, sf_dir, "conversations")), "speaker")
    return found.select("conv_id", "perspective", "turn", "role", "name", "start", "mask_start", "mask_end", "end", F.md5("segment").alias("segment_md5"))


def op7_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, by a byte convolutional network that never saw the held-out ones."""
    return byte_cnn.predicted(table(spark, sf_dir, "documents"))


def op8_repair_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids written as Re-Pair shards and read back."""
    return repair_codec.round_trip(table(spark, sf_dir, "documents"))


def op9_quality_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule statistics of every document and whether rules and isolation forests keep it."""
    found = quality_forest.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *(f"score_{g}" for g in quality_forest.GROUPS))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A proof for every document, folded from the document or, for half of them, from one without its line ends."""
    tampered = F.when(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 2 == 0, merkle_manifest.document_leaf(F.translate("text", "\n", "")))
    found = merkle_manifest.manifest(table(spark, sf_dir, "documents"), {"tampered": tampered})
    found = found.withColumn("folded_root", merkle_manifest.folded(F.coalesce("tampered", "leaf"), F.col("proof")))
    return found.select("doc_id", "leaf", "subroot", "root", merkle_manifest.proof_hash(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents cut at two places between lines, in prefix- or suffix-first order, and digests of output and rebuilt text."""
    return fill_in_middle.digests(fill_in_middle.transformed(table(spark, sf_dir, "documents")))


def op13_norm_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 largest inner products of every vector whose id is divisible by 100 with all others, exactly."""
    vectors = table(spark, sf_dir, "embeddings")
    return norm_sorted.largest_products(vectors, vectors.where("vec_id % 100 = 0"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_cube_mixing, op2_pii, op3_cost_packing, op4_warc_revisits, op5_multi_index, op6_perspective_rotation, op7_byte_cnn, op8_repair_grammar, op9_quality_forest, op10_ngram_jaccard_join, op11_merkle_manifest, op12_fill_in_middle, op13_norm_sorted)}


def oracle_sql() -> dict[str, str]:
    return {"op4_warc_revisits": warc_revisits.ORACLE_SQL, "op6_perspective_rotation": perspectives.ORACLE_SQL, "op11_merkle_manifest": merkle_manifest.ORACLE_SQL, "op12_fill_in_middle": fill_in_middle.ORACLE_SQL, "op13_norm_sorted": norm_sorted.ORACLE_SQL}
