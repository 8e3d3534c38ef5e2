"""The queries of this subpackage, one for each operator, as thin contracts over the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import spread
from .alignment import tokenizer_alignment
from .ann import nearest
from .chroma import align, fingerprints, sung
from .extraction import extract_text
from .licenses import ORACLE as LICENSES_SQL
from .licenses import label_columns, scan_licenses
from .linededup import ORACLE as LINE_DEDUP_SQL
from .linededup import dedup_lines
from .manifest import ORACLE as MANIFEST_SQL
from .manifest import manifest
from .minhash import ORACLE as NEAR_DEDUP_SQL
from .minhash import near_duplicates
from .mixing import mixing_rates
from .pieces import encode_n_best
from .shared import table
from .tokencount import token_length_table
from .toxicity import held_out, score_toxicity
from .urlfilter import judge_urls


def dealt(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows keep all cores busy, even if it is one small row group."""
    return spread(table(spark, sf_dir, name))


def op1_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings are the turns of ``conversations``, sung: the given tables have no audio."""
    turns = dealt(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return align(fingerprints(sung(turns)), ["conv_id", "turn"], F.col("conv_id") % 20 == 0)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_rates(dealt(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(dealt(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_length_table(dealt(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_toxicity(dealt(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.7).cast("int").alias("predicted"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(dealt(spark, sf_dir, "documents"), percent=85)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = encode_n_best(dealt(spark, sf_dir, "documents").select("doc_id", "text"), n=4)
    return made.select(
        "doc_id", F.size("ids").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), "scores",
        F.xxhash64(F.to_json("changes")).alias("changes_hash"), "round_trip",
    )


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(dealt(spark, sf_dir, "pages").select("page_id", "url", "html")).select(
        "page_id", "host", "path", "rule", "verdict", "host_words", "block_odds"
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(dealt(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_approximate_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_columns(scan_licenses(dealt(spark, sf_dir, "documents").select("doc_id", "text")))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = manifest(dealt(spark, sf_dir, "documents"))
    return made.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = tokenizer_alignment(dealt(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


OPERATORS = (
    op1_chroma_fingerprints,
    op2_mixing,
    op3_html_extraction,
    op4_token_counts,
    op5_toxicity,
    op6_minhash_near_dedup,
    op7_sentencepiece,
    op8_url_filter,
    op9_line_dedup,
    op10_approximate_neighbours,
    op11_license_scan,
    op12_merkle_manifest,
    op13_tokenizer_alignment,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {"op6_minhash_near_dedup": NEAR_DEDUP_SQL, "op9_line_dedup": LINE_DEDUP_SQL, "op11_license_scan": LICENSES_SQL, "op12_merkle_manifest": MANIFEST_SQL}
