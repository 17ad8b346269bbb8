"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroid_clusters, curriculum_mix, line_dedup, secret_scan
from .bestfit_pack import pack_documents
from .common import table
from .imatch import imatch_report
from .loglinear_lm import lm_scores
from .near_dup import near_duplicates
from .quality_cascade import quality_report
from .spelling_groups import spelling_groups
from .style_tree import extract_pages
from .suffix_dedup import removed_passages
from .token_counts import token_counts

#: Tokens above which a document counts as over the limit.
TOKEN_LIMIT = 2048


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_passages(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op4_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op5_loglinear_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op6_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curriculum_mix.mix_report(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"))


def op8_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op9_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch_report(table(spark, sf_dir, "documents"))


def op10_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op12_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(table(spark, sf_dir, "documents"))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters.cluster_report(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_secret_scan, op2_suffix_dedup, op3_token_counts, op4_style_tree, op5_loglinear_lm, op6_curriculum_mix, op7_quality_rules, op8_bestfit_packing, op9_imatch, op10_minhash_near_dup, op11_line_dedup, op12_spelling_groups, op13_centroid_clusters)}
ORACLE_SQL: dict[str, str] = {"op1_secret_scan": secret_scan.oracle_sql(), "op6_curriculum_mix": curriculum_mix.ORACLE_SQL, "op11_line_dedup": line_dedup.ORACLE_SQL, "op13_centroid_clusters": centroid_clusters.oracle_sql()}
