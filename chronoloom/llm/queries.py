"""Queries of this subpackage: name -> callable(spark, sf_dir). None can be given as SQL; the tests hold them against brute force."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronoloom.llm.event_runs import activity_runs
from chronoloom.llm.packing import document_containers
from chronoloom.llm.personal_info import personal_info, redacted_activity
from chronoloom.llm.plain_text import WHOLE, not_plain, plain_activity
from chronoloom.llm.splitting import split_texts
from chronoloom.llm.token_ids import encoded


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity_runs(_table(spark, sf_dir, "activity_records")).where("n_events >= 2").select("bucket_id", "first_event_id", "last_event_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_info(_table(spark, sf_dir, "activity_records"), _table(spark, sf_dir, "people"))


def p5_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redacted_activity(_table(spark, sf_dir, "activity_records"), _table(spark, sf_dir, "people"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return not_plain(_table(spark, sf_dir, "activity_records"))


def p6_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain_activity(_table(spark, sf_dir, "activity_records"))


def p6_whole_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with words wholly of look-alikes, which are in one script and therefore no cases of p6_found."""
    return not_plain(_table(spark, sf_dir, "activity_records"), kinds=WHOLE)


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(_table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_containers(_table(spark, sf_dir, "documents"))


def p9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_texts(_table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p2_found, p5_found, p5_redacted, p6_found, p6_plain, p6_whole_words, p7_ids, p8_containers, p9_pieces)}
ORACLE: dict[str, str] = {}
