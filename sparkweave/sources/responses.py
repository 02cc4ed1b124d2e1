"""Landed API responses (SRC-12, SRC-13).

Fetching is outside Spark: responses are landed as files (one JSON document
per line, or one pretty-printed document per file) and read here in
parallel with a fixed schema.  Missing keys read as NULL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from sparkweave.operators.flatten import SEARCH_SCHEMA, USER_SCHEMA, flatten_search, flatten_users
from sparkweave.sources.files import read_json


def read_responses(spark: SparkSession, path: str, schema: T.StructType, one_per_file: bool = False) -> DataFrame:
    return read_json(spark, path, schema, multi_line=one_per_file)


def read_search_results(spark: SparkSession, path: str, one_per_file: bool = False) -> DataFrame:
    return flatten_search(read_responses(spark, path, SEARCH_SCHEMA, one_per_file))


def read_user_profiles(spark: SparkSession, path: str, one_per_file: bool = False) -> DataFrame:
    return flatten_users(read_responses(spark, path, USER_SCHEMA, one_per_file))
