"""All queries of the core and their SQL."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexiweave.plans import data_cleaning, files, geometry, models, reports, words

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**data_cleaning.QUERIES, **words.QUERIES, **geometry.QUERIES, **reports.QUERIES, **models.QUERIES, **files.QUERIES}
SQL: dict[str, str] = {**data_cleaning.SQL, **words.SQL, **geometry.SQL, **reports.SQL, **models.SQL, **files.SQL}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
