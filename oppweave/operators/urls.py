"""Canonical URL tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import base_domain, canonical_url, domain


def canonical_urls(
    df: DataFrame, url_col: str, ord_col: str, strip_utm: bool = False
) -> DataFrame:
    """One row per canonical URL: first position, row count, number of variants."""
    return (
        df.select(
            canonical_url(url_col, strip_utm).alias("canonical_url"),
            domain(url_col).alias("source_domain"),
            F.col(url_col).alias("variant"),
            F.col(ord_col).alias("ord"),
        )
        .groupBy("canonical_url", "source_domain", "variant")
        .agg(F.min("ord").alias("ord"), F.count("*").alias("n"))
        .groupBy("canonical_url", "source_domain")
        .agg(
            F.min("ord").alias("first_ord"),
            F.min_by("variant", "ord").alias("first_variant"),
            F.sum("n").alias("n_rows"),
            F.count("*").alias("n_variants"),
        )
        .withColumn("base_domain", base_domain("source_domain"))
    )


def domain_counts(urls: DataFrame) -> DataFrame:
    """Canonical URLs and rows per domain."""
    return urls.groupBy("source_domain", "base_domain").agg(
        F.count("*").alias("n_urls"), F.sum("n_rows").alias("n_rows")
    )
