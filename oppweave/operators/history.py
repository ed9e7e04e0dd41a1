"""Fetch history: lookup with TTL, gate, revisits, upsert and domain feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vocab as v
from ..functions.ranks import running_max, top_n
from ..functions.text import clean, nonblank

HISTORY_COLUMNS = [
    "normalized_url", "url", "source_domain", "page_type", "last_seen_at", "last_fetched_at",
    "last_search_query", "last_error", "candidate_id", "candidate_name",
]


def _seconds(c: Column) -> Column:
    return c.cast("timestamp").cast("double")


def ttl_hours(page_type: Column, ttl: dict[str, float]) -> Column:
    out = F.lit(float(ttl["unknown"]))
    for kind, hours in ttl.items():
        out = F.when(page_type == kind, F.lit(float(hours))).otherwise(out)
    return out


def history_lookup(
    hits: DataFrame, history: DataFrame, as_of: str, ttl: dict[str, float] | None = None
) -> DataFrame:
    """Latest record of each hit's URL, its age and whether it is still fresh."""
    ttl = ttl or v.PAGE_TYPE_TTL_HOURS
    known = history.select(
        "normalized_url",
        F.col("last_fetched_at").alias("h_fetched_at"),
        F.coalesce(nonblank("page_type"), F.lit("unknown")).alias("h_page_type"),
    )
    fetched = F.col("h_fetched_at")
    age = F.when(
        fetched.isNotNull(),
        F.greatest(F.lit(0.0), (_seconds(F.lit(as_of)) - _seconds(fetched)) / 3600),
    )
    return (
        hits.join(known, "normalized_url", "left")
        .withColumns(
            {
                "page_type": F.when(fetched.isNull(), "unknown").otherwise(F.col("h_page_type")),
                "age_hours": age,
                "ttl_hours": F.when(fetched.isNotNull(), ttl_hours(F.col("h_page_type"), ttl)),
            }
        )
        .withColumn("skip", F.coalesce(F.col("age_hours") < F.col("ttl_hours"), F.lit(False)))
        .drop("h_fetched_at", "h_page_type")
    )


def history_gate(looked_up: DataFrame, mode: str = "normal") -> DataFrame:
    """fetch / bypass / skip; ``mode`` is normal, rerun or fresh.

    Good hits of fresh direct or list pages are fetched again on a rerun (fit 11,
    two hours old) or a fresh start (fit 9, any age).
    """
    fit = F.coalesce("fit_score", F.lit(0.0))
    # Bypass thresholds.
    least_fit, least_age = (9.0, 0.0) if mode == "fresh" else (11.0, 2.0)
    bypass = (
        F.lit(mode in ("rerun", "fresh"))
        & (fit >= least_fit)
        & F.col("page_type").isin("direct_scholarship", "scholarship_list_page")
        & (F.col("age_hours").isNull() | (F.col("age_hours") >= least_age))
    )
    return looked_up.withColumn(
        "decision", F.when(bypass, "bypass").when(F.col("skip"), "skip").otherwise("fetch")
    )


def select_revisits(gated: DataFrame, fresh_start: bool = False, most: int = 6, least: int = 6) -> DataFrame:
    """Recently fetched pages to fetch again when too little else is left.

    Lists before direct pages, oldest first, then rank, then place (``ord``) where there is one; at most ``most`` per run.
    """
    counts = gated.groupBy("run_id").agg(
        F.count_if(F.col("decision") != "skip").alias("n_fetchable"),
        F.count_if(F.col("decision") == "skip").alias("n_skipped"),
    )
    n, k = F.col("n_fetchable"), F.col("n_skipped")
    top_up = F.lit(fresh_start) & (n > 0) & (n < least)
    short = F.when(n == 0, F.lit(most)).otherwise(F.greatest(F.lit(1), F.lit(least) - n))
    budgets = counts.filter((k > 0) & ((n == 0) | top_up)).select(
        "run_id", F.least(F.lit(most), F.greatest(F.lit(1), F.least(short, k))).alias("budget")
    )
    pool = gated.filter(
        (F.col("decision") == "skip")
        & F.col("page_type").isin("direct_scholarship", "scholarship_list_page")
    )
    order = [
        F.when(F.col("page_type") == "scholarship_list_page", 0).otherwise(1).asc(),
        F.col("age_hours").desc_nulls_last(),
        F.col("rank").asc(),
        *[F.col(c).asc() for c in ("ord",) if c in gated.columns],
    ]
    return (
        top_n(pool, ["run_id"], order, most, "revisit_rank")
        .join(budgets, "run_id")
        .filter(F.col("revisit_rank") <= F.col("budget"))
        .drop("budget")
    )


def upsert_history(history: DataFrame, updates: DataFrame) -> DataFrame:
    """Last non-empty value per column and URL, in update order.

    ``history`` rows count as order -1.  One grouped aggregate with map-side
    combine; a URL updated very often costs one row per task.
    """
    rows = history.select(*HISTORY_COLUMNS, F.lit(-1).cast("bigint").alias("ord")).unionByName(
        updates.select(*HISTORY_COLUMNS, F.col("ord").cast("bigint").alias("ord"))
    )
    aggs = []
    for c in HISTORY_COLUMNS[1:]:
        value = F.col(c)
        if c not in ("last_seen_at", "last_fetched_at"):
            value = nonblank(clean(c))
        last = F.max_by(value, F.when(value.isNotNull(), F.col("ord")))
        aggs.append((F.coalesce(last, F.lit("unknown")) if c == "page_type" else last).alias(c))
    return rows.filter(F.coalesce("normalized_url", F.lit("")) != "").groupBy("normalized_url").agg(*aggs)


def recent_fetches(history: DataFrame, updates: DataFrame, ttl: dict[str, float] | None = None) -> DataFrame:
    """``updates`` with the record of their URL just before each, and whether that was still fresh (``skip``).

    The record is ``history`` with the earlier updates (by ``ord``, of the same table) folded in, and an update's clock
    is its own ``last_seen_at``, so the flags do not depend on how a stream of updates is cut into tables.
    """
    fetched, kind = F.col("last_fetched_at"), nonblank(clean("page_type"))
    at = F.col("ord").alias("at")
    keyed = updates.filter(F.coalesce("normalized_url", F.lit("")) != "")
    earlier = running_max(
        keyed, ["normalized_url"], [F.col("ord").asc()],
        {"__f": F.when(fetched.isNotNull(), F.struct(at, fetched.alias("x"))), "__p": F.when(kind.isNotNull(), F.struct(at, kind.alias("x")))},
    )
    stored = history.select("normalized_url", F.col("last_fetched_at").alias("__hf"), nonblank("page_type").alias("__hp"))
    both = earlier.join(stored, "normalized_url", "left").withColumns(
        {"fetched_before": F.coalesce("__f.x", "__hf"), "type_before": F.coalesce("__p.x", "__hp", F.lit("unknown"))}
    )
    age = F.greatest(F.lit(0.0), (_seconds(F.col("last_seen_at")) - _seconds(F.col("fetched_before"))) / 3600)
    aged = both.withColumn("age_hours", F.when(F.col("fetched_before").isNotNull(), age))
    fresh = F.col("age_hours") < ttl_hours(F.col("type_before"), ttl or v.PAGE_TYPE_TTL_HOURS)
    return aged.withColumn("skip", F.coalesce(fresh, F.lit(False))).drop("__f", "__p", "__hf", "__hp")


def recent(history: DataFrame, as_of: str, days: int = 14) -> DataFrame:
    """History rows fetched within the trailing window."""
    age = _seconds(F.lit(as_of)) - _seconds(F.col("last_fetched_at"))
    return history.filter(
        F.col("last_fetched_at").isNotNull() & (age <= days * 86400)
        & (F.coalesce("source_domain", F.lit("")) != "")
    )


def domain_feedback(candidates: DataFrame) -> DataFrame:
    """Review outcomes per domain; an unknown status counts as pending."""
    s = F.coalesce("status", F.lit("pending"))
    known = ["approved", "rejected", "submitted"]
    return (
        candidates.withColumn(
            "source_domain", F.regexp_replace(F.lower("source_domain"), r"^www\.", "")
        )
        .filter(F.col("source_domain") != "")
        .groupBy("source_domain")
        .agg(
            *[F.count_if(s == k).alias(k) for k in known],
            F.count_if(~s.isin(*known)).alias("pending"),
        )
    )


def domain_yield(history: DataFrame, as_of: str, days: int = 14) -> DataFrame:
    """Direct, list, error and other pages per domain in the window."""
    t = F.coalesce("page_type", F.lit(""))
    named = ["direct_scholarship", "scholarship_list_page", "fetch_error"]
    return recent(history, as_of, days).groupBy("source_domain").agg(
        F.count_if(t == named[0]).alias("n_direct"),
        F.count_if(t == named[1]).alias("n_list"),
        F.count_if(t == named[2]).alias("n_error"),
        F.count_if(~t.isin(*named)).alias("n_other"),
    )


def recent_domain_counts(
    history: DataFrame, as_of: str, types: list[str] | None = None, days: int = 14
) -> DataFrame:
    """Fetches per domain in the window, optionally of some page types only."""
    rows = recent(history, as_of, days)
    if types:
        rows = rows.filter(F.col("page_type").isin(*types))
    return rows.groupBy("source_domain").agg(F.count("*").alias("recent_count"))


def domain_score(feedback: DataFrame, yields: DataFrame) -> DataFrame:
    """Clamped score of a domain from reviews and recent page kinds."""
    both = feedback.join(yields, "source_domain", "full_outer")
    a, r, s, p = (F.coalesce(c, F.lit(0)) for c in ("approved", "rejected", "submitted", "pending"))
    d, li, e = (F.coalesce(c, F.lit(0)) for c in ("n_direct", "n_list", "n_error"))
    # Feedback weights and clamps.
    gain = a * 1.5 + s * 2.0 + p * 0.1 - r * 2.5
    score = (
        F.greatest(F.lit(-6.0), F.least(F.lit(6.0), gain))
        + F.when(F.col("approved").isNotNull() & (r >= a + s + p + 2), -2.0).otherwise(0.0)
        + F.when((li >= 6) & (d == 0), -4.0)
        .when(F.col("n_list").isNotNull() & (li >= F.greatest(F.lit(4), d * 4)), -2.5)
        .otherwise(0.0)
        + F.when(e >= 3, -1.5).otherwise(0.0)
    )
    return both.select(
        "source_domain",
        F.round(F.greatest(F.lit(-8.0), F.least(F.lit(6.0), score)), 3).alias("domain_score"),
    )


def avoid_domains(recent_counts: DataFrame, feedback: DataFrame, most: int = 3) -> DataFrame:
    """Two most fetched domains, then two often rejected ones, distinct, first three.

    Both inputs are cut to two rows by a plain limit before they meet.
    """
    # Two of each kind, two rejections at least.
    busy = (
        recent_counts.orderBy(F.col("recent_count").desc(), "source_domain").limit(2)
        .select("source_domain", F.lit(0).alias("kind"), (-F.col("recent_count")).alias("by"))
    )
    bad = (
        feedback.filter("rejected >= 2 AND approved = 0 AND submitted = 0")
        .orderBy(F.col("rejected").desc(), "source_domain").limit(2)
        .select("source_domain", F.lit(1).alias("kind"), (-F.col("rejected")).alias("by"))
    )
    first = busy.unionByName(bad).groupBy("source_domain").agg(
        F.min(F.struct("kind", "by", "source_domain")).alias("k")
    )
    w = W.orderBy("k")
    return first.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= most).select(
        "source_domain", "position"
    )
