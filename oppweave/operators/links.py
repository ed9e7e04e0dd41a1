"""Links of stored pages, their scores and caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vocab as v
from ..functions.ranks import top_n
from ..functions.text import clean, clip, has, let, nonblank, num
from ..functions.urls import canonical_url, domain, hostname, path, resolve
from .hits import detail_path
from .history import history_lookup
from .pages import decode_entities, strip_tags

ANCHOR = r"(?is)<a(?!\w)[^>]*href=[\"']([^\"']+)[\"'][^>]*>(.*?)</a>"


def link_score(anchor: Column, p: Column, same_domain: Column, crawl: bool = False) -> Column:
    """Promise of a link by its anchor text and path."""
    both = F.concat_ws(" ", anchor, p)
    plural = has(anchor, v.PLURAL)
    # Link points.
    score = (
        num(has(anchor, r"\bscholarship\b"), 3.0)
        + num(has(anchor, r"\baward\b|\bgrant\b"), 2.0)
        + num(has(anchor, r"\bfellowship\b"), 1.0)
        + num(detail_path(F.lower(p)), 4.0)
        + num(has(p, "/scholarships?/"), 2.0)
        + num((anchor != "") & ~plural, 1.0)
        + num(has(both, v.LINK_STAGE), 1.5)
        + num(has(both, v.LINK_GRADUATE), -2.5)
    )
    if crawl:
        return score + num(has(p, "/search/"), 1.0) + num(plural, -1.0)
    return score + num(~same_domain, -0.5)


def page_links(
    pages: DataFrame, keep: str = v.LINK_KEEP, drop: str = v.LINK_DROP, crawl: bool = False
) -> DataFrame:
    """One row per usable anchor of each page.

    The bundle form keeps links to any host; the crawl form keeps the page's own
    host.  ``keep`` and ``drop`` are word patterns on anchor text and path.
    """

    def describe(anchor: Column, i: Column) -> Column:
        raw = F.struct(
            clean(decode_entities(F.regexp_extract(anchor, ANCHOR, 1))).alias("href"),
            clean(decode_entities(strip_tags(F.regexp_extract(anchor, ANCHOR, 2)))).alias("text"),
        )

        def locate(a: Column) -> Column:
            target = F.when(
                (a["href"] != "") & ~has(a["href"], v.LINK_SKIP), resolve(a["href"], F.col("src_url"))
            )
            return let(
                target,
                lambda t: let(
                    F.struct(path(t).alias("path"), hostname(t).alias("host")),
                    lambda u: F.struct(
                        t.alias("target"), a["text"].alias("text"), F.lower(u["path"]).alias("path"),
                        u["path"].alias("raw_path"), canonical_url(t).alias("url"),
                        F.regexp_replace(u["host"], r"^www\.", "").alias("domain"), u["host"].alias("host"),
                        (i + 1).alias("position"),
                    ),
                ),
            )

        return let(raw, locate)

    def usable(x: Column) -> Column:
        words = F.concat_ws(" ", x["text"], x["raw_path"])
        fresh = (
            (x["target"] != F.col("src_url")) & (x["host"] == F.col("src_host"))
            if crawl
            else x["url"] != F.col("src_canonical")
        )
        return (
            x["target"].rlike("(?i)^https?://") & fresh & ~has(x["raw_path"], v.LINK_FILE)
            & ~has(words, drop) & has(words, keep)
        )

    def shape(x: Column) -> Column:
        same = x["host"] == F.col("src_host")
        label = F.coalesce(
            nonblank(x["text"]), nonblank(F.element_at(F.split(x["raw_path"], "/"), -1)), x["url"]
        )
        return F.struct(
            x["position"].alias("position"),
            (x["target"] if crawl else x["url"]).alias("url"),
            clip(label, 120).alias("anchor_text"),
            x["domain"].alias("source_domain"),
            same.alias("same_domain"),
            detail_path(x["path"]).alias("detail_path_likely"),
            F.round(link_score(x["text"], x["raw_path"], same, crawl), 3).alias("score"),
        )

    # Anchors are shaped and dropped inside the row, so no filter is pushed below
    # and computed twice; only usable links leave the page's row.
    src = pages.select(
        "page_id",
        F.trim("url").alias("src_url"),
        hostname("url").alias("src_host"),
        canonical_url("url").alias("src_canonical"),
        F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(ANCHOR), F.lit(0)).alias("anchors"),
    )
    # The outer form, as Spark would filter pages by their usable links first, and so shape all anchors once more.
    return src.select(
        "page_id",
        "src_url",
        F.inline_outer(F.transform(F.filter(F.transform("anchors", describe), usable), shape)),
    ).filter("position IS NOT NULL")


def mark_seen(links: DataFrame, history: DataFrame, as_of: str) -> DataFrame:
    """Add ``seen_recently`` by the fetch history's TTL rule."""
    looked = history_lookup(links.withColumn("normalized_url", canonical_url("url")), history, as_of)
    return looked.withColumnRenamed("skip", "seen_recently").drop(
        "normalized_url", "page_type", "age_hours", "ttl_hours"
    )


def best_links(links: DataFrame, per_page: int | None = None) -> DataFrame:
    """Best-scored link per page and URL, then the best ``per_page`` of each page, or all of them."""
    order = [F.col("score").desc(), F.col("position").asc()]
    best = top_n(links, ["page_id", "url"], order, 1, "__rn").drop("__rn")
    return top_n(best, ["page_id"], order, per_page, "page_rank")


def cap_links(links: DataFrame, batches: DataFrame, per_page: int | None, total: int) -> DataFrame:
    """``best_links`` further cut to ``total`` per batch, in page order.

    ``batches(batch_id, page_id, page_ord)``.  Every page that still counts brings
    at least one link, so only the first ``total`` linked pages of a batch matter.
    """
    best = best_links(links, per_page)
    sizes = best.groupBy("page_id").agg(F.count("*").alias("n"))
    first = top_n(
        batches.join(sizes, "page_id"), ["batch_id"], [F.col("page_ord")], total, "__rn"
    ).drop("__rn")
    before = W.partitionBy("batch_id").orderBy("page_ord").rowsBetween(W.unboundedPreceding, -1)
    room = first.select(
        "batch_id", "page_id", (F.lit(total) - F.coalesce(F.sum("n").over(before), F.lit(0))).alias("room")
    )
    return best.join(room, "page_id").filter(F.col("page_rank") <= F.col("room")).drop("room")


def link_counts(links: DataFrame, per_page: int | None = None) -> DataFrame:
    """Distinct links per page and whether one of them, or of the best ``per_page``, leads to an original source."""
    source = ~F.col("same_host") & (
        has("anchor_text", v.LINK_SOURCE_ANCHOR) | F.col("detail_path_likely")
    )
    totals = links.groupBy("page_id").agg(F.count_distinct("url").alias("n_links"))
    host = F.regexp_replace(hostname("src_url"), r"^www\.", "")
    top = best_links(links, per_page).withColumn(
        "same_host", (F.col("source_domain") == host) | (F.col("source_domain") == "")
    )
    sources = top.groupBy("page_id").agg(F.max(source).alias("source_link"))
    return totals.join(sources, "page_id", "left")
