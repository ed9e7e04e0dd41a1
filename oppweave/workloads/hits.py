"""Search hits, URLs, frontier and fetch history."""

from pyspark.sql import functions as F

from ..functions import vocab as v
from ..operators import history as h
from ..operators import hits as o
from ..operators import urls as u
from ..session import deal_rows
from .registry import query
from .tables import (
    AS_OF, EVENTS_SQL, HITS_SQL, event_updates, history, hits, table,
)

# Canonical form, restated with plain regexes.
URL_SQL = r"""
 raw AS (SELECT page_id ord, url variant, regexp_extract(url, '^(https?)://', 1) sch,
   regexp_extract(url, '^https?://([^/?#]+)', 1) host,
   regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/+$', '') p,
   regexp_extract(url, '^[^?#]*\?([^#]*)', 1) q FROM pages),
 canon AS (SELECT ord, variant, regexp_replace(lower(host), '^www\.', '') source_domain,
   sch || '://' || lower(host) || CASE WHEN p = '' THEN '/' ELSE p END ||
   CASE WHEN len(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '(?i)^(utm_|fbclid|gclid|mc_cid|mc_eid|ref|source)(=|$)'))) = 0 THEN ''
   ELSE '?' || array_to_string(list_filter(string_split(q, '&'), lambda x: NOT regexp_matches(x, '(?i)^(utm_|fbclid|gclid|mc_cid|mc_eid|ref|source)(=|$)')), '&') END canonical_url,
   lower(CASE WHEN p = '' THEN '/' ELSE p END) path, CASE WHEN p = '' THEN '/' ELSE p END || '' raw_path FROM raw)
"""


def _page_urls(spark, sf):
    return u.canonical_urls(table(spark, sf, "pages"), "url", "page_id")


@query(
    "canonical_urls",
    f"""WITH {URL_SQL} SELECT canonical_url, source_domain, min(ord) first_ord, arg_min(variant, ord) first_variant,
 count(*) n_rows, count(DISTINCT variant) n_variants,
 array_to_string(string_split(source_domain, '.')[-2:], '.') base_domain FROM canon GROUP BY 1, 2""",
)
def canonical_urls(spark, sf):
    return _page_urls(spark, sf)


@query(
    "canonical_domain_counts",
    f"""WITH {URL_SQL}, c AS (SELECT canonical_url, source_domain, count(*) n FROM canon GROUP BY 1, 2)
 SELECT source_domain, array_to_string(string_split(source_domain, '.')[-2:], '.') base_domain,
 count(*) n_urls, sum(n)::BIGINT n_rows FROM c GROUP BY 1, 2""",
)
def canonical_domain_counts(spark, sf):
    return u.domain_counts(_page_urls(spark, sf))


@query(
    "surface_mix",
    f"""WITH {URL_SQL},
 p AS (SELECT ord, source_domain, lower(regexp_extract(variant, '^https?://[^/?#]+([^?#]*)', 1)) path FROM canon),
 s AS (SELECT ord % 7 run_id, source_domain, CASE
   WHEN regexp_matches(path, '{v.LIST_CUES}') THEN 'list_likely'
   WHEN source_domain LIKE 'blog.%' OR path LIKE '%/blog/%' THEN 'list_likely'
   WHEN regexp_matches(path, '{v.CATEGORY_PATH}') THEN 'list_likely'
   WHEN regexp_matches(path, '{v.HUB_CUES}') THEN 'hub_likely'
   WHEN regexp_matches(path, '{v.KEYWORD}') THEN 'direct_likely' ELSE 'other' END surface_type FROM p)
 SELECT run_id, source_domain, surface_type, count(*) n_hits FROM s GROUP BY ALL""",
)
def surface_mix(spark, sf):
    pages = table(spark, sf, "pages").select(
        (F.col("page_id") % 7).alias("run_id"), "url", F.lit("").alias("title"), F.lit("").alias("snippet")
    )
    return o.surface_mix(pages, ["run_id"])


@query(
    "dedupe_hits",
    f"""WITH {HITS_SQL} SELECT run_id, normalized_url, source_domain, surface_type, fit_score, novelty_score,
 provider_rank, ord, first_ord FROM ded""",
)
def dedupe_hits(spark, sf):
    return o.dedupe_hits(hits(spark, sf)).select(
        "run_id", "normalized_url", "source_domain", "surface_type", "fit_score", "novelty_score",
        "provider_rank", "ord", "first_ord",
    )


def _ranked(spark, sf, *columns):
    found = hits(spark, sf)
    return o.rank_hits(o.dedupe_hits(found.select(*columns) if columns else found), tie="first_ord")


@query("rank_hits", f"WITH {HITS_SQL} SELECT run_id, normalized_url, fit_score, novelty_score, rank FROM ranked")
def rank_hits(spark, sf):
    return _ranked(spark, sf).select("run_id", "normalized_url", "fit_score", "novelty_score", "rank")


@query(
    "rank_hits_discovery",
    f"""WITH {HITS_SQL} SELECT run_id, normalized_url, row_number() OVER (PARTITION BY run_id ORDER BY fit_score DESC,
 CASE surface_type WHEN 'direct_likely' THEN 0 WHEN 'hub_likely' THEN 1 WHEN 'list_likely' THEN 2 ELSE 3 END,
 pass_priority, novelty_score DESC, first_ord) AS rank FROM ded""",
)
def rank_hits_discovery(spark, sf):
    d = o.dedupe_hits(hits(spark, sf)).withColumn("global_rank", F.col("first_ord"))
    return o.rank_hits(d, "discovery", "first_ord").select("run_id", "normalized_url", "rank")


@query(
    "same_domain_flag",
    f"""WITH {HITS_SQL} SELECT run_id, normalized_url, rank,
 row_number() OVER (PARTITION BY run_id, source_domain ORDER BY rank) > 1 AS same_domain_as_prior FROM ranked""",
)
def same_domain_flag(spark, sf):
    # What is not returned and orders nothing would be moved and written with every row.
    read = ("run_id", "ord", "normalized_url", "source_domain", "fit_score", "novelty_score", "provider_rank")
    return o.same_domain_flag(_ranked(spark, sf, *read)).select(
        "run_id", "normalized_url", "rank", "same_domain_as_prior"
    )


FRONTIER_SQL = f"""{HITS_SQL},
 s AS (SELECT *, row_number() OVER (PARTITION BY run_id, surface_type ORDER BY rank) rs FROM ranked),
 pick AS (SELECT * FROM s WHERE rs <= CASE surface_type WHEN 'direct_likely' THEN 18 WHEN 'hub_likely' THEN 6 WHEN 'list_likely' THEN 8 ELSE 6 END),
 n AS (SELECT run_id, count(*) n FROM pick GROUP BY 1),
 rest AS (SELECT s.*, row_number() OVER (PARTITION BY s.run_id ORDER BY s.rank) rr FROM s ANTI JOIN pick USING (run_id, normalized_url)),
 allf AS (SELECT run_id, normalized_url, surface_type, rank, false AS backfill FROM pick
   UNION ALL SELECT r.run_id, normalized_url, surface_type, rank, true FROM rest r JOIN n ON n.run_id = r.run_id WHERE rr <= 38 - n.n),
 frontier AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY backfill, rank) frontier_position FROM allf)
"""


@query(
    "initial_frontier",
    f"WITH {FRONTIER_SQL} SELECT run_id, normalized_url, surface_type, rank, backfill, frontier_position FROM frontier",
)
def initial_frontier(spark, sf):
    return o.initial_frontier(_ranked(spark, sf)).select(
        "run_id", "normalized_url", "surface_type", "rank", "backfill", "frontier_position"
    )


@query(
    "frontier_counts",
    f"""WITH {FRONTIER_SQL} SELECT run_id, count(*) FILTER (surface_type = 'direct_likely') n_direct_likely,
 count(*) FILTER (surface_type = 'hub_likely') n_hub_likely, count(*) FILTER (surface_type = 'list_likely') n_list_likely,
 count(*) FILTER (surface_type = 'other') n_other FROM frontier GROUP BY 1""",
)
def frontier_counts(spark, sf):
    return o.frontier_counts(o.initial_frontier(_ranked(spark, sf)))


@query(
    "search_quality",
    f"""WITH {HITS_SQL}, a AS (SELECT run_id, count(*) n_hits, count(*) FILTER (surface_type = 'direct_likely') n_direct_likely,
 count(*) FILTER (surface_type = 'hub_likely') n_hub_likely, count(*) FILTER (surface_type = 'list_likely') n_list_likely,
 count(*) FILTER (surface_type = 'other') n_other, count(*) FILTER (specific_school) n_school,
 count(*) FILTER (institution_specific) n_institution, count(*) FILTER (stale_cycle) n_stale,
 count(*) FILTER (indirect_content) n_indirect, count(DISTINCT source_domain) n_domains FROM ranked GROUP BY 1),
 b AS (SELECT run_id, round(avg((surface_type = 'direct_likely')::INT), 3) direct_share_top,
 string_agg(normalized_url, ' ' ORDER BY rank) top_urls FROM ranked WHERE rank <= 10 GROUP BY 1)
 SELECT * FROM a LEFT JOIN b USING (run_id)""",
)
def search_quality(spark, sf):
    return o.search_quality(_ranked(spark, sf))


@query(
    "frontier_weakness",
    f"""WITH {HITS_SQL}, c AS (SELECT run_id, count(*) FILTER (surface_type = 'direct_likely' AND fit_score >= 7) strong_direct,
 count(*) FILTER (surface_type = 'hub_likely' AND fit_score >= 6) strong_programs, count(*) FILTER (fit_score >= 6) high_fit,
 count(*) FILTER (surface_type IN ('direct_likely', 'hub_likely')) direct_like FROM ranked WHERE rank <= 15 GROUP BY 1)
 SELECT *, strong_direct + strong_programs < 3 OR high_fit < 6 OR direct_like < 4 AS weak FROM c""",
)
def frontier_weakness(spark, sf):
    return o.frontier_weakness(_ranked(spark, sf))


@query(
    "union_passes",
    f"""WITH {HITS_SQL}, u AS (SELECT run_id, normalized_url, ord, 'specific' AS pass, 0 p, 0 i FROM hits WHERE provider_rank <= 3
 UNION ALL SELECT run_id, normalized_url, ord, 'generic', 2, 1 FROM hits WHERE provider_rank > 3)
 SELECT run_id, normalized_url, ord, pass, p AS pass_priority, row_number() OVER (PARTITION BY run_id ORDER BY i, ord) global_rank FROM u""",
)
def union_passes(spark, sf):
    a = hits(spark, sf).select("run_id", "normalized_url", "ord", "provider_rank")
    low = F.col("provider_rank") <= 3
    return o.union_passes([(a.filter(low), "specific", 0), (a.filter(~low), "generic", 2)]).drop("provider_rank")


@query(
    "merge_expansion",
    f"""WITH {HITS_SQL}, b AS (SELECT run_id, normalized_url, row_number() OVER (PARTITION BY run_id ORDER BY first_ord) global_rank FROM
   (SELECT run_id, normalized_url, min(ord) first_ord FROM hits WHERE provider_rank <= 5 GROUP BY 1, 2)),
 e AS (SELECT run_id, normalized_url, min(ord) o FROM hits WHERE provider_rank > 5 GROUP BY 1, 2),
 x AS (SELECT * FROM e ANTI JOIN b USING (run_id, normalized_url)), n AS (SELECT run_id, count(*) n FROM b GROUP BY 1)
 SELECT run_id, normalized_url, global_rank FROM b UNION ALL
 SELECT x.run_id, normalized_url, coalesce(n.n, 0) + row_number() OVER (PARTITION BY x.run_id ORDER BY o) FROM x LEFT JOIN n ON n.run_id = x.run_id""",
)
def merge_expansion(spark, sf):
    a = hits(spark, sf).select("run_id", "normalized_url", "ord", "provider_rank")
    base = o.full_rank(
        a.filter("provider_rank <= 5").groupBy("run_id", "normalized_url").agg(F.min("ord").alias("ord")),
        ["run_id"], [F.col("ord")], "global_rank",
    )
    extra = a.filter("provider_rank > 5").drop("provider_rank")
    return o.merge_expansion(base, extra).select("run_id", "normalized_url", "global_rank")


@query(
    "domain_hints",
    f"""WITH {URL_SQL} SELECT ord, source_domain,
 source_domain = 'therha.example.com' OR source_domain LIKE '%.therha.example.com' OR source_domain LIKE '%.example.net' OR source_domain = 'example.net' AS allowed_domain
 FROM canon WHERE NOT (source_domain = 'spam-farm.example.org' OR source_domain LIKE '%.spam-farm.example.org'
   OR source_domain LIKE '%.ththan.example.net' OR source_domain = 'ththan.example.net')""",
)
def domain_hints(spark, sf):
    pages = table(spark, sf, "pages").select(
        F.col("page_id").alias("ord"), o.domain("url").alias("source_domain")
    )
    allow = spark.createDataFrame([("site:therha.example.com",), ("https://example.net/",)], "hint string")
    deny = spark.createDataFrame([("spam-farm.example.org",), ("ththan.example.net",)], "hint string")
    return o.domain_hints(pages, allow, deny)


@query(
    "distinct_ci",
    """SELECT lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) value_key, arg_min(p_name, p_partkey) AS value, count(*) n_rows
 FROM part GROUP BY 1""",
)
def distinct_ci(spark, sf):
    return o.distinct_ci(table(spark, sf, "part"), "p_name", ["p_partkey"])


# ---- fetch history ---------------------------------------------------------------------------

LOOKUP_SQL = f"""{EVENTS_SQL},
 probe AS (SELECT c_custkey AS rank, c_custkey // 10 run_id, 'https://u' || c_custkey || '.example.net/' normalized_url,
   c_acctbal / 500 fit_score, CASE WHEN c_nationkey % 2 = 0 THEN 'direct_likely' ELSE 'list_likely' END surface_type FROM customer),
 look AS (SELECT p.*, CASE WHEN h.last_fetched_at IS NULL THEN 'unknown' ELSE h.page_type END page_type,
   round(epoch(TIMESTAMP '{AS_OF}' - h.last_fetched_at) / 3600, 3) age_hours,
   CASE WHEN h.last_fetched_at IS NOT NULL THEN CASE h.page_type WHEN 'direct_scholarship' THEN 24.0 WHEN 'scholarship_list_page' THEN 12
     WHEN 'not_scholarship_page' THEN 72 WHEN 'fetch_error' THEN 6 ELSE 24 END END ttl_hours
   FROM probe p LEFT JOIN history h USING (normalized_url)),
 looked AS (SELECT *, coalesce(age_hours < ttl_hours, false) AS skip FROM look)
"""


def _looked(spark, sf):
    c = table(spark, sf, "customer")
    probe = c.select(
        F.col("c_custkey").alias("rank"),
        F.floor(F.col("c_custkey") / 10).alias("run_id"),
        F.concat(F.lit("https://u"), F.col("c_custkey"), F.lit(".example.net/")).alias("normalized_url"),
        (F.col("c_acctbal") / 500).alias("fit_score"),
        F.when(F.col("c_nationkey") % 2 == 0, "direct_likely").otherwise("list_likely").alias("surface_type"),
    )
    return h.history_lookup(probe, history(spark, sf), AS_OF)


@query(
    "history_lookup",
    f"WITH {LOOKUP_SQL} SELECT run_id, normalized_url, page_type, age_hours, ttl_hours, skip FROM looked",
)
def history_lookup(spark, sf):
    return _looked(spark, sf).select(
        "run_id", "normalized_url", "page_type", F.round("age_hours", 3).alias("age_hours"), "ttl_hours", "skip"
    )


GATE_SQL = LOOKUP_SQL + """, gated AS (SELECT *, CASE WHEN fit_score >= 11 AND page_type IN ('direct_scholarship', 'scholarship_list_page')
   AND (age_hours IS NULL OR age_hours >= 2) THEN 'bypass' WHEN skip THEN 'skip' ELSE 'fetch' END decision FROM looked)"""


@query("history_gate", f"WITH {GATE_SQL} SELECT run_id, normalized_url, page_type, decision FROM gated")
def history_gate(spark, sf):
    return h.history_gate(_looked(spark, sf), "rerun").select(
        "run_id", "normalized_url", "page_type", "decision"
    )


@query(
    "weakness_after_history",
    f"""WITH {GATE_SQL}, c AS (SELECT run_id, count(*) n_frontier, count(*) FILTER (decision <> 'skip') n_fetchable,
 count(*) FILTER (decision = 'skip') n_skipped,
 count(*) FILTER (decision <> 'skip' AND surface_type IN ('direct_likely', 'hub_likely')) n_direct_like,
 count(*) FILTER (decision <> 'skip' AND surface_type = 'list_likely') n_list_like FROM gated GROUP BY 1)
 SELECT *, n_fetchable = 0 OR n_direct_like < 3 OR n_fetchable < 5 OR n_skipped > n_fetchable
   OR (n_list_like >= n_fetchable AND n_direct_like = 0) AS weak FROM c""",
)
def weakness_after_history(spark, sf):
    return o.weakness_after_history(h.history_gate(_looked(spark, sf), "rerun"))


_TTL = "CASE tb " + " ".join(f"WHEN '{k}' THEN {t}" for k, t in v.PAGE_TYPE_TTL_HOURS.items()) + " END"


@query(
    "recent_fetches",
    f"""WITH {EVENTS_SQL}, hist AS (SELECT DISTINCT 'https://u' || user_id || '.example.net/' normalized_url, TIMESTAMP '2023-12-31 20:00:00' hf, CASE WHEN user_id % 2 = 0 THEN 'fetch_error' ELSE '' END hp FROM events WHERE user_id % 3 > 0),
 b AS (SELECT ord, u.normalized_url, last_seen_at, coalesce(last_value(last_fetched_at IGNORE NULLS) OVER w, hf) fb, coalesce(last_value(nullif(trim(page_type), '') IGNORE NULLS) OVER w, nullif(hp, ''), 'unknown') tb
   FROM updates u LEFT JOIN hist USING (normalized_url) WINDOW w AS (PARTITION BY u.normalized_url ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 a AS (SELECT *, CASE WHEN fb IS NOT NULL THEN greatest(0, (epoch(last_seen_at) - epoch(fb)) / 3600) END age FROM b)
 SELECT ord, normalized_url, tb type_before, round(age, 4) age_hours, coalesce(age < {_TTL}, false) AS skip FROM a""",
)
def recent_fetches(spark, sf):
    """Every fetch event against its URL's record at that moment."""
    users = table(spark, sf, "events").filter("user_id % 3 > 0").select("user_id").distinct()
    hist = users.select(
        F.concat(F.lit("https://u"), "user_id", F.lit(".example.net/")).alias("normalized_url"),
        F.lit("2023-12-31 20:00:00").cast("timestamp").alias("last_fetched_at"), F.when(F.col("user_id") % 2 == 0, "fetch_error").otherwise("").alias("page_type"),
    )
    got = h.recent_fetches(hist, event_updates(spark, sf))
    return got.select("ord", "normalized_url", "type_before", F.round("age_hours", 4).alias("age_hours"), "skip")


REVISIT_SQL = f"""
WITH {EVENTS_SQL},
 f AS (SELECT user_id // 10 run_id, event_id AS rank, normalized_url, CASE WHEN event_id % 500 = 0 THEN 'fetch' ELSE 'skip' END decision,
   page_type, round(epoch(TIMESTAMP '{AS_OF}' - last_fetched_at) / 3600, 3) age_hours
   FROM updates JOIN events ON event_id = ord),
 c AS (SELECT run_id, count(*) FILTER (decision <> 'skip') n, count(*) FILTER (decision = 'skip') k FROM f GROUP BY 1),
 b AS (SELECT run_id, least(6, greatest(1, least(CASE WHEN n = 0 THEN 6 ELSE greatest(1, 6 - n) END, k))) budget FROM c
   WHERE k > 0 AND n < 6),
 r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY (page_type = 'direct_scholarship')::INT, age_hours DESC, rank) revisit_rank
   FROM f WHERE decision = 'skip' AND page_type IN ('direct_scholarship', 'scholarship_list_page'))
"""


@query(
    "select_revisits",
    REVISIT_SQL + " SELECT r.run_id, rank, page_type, age_hours, revisit_rank FROM r JOIN b ON b.run_id = r.run_id WHERE revisit_rank <= budget",
)
def select_revisits(spark, sf):
    up = event_updates(spark, sf)
    age = F.lit(AS_OF).cast("timestamp").cast("double") - F.col("last_fetched_at").cast("double")
    users = table(spark, sf, "events").select(F.col("event_id").alias("ord"), "user_id")
    gated = up.join(users, "ord").select(
        F.floor(F.col("user_id") / 10).alias("run_id"),
        F.col("ord").alias("rank"),
        "page_type",
        F.round(age / 3600, 3).alias("age_hours"),
        F.when(F.col("ord") % 500 == 0, "fetch").otherwise("skip").alias("decision"),
    )
    return h.select_revisits(gated, fresh_start=True).select(
        "run_id", "rank", "page_type", "age_hours", "revisit_rank"
    )


@query(
    "upsert_history",
    f"""WITH {EVENTS_SQL} SELECT normalized_url, url, source_domain, page_type, last_seen_at, last_fetched_at,
 last_search_query, last_error, candidate_id FROM history""",
)
def upsert_history(spark, sf):
    return history(spark, sf).drop("candidate_name")


@query(
    "domain_feedback",
    """SELECT 'c' || (o_custkey % 500) || '.example.org' source_domain, count(*) FILTER (o_orderstatus = 'F' AND o_totalprice <= 400000) approved,
 count(*) FILTER (o_orderstatus = 'P') rejected, count(*) FILTER (o_orderstatus = 'F' AND o_totalprice > 400000) submitted,
 count(*) FILTER (o_orderstatus = 'O') pending FROM orders GROUP BY 1""",
)
def domain_feedback(spark, sf):
    return h.domain_feedback(candidates_by_domain(spark, sf))


def candidates_by_domain(spark, sf):
    s = F.col("o_orderstatus")
    return table(spark, sf, "orders").select(
        F.concat(F.lit("www.C"), F.col("o_custkey") % 500, F.lit(".example.org")).alias("source_domain"),
        F.when((s == "F") & (F.col("o_totalprice") > 400000), "submitted").when(s == "F", "approved")
        .when(s == "P", "rejected").otherwise("new").alias("status"),
    )


def _event_history(spark, sf):
    """Every event as a history row, so that windows have something to cut."""
    return event_updates(spark, sf)


RECENT_SQL = f"{EVENTS_SQL}, rec AS (SELECT * FROM updates WHERE last_fetched_at IS NOT NULL AND last_fetched_at >= TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY)"
YIELD_SQL = RECENT_SQL + """, y AS (SELECT source_domain, count(*) FILTER (page_type = 'direct_scholarship') n_direct,
 count(*) FILTER (page_type = 'scholarship_list_page') n_list, count(*) FILTER (page_type = 'fetch_error') n_error,
 count(*) FILTER (page_type NOT IN ('direct_scholarship', 'scholarship_list_page', 'fetch_error')) n_other FROM rec GROUP BY 1)"""


@query("domain_yield", f"WITH {YIELD_SQL} SELECT * FROM y")
def domain_yield(spark, sf):
    return h.domain_yield(_event_history(spark, sf), AS_OF)


@query(
    "recent_domain_counts",
    f"""WITH {RECENT_SQL} SELECT source_domain, count(*) recent_count FROM rec
 WHERE page_type IN ('direct_scholarship', 'scholarship_list_page') GROUP BY 1""",
)
def recent_domain_counts(spark, sf):
    return h.recent_domain_counts(
        _event_history(spark, sf), AS_OF, ["direct_scholarship", "scholarship_list_page"]
    )


FEED_SQL = """ fb AS (SELECT CASE WHEN o_orderstatus = 'P' AND o_custkey % 11 = 0 THEN 'r' || (o_custkey % 3) ELSE 'u' || (o_custkey % 30) END || '.example.net' source_domain, count(*) FILTER (o_orderstatus = 'F') approved,
 count(*) FILTER (o_orderstatus = 'P') rejected, 0 submitted, count(*) FILTER (o_orderstatus = 'O') pending FROM orders
 GROUP BY 1)"""


def _feedback(spark, sf):
    s = F.col("o_orderstatus")
    return h.domain_feedback(
        table(spark, sf, "orders").select(
            F.concat(
                F.when((s == "P") & (F.col("o_custkey") % 11 == 0), F.concat(F.lit("r"), F.col("o_custkey") % 3))
                .otherwise(F.concat(F.lit("u"), F.col("o_custkey") % 30)),
                F.lit(".example.net"),
            ).alias("source_domain"),
            F.when(s == "F", "approved").when(s == "P", "rejected").otherwise("pending").alias("status"),
        )
    )


@query(
    "domain_score",
    f"""WITH {YIELD_SQL}, {FEED_SQL} SELECT coalesce(fb.source_domain, y.source_domain) source_domain,
 round(greatest(-8, least(6, CASE WHEN approved IS NULL THEN 0 ELSE greatest(-6, least(6, approved * 1.5 + pending * 0.1 - rejected * 2.5))
   + CASE WHEN rejected >= approved + pending + 2 THEN -2 ELSE 0 END END
   + CASE WHEN n_list IS NULL THEN 0 WHEN n_list >= 6 AND n_direct = 0 THEN -4 WHEN n_list >= greatest(4, n_direct * 4) THEN -2.5 ELSE 0 END
   + CASE WHEN n_error >= 3 THEN -1.5 ELSE 0 END))::DOUBLE, 3) domain_score
 FROM fb FULL JOIN y ON fb.source_domain = y.source_domain""",
)
def domain_score(spark, sf):
    return h.domain_score(_feedback(spark, sf), h.domain_yield(_event_history(spark, sf), AS_OF))


@query(
    "avoid_domains",
    f"""WITH {RECENT_SQL}, {FEED_SQL},
 b AS (SELECT source_domain, 0 kind, -count(*) k FROM rec GROUP BY 1 ORDER BY k, 1 LIMIT 2),
 r AS (SELECT source_domain, 1 kind, -rejected k FROM fb WHERE rejected >= 2 AND approved = 0 ORDER BY k, 1 LIMIT 2),
 x AS (SELECT source_domain, min(kind) kind, arg_min(k, kind) k FROM (SELECT * FROM b UNION ALL SELECT * FROM r) GROUP BY 1)
 SELECT source_domain, row_number() OVER (ORDER BY kind, k, source_domain) AS position FROM x QUALIFY row_number() OVER (ORDER BY kind, k, source_domain) <= 3""",
)
def avoid_domains(spark, sf):
    return h.avoid_domains(h.recent_domain_counts(_event_history(spark, sf), AS_OF), _feedback(spark, sf))


# ---- hit scores on whole documents -----------------------------------------------------------


def _re(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, '(?i){pattern}')".replace("master'?s", "master''?s")


def _tag_sql(text: str, rules) -> str:
    parts = [f"CASE WHEN {_re(text, p)} THEN {vals!r} ELSE []::VARCHAR[] END" for p, vals in rules]
    return "list_distinct(flatten([" + ", ".join(parts) + "]))"


SCORE_SQL = f"""
WITH st AS (SELECT * FROM (VALUES {", ".join(f"('{k}', '{n}')" for k, n in v.STATES.items())}) t(code, name)),
 d AS (SELECT doc_id, doc_id % 100 profile_id, source, trim(regexp_replace(text, '[\\s   -     　﻿]+', ' ', 'g')) s,
   'https://' || source || '.example.org/doc/' || doc_id url, '/doc/' || doc_id path FROM documents),
 d2 AS (SELECT *, source || chr(10) || s || chr(10) || path AS l, source || ' ' || s || ' ' || path AS c FROM d),
 stm AS (SELECT doc_id, list(code) codes FROM (SELECT doc_id, code FROM d2, st
   WHERE regexp_matches(l, '(?i)\\b(' || code || '|' || replace(name, ' ', '\\s+') || ')\\b')) GROUP BY 1),
 f AS (SELECT d2.*, coalesce(codes, []::VARCHAR[]) states, {_tag_sql("l", v.MAJORS)} majors, {_tag_sql("l", v.ETHNICITIES)} eths,
   lower(c_mktsegment) major, CASE c_nationkey % 3 WHEN 0 THEN 'IN' WHEN 1 THEN 'OR' ELSE '' END st,
   CASE WHEN c_nationkey % 2 = 0 THEN 'starting_college' ELSE '' END stage
   FROM d2 JOIN customer ON c_custkey = profile_id LEFT JOIN stm ON stm.doc_id = d2.doc_id),
 g AS (SELECT *, len(list_filter(majors, lambda m: contains(major, m) OR contains(m, major))) > 0 mm,
   list_contains(states, st) AND st <> '' sm,
   len(list_filter(CASE WHEN stage <> '' THEN ['incoming college freshman','high school senior','first year college','undergraduate','freshman']
     ELSE ['undergraduate','college student'] END, lambda t: contains(lower(s), t) OR contains(lower(s), replace(t, 'freshman', 'freshmen')))) terms,
   {_re("c", v.LIST_CUES)} OR {_re("c", v.INDIRECT)} list_like, {_re("l", v.KEYWORD)} kw, {_re("l", v.HUB_CUES)} hub FROM f)
 SELECT doc_id, round((CASE WHEN list_like THEN -0.25 WHEN {_re("c", v.CENTER)} THEN 0.5 WHEN hub THEN 0.5 WHEN kw THEN 7 ELSE 0 END)
   + (CASE WHEN kw THEN 1.5 ELSE 0 END) + (CASE WHEN {_re("l", v.ACTION)} THEN 1.5 ELSE 0 END)
   - (CASE WHEN {_re("l", v.GENERIC_BLOG)} THEN 2 ELSE 0 END) - (CASE WHEN {_re("c", v.INDIRECT)} THEN 2.5 ELSE 0 END)
   - (CASE WHEN regexp_matches(c, '\\b20\\d\\d\\b') AND len(list_filter(regexp_extract_all(c, '\\b20\\d\\d\\b'), lambda y: y >= '2024')) = 0 AND {_re("c", v.STALE_WORDS)} THEN 4 ELSE 0 END)
   - (CASE WHEN {_re("l", v.INSTITUTION)} THEN 2.25 ELSE 0 END)
   + (CASE WHEN mm THEN 4 WHEN len(majors) > 0 THEN -1 ELSE 0 END)
   + (CASE WHEN len(eths) > 0 THEN -1.5 ELSE 0 END)
   + (CASE WHEN sm THEN 1.5 WHEN st <> '' AND len(states) > 0 THEN -0.5 ELSE 0 END) + 1.5 * terms
   + (CASE WHEN stage <> '' AND {_re("l", v.UPPERCLASS)} THEN -4.5 ELSE 0 END)
   + (CASE WHEN stage <> '' AND {_re("l", v.GRADUATE)} THEN -5 ELSE 0 END), 3)::DOUBLE fit_score,
   (12 - least(4, 0.5 * doc_id % 3) + CASE WHEN {_re("source || ' ' || path", v.KEYWORD)} THEN 0.5 ELSE 0 END)::DOUBLE novelty_score,
   array_to_string(list_sort(states), ' ') states FROM g
"""


@query("score_hits", SCORE_SQL.replace("0.5 * doc_id % 3", "0"))
def score_hits(spark, sf):
    d = deal_rows(table(spark, sf, "documents"), 500)  # each text is read by many patterns
    rows = d.select(
        "doc_id",
        (F.col("doc_id") % 100).alias("profile_id"),
        F.col("source").alias("title"),
        F.col("text").alias("snippet"),
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example.org/doc/"), F.col("doc_id")).alias("url"),
    )
    c = table(spark, sf, "customer")
    people = c.select(
        F.col("c_custkey").alias("profile_id"),
        F.lower("c_mktsegment").alias("intended_major"),
        F.lit(None).cast("string").alias("ethnicity"),
        F.when(F.col("c_nationkey") % 3 == 0, "Indiana").when(F.col("c_nationkey") % 3 == 1, "or").otherwise("").alias("state"),
        F.when(F.col("c_nationkey") % 2 == 0, "starting_college").otherwise("").alias("student_stage"),
        F.lit("").alias("grade_level"),
    )
    hist = history(spark, sf)
    counts = h.recent_domain_counts(hist, AS_OF)
    scored = o.score_hits(rows, people, hist, counts, AS_OF)
    return scored.select(
        "doc_id", "fit_score", "novelty_score", F.array_join(F.array_sort("states"), " ").alias("states")
    )
