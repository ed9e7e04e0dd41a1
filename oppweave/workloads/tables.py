"""Test tables read as the model tables the jobs expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import deal_rows, split_rows


# Tables whose rows cost much work each.
WIDE = {"pages", "documents"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return split_rows(df) if name in WIDE else df


# Offer rules derived from part types: (type, majors, minimum GPA).
PART_RULES = [
    ("ECONOMY", ["auto", "building supply"], 1.0),
    ("STANDARD", [], None),
    ("PROMO", ["household"], None),
    ("LARGE", ["machinery", "furniture"], 2.0),
    ("MEDIUM", ["mach"], None),
    ("SMALL", [], 3.0),
]


def profiles(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as profiles: segment is the major, balance gives the GPA."""
    c = table(spark, sf, "customer")
    return c.select(
        F.col("c_custkey").alias("profile_id"),
        F.lower("c_mktsegment").alias("intended_major"),
        F.when(F.col("c_nationkey") >= 3, F.concat(F.lit("group "), F.col("c_nationkey"))).alias("ethnicity"),
        F.when(F.col("c_acctbal") >= 0, F.format_string("%.2f", F.floor(F.col("c_acctbal") / 25) / 100)).alias("gpa"),
    )


def catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as offers: price is the award, type gives the rules."""
    p = table(spark, sf, "part")
    none = F.array().cast("array<string>")
    majors = F.lit(None).cast("array<string>")
    gpa = F.lit(None).cast("double")
    for kind, ms, g in PART_RULES:
        here = F.col("p_type") == kind
        majors = F.when(here, F.array(*[F.lit(m) for m in ms]) if ms else none).otherwise(majors)
        gpa = F.when(here, F.lit(g).cast("double")).otherwise(gpa)
    return p.select(
        F.col("p_partkey").alias("id"),
        F.col("p_partkey").alias("ord"),
        F.col("p_name").alias("name"),
        F.concat(F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.lit(".example.org")).alias("source_domain"),
        (F.col("p_size") > 45).alias("requires_account"),
        F.floor("p_retailprice").cast("double").alias("award_amount"),
        F.when(F.col("p_size") > 5, F.format_string("2026-%02d-15", F.col("p_size") % 12 + 1)).alias("deadline"),
        F.col("p_size").alias("effort_minutes"),
        gpa.alias("min_gpa"),
        F.coalesce(majors, none).alias("allowed_majors"),
        F.when(F.col("p_brand") == "Brand#7", F.array(F.lit("group 7"), F.lit("group 1"))).otherwise(none).alias("allowed_ethnicities"),
    )


CATALOG_SQL = """
 profiles AS (SELECT c_custkey profile_id, lower(c_mktsegment) intended_major,
   CASE WHEN c_nationkey >= 3 THEN 'group ' || c_nationkey END ethnicity,
   CASE WHEN c_acctbal >= 0 THEN floor(c_acctbal / 25) / 100 END gpa FROM customer),
 rules AS (SELECT * FROM (VALUES
   ('ECONOMY', ['auto','building supply'], 1.0::DOUBLE), ('STANDARD', []::VARCHAR[], NULL),
   ('PROMO', ['household'], NULL), ('LARGE', ['machinery','furniture'], 2.0),
   ('MEDIUM', ['mach'], NULL), ('SMALL', []::VARCHAR[], 3.0)) t(p_type, majors, min_gpa)),
 catalog AS (SELECT p_partkey id, p_partkey ord, p_name AS name, floor(p_retailprice)::DOUBLE award_amount,
   CASE WHEN p_size > 5 THEN '2026-' || lpad((p_size % 12 + 1)::VARCHAR, 2, '0') || '-15' END deadline,
   p_size effort_minutes, p_size > 45 requires_account, r.min_gpa,
   coalesce(r.majors, []::VARCHAR[]) allowed_majors,
   CASE WHEN p_brand = 'Brand#7' THEN ['group 7','group 1'] ELSE []::VARCHAR[] END allowed_ethnicities
   FROM part p LEFT JOIN rules r ON r.p_type = p.p_type),
 pairs AS (SELECT DISTINCT o_custkey profile_id, l_partkey id
   FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
"""


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """A customer's ordered parts as the queue of a profile."""
    li = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_partkey").alias("id"))
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("profile_id"))
    return li.join(o, li.l_orderkey == o.o_orderkey).select("profile_id", "id").distinct()


def hits(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as search hits: part is the page, supplier the domain."""
    li = table(spark, sf, "lineitem")
    flag = F.col("l_returnflag")
    surface = (
        F.when(flag == "A", "direct_likely").when(flag == "R", "hub_likely")
        .when(F.col("l_linestatus") == "O", "list_likely").otherwise("other")
    )
    return li.select(
        F.floor(F.col("l_orderkey") / 100).alias("run_id"),
        (((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1000003 + F.col("l_partkey")) * 10007
         + F.col("l_suppkey")).alias("ord"),
        F.concat(F.lit("https://s"), F.col("l_suppkey"), F.lit(".example.org/p/"), F.col("l_partkey")).alias("normalized_url"),
        F.concat(F.lit("s"), F.col("l_suppkey"), F.lit(".example.org")).alias("source_domain"),
        surface.alias("surface_type"),
        F.col("l_quantity").alias("fit_score"),
        F.round(F.col("l_discount") * 100).alias("novelty_score"),
        F.col("l_linenumber").alias("provider_rank"),
        (F.col("l_linenumber") % 3).alias("pass_priority"),
        (F.col("l_tax") > 0.04).alias("stage_match"),
        (F.col("l_tax") < 0.02).alias("specific_school"),
        (F.col("l_tax") < 0.04).alias("institution_specific"),
        (F.col("l_discount") > 0.08).alias("stale_cycle"),
        (F.col("l_discount") < 0.01).alias("indirect_content"),
    )


HITS_SQL = """
 hits AS (SELECT l_orderkey // 100 run_id, ((l_orderkey * 8 + l_linenumber) * 1000003 + l_partkey) * 10007 + l_suppkey ord,
   'https://s' || l_suppkey || '.example.org/p/' || l_partkey normalized_url,
   's' || l_suppkey || '.example.org' source_domain,
   CASE WHEN l_returnflag = 'A' THEN 'direct_likely' WHEN l_returnflag = 'R' THEN 'hub_likely'
     WHEN l_linestatus = 'O' THEN 'list_likely' ELSE 'other' END surface_type,
   l_quantity fit_score, round(l_discount * 100) novelty_score, l_linenumber provider_rank,
   l_linenumber % 3 pass_priority, l_tax > 0.04 stage_match, l_tax < 0.02 specific_school,
   l_tax < 0.04 institution_specific, l_discount > 0.08 stale_cycle, l_discount < 0.01 indirect_content
   FROM lineitem),
 ded AS (SELECT * EXCLUDE (rn) FROM (SELECT *, min(ord) OVER (PARTITION BY run_id, normalized_url) first_ord,
   row_number() OVER (PARTITION BY run_id, normalized_url ORDER BY fit_score DESC, novelty_score DESC, ord) rn FROM hits) WHERE rn = 1),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY fit_score DESC, novelty_score DESC, provider_rank, first_ord) AS rank FROM ded)
"""

AS_OF = "2024-01-31 00:00:00"

# Event types read as page types.
EVENT_PAGES = {
    "purchase": "direct_scholarship",
    "view": "scholarship_list_page",
    "error": "fetch_error",
    "click": "not_scholarship_page",
    "signup": "unknown",
}


def event_page_type():
    out = F.lit("unknown")
    for kind, page in EVENT_PAGES.items():
        out = F.when(F.col("event_type") == kind, page).otherwise(out)
    return out


def event_updates(spark: SparkSession, sf: str) -> DataFrame:
    """Events as fetch-history updates; the user is the page, blanks do not overwrite."""
    e = table(spark, sf, "events")
    user = F.col("user_id")
    url = F.concat(F.lit("https://u"), user, F.lit(".example.net/"))
    return e.select(
        F.col("event_id").alias("ord"),
        url.alias("normalized_url"),
        url.alias("url"),
        F.concat(F.lit("u"), user % 20, F.lit(".example.net")).alias("source_domain"),
        event_page_type().alias("page_type"),
        F.col("ts").cast("timestamp").alias("last_seen_at"),
        F.when(F.col("event_type") != "signup", F.col("ts").cast("timestamp")).alias("last_fetched_at"),
        F.when(F.col("value") > 20, F.col("props")).otherwise("").alias("last_search_query"),
        F.when(F.col("event_type") == "error", "failed").otherwise("").alias("last_error"),
        F.when(F.col("event_type") == "purchase", F.concat(F.lit("c"), F.col("event_id"))).otherwise("").alias("candidate_id"),
        F.lit("").alias("candidate_name"),
    )


EVENTS_SQL = """
 updates AS (SELECT event_id ord, 'https://u' || user_id || '.example.net/' normalized_url,
   'https://u' || user_id || '.example.net/' url, 'u' || (user_id % 20) || '.example.net' source_domain,
   CASE event_type WHEN 'purchase' THEN 'direct_scholarship' WHEN 'view' THEN 'scholarship_list_page'
     WHEN 'error' THEN 'fetch_error' WHEN 'click' THEN 'not_scholarship_page' ELSE 'unknown' END page_type,
   ts last_seen_at, CASE WHEN event_type <> 'signup' THEN ts END last_fetched_at,
   CASE WHEN value > 20 THEN props ELSE '' END last_search_query,
   CASE WHEN event_type = 'error' THEN 'failed' ELSE '' END last_error,
   CASE WHEN event_type = 'purchase' THEN 'c' || event_id ELSE '' END candidate_id FROM events),
 history AS (SELECT normalized_url, arg_max(url, ord) url, arg_max(source_domain, ord) source_domain,
   arg_max(page_type, ord) page_type, arg_max(last_seen_at, ord) last_seen_at,
   arg_max(last_fetched_at, ord) FILTER (last_fetched_at IS NOT NULL) last_fetched_at,
   arg_max(last_search_query, ord) FILTER (last_search_query <> '') last_search_query,
   arg_max(last_error, ord) FILTER (last_error <> '') last_error,
   arg_max(candidate_id, ord) FILTER (candidate_id <> '') candidate_id FROM updates GROUP BY 1)
"""


def history(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.history import upsert_history

    up = event_updates(spark, sf)
    return upsert_history(up.limit(0).drop("ord"), up)


# ---- offer pages derived from parts ----------------------------------------------------------

PAGES_AS_OF = "2026-01-15 00:00:00"

# Page kinds by part size: (kind, url path, title, sentences, anchors).  {k} is the part key,
# {n} the part name, {a} the award, {s} the next part.
PAGE_KINDS = {
    0: ("/scholarships/{n}-{k}", "{n} Scholarship",
        "The {n} Scholarship awards up to ${a} to each winner. Application deadline: June 15, 2026. "
        "Applicants must have a minimum 3.25 GPA and be residents of Texas. Apply online with an essay today.", ""),
    1: ("/scholarships/{n}-{k}", "{n} Award",
        "The {n} Award was worth ${a} last time around. Sorry, the deadline has passed for this one.", ""),
    2: ("/scholarships/{n}-{k}", "{n} Grant",
        "The {n} Grant gives winners ${a} for mechanical engineering. Deadline: June 15, 2020 for every form sent.", ""),
    3: ("/scholarships/", "Best scholarships for {n} fans",
        "Here is a list of scholarships that people have liked so far.",
        "<a href='/scholarships/one-{k}'>One {n} scholarship</a> <a href='/scholarships/two-{k}'>Two {n} award</a> "
        "<a href='/about'>About us</a> <a href='/scholarships/three-{k}.pdf'>Three scholarship</a>"),
    4: ("/programs/{k}/scholarships", "Department scholarships",
        "Our university department supports its members every single year.",
        "<a href='/programs/fund-{k}'>{n} fund scholarship</a> <a href='https://other{s}.example.com/scholarships/x-{k}'>Official {n} award</a> "
        "<a href='/programs/guidelines'>Program guidelines award</a>"),
    5: ("/listing/{k}", "{n} Scholarship",
        "See the scholarship directory for more of these. The {n} Scholarship awards ${a} to freshman students.",
        "<a href='https://sponsor{s}.example.com/apply/{k}'>Apply at official website</a> <a href='/scholarships/by-major/'>More by major scholarship</a>"),
    6: ("/gone/{k}", "Gone", "This page could not be shown to you.", ""),
    7: ("/file/{k}", "File", "This file could not be read by anyone.", ""),
    8: ("/aid/{k}", "What is student aid",
        "Everything you need to know about federal student aid and fafsa.", ""),
    9: ("/item/{k}", "{n}", "Just a plain page about some thing here.", ""),
}


def _fill(template: str):
    """Column for a page template; only these five holes are known."""
    holes = {
        "{k}": F.col("p_partkey").cast("string"),
        "{n}": F.initcap("p_name"),
        "{a}": F.floor("p_retailprice").cast("string"),
        "{s}": ((F.col("p_partkey") + 1) % 97).cast("string"),
    }
    out = F.lit(template)
    for hole, value in holes.items():
        if hole in template:
            out = F.replace(out, F.lit(hole), value)
    return out


def offer_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Web pages written from the rows of ``part``."""
    p = deal_rows(table(spark, sf, "part")).withColumn("kind", F.col("p_size") % 10)
    slug = F.lower(F.replace("p_name", F.lit(" "), F.lit("-")))
    url = F.lit(None).cast("string")
    body = F.lit(None).cast("string")
    title = F.lit(None).cast("string")
    for kind, (route, head, text, anchors) in PAGE_KINDS.items():
        here = F.col("kind") == kind
        url = F.when(here, F.replace(_fill(route.replace("{n}", "~")), F.lit("~"), slug)).otherwise(url)
        title = F.when(here, _fill(head)).otherwise(title)
        body = F.when(here, _fill(f"<p>{text}</p><ul>{anchors}</ul>")).otherwise(body)
    host = F.when(F.col("kind") == 5, F.lit("www.fastweb.com")).otherwise(
        F.concat(F.lit("site"), F.col("p_partkey") % 211, F.lit(".example.org"))
    )
    return p.select(
        F.col("p_partkey").alias("page_id"),
        F.floor(F.col("p_partkey") / 40).alias("run_id"),
        F.col("p_partkey").alias("ord"),
        "kind",
        "p_name",
        F.floor("p_retailprice").cast("double").alias("award"),
        F.concat(F.lit("https://"), host, url).alias("url"),
        F.when(F.col("kind") == 6, 404).otherwise(200).alias("http_status"),
        F.when(F.col("kind") == 7, "application/pdf").otherwise("text/html").alias("content_type"),
        F.concat(
            F.lit("<html><head><title>"), title, F.lit("</title><script>var x='<p>';</script></head><body><h1>"),
            title, F.lit("</h1>"), body, F.lit("</body></html>"),
        ).alias("html"),
        F.lit("mechanical engineering").alias("intended_major"),
        F.lit("").alias("ethnicity"),
        F.lit("Texas").alias("state"),
        F.lit("").alias("grade_level"),
        F.lit("starting_college").alias("student_stage"),
    )
