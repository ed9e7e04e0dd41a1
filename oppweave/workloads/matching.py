"""Profiles, offers and their pairs."""

from pyspark.sql import functions as F

from ..operators import matching as m
from ..session import deal_keyed
from .registry import query
from .tables import CATALOG_SQL, catalog, pairs, profiles, table

STATUS_SQL = f"""
WITH {CATALOG_SQL},
 m AS (SELECT p.*, c.* EXCLUDE (id), c.id,
   len(list_filter(allowed_majors, lambda r: contains(intended_major, r) OR contains(r, intended_major))) > 0 major_ok,
   ethnicity IS NOT NULL AND len(list_filter(allowed_ethnicities, lambda r: contains(ethnicity, r) OR contains(r, ethnicity))) > 0 eth_ok
   FROM pairs q JOIN catalog c ON c.id = q.id JOIN profiles p ON p.profile_id = q.profile_id),
 e AS (SELECT *,
   (CASE WHEN min_gpa IS NOT NULL AND gpa < min_gpa THEN 1 ELSE 0 END)
   + (CASE WHEN len(allowed_majors) > 0 AND NOT major_ok THEN 1 ELSE 0 END)
   + (CASE WHEN len(allowed_ethnicities) > 0 AND ethnicity IS NOT NULL AND NOT eth_ok THEN 1 ELSE 0 END) n_failed,
   (CASE WHEN min_gpa IS NOT NULL AND gpa IS NULL THEN 1 ELSE 0 END)
   + (CASE WHEN len(allowed_ethnicities) > 0 AND ethnicity IS NULL THEN 1 ELSE 0 END) n_missing FROM m),
 f AS (SELECT *, CASE WHEN n_failed > 0 THEN 'ineligible' WHEN n_missing > 0 THEN 'needs_human_review' ELSE 'eligible' END status,
   (len(allowed_majors) > 0)::INT + (len(allowed_ethnicities) > 0)::INT + (min_gpa IS NOT NULL)::INT checks,
   (len(allowed_majors) > 0 AND major_ok)::INT + (len(allowed_ethnicities) > 0 AND eth_ok)::INT
   + coalesce((gpa >= min_gpa)::INT, 0) hits FROM e),
 g AS (SELECT *, CASE WHEN checks = 0 THEN 0.5 ELSE round(hits::DOUBLE / checks, 3) END fit_score FROM f)
"""


def _scored(spark, sf):
    pr, cat = profiles(spark, sf), catalog(spark, sf)
    matched = m.match_eligibility(pr, cat, pairs(spark, sf))
    return m.with_fit(matched).withColumn("essay_score", F.lit(0.0))


@query(
    "match_eligibility",
    STATUS_SQL + "SELECT profile_id, id, status, n_failed, n_missing, requires_account AS excluded FROM g",
)
def match_eligibility(spark, sf):
    out = m.match_eligibility(
        profiles(spark, sf), catalog(spark, sf), pairs(spark, sf), include_account=False
    )
    return out.select(
        "profile_id",
        "id",
        "status",
        F.size("failed_rules").alias("n_failed"),
        F.size("missing_info").alias("n_missing"),
        F.col("excluded_reason").isNotNull().alias("excluded"),
    )


@query("score_profile_fit", STATUS_SQL + "SELECT profile_id, id, fit_score FROM g")
def score_profile_fit(spark, sf):
    return _scored(spark, sf).select("profile_id", "id", "fit_score")


@query(
    "rank_offers",
    STATUS_SQL
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY award_amount DESC, fit_score DESC,
   deadline ASC NULLS LAST, effort_minutes, ord) AS rank FROM g)
 SELECT profile_id, id, name, award_amount, fit_score, status, rank FROM r WHERE rank <= 3""",
)
def rank_offers(spark, sf):
    return m.rank_offers(_scored(spark, sf), 3).select(
        "profile_id", "id", "name", "award_amount", "fit_score", "status", "rank"
    )


@query(
    "essay_containment",
    """
 WITH p AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'),
 e AS (SELECT conv_id, text FROM conversations WHERE role <> 'user'),
 pt AS (SELECT DISTINCT conv_id, turn, unnest(list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: t <> '')) AS tok FROM p),
 et AS (SELECT DISTINCT conv_id, unnest(list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: t <> '')) AS tok FROM e),
 s AS (SELECT pt.conv_id, pt.turn, count(*) n, count(et.tok) h FROM pt LEFT JOIN et ON et.conv_id = pt.conv_id AND et.tok = pt.tok GROUP BY 1, 2)
 SELECT conv_id AS profile_id, conv_id::VARCHAR || ':' || turn::VARCHAR AS id, round(h::DOUBLE / n, 3) AS essay_score FROM s
 UNION ALL SELECT DISTINCT p.conv_id, p.conv_id::VARCHAR || ':' || p.turn::VARCHAR, 0.0 FROM p
   WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.conv_id = p.conv_id AND s.turn = p.turn)""",
)
def essay_containment(spark, sf):
    c = table(spark, sf, "conversations")
    asked = c.filter("role = 'user'").select(
        F.col("conv_id").alias("profile_id"),
        F.concat_ws(":", "conv_id", "turn").alias("id"),
        F.col("text").alias("prompt"),
    )
    essays = c.filter("role <> 'user'").select(
        F.col("conv_id").alias("profile_id"), F.col("text").alias("content")
    )
    return m.essay_containment(asked, essays, asked)


DRAFT_SQL = """
 WITH f AS (SELECT l_orderkey profile_id, l_partkey id, l_linenumber position,
   CASE l_returnflag WHEN 'A' THEN 'file' WHEN 'N' THEN 'text' ELSE 'textarea' END field_type,
   CASE WHEN l_linenumber = 3 THEN 'Passport number' ELSE 'field ' || l_linenumber::VARCHAR END field_name,
   l_suppkey, l_extendedprice FROM lineitem),
 d AS (SELECT f.*, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS value FROM f JOIN orders ON o_orderkey = profile_id),
 r AS (SELECT *, CASE WHEN field_type = 'file' THEN 'File upload required by scholarship form'
   WHEN value IS NULL THEN 'No mapped value available'
   WHEN field_name = 'Passport number' THEN 'Sensitive field manual entry required' END reason FROM d)
"""


def _drafts(spark, sf, dealt=False):
    li, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    if dealt:
        li, orders = deal_keyed((li, "l_orderkey"), (orders, "o_orderkey"))
    field = F.struct(
        F.when(F.col("l_linenumber") == 3, "Passport number")
        .otherwise(F.concat(F.lit("field "), F.col("l_linenumber"))).alias("field_name"),
        F.when(F.col("l_returnflag") == "A", "file").when(F.col("l_returnflag") == "N", "text")
        .otherwise("textarea").alias("field_type"),
        F.lit("priority").alias("source_path"),
        F.col("l_linenumber").alias("line"),
    )
    offers = li.select(
        F.col("l_orderkey").alias("profile_id"), F.col("l_partkey").alias("id"),
        F.array(field).alias("form_fields"),
    )
    values = orders.select(
        F.col("o_orderkey").alias("profile_id"),
        F.lit("priority").alias("source_path"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("value"),
    )
    return m.draft_fields(offers, values)


@query(
    "draft_fields",
    DRAFT_SQL
    + """SELECT profile_id, id, position AS line, reason, CASE WHEN reason IS NULL THEN value END filled_value,
   CASE WHEN reason LIKE 'Sensitive%' THEN '***' || right(value, 4) END masked_preview FROM r""",
)
def draft_fields(spark, sf):
    return _drafts(spark, sf).select(
        "profile_id", "id", "line", "reason", "filled_value", "masked_preview"
    )


@query(
    "draft_report",
    DRAFT_SQL
    + """SELECT profile_id, id, count(*) FILTER (reason IS NULL) n_autofill, count(*) FILTER (reason IS NOT NULL) n_manual
   FROM r GROUP BY 1, 2""",
)
def draft_report(spark, sf):
    # Join and counts stay in one stage, dealt by profile, which AQE does not split for a hot one either.
    return m.draft_report(_drafts(spark, sf, dealt=True))
