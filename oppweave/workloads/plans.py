"""Text profiles, sources, expansion and the composed jobs."""

from pyspark.sql import functions as F

from ..functions import vocab as v
from ..operators import expansion as e
from ..operators import history as h
from ..operators import queries as q
from ..operators import texts as t
from ..functions.ranks import first_per
from ..functions.urls import canonical_url
from ..operators.links import mark_seen
from ..plans.discover import discover
from ..plans.hub_rounds import hub_rounds
from ..plans.match_profiles import match_profiles
from ..session import cut, deal_rows
from ..sources import readers as rd
from ..streaming import jobs as st
from .pages import part_bundles, part_links
from .registry import query
from .tables import PAGES_AS_OF, history, offer_pages, table

# ---- application documents written from customers --------------------------------------------


def applications(spark, sf):
    """Customers as application forms, with orders' priorities as activities."""
    c = deal_rows(table(spark, sf, "customer"))
    n = F.col("c_custkey").cast("string")
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("Student Name: "), "c_name"),
        F.concat(F.lit("State\t"), F.when(F.col("c_nationkey") % 2 == 0, "CA").otherwise("Texas")),
        F.lit("Intended Major"),
        F.lit("-- 1 of 3 --"),
        F.lower("c_mktsegment"),
        F.concat(F.lit("GPA: "), F.format_string("%.2f", F.floor(F.abs("c_acctbal") / 25) / 100)),
        F.concat(F.lit("Activity: club "), n),
        F.concat(F.lit("Award: prize "), F.col("c_nationkey")),
        F.lit("Activities/Awards"),
        F.concat(F.lit("1. Volunteering")),
        F.lit("Program name"),
        F.concat(F.lit("Helpers "), n),
        F.lit("Program description"),
        F.lit("We helped people"),
        F.lit("every single week"),
        F.lit("2. Award or honor"),
        F.lit("Name of the award or honor"),
        F.concat(F.lit("Medal "), n),
        F.lit("Type of award"),
        F.lit("School"),
        F.lit("Personal insight questions"),
        F.lit("Describe the most significant challenge you have faced"),
        F.lit("and how you met it."),
        F.concat(F.lit("I met number "), n, F.repeat(F.lit(" and went on with my work"), 6)),
        F.lit("Every person has a creative side"),
        F.lit("Too short an answer."),
    )
    return c.select(
        F.col("c_custkey").alias("profile_id"), F.concat(F.lit("app"), n).alias("document_id"),
        F.lit(1).alias("doc_ord"), text.alias("raw_text"),
    )


@query(
    "label_values",
    """SELECT c_custkey profile_id, 'name' field_path, c_name AS value FROM customer
 UNION ALL SELECT c_custkey, 'major', lower(c_mktsegment) FROM customer
 UNION ALL SELECT c_custkey, 'state', CASE WHEN c_nationkey % 2 = 0 THEN 'CA' ELSE 'Texas' END FROM customer""",
)
def label_values(spark, sf):
    labels = {"name": ["student name"], "major": ["intended major"], "state": ["state"], "none": ["no such label"]}
    return t.label_values(applications(spark, sf), labels).select("profile_id", "field_path", "value")


@query(
    "extract_claims",
    """SELECT c_custkey profile_id, 'personalInfo.fullName' field_path, c_name AS value, 0.8 confidence FROM customer
 UNION ALL SELECT c_custkey, 'personalInfo.intendedMajor', lower(c_mktsegment), 0.8 FROM customer
 UNION ALL SELECT c_custkey, 'personalInfo.state', CASE WHEN c_nationkey % 2 = 0 THEN 'CA' ELSE 'Texas' END, 0.8 FROM customer
 UNION ALL SELECT c_custkey, 'personalInfo.address', CASE WHEN c_nationkey % 2 = 0 THEN 'CA' ELSE 'Texas' END, 0.8 FROM customer
 UNION ALL SELECT c_custkey, 'academics.gpa', printf('%.2f', floor(abs(c_acctbal) / 25) / 100), 0.8 FROM customer""",
)
def extract_claims(spark, sf):
    return t.extract_claims(applications(spark, sf)).select("profile_id", "field_path", "value", "confidence")


@query(
    "segment_entries",
    """SELECT c_custkey profile_id, 1 segment, 'program name' AS label, 'Helpers ' || c_custkey AS text FROM customer
 UNION ALL SELECT c_custkey, 1, 'program description', 'We helped people every single week' FROM customer
 UNION ALL SELECT c_custkey, 2, 'name of the award or honor', 'Medal ' || c_custkey FROM customer
 UNION ALL SELECT c_custkey, 2, 'type of award', 'School' FROM customer""",
)
def segment_entries(spark, sf):
    return t.segment_entries(applications(spark, sf)).filter("label IS NOT NULL").select(
        "profile_id", "segment", "label", "text"
    )


@query(
    "entry_summaries",
    """SELECT c_custkey profile_id, 'activity' list_kind, 'Helpers ' || c_custkey || ' - We helped people every single week' item FROM customer
 UNION ALL SELECT c_custkey, 'award', 'Medal ' || c_custkey || ' (School)' FROM customer""",
)
def entry_summaries(spark, sf):
    return t.entry_summaries(t.segment_entries(applications(spark, sf))).select("profile_id", "list_kind", "item")


@query(
    "segment_islands",
    """WITH r AS (SELECT *, CASE WHEN role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 1 ELSE 0 END h FROM conversations)
 SELECT conv_id, turn, sum(h) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT segment FROM r""",
)
def segment_islands(spark, sf):
    from pyspark.sql import Window as W

    c = table(spark, sf, "conversations")
    prev = F.lag("role").over(W.partitionBy("conv_id").orderBy("turn"))
    return t.segment_islands(
        c.withColumn("starts", ~F.col("role").eqNullSafe(prev)), ["conv_id"], ["turn"], F.col("starts")
    ).select("conv_id", "turn", "segment")


@query(
    "prefixed_items",
    """SELECT c_custkey profile_id, 'activity' kind, 'club ' || c_custkey item FROM customer
 UNION ALL SELECT c_custkey, 'award', 'prize ' || c_nationkey FROM customer""",
)
def prefixed_items(spark, sf):
    return t.prefixed_items(applications(spark, sf)).select("profile_id", "kind", "item")


@query(
    "segment_essays",
    """SELECT c_custkey profile_id, 'app' || c_custkey || '-essay-1' essay_id, 'Describe the most significant challenge you have faced and how you met it.' prompt,
 'I met number ' || c_custkey || repeat(' and went on with my work', 6) AS content FROM customer""",
)
def segment_essays(spark, sf):
    return t.segment_essays(applications(spark, sf), most=v.LIMITS["essays"]).select("profile_id", "essay_id", "prompt", "content")


@query(
    "segment_paragraphs",
    r"""SELECT doc_id profile_id, doc_id::VARCHAR || '-essay-1' essay_id, length(trim(text)) n FROM documents WHERE length(trim(text)) > 400 AND text NOT LIKE '%' || chr(10) || chr(10) || '%'""",
)
def segment_paragraphs(spark, sf):
    d = table(spark, sf, "documents").select(
        F.col("doc_id").alias("profile_id"), F.col("doc_id").cast("string").alias("document_id"), F.lit(1).alias("doc_ord"), F.col("text").alias("raw_text")
    )
    return t.segment_essays(d, most=v.LIMITS["essays"]).select("profile_id", "essay_id", F.length("content").alias("n"))


@query(
    "essay_prompt_report",
    """WITH x AS (SELECT o_custkey k, o_orderkey o, o_orderkey % 5 v, 100 + o_orderkey % 400 n FROM orders),
 s AS (SELECT *, CASE v WHEN 0 THEN 0 WHEN 1 THEN 8 WHEN 2 THEN 5 WHEN 3 THEN 13 ELSE 3 END sc FROM x)
 SELECT k form_id, sc prompt_score, CASE v WHEN 1 THEN n WHEN 3 THEN n END min_words, CASE v WHEN 2 THEN n WHEN 3 THEN n + 100 END max_words,
  CASE v WHEN 1 THEN n + 40 WHEN 2 THEN greatest(120, n - 30) WHEN 3 THEN n + 50 ELSE 320 END target_words
 FROM s WHERE sc > 0 QUALIFY row_number() OVER (PARTITION BY k ORDER BY sc DESC, o) = 1""",
)
def essay_prompt_report(spark, sf):
    o, n = F.col("o_orderkey"), (100 + F.col("o_orderkey") % 400).cast("string")
    k = o % 5
    text = (
        F.when(k == 0, F.lit("body { margin: 0; } .a { color: red; } essay style sheet"))
        .when(k == 1, F.concat(F.lit("Please write a personal statement of at least "), n, F.lit(" words")))
        .when(k == 2, F.concat(F.lit("Describe your favourite school day in up to "), n, F.lit(" words")))
        .when(k == 3, F.concat(F.lit("Tell us what you like in a short answer, between "), n, F.lit(" and "), (100 + o % 400 + 100).cast("string"), F.lit(" words?")))
        .otherwise(F.lit("Please explain your own plans here"))
    )
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("form_id"), o.alias("ord"), text.alias("text"))
    return t.essay_prompt_report(rows, "form_id").select("form_id", "prompt_score", "min_words", "max_words", "target_words")


FORM_SQL = """ f AS (SELECT p_partkey // 100 form_id, p_partkey ord, p_name || CASE p_size % 4 WHEN 0 THEN ' email' WHEN 1 THEN ' gpa' WHEN 2 THEN ' upload' ELSE '' END label FROM part),
 d AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY form_id, label ORDER BY ord) = 1)"""


def _forms(spark, sf):
    k = F.col("p_size") % 4
    label = F.concat("p_name", F.when(k == 0, " email").when(k == 1, " gpa").when(k == 2, " upload").otherwise(""))
    none = F.lit(None).cast("string")
    return table(spark, sf, "part").select(
        F.floor(F.col("p_partkey") / 100).alias("form_id"), F.col("p_partkey").alias("ord"), none.alias("name"), none.alias("id"),
        label.alias("display_label"), none.alias("placeholder"), none.alias("aria_label"), none.alias("type"),
    )


@query(
    "map_form_fields",
    f"""WITH {FORM_SQL} SELECT form_id, label, CASE WHEN label LIKE '% email' THEN 'personalInfo.email' WHEN label LIKE '% gpa' THEN 'academics.gpa' ELSE '__manual__.' || replace(label, ' ', '_') END source_path,
 row_number() OVER (PARTITION BY form_id ORDER BY ord) AS position FROM d QUALIFY position <= 80""",
)
def map_form_fields(spark, sf):
    return t.map_form_fields(_forms(spark, sf), v.LIMITS["form_fields"]).select("form_id", "label", "source_path", "position")


@query(
    "form_clues",
    f"""WITH {FORM_SQL}, g AS (SELECT DISTINCT form_id FROM f) SELECT form_id, field_name, source_path FROM g, (VALUES ('city', 'personalInfo.city'), ('transcript_upload', '__manual__.transcript_upload')) c(field_name, source_path)""",
)
def form_clues(spark, sf):
    mapped = t.map_form_fields(_forms(spark, sf), v.LIMITS["form_fields"])
    forms = mapped.select("form_id").distinct().withColumn("text", F.lit("Your city and a transcript, please"))
    return t.form_clues(forms, mapped).select("form_id", "field_name", "source_path")


# ---- sources ---------------------------------------------------------------------------------


@query(
    "explode_search_payload",
    """WITH x AS (SELECT user_id query_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) i, 'https://e' || event_id || '.example.org/' url, event_type || ' ' || event_id title, value FROM events)
 SELECT query_id, url, title, row_number() OVER (PARTITION BY query_id ORDER BY event_id) provider_rank FROM x WHERE value >= 5 AND title NOT LIKE 'error%' QUALIFY provider_rank <= 20""",
)
def explode_search_payload(spark, sf):
    ev = table(spark, sf, "events")
    scheme = F.when(F.col("value") >= 5, "https://e").otherwise("ftp://e")
    title = F.when(F.col("event_type") == "error", " ").otherwise(F.concat_ws(" ", "event_type", "event_id"))
    item = F.struct(
        title.alias("title"), F.concat(scheme, "event_id", F.lit(".example.org/")).alias("url"), F.lit("d").alias("description"),
        F.lit("p").alias("page_age"),
    )
    rows = ev.groupBy(F.col("user_id").alias("query_id")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("event_id", item.alias("r")))), lambda x: x["r"]).alias("results")
    )
    payloads = rows.select("query_id", F.to_json(F.struct(F.struct("results").alias("web"))).alias("payload"))
    return rd.explode_search_payload(payloads, 20).select("query_id", "url", "title", "provider_rank")


@query(
    "newest_log_entries",
    "SELECT event_id run_id, ts, event_type status FROM events ORDER BY ts DESC, event_id DESC LIMIT 50",
)
def newest_log_entries(spark, sf):
    log = table(spark, sf, "events").select(F.col("event_id").alias("run_id"), "ts", F.col("event_type").alias("status"))
    return rd.newest(log, 50)


@query(
    "hourly_runs",
    """SELECT date_trunc('hour', ts) AS hour, event_type AS mode, CASE WHEN value > 50 THEN 'high' ELSE 'low' END reason, count(*) n_runs,
 count(*) FILTER (event_type = 'error') n_errors, sum(floor(value))::BIGINT n_imported FROM events GROUP BY 1, 2, 3""",
)
def hourly_runs(spark, sf):
    log = table(spark, sf, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("mode"),
        F.when(F.col("value") > 50, "high").otherwise("low").alias("reason"),
        F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"), F.floor("value").cast("bigint").alias("imported"),
    )
    return st.hourly_runs(log)


# ---- query planning --------------------------------------------------------------------------

PLAN_SQL = """ p AS (SELECT c_custkey profile_id, lower(c_mktsegment) m, CASE WHEN c_nationkey % 2 = 0 THEN 'CA' END s, c_nationkey % 3 = 0 starting FROM customer),
 w AS (SELECT *, CASE WHEN starting THEN 'incoming college freshman' ELSE 'undergraduate' END t0, CASE WHEN starting THEN 'high school senior' ELSE 'college student' END t1,
  CASE WHEN starting THEN 'first year college' ELSE 'university student' END t2 FROM p),
 q AS (SELECT profile_id, starting, s IS NOT NULL has_s,
  list_filter([m || ' scholarship ' || t0, m || ' scholarship ' || s || ' ' || t0, m || ' scholarship incoming freshman', m || ' scholarship first-year student', m || ' scholarship ' || s || ' incoming freshman', m || ' scholarship ' || t2], lambda x: x IS NOT NULL)[1:6] sp,
  CASE WHEN starting THEN list_filter([m || ' scholarships ' || t0, t0 || ' ' || m || ' scholarship', s || ' ' || t0 || ' scholarship', m || ' scholarship ' || t1, m || ' scholarship ' || s || ' ' || t1, m || ' scholarship ' || t2], lambda x: x IS NOT NULL)
   ELSE list_filter([m || ' undergraduate scholarship', m || ' undergraduate scholarship ' || s, m || ' scholarships ' || t0, t0 || ' ' || m || ' scholarship', s || ' ' || t0 || ' scholarship', m || ' scholarship ' || t1], lambda x: x IS NOT NULL) END[1:4] br,
  CASE WHEN starting THEN list_filter([t0 || ' scholarship', s || ' ' || t0 || ' no essay scholarship', 'no essay scholarship incoming freshman'], lambda x: x IS NOT NULL)
   ELSE list_filter([t0 || ' scholarship', s || ' ' || t0 || ' no essay scholarship', 'no essay scholarship undergraduate'], lambda x: x IS NOT NULL) END[1:2] ge FROM w),
 l AS (SELECT profile_id, starting, list_concat(list_concat(sp, br), ge) qs FROM q),
 u AS (SELECT profile_id, starting, list_filter(qs, lambda x, i: list_position(qs, x) = i) qs FROM l),
 v AS (SELECT profile_id, CASE WHEN starting THEN list_append(qs[1:11], qs[1] || ' -graduate -fellowship -phd -masters') ELSE qs[1:12] END qs FROM u)"""


@query(
    "plan_queries",
    f"WITH {PLAN_SQL} SELECT profile_id, unnest(qs) AS query, generate_subscripts(qs, 1) query_ord FROM v",
)
def plan_queries(spark, sf):
    return q.plan_queries(plan_people(spark, sf), 12)


def plan_people(spark, sf):
    return deal_rows(table(spark, sf, "customer")).select(
        F.col("c_custkey").alias("profile_id"), F.lower("c_mktsegment").alias("intended_major"), F.lit("").alias("ethnicity"),
        F.when(F.col("c_nationkey") % 2 == 0, "California").otherwise("").alias("state"), F.lit("").alias("grade_level"),
        F.when(F.col("c_nationkey") % 3 == 0, "starting_college").otherwise("in_college").alias("student_stage"),
    )


# ---- expansion -------------------------------------------------------------------------------

SCORE_SQL = """ p AS (SELECT c_custkey profile_id, lower(c_mktsegment) major, CASE WHEN c_nationkey % 2 = 0 THEN 'TX' ELSE 'CA' END st, CASE WHEN c_acctbal >= 0 THEN c_acctbal / 2500 END gpa,
   CASE WHEN c_nationkey % 3 = 0 THEN 'starting_college' WHEN c_nationkey % 3 = 1 THEN 'in_college' ELSE '' END stage FROM customer),
 c AS (SELECT DISTINCT o_custkey profile_id, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
 j AS (SELECT c.profile_id, p_partkey id, floor(p_retailprice) award, p_size % 2 = 0 due, p_size % 3 = 0 asks_major, p_size % 5 = 0 asks_state, p_size % 4 = 0 asks_gpa, p_size % 7 AS sg, p_partkey % 12 AS gr, major, st, gpa, stage
   FROM c JOIN part ON p_partkey = l_partkey JOIN p ON p.profile_id = c.profile_id),
 k AS (SELECT *, major = 'furniture' OR major = 'machinery' mm, coalesce(gpa >= 2, false) gm,
   CASE WHEN sg = 1 THEN 'graduate' WHEN sg = 2 THEN 'incoming_freshman' WHEN sg = 3 THEN 'undergraduate' WHEN sg = 4 THEN 'continuing_college' WHEN sg = 5 THEN 'high_school' END need FROM j),
 s AS (SELECT *, least(4, log10(award + 1)) + CASE WHEN due THEN 0.6 ELSE 0 END + CASE WHEN asks_major AND mm THEN 3 ELSE 0 END + CASE WHEN asks_state AND st = 'TX' THEN 1.5 ELSE 0 END
   + CASE WHEN asks_gpa AND gm THEN 1.2 ELSE 0 END + CASE WHEN stage = 'starting_college' AND need IN ('incoming_freshman', 'high_school') THEN 2 WHEN stage = 'starting_college' AND need = 'undergraduate' THEN 0.8
     WHEN stage = 'in_college' AND need IN ('continuing_college', 'undergraduate') THEN 1.5 ELSE 0 END + greatest(0, 2 - gr * 0.2) sc,
   array_to_string(list_filter([CASE WHEN asks_major AND NOT mm THEN 'major_mismatch' END, CASE WHEN asks_state AND st <> 'TX' THEN 'state_mismatch' END, CASE WHEN asks_gpa AND NOT gm THEN 'gpa_mismatch' END,
     CASE WHEN stage <> '' AND need = 'graduate' THEN 'stage_mismatch_graduate' END, CASE WHEN stage = 'starting_college' AND need = 'continuing_college' THEN 'stage_mismatch_continuing_college' END,
     CASE WHEN stage = 'in_college' AND need = 'high_school' THEN 'stage_mismatch_high_school' END], lambda x: x IS NOT NULL), '|') blockers FROM k)"""


def _fit(spark, sf):
    c = table(spark, sf, "customer")
    nat = F.col("c_nationkey")
    people = c.select(
        F.col("c_custkey").alias("profile_id"), F.lower("c_mktsegment").alias("intended_major"), F.lit("").alias("ethnicity"),
        F.when(nat % 2 == 0, "Texas").otherwise("ca").alias("state"),
        F.when(F.col("c_acctbal") >= 0, (F.col("c_acctbal") / 2500).cast("string")).alias("gpa"), F.lit("").alias("grade_level"),
        F.when(nat % 3 == 0, "starting_college").when(nat % 3 == 1, "in_college").otherwise("").alias("student_stage"),
    )
    none = F.array().cast("array<string>")
    s = F.col("p_size")
    need = (
        F.when(s % 7 == 1, "graduate").when(s % 7 == 2, "incoming_freshman").when(s % 7 == 3, "undergraduate")
        .when(s % 7 == 4, "continuing_college").when(s % 7 == 5, "high_school")
    )
    pairs = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("profile_id"), F.col("l_partkey").alias("id")
    ).distinct()
    cand = table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.floor("p_retailprice").cast("double").alias("award_amount"),
        F.when(s % 2 == 0, "2026-05-01").alias("deadline"),
        F.when(s % 3 == 0, F.array(F.lit("furniture"), F.lit("machinery works"))).otherwise(none).alias("allowed_majors"),
        none.alias("allowed_ethnicities"), F.when(s % 5 == 0, F.array(F.lit("TX"))).otherwise(none).alias("required_states"),
        F.when(s % 4 == 0, 2.0).alias("min_gpa"), F.array_compact(F.array(need)).alias("required_stages"),
        (F.col("p_partkey") % 12).alias("global_rank"),
        F.concat(F.lit("https://x/"), F.col("p_partkey") % 500).alias("source_url"), F.col("p_name").alias("name"), F.lit("x").alias("source_domain"),
    )
    return e.score_candidate_fit(pairs.join(cand, "id"), people)


@query(
    "score_candidate_fit",
    f"WITH {SCORE_SQL} SELECT profile_id, id, round(sc, 3) score, blockers, blockers = '' AS is_eligible FROM s",
)
def score_candidate_fit(spark, sf):
    return _fit(spark, sf).select("profile_id", "id", "score", F.array_join("blockers", "|").alias("blockers"), "is_eligible")


@query(
    "final_candidates",
    f"""WITH {SCORE_SQL}, d AS (SELECT profile_id run_id, id, round(sc, 3) score FROM s WHERE blockers = '' QUALIFY row_number() OVER (PARTITION BY profile_id, id % 500 ORDER BY round(sc, 3) DESC, id) = 1)
 SELECT run_id, id, score, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, id) AS position FROM d QUALIFY position <= 8""",
)
def final_candidates(spark, sf):
    x = _fit(spark, sf).filter("is_eligible").withColumnRenamed("profile_id", "run_id")
    return e.final_candidates(x, 8, "id").select("run_id", "id", "score", "position")


@query(
    "fetch_frontier",
    """SELECT DISTINCT l_orderkey // 100 run_id, l_partkey, CASE WHEN p_size > 40 OR p_partkey IS NULL THEN 'page_fetch_failed' END fetch_error FROM lineitem LEFT JOIN part ON p_partkey = l_partkey""",
)
def fetch_frontier(spark, sf):
    front = table(spark, sf, "lineitem").select(
        F.floor(F.col("l_orderkey") / 100).alias("run_id"), F.col("l_partkey"), F.concat(F.lit("p"), F.col("l_partkey")).alias("normalized_url")
    ).distinct()
    pages = table(spark, sf, "part").filter("p_size <= 40").select(
        F.concat(F.lit("p"), F.col("p_partkey")).alias("normalized_url"), F.col("p_partkey").alias("page_id")
    )
    return e.fetch_frontier(front, pages).select("run_id", "l_partkey", "fetch_error")


# Suppliers are list pages, parts are offers (odd size) or list pages (even size).
WALK_SQL = """ e1 AS (SELECT 's' || l_suppkey src, 'p' || l_partkey dst, 'd' || (l_partkey % 40) dom, min(l_orderkey * 8 + l_linenumber) pos FROM lineitem GROUP BY 1, 2, 3),
 e2 AS (SELECT 'p' || l_partkey src, 's' || l_suppkey dst, 'd' || (l_suppkey % 30) dom, min(l_orderkey * 8 + l_linenumber) pos FROM lineitem GROUP BY 1, 2, 3),
 k AS (SELECT 's' || s_suppkey url, 'list' kind FROM supplier UNION ALL SELECT 'p' || p_partkey, CASE WHEN p_size % 2 = 1 THEN 'offer' ELSE 'list' END FROM part WHERE p_size <= 45),
 d0 AS (SELECT s_nationkey run_id, 's' || s_suppkey url, s_suppkey ord FROM supplier),
 c1 AS (SELECT d0.run_id, e1.dst url, e1.dom, d0.ord po, e1.pos, d0.url parent FROM d0 JOIN e1 ON e1.src = d0.url),
 f1 AS (SELECT * FROM c1 QUALIFY row_number() OVER (PARTITION BY run_id, url ORDER BY po, pos) = 1),
 g1 AS (SELECT * FROM f1 QUALIFY row_number() OVER (PARTITION BY run_id, dom ORDER BY po, pos, url) <= 4),
 d1 AS (SELECT run_id, url, parent, row_number() OVER (PARTITION BY run_id ORDER BY po, pos, url) ord FROM g1 QUALIFY ord <= 16),
 c2 AS (SELECT d1.run_id, e2.dst url, e2.dom, d1.ord po, e2.pos, d1.url parent FROM d1 JOIN k ON k.url = d1.url AND kind = 'list' JOIN e2 ON e2.src = d1.url),
 f2 AS (SELECT * FROM c2 QUALIFY row_number() OVER (PARTITION BY run_id, url ORDER BY po, pos) = 1),
 n2 AS (SELECT f2.* FROM f2 ANTI JOIN d0 ON d0.run_id = f2.run_id AND d0.url = f2.url),
 g2 AS (SELECT * FROM n2 QUALIFY row_number() OVER (PARTITION BY run_id, dom ORDER BY po, pos, url) <= 4),
 u1 AS (SELECT run_id, count(*) n FROM d1 GROUP BY 1),
 d2 AS (SELECT g2.run_id, url, parent, row_number() OVER (PARTITION BY g2.run_id ORDER BY po, pos, url) ord, n FROM g2 JOIN u1 ON u1.run_id = g2.run_id QUALIFY ord <= 32 AND ord + n <= 48),
 w AS (SELECT run_id, url, NULL parent_url, 0 AS depth FROM d0 UNION ALL SELECT run_id, url, parent, 1 FROM d1 UNION ALL SELECT run_id, url, parent, 2 FROM d2)"""


@query(
    "expand_lists",
    f"""WITH {WALK_SQL} SELECT run_id, w.url, parent_url, depth, CASE WHEN kind IS NULL THEN 'page_fetch_failed' WHEN kind = 'offer' THEN 'candidate'
 WHEN depth >= 2 THEN 'max_list_expansion_depth_reached' ELSE 'scholarship_list_page' END outcome FROM w LEFT JOIN k ON k.url = w.url""",
)
def expand_lists(spark, sf):
    li = table(spark, sf, "lineitem")
    s, p = F.concat(F.lit("s"), F.col("l_suppkey")), F.concat(F.lit("p"), F.col("l_partkey"))
    pos = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("position")
    down = li.select(s.alias("src_url"), p.alias("url"), F.concat(F.lit("d"), F.col("l_partkey") % 40).alias("source_domain"), pos)
    up = li.select(p.alias("src_url"), s.alias("url"), F.concat(F.lit("d"), F.col("l_suppkey") % 30).alias("source_domain"), pos)
    links = down.unionByName(up).groupBy("src_url", "url", "source_domain").agg(F.min("position").alias("position"))
    sup = table(spark, sf, "supplier")
    pages = sup.select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("url"), F.lit("list").alias("kind")).unionByName(
        table(spark, sf, "part").filter("p_size <= 45").select(
            F.concat(F.lit("p"), F.col("p_partkey")).alias("url"), F.when(F.col("p_size") % 2 == 1, "offer").otherwise("list").alias("kind")
        )
    )
    seeds = sup.select(F.col("s_nationkey").alias("run_id"), F.concat(F.lit("s"), F.col("s_suppkey")).alias("url"), F.col("s_suppkey").alias("ord"))
    return e.expand_lists(seeds, pages, links).select("run_id", "url", "parent_url", "depth", "outcome")


# ---- the walk with a fetch history at every depth ----------------------------------------------

WALK_AS_OF = "2026-01-15 00:00:00"
GOOD_TYPES = "('direct_scholarship', 'scholarship_list_page')"


def _walk_sql(mode: str, max_depth: int) -> str:
    """The walk of :func:`expand_lists`' graph as one statement: per depth a gate, revisits, children and quotas."""
    ttl = "CASE pt " + " ".join(f"WHEN '{k}' THEN {t}" for k, t in v.PAGE_TYPE_TTL_HOURS.items()) + " END"
    bypass = f"(fit >= 11 AND pt IN {GOOD_TYPES} AND age >= 2)" if mode == "rerun" else "false"
    stage = " OR ".join(f"contains(t, '{x}')" for x in v.STAGE_TERMS["starting_college"])
    parts = [
        """e AS (SELECT 's' || l_suppkey src, 'p' || l_partkey url, 'd' || (l_partkey % 40) dom, min(l_orderkey * 8 + l_linenumber) pos FROM lineitem GROUP BY 1, 2, 3
 UNION ALL SELECT 'p' || l_partkey, 's' || l_suppkey, 'd' || (l_suppkey % 30), min(l_orderkey * 8 + l_linenumber) FROM lineitem GROUP BY 1, 2, 3)""",
        "k AS (SELECT 's' || s_suppkey url, 'list' kind FROM supplier UNION ALL SELECT 'p' || p_partkey, CASE WHEN p_size % 2 = 1 THEN 'offer' ELSE 'list' END FROM part WHERE p_size <= 45)",
        """h AS (SELECT 'p' || p_partkey url, CASE WHEN p_size % 2 = 1 THEN 'direct_scholarship' ELSE 'scholarship_list_page' END pt, p_size % 13 age FROM part WHERE p_partkey % 23 <> 0
 UNION ALL SELECT 's' || s_suppkey, 'scholarship_list_page', s_suppkey % 12 FROM supplier WHERE s_suppkey % 5 = 0 OR s_nationkey % 4 = 0)""",
        "known AS (SELECT p_partkey % 25 run_id, 'p' || p_partkey url FROM part WHERE p_size % 3 = 0)",
        "f0 AS (SELECT s_nationkey run_id, 's' || s_suppkey url, s_suppkey ord, s_suppkey::DOUBLE AS rank, s_suppkey % 15 fit, NULL parent FROM supplier)",
        """good AS (SELECT run_id, url FROM (SELECT r.n_nationkey run_id, 's' || s_suppkey url, s_suppkey, lower(s_name || chr(10) || chr(10) || n.n_name || ' ' || CASE s_suppkey % 5 WHEN 0 THEN 'engineering scholarships' WHEN 1 THEN 'furniture awards for incoming freshman'
   WHEN 2 THEN 'phd programs' WHEN 3 THEN 'top 10 hispanic awards' ELSE 'plain' END || chr(10) || CASE WHEN s_suppkey % 2 = 0 THEN '/scholarships/' ELSE '/list/' END) t, n_links, r.n_nationkey % 3 m, lower(r.n_name) st
   FROM supplier JOIN nation n ON n.n_nationkey = s_nationkey CROSS JOIN nation r JOIN (SELECT src, count(*) n_links FROM e GROUP BY 1) c ON c.src = 's' || s_suppkey)
  WHERE CASE WHEN n_links BETWEEN 2 AND 8 THEN 2 WHEN n_links > 8 THEN 1 ELSE 0 END + CASE WHEN """
        + stage
        + """ THEN 3 ELSE 0 END
   + CASE WHEN m = 0 AND contains(t, 'engineering') THEN 2 WHEN m = 1 AND contains(t, 'furniture') THEN 3 ELSE 0 END + CASE WHEN contains(t, 'hispanic') THEN 2 ELSE 0 END + CASE WHEN contains(t, st) THEN 1 ELSE 0 END
   + CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN regexp_matches(t, 'top [0-9]+|scholarships for|engineering scholarships') THEN 1 ELSE 0 END - CASE WHEN contains(t, 'phd') THEN 3 ELSE 0 END >= 5)""",
    ]
    outcomes = []
    for d in range(max_depth + 1):
        stop = "max_list_expansion_depth_reached" if d == max_depth else "scholarship_list_page"
        expand = "kind = 'list'" + (" AND EXISTS (FROM good WHERE good.run_id = g.run_id AND good.url = g.url)" if d == 2 else "")
        deep = f"CASE WHEN {expand} THEN '{stop}' ELSE 'depth_3_not_promising' END" if d == 2 and max_depth == 3 else f"'{stop}'"
        parts += [
            f"l{d} AS (SELECT *, coalesce(age < {ttl}, false) AND NOT coalesce({bypass}, false) AS skipped FROM f{d} LEFT JOIN h USING (url))",
            f"""r{d} AS (SELECT run_id, url, row_number() OVER (PARTITION BY run_id ORDER BY CASE WHEN pt = 'scholarship_list_page' THEN 0 ELSE 1 END, age DESC, rank, ord) AS place FROM l{d}
 WHERE skipped AND pt IN {GOOD_TYPES} AND run_id NOT IN (SELECT run_id FROM l{d} WHERE NOT skipped) QUALIFY place <= 6)""",
            f"""g{d} AS (SELECT run_id, url, ord, rank, parent FROM l{d} WHERE NOT skipped UNION ALL
 SELECT run_id, url, {1 << 40} + place, rank, parent FROM l{d} JOIN r{d} USING (run_id, url))""",
            f"""o{d} AS (SELECT run_id, g.url, parent, {d} AS depth, rank, CASE WHEN kind IS NULL THEN 'page_fetch_failed' WHEN kind = 'offer' THEN 'candidate' ELSE {deep} END outcome FROM g{d} g LEFT JOIN k ON k.url = g.url
 UNION ALL SELECT run_id, url, parent, {d}, rank, 'history_recent_' || pt FROM l{d} ANTI JOIN g{d} USING (run_id, url))""",
        ]
        outcomes.append(f"SELECT * FROM o{d}")
        if d == max_depth:
            break
        queued = " UNION ALL ".join(f"SELECT run_id, url FROM f{x}" for x in range(d + 1))
        before = " UNION ALL ".join(f"SELECT run_id FROM f{x}" for x in range(1, d + 1)) or "SELECT 0 AS run_id WHERE false"
        parts += [
            f"c{d} AS (SELECT g.run_id, e.url, e.dom, g.ord po, g.rank pr, e.pos, g.url parent FROM g{d} g JOIN k ON k.url = g.url AND {expand} JOIN e ON e.src = g.url)",
            f"u{d} AS (SELECT * FROM c{d} QUALIFY row_number() OVER (PARTITION BY run_id, url ORDER BY po, pos) = 1)",
            f"n{d} AS (SELECT * FROM u{d} ANTI JOIN (SELECT * FROM known UNION ALL {queued}) s USING (run_id, url))",
            f"q{d} AS (SELECT * FROM n{d} QUALIFY row_number() OVER (PARTITION BY run_id, dom ORDER BY po, pos, url) <= {v.EXPANSION_PER_DOMAIN})",
            f"""f{d + 1} AS (SELECT run_id, url, ord, pr + ord::DOUBLE / 100::DOUBLE AS rank, NULL::BIGINT fit, parent FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY po, pos, url) ord FROM q{d})
 LEFT JOIN (SELECT run_id, count(*) n FROM ({before}) GROUP BY 1) b USING (run_id) WHERE ord <= {v.EXPANSION_PER_DEPTH[d + 1]} AND ord + coalesce(n, 0) <= {v.EXPANSION_PER_RUN})""",
        ]
    rows = " UNION ALL ".join(outcomes)
    return f"WITH {', '.join(parts)} SELECT run_id, url, parent AS parent_url, depth, round(rank, 4) AS rank, outcome FROM ({rows})"


def _history_walk(spark, sf, mode: str, max_depth: int):
    """Suppliers and parts as pages of runs (one per nation) whose history holds most of them."""
    li, sup, part = (table(spark, sf, x) for x in ("lineitem", "supplier", "part"))
    s, p = F.concat(F.lit("s"), F.col("s_suppkey")), F.concat(F.lit("p"), F.col("p_partkey"))
    ls, lp = F.concat(F.lit("s"), F.col("l_suppkey")), F.concat(F.lit("p"), F.col("l_partkey"))
    pos = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("position")
    down = li.select(ls.alias("src_url"), lp.alias("url"), F.concat(F.lit("d"), F.col("l_partkey") % 40).alias("source_domain"), pos)
    up = li.select(lp.alias("src_url"), ls.alias("url"), F.concat(F.lit("d"), F.col("l_suppkey") % 30).alias("source_domain"), pos)
    links = down.unionByName(up).groupBy("src_url", "url", "source_domain").agg(F.min("position").alias("position"))
    odd = F.col("p_size") % 2 == 1
    pages = sup.select(s.alias("url"), F.lit("list").alias("kind")).unionByName(
        part.filter("p_size <= 45").select(p.alias("url"), F.when(odd, "offer").otherwise("list").alias("kind"))
    )
    ago = lambda hours: (F.lit(WALK_AS_OF).cast("timestamp") - F.make_interval(hours=hours)).alias("last_fetched_at")
    kept = part.filter("p_partkey % 23 <> 0").select(
        p.alias("normalized_url"), F.when(odd, "direct_scholarship").otherwise("scholarship_list_page").alias("page_type"),
        ago(F.col("p_size") % 13),
    ).unionByName(
        sup.filter("s_suppkey % 5 = 0 OR s_nationkey % 4 = 0").select(
            s.alias("normalized_url"), F.lit("scholarship_list_page").alias("page_type"), ago((F.col("s_suppkey") % 12).cast("int"))
        )
    )
    ranked = part.filter("p_size % 3 = 0").select((F.col("p_partkey") % 25).alias("run_id"), p.alias("url"))
    front = sup.select(
        F.col("s_nationkey").alias("run_id"), s.alias("url"), F.col("s_suppkey").alias("ord"), F.col("s_suppkey").cast("double").alias("rank"),
        (F.col("s_suppkey") % 15).cast("double").alias("fit_score"), F.lit("").alias("query"),
    )
    nation = table(spark, sf, "nation")
    key = F.col("s_suppkey")
    texts = sup.join(nation, F.col("n_nationkey") == F.col("s_nationkey")).select(
        s.alias("url"), F.col("s_name").alias("title"),
        F.concat_ws(
            " ", "n_name",
            F.when(key % 5 == 0, "engineering scholarships").when(key % 5 == 1, "furniture awards for incoming freshman")
            .when(key % 5 == 2, "phd programs").when(key % 5 == 3, "top 10 hispanic awards").otherwise("plain"),
        ).alias("text"),
        F.when(key % 2 == 0, "/scholarships/").otherwise("/list/").alias("path"),
    )
    people = nation.select(
        F.col("n_nationkey").alias("run_id"), F.element_at(F.array(F.lit("mechanical engineering"), F.lit("furniture"), F.lit("")), (F.col("n_nationkey") % 3 + 1).cast("int")).alias("intended_major"),
        F.lit("hispanic").alias("ethnicity"), F.col("n_name").alias("state"), F.lit("starting_college").alias("student_stage"), F.lit("").alias("grade_level"),
    )

    def promise(lists):
        sizes = e.links_from(links, lists).groupBy(F.col("src_url").alias("url")).agg(F.count("*").alias("n_links"))
        seen = lists.join(texts, "url").join(sizes, "url").join(people, "run_id")
        return seen.filter(e.list_promise(seen, F.col("n_links"))).select("run_id", "url")

    walk = e.walk_lists(front, lambda urls: (pages, e.links_from(links, urls)), ranked, kept, WALK_AS_OF, mode, max_depth, promise)
    return walk.select("run_id", "url", "parent_url", "depth", F.round("rank", 4).alias("rank"), "outcome")


@query("walk_history", _walk_sql("normal", 2))
def walk_history(spark, sf):
    return _history_walk(spark, sf, "normal", 2)


@query("walk_deep", _walk_sql("rerun", 3))
def walk_deep(spark, sf):
    return _history_walk(spark, sf, "rerun", 3)


# ---- composed jobs ---------------------------------------------------------------------------


@query("match_profiles")
def match_profiles_(spark, sf):
    from .tables import catalog, pairs

    cat = catalog(spark, sf).withColumn("essay_prompts", F.array(F.lit("Describe your work and how you went on")))
    out = match_profiles(applications(spark, sf), cat, pairs(spark, sf), None, 3)
    return out["ranked"].select("profile_id", "id", "award_amount", "fit_score", "essay_score", "status", "rank")


def part_hits(spark, sf):
    """Pages written from parts, found by one query of their run."""
    k = F.col("kind")
    return offer_pages(spark, sf).select(
        "run_id", F.lit("p").alias("profile_id"), F.col("page_id").alias("ord"), F.lit("q").alias("query"),
        F.concat(F.initcap("p_name"), F.lit(" scholarship")).alias("title"), "url",
        F.when(k == 5, "For every incoming college freshman").otherwise("Apply by the deadline").alias("snippet"),
        F.lit(0).alias("pass_priority"), k.alias("kind"),
    )


def part_people(spark, sf):
    """The one profile that every part run shares, as rows of the run table."""
    return offer_pages(spark, sf).select(
        F.lit("p").alias("profile_id"), "intended_major", "ethnicity", "state", "grade_level", "student_stage", F.lit("3.9").alias("gpa")
    ).distinct()


@query("discover")
def discover_(spark, sf):
    known = table(spark, sf, "part").filter("p_size = 10").select(
        F.concat(F.lit("k"), F.col("p_partkey")).alias("id"), F.lit("").alias("source_url"),
        F.concat(F.initcap("p_name"), F.lit(" Scholarship")).alias("name"),
        F.concat(F.lit("site"), F.col("p_partkey") % 211, F.lit(".example.org")).alias("source_domain"),
    )
    feedback = h.domain_feedback(known.select("source_domain", F.lit("approved").alias("status")))
    out = discover(
        part_people(spark, sf), part_hits(spark, sf).drop("kind"), offer_pages(spark, sf), history(spark, sf), feedback, known, PAGES_AS_OF
    )
    return out["candidates"].select("run_id", "source_url", "name", "score", "position")


def part_fetches(spark, sf):
    """A history in which most parts' pages were fetched some hours ago."""
    pages = offer_pages(spark, sf).select(canonical_url("url").alias("normalized_url"), (F.col("page_id") % 60).cast("int").alias("hours"), "page_id")
    ago = F.lit(WALK_AS_OF).cast("timestamp") - F.make_interval(hours="hours")
    kind = F.when(F.col("page_id") % 2 == 0, "scholarship_list_page").otherwise("direct_scholarship")
    kept = pages.filter("page_id % 5 > 0").select("normalized_url", ago.alias("last_fetched_at"), kind.alias("page_type"), "page_id")
    return first_per(kept, ["normalized_url"], [F.col("page_id")]).drop("page_id")


@query(
    "seen_links",
    """WITH h AS (SELECT p_partkey p, CASE WHEN p_partkey % 2 = 0 THEN 12 ELSE 24 END ttl, p_partkey % 60 age FROM part WHERE p_partkey % 5 > 0)
 SELECT l_orderkey AS page_id, l_linenumber AS "position", l_partkey, coalesce(age < ttl, false) seen_recently FROM lineitem LEFT JOIN h ON p = l_partkey""",
)
def seen_links(spark, sf):
    """Order lines as links to parts' pages, most of which were fetched some hours ago."""
    k = F.col("p_partkey")
    history_ = table(spark, sf, "part").filter(k % 5 > 0).select(
        canonical_url(F.concat(F.lit("https://p.example.org/"), k)).alias("normalized_url"),
        (F.lit(WALK_AS_OF).cast("timestamp") - F.make_interval(hours=(k % 60).cast("int"))).alias("last_fetched_at"),
        F.when(k % 2 == 0, "scholarship_list_page").otherwise("direct_scholarship").alias("page_type"),
    )
    links = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("position"), "l_partkey",
        F.concat(F.lit("https://p.example.org/"), F.col("l_partkey"), F.lit("/?utm_=x")).alias("url"),
    )
    return mark_seen(links, history_, WALK_AS_OF).select("page_id", "position", "l_partkey", "seen_recently")


@query("hub_rounds")
def hub_rounds_(spark, sf):
    raw = part_links(spark, sf)
    b = part_bundles(spark, sf, raw)
    from ..operators.links import best_links
    from ..operators.urls import canonical_url

    links = best_links(raw, v.LIMITS["links_per_page"]).drop("position").withColumnRenamed("page_rank", "position")
    s = F.col("kind")
    hits = part_hits(spark, sf).withColumns(
        {
            "normalized_url": canonical_url("url"),
            "source_domain": F.concat(F.lit("s"), F.col("ord") % 9),
            "surface_type": F.when(s.isin(0, 1, 2), "direct_likely").when(s == 4, "hub_likely").when(s.isin(3, 5), "list_likely").otherwise("other"),
            "stage_match": F.lit(True), "fit_score": (F.col("ord") % 13).cast("double"), "novelty_score": F.lit(0.0),
            "provider_rank": (F.col("ord") % 20).cast("int"),
        }
    )
    fetched = part_fetches(spark, sf)
    out = hub_rounds(hits, b, cut(links), max_rounds=3, history=fetched, as_of=WALK_AS_OF)
    return out["decisions"]
