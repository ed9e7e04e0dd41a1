"""Batches, hub lineage, progress, model decisions and replays."""

from pyspark.sql import functions as F

from ..operators import batch as b
from ..operators import decisions as d
from ..operators import hubs as h
from .registry import query
from .tables import HITS_SQL, hits, table


def _hits(spark, sf):
    x = hits(spark, sf)
    return x.withColumns(
        {
            "title": F.concat(F.lit("Item "), F.col("provider_rank")),
            "snippet": F.lit(""),
            "url": F.col("normalized_url"),
            "fit_score": F.col("fit_score") - 25,
        }
    )


# Titles hold no cue, so the score is fit, surface, novelty and flags.
SCORED_SQL = f"""{HITS_SQL},
 one AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY run_id, normalized_url ORDER BY ord) = 1),
 sc AS (SELECT *, round(fit_score - 25 + CASE surface_type WHEN 'direct_likely' THEN 1.25 WHEN 'hub_likely' THEN 0.7 WHEN 'list_likely' THEN -0.2 ELSE 0 END
   + greatest(-0.75, least(0.75, novelty_score * 0.08)) + CASE WHEN stage_match THEN 0.75 ELSE 0 END
   + CASE WHEN institution_specific THEN -1.25 ELSE 0 END + CASE WHEN specific_school THEN -0.75 ELSE 0 END
   + CASE WHEN stale_cycle THEN -5 ELSE 0 END + CASE WHEN indirect_content THEN -2.5 ELSE 0 END, 3) score FROM one),
 dom AS (SELECT *, row_number() OVER (PARTITION BY run_id, source_domain ORDER BY score DESC, provider_rank, ord) n FROM sc),
 pr AS (SELECT *, score - 1.25 * (n - 1) adjusted FROM dom),
 div AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY adjusted DESC, score DESC, provider_rank, ord) pick FROM pr)
"""


def _scored(spark, sf, variant="conversion_mix"):
    return b.with_traits(b.unfetched(_hits(spark, sf), None)).withColumn("score", b.batch_score(variant))


@query(
    "batch_diversity_fill",
    f"WITH {SCORED_SQL} SELECT run_id, normalized_url, round(score, 3) score, round(adjusted, 3) adjusted, pick FROM div WHERE pick <= 6",
)
def batch_diversity_fill(spark, sf):
    return b.diverse_top(_scored(spark, sf), ["run_id"], 6).select(
        "run_id", "normalized_url", F.round("score", 3).alias("score"), F.round("adjusted", 3).alias("adjusted"), "pick"
    )


@query("select_batch")
def select_batch(spark, sf):
    return b.select_batch(_hits(spark, sf), 6)


@query(
    "replay_scores",
    f"""WITH {SCORED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, provider_rank, ord) p FROM sc)
 SELECT run_id, normalized_url, p AS pick, (p - 1) // 6 + 1 AS round FROM r WHERE p <= 18""",
)
def replay_scores(spark, sf):
    return b.replay_scores(_hits(spark, sf), "conversion_mix").select("run_id", "normalized_url", "pick", "round")


@query("replay_variants")
def replay_variants(spark, sf):
    return b.replay_variants(_hits(spark, sf), rounds=2).select(
        "variant", "run_id", "round", "pick", "normalized_url"
    )


def _known(spark, sf):
    """Earlier outcomes from labels: the later document of a URL is the later round."""
    q, t = F.col("quality"), F.col("toxic")
    return table(spark, sf, "labels").select(
        F.concat(F.lit("https://s"), F.col("doc_id") % 50, F.lit(".example.org/p/"), F.col("doc_id")).alias("normalized_url"),
        F.col("doc_id").alias("round"),
        F.when(t == 1, "drop").when(q == 1, "advance_to_finalize").otherwise("hold_for_expansion").alias("action"),
    )


def _picks(spark, sf):
    doc = table(spark, sf, "documents")
    return doc.select(
        F.concat(F.lit("https://s"), F.col("doc_id") % 50, F.lit(".example.org/p/"), F.col("doc_id")).alias("normalized_url"),
        F.col("lang").alias("variant"), F.col("source").alias("source_domain"),
        (F.col("n_chars") > 1000).alias("stage_match"), (F.col("n_chars") > 3000).alias("specific_school"),
        (F.col("n_chars") < 200).alias("stale_cycle"), F.lit(False).alias("indirect_content"),
    )


KNOWN_SQL = """ k AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'drop' WHEN quality = 1 THEN 'advance_to_finalize' ELSE 'hold_for_expansion' END a FROM labels),
 p AS (SELECT 'https://s' || (doc_id % 50) || '.example.org/p/' || doc_id normalized_url, lang variant, source, n_chars, a FROM documents LEFT JOIN k USING (doc_id))"""


@query("replay_known", f"WITH {KNOWN_SQL} SELECT normalized_url, variant, a AS known_action FROM p")
def replay_known(spark, sf):
    return b.replay_known(_picks(spark, sf), _known(spark, sf)).select("normalized_url", "variant", "known_action")


@query(
    "selection_report",
    f"""WITH {KNOWN_SQL} SELECT variant, count(*) n_picks, count(*) FILTER (n_chars > 1000) n_stage, count(*) FILTER (n_chars > 3000) n_school,
 count(*) FILTER (n_chars < 200) n_stale_or_indirect, count(*) FILTER (a = 'advance_to_finalize') n_known_advance,
 count(*) FILTER (a = 'hold_for_expansion') n_known_hold, count(*) FILTER (a = 'drop') n_known_drop, count(DISTINCT source) n_domains FROM p GROUP BY 1""",
)
def selection_report(spark, sf):
    return b.selection_report(b.replay_known(_picks(spark, sf), _known(spark, sf)))


# ---- lineage ---------------------------------------------------------------------------------


def _leads(spark, sf, shared: bool):
    li = table(spark, sf, "lineitem")
    url = F.col("l_partkey").cast("string")
    if not shared:
        url = F.concat_ws("/", "l_suppkey", "l_partkey")
    ord_ = (((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1000003 + F.col("l_partkey")) * 10007 + F.col("l_suppkey"))
    return li.select(
        F.floor(F.col("l_orderkey") / 100).alias("run_id"), F.col("l_suppkey").alias("hub_ord"),
        F.concat(F.lit("hub"), F.col("l_suppkey")).alias("hub"), ord_.alias("lead_ord"), url.alias("url"),
        "l_returnflag", "l_linestatus",
    )


LEAD_SQL = """ l0 AS (SELECT l_orderkey // 100 run_id, l_suppkey hub_ord, 'hub' || l_suppkey hub,
   ((l_orderkey * 8 + l_linenumber) * 1000003 + l_partkey) * 10007 + l_suppkey lead_ord, l_suppkey || '/' || l_partkey url, l_returnflag, l_linestatus FROM lineitem),
 seen AS (SELECT DISTINCT run_id, url FROM l0 WHERE l_returnflag = 'R' AND l_linestatus = 'O'),
 l1 AS (SELECT run_id, hub_ord, hub, url, min(lead_ord) lead_ord FROM l0 WHERE l_returnflag <> 'R' GROUP BY ALL),
 l2 AS (SELECT *, row_number() OVER (PARTITION BY run_id, hub_ord ORDER BY lead_ord) rn FROM l1 ANTI JOIN seen USING (run_id, url))"""


def _staged(spark, sf, shared):
    x = _leads(spark, sf, shared)
    none = x.limit(0).select("run_id", "hub", "url")
    fetched = x.filter("l_returnflag = 'R' AND l_linestatus = 'O'").select("run_id", "url")
    return h.stage_leads(x.filter("l_returnflag <> 'R'"), none, fetched, none)


def _both(a, b_, first, second):
    cols = ["run_id", "hub", "url"]
    return a.select(*cols, F.lit(first).alias("place")).unionByName(b_.select(*cols, F.lit(second).alias("place")))


@query(
    "stage_leads",
    f"WITH {LEAD_SQL} SELECT run_id, hub, url, CASE WHEN rn <= 2 THEN 'queue' ELSE 'backlog' END place FROM l2",
)
def stage_leads(spark, sf):
    return _both(*_staged(spark, sf, False), "queue", "backlog")


@query("stage_leads_shared")
def stage_leads_shared(spark, sf):
    return _both(*_staged(spark, sf, True), "queue", "backlog")


@query(
    "promote_reserves",
    f"""WITH {LEAD_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY run_id, hub_ord ORDER BY lead_ord) r2 FROM l2 WHERE rn > 2)
 SELECT run_id, hub, url, CASE WHEN hub_ord % 3 <> 0 AND r2 <= 2 THEN 'promoted' ELSE 'backlog' END place FROM r""",
)
def promote_reserves(spark, sf):
    added, spare = _staged(spark, sf, False)
    heat = spare.select("run_id", "hub", "hub_ord", (F.col("hub_ord") % 3).alias("heat")).distinct()
    none = spare.limit(0).select("run_id", "url")
    return _both(*h.promote_reserves(spare, heat, added.select("run_id", "url"), none), "promoted", "backlog")


OUT_SQL = """ pg AS (SELECT DISTINCT l_orderkey // 100 run_id, l_partkey FROM lineitem),
 de AS (SELECT l_orderkey // 100 run_id, l_partkey, max(CASE WHEN l_returnflag = 'A' THEN 2 WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) delta FROM lineitem GROUP BY 1, 2),
 oc AS (SELECT run_id, l_partkey, 'hub' || (l_partkey % 13) parent_hub_url, delta FROM pg JOIN de USING (run_id, l_partkey) WHERE delta > 0 AND l_partkey % 2 = 0)"""


def _outcomes(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("run_id", F.floor(F.col("l_orderkey") / 100))
    k = F.col("l_partkey")
    pages = li.select(
        "run_id", F.concat(F.lit("r"), k).alias("requested_url"),
        F.when(k % 5 == 0, F.concat(F.lit("r"), k)).otherwise(F.concat(F.lit("c"), k)).alias("canonical_url"), k,
    ).distinct()
    dec = li.select(
        "run_id", F.when(k % 3 == 0, F.concat(F.lit("r"), k)).when(k % 5 == 0, F.concat(F.lit("r"), k)).otherwise(F.concat(F.lit("c"), k)).alias("url"),
        F.when(F.col("l_returnflag") == "A", "advance_to_finalize").when(F.col("l_returnflag") == "R", "hold_for_expansion").otherwise("drop").alias("action"),
    )
    org = li.filter(k % 2 == 0).select(
        "run_id", F.concat(F.lit("r"), k).alias("url"), F.concat(F.lit("hub"), k % 13).alias("parent_hub_url")
    ).distinct()
    return h.lineage_outcomes(pages, dec, h.carry_origins(pages, org))


@query("lineage_outcomes", f"WITH {OUT_SQL} SELECT run_id, 'r' || l_partkey requested_url, parent_hub_url, delta FROM oc")
def lineage_outcomes(spark, sf):
    return _outcomes(spark, sf).select("run_id", "requested_url", "parent_hub_url", "delta")


@query("hub_heat", f"WITH {OUT_SQL} SELECT run_id, parent_hub_url, sum(delta)::INT heat FROM oc GROUP BY 1, 2")
def hub_heat(spark, sf):
    return h.hub_heat(_outcomes(spark, sf))


@query(
    "select_expansion",
    f"""WITH {OUT_SQL}, ht AS (SELECT run_id, parent_hub_url, sum(delta) heat FROM oc GROUP BY 1, 2),
 q AS (SELECT DISTINCT l_orderkey // 100 run_id, 'u' || l_partkey url, 'hub' || (l_partkey % 13) parent_hub_url, l_partkey % 4 pr, l_partkey % 3 er, l_partkey % 2 = 0 off, l_partkey % 5 = 0 nv FROM lineitem),
 s AS (SELECT q.*, coalesce(heat, 0) * 10 + pr + CASE WHEN off THEN 2 ELSE 0 END + CASE WHEN nv THEN 0.5 ELSE 0 END priority FROM q LEFT JOIN ht USING (run_id, parent_hub_url))
 SELECT run_id, url, priority::DOUBLE priority, row_number() OVER (PARTITION BY run_id ORDER BY priority DESC, er, url) pick FROM s QUALIFY pick <= 6""",
)
def select_expansion(spark, sf):
    k = F.col("l_partkey")
    q = table(spark, sf, "lineitem").select(
        F.floor(F.col("l_orderkey") / 100).alias("run_id"), F.concat(F.lit("u"), k).alias("url"),
        F.concat(F.lit("hub"), k % 13).alias("parent_hub_url"),
        F.when(k % 4 == 3, "high").when(k % 4 == 2, "medium").when(k % 4 == 1, "low").otherwise("").alias("verification_priority"),
        (k % 3).alias("enqueued_round"), (k % 2 == 0).alias("is_official"), (k % 5 == 0).alias("needs_verification"),
    ).distinct()
    return h.select_expansion(q, h.hub_heat(_outcomes(spark, sf)), 6).select("run_id", "url", "priority", "pick")


STATE_SQL = """ st AS (SELECT o_orderkey run_id, o_custkey % 7 accepted, o_custkey % 2 strong, 5 target, o_custkey % 3 advanced, o_custkey % 2 held, o_orderkey % 4 unfetched,
   o_orderkey % 3 hubs_ready, o_custkey % 5 // 4 children_ready, (o_orderkey % 101) / 100 school_pressure, (o_custkey % 101) / 100 broad_pressure,
   o_orderkey % 6 pages_left, o_custkey % 4 depth_left, o_orderkey % 5 queries_left, o_custkey % 2 replans_left, o_orderkey % 2 search_rounds_left FROM orders)"""


@query(
    "assess_progress",
    f"""WITH {STATE_SQL}, r AS (SELECT *, CASE WHEN accepted >= target AND strong > 0 THEN 'done' WHEN pages_left <= 0 AND queries_left <= 0 AND depth_left <= 0 THEN 'spent'
  WHEN children_ready > 0 AND pages_left > 0 AND depth_left > 0 THEN 'children' WHEN hubs_ready > 0 AND held > 0 AND pages_left > 0 AND depth_left > 0 AND school_pressure <= 0.75 THEN 'hubs'
  WHEN unfetched > 0 AND pages_left > 0 AND (broad_pressure >= school_pressure OR school_pressure < 0.65) THEN 'frontier'
  WHEN accepted < target AND replans_left > 0 AND queries_left > 0 AND search_rounds_left > 0 THEN 'replan' WHEN unfetched > 0 AND pages_left > 0 THEN 'rest' ELSE 'weak' END rule FROM st)
 SELECT run_id, rule, CASE rule WHEN 'replan' THEN 'replan' WHEN 'done' THEN 'stop' WHEN 'spent' THEN 'stop' WHEN 'weak' THEN 'stop' ELSE 'continue' END AS action,
  CASE WHEN rule = 'replan' THEN (school_pressure >= 0.55)::INT * 2 + (broad_pressure < 0.4)::INT + (advanced <= 0)::INT ELSE 0 END n_hints FROM r""",
)
def assess_progress(spark, sf):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    st = table(spark, sf, "orders").select(
        o.alias("run_id"), (c % 7).alias("accepted"), (c % 2).alias("strong"), F.lit(5).alias("target"), (c % 3).alias("advanced"),
        (c % 2).alias("held"), (o % 4).alias("unfetched"), (o % 3).alias("hubs_ready"), F.floor(c % 5 / 4).alias("children_ready"),
        (o % 101 / 100).alias("school_pressure"), (c % 101 / 100).alias("broad_pressure"), (o % 6).alias("pages_left"),
        (c % 4).alias("depth_left"), (o % 5).alias("queries_left"), (c % 2).alias("replans_left"), (o % 2).alias("search_rounds_left"),
    )
    return h.assess_progress(st).select("run_id", "rule", "action", F.size("suggestions").alias("n_hints"))


@query(
    "opportunity_pressure",
    """SELECT l_orderkey // 100 run_id, l_linenumber AS round, round(avg((l_tax < 0.02)::INT), 3) school_pressure, round(avg(1 - (l_tax < 0.02)::INT), 3) broad_pressure
 FROM lineitem GROUP BY 1, 2""",
)
def opportunity_pressure(spark, sf):
    x = table(spark, sf, "lineitem").select(
        F.floor(F.col("l_orderkey") / 100).alias("run_id"), F.col("l_linenumber").alias("round"), (F.col("l_tax") < 0.02).alias("specific_school")
    )
    return h.opportunity_pressure(x, ["run_id", "round"])


@query(
    "skip_reason_counts",
    "SELECT user_id run_id, event_type reason, count(*) n FROM events WHERE event_type <> 'click' GROUP BY 1, 2",
)
def skip_reason_counts(spark, sf):
    e = table(spark, sf, "events")
    return h.skip_reason_counts(
        e.select(F.col("user_id").alias("run_id"), F.when(F.col("event_type") != "click", F.col("event_type")).alias("reason")), ["run_id"]
    )


@query(
    "run_summary",
    """WITH r AS (SELECT user_id run_id, date_trunc('day', ts) AS day, count(*) FILTER (event_type = 'click') discovered, count(*) FILTER (event_type = 'purchase') imported,
 count(*) FILTER (event_type = 'view') fetched, count(*) FILTER (event_type = 'error') skipped FROM events GROUP BY 1, 2)
 SELECT *, CASE WHEN imported > 0 THEN '' WHEN discovered = 0 AND fetched = 0 AND skipped > 0 THEN 'all_search_results_skipped_by_recent_history'
  WHEN discovered = 0 THEN 'agent_returned_zero_candidates' ELSE 'all_discovered_candidates_skipped_or_deduped' END reason FROM r""",
)
def run_summary(spark, sf):
    t = F.col("event_type")
    r = table(spark, sf, "events").groupBy(F.col("user_id").alias("run_id"), F.date_trunc("day", "ts").alias("day")).agg(
        F.count_if(t == "click").alias("discovered"), F.count_if(t == "purchase").alias("imported"),
        F.count_if(t == "view").alias("fetched"), F.count_if(t == "error").alias("skipped"),
    )
    return h.run_summary(r)


# ---- model decisions -------------------------------------------------------------------------

MODEL_SQL = """ ru AS (SELECT doc_id item_id, source run_id, doc_id % 7 = 0 mirror FROM documents),
 mo AS (SELECT doc_id item_id, source run_id, CASE WHEN quality = 1 THEN 'advance_to_finalize' WHEN toxic = 1 THEN 'drop' ELSE 'hold_for_expansion' END a FROM labels JOIN documents USING (doc_id)
   UNION ALL SELECT doc_id, source, 'drop' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND source NOT IN ('src1', 'src2', 'src3')),
 bad AS (SELECT DISTINCT run_id FROM ru ANTI JOIN mo USING (item_id))"""


@query(
    "validate_triage",
    f"""WITH {MODEL_SQL} SELECT ru.run_id, ru.item_id::VARCHAR item_id, CASE WHEN ru.run_id IN (SELECT run_id FROM bad) THEN 'hold_for_expansion' WHEN a = 'advance_to_finalize' AND mirror THEN 'hold_for_expansion' ELSE a END AS action,
 CASE WHEN ru.run_id IN (SELECT run_id FROM bad) THEN 'fallback' WHEN a = 'advance_to_finalize' AND mirror THEN 'guardrail' ELSE 'model' END AS mode FROM ru LEFT JOIN mo USING (item_id)""",
)
def validate_triage(spark, sf):
    doc, lab = table(spark, sf, "documents"), table(spark, sf, "labels")
    key = F.col("doc_id").cast("string").alias("item_id")
    rules = doc.select(
        F.col("source").alias("run_id"), key, F.concat(F.lit("u"), F.col("doc_id")).alias("url"), F.lit("hold_for_expansion").alias("action"),
        F.lit("rule").alias("rationale"), (F.col("doc_id") % 7 == 0).alias("mirror"),
    )
    act = F.when(F.col("quality") == 1, "advance_to_finalize").when(F.col("toxic") == 1, "drop").otherwise("hold_for_expansion")
    labelled = doc.join(lab, "doc_id").select(F.col("source").alias("run_id"), key, act.alias("action"))
    other = doc.join(lab, "doc_id", "left_anti").filter(~F.col("source").isin("src1", "src2", "src3")).select(
        F.col("source").alias("run_id"), key, F.lit("drop").alias("action")
    )
    model = labelled.unionByName(other).withColumn("rationale", F.lit("because"))
    return d.validate_triage(model, rules).select("run_id", "item_id", "action", "mode")


@query(
    "validate_batch",
    """WITH m AS (SELECT l_orderkey run_id, l_linenumber ord, l_partkey FROM lineitem WHERE l_returnflag = 'A'),
 v AS (SELECT run_id, count(*) = count(DISTINCT l_partkey) AND count(*) <= 3 ok FROM m GROUP BY 1),
 p AS (SELECT m.run_id, 'u' || l_partkey url, row_number() OVER (PARTITION BY m.run_id ORDER BY ord, l_partkey) pick, 'model' AS mode FROM m JOIN v ON v.run_id = m.run_id AND ok)
 SELECT * FROM p UNION ALL SELECT o_orderkey, 'rule' || o_orderkey, 1, 'fallback' FROM orders WHERE o_orderkey NOT IN (SELECT run_id FROM v WHERE ok)""",
)
def validate_batch(spark, sf):
    li = table(spark, sf, "lineitem")
    item = F.col("l_partkey").cast("string").alias("item_id")
    model = li.filter("l_returnflag = 'A'").select(
        F.col("l_orderkey").alias("run_id"), item, (F.col("l_linenumber").cast("bigint") * 10**9 + F.col("l_partkey")).alias("ord"), F.lit("why").alias("rationale")
    )
    known = li.select(F.col("l_orderkey").alias("run_id"), item, F.concat(F.lit("u"), F.col("l_partkey")).alias("url")).distinct()
    rules = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.lit(1).alias("pick"), F.concat(F.lit("rule"), F.col("o_orderkey")).alias("url")
    )
    return d.validate_batch(model, known, rules, 3)


@query(
    "validate_progress",
    """SELECT o_orderkey run_id, CASE WHEN o_orderstatus = 'P' OR o_custkey % 4 = 0 THEN 'continue' WHEN o_orderstatus = 'F' THEN 'stop' ELSE 'replan' END AS action,
 CASE WHEN o_orderstatus = 'P' OR o_custkey % 4 = 0 THEN 'fallback' ELSE 'model' END AS mode FROM orders""",
)
def validate_progress(spark, sf):
    o = table(spark, sf, "orders")
    st = F.col("o_orderstatus")
    model = o.select(
        F.col("o_orderkey").alias("run_id"),
        F.when(st == "F", "stop").when(st == "O", "replan").otherwise("continue").alias("action"),
        F.when(st == "F", "stop_now").otherwise("widen_queries").alias("next_step"),
        F.when(F.col("o_custkey") % 4 == 0, " ").otherwise("because").alias("rationale"),
        F.array().cast("array<string>").alias("suggestions"),
    )
    rules = o.select(
        F.col("o_orderkey").alias("run_id"), F.lit("continue").alias("action"), F.lit("expand_held_hubs").alias("next_step"), F.lit("rule").alias("rationale")
    )
    return d.validate_progress(model, rules).select("run_id", "action", "mode")


@query(
    "triage_report",
    """WITH k AS (SELECT v.variant, doc_id % 5 = 0 agg, CASE WHEN toxic = 1 THEN 'd' WHEN quality = 1 OR (v.variant = 'loose' AND doc_id % 3 = 0) THEN 'a' ELSE 'h' END x FROM labels, (VALUES ('strict'), ('loose')) v(variant))
 SELECT variant, count(*) FILTER (x = 'a') n_advance, count(*) FILTER (x = 'h') n_hold, count(*) FILTER (x = 'd') n_drop,
  count(*) FILTER (agg AND x = 'a') n_aggregator_advance, count(*) FILTER (agg AND x = 'h') n_aggregator_hold, count(*) FILTER (agg AND x = 'd') n_aggregator_drop FROM k GROUP BY 1""",
)
def triage_report(spark, sf):
    lab = table(spark, sf, "labels").withColumn("variant", F.explode(F.array(F.lit("strict"), F.lit("loose"))))
    loose = (F.col("variant") == "loose") & (F.col("doc_id") % 3 == 0)
    return d.triage_report(
        lab.select(
            "variant", (F.col("doc_id") % 5 == 0).alias("aggregator"),
            F.when(F.col("toxic") == 1, "drop").when((F.col("quality") == 1) | loose, "advance_to_finalize").otherwise("hold_for_expansion").alias("action"),
        )
    )
