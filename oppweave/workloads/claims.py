"""Field claims from events; candidates and reviews from orders."""

from pyspark.sql import functions as F

from ..functions.urls import canonical_url
from ..operators import claims as c
from ..operators import store as s
from ..session import cut
from .hits import URL_SQL
from .registry import query
from .tables import catalog, table

CLAIM_SQL = """ cl AS (SELECT user_id profile_id, event_type field_path, CASE WHEN value < 2 THEN '' ELSE props END AS value,
   least(floor(value / 40) / 10, 0.9) confidence, event_id doc_ord, 'd' || event_id document_id FROM events),
 ok AS (SELECT * FROM cl WHERE value <> ''),
 win AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY profile_id, field_path ORDER BY confidence DESC, doc_ord) = 1)"""


def claims(spark, sf):
    e = table(spark, sf, "events")
    return e.select(
        F.col("user_id").alias("profile_id"),
        F.col("event_type").alias("field_path"),
        F.when(F.col("value") < 2, "").otherwise(F.col("props")).alias("value"),
        F.least(F.floor(F.col("value") / 40) / 10, F.lit(0.9)).alias("confidence"),
        F.col("event_id").alias("doc_ord"),
        F.concat(F.lit("d"), F.col("event_id")).alias("document_id"),
    )


@query("merge_claims", f"WITH {CLAIM_SQL} SELECT profile_id, field_path, value, confidence, document_id FROM win")
def merge_claims(spark, sf):
    return c.merge_claims(claims(spark, sf))


@query(
    "claim_conflicts",
    f"""WITH {CLAIM_SQL}, r AS (SELECT *, arg_max(doc_ord, confidence * 1e9 - doc_ord) OVER w b
   FROM ok WINDOW w AS (PARTITION BY profile_id, field_path ORDER BY doc_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
 SELECT r.profile_id, r.field_path, r.doc_ord, p.value previous_value, r.value incoming_value,
   CASE WHEN r.confidence > p.confidence THEN r.value ELSE p.value END chosen_value,
   CASE WHEN r.confidence > p.confidence THEN r.document_id ELSE p.document_id END chosen_source
 FROM r JOIN ok p ON p.doc_ord = r.b WHERE r.value <> p.value""",
)
def claim_conflicts(spark, sf):
    return c.claim_conflicts(claims(spark, sf))


@query(
    "merge_lists",
    """SELECT user_id profile_id, event_type kind, props item, min(event_id) first_doc, arg_min(event_id % 5, event_id) first_pos
 FROM events GROUP BY 1, 2, 3""",
)
def merge_lists(spark, sf):
    e = table(spark, sf, "events")
    return c.merge_lists(
        e.select(
            F.col("user_id").alias("profile_id"), F.col("event_type").alias("kind"), F.col("event_id").alias("doc_ord"),
            (F.col("event_id") % 5).alias("pos"), F.col("props").alias("item"),
        )
    )


@query(
    "apply_overrides",
    f"""WITH {CLAIM_SQL}, o AS (SELECT c_custkey profile_id, CASE WHEN c_nationkey % 2 = 0 THEN 'click' ELSE 'intended' END field_path, c_name AS value
   FROM customer WHERE c_acctbal > 0)
 SELECT coalesce(win.profile_id, o.profile_id) profile_id, coalesce(win.field_path, o.field_path) field_path, coalesce(o.value, win.value) AS value,
  CASE WHEN o.value IS NOT NULL THEN 1.0 ELSE confidence END confidence, CASE WHEN o.value IS NOT NULL THEN 'human_input' ELSE document_id END document_id
 FROM win FULL JOIN o ON win.profile_id = o.profile_id AND win.field_path = o.field_path""",
)
def apply_overrides(spark, sf):
    o = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("profile_id"),
        F.when(F.col("c_nationkey") % 2 == 0, "click").otherwise("intended").alias("field_path"),
        F.when(F.col("c_acctbal") > 0, F.col("c_name")).otherwise(" ").alias("value"),
    )
    return c.apply_overrides(c.merge_claims(claims(spark, sf)), o)


MODEL_FIELDS = ["click", "view", "error"]
MODEL_SQL = f"""{CLAIM_SQL}, mo AS (SELECT user_id profile_id, event_type field_path, 'm' || event_id AS value, least(round(value / 100, 2), 1.0) confidence, event_id ord
   FROM events WHERE event_type IN ('click', 'view', 'error') AND least(round(value / 100, 2), 1.0) >= 0.55),
 done AS (SELECT profile_id FROM win WHERE field_path IN ('click', 'view', 'error') AND confidence >= 0.85 GROUP BY 1 HAVING count(*) = 3),
 mb AS (SELECT * FROM mo WHERE profile_id NOT IN (SELECT profile_id FROM done) QUALIFY row_number() OVER (PARTITION BY profile_id, field_path ORDER BY confidence DESC, ord) = 1)"""


@query(
    "merge_model_values",
    f"""WITH {MODEL_SQL} SELECT coalesce(w.profile_id, m.profile_id) profile_id, coalesce(w.field_path, m.field_path) field_path,
  CASE WHEN m.confidence > coalesce(w.confidence, 0) THEN m.value ELSE w.value END AS value,
  CASE WHEN m.confidence > coalesce(w.confidence, 0) THEN m.confidence ELSE w.confidence END confidence,
  CASE WHEN m.confidence > coalesce(w.confidence, 0) THEN 'ai_enrichment' ELSE document_id END document_id
 FROM win w FULL JOIN mb m ON w.profile_id = m.profile_id AND w.field_path = m.field_path""",
)
def merge_model_values(spark, sf):
    e = table(spark, sf, "events")
    model = e.select(
        F.col("user_id").alias("profile_id"), F.col("event_type").alias("field_path"),
        F.concat(F.lit("m"), F.col("event_id")).alias("value"),
        F.least(F.round(F.col("value") / 100, 2), F.lit(1.0)).alias("confidence"), F.col("event_id").alias("ord"),
    )
    return c.merge_model_values(c.merge_claims(claims(spark, sf)), model, MODEL_FIELDS)


@query(
    "fields_to_ask",
    f"""WITH {CLAIM_SQL} SELECT c_custkey profile_id, f.field_path FROM customer, (VALUES ('click'), ('view'), ('error')) f(field_path)
 WHERE NOT EXISTS (SELECT 1 FROM win WHERE win.profile_id = c_custkey AND win.field_path = f.field_path AND confidence >= 0.85)""",
)
def fields_to_ask(spark, sf):
    people = table(spark, sf, "customer").select(F.col("c_custkey").alias("profile_id"))
    return c.fields_to_ask(c.merge_claims(claims(spark, sf)), people, MODEL_FIELDS)


# ---- store -----------------------------------------------------------------------------------

CAND_SQL = """ cand AS (SELECT o_orderkey ord, 'o' || o_orderkey id, 'Offer ' || o_orderpriority AS name, 'd' || o_custkey || CASE o_custkey % 9 WHEN 1 THEN '.xyz' WHEN 2 THEN '.quickcash.org' ELSE '.example.org' END source_domain,
   CASE o_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'http://d' || o_custkey || '.example.org/o' ELSE 'https://d' || o_custkey || '.example.org/o/' || (o_orderkey % 3) END source_url,
   CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'approved' ELSE 'rejected' END status,
   CASE WHEN o_totalprice > 100000 THEN '2026-05-01' ELSE '' END deadline, floor(o_totalprice) award_amount, o_orderdate FROM orders)"""


def candidates(spark, sf):
    o = table(spark, sf, "orders")
    cust = F.col("o_custkey")
    tail = F.when(cust % 9 == 1, ".xyz").when(cust % 9 == 2, ".quickcash.org").otherwise(".example.org")
    base = F.concat(F.lit("d"), cust, F.lit(".example.org/o"))
    return o.select(
        F.col("o_orderkey").alias("ord"),
        F.concat(F.lit("o"), F.col("o_orderkey")).alias("id"),
        F.concat(F.lit("Offer "), F.col("o_orderpriority")).alias("name"),
        F.concat(F.lit("d"), cust, tail).alias("source_domain"),
        F.when(cust % 4 == 0, "").when(cust % 4 == 1, F.concat(F.lit("http://"), base))
        .otherwise(F.concat(F.lit("https://"), base, F.lit("/"), F.col("o_orderkey") % 3)).alias("source_url"),
        F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "approved")
        .otherwise("rejected").alias("status"),
        F.when(F.col("o_totalprice") > 100000, "2026-05-01").otherwise("").alias("deadline"),
        F.floor("o_totalprice").cast("double").alias("award_amount"),
        F.lit("").alias("source_name"),
        F.lit(True).alias("has_eligibility"),
        F.lit("").alias("review_notes"),
        F.lit("").alias("reviewed_by"),
        F.col("o_orderdate").alias("reviewed_at"),
        F.lit("Tier 1").alias("recommended_tier"),
    )


@query(
    "normalize_candidates",
    """SELECT 'o' || o_orderkey id, CASE WHEN o_custkey % 11 = 0 THEN 'Candidate missing required field: name' END reject_reason,
 CASE WHEN o_custkey % 11 > 0 THEN CASE WHEN o_totalprice > 250000 THEN 45 ELSE 30 END END effort_minutes FROM orders""",
)
def normalize_candidates(spark, sf):
    raw = candidates(spark, sf).join(table(spark, sf, "orders"), F.col("ord") == F.col("o_orderkey")).withColumns(
        {
            "name": F.when(F.col("o_custkey") % 11 > 0, F.col("name")),
            "effort_minutes": F.when(F.col("o_totalprice") > 250000, 45),
            "requires_account": F.lit("yes"),
        }
    )
    good, bad = s.normalize_candidates(raw)
    return good.select("id", F.lit(None).cast("string").alias("reject_reason"), "effort_minutes").unionByName(
        bad.select("id", "reject_reason", F.lit(None).cast("int").alias("effort_minutes"))
    )


@query(
    "anti_known",
    f"""WITH {CAND_SQL}, k AS (SELECT * FROM cand WHERE status = 'rejected'), c AS (SELECT * FROM cand WHERE status <> 'rejected'),
 ku AS (SELECT DISTINCT source_url FROM k WHERE source_url <> ''), kn AS (SELECT DISTINCT name, source_domain FROM k)
 SELECT id FROM c ANTI JOIN ku ON ku.source_url = c.source_url ANTI JOIN kn ON kn.name = c.name AND kn.source_domain = c.source_domain""",
)
def anti_known(spark, sf):
    all_ = candidates(spark, sf)
    return s.anti_known(all_.filter("status <> 'rejected'"), all_.filter("status = 'rejected'"), "ord").select("id")


@query(
    "catalog_duplicates",
    """WITH c AS (SELECT p_partkey id, 'd' || (p_partkey % 300) || '.example.org' source_domain FROM part),
 f AS (SELECT source_domain, min(id) id FROM c GROUP BY 1)
 SELECT o_orderkey ord, f.id::VARCHAR duplicate_id FROM orders JOIN f ON f.source_domain = 'd' || o_custkey || CASE o_custkey % 9 WHEN 1 THEN '.xyz' WHEN 2 THEN '.quickcash.org' ELSE '.example.org' END""",
)
def catalog_duplicates(spark, sf):
    return s.catalog_duplicates(candidates(spark, sf), _offers(spark, sf), "ord")


def _offers(spark, sf):
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("name"),
        F.concat(F.lit("d"), F.col("p_partkey") % 300, F.lit(".example.org")).alias("source_domain"),
        F.lit("").alias("source_url"),
    )


@query(
    "candidate_risk",
    f"""WITH {CAND_SQL}, d AS (SELECT DISTINCT 'd' || (p_partkey % 300) || '.example.org' source_domain, p_partkey % 300 AS m FROM part WHERE p_partkey < 300),
 r AS (SELECT cand.*, d.m, (CASE WHEN source_url LIKE 'http://%' THEN 20 ELSE 0 END) + (CASE WHEN cand.source_domain LIKE '%.xyz' THEN 35 ELSE 0 END)
   + (CASE WHEN cand.source_domain LIKE '%quickcash%' THEN 30 ELSE 0 END) + (CASE WHEN d.m IS NOT NULL THEN 20 ELSE 0 END) + (CASE WHEN deadline = '' THEN 10 ELSE 0 END) + 8 p
   FROM cand LEFT JOIN d ON d.source_domain = cand.source_domain)
 SELECT id, p risk_score, CASE WHEN p < 25 THEN 'Tier 1' WHEN p < 55 THEN 'Tier 2' ELSE 'Tier 3' END recommended_tier,
  array_to_string(list_filter([CASE WHEN source_url LIKE 'http://%' THEN 'non_https_source_url' END, CASE WHEN source_domain LIKE '%.xyz' THEN 'high_risk_tld:.xyz' END,
   CASE WHEN source_domain LIKE '%quickcash%' THEN 'suspicious_keyword:quickcash' END, CASE WHEN m IS NOT NULL THEN 'already_exists_in_catalog:' || m END,
   CASE WHEN deadline = '' THEN 'missing_deadline' END, 'missing_source_name'], lambda x: x IS NOT NULL), '|') flags FROM r""",
)
def candidate_risk(spark, sf):
    return s.candidate_risk(candidates(spark, sf), _offers(spark, sf), "ord").select(
        "id", "risk_score", "recommended_tier", F.array_join("risk_flags", "|").alias("flags")
    )


@query(
    "import_candidates",
    """WITH p AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus IN ('P', 'F'))
 SELECT min(o_orderkey) id FROM (SELECT * FROM orders WHERE o_orderstatus = 'O') i ANTI JOIN p USING (o_custkey, o_orderpriority) GROUP BY o_custkey, o_orderpriority""",
)
def import_candidates(spark, sf):
    """Open orders against rejected ones in the store and filled ones in the catalog; customer and priority are the offer."""
    offer = F.concat_ws("/", "o_custkey", "o_orderpriority")
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("https://x.example.org/"), offer).alias("source_url"),
        F.concat(F.lit("n"), offer).alias("name"), F.lit("x.example.org").alias("source_domain"), "o_orderstatus",
    )
    part = {x: o.filter(F.col("o_orderstatus") == x) for x in "OPF"}
    return s.import_candidates(part["O"], part["P"], part["F"], "id", "id").select("id")


# Chains of shared keys: rows of one customer share a URL with the next row and a
# name with the one after, so a fallen row must not block its neighbours.
@query("first_wins_chains")
def first_wins_chains(spark, sf):
    li = table(spark, sf, "lineitem")
    rows = li.select(
        (((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1000003 + F.col("l_partkey")) * 10007 + F.col("l_suppkey")).alias("id"),
        F.concat(F.lit("https://x/"), F.col("l_orderkey"), F.lit("/"), F.floor(F.col("l_linenumber") / 2)).alias("source_url"),
        F.concat(F.lit("n"), F.floor((F.col("l_linenumber") + 1) / 2)).alias("name"),
        F.concat(F.lit("d"), F.col("l_orderkey")).alias("source_domain"),
    )
    return s.first_wins(rows, "id", "id").select("id")


@query(
    "replace_pending",
    f"WITH {CAND_SQL} SELECT id, status FROM cand WHERE status <> 'pending' UNION ALL SELECT 'new' || id, 'pending' FROM cand WHERE status = 'approved'",
)
def replace_pending(spark, sf):
    x = candidates(spark, sf)
    new = x.filter("status = 'approved'").withColumns(
        {"id": F.concat(F.lit("new"), F.col("id")), "status": F.lit("pending")}
    )
    return s.replace_pending(x, new).select("id", "status")


REVIEW_SQL = f"""{CAND_SQL}, rv AS (SELECT event_id ord, 'o' || (event_id * 2) id, CASE event_type WHEN 'click' THEN 'approve' WHEN 'view' THEN 'reject' WHEN 'purchase' THEN 'submit' WHEN 'error' THEN 'drop' ELSE 'approve' END decision, ts FROM events),
 j AS (SELECT rv.*, cand.status old, CASE WHEN cand.status IS NULL THEN 'Candidate not found' WHEN decision = 'drop' THEN 'decision must be ''approve'' or ''reject'''
   WHEN decision = 'submit' AND cand.status = 'rejected' THEN 'Rejected candidates cannot be marked as submitted' END refused FROM rv LEFT JOIN cand ON cand.id = rv.id)"""


@query(
    "review_updates",
    f"""WITH {REVIEW_SQL} SELECT cand.id, CASE j.decision WHEN 'approve' THEN 'approved' WHEN 'reject' THEN 'rejected' WHEN 'submit' THEN 'submitted' ELSE cand.status END status,
 CASE WHEN j.id IS NOT NULL THEN j.ts ELSE o_orderdate END reviewed_at FROM cand LEFT JOIN (SELECT * FROM j WHERE refused IS NULL) j ON j.id = cand.id""",
)
def review_updates(spark, sf):
    return _reviewed(spark, sf)[0].select("id", "status", "reviewed_at")


@query(
    "refused_reviews",
    f"WITH {REVIEW_SQL} SELECT ord, id, decision, refused FROM j WHERE refused IS NOT NULL",
)
def refused_reviews(spark, sf):
    return _reviewed(spark, sf)[1].select("ord", "id", "decision", "refused")


def _reviewed(spark, sf):
    t = F.col("event_type")
    rv = table(spark, sf, "events").select(
        F.col("event_id").alias("ord"), F.concat(F.lit("o"), F.col("event_id") * 2).alias("id"),
        F.when(t == "view", "reject").when(t == "purchase", "submit").when(t == "error", "drop").otherwise("approve").alias("decision"),
        F.lit("r").alias("reviewer"), F.lit("").alias("notes"), F.lit("").alias("tier_override"), F.col("ts").alias("reviewed_at"),
    )
    return s.review_updates(candidates(spark, sf), rv)


PATCH_SQL = f"""{CAND_SQL}, ev AS (SELECT event_id ord, 'o' || (event_id % 900) id, CASE event_id % 7 WHEN 0 THEN 'approve' WHEN 1 THEN 'reject' WHEN 2 THEN 'submit' WHEN 3 THEN 'submit' WHEN 4 THEN 'suggest' ELSE 'patch' END decision,
   CASE WHEN user_id % 4 <> 0 THEN 'u' || (user_id % 5) END reviewer, CASE WHEN event_id % 3 = 0 THEN 'note ' || event_id ELSE '' END notes, CASE WHEN event_id % 7 >= 5 AND user_id % 2 = 0 THEN 'name ' || event_id END p_name,
   CASE WHEN event_id % 7 >= 5 AND user_id % 3 = 0 THEN value END p_award, CASE WHEN event_id % 7 = 6 AND user_id % 5 = 0 THEN 'pending' WHEN event_id % 7 = 6 AND user_id % 5 = 1 THEN 'rejected' END p_status FROM events),
 j0 AS (SELECT ev.*, cand.status old, CASE decision WHEN 'approve' THEN 'approved' WHEN 'reject' THEN 'rejected' ELSE p_status END verdict FROM ev LEFT JOIN cand USING (id)),
 j1 AS (SELECT *, coalesce(last_value(verdict IGNORE NULLS) OVER (PARTITION BY id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), old) now FROM j0),
 j2 AS (SELECT *, CASE WHEN old IS NULL THEN 'Candidate not found' WHEN decision = 'submit' AND now = 'rejected' THEN 'Rejected candidates cannot be marked as submitted' END refused FROM j1),
 ok AS (SELECT *, CASE WHEN decision IN ('approve', 'reject') OR (decision = 'submit' AND notes <> '') THEN trim(concat_ws(' ', '[' || reviewer || ']', nullif(notes, ''))) END n,
   CASE WHEN decision IN ('approve', 'reject') THEN coalesce(reviewer, '') WHEN decision = 'submit' THEN reviewer END who FROM j2 WHERE refused IS NULL),
 base AS (SELECT id, max(ord) FILTER (n IS NOT NULL) noted FROM ok GROUP BY 1),
 fin AS (SELECT ok.id, arg_max(coalesce(CASE WHEN decision = 'submit' THEN 'submitted' END, verdict), ord) FILTER (decision = 'submit' OR verdict IS NOT NULL) st, arg_max(n, ord) FILTER (n IS NOT NULL) n,
   arg_max(who, ord) FILTER (who IS NOT NULL) who, string_agg('[' || reviewer || ']', ' ' ORDER BY ord DESC) FILTER (decision = 'submit' AND notes = '' AND reviewer IS NOT NULL AND (noted IS NULL OR ord > noted)) marks,
   bool_or(decision = 'suggest') sug, arg_max(p_name, ord) FILTER (p_name IS NOT NULL) p_name, arg_max(p_award, ord) FILTER (p_award IS NOT NULL) p_award FROM ok JOIN base USING (id) GROUP BY 1)"""


@query(
    "review_patches",
    f"""WITH {PATCH_SQL} SELECT cand.id, coalesce(st, cand.status) status, CASE WHEN marks IS NULL THEN coalesce(fin.n, '') ELSE concat_ws(' ', marks, nullif(fin.n, '')) END AS review_notes,
 coalesce(who, '') reviewed_by, coalesce(sug, false) user_suggested, coalesce(p_name, 'n') AS name, coalesce(p_award, cand.award_amount) award_amount FROM cand LEFT JOIN fin USING (id)""",
)
def review_patches(spark, sf):
    """Reviews, marks and patches of the same few hundred candidates, many of them each."""
    done, _ = _patched(spark, sf)
    return done.select("id", "status", "review_notes", "reviewed_by", "user_suggested", "name", "award_amount")


@query("refused_patches", f"WITH {PATCH_SQL} SELECT ord, id, refused FROM j2 WHERE refused IS NOT NULL")
def refused_patches(spark, sf):
    return _patched(spark, sf)[1].select("ord", "id", "refused")


def _patched(spark, sf):
    k, u = F.col("event_id"), F.col("user_id")
    kind = k % 7
    patch = F.struct(
        F.when((kind >= 5) & (u % 2 == 0), F.concat(F.lit("name "), k)).alias("name"), F.when((kind >= 5) & (u % 3 == 0), F.col("value")).alias("award_amount"),
        F.when((kind == 6) & (u % 5 == 0), "pending").when((kind == 6) & (u % 5 == 1), "rejected").alias("status"),
    )
    rv = table(spark, sf, "events").select(
        k.alias("ord"), F.concat(F.lit("o"), k % 900).alias("id"),
        F.when(kind == 0, "approve").when(kind == 1, "reject").when(kind.isin(2, 3), "submit").when(kind == 4, "suggest").otherwise("patch").alias("decision"),
        F.when(u % 4 != 0, F.concat(F.lit("u"), u % 5)).alias("reviewer"), F.when(k % 3 == 0, F.concat(F.lit("note "), k)).otherwise("").alias("notes"),
        F.lit("").alias("tier_override"), F.col("ts").alias("reviewed_at"), patch.alias("patch"),
    )
    stored = candidates(spark, sf).withColumns({"name": F.lit("n"), "review_notes": F.lit(""), "reviewed_by": F.lit("")})
    return s.review_updates(stored, rv, prefix_reviewer=True)


# Parts are the catalog; a user's queue holds the parts of its open orders; all other order lines are suggestions.
SUGGEST_SQL = """ l AS (SELECT o_custkey user_id, ((l_orderkey * 8 + l_linenumber) * 1000003 + l_partkey) * 10007 + l_suppkey ord, l_partkey p, l_linestatus = 'O' AND o_orderstatus = 'O' queued FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
 q AS (SELECT DISTINCT user_id, p FROM l WHERE queued), s AS (SELECT * FROM l WHERE NOT queued),
 vet AS (SELECT user_id, ord, 'already_in_catalog' status, p::VARCHAR existing_id, EXISTS (FROM q WHERE q.user_id = s.user_id AND q.p = s.p) reprioritized FROM s WHERE p % 4 = 0),
 rest AS (SELECT s.*, p // 3 g FROM s WHERE p % 4 <> 0),
 kn AS (SELECT DISTINCT user_id, p // 3 g FROM q WHERE p % 4 <> 0)"""


@query(
    "judge_suggestions",
    f"""WITH {SUGGEST_SQL} SELECT * FROM vet UNION ALL SELECT rest.user_id, ord, CASE WHEN kn.g IS NOT NULL OR row_number() OVER (PARTITION BY rest.user_id, rest.g ORDER BY ord) > 1 THEN 'already_in_queue' ELSE 'imported' END,
 NULL, false FROM rest LEFT JOIN kn ON kn.user_id = rest.user_id AND kn.g = rest.g""",
)
def judge_suggestions(spark, sf):
    l = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    p = F.col("l_partkey")
    vetted = p % 4 == 0
    # Joined and written once, as numbers; the queue and the suggestions are read from it.
    lines = cut(l.select(
        F.col("o_custkey").alias("user_id"), (((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1000003 + p) * 10007 + F.col("l_suppkey")).alias("ord"), "l_partkey",
        ((F.col("l_linestatus") == "O") & (F.col("o_orderstatus") == "O")).alias("queued"),
    ))
    rows = lines.select(
        "user_id", "ord", p.cast("string").alias("id"), "queued",
        F.when(vetted, F.concat(F.lit("https://P.example.org/"), p)).otherwise(F.concat(F.lit("https://u.example.org/"), p)).alias("source_url"),
        F.when(vetted, F.concat(F.lit("v"), p)).otherwise(F.concat(F.lit("n"), F.floor(p / 3))).alias("name"), F.lit("x.org").alias("source_domain"),
    )
    k = F.col("p_partkey")
    catalog_ = table(spark, sf, "part").filter(k % 4 == 0).select(
        k.alias("id"), F.concat(F.lit("https://p.example.org/"), k).alias("source_url"), F.concat(F.lit("offer "), k).alias("name"), F.lit("y.org").alias("source_domain")
    )
    queue = rows.filter("queued").select("user_id", "id", "source_url", "name", "source_domain")
    return s.judge_suggestions(rows.filter("not queued").drop("queued", "id"), catalog_, queue)


@query(
    "export_offers",
    f"WITH {CAND_SQL} SELECT id, 'Tier 1' source_tier, strftime(o_orderdate, '%Y-%m-%d') verified_at, award_amount FROM cand WHERE status = 'approved'",
)
def export_offers(spark, sf):
    return s.export_offers(candidates(spark, sf).filter("status = 'approved'")).select(
        "id", "source_tier", "verified_at", "award_amount"
    )


@query(
    "load_user_queue",
    """SELECT o_custkey user_id, l_partkey id, p_name AS name, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'approved' ELSE 'submitted' END status,
 CASE WHEN o_orderstatus <> 'O' THEN o_orderdate END reviewed_at, 30 effort_minutes FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey""",
)
def load_user_queue(spark, sf):
    st = F.col("o_orderstatus")
    q = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("scholarship_id"),
        F.when(st == "O", "queued").when(st == "F", "in_progress").otherwise("submitted").alias("status"),
        F.lit("").alias("notes"), F.col("o_orderdate").alias("last_action_at"), F.col("o_orderdate").alias("date_added"),
    )
    p = table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.lit("").alias("source_domain"), F.lit("").alias("source_url"),
        F.col("p_retailprice").alias("award_amount"), F.lit("").alias("deadline"), F.lit(0).alias("effort_minutes"),
    )
    return s.load_user_queue(q, p).select("user_id", "id", "name", "status", "reviewed_at", "effort_minutes")


@query(
    "upsert_offers",
    """WITH a AS (SELECT 'u' || o_custkey source_url, min(o_orderkey) id, arg_max(o_orderpriority, o_orderkey) title FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
 b AS (SELECT 'u' || o_custkey source_url, min(o_orderkey) + 10000000 id, arg_max('new ' || o_orderpriority, o_orderkey) title FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
 SELECT coalesce(a.source_url, b.source_url) source_url, coalesce(a.id, b.id) id, coalesce(b.title, a.title) title FROM a FULL JOIN b ON a.source_url = b.source_url""",
)
def upsert_offers(spark, sf):
    o = table(spark, sf, "orders")
    url = F.concat(F.lit("u"), F.col("o_custkey")).alias("source_url")
    old = o.filter("o_orderstatus = 'F'").groupBy(url).agg(
        F.min("o_orderkey").alias("id"), F.max_by("o_orderpriority", "o_orderkey").alias("title")
    )
    new = o.filter("o_orderstatus = 'O'").select(
        url, (F.col("o_orderkey") + 10000000).alias("id"), F.concat(F.lit("new "), F.col("o_orderpriority")).alias("title"),
        F.col("o_orderkey").alias("ord"),
    )
    return s.upsert_offers(old, new)


@query(
    "upsert_queue",
    """WITH q AS (SELECT DISTINCT o_custkey user_id, l_partkey scholarship_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'),
 l AS (SELECT DISTINCT o_custkey user_id, l_partkey scholarship_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'F')
 SELECT *, 'approved' status FROM q UNION ALL SELECT *, 'queued' FROM (SELECT * FROM l ANTI JOIN q USING (user_id, scholarship_id))""",
)
def upsert_queue(spark, sf):
    j = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("scholarship_id"), "o_orderstatus"
    )
    q = j.filter("o_orderstatus = 'F'").drop("o_orderstatus").distinct().withColumns({"status": F.lit("approved"), "notes": F.lit("")})
    return s.upsert_queue(q, j.filter("o_orderstatus <> 'F'").drop("o_orderstatus")).drop("notes")


@query(
    "suggested_offers",
    f"""WITH {URL_SQL}, f AS (SELECT canonical_url, 'Title ' || min(ord) title FROM canon WHERE ord % 5 = 1 GROUP BY 1),
 y AS (SELECT canon.*, f.title, regexp_replace(regexp_extract(regexp_replace(raw_path, '/+$', ''), '([^/]*)$', 1), '\\.[a-z0-9]+$', '') seg FROM canon LEFT JOIN f USING (canonical_url))
 SELECT ord, variant source_url, source_domain, CASE WHEN ord % 5 = 0 THEN 'Given ' || ord WHEN title IS NOT NULL THEN title ELSE upper(seg[1]) || seg[2:] END AS name,
  CASE WHEN ord % 2 = 0 THEN 500.0 WHEN title IS NOT NULL THEN 750 ELSE 0 END award_amount FROM y""",
)
def suggested_offers(spark, sf):
    p = table(spark, sf, "pages")
    k = F.col("page_id")
    urls = p.select(
        k.alias("ord"), "url", F.when(k % 5 == 0, F.concat(F.lit("Given "), k)).alias("name"),
        F.when(k % 2 == 0, 500.0).alias("award_amount"), F.lit("").alias("deadline"),
    )
    facts = p.filter(k % 5 == 1).groupBy(canonical_url("url").alias("canonical_url")).agg(
        F.concat(F.lit("Title "), F.min("page_id")).alias("title"), F.lit(750.0).alias("award_amount"), F.lit("").alias("deadline"),
    )
    return s.suggested_offers(urls, facts).select("ord", "source_url", "source_domain", "name", "award_amount")


@query(
    "refresh_metadata",
    """WITH f AS (SELECT c_custkey k, c_acctbal > 3000 has FROM customer), x AS (SELECT o_orderkey, o_custkey, o_totalprice > 250000 big, has FROM orders JOIN f ON k = o_custkey)
 SELECT o_orderkey ord, CASE WHEN has THEN 'Page ' || o_custkey ELSE 'Old' END AS name, CASE WHEN big THEN 1000.0 WHEN has THEN 250.0 ELSE 0 END award_amount,
  array_to_string(list_filter([CASE WHEN has THEN 'name' END, CASE WHEN has AND NOT big THEN 'awardAmount' END], lambda v: v IS NOT NULL), '|') changed FROM x""",
)
def refresh_metadata(spark, sf):
    c_ = table(spark, sf, "customer")
    facts = c_.filter("c_acctbal > 3000").select(
        F.concat(F.lit("https://d"), F.col("c_custkey"), F.lit(".example.org/")).alias("canonical_url"),
        F.concat(F.lit("Page "), F.col("c_custkey")).alias("title"), F.lit(250.0).alias("award_amount"), F.lit("").alias("deadline"),
    )
    x = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("ord"), F.lit("Old").alias("name"),
        F.concat(F.lit("https://d"), F.col("o_custkey"), F.lit(".example.org#x")).alias("source_url"),
        F.concat(F.lit("d"), F.col("o_custkey"), F.lit(".example.org")).alias("source_domain"),
        F.when(F.col("o_totalprice") > 250000, 1000.0).otherwise(0.0).alias("award_amount"), F.lit("").alias("deadline"),
    )
    return s.refresh_metadata(x, facts).select("ord", "name", "award_amount", F.array_join("changed_fields", "|").alias("changed"))
