"""Stored pages, documents and pages derived from parts."""

from pyspark.sql import functions as F

from ..functions import vocab as v
from ..operators import bundles as b
from ..operators import links as li
from ..operators import pages as p
from ..operators import routing as r
from ..operators import safety as sf_
from ..session import cut
from .registry import query
from .tables import PAGES_AS_OF, offer_pages, table

TEXT_SQL = r"""
 t AS (SELECT page_id, url,
   trim(regexp_replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '<script.*?</script>', ' ', 'gis'),
     '<style.*?</style>', ' ', 'gis'), '<[^>]+>', ' ', 'g'), '&amp;', '&'), '&quot;', '"'), '[\s ]+', ' ', 'g')) AS text,
   trim(regexp_replace(replace(replace(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', ' ', 'g'), '&amp;', '&'), '&quot;', '"'), '[\s ]+', ' ', 'g')) title
   FROM pages)"""


@query("page_text", f"WITH {TEXT_SQL} SELECT page_id, title, text, length(text) n_chars FROM t")
def page_text(spark, sf):
    return p.page_text(table(spark, sf, "pages")).select(
        "page_id", "title", "text", F.length("text").alias("n_chars")
    )


SENT_SQL = r"""
 s AS (SELECT doc_id, list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), '[\r\n]+'),
   lambda x: trim(regexp_replace(x, '[\s ]+', ' ', 'g'))), lambda x: length(x) >= 20) l FROM documents),
 e AS (SELECT doc_id, unnest(l) sentence, generate_subscripts(l, 1) - 1 pos FROM s)"""


REQ_SQL = f"""(regexp_matches(sentence, '(?i){p.v.REQUIREMENT}') OR (regexp_matches(sentence, '(?i){p.v.REQUIREMENT_SUBJECT}')
   AND regexp_matches(sentence, '(?i){p.v.REQUIREMENT_DETAIL}') AND regexp_matches(sentence, '(?i){p.v.REQUIREMENT_MODAL}')))"""


@query(
    "page_sentences",
    f"""WITH {SENT_SQL}, m AS (SELECT *, {REQ_SQL} req FROM e),
 n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, req ORDER BY pos) rn FROM m)
 SELECT doc_id, pos, sentence, CASE WHEN req AND rn <= 8 THEN rn END requirement_rank FROM n""",
)
def page_sentences(spark, sf):
    return p.page_sentences(table(spark, sf, "documents"), "doc_id", most=v.LIMITS["requirements"])


# Word rules that occur in the test documents.
TEST_RULES = [
    (r"\bthe\b", ["article", "english"]),
    (r"\band\b|\bor\b", ["link", "english"]),
    (r"\bder\b|\bdie\b", ["article", "german"]),
    (r"\bla\b|\blos\b", ["article", "romance"]),
    (r"\bque\b", ["link", "romance"]),
]


@query(
    "tag_lexicon",
    "SELECT doc_id, array_to_string(list_sort(list_distinct(flatten(["
    + ", ".join(
        f"CASE WHEN regexp_matches(text, '(?i){pat}') THEN {vals!r} ELSE []::VARCHAR[] END" for pat, vals in TEST_RULES
    )
    + "]))), ' ') tags FROM documents",
)
def tag_lexicon(spark, sf):
    tagged = p.tag_lexicon(table(spark, sf, "documents"), "text", TEST_RULES, "tags", scan_once=True)
    return tagged.select("doc_id", F.array_join(F.array_sort("tags"), " ").alias("tags"))


@query(
    "scan_sensitive",
    r"""WITH f AS (SELECT source, lang, text, regexp_matches(text, '\b\d{3}-\d{2}-\d{4}\b') a, regexp_matches(text, '\b\d{9}\b') b,
 regexp_matches(text, '\b[0-9]{13,19}\b') c,
 len(list_filter(regexp_extract_all(text, '\b[A-Z0-9]{6,9}\b'), lambda x: regexp_matches(x, '[A-Z]') AND regexp_matches(x, '\d'))) > 0 d FROM documents)
 SELECT source, count(*) n_rows, 0 n_name, count(*) FILTER (a) n_ssn, count(*) FILTER (b) n_nine_digits, count(*) FILTER (c) n_card,
 count(*) FILTER (d) n_token, count(*) FILTER (a OR b OR c OR d) n_sensitive FROM f GROUP BY 1""",
)
def scan_sensitive(spark, sf):
    return sf_.sensitive_counts(sf_.scan_sensitive(table(spark, sf, "documents"), "lang", "text"), "source")


LINK_SQL = r"""
 a AS (SELECT page_id, url src, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*href=["'']([^"'']+)["''][^>]*>(.*?)</a>')) an,
   generate_subscripts(regexp_extract_all(html, '(?is)<a\b[^>]*href=["'']([^"'']+)["''][^>]*>(.*?)</a>'), 1) AS position FROM pages),
 x AS (SELECT page_id, src, position, trim(regexp_extract(an, '(?is)href=["'']([^"'']+)["'']', 1)) href,
   trim(regexp_replace(regexp_replace(regexp_extract(an, '(?is)>(.*?)</a>', 1), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) anchor FROM a),
 y AS (SELECT *, regexp_extract(src, '^(https?)://', 1) || '://' || regexp_extract(src, '^https?://([^/?#]+)', 1) || href target FROM x),
 l AS (SELECT page_id, position, regexp_replace(split_part(split_part(target, '#', 1), '?', 1), '/+$', '') url, anchor anchor_text,
   regexp_replace(regexp_extract(src, '^https?://([^/?#]+)', 1), '^www\.', '') source_domain, true same_domain,
   CASE WHEN anchor <> '' THEN 1.0 ELSE 0.0 END score FROM y WHERE href LIKE '/%')"""


def _links(spark, sf):
    return li.page_links(table(spark, sf, "pages"), keep=r"[^ ]", drop=r"\b(nolinkword)\b")


@query("page_links", f"WITH {LINK_SQL} SELECT page_id, position, url, anchor_text, source_domain, same_domain, score FROM l")
def page_links(spark, sf):
    return _links(spark, sf).select(
        "page_id", "position", "url", "anchor_text", "source_domain", "same_domain", "score"
    )


@query(
    "cap_links",
    f"""WITH {LINK_SQL}, d AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY page_id, url ORDER BY score DESC, position) = 1),
 k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, position) page_rank FROM d) WHERE page_rank <= 15),
 n AS (SELECT page_id, count(*) n FROM k GROUP BY 1),
 c AS (SELECT page_id, 50 - coalesce(sum(n) OVER (PARTITION BY page_id % 20 ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) room FROM n)
 SELECT page_id % 20 batch_id, page_id, url, page_rank FROM k JOIN c USING (page_id) WHERE page_rank <= room""",
)
def cap_links(spark, sf):
    batches = table(spark, sf, "pages").select(
        (F.col("page_id") % 20).alias("batch_id"), "page_id", F.col("page_id").alias("page_ord")
    )
    return li.cap_links(_links(spark, sf), batches, v.LIMITS["links_per_page"], v.LIMITS["links_per_batch"]).select("batch_id", "page_id", "url", "page_rank")


@query(
    "classify_fetch",
    r"""SELECT page_id, CASE WHEN page_id % 11 = 3 THEN 'error' WHEN page_id % 7 = 2 THEN 'unsupported_content_type' ELSE 'ok' END fetch_status,
 page_id % 11 = 3 OR page_id % 7 = 2 AS access_blocked,
 CASE WHEN page_id % 11 = 3 OR page_id % 7 = 2 THEN 0 ELSE length(html) END n_html FROM pages""",
)
def classify_fetch(spark, sf):
    pages = table(spark, sf, "pages").withColumns(
        {
            "http_status": F.when(F.col("page_id") % 11 == 3, 500).otherwise(200),
            "content_type": F.when(F.col("page_id") % 7 == 2, "application/pdf").otherwise("text/html"),
        }
    )
    return p.classify_fetch(pages).select(
        "page_id", "fetch_status", "access_blocked", F.length("html").alias("n_html")
    )


# ---- pages derived from parts ----------------------------------------------------------------


def facts_of(pages):
    return p.page_facts(p.with_sentences(p.page_text(pages), most=v.LIMITS["requirements"]), v.LIMITS["essay_prompts"])


def _facts(spark, sf):
    return facts_of(p.classify_fetch(offer_pages(spark, sf)))


PART_SQL = """
 base AS (SELECT p_partkey page_id, p_partkey // 40 run_id, p_size % 10 kind, p_name, floor(p_retailprice)::DOUBLE award,
   CASE WHEN p_size % 10 = 5 THEN 'fastweb.com' ELSE 'site' || (p_partkey % 211) || '.example.org' END source_domain,
   replace(p_name, ' ', '-') slug, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') n FROM part)
"""


@query(
    "page_facts",
    f"""WITH {PART_SQL} SELECT page_id, CASE WHEN kind IN (0, 1, 2, 5) THEN award ELSE 0 END award_amount,
 CASE kind WHEN 0 THEN '2026-06-15' WHEN 2 THEN '2020-06-15' ELSE '' END deadline,
 CASE kind WHEN 0 THEN 3.25 END min_gpa, kind = 1 AS closed_words, false AS requires_account,
 CASE kind WHEN 0 THEN 'Apply online with an essay today.' ELSE '' END prompts,
 CASE kind WHEN 0 THEN 1 ELSE 0 END n_requirements FROM base""",
)
def page_facts(spark, sf):
    return _facts(spark, sf).select(
        "page_id", "award_amount", "deadline", "min_gpa", "closed_words", "requires_account",
        F.array_join("essay_prompts", "|").alias("prompts"),
        F.size("requirements").alias("n_requirements"),
    )


@query(
    "stale_pages",
    f"""WITH {PART_SQL} SELECT source_domain, count(*) n_pages, round(avg((kind = 2)::INT), 3) stale_cycle_share,
 round(avg((kind = 2)::INT), 3) expired_share, round(avg((kind = 1)::INT), 3) closed_share FROM base GROUP BY 1""",
)
def stale_pages(spark, sf):
    return p.stale_shares(p.stale_flags(_facts(spark, sf), PAGES_AS_OF))


def part_links(spark, sf):
    return cut(li.page_links(offer_pages(spark, sf)))


def part_bundles(spark, sf, links=None):
    """Bundles as a table of their own: later jobs read them more than once. ``links`` are those of :func:`part_links`."""
    pages = p.classify_fetch(offer_pages(spark, sf))
    links = part_links(spark, sf) if links is None else links
    return cut(b.page_bundles(facts_of(pages), li.link_counts(links, v.LIMITS["links_per_page"]), PAGES_AS_OF))


@query(
    "evidence_snippets",
    f"""WITH {PART_SQL}, ev AS (SELECT page_id,
   CASE kind WHEN 0 THEN 'Application deadline: June 15, 2026.' WHEN 1 THEN 'Sorry, the deadline has passed for this one.' WHEN 2 THEN 'Deadline: June 15, 2020 for every form sent.' END deadline,
   CASE kind WHEN 0 THEN 'Applicants must have a minimum 3.25 GPA and be residents of Texas.' WHEN 5 THEN 'Apply at official website More by major scholarship' END eligibility,
   CASE kind WHEN 0 THEN n || ' Scholarship ' || n || ' Scholarship The ' || n || ' Scholarship awards up to $' || award::INT || ' to each winner.'
     WHEN 1 THEN n || ' Award ' || n || ' Award The ' || n || ' Award was worth $' || award::INT || ' last time around.'
     WHEN 2 THEN n || ' Grant ' || n || ' Grant The ' || n || ' Grant gives winners $' || award::INT || ' for mechanical engineering.'
     WHEN 3 THEN 'One ' || n || ' scholarship Two ' || n || ' award About us Three scholarship'
     WHEN 4 THEN n || ' fund scholarship Official ' || n || ' award Program guidelines award'
     WHEN 5 THEN n || ' Scholarship ' || n || ' Scholarship See the scholarship directory for more of these.' END amount,
   CASE kind WHEN 5 THEN 'The ' || n || ' Scholarship awards $' || award::INT || ' to freshman students.' END stage,
   CASE kind WHEN 1 THEN 'Sorry, the deadline has passed for this one.' END closed FROM base) SELECT * FROM ev""",
)
def evidence_snippets(spark, sf):
    e = part_bundles(spark, sf)
    return e.select("page_id", *[F.col(f"evidence.{k}").alias(k) for k in p.v.EVIDENCE])


# What each page kind must look like, worked out from its text.
KIND_SQL = """ kinds AS (SELECT * FROM (VALUES
   (0, 0, false, false, false, false, true, false, false, true, false, false, true, true, true, true, false, false, false, 'strong', 'advance_to_finalize', 0),
   (1, 0, true, false, false, false, false, false, false, true, false, false, false, true, false, false, false, false, false, 'closed', 'drop', 0),
   (2, 0, true, true, false, true, false, false, false, true, false, false, true, true, false, false, false, false, false, 'closed', 'drop', 0),
   (3, 2, false, false, false, false, false, false, false, false, true, true, false, false, false, false, true, false, false, 'gateway', 'hold_for_expansion', 2),
   (4, 3, false, false, false, false, false, true, true, false, true, true, false, false, false, false, false, false, true, 'mirror_hold', 'hold_for_expansion', 3),
   (5, 2, false, false, false, false, false, false, false, false, false, true, false, true, false, true, true, true, true, 'mirror_hold', 'hold_for_expansion', 2),
   (6, 0, false, false, true, false, false, false, false, false, false, false, false, false, false, false, false, false, false, 'access', 'drop', 0),
   (7, 0, false, false, true, false, false, false, false, false, false, false, false, false, false, false, false, false, false, 'access', 'drop', 0),
   (8, 0, false, false, false, false, false, false, false, false, false, false, false, false, false, false, false, false, false, 'explainer', 'drop', 0),
   (9, 0, false, false, false, false, false, false, false, false, false, false, false, false, false, false, false, false, false, 'default', 'drop', 0)
   ) k(kind, n_links, closed, past_cycle, access_blocked, fit_major, fit_state, fit_institution, fit_school, is_direct, is_hub, is_list,
       is_deadline, is_amount, is_eligibility, is_application, is_indirect, is_aggregator, is_original_source, rule, action, n_promising))"""


@query(
    "page_bundles",
    f"""WITH {PART_SQL}, {KIND_SQL} SELECT page_id, n_links, closed, past_cycle, false AS stage_mismatch, access_blocked,
 fit_major, fit_state, false AS fit_stage, fit_institution, fit_school, is_direct, is_hub, is_list, is_deadline, is_amount, is_eligibility,
 is_application, is_indirect, is_aggregator, is_original_source,
 CASE kind WHEN 0 THEN n || ' Scholarship' WHEN 1 THEN n || ' Award' WHEN 2 THEN n || ' Grant' WHEN 3 THEN 'Best scholarships for ' || n || ' fans'
  WHEN 4 THEN 'Department scholarships' WHEN 5 THEN n || ' Scholarship' WHEN 6 THEN 'https://' || source_domain || '/gone/' || page_id
  WHEN 7 THEN 'https://' || source_domain || '/file/' || page_id WHEN 8 THEN 'What is student aid' ELSE n END title
 FROM base JOIN kinds USING (kind)""",
)
def page_bundles(spark, sf):
    e = part_bundles(spark, sf)
    return e.select(
        "page_id", "title", "n_links", "blockers.*",
        *[F.col(f"fit.{k}").alias(f"fit_{k}") for k in ("major", "state", "stage", "institution", "school")],
        *[F.col(f"signals.{k}").alias(f"is_{k}") for k in ("direct", "hub", "list", "deadline", "amount", "eligibility", "application", "indirect", "aggregator", "original_source")],
    )


def part_decisions(spark, sf, variants=("control", "trusted_agg_conservative", "trusted_agg_moderate")):
    links = part_links(spark, sf)
    both = part_bundles(spark, sf, links).withColumn(
        "variant_name", F.explode(F.array(*[F.lit(x) for x in variants]))
    )
    return r.triage_pages(
        both, links, ["page_id"], variant=F.col("variant_name")
    ).drop("variant_name")


VARIANT_SQL = "(VALUES ('control'), ('trusted_agg_conservative'), ('trusted_agg_moderate')) v(variant)"


@query(
    "triage_pages",
    f"WITH {PART_SQL}, {KIND_SQL} SELECT page_id, variant, n_promising, rule, action FROM base JOIN kinds USING (kind), {VARIANT_SQL}",
)
def triage_pages(spark, sf):
    return part_decisions(spark, sf).select("page_id", "variant", "n_promising", "rule", "action")


@query(
    "triage_queues",
    f"""WITH {PART_SQL}, {KIND_SQL} SELECT run_id, variant, count(*) FILTER (action LIKE 'adv%') n_advance, count(*) FILTER (action LIKE 'hold%') n_hold,
 count(*) FILTER (action = 'drop') n_drop FROM base JOIN kinds USING (kind), {VARIANT_SQL} GROUP BY 1, 2""",
)
def triage_queues(spark, sf):
    return r.triage_queues(part_decisions(spark, sf))


def _ordered_links(spark, sf):
    """Links in bundle order: best first, as the hub jobs read them."""
    return li.best_links(part_links(spark, sf), v.LIMITS["links_per_page"]).drop("position").withColumnRenamed("page_rank", "position").withColumn(
        "seen_recently", F.lit(False)
    )


CHILD_SQL = f""" ch AS (
   SELECT page_id, run_id, kind, n, 'https://' || source_domain || '/scholarships/one-' || page_id url, 1 pos FROM base WHERE kind = 3
   UNION ALL SELECT page_id, run_id, kind, n, 'https://' || source_domain || '/scholarships/two-' || page_id, 2 FROM base WHERE kind = 3
   UNION ALL SELECT page_id, run_id, kind, n, 'https://other' || ((page_id + 1) % 97) || '.example.com/scholarships/x-' || page_id, 1 FROM base WHERE kind = 4
   UNION ALL SELECT page_id, run_id, kind, n, 'https://' || source_domain || '/programs/fund-' || page_id, 2 FROM base WHERE kind = 4
   UNION ALL SELECT page_id, run_id, kind, n, 'https://' || source_domain || '/programs/guidelines', 3 FROM base WHERE kind = 4
   UNION ALL SELECT page_id, run_id, kind, n, 'https://sponsor' || ((page_id + 1) % 97) || '.example.com/apply/' || page_id, 1 FROM base WHERE kind = 5
   UNION ALL SELECT page_id, run_id, kind, n, 'https://www.fastweb.com/scholarships/by-major', 2 FROM base WHERE kind = 5)"""


@query(
    "select_children",
    f"""WITH {PART_SQL}, {CHILD_SQL} SELECT page_id, url,
 CASE kind WHEN 3 THEN 6.0 WHEN 4 THEN CASE pos WHEN 1 THEN 5.0 ELSE 3.0 END ELSE CASE pos WHEN 1 THEN 6.0 ELSE -1.0 END END::DOUBLE child_score,
 NOT (kind = 5 AND pos = 2) AS selected, CASE WHEN kind = 5 THEN 1 ELSE pos END pick,
 CASE WHEN kind = 3 OR (kind = 4 AND pos = 1) THEN 'Looks like a likely scholarship-detail child worth fetching next.'
   WHEN kind = 5 AND pos = 1 THEN 'Looks like an offsite original-source path for an aggregator summary page.'
   ELSE 'Anchor text or URL suggests this is a scholarship-oriented child page.' END reason FROM ch""",
)
def select_children(spark, sf):
    out = r.select_children(_ordered_links(spark, sf), part_bundles(spark, sf), ["page_id"])
    return out.select("page_id", "url", "child_score", "selected", "pick", "reason")


@query(
    "extract_leads",
    f"""WITH {PART_SQL}, {CHILD_SQL}, ok AS (SELECT * FROM ch WHERE NOT (kind = 4 AND pos = 3)),
 idx AS (SELECT DISTINCT run_id, page_id, dense_rank() OVER (PARTITION BY run_id ORDER BY page_id) - 1 i FROM ok)
 SELECT run_id, page_id, url lead_url,
 CASE WHEN kind = 3 AND pos = 1 THEN 'One ' || n || ' scholarship' WHEN kind = 3 THEN 'Two ' || n || ' award'
  WHEN kind = 4 AND pos = 1 THEN 'Official ' || n || ' award' WHEN kind = 4 THEN n || ' fund scholarship'
  WHEN pos = 1 THEN page_id::VARCHAR ELSE 'More by major scholarship' END lead_name,
 CASE WHEN kind IN (4, 5) AND pos = 1 THEN 'official_source' ELSE 'scholarship_detail' END lead_type,
 CASE WHEN kind = 3 THEN 6 WHEN kind = 4 AND pos = 1 THEN 12 WHEN kind = 4 THEN 4 WHEN pos = 1 THEN 7 ELSE 2 END::DOUBLE lead_score,
 CASE WHEN kind = 3 THEN 'medium' WHEN pos = 1 THEN 'high' WHEN kind = 4 THEN 'medium' ELSE 'low' END verification_priority,
 CASE WHEN kind = 5 THEN 'aggregator_hub' ELSE 'scholarship_hub' END source_type,
 kind = 3 OR (kind = 5 AND pos = 2) AS needs_verification, pos lead_rank
 FROM ok JOIN idx USING (run_id, page_id) WHERE pos <= 15 - 2 * i""",
)
def extract_leads(spark, sf):
    leads, _ = r.extract_leads(
        _ordered_links(spark, sf), part_bundles(spark, sf), ["page_id"], "starting_college"
    )
    return leads.select(
        "run_id", "page_id", "lead_url", "lead_name", "lead_type", "lead_score",
        "verification_priority", "source_type", "needs_verification", "lead_rank",
    )


@query(
    "rejected_links",
    f"""WITH {PART_SQL}, {CHILD_SQL} SELECT page_id, url,
 'Generic advice, search, provider, or directory page rather than a named scholarship lead.' reason, 1 pick FROM ch WHERE kind = 4 AND pos = 3""",
)
def rejected_links(spark, sf):
    _, rejected = r.extract_leads(
        _ordered_links(spark, sf), part_bundles(spark, sf), ["page_id"], "starting_college"
    )
    return rejected.select("page_id", "url", "reason", "pick")


def part_candidates(spark, sf):
    pages = p.classify_fetch(offer_pages(spark, sf)).filter("fetch_status = 'ok'")
    crawl = li.page_links(offer_pages(spark, sf), li.v.LINK_KEEP_CRAWL, li.v.LINK_DROP_CRAWL, crawl=True)
    counts = li.best_links(crawl, 12).groupBy("page_id").agg(F.count("*").alias("n_links"))
    return b.extract_candidates(facts_of(pages), counts, PAGES_AS_OF)


@query(
    "extract_candidates",
    f"""WITH {PART_SQL} SELECT page_id,
 CASE WHEN kind IN (1, 2) THEN 'scholarship_closed' WHEN kind IN (3, 4, 5) THEN 'scholarship_list_page' WHEN kind IN (8, 9) THEN 'insufficient_scholarship_signals' END skip_reason,
 CASE kind WHEN 0 THEN n || ' Scholarship' WHEN 1 THEN n || ' Award' WHEN 2 THEN n || ' Grant' WHEN 3 THEN 'Best scholarships for ' || n || ' fans'
  WHEN 4 THEN 'Department scholarships' WHEN 5 THEN n || ' Scholarship' WHEN 8 THEN 'What is student aid' ELSE n END AS name,
 CASE kind WHEN 5 THEN 'Fastweb' ELSE 'Site' || (page_id % 211) || ' Example' END source_name,
 CASE WHEN kind IN (0, 1, 2, 5) THEN award ELSE 0 END award_amount,
 CASE kind WHEN 0 THEN '2026-06-15' WHEN 2 THEN '2020-06-15' ELSE '' END deadline, CASE kind WHEN 0 THEN 3.25 END min_gpa,
 CASE kind WHEN 3 THEN 2 WHEN 4 THEN 2 WHEN 5 THEN 1 ELSE 0 END n_links, '' majors, CASE kind WHEN 0 THEN 'TX' ELSE '' END states, '' stages,
 array_to_string(list_filter([CASE WHEN kind NOT IN (0, 2) THEN 'missing_deadline' END, CASE WHEN kind NOT IN (0, 1, 2, 5) THEN 'missing_award_amount' END,
  CASE WHEN kind <> 0 THEN 'missing_requirement_statements' END], lambda x: x IS NOT NULL), '|') ambiguity FROM base WHERE kind NOT IN (6, 7)""",
)
def extract_candidates(spark, sf):
    return part_candidates(spark, sf).select(
        "page_id", "skip_reason", "name", "source_name", "award_amount", "deadline", "min_gpa", "n_links",
        F.array_join("allowed_majors", "|").alias("majors"),
        F.array_join("required_states", "|").alias("states"),
        F.array_join("required_stages", "|").alias("stages"),
        F.array_join("ambiguity_flags", "|").alias("ambiguity"),
    )


@query(
    "review_queue",
    f"WITH {PART_SQL} SELECT page_id, n || ' Scholarship' AS name, 'rejected_list' review_kind FROM base WHERE kind = 5",
)
def review_queue(spark, sf):
    return b.review_queue(part_candidates(spark, sf)).select("page_id", "name", "review_kind")
