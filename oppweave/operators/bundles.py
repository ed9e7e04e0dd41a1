"""Page bundles: blockers, fit and page signals; candidates from pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as v
from ..functions.lexicon import (
    rule_matches, stage_conflicts, stage_fits, state_code, student_stage, tag_states, tag_values,
)
from ..functions.text import flag, has, listed, nonblank
from ..functions.urls import path
from .hits import detail_path, hub_path, indirect, years_are_stale
from .pages import evidence_snippets, expired_deadline, expired_partial

PLURAL_URL = r"/scholarships/|[-_/]scholarships(?:[-_/]|$)"
OFFER_ROOTS = r"/scholarships?/?$|/scholarships/scholarships/?$"
PROFILE_COLUMNS = ["intended_major", "ethnicity", "state", "grade_level", "student_stage"]


def _lead(text: Column, lead_chars: int | None) -> Column:
    return F.substring(text, 1, lead_chars) if lead_chars else text


def required_stages(title: Column, statements: Column) -> Column:
    """Stages asked for by the title (if it names one) and the statements."""
    text = F.concat_ws(" ", F.when(has(title, v.STAGE_TITLE), title), F.array_join(statements, " "))
    return tag_values(text, v.REQUIRED_STAGES, scan_once=False)


def aggregator(text: Column, dom: Column, p: Column) -> Column:
    """Does the page summarise offers that live on other sites?"""
    return (
        has(dom, v.AGGREGATOR_DOMAINS)
        | has(p, v.AGGREGATOR_PATHS)
        | has(F.concat_ws(" ", text, p), v.AGGREGATOR_CUES)
    )


def list_page(title: Column, url: Column, text: Column, n_links: Column, p: Column) -> Column:
    """Does the page list several offers?"""
    plural = has(title, v.PLURAL) | has(url, PLURAL_URL)
    return (
        has(F.concat_ws("\n", title, url, text), v.LIST_CUES_PAGE)
        | has(p, OFFER_ROOTS)
        | has(p, v.CATEGORY_PATH)
        | (plural & (n_links >= 2))
    )


def page_bundles(
    facts: DataFrame, counts: DataFrame, as_of: str, lead_chars: int | None = None
) -> DataFrame:
    """Blockers, fit signals, page signals and evidence of each page.

    ``facts`` is ``page_facts`` output that also carries the profile columns;
    ``counts`` is ``link_counts``.  ``lead_chars`` limits some cues to the start of
    the text; by default whole texts count.
    """
    df = facts.join(counts, "page_id", "left")
    title, text, url, dom = (F.col(c) for c in ("title", "text", "canonical_url", "source_domain"))
    n_links = F.coalesce("n_links", F.lit(0))
    year = F.year(F.lit(as_of).cast("timestamp"))
    df = df.withColumns(
        {
            "__path": F.lower(path(url)),
            "__head": F.concat_ws("\n", title, _lead(text, lead_chars)),
            "__all": F.concat_ws("\n", title, text),
        }
    )
    p, head, all_text = F.col("__path"), F.col("__head"), F.col("__all")
    df = df.withColumns(
        {
            "stages": required_stages(
                title, F.concat(F.col("requirements"), F.col("stage_sentences"))
            ),
            "profile_stage": student_stage("student_stage", "grade_level"),
            "profile_state": state_code("state"),
            "major_match": rule_matches(tag_values(all_text, v.MAJORS), "intended_major"),
            "ethnicity_match": rule_matches(tag_values(all_text, v.ETHNICITIES), "ethnicity"),
            "page_states": tag_states(all_text),
            "institution_specific": dom.endswith(".edu") | has(head, v.PAGE_INSTITUTION),
            "specific_school": dom.endswith(".edu") | has(head, v.PAGE_SCHOOL[0])
            | has(head, v.PAGE_SCHOOL[1]),
            "indirect_words": indirect(head, dom, p, v.INDIRECT_PAGE),
            "aggregator": aggregator(head, dom, p),
            "past_cycle": years_are_stale(F.regexp_replace(head, "\n", " "), year, v.STALE_WORDS_PAGE),
            "application": has(all_text, v.PAGE_APPLICATION),
            "deadline_known": (F.col("deadline") != "") | F.col("partial_deadline").isNotNull(),
            "original_source": flag(F.col("source_link")),
        }
    )
    df = df.withColumns(
        {
            "list_like": list_page(title, url, text, n_links, p) | F.col("aggregator"),
            "closed": F.col("closed_words") | expired_deadline(F.col("deadline"), as_of)
            | expired_partial(F.col("partial_deadline"), as_of),
            "state_match": (F.col("profile_state") != "")
            & F.array_contains("page_states", F.col("profile_state")),
            "stage_match": stage_fits(F.col("stages"), F.col("profile_stage")),
            "stage_mismatch": stage_conflicts(F.col("stages"), F.col("profile_stage")),
        }
    )
    proofs = (
        (F.col("award_amount") > 0).cast("int") + (F.col("deadline") != "").cast("int")
        + (F.size("requirements") > 0).cast("int")
    )
    direct = (
        ~F.col("list_like") & ~F.col("indirect_words") & ~F.col("aggregator")
        & (detail_path(p) | (has(title, v.KEYWORD) & ~has(title, v.PLURAL)) | (proofs >= 2))
    )
    df = df.withColumn("direct", direct)
    df = df.withColumn(
        "hub", ~F.col("direct") & (hub_path(p) | (has(title, v.PLURAL) & F.col("institution_specific")))
    )
    df = evidence_snippets(df)
    blocked = F.col("access_blocked") if "access_blocked" in df.columns else F.lit(False)
    bundle = df.withColumns(
        {
            "evidence": F.struct(*[F.col(f"{k}_snippet").alias(k) for k in v.EVIDENCE]),
            "blockers": F.struct(
                F.col("closed"), F.col("past_cycle"), F.col("stage_mismatch"),
                blocked.alias("access_blocked"),
            ),
            "fit": F.struct(
                F.col("major_match").alias("major"), F.col("ethnicity_match").alias("ethnicity"),
                F.col("state_match").alias("state"), F.col("stage_match").alias("stage"),
                F.col("institution_specific").alias("institution"), F.col("specific_school").alias("school"),
            ),
            "signals": F.struct(
                F.col("direct"), F.col("hub"), F.col("list_like").alias("list"),
                F.col("deadline_known").alias("deadline"), (F.col("award_amount") > 0).alias("amount"),
                (F.size("requirements") > 0).alias("eligibility"), F.col("application"),
                (F.col("indirect_words") | F.col("aggregator")).alias("indirect"),
                F.col("aggregator"), F.col("original_source"),
            ),
            "n_links": n_links,
        }
    )
    keep = [c for c in ("run_id", "profile_id", "ord") if c in bundle.columns]
    return bundle.select(
        *keep, "page_id", "url", "canonical_url", "source_domain", "title", "n_links", "evidence",
        "blockers", "fit", "signals",
    )


# ---- candidates ------------------------------------------------------------------------------


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit("(?i)" + pattern.replace(r"\b", r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))")))


def crawl_list_page(df: DataFrame) -> Column:
    """List test of the candidate extractor; counts links, amounts and deadlines."""
    title, url, text = F.col("title"), F.col("url"), F.col("text")
    p, n, both = F.col("__path"), F.coalesce("n_links", F.lit(0)), F.col("__all")
    mentions = _count(text, r"\bscholarship\b")
    plural = has(title, v.PLURAL) | has(url, PLURAL_URL)
    applies = has(both, r"\b(apply|application|guidelines|eligibility|program)\b")
    return (
        has(both, v.LIST_CUES_PAGE)
        | (p.rlike("^/?$") & (n >= 3) & (mentions >= 3))
        | has(p, OFFER_ROOTS)
        | has(p, v.CATEGORY_PATH)
        | has(title, v.LIST_TITLE)
        | (plural & (~detail_path(p) | (n >= 2)) & ~applies)
        | (plural & (n >= 3))
        | (_count(text, v.MONEY) >= 3)
        | (_count(text, r"\b(deadline|apply by|applications due|due date)\b") >= 3)
        | ((mentions >= 8) & (F.col("n_anchors") >= 12))
    )


def _looks_like_offer() -> Column:
    title, p, both = F.col("title"), F.col("__path"), F.col("__all")
    detail = detail_path(p)
    singular = has(title, v.KEYWORD) & ~has(title, v.PLURAL)
    applies = has(both, r"\b(apply|application deadline|how to apply|eligibility requirements?)\b")
    amount, due = F.col("award_amount") > 0, F.col("deadline") != ""
    signals = sum(
        (
            x.cast("int")
            for x in (
                has(both, r"\b(scholarship|grant|fellowship|award|tuition assistance)\b"),
                singular, detail, amount, due, F.size("requirements") > 0,
            )
        ),
        F.lit(0),
    )
    return (
        ~((p == "/") & ~singular & ~due)
        & (detail | singular | amount | due)
        & (detail | singular | applies)
        & (signals >= 3)
    )


def _joined(pattern: str) -> Column:
    return F.array_join(F.filter("requirements", lambda s: has(s, pattern)), " ")


def domain_label(dom: Column) -> Column:
    """Readable name of a domain: labels without the last one, capitalised."""
    labels = F.split(F.regexp_replace(dom, r"^www\.", ""), r"\.")
    root = F.array_join(F.slice(labels, 1, F.greatest(F.size(labels) - 1, F.lit(1))), " ")
    return F.initcap(F.trim(F.regexp_replace(root, r"[-\s]+", " ")))


def extract_candidates(
    facts: DataFrame, counts: DataFrame, as_of: str, allow_lists: Column | None = None
) -> DataFrame:
    """Each page as an offer candidate, or the reason it is none.

    ``counts`` are the crawl form's links per page (``n_links``).
    """
    df = facts.join(counts.select("page_id", "n_links"), "page_id", "left")
    # The extractor prefers the heading to the document title.
    df = df.withColumn(
        "title", F.coalesce(nonblank("heading"), nonblank("document_title"), F.col("url"))
    )
    df = df.withColumns(
        {"__path": F.lower(path("url")), "__all": F.concat_ws("\n", "title", "url", "text")}
    )
    lists = F.lit(False) if allow_lists is None else flag(allow_lists)
    df = df.withColumns({"is_list": ~lists & crawl_list_page(df), "offer_like": _looks_like_offer()})
    closed = has("title", v.CLOSED) | has("text", v.CLOSED) | expired_deadline(F.col("deadline"), as_of)
    df = df.withColumn(
        "skip_reason",
        F.when(closed, "scholarship_closed")
        .when(F.col("is_list"), "scholarship_list_page")
        .when(~F.col("offer_like"), "insufficient_scholarship_signals"),
    )
    words = r"\b(major|majoring|degree|studying|study|enrolled|pursuing)\b"
    groups = (
        r"\b(hispanic|latino|latina|latinx|black|african american|asian|asian american"
        r"|native american|indigenous|american indian|pacific islander|native hawaiian"
        r"|middle eastern|mena)\b"
    )
    places = r"\b(resident|residents|state|states|live in|residing)\b"
    df = df.withColumns(
        {
            "name": F.col("title"),
            "source_url": F.trim("url"),
            "source_name": domain_label(F.col("source_domain")),
            "effort_minutes": F.when((F.size("requirements") >= 5) | F.col("requires_account"), 60).otherwise(30),
            "allowed_majors": tag_values(_joined(words), v.MAJORS),
            "allowed_ethnicities": tag_values(_joined(groups), v.ETHNICITIES),
            "required_states": tag_states(_joined(places)),
            "required_stages": required_stages(F.col("title"), F.col("requirements")),
            "ambiguity_flags": listed(
                (F.col("deadline") == "", "missing_deadline"),
                (F.col("award_amount") == 0, "missing_award_amount"),
                (F.size("requirements") == 0, "missing_requirement_statements"),
            ),
        }
    )
    keep = [c for c in ("run_id", "profile_id", "depth", "global_rank", "query") if c in df.columns]
    return df.select(
        *keep, "page_id", "skip_reason", "name", "source_domain", "source_url", "source_name",
        "award_amount", "deadline", "requires_account", "effort_minutes", "min_gpa", "allowed_majors",
        "allowed_ethnicities", "required_states", "required_stages", "min_age", "max_age",
        F.col("requirements").alias("statements"), "essay_prompts", "ambiguity_flags",
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def review_queue(candidates: DataFrame) -> DataFrame:
    """Borderline pages: doubtful accepted ones and list pages that look singular."""
    p, t = F.lower(path("source_url")), F.col("name")
    singular = has(t, v.KEYWORD) & ~has(t, v.PLURAL)
    category = has(p, v.CATEGORY_PATH) | has(p, OFFER_ROOTS)
    generic = has(t, v.LIST_TITLE)
    generic_accepted = generic | has(t, "^empowering courageous leaders$")
    weak = (F.col("award_amount") == 0) & (F.col("deadline") == "") & (F.size("statements") < 2)
    n = F.col("n_links")
    accepted = F.col("skip_reason").isNull() & (
        (p == "/") | category | generic_accepted | (has(t, v.PLURAL) & ~singular) | (n >= 2) | weak
    )
    listed_page = (
        (F.col("skip_reason") == "scholarship_list_page")
        & ~(p.rlike("^/?$") | category | generic)
        & (singular | detail_path(p) | n.between(1, 3))
    )
    return candidates.withColumn(
        "review_kind", F.when(accepted, "accepted").when(flag(listed_page), "rejected_list")
    ).filter(F.col("review_kind").isNotNull())
