"""Triage of bundles, hub expansion and lead extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vocab as v
from ..functions.ranks import top_n
from ..functions.text import clean, flag, has, nonblank, norm, num
from ..functions.urls import base_domain, path

VARIANTS = ["control", "trusted_agg_conservative", "trusted_agg_moderate", "trusted_agg_strict_domain"]

# Triage cues.
TRIAGE_NAV = (
    r"\b(donate|donation|mentor|mentorship|internship|research program|return to application"
    r"|login|sign in)\b"
)
TRIAGE_SOURCE = r"\b(apply|application|official|source|provider|sponsor|website)\b"
STAGE_CUE = (
    r"\b(high school senior|high school student|incoming|freshman|first year of college"
    r"|college freshman|grade level)\b"
)
VERIFIED_CUE = (
    r"\b(verified by the scholarship providing organization|reviewed by"
    r"|scholarship review process|reviewed scholarship)\b"
)
ROUNDUP_TITLE = r"\b(top|best|\d+)\b"
MULTI_PROGRAM = (
    r"\b(comprises \w+ individual scholarship|individual scholarship programs"
    r"|multiple scholarship programs|scholarship program comprises)\b"
)
AID_CUE = (
    r"\b(pell grant|fafsa|financial aid|federal student aid|student aid|grant eligibility"
    r"|grant maximum|grant minimum)\b"
)
AID_EXPLAINER = (
    r"\b(everything you need to know|how to|what is|eligibility|aid amounts?|award amounts?"
    r"|deadline|federal)\b"
)

# Why a child link is picked or not, in rule order.
CHILD_REASONS = {
    "nav": "Looks navigational or unrelated to scholarship detail.",
    "seen": "Already seen recently, so it is not a good use of fetch budget.",
    "apply_only": "Looks more like a generic application path than a scholarship detail page.",
    "mirror": "Same-domain aggregator detail page is weaker than fetching an original-source link first.",
    "offer": "Anchor text or URL suggests this is a scholarship-oriented child page.",
    "source": "Looks like an offsite original-source path for an aggregator summary page.",
    "detail": "Looks like a likely scholarship-detail child worth fetching next.",
    "other": "Child link is weaker than the selected expansion paths.",
}

# Why a lead is turned down, in rule order.
LEAD_REASONS = {
    "no_url": "Missing child URL.",
    "nav": "Navigational, portal, donation, or unrelated program link.",
    "advice": "Generic advice, search, provider, or directory page rather than a named scholarship lead.",
    "tracking": "Referral, affiliate, provider, or tracking link rather than a stable scholarship lead.",
    "later": "Child link appears targeted to later college or graduate students rather than incoming college freshmen.",
    "seen": "Already seen recently.",
    "apply_only": "Application-only link without scholarship identity.",
    "other": "Child does not look like a named scholarship lead.",
}

# Triage outcomes, in rule order.
ADVANCE, HOLD, DROP = "advance_to_finalize", "hold_for_expansion", "drop"
RATIONALES = {
    "access": "Page could not be meaningfully accessed, so it is not worth more attention in this run.",
    "closed": "Page appears closed or expired, so it should not continue in this run.",
    "past": "Page appears tied to a past scholarship cycle and is not worth more attention in this run.",
    "stage_direct": "Direct scholarship page shows an explicit stage mismatch, so it should not continue in this run.",
    "stage": "Page shows an explicit student-stage mismatch, so it should not continue in this run.",
    "explainer": "Page is a financial-aid explainer rather than a scholarship candidate page, so it should not continue in this run.",
    "strong": "Fetched page looks like a direct scholarship page with enough concrete evidence to send to finalization now.",
    "trusted": "Fetched page looks like a trusted aggregator detail page with enough concrete scholarship evidence to send to finalization now.",
    "mirror_hold": "Fetched page looks like an aggregator summary, so it should expand to the original source before finalization.",
    "mirror_drop": "Fetched page looks like an aggregator summary but does not expose a useful original-source expansion path.",
    "school_narrow": "Page is too school-specific and does not expose a strong enough expansion path for this run.",
    "gateway": "Fetched page looks more like a gateway than a final scholarship and has useful child links worth exploring.",
    "indirect": "Page looks indirect and does not provide a strong enough path to continue.",
    "school": "Page is school-specific and does not look strong enough to continue without a better expansion path.",
    "default": "Fetched page does not show enough direct evidence or expansion value to continue in this run.",
}


def promising_links(links: DataFrame, bundles: DataFrame, key: list[str]) -> DataFrame:
    """Child links per page that may lead to an offer."""
    # One row per page, also when the bundles are repeated for several variants.
    signals = bundles.groupBy(*key).agg(F.max("signals.aggregator").alias("__agg"))
    a = clean("anchor_text")
    good = (a != "") & ~has(a, TRIAGE_NAV) & (
        flag(F.col("detail_path_likely"))
        | (flag(F.col("__agg")) & ~flag(F.col("same_domain")) & has(a, TRIAGE_SOURCE))
        | has(a, v.KEYWORD)
    )
    return links.join(signals, key).groupBy(*key).agg(F.count_if(good).alias("n_promising"))


def triage_pages(
    bundles: DataFrame, links: DataFrame, key: list[str], pages_left: Column | int = 1,
    depth_left: Column | int = 1, variant: Column | str = "trusted_agg_conservative",
) -> DataFrame:
    """advance / hold / drop with a rationale, by ordered rules.

    ``variant`` may be a column, so several variants run in one pass.
    """
    lit = lambda x: F.lit(x) if not isinstance(x, Column) else x
    variant, pages_left, depth_left = lit(variant), lit(pages_left), lit(depth_left)
    df = bundles.join(promising_links(links, bundles, key), key, "left").withColumn(
        "n_promising", F.coalesce("n_promising", F.lit(0))
    )
    s = {k: flag(F.col(f"signals.{k}")) for k in (
        "direct", "hub", "list", "deadline", "amount", "eligibility", "application", "indirect",
        "aggregator", "original_source")}
    b = {k: flag(F.col(f"blockers.{k}")) for k in ("closed", "past_cycle", "stage_mismatch", "access_blocked")}
    school = flag(F.col("fit.school"))
    title = clean("title")
    evidence = clean(
        F.concat_ws(
            " ", "title", "canonical_url", "evidence.deadline", "evidence.eligibility",
            "evidence.amount", "evidence.stage",
        )
    )
    df = df.withColumns(
        {
            "__text": evidence,
            "n_positive": sum((s[k].cast("int") for k in ("deadline", "amount", "eligibility", "application")), F.lit(0)),
        }
    )
    text, pos, n = F.col("__text"), F.col("n_positive"), F.col("n_promising")
    explainer = (
        has(text, AID_CUE) & has(text, AID_EXPLAINER) & ~s["direct"] & ~has(text, r"\bscholarship\b")
    )
    mirror = s["aggregator"] | (s["original_source"] & ~s["direct"])
    snippets = F.concat_ws("", "evidence.eligibility", "evidence.amount", "evidence.deadline")
    strong = ~mirror & s["direct"] & ((pos >= 2) | ((pos >= 1) & (clean(snippets) != "")))
    stage_cue, verified = has(text, STAGE_CUE), has(text, VERIFIED_CUE)
    trusted_domain = base_domain("source_domain").isin(v.TRUSTED_AGGREGATORS)
    enough = (
        F.when(variant == "trusted_agg_conservative", (pos >= 4) & stage_cue & verified)
        .when(
            variant == "trusted_agg_moderate",
            ((pos >= 4) & stage_cue) | ((pos >= 3) & stage_cue & verified),
        )
        .when(
            variant == "trusted_agg_strict_domain",
            trusted_domain & (pos >= 4) & stage_cue & verified,
        )
        .otherwise(False)
    )
    trusted = (
        mirror & ~b["stage_mismatch"] & ~explainer & ~s["hub"] & s["list"]
        & has(title, v.KEYWORD) & ~has(title, v.PLURAL) & ~has(title, ROUNDUP_TITLE)
        & ~has(text, MULTI_PROGRAM) & enough
    )
    expandable = (pages_left > 0) & (depth_left > 0) & (n > 0) & (s["hub"] | s["list"] | (n >= 2))
    rules = [
        ("access", b["access_blocked"], DROP),
        ("closed", b["closed"], DROP),
        ("past", b["past_cycle"], DROP),
        ("stage_direct", b["stage_mismatch"] & s["direct"], DROP),
        ("stage", b["stage_mismatch"], DROP),
        ("explainer", explainer, DROP),
        ("strong", strong, ADVANCE),
        ("trusted", trusted, ADVANCE),
        ("mirror_hold", mirror & expandable, HOLD),
        ("mirror_drop", mirror, DROP),
        ("school_narrow", expandable & school & ~s["hub"] & (n < 2), DROP),
        ("gateway", expandable, HOLD),
        ("indirect", s["indirect"] & (n <= 0), DROP),
        ("school", school & ~s["direct"], DROP),
    ]
    rule = F.when(F.lit(False), F.lit(""))
    for name, cond, _ in rules:
        rule = rule.when(cond, F.lit(name))
    df = df.withColumn("rule", rule.otherwise("default"))
    actions = F.create_map(*[F.lit(x) for name, _, a in [*rules, ("default", None, DROP)] for x in (name, a)])
    reasons = F.create_map(*[F.lit(x) for kv in RATIONALES.items() for x in kv])
    return df.withColumns(
        {"action": actions[F.col("rule")], "rationale": reasons[F.col("rule")], "variant": variant}
    ).drop("__text")


def triage_queues(decisions: DataFrame) -> DataFrame:
    """Decision counts per run and variant."""
    return decisions.groupBy("run_id", "variant").agg(
        *[F.count_if(F.col("action") == a).alias(n) for a, n in (
            (ADVANCE, "n_advance"), (HOLD, "n_hold"), (DROP, "n_drop"))]
    )


# ---- hub expansion ---------------------------------------------------------------------------

# Child-link words.
CHILD_NAV = (
    r"\b(donate|donation|mentor|mentorship|internship|research program|program administration"
    r"|about|contact|privacy|policy|terms|login|log in|sign in|sign-in|portal"
    r"|return to application|apply now|make a gift|give now)\b"
)
CHILD_OFFER = r"\b(scholarship|award|grant|fellowship|scholarships)\b"
CHILD_SOURCE = (
    r"\b(apply|application|official|source|provider|sponsor|website|scholarship|scholarships"
    r"|award|grant|fellowship)\b"
)


def select_children(
    links: DataFrame, bundles: DataFrame, key: list[str], pages_left: Column | int = 6,
    depth_left: Column | int = 1, most: int = 4, rejects: int = 5,
) -> DataFrame:
    """Children worth fetching next per hub, and the best few turned down.

    ``key`` names the hub (page and run).  Rows carry ``selected``; a hub that is
    blocked, closed, past or without budget yields none.
    """
    lit = lambda x: F.lit(x) if not isinstance(x, Column) else x
    cap = F.least(F.lit(most), lit(pages_left))
    ready = bundles.filter(
        ~flag(F.col("blockers.access_blocked")) & ~flag(F.col("blockers.closed"))
        & ~flag(F.col("blockers.past_cycle")) & (lit(pages_left) > 0) & (lit(depth_left) > 0)
    ).select(
        *key,
        flag(F.col("signals.aggregator") & F.col("signals.original_source")).alias("__mirror"),
        cap.alias("__cap"),
    )
    df = links.filter(clean("url") != "").join(ready, key)
    a = clean("anchor_text")
    text = F.lower(F.concat_ws(" ", a, F.col("url")))
    same, detail = flag(F.col("same_domain")), flag(F.col("detail_path_likely"))
    mirror = F.col("__mirror")
    source = mirror & ~same & has(text, CHILD_SOURCE)
    offer = detail | has(text, CHILD_OFFER)
    nav = has(text, CHILD_NAV) & ~source
    seen = flag(F.col("seen_recently"))
    apply_only = has(a, r"\b(apply|application)\b") & ~offer & ~source
    # Child points.
    points = (
        num(a == "", -1.0) + num(source, 6.0) + num(detail, 3.0) + num(offer, 2.0)
        + F.when(same & mirror, -3.0).when(same, 1.0).otherwise(0.0)
        + num(has("source_domain", r"\.edu$"), 0.5) + num(apply_only, -2.0)
    )
    reason = (
        F.when(nav, CHILD_REASONS["nav"])
        .when(seen, CHILD_REASONS["seen"])
        .when(apply_only, CHILD_REASONS["apply_only"])
        .when(same & mirror & detail, CHILD_REASONS["mirror"])
        .when(offer & ~detail, CHILD_REASONS["offer"])
        .when(source, CHILD_REASONS["source"])
        .when(detail, CHILD_REASONS["detail"])
        .otherwise(CHILD_REASONS["other"])
    )
    df = df.withColumns(
        {"child_score": F.when(nav, -6.0).when(seen, -4.0).otherwise(points), "reason": reason,
         "is_source": source & ~nav & ~seen}
    )
    good = F.col("child_score") >= 2
    has_source = F.max(flag(F.col("is_source") & good)).over(W.partitionBy(*key))
    df = df.withColumn("viable", good & (~has_source | F.col("is_source")))
    order = [F.col("child_score").desc(), F.col("position").asc()]
    chosen = top_n(df.filter("viable"), key, order, most, "pick").filter(F.col("pick") <= F.col("__cap"))
    chosen = chosen.withColumn("selected", F.lit(True))
    rest = df.join(chosen.select(*key, "url"), [*key, "url"], "left_anti")
    rest = top_n(rest, key, order, rejects, "pick").withColumn("selected", F.lit(False))
    return chosen.unionByName(rest).drop("__mirror", "__cap", "viable")


# ---- leads -----------------------------------------------------------------------------------

# Reasons a link is no lead.
LEAD_ADVICE = (
    r"\b(essay|essays|application process|how to apply|find a scholarship|find scholarships"
    r"|scholarship search|search tool|finder|directory|category|tag|submission form"
    r"|submit a scholarship|scholarship applications?|types of scholarships"
    r"|scholarship rules?|rules|guidelines?|what is|guide|resources?|blog|article"
    r"|national scholarship month|success stories|winner|winners|book a demo"
    r"|verify your scholarship|scholarship providers?|for scholarship providers)\b"
)
LEAD_NAV = (
    r"\b(donate|donation|mentor|mentorship|internship|research program|program administration"
    r"|about|contact|privacy|policy|terms|login|log in|sign in|sign-in|portal"
    r"|return to application|make a gift|give now|cart|volunteer|get involved|committee)\b"
)
LEAD_TRACKING = (
    r"\b(referral|refer\.|affiliate|adcampaign|adnetwork|utm_source|utm_medium|utm_campaign"
    r"|clickid|coupon|promo|giveaway)\b"
)
LEAD_LATER = (
    r"\b(graduate students?|graduate program|sophomores?|juniors?|seniors?|upperclassmen"
    r"|4[- ]?year baccalaureate)\b"
)
LEAD_STARTING = r"\b(starting_college|incoming|freshman|high school senior|12th)\b"
LEAD_GENERIC_ANCHOR = (
    r"\b(apply|apply online|apply today|learn more|read more|click here|website"
    r"|official website)\b"
)


def slug_title(url: Column) -> Column:
    """Title made of the last path segment of a URL."""
    last = F.try_element_at(F.filter(F.split(path(url), "/"), lambda s: s != ""), F.lit(-1))
    words = F.regexp_replace(
        F.regexp_replace(F.coalesce(last, F.lit("")), r"(?i)\.(html?|php|aspx?)$", ""), "[-_]+", " "
    )
    # Only the first letter of each word changes, the rest keeps its case.
    parts = F.transform(
        F.split(words, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))
    )
    return clean(F.array_join(parts, " "))


def extract_leads(
    links: DataFrame, bundles: DataFrame, key: list[str], student_stage: Column | str = "",
    per_page: int = 5, total: int | None = 15, rejects: int = 8,
) -> tuple[DataFrame, DataFrame]:
    """Leads of hub pages and the first links turned down.

    At most ``per_page`` leads per page and ``total`` per run in page order (no
    total with None).
    ``bundles`` needs ``run_id, ord``; pages after a page without a URL are not read.
    """
    stage = F.lit(student_stage) if not isinstance(student_stage, Column) else student_stage
    # Only the first page without a URL matters, so a grouped minimum finds it.
    stop = bundles.filter(clean("canonical_url") == "").groupBy("run_id").agg(F.min("ord").alias("__stop"))
    pages = bundles.join(stop, "run_id", "left").filter(
        F.col("__stop").isNull() | (F.col("ord") < F.col("__stop"))
    )
    pages = pages.filter(~flag(F.col("blockers.access_blocked"))).select(
        *key,
        *[c for c in ("run_id", "ord") if c not in key],
        F.col("canonical_url").alias("source_url"),
        F.col("title").alias("page_title"),
        F.col("source_domain").alias("page_domain"),
        "signals", "fit", "blockers",
    )
    df = links.join(pages, key)
    a = clean("anchor_text")
    text = F.lower(F.concat_ws(" ", a, F.col("url")))
    same, detail = flag(F.col("same_domain")), flag(F.col("detail_path_likely"))
    agg = flag(F.col("signals.aggregator"))
    dom, page_dom = base_domain("source_domain"), base_domain("page_domain")
    same_org = (dom != "") & (page_dom != "") & (dom == page_dom)
    advice, nav, tracking = has(text, LEAD_ADVICE), has(text, LEAD_NAV), has(text, LEAD_TRACKING)
    official = ~tracking & (
        (agg & (F.col("source_domain") != "") & ~same_org & ~advice)
        | (~same & ~same_org & has(a, r"\b(official|source|sponsor|apply|application|website)\b"))
    )
    offer = detail | has(text, v.KEYWORD)
    apply_only = has(a, r"\b(apply|apply online|apply today|application)\b") & ~has(text, v.KEYWORD)
    later = (
        has(clean(stage), LEAD_STARTING) & ~has(text, r"\bhigh school seniors?\b") & has(text, LEAD_LATER)
    )
    seen = flag(F.col("seen_recently"))
    edu = has("source_domain", r"\.edu$")
    # Lead points.
    points = (
        num(seen, -4.0) + num(official, 7.0)
        + F.when(offer & detail, 5.0).when(offer, 3.0).otherwise(0.0)
        + F.when(same & agg, -1.0).when(same, 1.0).otherwise(0.0)
        + num(edu, 0.25) + num(apply_only & ~official, -3.0)
    )
    hard = (
        F.when(clean("url") == "", LEAD_REASONS["no_url"])
        .when(nav, LEAD_REASONS["nav"])
        .when(advice, LEAD_REASONS["advice"])
        .when(tracking, LEAD_REASONS["tracking"])
        .when(later, LEAD_REASONS["later"])
    )
    df = df.withColumns(
        {"official": official, "hard": hard, "lead_score": F.when(hard.isNotNull(), -100.0).otherwise(points)}
    )
    soft = (
        F.when(seen, LEAD_REASONS["seen"])
        .when(apply_only & ~official, LEAD_REASONS["apply_only"])
        .otherwise(LEAD_REASONS["other"])
    )
    rejected = df.filter(F.col("lead_score") < 2).withColumn("reason", F.coalesce("hard", soft))
    rejected = top_n(rejected, key, [F.col("position").asc()], rejects, "pick").select(
        *key, "source_url", "url", "reason", "pick"
    )
    good = top_n(
        df.filter(F.col("lead_score") >= 2), key, [F.col("lead_score").desc(), F.col("position").asc()],
        per_page, "pick",
    )
    if total is not None:
        sizes = good.groupBy("run_id", "ord").agg(F.count("*").alias("n"))
        first = top_n(sizes, ["run_id"], [F.col("ord").asc()], total, "__rn").drop("__rn")
        before = W.partitionBy("run_id").orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
        room = first.select(
            "run_id", "ord", (F.lit(total) - F.coalesce(F.sum("n").over(before), F.lit(0))).alias("room")
        )
        good = good.join(room, ["run_id", "ord"]).filter(F.col("pick") <= F.col("room"))
    derived = agg | flag(F.col("signals.indirect"))
    leads = good.withColumns(
        {
            "lead_name": F.when((a != "") & ~has(a, LEAD_GENERIC_ANCHOR), a).otherwise(
                F.coalesce(nonblank(slug_title(F.col("url"))), clean("page_title"))
            ),
            "lead_type": F.when(F.col("official"), "official_source").otherwise("scholarship_detail"),
            "source_type": F.when(agg, "aggregator_hub")
            .when(flag(F.col("signals.hub") | F.col("signals.list")), "scholarship_hub")
            .when(flag(F.col("signals.direct")), "mixed_candidate_page").otherwise("lead_source"),
            "verification_priority": F.when(F.col("lead_score") >= 7, "high")
            .when(F.col("lead_score") >= 4, "medium").otherwise("low"),
            "needs_verification": derived & ~F.col("official"),
            "stage_likely": ~derived & flag(F.col("fit.stage")),
            "major_likely": ~derived & flag(F.col("fit.major")),
            "ethnicity_likely": ~derived & flag(F.col("fit.ethnicity")),
            "state_likely": ~derived & flag(F.col("fit.state")),
            "school_likely": flag(F.col("fit.school")) | (same & edu),
            "stale_likely": flag(F.col("blockers.past_cycle") | F.col("blockers.closed")),
            "portal_likely": apply_only & ~F.col("official"),
            "mixed_likely": flag(F.col("signals.direct") & (F.col("signals.hub") | F.col("signals.list"))),
        }
    ).select(
        *key, *[c for c in ("run_id", "ord") if c not in key], "source_url", "source_type",
        F.col("url").alias("lead_url"), "lead_name", "lead_type", "lead_score",
        "verification_priority", F.col("official").alias("is_official"), "needs_verification",
        "stage_likely", "major_likely", "ethnicity_likely", "state_likely", "school_likely",
        "stale_likely", "portal_likely", "mixed_likely", F.col("pick").alias("lead_rank"),
    )
    return leads, rejected
