"""Search hits: features, scores, dedupe, ranks, quotas and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vocab as v
from ..functions.lexicon import (
    rule_matches, stage_terms, state_code, tag_states, tag_values, term_hits,
)
from ..functions.ranks import HELD, full_rank, largest, top_n
from ..functions.text import clean, col, flag, has, norm, num
from ..functions.urls import canonical_url, domain, domain_hint, domain_suffixes, path

SURFACES = ["direct_likely", "hub_likely", "list_likely", "other"]
HINTS = {
    "direct_scholarship": "direct_likely",
    "scholarship_program_hub": "hub_likely",
    "scholarship_list_page": "list_likely",
}


def detail_path(p: Column) -> Column:
    """Path of a single offer."""
    return (
        (p != "/") & (p != "") & ~has(p, v.CATEGORY_PATH)
        & (
            has(p, v.DETAIL_PATHS[0])
            | (has(p, v.OFFER_PATH) & ~has(p, v.OFFER_ROOT_PATH))
            | has(p, v.DETAIL_PATHS[1])
        )
    )


def hub_path(p: Column) -> Column:
    """Path of a programme or department page that gathers offers."""
    hub = F.lit(False)
    for pattern in v.HUB_PATHS:
        hub = hub | has(p, pattern)
    return (p != "/") & (p != "") & ~has(p, v.CATEGORY_PATH) & hub


def years_are_stale(text: Column, year: Column, words: str) -> Column:
    """A past year, no current or future one, and a word of an application cycle."""
    years = F.transform(
        F.regexp_extract_all(text, F.lit(r"(?<!\w)(20\d{2})(?!\w)"), F.lit(1)), lambda y: y.cast("int")
    )
    return (
        F.exists(years, lambda y: y < year) & ~F.exists(years, lambda y: y >= year) & has(text, words)
    )


def indirect(text: Column, dom: Column, p: Column, cues: str) -> Column:
    joined = F.concat_ws(" ", clean(text), dom, p)
    return dom.startswith("blog.") | has(p, "/blog/") | has(joined, cues)


def hit_features(hits: DataFrame) -> DataFrame:
    """Cleaned text, canonical URL, domain and path of each hit."""
    out = hits.withColumns(
        {
            "title": clean("title"),
            "snippet": clean("snippet"),
            "normalized_url": canonical_url("url"),
            "source_domain": domain("url"),
            "path": F.lower(path("url")),
        }
    )
    return out.withColumns(
        {
            "combined": F.concat_ws(" ", "title", "snippet", "path"),
            # Scores keep the three parts on lines of their own.
            "lines": F.concat_ws("\n", "title", "snippet", "path"),
        }
    )


def _homepage() -> Column:
    c, t = F.col("combined"), F.col("title")
    action = has(c, v.HOME_ACTION)
    return F.col("path").rlike("^/?$") & (
        has(t, r"\bhome\b") | (has(t, v.HOME_TITLE) & ~action)
        | (has(F.col("source_domain"), v.HOME_DOMAINS) & ~action)
    )


def _center() -> Column:
    c, t, p = F.col("combined"), F.col("title"), F.col("path")
    return (
        has(c, v.CENTER)
        | (has(t, v.CENTER_TITLE) & has(t, r"\bscholarship"))
        | (has(c, r"\bfirst[- ]year students?\b") & has(c, r"\bscholarship") & ~detail_path(p))
    )


def surface_type(rules: str = "search", hint: Column | None = None) -> Column:
    """Kind of page a hit looks like; ``rules`` picks one of two rule orders."""
    c, t, p = F.col("combined"), F.col("title"), F.col("path")
    plural = has(t, v.PLURAL)
    keyword = has(c, v.KEYWORD) & ~plural
    no_action = ~has(c, r"\b(apply|eligibility|deadline)\b")
    hinted = norm(hint) if hint is not None else F.lit("")
    out = F.when(F.lit(False), F.lit(""))
    for k, s in HINTS.items():
        out = out.when(hinted == k, F.lit(s))
    if rules == "discovery":
        steps = [
            (detail_path(p), "direct_likely"),
            (has(c, v.LIST_CUES), "list_likely"),
            (has(p, v.CATEGORY_PATH), "list_likely"),
            (plural & no_action, "list_likely"),
            (keyword, "direct_likely"),
        ]
    else:
        steps = [
            (has(c, v.LIST_CUES), "list_likely"),
            (
                indirect(F.concat_ws(" ", "title", "snippet"), F.col("source_domain"), p, v.INDIRECT),
                "list_likely",
            ),
            (_homepage(), "other"),
            (_center(), "hub_likely"),
            (has(p, v.CATEGORY_PATH), "list_likely"),
            (plural & has(c, r"\b(top \d+|best|directory|roundup|opportunities)\b"), "list_likely"),
            (plural & no_action, "list_likely"),
            (hub_path(p) | has(c, v.HUB_CUES), "hub_likely"),
            (detail_path(p), "direct_likely"),
            (keyword, "direct_likely"),
        ]
    for cond, s in steps:
        out = out.when(cond, F.lit(s))
    return out.otherwise("other")


def surface_mix(hits: DataFrame, keys: list[str], rules: str = "search") -> DataFrame:
    """Hits per key, domain and surface."""
    labelled = hit_features(hits).withColumn("surface_type", surface_type(rules))
    return labelled.groupBy(*keys, "source_domain", "surface_type").agg(F.count("*").alias("n_hits"))


def with_heuristics(hits: DataFrame, as_of: str, rules: str = "search") -> DataFrame:
    """Hits with features joined to their profile, plus the signal columns.

    Needs ``intended_major, ethnicity, state, grade_level, student_stage``.
    """
    c, dom, p = F.col("lines"), F.col("source_domain"), F.col("path")
    year = F.year(F.lit(as_of).cast("timestamp"))
    edu = dom.endswith(".edu")
    out = hits.withColumns(
        {
            "surface_type": surface_type(
                rules, F.col("surface_hint") if "surface_hint" in hits.columns else None
            ),
            "majors": tag_values(c, v.MAJORS),
            "ethnicities": tag_values(c, v.ETHNICITIES),
            "states": tag_states(c),
            "n_stage_terms": term_hits(stage_terms("student_stage", "grade_level"), c),
            "state_code": state_code("state"),
            "stale_cycle": years_are_stale(F.col("combined"), year, v.STALE_WORDS),
            "indirect_content": indirect(F.concat_ws(" ", "title", "snippet"), dom, p, v.INDIRECT),
            "institution_specific": edu | has(c, v.INSTITUTION),
            "specific_school": edu & has(c, v.SPECIFIC_SCHOOL),
            "negative_graduate": has(c, v.GRADUATE),
            "negative_blog": dom.rlike(r"^blog\.|\.blog\.") | has(c, v.BLOG_SIGNAL),
            "homepage": _homepage(),
        }
    )
    return out.withColumns(
        {
            "major_match": rule_matches(F.col("majors"), "intended_major"),
            "ethnicity_match": rule_matches(F.col("ethnicities"), "ethnicity"),
            "state_match": (F.col("state_code") != "")
            & F.array_contains("states", F.col("state_code")),
            "stage_match": F.col("n_stage_terms") > 0,
            "negative_directory": (F.col("surface_type") == "list_likely")
            | has(c, v.DIRECTORY_SIGNAL),
        }
    )


def fit_score(variant: str = "control", allowed: Column | None = None) -> Column:
    """Hit fit under a named weight variant (or its rows given as a dict)."""
    w = {**v.HIT_WEIGHTS["control"], **v.HIT_WEIGHTS[variant]}
    pw = v.PROFILE_WEIGHTS
    c, t, s = F.col("lines"), F.col("title"), F.col("surface_type")
    major = norm("intended_major")
    exact = F.exists("majors", lambda m: norm(m) == major)
    broad = major.contains("engineering") & F.array_contains("majors", "engineering") & ~exact
    starting = norm("student_stage") == "starting_college"
    has_state = F.col("state_code") != ""
    action = has(c, v.ACTION)
    detail = detail_path(F.col("path"))
    score = (
        num(s == "direct_likely", w["direct"])
        + num(s == "hub_likely", w["hub"])
        + num(s == "list_likely", w["list"])
        + num(has(c, v.KEYWORD), w["keyword"])
        + num(action, w["action"])
        + num(has(c, v.GENERIC_BLOG) | F.col("source_domain").startswith("blog."), w["blog"])
        + num(F.col("indirect_content"), w["indirect"])
        + num(F.col("stale_cycle"), w["stale"])
        + num(F.col("institution_specific"), w["institution"])
        + num(F.col("specific_school"), w["school"])
        + num(F.col("homepage"), w["homepage"])
        + num(F.col("major_match"), pw["major"])
        + num(~F.col("major_match") & (F.size("majors") > 0), pw["other_major"])
        + num(F.col("ethnicity_match"), pw["ethnicity"])
        + num(~F.col("ethnicity_match") & (F.size("ethnicities") > 0), pw["other_ethnicity"])
        + num(F.col("state_match"), pw["state"])
        + num(has_state & ~F.col("state_match") & (F.size("states") > 0), pw["other_state"])
        + F.col("n_stage_terms") * pw["stage_term"]
        + num(starting & has(c, v.UPPERCLASS), pw["upperclass"])
        + num(starting & F.col("negative_graduate"), pw["graduate"])
    )
    if w["detail_path"]:
        score = score + num(detail, w["detail_path"])
    if w["program"]:
        score = score + num(has(c, r"\bscholarship program\b"), w["program"])
    if w["plural"]:
        score = score + num(has(t, v.PLURAL) & ~action & ~detail, w["plural"])
    if w["exact_major"]:
        score = score + num(exact, w["exact_major"])
    if w["broad_engineering"]:
        score = score + num(broad, w["broad_engineering"])
    if allowed is not None:
        score = score + num(allowed, pw["allowed_domain"])
    return F.round(score, 3)


def discovery_fit_score(domain_score: Column) -> Column:
    """Hit fit of the discovery flow: other surface weights plus domain feedback."""
    c, s = F.col("lines"), F.col("surface_type")
    pw = v.PROFILE_WEIGHTS
    starting = norm("student_stage") == "starting_college"
    has_state = F.col("state_code") != ""
    return F.round(
        # Surface weights of the discovery flow.
        num(s == "direct_likely", 5.0) + num(s == "hub_likely", 3.5) + num(s == "list_likely", -2.5)
        + num(has(c, v.KEYWORD), 1.5) + num(has(c, v.ACTION), 1.5) + num(has(c, v.GENERIC_BLOG), -2.0)
        + num(F.col("major_match"), pw["major"])
        + num(~F.col("major_match") & (F.size("majors") > 0), pw["other_major"])
        + num(F.col("ethnicity_match"), pw["ethnicity"])
        + num(~F.col("ethnicity_match") & (F.size("ethnicities") > 0), pw["other_ethnicity"])
        + num(F.col("state_match"), pw["state"])
        + num(has_state & ~F.col("state_match") & (F.size("states") > 0), pw["other_state"])
        + F.col("n_stage_terms") * pw["stage_term"]
        + num(starting & has(c, v.UPPERCLASS), pw["upperclass"])
        + num(starting & F.col("negative_graduate"), pw["graduate"])
        + F.coalesce(domain_score, F.lit(0.0)),
        3,
    )


def novelty_score(as_of: str) -> Column:
    """Novelty from the joined ``last_fetched_at, page_type, recent_count``."""
    age_h = F.greatest(
        F.lit(0.0),
        (F.lit(as_of).cast("timestamp").cast("double") - F.col("last_fetched_at").cast("double")) / 3600,
    )
    seen = F.coalesce("recent_count", F.lit(0))
    # Novelty points.
    return F.round(
        F.when(F.col("last_fetched_at").isNull(), F.lit(12.0)).otherwise(
            F.least(F.lit(8.0), age_h / 24)
            + num(F.col("page_type") == "direct_scholarship", -3.0)
            + num(F.col("page_type") == "scholarship_list_page", -1.5)
        )
        - F.least(F.lit(4.0), seen * 0.5)
        + num(detail_path(F.col("path")), 1.0)
        + num(has(F.concat_ws(" ", "title", "path"), v.KEYWORD), 0.5),
        3,
    )


def score_hits(
    hits: DataFrame, profiles: DataFrame, history: DataFrame, domain_counts: DataFrame,
    as_of: str, variant: str = "control",
) -> DataFrame:
    """Fit and novelty of every hit for its run's profile.

    ``domain_counts(source_domain, recent_count)``; ``history`` is keyed by
    ``normalized_url``.
    """
    known = history.select("normalized_url", "last_fetched_at", "page_type")
    feats = with_heuristics(hit_features(hits).join(profiles, "profile_id", "left"), as_of)
    return (
        feats.join(known, "normalized_url", "left")
        .join(domain_counts, "source_domain", "left")
        .withColumns({"fit_score": fit_score(variant), "novelty_score": novelty_score(as_of)})
    )


def domain_hints(hits: DataFrame, allow: DataFrame, deny: DataFrame) -> DataFrame:
    """Drop hits of denied domains and mark those of allowed ones.

    Hints match a domain or any parent of it.  The match runs on distinct domains,
    exploded to their label suffixes, so it is an equality join.
    """
    hints = (
        allow.select(domain_hint("hint").alias("suffix"), F.lit("allow").alias("kind"))
        .union(deny.select(domain_hint("hint").alias("suffix"), F.lit("deny").alias("kind")))
        .filter("suffix <> ''")
        .distinct()
    )
    verdicts = (
        hits.select("source_domain").distinct()
        .select("source_domain", F.explode(domain_suffixes("source_domain")).alias("suffix"))
        .join(hints, "suffix")
        .groupBy("source_domain")
        .agg(
            F.max((F.col("kind") == "allow").cast("int")).alias("__allow"),
            F.max((F.col("kind") == "deny").cast("int")).alias("__deny"),
        )
    )
    return (
        hits.filter(F.col("source_domain") != "")
        .join(verdicts, "source_domain", "left")
        .filter(F.coalesce("__deny", F.lit(0)) == 0)
        .withColumn("allowed_domain", F.coalesce("__allow", F.lit(0)) == 1)
        .drop("__allow", "__deny")
    )


def dedupe_hits(hits: DataFrame) -> DataFrame:
    """Best hit per run and canonical URL, at the URL's first position.

    A grouped ``max_by`` combines on the map side, so a URL repeated in a third of
    all rows still sends one row per task.
    """
    rest = [c for c in hits.columns if c not in ("run_id", "normalized_url")]
    key = F.struct(
        F.coalesce("fit_score", F.lit(0.0)), F.coalesce("novelty_score", F.lit(0.0)), -F.col("ord")
    )
    return (
        hits.filter(F.col("normalized_url") != "")
        .groupBy("run_id", "normalized_url")
        .agg(F.max_by(F.struct(*rest), key).alias("best"), F.min("ord").alias("first_ord"))
        .select("run_id", "normalized_url", "best.*", "first_ord")
    )


def surface_rank(c: Column | str = "surface_type") -> Column:
    c = col(c)
    return (
        F.when(c == "direct_likely", 0).when(c == "hub_likely", 1).when(c == "list_likely", 2)
        .otherwise(3)
    )


def rank_hits(hits: DataFrame, order: str = "search", tie: str = "ord") -> DataFrame:
    """Position of every hit in its run.

    ``search`` order: fit, novelty, provider rank.  ``discovery`` order: fit,
    surface, pass priority, novelty, global rank.
    """
    # A missing score counts as zero.
    fit, nov = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("fit_score", "novelty_score"))
    if order == "discovery":
        by = [fit.desc(), surface_rank().asc(), F.col("pass_priority").asc(), nov.desc(),
              F.col("global_rank").asc(), F.col(tie).asc()]
    else:
        by = [fit.desc(), nov.desc(), F.col("provider_rank").asc(), F.col(tie).asc()]
    return full_rank(hits, ["run_id"], by, "rank")


def same_domain_flag(ranked: DataFrame) -> DataFrame:
    """True where the domain already appeared earlier in the run's order.

    Rows are compared where their run's domain is; beyond ``HELD`` rows of one domain of a run, with a table of its first ranks.
    """
    hosts = ["run_id", "source_domain"]
    if largest(ranked, hosts) <= HELD:
        return ranked.withColumn("same_domain_as_prior", F.col("rank") > F.min("rank").over(W.partitionBy(*hosts)))
    first = ranked.groupBy(F.col("run_id").alias("__run"), F.col("source_domain").alias("__domain")).agg(
        F.min("rank").alias("__first")
    )
    same = F.col("run_id").eqNullSafe(F.col("__run")) & F.col("source_domain").eqNullSafe(F.col("__domain"))
    return ranked.join(first, same).withColumn(
        "same_domain_as_prior", F.col("rank") > F.col("__first")
    ).drop("__first", "__run", "__domain")


def initial_frontier(ranked: DataFrame, quotas: dict[str, int] | None = None) -> DataFrame:
    """Quota per surface by rank, then backfill in rank order up to the total.

    A row of the frontier is among the first ``total`` of its surface, so one cut
    with that literal bound keeps at most total x surfaces rows per run before the
    shuffle; quotas and backfill are then decided among those few rows.
    """
    quotas = quotas or v.FRONTIER_QUOTAS
    total = sum(quotas.values())
    surface = F.coalesce("surface_type", F.lit("other"))
    quota = F.lit(0)
    for s, q in quotas.items():
        quota = F.when(F.col("__s") == s, q).otherwise(quota)
    pool = top_n(ranked.withColumn("__s", surface), ["run_id", "__s"], [F.col("rank")], total, "__rn")
    run = W.partitionBy("run_id")
    pool = pool.withColumn("backfill", F.col("__rn") > quota).withColumns(
        {
            "__picked": F.sum((~F.col("backfill")).cast("int")).over(run),
            "__order": F.row_number().over(W.partitionBy("run_id", "backfill").orderBy("rank")),
        }
    )
    kept = pool.filter(~F.col("backfill") | (F.col("__order") <= total - F.col("__picked")))
    return kept.withColumn(
        "frontier_position",
        F.row_number().over(W.partitionBy("run_id").orderBy("backfill", "rank")),
    ).drop("__s", "__rn", "__picked", "__order")


def frontier_counts(frontier: DataFrame) -> DataFrame:
    """Selected hits per surface and run."""
    s = F.coalesce("surface_type", F.lit("other"))
    return frontier.groupBy("run_id").agg(*[F.count_if(s == x).alias(f"n_{x}") for x in SURFACES])


def union_passes(passes: list[tuple[DataFrame, str, int]]) -> DataFrame:
    """Hits of all search passes with pass name, priority and arrival rank."""
    out = None
    for i, (df, name, priority) in enumerate(passes):
        df = df.withColumns(
            {"pass": F.lit(name), "pass_priority": F.lit(priority), "__pass": F.lit(i)}
        )
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return full_rank(out, ["run_id"], [F.col("__pass"), F.col("ord")], "global_rank").drop("__pass")


def merge_expansion(base: DataFrame, extra: DataFrame) -> DataFrame:
    """Append only URLs new to the run, ranked after the existing hits."""
    known = base.select(F.col("run_id").alias("__run"), F.col("normalized_url").alias("__url"))
    fresh = extra.filter(F.col("normalized_url") != "").join(
        known, F.col("run_id").eqNullSafe(F.col("__run")) & (F.col("normalized_url") == F.col("__url")), "left_anti"
    )
    fresh = top_n(fresh, ["run_id", "normalized_url"], [F.col("ord")], 1, "__rn").drop("__rn")
    sizes = base.groupBy("run_id").agg(F.count("*").alias("__n"))
    fresh = full_rank(fresh, ["run_id"], [F.col("ord")], "__rn")
    sizes = sizes.withColumnRenamed("run_id", "__run")
    fresh = fresh.join(sizes, F.col("run_id").eqNullSafe(F.col("__run")), "left").withColumn(
        "global_rank", (F.coalesce("__n", F.lit(0)) + F.col("__rn")).cast("int")
    ).drop("__rn", "__n", "__run")
    return base.unionByName(fresh, allowMissingColumns=True)


def distinct_ci(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """Distinct values ignoring case and blanks; the earliest spelling stays."""
    key = norm(column)
    return (
        df.filter(key != "")
        .groupBy(key.alias("value_key"))
        .agg(
            F.min_by(clean(column), F.struct(*order)).alias("value"),
            F.count("*").alias("n_rows"),
        )
    )


def search_quality(ranked: DataFrame, top: int = 10) -> DataFrame:
    """Totals per surface, signal counts, domains and the share of direct hits on top."""
    s = F.col("surface_type")
    stats = ranked.groupBy("run_id").agg(
        F.count("*").alias("n_hits"),
        *[F.count_if(s == x).alias(f"n_{x}") for x in SURFACES],
        F.count_if(F.col("specific_school")).alias("n_school"),
        F.count_if(F.col("institution_specific")).alias("n_institution"),
        F.count_if(F.col("stale_cycle")).alias("n_stale"),
        F.count_if(F.col("indirect_content")).alias("n_indirect"),
        F.count_distinct("source_domain").alias("n_domains"),
    )
    head = ranked.filter(F.col("rank") <= top).groupBy("run_id").agg(
        F.round(F.avg((s == "direct_likely").cast("int")), 3).alias("direct_share_top"),
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list(F.struct("rank", "normalized_url"))),
                lambda x: x["normalized_url"],
            ),
            " ",
        ).alias("top_urls"),
    )
    return stats.join(head, "run_id", "left")


def frontier_weakness(ranked: DataFrame, top: int = 15) -> DataFrame:
    """Is the head of the ranked hits too weak to stop searching?"""
    s, fit = F.col("surface_type"), F.coalesce("fit_score", F.lit(0.0))
    counts = ranked.filter(F.col("rank") <= top).groupBy("run_id").agg(
        F.count_if((s == "direct_likely") & (fit >= 7)).alias("strong_direct"),
        F.count_if((s == "hub_likely") & (fit >= 6)).alias("strong_programs"),
        F.count_if(fit >= 6).alias("high_fit"),
        F.count_if(s.isin("direct_likely", "hub_likely")).alias("direct_like"),
    )
    return counts.withColumn(
        "weak",
        (F.col("strong_direct") + F.col("strong_programs") < 3)
        | (F.col("high_fit") < 6)
        | (F.col("direct_like") < 4),
    )


def weakness_after_history(gated: DataFrame) -> DataFrame:
    """The same question after the history gate (``decision`` fetch/bypass/skip)."""
    fetch = F.col("decision") != "skip"
    s = F.col("surface_type")
    c = gated.groupBy("run_id").agg(
        F.count("*").alias("n_frontier"),
        F.count_if(fetch).alias("n_fetchable"),
        F.count_if(~fetch).alias("n_skipped"),
        F.count_if(fetch & s.isin("direct_likely", "hub_likely")).alias("n_direct_like"),
        F.count_if(fetch & (s == "list_likely")).alias("n_list_like"),
    )
    n, d = F.col("n_fetchable"), F.col("n_direct_like")
    return c.withColumn(
        "weak",
        (n == 0) | (d < 3) | (n < 5) | (F.col("n_skipped") > n)
        | ((F.col("n_list_like") >= n) & (d == 0)),
    )
