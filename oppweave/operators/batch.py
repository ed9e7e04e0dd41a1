"""Fetch batches: batch score, slot picks, diversity top-k and replays."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vocab as v
from ..functions.ranks import HELD, first_per, largest, top_n
from ..functions.text import clean, flag, has, let, num
from ..functions.urls import base_domain
from ..session import cut

# Cues of the batch score.
ROUNDUP = r"\b(top|best|\d{2,}|list of|scholarships for|scholarship directory|scholarships by|roundup)\b"
NOT_NAMED = r"\b(top|best|\d{2,}|directory|blog)\b"
PROOF = r"\b(application deadline|winner announcement|verified by|reviewed by|offered by)\b"
PROGRAM = r"\b(scholarship program|scholarship)\b"
STARTING = r"\bhigh school senior|incoming freshman|freshman\b"
RISKS = [
    (r"\b(third|fourth)[- ]year\b|\bjunior|senior year\b", True, 5),
    (r"\b(application is closed|applications are closed|application closed|deadline has passed|no longer accepting)\b", False, 6),
    (r"\bgraduate fellowship|graduate fellowships|master'?s|phd\b", True, 4),
    (r"\b0 results\b|\bscholarship finder\b|\buse our scholarship finder\b", False, 3),
]

# Fixed value: what each earlier pick of a domain costs.
SAME_DOMAIN = 1.25

# Batch score weights per replay variant ("rule" is the normal batch).
BATCH_WEIGHTS = {
    "rule": {
        "stage": 0.75, "no_stage": 0.0, "named": 1.25, "trusted": 1.25, "program": 0.8,
        "roundup": -1.75, "risk": -0.35, "graduate": -4.0, "blog": -2.0, "directory": -1.4,
        "school": -0.75, "indirect": -2.5,
    },
    "conversion_mix": {
        "stage": 0.75, "no_stage": 0.0, "named": 0.0, "trusted": 0.0, "program": 0.0,
        "roundup": 0.0, "risk": -0.35, "graduate": -4.0, "blog": -2.0, "directory": -1.4,
        "school": -0.75, "indirect": -2.5,
    },
    "stage_detail_first": {
        "stage": 3.5, "no_stage": -6.0, "named": 4.0, "trusted": 4.5, "program": 2.0,
        "roundup": -3.5, "risk": -0.35, "graduate": -5.0, "blog": -2.0, "directory": -2.5,
        "school": -1.5, "indirect": -2.5,
    },
    "precision_guard": {
        "stage": 2.5, "no_stage": -11.0, "named": 3.0, "trusted": 3.5, "program": 1.5,
        "roundup": -5.0, "risk": -1.1, "graduate": -4.0, "blog": -4.0, "directory": -4.0,
        "school": -1.5, "indirect": -4.5,
    },
}
FLAGS = [
    "major_match", "ethnicity_match", "state_match", "stage_match", "negative_graduate",
    "negative_blog", "negative_directory", "institution_specific", "specific_school",
    "stale_cycle", "indirect_content", "seen_recently", "same_domain_as_prior",
]


def with_traits(hits: DataFrame) -> DataFrame:
    """Named detail, trusted detail, program, roundup and snippet-risk traits."""
    title = F.lower(clean("title"))
    out = hits.withColumns(
        {
            "__title": title,
            "__text": F.lower(clean(F.concat_ws(" ", "title", "snippet", "url"))),
            "__said": F.lower(clean(F.concat_ws(" ", "title", "snippet"))),
            **{f: flag(F.col(f)) if f in hits.columns else F.lit(False) for f in FLAGS},
        }
    )
    t, text, said = F.col("__title"), F.col("__text"), F.col("__said")
    direct = F.col("surface_type") == "direct_likely"
    named = (
        has(t, v.KEYWORD) & ~has(t, v.PLURAL) & ~has(t, NOT_NAMED) & (direct | has(text, PROOF))
    )
    risk = sum(
        (
            num(has(said, p) & (~has(said, STARTING) if guarded else F.lit(True)), pts)
            for p, guarded, pts in RISKS
        ),
        F.lit(0.0),
    )
    out = out.withColumns(
        {
            "trusted_domain": base_domain("source_domain").isin(v.TRUSTED_AGGREGATORS),
            "named_detail": named,
            "broad_roundup": has(text, ROUNDUP) | has(t, v.PLURAL),
            "program_page": (has(t, PROGRAM) & ~has(t, v.PLURAL)) | (direct & ~F.col("negative_directory")),
            "snippet_risk": risk,
            "__proof": has(text, PROOF),
        }
    )
    return out.withColumn(
        "trusted_detail", F.col("trusted_domain") & F.col("named_detail") & F.col("__proof")
    ).drop("__title", "__text", "__said", "__proof")


def batch_score(variant: str = "rule") -> Column:
    w = BATCH_WEIGHTS[variant]
    s = F.col("surface_type")
    novelty = F.coalesce("novelty_score", F.lit(0.0)) * 0.08
    # Weights shared by all variants.
    return F.round(
        F.coalesce("fit_score", F.lit(0.0))
        + F.when(s == "direct_likely", 1.25).when(s == "hub_likely", 0.7).when(s == "list_likely", -0.2).otherwise(0.0)
        + F.greatest(F.lit(-0.75), F.least(F.lit(0.75), novelty))
        + num(F.col("major_match"), 0.5) + num(F.col("ethnicity_match"), 0.35) + num(F.col("state_match"), 0.25)
        + F.when(F.col("stage_match"), w["stage"]).otherwise(w["no_stage"])
        + num(F.col("named_detail"), w["named"]) + num(F.col("trusted_detail"), w["trusted"])
        + num(F.col("program_page"), w["program"]) + num(F.col("broad_roundup"), w["roundup"])
        + num(F.col("negative_graduate"), w["graduate"]) + num(F.col("negative_blog"), w["blog"])
        + num(F.col("negative_directory"), w["directory"]) + num(F.col("institution_specific"), -1.25)
        + num(F.col("specific_school"), w["school"]) + num(F.col("stale_cycle"), -5.0)
        + num(F.col("indirect_content"), w["indirect"]) + num(F.col("seen_recently"), -1.5)
        + num(F.col("same_domain_as_prior"), -0.5) + F.col("snippet_risk") * w["risk"],
        3,
    )


def slots() -> dict[str, Column]:
    """Slot name to membership, in the order the slots are filled."""
    stage, stale, ind = F.col("stage_match"), F.col("stale_cycle"), F.col("indirect_content")
    hubs = F.col("surface_type").isin("hub_likely", "list_likely")
    good, explore = F.col("score") >= 0, F.col("score") >= -6
    clean_ = ~stale & ~ind
    return {
        "detail_stage": stage & F.col("named_detail") & ~stale & good,
        "trusted_agg_detail": stage & F.col("trusted_detail") & ~stale & good,
        "program_stage": stage & F.col("program_page") & ~F.col("broad_roundup") & ~stale & good,
        "trusted_agg_hub_stage": stage & F.col("trusted_domain") & hubs & clean_ & explore,
        "ethnicity_stage": stage & F.col("ethnicity_match") & clean_ & good,
        "hub_stage": stage & hubs & ~F.col("specific_school") & clean_ & good,
        "explore": stage & clean_ & good,
        "fill": stage & good,
    }


ORDER = ["score", "provider_rank", "ord"]


def _order() -> list[Column]:
    return [F.col("score").desc(), F.col("provider_rank").asc(), F.col("ord").asc()]


def unfetched(hits: DataFrame, fetched: DataFrame | None) -> DataFrame:
    """First row per URL that was not fetched before."""
    one = first_per(hits.filter(F.col("normalized_url") != ""), ["run_id", "normalized_url"], [F.col("ord")])
    if fetched is None:
        return one
    return one.join(fetched.select("run_id", "normalized_url"), ["run_id", "normalized_url"], "left_anti")


def select_batch(hits: DataFrame, limit: int = 6, fetched: DataFrame | None = None) -> DataFrame:
    """Slot picks, then a fill, each pick making its domain dearer by 1.25.

    A pick can only come from the ``limit`` best domains of a slot and the
    ``limit`` best rows of each (fewer picks than that can have touched them), so
    both cuts are exact and bound what one run brings to the final fold.
    """
    # Scored where the hits are read, so that texts and flags are not shuffled.
    scored = with_traits(hits).withColumn("score", batch_score())
    member = slots()
    names = list(member)
    tagged = scored.select(
        "run_id", "normalized_url", F.lower(F.coalesce("source_domain", F.lit(""))).alias("dom"), *ORDER,
        F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in member.items()])).alias("slot_names"),
    )
    per = unfetched(tagged, fetched).select("run_id", "normalized_url", "dom", *ORDER, F.explode("slot_names").alias("slot"))
    rows = top_n(per, ["run_id", "slot", "dom"], _order(), limit, "in_dom")
    heads = top_n(rows.filter("in_dom = 1"), ["run_id", "slot"], _order(), limit, "__rn")
    kept = rows.join(heads.select("run_id", "slot", "dom"), ["run_id", "slot", "dom"], "left_semi")
    item = F.struct(
        (-F.col("score")).alias("neg"), "provider_rank", "ord", F.col("normalized_url").alias("url"), "dom", "slot"
    )
    lists = kept.groupBy("run_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    none = F.lit(None).cast("array<struct<url:string,dom:string,slot:string,adjusted:double>>")

    def step(picked: Column, slot: Column) -> Column:
        fits = F.filter(
            F.col("items"),
            lambda c: (c["slot"] == slot) & ~F.exists(picked, lambda p: p["url"] == c["url"]),
        )
        priced = F.transform(
            fits,
            lambda c, i: F.struct(
                (-c["neg"] - SAME_DOMAIN * F.size(F.filter(picked, lambda p: p["dom"] == c["dom"]))).alias("adjusted"),
                (-i).alias("i"),
                c["url"].alias("url"), c["dom"].alias("dom"), c["slot"].alias("slot"),
            ),
        )

        def add(best: Column) -> Column:
            pick = F.struct(
                best["url"].alias("url"), best["dom"].alias("dom"), best["slot"].alias("slot"), best["adjusted"].alias("adjusted")
            )
            return F.when(best.isNull(), picked).otherwise(F.concat(picked, F.array(pick)))

        return F.when(F.size(picked) >= limit, picked).otherwise(let(F.array_max(priced), add))

    steps = F.array(*[F.lit(n) for n in names[:-1]], *[F.lit("fill")] * limit)
    empty = F.coalesce(none, F.array().cast("array<struct<url:string,dom:string,slot:string,adjusted:double>>"))
    return lists.select("run_id", F.aggregate(steps, empty, step).alias("picks")).select(
        "run_id", F.posexplode("picks").alias("pick", "p")
    ).select(
        "run_id", (F.col("pick") + 1).alias("pick"), F.col("p.url").alias("normalized_url"),
        F.col("p.slot").alias("slot"), F.round("p.adjusted", 3).alias("adjusted"),
    )


def diverse_top(scored: DataFrame, keys: list[str], limit: int, out: str = "pick") -> DataFrame:
    """Diversity top-k: every pick makes later rows of its domain dearer by 1.25.

    Equal to the greedy loop: the n-th row of a domain costs (n-1) penalties, so
    one sort on the price gives the same picks in the same order.
    """
    dom = F.lower(F.coalesce("source_domain", F.lit("")))
    rows = top_n(scored.withColumn("__dom", dom), [*keys, "__dom"], _order(), limit, "__n")
    priced = rows.withColumn("adjusted", F.col("score") - SAME_DOMAIN * (F.col("__n") - 1))
    order = [F.col("adjusted").desc(), *_order()]
    return top_n(priced, keys, order, limit, out).drop("__dom", "__n")


# Replay variants, (name, score weights, least score or none).
REPLAYS = {
    "stage_detail_first": ("stage_detail_first", None),
    "precision_guard": ("precision_guard", None),
    "quality_floor": ("conversion_mix", 0.0),
}


def replay_variants(
    hits: DataFrame, variants: dict | None = None, rounds: int = 3, limit: int = 6
) -> DataFrame:
    """Each variant over the same frontier for some rounds, no URL twice.

    All runs and variants advance together; a round's picks are written out
    before the next one excludes them.
    """
    variants = variants or REPLAYS
    # All variants are scored in one pass where the hits are read; texts, flags and traits come back at the end.
    scores = F.array(*[batch_score(weights) for weights, _ in variants.values()])
    slim = ["run_id", "normalized_url", "provider_rank", "ord"]
    given = with_traits(hits).filter("run_id IS NOT NULL").select(
        *slim, F.lower(F.coalesce("source_domain", F.lit(""))).alias("__dom"), scores.alias("__scores")
    )
    # Moved once, before the rows of the variants, and by run, so no rank needs a further move. A run too large for
    # one task is moved by its URLs and then by its domains.
    held = largest(hits, ["run_id"]) <= HELD
    moved = unfetched(given.repartition("run_id"), None) if held else unfetched(given, None).repartition("run_id", "__dom")
    named = F.element_at(F.array(*map(F.lit, variants)), F.col("__v") + 1)
    scored = moved.select(*slim, "__dom", F.posexplode("__scores").alias("__v", "score")).withColumn("variant", named).drop("__v")
    for name, (_, floor) in variants.items():
        if floor is not None:
            scored = scored.filter((F.col("variant") != name) | (F.col("score") >= floor))
    key = ["variant", "run_id"]
    # In all rounds together only the best rounds x limit rows of a domain, and of
    # so many domains, can be picked.
    most = rounds * limit
    rows = top_n(scored, [*key, "__dom"], _order(), most, "__n")
    if held:
        head = F.first(F.struct(*ORDER)).over(W.partitionBy(*key, "__dom").orderBy(*_order()))
        place = W.partitionBy(*key).orderBy(F.col("__head.score").desc(), "__head.provider_rank", "__head.ord", "__dom")
        led = rows.withColumn("__head", head).withColumn("__h", F.dense_rank().over(place)).filter(F.col("__h") <= most)
    else:
        heads = top_n(rows.filter("__n = 1"), key, _order(), most, "__h")
        # Joined by run and domain alone, as the rows lie, so they are not moved again.
        leads = heads.groupBy("run_id", "__dom").agg(F.collect_set("variant").alias("__led"))
        led = rows.join(leads, ["run_id", "__dom"]).filter(F.array_contains("__led", F.col("variant")))
    pool = cut(led.select(*slim, F.col("__dom").alias("source_domain"), "variant", "score"))
    left, picks = pool, []
    for i in range(1, rounds + 1):
        now = cut(diverse_top(left, key, limit).withColumn("round", F.lit(i)))
        picks.append(now)
        left = left.join(now.select(*key, "normalized_url"), [*key, "normalized_url"], "left_anti")
    # The first row of a URL is known by its place; of several rows in that place one is left.
    at = {"run_id": "__run", "normalized_url": "__url", "ord": "__ord"}
    found = ["variant", "score", "adjusted", "pick", "round"]
    all_picks = reduce(DataFrame.unionByName, picks).select(*[F.col(c).alias(n) for c, n in at.items()], *found)
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(n)) for c, n in at.items()])
    whole = hits.filter(F.col("normalized_url") != "").join(all_picks, same)
    return with_traits(first_per(whole, ["__run", "__url", "variant", "round", "pick"], [F.col("ord")]).drop(*at.values()))


def replay_scores(hits: DataFrame, variant: str, rounds: int = 3, limit: int = 6) -> DataFrame:
    """Replay of a variant without penalties: one ranking cut in blocks."""
    scored = with_traits(unfetched(hits, None)).withColumn("score", batch_score(variant))
    ranked = top_n(scored, ["run_id"], _order(), rounds * limit, "pick")
    return ranked.withColumn("round", (F.floor((F.col("pick") - 1) / limit) + 1).cast("int"))


def replay_known(picks: DataFrame, known: DataFrame) -> DataFrame:
    """Picks joined to earlier triage outcomes; the later round's outcome counts."""
    last = known.groupBy("normalized_url").agg(F.max_by("action", "round").alias("known_action"))
    return picks.join(last, "normalized_url", "left")


def selection_report(picks: DataFrame) -> DataFrame:
    """Per variant: stage, school, stale and known-outcome counts and the domains."""
    a = F.col("known_action")
    return picks.groupBy("variant").agg(
        F.count("*").alias("n_picks"),
        F.count_if(F.col("stage_match")).alias("n_stage"),
        F.count_if(F.col("specific_school")).alias("n_school"),
        F.count_if(F.col("stale_cycle") | F.col("indirect_content")).alias("n_stale_or_indirect"),
        F.count_if(a == "advance_to_finalize").alias("n_known_advance"),
        F.count_if(a == "hold_for_expansion").alias("n_known_hold"),
        F.count_if(a == "drop").alias("n_known_drop"),
        F.count_distinct("source_domain").alias("n_domains"),
    )
