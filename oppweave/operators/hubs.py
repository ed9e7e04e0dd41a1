"""Hub lineage: lead staging, heat, promotion and the expansion queue."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ranks import top_n
from ..functions.text import flag, let, listed
from ..session import cut


#: Disputed leads of a run that one row may hold; longer runs are settled in waves.
RUN_LEADS = 5000


def _taken_and_left(leads: DataFrame, queued: DataFrame, cap: int) -> tuple[DataFrame, DataFrame]:
    """First ``cap`` leads per hub that no earlier hub took, and the rest.

    ``leads(run_id, hub_ord, lead_ord, url, ...)`` with one row per hub and URL;
    ``queued(run_id, url)`` are taken from the start.  A lead taken by a hub is
    closed to later hubs.  Hubs none of whose URLs another lead of the run has are settled by their own order. The other
    hubs of a run are folded in the run's row, however long their chains are, if they have at most ``RUN_LEADS``
    leads; longer runs, and those with NULL keys, go in waves.
    """
    null = F.col("hub_ord").isNull() | F.col("lead_ord").isNull() | F.col("url").isNull() | F.col("run_id").isNull()
    hub = W.partitionBy("run_id", "hub_ord")
    every = cut(
        leads.join(queued.select("run_id", "url").distinct(), ["run_id", "url"], "left_anti")
        .withColumn("__shared", F.count(F.lit(1)).over(W.partitionBy("run_id", "url")) > 1)
        .withColumns({"__mixed": F.max("__shared").over(hub), "__rn": F.row_number().over(hub.orderBy("lead_ord")), "__null": null})
    )
    runs = every.filter("__mixed OR __null").groupBy("run_id").agg(F.count_if("__mixed").alias("__n"), F.max("__null").alias("__null"))
    runs = cut(runs.select("run_id", (F.col("__null") | (F.col("__n") > RUN_LEADS)).alias("__long")))
    marks = ["__shared", "__mixed", "__rn", "__null"]
    long, waves = runs.filter("__long").select("run_id"), None
    if not long.isEmpty():
        # Null-safe, so that rows without a run stay with the waves.
        long = long.withColumnRenamed("run_id", "__run")
        same = F.col("run_id").eqNullSafe(F.col("__run"))
        waves = _waves(cut(every.join(long, same, "left_semi").drop(*marks)), cap)
        every = every.join(long, same, "left_anti")
    plain, (taken, rest) = every.filter("NOT __mixed"), _folds(every.filter("__mixed").drop("__mixed", "__rn", "__null"), cap)
    taken = taken.unionByName(plain.filter(F.col("__rn") <= cap).drop(*marks))
    rest = rest.unionByName(plain.filter(F.col("__rn") > cap).drop(*marks))
    return (taken, rest) if waves is None else (taken.unionByName(waves[0]), rest.unionByName(waves[1]))


def _folds(every: DataFrame, cap: int) -> tuple[DataFrame, DataFrame]:
    """The literal loop over a run's leads, in hub and lead order, inside the run's row; written once."""
    kept = [c for c in every.columns if c != "__shared"]
    row = F.struct(*[F.col(c) for c in kept if c != "run_id"])
    leads = F.array_sort(F.collect_list(F.struct("hub_ord", "lead_ord", "url", F.col("__shared").alias("shared"), row.alias("row"))))
    none = F.array().cast("array<string>")
    start = F.struct(
        none.alias("before"), none.alias("own"), F.lit(0).alias("n"),
        F.lit(None).cast(every.schema["hub_ord"].dataType).alias("hub"), F.lit("").alias("marks"),
    )

    def mark(s: Column, x: Column) -> Column:
        # t: taken, l: left to the hub, x: its own or an earlier hub took the URL.
        return (
            F.when(x.shared & F.array_contains(s.before, x.url), "x").when(s.n < cap, "t")
            .when(x.shared & F.array_contains(s.own, x.url), "x").otherwise("l")
        )

    def step(s: Column, x: Column) -> Column:
        same = s.hub.eqNullSafe(x.hub_ord)
        at = F.struct(
            F.when(same | (F.size(s.own) == 0), s.before).otherwise(F.concat(s.before, s.own)).alias("before"),
            F.when(same, s.own).otherwise(none).alias("own"), F.when(same, s.n).otherwise(0).alias("n"),
        )
        return let(
            at,
            lambda t: let(
                mark(t, x),
                lambda m: F.struct(
                    t.before.alias("before"), F.when((m == "t") & x.shared, F.concat(t.own, F.array(x.url))).otherwise(t.own).alias("own"),
                    (t.n + (m == "t").cast("int")).alias("n"), x.hub_ord.alias("hub"), F.concat(s.marks, m).alias("marks"),
                ),
            ),
        )

    end = F.aggregate("leads", start, step, lambda s: F.struct(s.marks.alias("marks"), F.concat(s.before, s.own).alias("taken")))
    # A URL that a hub took several times, from equal leads, leaves an earlier hub's lead as often.
    twice = F.size("end.taken") > F.size(F.array_distinct("end.taken"))
    again = F.filter("end.taken", lambda u: u == F.col("lead.url"))
    folded = every.groupBy("run_id").agg(leads.alias("leads")).withColumn("end", end).withColumn("twice", twice)
    marked = cut(
        folded.select("run_id", F.posexplode("leads").alias("i", "lead"), "end", "twice")
        .withColumn("mark", F.substring(F.col("end.marks"), F.col("i") + 1, 1)).filter("mark <> 'x'")
        .select("run_id", "lead.row", "mark", F.when(F.col("twice"), F.greatest(F.lit(1), F.size(again))).otherwise(1).alias("times"))
    )
    own = ["run_id", *[F.col(f"row.`{c}`") for c in kept if c != "run_id"]]
    left = marked.filter("mark = 'l'").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return marked.filter("mark = 't'").select(*own), left.select(*own)


def _waves(every: DataFrame, cap: int) -> tuple[DataFrame, DataFrame]:
    """The same for runs of any size, with NULL keys or without.

    A lead that no earlier open hub wants is sure: its hub takes it if it comes that
    far, so no hub goes past its ``cap``-th sure lead, and only URLs up to there can make a later hub wait. Each
    round settles all hubs of all runs that do not wait; it is written once. Links at the end of many hubs,
    such as footers, cost no round, as the hubs are full before they come to them.
    """
    hub = ["run_id", "hub_ord"]
    todo, rounds = every, []
    while not todo.isEmpty():
        # Twice: once the first cut has shortened the lists, more leads are sure.
        reach = _within_reach(_within_reach(todo, cap), cap)
        owner = reach.groupBy("run_id", "url").agg(F.min("hub_ord").alias("first"), F.count("*").alias("n"))
        waits = (
            reach.join(owner.filter("n > 1"), ["run_id", "url"])
            .filter(F.col("hub_ord") > F.col("first")).select(*hub).distinct()
        )
        ready = reach.join(waits, hub, "left_anti")
        # The literal cap bounds what a hub brings to the shuffle.
        now = cut(top_n(ready, hub, [F.col("lead_ord")], cap, "__rn").drop("__rn"))
        rounds.append(now)
        todo = cut(
            todo.join(waits, hub, "left_semi").join(now.select("run_id", "url").distinct(), ["run_id", "url"], "left_anti")
        )
    taken = reduce(DataFrame.unionByName, rounds) if rounds else every
    # A lead falls if its own or an earlier hub took its URL.
    by = taken.select("run_id", "url", F.col("hub_ord").alias("__by"))
    rest = every.join(by, ["run_id", "url"], "left").filter(F.col("__by").isNull() | (F.col("__by") > F.col("hub_ord")))
    return taken, rest.drop("__by")


def _within_reach(leads: DataFrame, cap: int) -> DataFrame:
    """Leads of each hub up to its ``cap``-th that no earlier hub has."""
    hub = ["run_id", "hub_ord"]
    first = leads.groupBy("run_id", "url").agg(F.min("hub_ord").alias("__first"))
    sure = leads.join(first, ["run_id", "url"]).filter(F.col("hub_ord") == F.col("__first"))
    last = (
        top_n(sure, hub, [F.col("lead_ord")], cap, "__rn").groupBy(*hub)
        .agg(F.max("lead_ord").alias("__last"), F.count("*").alias("__m")).filter(F.col("__m") == cap)
    )
    held = leads.join(last.select(*hub, "__last"), hub, "left")
    return held.filter(F.col("__last").isNull() | (F.col("lead_ord") <= F.col("__last"))).drop("__last")


def stage_leads(
    leads: DataFrame, queue: DataFrame, fetched: DataFrame, backlog: DataFrame, cap: int = 2
) -> tuple[DataFrame, DataFrame]:
    """New queue rows and new backlog rows from the leads of hubs.

    ``leads(run_id, hub_ord, hub, lead_ord, url, ...)``.  Each hub queues its
    first ``cap`` leads nobody fetched or queued; its other leads go to its own
    backlog, once each.
    """
    first = top_n(
        leads.filter(F.col("url") != ""), ["run_id", "hub_ord", "url"], [F.col("lead_ord")], 1, "__rn"
    ).drop("__rn")
    fresh = first.join(fetched.select("run_id", "url").distinct(), ["run_id", "url"], "left_anti")
    added, rest = _taken_and_left(fresh, queue, cap)
    spare = rest.join(backlog.select("run_id", "hub", "url"), ["run_id", "hub", "url"], "left_anti")
    return added, spare


def promote_reserves(
    backlog: DataFrame, heat: DataFrame, queue: DataFrame, fetched: DataFrame, cap: int = 2
) -> tuple[DataFrame, DataFrame]:
    """Reserve leads of hot hubs moved to the queue, and the backlog that stays.

    ``backlog(run_id, hub, lead_ord, url, ...)``, ``heat(run_id, hub, heat,
    hub_ord)``; hottest hubs come first.  Stale reserves of hot hubs go.
    """
    hot = heat.filter("heat > 0").select(
        "run_id", "hub", F.struct((-F.col("heat")).alias("h"), "hub_ord").alias("hub_ord")
    )
    mine = backlog.drop("hub_ord").join(hot, ["run_id", "hub"])
    fresh = mine.join(fetched.select("run_id", "url").distinct(), ["run_id", "url"], "left_anti")
    promoted, rest = _taken_and_left(fresh, queue, cap)
    cold = backlog.drop("hub_ord").join(hot.select("run_id", "hub"), ["run_id", "hub"], "left_anti")
    return promoted.drop("hub_ord"), cold.unionByName(rest.drop("hub_ord"))


def lineage_outcomes(pages: DataFrame, decisions: DataFrame, origins: DataFrame) -> DataFrame:
    """Heat each fetched page brings to its parent hub: advanced 2, held 1.

    Pages carry ``requested_url`` and ``canonical_url``; origin and decision may be
    known under either, the canonical one first.
    """
    # Heat per outcome.
    gain = F.max(
        F.when(F.col("action") == "advance_to_finalize", 2)
        .when(F.col("action") == "hold_for_expansion", 1)
        .otherwise(0)
    )
    d = decisions.groupBy("run_id", "url").agg(gain.alias("gain"))
    o = origins.groupBy("run_id", "url").agg(F.min("parent_hub_url").alias("parent"))
    known = o.join(d, ["run_id", "url"], "full_outer")
    for side in ("canonical", "requested"):
        part = known.select(
            "run_id", F.col("url").alias(f"{side}_url"), F.col("parent").alias(f"{side}_parent"), F.col("gain").alias(f"{side}_gain")
        )
        pages = pages.join(part, ["run_id", f"{side}_url"], "left")
    zero = F.lit(0)
    return (
        pages.select(
            "run_id", "requested_url", "canonical_url",
            F.coalesce("canonical_parent", "requested_parent").alias("parent_hub_url"),
            F.greatest(F.coalesce("canonical_gain", zero), F.coalesce("requested_gain", zero)).alias("delta"),
        )
        .filter(F.col("parent_hub_url").isNotNull() & (F.col("delta") > 0))
    )


def carry_origins(pages: DataFrame, origins: DataFrame) -> DataFrame:
    """Origins with those of requested URLs also under the canonical URL."""
    via = (
        pages.filter(F.col("canonical_url") != "")
        .select("run_id", F.col("requested_url").alias("url"), "canonical_url")
        .join(origins, ["run_id", "url"])
        .select("run_id", F.col("canonical_url").alias("url"), "parent_hub_url")
    )
    fresh = via.join(origins.select("run_id", "url"), ["run_id", "url"], "left_anti").groupBy("run_id", "url").agg(
        F.min("parent_hub_url").alias("parent_hub_url")
    )
    return origins.unionByName(fresh)


def hub_heat(outcomes: DataFrame) -> DataFrame:
    """Heat per hub over all rounds."""
    return outcomes.groupBy("run_id", "parent_hub_url").agg(F.sum("delta").cast("int").alias("heat"))


def expansion_priority() -> Column:
    p = F.col("verification_priority")
    # Expansion priority.
    return (
        F.coalesce("heat", F.lit(0)) * 10.0
        + F.when(p == "high", 3).when(p == "medium", 2).when(p == "low", 1).otherwise(0)
        + F.when(flag(F.col("is_official")), 2).otherwise(0)
        + F.when(flag(F.col("needs_verification")), 0.5).otherwise(0.0)
    )


def select_expansion(queue: DataFrame, heat: DataFrame, k: int = 6) -> DataFrame:
    """Best ``k`` queued leads per run; URL ties in binary order."""
    joined = queue.join(heat.select("run_id", "parent_hub_url", "heat"), ["run_id", "parent_hub_url"], "left")
    order = [F.col("priority").desc(), F.col("enqueued_round").asc(), F.col("url").asc()]
    return top_n(joined.withColumn("priority", expansion_priority()), ["run_id"], order, k, "pick")


# ---- progress --------------------------------------------------------------------------------

# Progress outcomes.
PROGRESS = {
    "done": ("stop", "stop_now", "Accepted candidates have reached the current target with enough strong evidence to stop this run."),
    "spent": ("stop", "stop_now", "Meaningful search budget is exhausted, so the run should stop."),
    "children": ("continue", "expand_held_hubs", "Promising hub-expansion children are already selected and look like the strongest next use of fetch budget."),
    "hubs": ("continue", "expand_held_hubs", "Held hub pages still look promising enough to expand before widening the search."),
    "frontier": ("continue", "fetch_remaining_frontier", "There are still unfetched search results worth inspecting before widening the search."),
    "replan": ("replan", "widen_queries", "Accepted count is still below target and the remaining opportunity set looks too weak or too narrow to keep the current search pattern."),
    "rest": ("continue", "fetch_remaining_frontier", "Remaining search frontier is the best available next path."),
    "weak": ("stop", "stop_now", "The remaining opportunity set does not look strong enough to justify more rounds."),
}

# Hints for the next search, in rule order.
HINTS = [
    "broaden toward non-school-specific undergraduate scholarships",
    "search professional organizations and foundations instead of department pages",
    "widen to broader STEM and engineering scholarship queries",
    "favor direct-detail scholarship pages over hubs in the next query batch",
]


def assess_progress(state: DataFrame) -> DataFrame:
    """Stop, go on or plan anew for every run, by ordered rules."""

    def n(c: str) -> Column:
        return F.greatest(F.lit(0), F.floor(F.coalesce(c, F.lit(0))))

    def share(c: str) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c, F.lit(0.0))))

    t = n("target")
    target = F.when(t == 0, 5).otherwise(t)
    pages, depth, queries = n("pages_left"), n("depth_left"), n("queries_left")
    school, broad = share("school_pressure"), share("broad_pressure")
    # Progress thresholds.
    rules = [
        ("done", (n("accepted") >= target) & (n("strong") > 0)),
        ("spent", (pages <= 0) & (queries <= 0) & (depth <= 0)),
        ("children", (n("children_ready") > 0) & (pages > 0) & (depth > 0)),
        ("hubs", (n("hubs_ready") > 0) & (n("held") > 0) & (pages > 0) & (depth > 0) & (school <= 0.75)),
        ("frontier", (n("unfetched") > 0) & (pages > 0) & ((broad >= school) | (school < 0.65))),
        ("replan", (n("accepted") < target) & (n("replans_left") > 0) & (queries > 0) & (n("search_rounds_left") > 0)),
        ("rest", (n("unfetched") > 0) & (pages > 0)),
    ]
    rule = F.when(F.lit(False), F.lit(""))
    for name, cond in rules:
        rule = rule.when(cond, F.lit(name))
    out = state.withColumn("rule", rule.otherwise("weak"))
    for i, c in enumerate(("action", "next_step", "rationale")):
        m = F.create_map(*[F.lit(x) for k, row in PROGRESS.items() for x in (k, row[i])])
        out = out.withColumn(c, m[F.col("rule")])
    hints = listed(
        (school >= 0.55, HINTS[0]), (school >= 0.55, HINTS[1]), (broad < 0.4, HINTS[2]), (n("advanced") <= 0, HINTS[3])
    )
    none = F.array().cast("array<string>")
    return out.withColumn(
        "suggestions", F.when(F.col("rule") == "replan", F.slice(hints, 1, 5)).otherwise(none)
    )


def opportunity_pressure(bundles: DataFrame, keys: list[str]) -> DataFrame:
    """Share of school-specific and of broad pages per round."""
    school = flag(F.col("specific_school")).cast("int")
    return bundles.groupBy(*keys).agg(
        F.round(F.avg(school), 3).alias("school_pressure"), F.round(F.avg(1 - school), 3).alias("broad_pressure")
    )


def skip_reason_counts(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    return outcomes.filter(F.coalesce("reason", F.lit("")) != "").groupBy(*keys, "reason").agg(F.count("*").alias("n"))


def run_summary(runs: DataFrame) -> DataFrame:
    """Why a run brought no new candidates, by ordered rules.

    ``runs(run_id, discovered, imported, pending, approved, fetched, skipped)``.
    """
    d, i = F.coalesce("discovered", F.lit(0)), F.coalesce("imported", F.lit(0))
    return runs.withColumn(
        "reason",
        F.when(F.col("discovered").isNull() & F.col("imported").isNull(), "unknown_no_import_signal")
        .when(i > 0, "")
        .when((d == 0) & (F.coalesce("fetched", F.lit(0)) == 0) & (F.coalesce("skipped", F.lit(0)) > 0),
              "all_search_results_skipped_by_recent_history")
        .when(d == 0, "agent_returned_zero_candidates")
        .otherwise("all_discovered_candidates_skipped_or_deduped"),
    )
