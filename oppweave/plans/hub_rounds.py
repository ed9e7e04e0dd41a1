"""Rounds of select, triage, lead staging and progress, for many runs at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import flag
from ..operators import batch as b
from ..operators import hubs as h
from ..operators import routing as r
from ..operators.links import mark_seen
from ..session import cut

LEAD = "run_id STRING, hub STRING, url STRING, lead_ord BIGINT, source_type STRING, verification_priority STRING, is_official BOOLEAN, needs_verification BOOLEAN, enqueued_round INT"


def _lead_rows(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("run_id").cast("string"), "hub", "url", F.col("lead_ord").cast("bigint"), "source_type", "verification_priority",
        "is_official", "needs_verification", F.col("enqueued_round").cast("int"),
    )


def hub_rounds(
    hits: DataFrame, bundles: DataFrame, links: DataFrame, max_rounds: int = 5, pages_per_run: int = 18,
    per_round: int = 6, leads_per_hub: int = 6, target: int = 5, history: DataFrame | None = None, as_of: str | None = None,
) -> dict[str, DataFrame]:
    """Run the hub flow until every run stops.

    ``hits`` carry the batch features, ``bundles(run_id, page_id, canonical_url,
    ...)`` the stored pages as each run sees them, ``links(page_id, ...)`` their
    child links. With a fetch ``history``, links whose page was fetched recently at ``as_of`` are marked and rank
    lower; without one the links' own ``seen_recently`` counts.  All runs move together; runs that stopped leave the round.  The
    state of each round is written out, so a lost executor costs one round at most.
    A hub's leads are cut to ``leads_per_hub`` whatever the page budget left.
    """
    spark = hits.sparkSession
    if history is not None:
        links = cut(mark_seen(links.drop("seen_recently"), history, as_of))
    hits = cut(hits.withColumn("run_id", F.col("run_id").cast("string")))
    bundles = cut(bundles.withColumn("run_id", F.col("run_id").cast("string")))
    runs = hits.select("run_id").distinct()
    fetched = spark.createDataFrame([], "run_id STRING, normalized_url STRING, round INT")
    queue = backlog = spark.createDataFrame([], LEAD)
    origins = spark.createDataFrame([], "run_id STRING, url STRING, parent_hub_url STRING")
    outcomes = spark.createDataFrame([], "run_id STRING, parent_hub_url STRING, delta INT")
    finals = spark.createDataFrame([], "run_id STRING, url STRING, round INT")
    progress = cut(runs.select("run_id", F.lit("continue").alias("action"), F.lit("").alias("next_step")))
    trace, decisions = None, None
    for rnd in range(1, max_rounds + 1):
        active = progress.filter("action <> 'stop'")
        if active.isEmpty():
            break
        heat = h.hub_heat(outcomes).join(active.select("run_id"), "run_id", "left_semi")
        used = fetched.groupBy("run_id").agg(F.count("*").alias("n_used"))
        with_queue = queue.select("run_id").distinct().withColumn("has_queue", F.lit(True))
        plan = active.join(with_queue, "run_id", "left").join(used, "run_id", "left").select(
            "run_id",
            ((F.col("next_step") == "expand_held_hubs") & F.col("has_queue").isNotNull()).alias("expand"),
            F.greatest(F.lit(0), pages_per_run - F.coalesce("n_used", F.lit(0))).alias("pages"),
        )
        plan = cut(plan)
        wide, deep = plan.filter(~F.col("expand")), plan.filter("expand")
        picks = b.select_batch(hits.join(wide.select("run_id"), "run_id", "left_semi"), per_round, fetched).select(
            "run_id", "pick", "normalized_url", F.lit("search_frontier").alias("source")
        )
        leads_now = h.select_expansion(
            queue.join(deep.select("run_id"), "run_id", "left_semi").withColumnRenamed("hub", "parent_hub_url"), heat, per_round
        )
        kids = leads_now.select("run_id", "pick", F.col("url").alias("normalized_url"), F.lit("hub_expansion").alias("source"))
        limit = F.when(F.col("pages") > 0, F.least(F.col("pages"), F.lit(per_round))).otherwise(per_round)
        chosen = (
            picks.unionByName(kids).join(plan.select("run_id", "pages"), "run_id")
            .join(fetched.select("run_id", "normalized_url"), ["run_id", "normalized_url"], "left_anti")
            .filter(F.col("pick") <= limit)
        )
        chosen = cut(chosen)
        queue = cut(queue.join(kids.select("run_id", F.col("normalized_url").alias("url")), ["run_id", "url"], "left_anti"))
        fetched = cut(fetched.unionByName(chosen.select("run_id", "normalized_url", F.lit(rnd).alias("round"))))
        size = chosen.groupBy("run_id").agg(F.count("*").alias("n_now"))
        stored = bundles.withColumn("normalized_url", F.col("canonical_url"))
        pages = chosen.join(stored.drop("ord"), ["run_id", "normalized_url"], "left").join(size, "run_id").withColumns(
            {
                "canonical_url": F.col("normalized_url"),
                "ord": F.col("pick").cast("bigint"),
                "missing": F.col("page_id").isNull(),
            }
        )
        pages = pages.withColumn(
            "blockers",
            pages["blockers"].withField("access_blocked", flag(pages["blockers.access_blocked"])),
        ).withColumn(
            "blockers",
            F.when(
                F.col("missing"),
                F.struct(F.lit(False).alias("closed"), F.lit(False).alias("past_cycle"), F.lit(False).alias("stage_mismatch"), F.lit(True).alias("access_blocked")),
            ).otherwise(F.col("blockers")),
        )
        pages = cut(pages)
        left = F.greatest(F.lit(0), F.col("pages") - F.col("n_now"))
        mine = links.join(pages.filter(~F.col("missing")).select("run_id", "page_id"), "page_id")
        key = ["run_id", "page_id"]
        triaged = cut(r.triage_pages(pages, mine, key, left, 1))
        dec = triaged.select("run_id", F.col("normalized_url").alias("url"), "action")
        shown = triaged.select("run_id", F.col("normalized_url").alias("requested_url"), "canonical_url")
        outcomes = cut(
            outcomes.unionByName(h.lineage_outcomes(shown, dec, origins).select("run_id", "parent_hub_url", F.col("delta").cast("int").alias("delta")))
        )
        now_heat = h.hub_heat(outcomes)
        seen = fetched.select("run_id", F.col("normalized_url").alias("url"))
        hot = now_heat.select("run_id", F.col("parent_hub_url").alias("hub"), "heat", F.col("parent_hub_url").alias("hub_ord"))
        promoted, backlog = h.promote_reserves(backlog, hot, queue.select("run_id", "url"), seen)
        queue = cut(queue.unionByName(_lead_rows(promoted)))
        backlog = cut(_lead_rows(backlog))
        got = triaged.filter("action = 'advance_to_finalize'").select("run_id", F.col("normalized_url").alias("url"), F.lit(rnd).alias("round"))
        finals = cut(finals.unionByName(got.join(finals, ["run_id", "url"], "left_anti")))
        held = triaged.filter("action = 'hold_for_expansion'")
        leads, _ = r.extract_leads(mine, held, key, "starting_college", leads_per_hub, None)
        rows = leads.select(
            "run_id", F.col("source_url").alias("hub"), F.col("ord").alias("hub_ord"), F.col("lead_rank").cast("bigint").alias("lead_ord"),
            F.col("lead_url").alias("url"), "source_type", "verification_priority", "is_official", "needs_verification",
            F.lit(rnd).alias("enqueued_round"),
        )
        rows = cut(rows)
        added, spare = h.stage_leads(rows, queue.select("run_id", "url"), seen, backlog.select("run_id", "hub", "url"))
        queue = cut(queue.unionByName(_lead_rows(added)))
        backlog = cut(backlog.unionByName(_lead_rows(spare)))
        # Of several hubs that lead to a URL the last one is its origin.
        fresh = rows.groupBy("run_id", "url").agg(F.max_by("hub", F.struct("hub_ord", "lead_ord", "hub")).alias("parent_hub_url"))
        origins = cut(origins.join(fresh, ["run_id", "url"], "left_anti").unionByName(fresh))
        # Where each run stands after the round.
        unf = b.unfetched(hits, fetched).groupBy("run_id").agg(F.count("*").alias("unfetched"))
        stats = triaged.groupBy("run_id").agg(
            F.count_if(F.col("action") == "advance_to_finalize").alias("advanced"),
            F.count_if(F.col("action") == "hold_for_expansion").alias("held"),
            F.round(F.avg(flag(F.col("fit.school")).cast("int")), 3).alias("school_pressure"),
        )
        state = (
            plan.join(stats, "run_id").join(unf, "run_id", "left")
            .join(finals.groupBy("run_id").agg(F.count("*").alias("accepted")), "run_id", "left")
            .join(queue.groupBy("run_id").agg(F.count("*").alias("children_ready")), "run_id", "left")
            .withColumns(
                {
                    "round": F.lit(rnd), "strong": F.col("accepted"), "target": F.lit(target), "hubs_ready": F.col("held"),
                    "broad_pressure": F.round(1 - F.col("school_pressure"), 3), "pages_left": F.col("pages"),
                    "depth_left": F.lit(1), "queries_left": F.lit(0), "replans_left": F.lit(0),
                    "search_rounds_left": F.lit(max_rounds - rnd),
                }
            )
        )
        judged = cut(h.assess_progress(state))
        trace = cut(judged.drop("suggestions") if trace is None else trace.unionByName(judged.drop("suggestions")))
        part = triaged.select("run_id", F.lit(rnd).alias("round"), "pick", "source", F.col("normalized_url").alias("url"), "rule", "action")
        decisions = cut(part if decisions is None else decisions.unionByName(part))
        # A run without new pages ends; waiting for an empty queue turns to the frontier.
        empty_queue = (F.col("next_step") == "expand_held_hubs") & (F.coalesce("children_ready", F.lit(0)) == 0)
        progress = cut(
            judged.select(
                "run_id", "action", F.when(empty_queue, "fetch_remaining_frontier").otherwise(F.col("next_step")).alias("next_step")
            )
        )
    return {
        "progress": trace, "decisions": decisions, "finalists": finals, "queue": queue, "backlog": backlog,
        "heat": h.hub_heat(outcomes),
    }
