"""Decision tables from outside models, checked against the rules' own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ranks import top_n
from ..functions.text import clean, flag

TRIAGE_ACTIONS = ["advance_to_finalize", "hold_for_expansion", "drop"]


def validate_triage(model: DataFrame, rules: DataFrame) -> DataFrame:
    """A run's model decisions if all are sound, else all of the rules' decisions.

    ``model(run_id, item_id, action, rationale)``; ``rules`` has one row per item
    with ``url, action, rationale, mirror``.  Unknown, missing or doubled items, a
    bad action or a blank rationale spoil the whole run.  A model may not advance
    an aggregator's page past the rules.
    """
    m = model.groupBy("run_id", F.trim(F.coalesce("item_id", F.lit(""))).alias("item_id")).agg(
        F.count("*").alias("n"), F.first(F.trim("action")).alias("m_action"), F.first(clean("rationale")).alias("m_rationale")
    )
    both = rules.join(m, ["run_id", "item_id"], "full_outer")
    sound = (
        F.col("url").isNotNull() & (F.col("n") == 1) & F.col("m_action").isin(TRIAGE_ACTIONS)
        & (F.coalesce("m_rationale", F.lit("")) != "")
    )
    verdict = both.groupBy("run_id").agg(F.min(flag(sound).cast("int")).alias("sound"))
    j = both.filter(F.col("url").isNotNull()).join(verdict, "run_id")
    ok = F.col("sound") == 1
    guarded = ok & (F.col("m_action") == "advance_to_finalize") & flag(F.col("mirror"))
    use = ok & ~guarded
    return j.select(
        "run_id", "item_id", "url",
        F.when(use, F.col("m_action")).otherwise(F.col("action")).alias("action"),
        F.when(use, F.col("m_rationale")).otherwise(F.col("rationale")).alias("rationale"),
        F.when(~ok, "fallback").when(guarded, "guardrail").otherwise("model").alias("mode"),
    )


def validate_batch(model: DataFrame, hits: DataFrame, rules: DataFrame, limit: int = 6) -> DataFrame:
    """A run's model picks if sound and within the limit, else the rules' picks.

    ``model(run_id, item_id, ord, rationale)``, ``hits(run_id, item_id, url)``,
    ``rules(run_id, pick, url)``.
    """
    j = model.join(hits.withColumn("known", F.lit(True)), ["run_id", "item_id"], "left")
    verdict = j.groupBy("run_id").agg(
        F.min((flag(F.col("known")) & (clean("rationale") != "")).cast("int")).alias("known"),
        F.count("*").alias("n"), F.count_distinct("item_id").alias("d"),
    ).select("run_id", ((F.col("known") == 1) & (F.col("n") == F.col("d")) & (F.col("n") <= limit)).alias("ok"))
    good = verdict.filter("ok").select("run_id")
    picked = top_n(
        j.join(good, "run_id", "left_semi"), ["run_id"], [F.col("ord")], limit, "pick"
    ).select("run_id", "pick", "url", F.lit("model").alias("mode"))
    ruled = rules.join(good, "run_id", "left_anti").select("run_id", "pick", "url", F.lit("fallback").alias("mode"))
    return picked.unionByName(ruled)


def validate_progress(model: DataFrame, rules: DataFrame) -> DataFrame:
    """A run's model progress decision if action, step and hints agree.

    Of several valid answers of a run the first by ``ord`` counts, if the table has one, then the smallest in text order.
    """
    a, s = F.trim("action"), F.trim("next_step")
    hints = F.size(F.filter(F.transform(F.coalesce("suggestions", F.array().cast("array<string>")), clean), lambda x: x != ""))
    ok = (clean("rationale") != "") & (
        ((a == "stop") & (s == "stop_now") & (hints == 0))
        | ((a == "replan") & (s == "widen_queries"))
        | ((a == "continue") & s.isin("fetch_remaining_frontier", "expand_held_hubs") & (hints == 0))
    )
    m = model.filter(flag(ok)).groupBy("run_id").agg(
        F.min(
            F.struct(
                *[F.col(c) for c in ("ord",) if c in model.columns],
                a.alias("action"), s.alias("next_step"), clean("rationale").alias("rationale"),
            )
        ).alias("m")
    )
    j = rules.join(m, "run_id", "left")
    return j.select(
        "run_id",
        *[F.coalesce(F.col(f"m.{c}"), F.col(c)).alias(c) for c in ("action", "next_step", "rationale")],
        F.when(F.col("m").isNull(), "fallback").otherwise("model").alias("mode"),
    )


def validate_children(
    model: DataFrame, children: DataFrame, rules: DataFrame, keys: list[str], most: Column | int = 4
) -> DataFrame:
    """A hub's model picks, cut to the budget, if sound, else the rules' picks.

    ``model(*keys, child_id, ord, reason, expand, rationale)`` has one row per pick
    (``child_id`` NULL for an answer without picks); ``children(*keys, child_id,
    url, is_source)``; ``rules(*keys, url, reason, pick)``.  On an aggregator page
    with original-source links, picks that leave them out are replaced.
    """
    most = F.lit(most) if not isinstance(most, Column) else most
    j = model.join(children, [*keys, "child_id"], "left")
    picked = F.col("child_id").isNotNull()
    bad = picked & (F.col("url").isNull() | (clean("reason") == ""))
    sources = children.groupBy(*keys).agg(F.max(flag(F.col("is_source"))).alias("has_source"))
    verdict = j.groupBy(*keys).agg(
        F.max(bad.cast("int")).alias("bad"), F.count("child_id").alias("n"), F.count_distinct("child_id").alias("d"),
        F.max(flag(F.col("expand")).cast("int")).alias("expand"), F.min((clean("rationale") != "").cast("int")).alias("why"),
        F.max((picked & ~flag(F.col("is_source"))).cast("int")).alias("other"),
    ).join(sources, keys, "left").withColumn("kept", F.least("n", most))
    sound = (
        (F.col("bad") == 0) & (F.col("n") == F.col("d")) & (F.col("why") == 1)
        & ((F.col("expand") == 1) == (F.col("kept") > 0))
    )
    overruled = flag(F.col("has_source")) & ((F.col("n") == 0) | (F.col("other") == 1))
    verdict = verdict.withColumn(
        "mode", F.when(~sound, "fallback").when(overruled, "guardrail").otherwise("model")
    )
    w = W.partitionBy(*keys).orderBy("ord")
    mine = (
        j.filter(picked).join(verdict.filter("mode = 'model'").select(*keys, "mode"), keys)
        .withColumn("pick", F.row_number().over(w)).filter(F.col("pick") <= most)
        .select(*keys, "url", clean("reason").alias("reason"), "pick", "mode")
    )
    theirs = rules.join(verdict.filter("mode <> 'model'").select(*keys, "mode"), keys).select(
        *keys, "url", "reason", "pick", "mode"
    )
    return mine.unionByName(theirs)


def triage_report(decisions: DataFrame) -> DataFrame:
    """Per variant: actions overall and on aggregator pages."""
    agg = flag(F.col("aggregator"))
    a = F.col("action")
    names = {"advance": TRIAGE_ACTIONS[0], "hold": TRIAGE_ACTIONS[1], "drop": TRIAGE_ACTIONS[2]}
    return decisions.groupBy("variant").agg(
        *[F.count_if(a == x).alias(f"n_{n}") for n, x in names.items()],
        *[F.count_if(agg & (a == x)).alias(f"n_aggregator_{n}") for n, x in names.items()],
    )


def promoted(decisions: DataFrame) -> DataFrame:
    """Aggregator pages that a variant advances, one row each."""
    return decisions.filter(flag(F.col("aggregator")) & (F.col("action") == TRIAGE_ACTIONS[0])).select("variant", "url")
