"""Ranks over NULL and hot keys, waves over shared links, traces of repeated jobs."""

import random

import pytest
from pyspark.sql import functions as F

from oppweave.functions.ranks import full_rank
from oppweave.operators import hits as o
from oppweave.operators import hubs as h
from oppweave.operators import matching as m
from oppweave.sources import writers as wr


@pytest.mark.parametrize("hot", [0.0, 0.9])
def test_full_rank_numbers_every_row_of_any_key(spark, hot):
    rnd = random.Random(3)
    rows = [(rnd.choice(["a", "b", None]) if rnd.random() > hot else "a", rnd.choice([None, 1, 2, 10**12]), i) for i in range(400)]
    df = spark.createDataFrame(rows, "run_id string, score long, ord long").repartition(5)
    got = full_rank(df, ["run_id"], [F.col("score").desc_nulls_last(), F.col("ord").asc()], "rank").collect()
    assert len(got) == len(rows)
    for key in ("a", "b", None):
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
        assert [r["ord"] for r in sorted((x for x in got if x["run_id"] == key), key=lambda x: x["rank"])] == [r[2] for r in mine]
        assert sorted(x["rank"] for x in got if x["run_id"] == key) == list(range(1, len(mine) + 1))


HITS = "run_id string, fit_score double, novelty_score double, provider_rank int, global_rank int, pass_priority int, surface_type string, ord int"


def test_rank_hits_keeps_null_runs_and_priorities_and_takes_null_scores_as_zero(spark):
    rows = [
        ("r", 5.0, 0.0, 1, 1, 1, "other", 1), ("r", None, 3.0, 1, 2, None, "other", 2), ("r", 0.0, 1.0, 1, 3, 1, "other", 3),
        ("r", -2.0, None, 1, 4, 1, "other", 4), (None, 1.0, 1.0, 1, 5, None, None, 5),
    ]
    df = spark.createDataFrame(rows, HITS)
    for order in ("search", "discovery"):
        got = {r["ord"]: r["rank"] for r in o.rank_hits(df, order).collect()}
        assert len(got) == 5 and got[1] == 1 and got[4] == 4 and got[5] == 1
    assert [r["ord"] for r in o.rank_hits(df).filter("run_id = 'r'").orderBy("rank").collect()] == [1, 2, 3, 4]


def test_same_domain_flag_keeps_null_runs(spark):
    df = spark.createDataFrame([(None, "a.org", 1), (None, "a.org", 2), ("r", None, 1)], "run_id string, source_domain string, rank int")
    assert sorted(r["same_domain_as_prior"] for r in o.same_domain_flag(df).collect()) == [False, False, True]


def test_merge_expansion_ranks_null_runs_after_the_base(spark):
    ddl = "run_id string, normalized_url string, ord int, global_rank int"
    base = spark.createDataFrame([(None, "u1", 1, 1), ("r", "u1", 1, 1)], ddl)
    extra = spark.createDataFrame([(None, "u1", 2), (None, "u2", 3), ("r", "u3", 4)], "run_id string, normalized_url string, ord int")
    got = {(r["run_id"], r["normalized_url"]): r["global_rank"] for r in o.merge_expansion(base, extra).collect()}
    assert got == {(None, "u1"): 1, (None, "u2"): 2, ("r", "u1"): 1, ("r", "u3"): 2}


@pytest.mark.parametrize("hubs", [12, 300])
def test_a_footer_link_on_all_hubs_costs_no_rounds(spark, monkeypatch, hubs):
    writes = []
    real = h.cut
    monkeypatch.setattr(h, "cut", lambda df: writes.append(1) or real(df))
    rows = [("r", k, f"h{k}", i, u) for k in range(hubs) for i, u in enumerate((f"own{k}a", f"own{k}b", "footer"))]
    leads = spark.createDataFrame(rows, "run_id string, hub_ord int, hub string, lead_ord int, url string")
    none = leads.select("run_id", "hub", "url").limit(0)
    added, spare = h.stage_leads(leads, none.select("run_id", "url"), none.select("run_id", "url"), none, 2)
    assert added.count() == 2 * hubs and {r["url"] for r in spare.collect()} == {"footer"}
    assert spare.count() == hubs and len(writes) == 3  # the leads, one round, what it leaves


def test_all_offers_are_ranked_without_a_bound(spark):
    cols = "profile_id string, award_amount double, fit_score double, essay_score double, deadline string, effort_minutes int, ord int"
    df = spark.createDataFrame([("p", float(k % 5), 0.0, 0.0, "", 1, k) for k in range(40)], cols)
    whole = {(r["ord"], r["rank"]) for r in m.rank_offers(df, None).collect()}
    assert len(whole) == 40 and {x for x in whole if x[1] <= 7} == {(r["ord"], r["rank"]) for r in m.rank_offers(df, 7).collect()}


def test_a_repeated_trace_job_leaves_no_row_twice(spark, tmp_path):
    trace = spark.createDataFrame([(f"run{k}", k % 2, f"line {k}") for k in range(500)], "run_id string, round int, line string")
    for _ in range(2):
        wr.write_run_trace(trace, str(tmp_path / "t"), buckets=4)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 500
    assert len(list((tmp_path / "t").glob("round=*/run_bucket=*"))) == 8


def test_pages_of_one_row_group_are_dealt_to_tasks(spark, tmp_path):
    from oppweave.workloads.plans import applications
    from oppweave.workloads.tables import offer_pages

    part = spark.range(9000).select(
        F.col("id").alias("p_partkey"), F.lit("red bolt").alias("p_name"), F.lit("Brand#1").alias("p_brand"), F.lit("PROMO").alias("p_type"),
        (F.col("id") % 50).cast("int").alias("p_size"), F.lit(10.5).alias("p_retailprice"),
    )
    part.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    people = spark.range(9000).select(
        F.col("id").alias("c_custkey"), F.lit("n").alias("c_name"), F.lit(1).alias("c_nationkey"), F.lit(1.0).alias("c_acctbal"), F.lit("AUTO").alias("c_mktsegment")
    )
    people.coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    for df, key in ((offer_pages(spark, str(tmp_path)), "page_id"), (applications(spark, str(tmp_path)), "profile_id")):
        sizes = df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(key).alias("n")).collect()
        assert len(sizes) > 1 and sum(r["n"] for r in sizes) == 9000


def test_only_shared_keys_enter_the_rounds_of_first_wins(spark, monkeypatch):
    from oppweave.operators import store

    written = []
    monkeypatch.setattr(store, "cut", lambda df: written.append(df.count()) or df.localCheckpoint())
    rows = [(i, f"u{i}", f"n{i}", "d") for i in range(50)] + [(50, "u0", "x", "d")]
    df = spark.createDataFrame(rows, "id int, source_url string, name string, source_domain string")
    assert {r["id"] for r in store.first_wins(df, "id", "id").collect()} == set(range(50))
    assert max(written) <= 2


def test_matching_broadcasts_no_table_of_guessed_size(spark):
    pairs = spark.createDataFrame([(1, 2)], "profile_id long, id long")
    prompts = spark.createDataFrame([(2, "a b")], "id long, prompt string")
    essays = spark.createDataFrame([(1, "b c")], "profile_id long, content string")
    people = spark.createDataFrame([(1, "x")], "profile_id long, intended_major string")
    for df in (m.essay_containment(prompts, essays, pairs), m.match_pairs(people, prompts, pairs)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert m.essay_containment(prompts, essays, pairs).first()["essay_score"] == 0.5
