"""Work that must not grow faster than the tables: rounds, chains, passes over texts."""

import pytest
from pyspark.sql import functions as F

from oppweave.operators import hubs as h

LEAD = "run_id string, hub_ord int, hub string, lead_ord int, url string"


def _chain(spark, n, run="r"):
    """Hub k wants what hub k - 1 wants too, so in waves each waits for the one before."""
    return spark.createDataFrame([(run, k, f"h{k}", i, f"u{k + i}") for k in range(n) for i in range(2)], LEAD)


def _settled(leads, cap=1):
    none = leads.select("run_id", "hub", "url").limit(0)
    added, spare = h.stage_leads(leads, none.select("run_id", "url"), none.select("run_id", "url"), none, cap)
    return sorted((r["run_id"], r["hub_ord"], r["url"]) for r in added.collect()), sorted((r["run_id"], r["hub_ord"], r["url"]) for r in spare.collect())


def test_a_chain_of_hubs_costs_no_rounds(spark, monkeypatch):
    writes = []
    real = h.cut
    monkeypatch.setattr(h, "cut", lambda df: writes.append(1) or real(df))
    added, spare = _settled(_chain(spark, 30))
    assert len(writes) == 3
    assert added == sorted(("r", k, f"u{k}") for k in range(30))
    assert spare == sorted(("r", k, f"u{k + 1}") for k in range(30))


def test_long_runs_and_null_keys_agree_with_short_runs(spark, monkeypatch):
    leads = _chain(spark, 6).unionByName(_chain(spark, 2, "s")).unionByName(_chain(spark, 3, "t"))
    short = _settled(leads)
    monkeypatch.setattr(h, "RUN_LEADS", 5)
    assert _settled(leads) == short
    odd = spark.createDataFrame([(None, 1, "h", 1, "u"), (None, 2, "g", 1, "u")], LEAD)
    before = h.DataFrame.unionByName(*[x.select("hub_ord") for x in h._waves(odd, 1)]).count()
    none = odd.select("run_id", "hub", "url").limit(0)
    added, spare = h.stage_leads(leads.unionByName(odd), none.select("run_id", "url"), none.select("run_id", "url"), none, 1)
    assert added.filter("run_id IS NULL").count() + spare.filter("run_id IS NULL").count() == before


def test_shards_move_no_second_copy_of_the_keys(spark):
    from oppweave.llm import sharding

    docs = spark.createDataFrame([(k, f"text {k}") for k in range(200)], "doc_id long, text string")
    out = sharding.shuffle_into_shards(docs, 3, ["doc_id", "text"])
    assert "text AS _w" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r["doc_id"] for r in out.collect()) == list(range(200))


def test_claims_read_a_text_only_for_patterns_whose_words_it_has(spark):
    from oppweave.operators import texts as t

    rows = [(1, "d", 1, "STATE\tTexas\nHISPANIC / LATINO\tyes\nGPA 3.5\nCLASS OF 2027\nCity\tAustin"), (2, "e", 1, None), (3, "f", 1, "Surname\nLee\nFirst name: Ann")]
    out = t.extract_claims(spark.createDataFrame(rows, "profile_id int, document_id string, doc_ord int, raw_text string"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Contains(low") >= 9
    got = {(r["profile_id"], r["field_path"]): r["value"] for r in out.collect()}
    assert got == {
        (1, "personalInfo.state"): "Texas", (1, "personalInfo.city"): "Austin", (1, "personalInfo.address"): "Austin, Texas",
        (1, "personalInfo.ethnicity"): "hispanic/latino", (1, "academics.gpa"): "3.5", (1, "academics.graduationYear"): "2027",
        (3, "personalInfo.fullName"): "Ann Lee",
    }


def test_a_walk_makes_links_only_of_the_pages_it_fetches(spark, monkeypatch):
    from oppweave.operators import expansion as e

    raw = spark.createDataFrame(
        [("a", "b", "x", 1), ("a", "b", "x", 0), ("a", "c", "x", 2), ("b", "d", "y", 3), ("far", "z", "x", 4)],
        "src_url string, url string, source_domain string, position long",
    )
    pages = spark.createDataFrame([("a", "list"), ("b", "list"), ("c", "offer"), ("d", "list"), ("far", "list")], "url string, kind string")
    seeds = spark.createDataFrame([(1, "a", 1), (2, "a", 1), (2, "c", 2), (2, None, 3)], "run_id int, url string, ord int")

    def walk(position):
        links = raw.groupBy("src_url", "url", "source_domain").agg(F.min(position).alias("position"))
        return sorted(map(tuple, e.expand_lists(seeds, pages, links).select("run_id", F.coalesce("url", F.lit("")), "depth", "outcome").collect()))

    got = walk(F.when(F.col("src_url") == "far", F.raise_error(F.lit("not reached")).cast("long")).otherwise(F.col("position")))
    assert [r[1] for r in got if r[0] == 1] == ["a", "b", "c", "d"]
    monkeypatch.setattr(e, "NEAR", 0)
    assert walk(F.col("position")) == got


def test_draft_report_moves_flags_and_deals_rows_to_tasks_of_bounded_size(spark, tmp_path, monkeypatch):
    from oppweave import session
    from oppweave.operators import matching as m
    from oppweave.workloads import matching as w

    offers = spark.createDataFrame(
        [(1, "o", [("Passport number", "text", "p"), ("cv", "FILE", "p"), ("name", None, "p"), (None, "text", "q"), ("age", "text", None)])],
        "profile_id int, id string, form_fields array<struct<field_name string, field_type string, source_path string>>",
    )
    values = spark.createDataFrame([(1, "p", "Ann"), (1, "q", "123-45-6789"), (2, "p", "")], "profile_id int, source_path string, value string")
    fields = m.draft_fields(offers, values)
    assert {r["position"]: (r["mode"], r["masked_preview"], r["filled_value"]) for r in fields.collect()} == {
        0: ("manual", "***Ann", None), 1: ("manual", None, None), 2: ("autofill", None, "Ann"),
        3: ("manual", "***6789", None), 4: ("manual", None, None),
    }
    report = m.draft_report(fields)
    assert [tuple(r) for r in report.collect()] == [(1, "o", 1, 4)]
    above = report._jdf.queryExecution().executedPlan().toString().split("Join")[0]
    assert "RLIKE" not in above and "field_type" not in above

    spark.range(40).selectExpr("id % 12 l_orderkey", "id l_partkey", "int(id % 7) l_linenumber", "'N' l_returnflag").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(12).selectExpr("id o_orderkey", "'O' o_orderstatus", "'high' o_orderpriority").write.parquet(f"{tmp_path}/orders.parquet")
    whole = sorted(map(tuple, w.draft_report(spark, str(tmp_path)).collect()))
    monkeypatch.setattr(session, "KEYED_ROWS", 8)
    dealt = w.draft_report(spark, str(tmp_path))
    assert "5), REPARTITION_BY_NUM" in dealt._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, dealt.collect())) == whole and len(whole) == 40
