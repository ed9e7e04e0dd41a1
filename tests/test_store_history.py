from datetime import datetime

import pytest
from pyspark.sql import functions as F

from oppweave.operators import decisions as d
from oppweave.operators import history as h
from oppweave.operators import hubs as hb
from oppweave.operators import queries as q
from oppweave.operators import store as s
from oppweave.operators import texts as t
from oppweave.sources import readers as rd
from oppweave.sources import writers as wr
from oppweave.streaming import jobs as st

HIST = st.HISTORY_SCHEMA


def rec(url, kind, fetched, **kw):
    base = dict.fromkeys(h.HISTORY_COLUMNS)
    base.update(normalized_url=url, url=url, source_domain="a.org", page_type=kind, last_seen_at=fetched, last_fetched_at=fetched, **kw)
    return tuple(base[c] for c in h.HISTORY_COLUMNS)


@pytest.mark.parametrize("kind,hours", [("direct_scholarship", 24), ("scholarship_list_page", 12), ("not_scholarship_page", 72), ("fetch_error", 6), ("odd", 24)])
def test_ttl_edges(spark, kind, hours):
    now = "2026-01-10 00:00:00"
    at = datetime(2026, 1, 10).timestamp() - hours * 3600
    rows = [rec("in", kind, datetime.fromtimestamp(at + 1)), rec("out", kind, datetime.fromtimestamp(at)), rec("never", kind, None)]
    hist = spark.createDataFrame(rows, HIST)
    probe = spark.createDataFrame([("in",), ("out",), ("never",), ("new",)], "normalized_url string")
    got = {x.normalized_url: x.skip for x in h.history_lookup(probe, hist, now).collect()}
    assert got == {"in": True, "out": False, "never": False, "new": False}


def test_upsert_keeps_values_on_blanks(spark):
    t0, t1 = datetime(2026, 1, 1), datetime(2026, 1, 2)
    hist = spark.createDataFrame([rec("u", "direct_scholarship", t0, last_error="e")], HIST)
    ups = spark.createDataFrame(
        [(*rec("u", "", None, last_error=""), 1), (*rec("u", "scholarship_list_page", t1), 2), (*rec("n", "", None), 3)], HIST + ", ord bigint"
    )
    got = {x.normalized_url: x for x in h.upsert_history(hist, ups).collect()}
    assert got["u"].page_type == "scholarship_list_page" and got["u"].last_error == "e" and got["u"].last_fetched_at == t1
    assert got["n"].page_type == "unknown" and got["n"].last_fetched_at is None
    again = h.upsert_history(h.upsert_history(hist, ups), ups)
    assert sorted(map(str, again.collect())) == sorted(map(str, got.values()))


def test_stream_equals_batch_with_restart(spark, tmp_path):
    rows = [(*rec(f"u{i % 3}", ["", "fetch_error", "direct_scholarship"][i % 3 if i < 4 else 0], datetime(2026, 1, 1, i), last_error=f"e{i}" if i % 2 else ""), i) for i in range(6)]
    ddl = HIST + ", ord bigint"
    src, table, ck, skip = (str(tmp_path / x) for x in ("in", "table", "ck", "skip"))
    for part in (rows[:3], rows[3:]):
        spark.createDataFrame(part, ddl).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(ddl).parquet(src)
        st.stream_history(stream, table, ck, skip).awaitTermination()
    got = st.read_history(spark, table, 1)
    want = h.upsert_history(spark.createDataFrame([], HIST), spark.createDataFrame(rows, ddl))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    # u1 failed at 1h and comes again at 4h, within the six hours of an error.
    assert {x.normalized_url for x in spark.read.parquet(f"{skip}/v=1").collect()} >= {"u1"}


def test_flags_and_table_do_not_depend_on_the_cut(spark, tmp_path):
    import random

    rng = random.Random(8)
    kinds = ["", "direct_scholarship", "scholarship_list_page", "fetch_error"]
    rows = [
        (*rec(f"u{rng.randint(0, 4)}", rng.choice(kinds), datetime(2026, 1, 1 + i // 20, i % 20), last_error=f"e{i}" if i % 3 else ""), i) for i in range(40)
    ]
    rows = [(*r[:5], None if i % 5 == 0 else r[5], *r[6:]) for i, r in enumerate(rows)]  # some are seen and not fetched
    ddl = HIST + ", ord bigint"
    whole = spark.createDataFrame(rows, ddl)
    none = spark.createDataFrame([], HIST)
    flags = {r["ord"] for r in h.recent_fetches(none, whole).filter("skip").collect()}
    table_rows = sorted(map(str, h.upsert_history(none, whole).collect()))
    assert 0 < len(flags) < 40
    for name, cuts in (("a", [40]), ("b", [1, 17, 19, 40])):
        src, table, ck, skip = (str(tmp_path / name / x) for x in ("in", "table", "ck", "skip"))
        for start, end in zip([0, *cuts], cuts):
            spark.createDataFrame(rows[start:end], ddl).coalesce(1).write.mode("append").parquet(src)
            st.stream_history(spark.readStream.schema(ddl).parquet(src), table, ck, skip, buckets=4).awaitTermination()
        last = len(cuts) - 1
        assert {r["ord"] for r in spark.read.parquet(skip).collect()} == flags
        assert sorted(map(str, st.read_history(spark, table, last).collect())) == table_rows
    # A batch rewrites the buckets of its URLs only.
    touched = {r["b"] for r in spark.createDataFrame(rows[17:19], ddl).select(st._bucket(4).alias("b")).collect()}
    assert {r["b"] for r in spark.read.parquet(f"{table}/v=2").select("b").collect()} == touched


def test_log_stream_equals_batch(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("log", "out", "ck"))
    import json
    import os

    os.makedirs(src)
    lines = [json.dumps({"runId": f"r{i}", "timestamp": f"2026-01-01T{i:02d}:10:00Z", "mode": "m", "status": "error" if i == 2 else "ok", "reason": "x", "counts": {"importedCount": i}}) for i in range(8)]
    with open(f"{src}/a.json", "w") as f:
        f.write("\n".join([*lines, "{broken"]))
    st.stream_run_log(st.read_log_stream(spark, src), out, ck).awaitTermination()
    # A later file moves the watermark and lets the earlier hours out.
    with open(f"{src}/b.json", "w") as f:
        f.write(json.dumps({"runId": "z", "timestamp": "2026-01-03T00:00:00Z", "mode": "m", "status": "ok", "reason": "x"}))
    st.stream_run_log(st.read_log_stream(spark, src), out, ck).awaitTermination()
    got = {(str(x.hour), x.n_runs, x.n_errors, x.n_imported) for x in spark.read.parquet(out).collect()}
    batch = st.hourly_runs(rd.parse_run_log(spark.read.schema(rd.RUN_LOG).option("mode", "DROPMALFORMED").json(f"{src}/a.json")).filter("ts is not null"))
    assert got == {(str(x.hour), x.n_runs, x.n_errors, x.n_imported) for x in batch.collect()}
    assert [x.run_id for x in rd.read_run_log(spark, src, 2).collect()] == ["z", "r7"]


def test_revisits_and_gate(spark):
    rows = [("r", f"u{i}", i, "scholarship_list_page" if i % 2 else "direct_scholarship", float(i), True, 12.0 if i == 1 else 1.0) for i in range(9)]
    df = spark.createDataFrame(rows, "run_id string, normalized_url string, rank int, page_type string, age_hours double, skip boolean, fit_score double")
    assert {x.normalized_url for x in h.history_gate(df, "rerun").filter("decision = 'bypass'").collect()} == set()
    assert {x.normalized_url for x in h.history_gate(df, "fresh").filter("decision = 'bypass'").collect()} == {"u1"}
    got = h.select_revisits(h.history_gate(df)).orderBy("revisit_rank").collect()
    assert [x.normalized_url for x in got] == ["u7", "u5", "u3", "u1", "u8", "u6"]


def test_reviews(spark):
    cand = spark.createDataFrame(
        [("a", "pending", "", "", None, "Tier 2"), ("b", "rejected", "", "", None, "Tier 1"), ("c", "pending", "n0", "", None, "Tier 1")],
        "id string, status string, review_notes string, reviewed_by string, reviewed_at timestamp, recommended_tier string",
    )
    rv = spark.createDataFrame(
        [
            (1, "a", "approve", "x", "fine", "Tier 3"), (2, "b", "submit", "x", "", ""), (3, "zz", "approve", "x", "", ""),
            (4, "c", "maybe", "x", "", ""), (5, "c", "reject", "x", "bad", ""), (6, "c", "submit", "x", "", ""), (7, "a", "submit", "", "", ""),
        ],
        "ord int, id string, decision string, reviewer string, notes string, tier_override string",
    ).withColumn("reviewed_at", F.lit("2026-01-01").cast("timestamp"))
    done, refused = s.review_updates(cand, rv)
    got = {x.id: (x.status, x.review_notes, x.recommended_tier) for x in done.collect()}
    assert got["a"] == ("submitted", "fine", "Tier 3") and got["b"][0] == "rejected" and got["c"] == ("rejected", "bad", "Tier 1")
    assert {x.ord for x in refused.collect()} == {2, 3, 4, 6}


def test_risk_and_normal_form(spark):
    ddl = "ord int, id string, name string, source_domain string, source_url string, source_name string, deadline string, has_eligibility boolean"
    rows = [(1, "n1", "N", "free-money.xyz", "http://free-money.xyz", "", "", False), (2, "k", "N", "ok.org", "https://ok.org", "s", "2026", True), (3, "x", "N", "", "", "s", "2026", True)]
    cat = spark.createDataFrame([("k", 1, "c.org"), ("z", 2, "ok.org")], "id string, ord int, source_domain string")
    got = {x.ord: (x.risk_score, x.recommended_tier, x.risk_flags) for x in s.candidate_risk(spark.createDataFrame(rows, ddl), cat, "ord").collect()}
    assert got[1][0] == 100 and got[1][2][:3] == ["non_https_source_url", "high_risk_tld:.xyz", "suspicious_keyword:free-money"]
    assert got[2] == (20, "Tier 1", ["already_exists_in_catalog:k"]) and got[3] == (35, "Tier 2", ["missing_source_domain"])
    raw = spark.createDataFrame(
        [("", "Big  Fund!", "a.org", "", None, None, None, None, "YES"), ("i", "", "a.org", "", None, None, None, None, "")],
        "id string, name string, source_domain string, source_url string, source_name string, award_amount double, deadline string, effort_minutes int, requires_account string",
    )
    good, bad = s.normalize_candidates(raw)
    x = good.first()
    assert x.id.startswith("big-fund-") and x.effort_minutes == 30 and x.requires_account and bad.count() == 1


def test_progress_edges(spark):
    cols = "run_id string, accepted int, strong int, target int, advanced int, held int, unfetched int, hubs_ready int, children_ready int, school_pressure double, broad_pressure double, pages_left int, depth_left int, queries_left int, replans_left int, search_rounds_left int"
    rows = [
        ("done", 5, 1, 5, 0, 0, 0, 0, 0, 0.0, 0.0, 1, 1, 1, 1, 1), ("spent", 0, 0, 5, 0, 0, 9, 0, 0, 0.0, 0.0, 0, 0, 0, 9, 9),
        ("children", 0, 0, 5, 0, 0, 0, 0, 1, 0.0, 0.0, 1, 1, 0, 0, 0), ("hubs", 0, 0, 5, 0, 1, 0, 1, 0, 0.75, 0.0, 1, 1, 0, 0, 0),
        ("frontier", 0, 0, 5, 0, 1, 1, 1, 0, 0.76, 0.76, 1, 1, 0, 0, 0), ("replan", 0, 0, 5, 0, 0, 1, 0, 0, 0.65, 0.39, 1, 1, 1, 1, 1),
        ("rest", 5, 0, 5, 0, 0, 1, 0, 0, 0.65, 0.1, 1, 1, 1, 1, 1), ("weak", 5, 0, 5, 0, 0, 0, 0, 0, 0.0, 0.0, 1, 1, 1, 1, 1),
    ]
    got = {x.run_id: x for x in hb.assess_progress(spark.createDataFrame(rows, cols)).collect()}
    assert {k: x.rule for k, x in got.items()} == {k: k for k in got}
    assert got["replan"].suggestions == [*hb.HINTS]


def test_decisions(spark):
    rules = spark.createDataFrame(
        [(run, i, f"u{i}", "drop", "rule", i == "2") for run in "abcd" for i in "12"],
        "run_id string, item_id string, url string, action string, rationale string, mirror boolean",
    )
    adv = "advance_to_finalize"
    model = spark.createDataFrame(
        [("a", "1", adv, "x"), ("a", "2", adv, "x"), ("b", "1", adv, "x"), ("c", "1", adv, "x"), ("c", "2", "drop", " "), ("d", "1", adv, "x"), ("d", "1", adv, "x"), ("d", "2", adv, "x")],
        "run_id string, item_id string, action string, rationale string",
    )
    got = {(x.run_id, x.item_id): (x.action, x["mode"]) for x in d.validate_triage(model, rules).collect()}
    assert got[("a", "1")] == (adv, "model") and got[("a", "2")] == ("drop", "guardrail")
    assert all(got[(r, "1")] == ("drop", "fallback") for r in "bcd")
    kids = spark.createDataFrame([(h, c, f"{h}{c}", s_) for h in "xyz" for c, s_ in (("1", False), ("2", h == "z"))], "hub string, child_id string, url string, is_source boolean")
    ruled = spark.createDataFrame([(h, f"{h}2", "rule", 1) for h in "xyz"], "hub string, url string, reason string, pick int")
    said = spark.createDataFrame(
        [("x", "1", 1, "good", True, "why"), ("y", "9", 1, "good", True, "why"), ("z", "1", 1, "good", True, "why")],
        "hub string, child_id string, ord int, reason string, expand boolean, rationale string",
    )
    out = {x.hub: (x.url, x["mode"]) for x in d.validate_children(said, kids, ruled, ["hub"]).collect()}
    assert out == {"x": ("x1", "model"), "y": ("y2", "fallback"), "z": ("z2", "guardrail")}


@pytest.mark.parametrize("total,aggressive,want", [(1, False, (1, 0, 0)), (2, False, (1, 1, 0)), (4, False, (2, 1, 1)), (6, False, (3, 2, 1)), (12, False, (6, 4, 2)), (12, True, (5, 4, 3))])
def test_query_budget(total, aggressive, want):
    assert q.query_budget(total, aggressive) == want


def test_query_planning(spark):
    p = spark.createDataFrame([("p", "B.S. Physics", "Latino", "CA", "", "starting_college")], "profile_id string, intended_major string, ethnicity string, state string, grade_level string, student_stage string")
    rows = [x.query for x in q.plan_queries(p, 12, avoid=["x.org"]).orderBy("query_ord").collect()]
    assert rows[0] == "Physics scholarship incoming college freshman" and len(rows) == 12
    assert rows[-2:] == [rows[0] + " -site:x.org", rows[0] + " -graduate -fellowship -phd -masters"]
    hinted = [x.query for x in q.plan_queries(p, 40, domains=["fund.org"]).collect()]
    assert any(x.startswith("site:fund.org ") for x in hinted)
    direct = [x.query for x in q.plan_queries(p, 12, "singular_synonym_mix").orderBy("query_ord").collect()]
    assert direct[5] == "California engineering scholarship incoming freshman"


@pytest.mark.parametrize(
    "text,want",
    [
        ("between 300 and 200 words", (200, 300, 250)), ("100-150 words", (100, 150, 125)), ("minimum 500 words", (500, None, 540)),
        ("max: 250 words", (None, 250, 220)), ("anything", (None, None, 320)),
    ],
)
def test_word_limits(one, text, want):
    assert tuple(one(t.word_limits(F.lit(text)))) == want


def test_sources(spark, tmp_path):
    import json

    (tmp_path / "c.json").write_text(json.dumps([{"id": "a", "name": "A", "riskFlags": [" x ", "", "x"], "sourceUrl": "", "eligibility": {"minGpa": None, "allowedMajors": ["m"]}}]))
    x = rd.read_catalog_json(spark, str(tmp_path / "c.json")).first()
    assert x.risk_flags == ["x"] and x.source_url is None and x.allowed_majors == ["m"] and x.effort_minutes == 30 and x.status == "pending"
    (tmp_path / "c.csv").write_text(
        ",".join(rd.CATALOG_CSV) + '\na,"Big, ""Blue""",a.org,Tier 9,YES,,2026-01-01,,,m| n |,,,s,2026-01-02\n'
    )
    x = rd.read_catalog_csv(spark, str(tmp_path / "c.csv")).first()
    assert x.name == 'Big, "Blue"' and x.recommended_tier == "Tier 1" and x.requires_account and x.allowed_majors == ["m", "n"]
    assert x.award_amount == 0.0 and x.min_gpa is None and x.status == "approved"
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "my_scholarship_form.txt").write_text(" Name: Z \n")
    x = rd.read_documents(spark, str(tmp_path / "docs")).first()
    assert x.document_type == "scholarship_application" and x.raw_text.startswith("Name: Z")
    pay = spark.createDataFrame([("q", json.dumps({"web": {"results": [{"title": "t", "url": "ftp://x"}, {"title": " ", "url": "https://y"}, {"title": "T", "url": "https://z", "page_age": "old"}]}})), ("bad", "{")], "query string, payload string")
    assert [(x.query, x.provider_rank, x.url, x.snippet) for x in rd.explode_search_payload(pay).collect()] == [("q", 1, "https://z", "old")]
    trace = spark.createDataFrame([("r", 1, "x")], "run_id string, round int, kind string")
    wr.write_run_trace(trace, str(tmp_path / "trace"))
    assert spark.read.parquet(str(tmp_path / "trace")).count() == 1
    wr.write_candidates(trace, str(tmp_path / "cand"))
    assert spark.read.parquet(str(tmp_path / "cand")).count() == 1


def test_application_text(spark):
    text = "\n".join(
        [
            "First name\tAna", "Last name: Lee", "Choose majors", "UC Davis", "Physics, B.S.", "City\tRome", "State\t", "CA", "GPA: 3.9", "Class of 2027",
            "Activities/Awards", "1. Volunteer work", "Program name", "Helpers", "2. Award or honor", "Name of the award or honor", "Medal",
            "Personal insight questions", "Every person has a creative side, and it", "shows in many ways?", "I paint. " + "word " * 30,
        ]
    )
    docs = spark.createDataFrame([("p", "d", 1, text)], "profile_id string, document_id string, doc_ord int, raw_text string")
    got = {x.field_path: x.value for x in t.extract_claims(docs).collect()}
    assert got["personalInfo.fullName"] == "Ana Lee" and got["personalInfo.intendedMajor"] == "Physics"
    assert got["personalInfo.city"] == "Rome" and got["academics.gpa"] == "3.9" and got["academics.graduationYear"] == "2027"
    items = {(x.list_kind, x.item) for x in t.entry_summaries(t.segment_entries(docs)).collect()}
    assert items == {("activity", "Helpers"), ("award", "Medal")}
    e = t.segment_essays(docs).first()
    assert e.prompt == "Every person has a creative side, and it shows in many ways?" and e.content.startswith("I paint.")
