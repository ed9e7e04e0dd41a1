"""What jobs leave on disk: spent shuffles, rows that move once, links that no quota can reach."""

import random

import pytest
from pyspark.sql import functions as F

from oppweave.functions import ranks
from oppweave.operators import batch as b
from oppweave.operators import expansion as e
from oppweave.operators import hits as o
from oppweave.operators import matching as m
from oppweave.operators import store as s
from oppweave.session import SPENT, cut


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _moves(df):
    return sum("Exchange hashpartitioning" in line for line in _plan(df).splitlines())


def test_a_cut_leaves_no_shuffle_files(spark):
    def files():
        got = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {got.apply(i).getName() for i in range(got.size())}

    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    assert df.count() == 7
    before, was = files(), spark.conf.get(SPENT, None)
    out = cut(df)
    assert not {f for f in files() - before if f.startswith("shuffle_")}
    assert spark.conf.get(SPENT, None) == was
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, df.collect()))


def _ranked(spark):
    rnd = random.Random(9)
    rows = [(rnd.choice([1, 2, None]), rnd.choice(["a.org", "b.org", None]), float(rnd.randrange(5)), k) for k in range(300)]
    return spark.createDataFrame(rows, "run_id int, source_domain string, score double, ord int")


def test_rows_of_keys_that_a_task_holds_are_ranked_and_compared_without_joins(spark, monkeypatch):
    df = _ranked(spark)

    def flagged():
        got = ranks.full_rank(df, ["run_id"], [F.col("score").desc(), F.col("ord")], "rank")
        out = o.same_domain_flag(got)
        return _plan(out).count("Join"), sorted(map(str, out.select(*sorted(out.columns)).collect()))

    joins, near = flagged()
    assert joins == 0
    monkeypatch.setattr(ranks, "HELD", 10)
    monkeypatch.setattr(o, "HELD", 10)
    assert flagged()[1] == near


def test_flags_of_domains_write_only_what_they_need(spark, tmp_path, monkeypatch):
    from oppweave.workloads import hits as w

    spark.range(60).selectExpr(
        "id * 10 l_orderkey", "int(id % 7) l_linenumber", "id % 9 l_partkey", "id % 4 l_suppkey", "'A' l_returnflag", "'O' l_linestatus",
        "double(id % 5) l_quantity", "0.05d l_discount", "0.03d l_tax",
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    written = []
    monkeypatch.setattr(ranks, "cut", lambda df: written.append(set(df.columns)) or df.localCheckpoint())
    assert w.same_domain_flag(spark, str(tmp_path)).count() == 60
    assert all(not {"surface_type", "stage_match", "stale_cycle"} & c for c in written) and written


@pytest.mark.parametrize("seed", [1, 2])
def test_walks_over_many_pages_of_one_url_move_only_links_in_reach(spark, seed):
    rng = random.Random(seed)
    hosts = [f"https://h{k}.org" for k in range(3)]
    links = [(f"{h}/list", f"{rng.choice(hosts)}/{rng.randrange(160)}", k % 40) for h in hosts for k in range(300)]
    rows = spark.createDataFrame(links, "src_url string, url string, position int").withColumn("source_domain", F.regexp_extract("url", "//([^/]+)", 1))
    lists = spark.createDataFrame([(r, f"{h}/list", k, float(k), "q") for r in range(25) for k, h in enumerate(hosts)], "run_id int, src_url string, parent_ord long, parent_rank double, query string")
    seen = spark.createDataFrame([(r, u) for r in range(24) for u in {x[1] for x in rng.sample(links, 20 * (r % 3))}], "run_id int, url string")
    some, all_ = e.children(lists, rows, seen), lists.join(rows, "src_url")
    keep = ["run_id", "url", "source_domain", "parent_ord", "position", "child_rank"]

    def kept(x):
        return sorted(map(tuple, e.expand_quota(x, seen, 1).select(*keep).collect()))

    assert kept(some) == kept(all_)
    assert some.count() < all_.count() / 2
    near = some.groupBy("run_id", "src_url", "source_domain").count()
    assert near.filter("run_id = 24").agg(F.max("count")).first()[0] <= 4  # has seen nothing


def test_a_hosted_walk_equals_one_over_all_links(spark, monkeypatch):
    rng, calls, real = random.Random(3), [], e.children
    monkeypatch.setattr(e, "children", lambda *a: calls.append(1) or real(*a))
    urls = [f"https://h{k % 4}.org/{k}" for k in range(80)]
    pages = spark.createDataFrame([(u, rng.choice(["list", "list", "offer"])) for u in urls], "url string, kind string")
    rows = [(u, rng.choice(urls), k) for u in urls for k in range(30)]
    links = spark.createDataFrame(rows, "src_url string, url string, position int").withColumn("source_domain", F.regexp_extract("url", "//([^/]+)", 1))
    front = spark.createDataFrame([(r, u, int(k), float(k), None, "q") for r in range(8) for k, u in enumerate(rng.sample(urls, 5))], "run_id int, url string, ord long, rank double, fit_score double, query string")

    def walked(hosted):
        return sorted(map(str, e.walk_lists(front, lambda _: (pages, links), hosted=hosted).select("run_id", "url", "parent_url", "depth", "ord", "outcome").collect()))

    assert walked(True) == walked(False) and len(calls) == 2


def test_levels_double(spark):
    got = [r[0] for r in spark.range(1, 40).orderBy("id").select(e.level(F.col("id"), 4)).collect()]
    assert got[:16] == [0] * 4 + [1] * 4 + [2] * 8 and got[16] == 3 and got == sorted(got)


def _first_wins(rows):
    kept, blocked = set(), set()
    for k, *keys in sorted(rows):
        if not blocked & set(keys):
            kept.add(k)
            blocked |= set(keys)
    return kept


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("kind", ["int", "string"])
def test_first_wins_looks_up_only_keys_of_more_than_two_rows(spark, monkeypatch, seed, kind):
    rng = random.Random(seed)
    rows = [(k, f"u{rng.randrange(60)}", f"n{rng.randrange(150)}") for k in range(200)]
    df = spark.createDataFrame([(*r, "d") for r in rows], "id int, source_url string, name string, source_domain string")
    df = df.withColumn("id", F.format_string("%03d", "id") if kind == "string" else F.col("id"))
    tables, real = [], s.cut
    monkeypatch.setattr(s, "cut", lambda x: tables.append(real(x)) or tables[-1])
    got = {int(r["id"]) for r in s.first_wins(df, "id", "id").collect()}
    assert got == _first_wins(rows)
    looked = {r["key"] for r in tables[0].filter("key is not null").collect()}
    sizes = [sum(f"url:{r[1]}" == key or f"name_domain:{r[2]}::d" == key for r in rows) for key in looked]
    assert looked and min(sizes) > 2


def test_suggestions_are_read_once_and_judged_as_in_a_loop(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.randrange(4), k, rng.choice(["https://C.org/", "https://u.org/"]) + str(rng.randrange(30)), rng.choice(["", "n", "m"]) + str(rng.randrange(25)), "d") for k in range(120)]
    ddl = "user_id int, ord int, source_url string, name string, source_domain string"
    spark.createDataFrame(rows, ddl).write.parquet(f"{tmp_path}/suggested")
    catalog = [(k, f"https://c.org/{k}", f"m{k}", "d") for k in range(12)]
    queue = [(rng.randrange(4), rng.randrange(12), f"https://u.org/{rng.randrange(30)}", f"q{k}", "d") for k in range(12)]
    out = s.judge_suggestions(
        spark.read.parquet(f"{tmp_path}/suggested"),
        spark.createDataFrame(catalog, "id int, source_url string, name string, source_domain string"),
        spark.createDataFrame(queue, "user_id int, id int, source_url string, name string, source_domain string"),
    )
    urls = {c[1]: c[0] for c in catalog}
    known = {c[1] for c in catalog} | {(c[2], "d") for c in catalog}
    taken = {u: known | {x for q in queue if q[0] == u for x in (q[2], (q[3], "d"))} for u in range(4)}
    want = []
    for user, ord_, url, name, dom in rows:
        url = url.lower()
        if url in urls:
            want.append((user, ord_, "already_in_catalog", str(urls[url]), any(q[:2] == (user, urls[url]) for q in queue)))
            continue
        dup = bool({url, (name, dom)} & taken[user])
        want.append((user, ord_, "already_in_queue" if dup else "imported", None, False))
        if not dup:
            taken[user] |= {url, (name, dom)}
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))
    assert "suggested" not in _plan(out)


def _hits(spark):
    rng = random.Random(11)
    rows = [
        (rng.choice(["a", "b", None]), f"https://x.org/{rng.randrange(120)}", f"D{rng.randrange(9)}.org", rng.choice([None, *range(500)]), rng.randrange(9), float(rng.randrange(40)), float(rng.randrange(9)), "direct_likely", f"Item {k}", "", rng.random() < 0.7)
        for k in range(500)
    ]
    df = spark.createDataFrame(rows, "run_id string, normalized_url string, source_domain string, ord int, provider_rank int, fit_score double, novelty_score double, surface_type string, title string, snippet string, stage_match boolean")
    return df.dropDuplicates(["run_id", "normalized_url", "ord"]).withColumn("url", F.col("normalized_url"))


def test_replays_move_hits_once_by_run(spark, monkeypatch):
    hits, plans, real = cut(_hits(spark)), [], b.cut
    monkeypatch.setattr(b, "cut", lambda df: plans.append(_moves(df)) or real(df))

    def replayed():
        out = b.replay_variants(hits, rounds=2, limit=4)
        return sorted(map(str, out.select(*sorted(out.columns)).collect()))

    once = replayed()
    assert plans[0] == 1 and once
    monkeypatch.setattr(b, "HELD", 10)
    assert replayed() == once


def test_a_pair_is_one_row_however_many_tokens_its_prompt_has(spark):
    pairs = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 3), (3, 1), (2, 1), (None, 1)], "profile_id long, id long")
    prompts = spark.createDataFrame([(1, "one two three"), (1, "four"), (2, "two"), (3, "--")], "id long, prompt string")
    essays = spark.createDataFrame([(1, "Two! one"), (1, "four"), (2, "none")], "profile_id long, content string")
    out = m.essay_containment(prompts, essays, pairs)
    joins = [line for line in _plan(out).splitlines() if "Join" in line]
    assert len(joins) == 2 and not any("token" in line for line in joins)
    got = {(r["profile_id"], r["id"]): r["essay_score"] for r in out.collect()}
    assert got == {(1, 1): 0.75, (1, 2): 1.0, (2, 1): 0.0, (2, 3): 0.0, (3, 1): 0.0, (None, 1): 0.0} and out.count() == 6


def test_pairs_bring_their_essay_score_and_come_back_as_often_as_they_are_queued(spark):
    from oppweave.plans.match_profiles import match_profiles

    docs = spark.createDataFrame([(1, "d", 1, "State: Texas\nGPA: 3.5")], "profile_id long, document_id string, doc_ord int, raw_text string")
    rows = [(k, k, f"offer {k}", 10.0 * k, None, 30, None, [], [], ["Why you"]) for k in (1, 2)]
    catalog = spark.createDataFrame(rows, "id long, ord long, name string, award_amount double, deadline string, effort_minutes int, min_gpa double, allowed_majors array<string>, allowed_ethnicities array<string>, essay_prompts array<string>")
    catalog = catalog.withColumn("requires_account", F.lit(False))
    pairs = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (1, 2)], "profile_id long, id long")
    out = match_profiles(docs, catalog, pairs, None, 9)["ranked"]
    assert sorted((r["id"], r["essay_score"]) for r in out.collect()) == [(1, 0.0), (2, 0.0), (2, 0.0), (2, 0.0)]
    plan = _plan(match_profiles(docs, catalog, pairs.distinct(), None, 9)["ranked"])
    keys = [line for line in plan.splitlines() if "SortMergeJoin" in line]
    assert keys and not any("profile_id" in line and " id#" in line for line in keys)
