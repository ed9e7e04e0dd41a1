"""The discovery plan: pages parsed on demand, searches widened per run, history rows after a walk."""

import json

import pytest
from pyspark.sql import functions as F

from oppweave.operators import expansion as e
from oppweave.plans import discover as d

AS_OF = "2026-01-15 00:00:00"
PAGE = "page_id LONG, url STRING, html STRING, http_status INT, content_type STRING"


def html(title, body):
    return f"<html><head><title>{title}</title></head><body><h1>{title}</h1><p>{body}</p></body></html>"


@pytest.fixture(scope="module")
def pages(spark):
    offer = "Award of $2,000. Applicants must be enrolled in college. Deadline: May 1, 2026. Apply with the application form."
    rows = [
        (k, f"https://a{k % 3}.example.org/scholarships/one-{k % 9}/", html(f"Grand Scholarship {k % 9}", offer), 200, "text/html") for k in range(12)
    ]
    return spark.createDataFrame(rows + [(99, "https://x.example.org/", None, 200, "text/html")], PAGE)


def test_pages_are_parsed_on_demand(spark, pages):
    reader = d.PageReader(pages, AS_OF, 12)
    urls = [r["url"] for r in reader.index.select("url").distinct().orderBy("url").collect()]
    first = spark.createDataFrame([(1, urls[0]), (2, urls[0]), (1, "https://none.example.org/")], "run_id INT, url STRING")
    plan = reader.reached(first)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan
    kinds, _ = reader(first)
    assert [r["url"] for r in kinds.collect()] == [urls[0]] and reader.found.select("page_id").distinct().count() == reader.found.count()
    some = spark.createDataFrame([(1, u) for u in urls], "run_id INT, url STRING")
    later, _ = reader(some)  # pages read before are not parsed again
    whole, _ = d.PageReader(pages, AS_OF, 12)(some)
    assert sorted(map(tuple, later.collect())) == sorted(map(tuple, whole.collect()))
    assert reader.found.count() == 13
    by_id = {r["url"]: r["page_id"] for r in reader.newest().collect()}
    assert by_id[urls[0]] == max(r["page_id"] for r in reader.index.collect() if r["url"] == urls[0])


def hits(spark, rows):
    return spark.createDataFrame(rows, "run_id INT, profile_id STRING, ord LONG, query STRING, title STRING, url STRING, snippet STRING, pass_priority INT")


def test_only_weak_runs_get_more_hits(spark):
    base = hits(spark, [(run, "p", k, "q", "t", f"https://s{k}.org/{run}", "", 0) for run in (1, 2) for k in range(1, 9)])
    extra = hits(spark, [(run, "p", k, "more", "t", f"https://s{k}.org/{run}", "", 1) for run in (1, 2) for k in range(8, 11)])
    strong = F.col("run_id") == 1
    ranked = base.select(
        "run_id", F.col("ord").alias("rank"), F.lit("direct_likely").alias("surface_type"), F.when(strong, 8.0).otherwise(1.0).alias("fit_score")
    )
    got = d.widen_weak_runs(base, ranked, extra)
    rows = sorted((r["run_id"], r["ord"], r["url"], r["query"]) for r in got.collect())
    assert [r for r in rows if r[0] == 1] == sorted((1, k, f"https://s{k}.org/1", "q") for k in range(1, 9))
    assert [r[1:3] for r in rows if r[0] == 2] == [(k, f"https://s{k}.org/2") for k in range(1, 11)]


def test_searches_start_from_planned_queries(spark):
    people = spark.createDataFrame(
        [("p", "mechanical engineering", "", "Texas", "", "starting_college")],
        "profile_id STRING, intended_major STRING, ethnicity STRING, state STRING, grade_level STRING, student_stage STRING",
    )
    planned = [r["query"] for r in d.q.plan_queries(people, 4).orderBy("query_ord").collect()]

    def answer(*names):
        return json.dumps({"web": {"results": [{"title": n, "url": f"https://{n}.org/", "description": "d"} for n in names]}})

    rows = [
        (7, "p", "generic", 2, planned[0], answer("c")), (7, "p", "specific", 0, f" {planned[1].upper()} ", answer("b")),
        (7, "p", "specific", 0, planned[0], answer("a", "a2")), (7, "p", "specific", 0, "never planned", answer("z")),
        (7, "p", "specific", 0, planned[2], "no json"),
    ]
    payloads = spark.createDataFrame(rows, "run_id INT, profile_id STRING, pass STRING, pass_priority INT, query STRING, payload STRING")
    got = d.search_passes(people, payloads, 4).orderBy("ord").collect()
    assert [(r["ord"], r["title"]) for r in got] == [(1, "a"), (2, "a2"), (3, "b"), (4, "c")]


def walk_loop(front, pages, links, ranked, skip, mode):
    """One run's walk, step by step: (url, depth, outcome); ``skip``: URL to (type, age) of recent pages."""
    seen, queued, out, depth = set(ranked) | {f[0] for f in front}, 0, [], 0
    level = [(u, rank) for u, rank in front]
    while level:
        go = [x for x in level if x[0] not in skip]
        late = [x for x in level if x[0] in skip]
        again = []
        if late and (not go or (mode == "fresh" and len(go) < 6)):
            most = 6 if not go else max(1, 6 - len(go))
            good = [x for x in late if skip[x[0]][0] in ("direct_scholarship", "scholarship_list_page")]
            good.sort(key=lambda x: (skip[x[0]][0] != "scholarship_list_page", -skip[x[0]][1], x[1]))
            again = good[: min(6, max(1, min(most, len(late))))]
        out += [(u, depth, f"history_recent_{skip[u][0]}") for u, r in late if (u, r) not in again]
        following, per_domain = [], {}
        for u, rank in go + again:
            kind = pages.get(u)
            end = "max_list_expansion_depth_reached" if depth == 2 else "scholarship_list_page"
            out.append((u, depth, {"offer": "candidate", "list": end, None: "page_fetch_failed"}.get(kind, "insufficient_scholarship_signals")))
            if kind != "list" or depth == 2:
                continue
            for child, dom in links.get(u, []):
                if queued >= 48 or len(following) >= (16, 32)[depth]:
                    break
                if child in seen or per_domain.get(dom, 0) >= 4:
                    continue
                seen.add(child)
                queued += 1
                per_domain[dom] = per_domain.get(dom, 0) + 1
                following.append((child, rank + (len(following) + 1) / 100))
        level, depth = following, depth + 1
    return sorted(out)


@pytest.mark.parametrize("mode", ["normal", "fresh"])
def test_walk_equals_a_loop(spark, mode):
    import random

    rng = random.Random(4)
    urls = [f"https://u.org/{k}" for k in range(160)]
    pages = {u: rng.choice(["offer", "list", "list", "other"]) for u in urls if rng.random() < 0.9}
    links = {u: [(c, f"d{int(c.rsplit('/', 1)[1]) % 12}") for c in rng.sample(urls, 9)] for u in urls}
    ages = {u: (rng.choice(["direct_scholarship", "scholarship_list_page", "fetch_error"]), rng.randint(0, 5)) for u in urls if rng.random() < 0.6}
    runs = {r: [(u, float(k + 1)) for k, u in enumerate(rng.sample(urls, 5))] for r in range(12)}
    ranked = {r: rng.sample(urls, 20) for r in runs}
    front = spark.createDataFrame([(r, u, int(k), k, None, "q") for r, f in runs.items() for u, k in f], "run_id INT, url STRING, ord LONG, rank DOUBLE, fit_score DOUBLE, query STRING")
    page_rows = spark.createDataFrame(list(pages.items()), "url STRING, kind STRING")
    link_rows = spark.createDataFrame([(u, c, m, k) for u, x in links.items() for k, (c, m) in enumerate(x)], "src_url STRING, url STRING, source_domain STRING, position INT")
    history = spark.createDataFrame([(u, t, a) for u, (t, a) in ages.items()], "normalized_url STRING, page_type STRING, age INT").withColumn(
        "last_fetched_at", F.lit(AS_OF).cast("timestamp") - F.make_interval(hours="age")
    )
    shown = spark.createDataFrame([(r, u) for r, x in ranked.items() for u in x], "run_id INT, url STRING")
    got = e.walk_lists(front, lambda f: (page_rows, link_rows), shown, history, AS_OF, mode).select("run_id", "url", "depth", "outcome").collect()
    for r, f in runs.items():
        assert sorted(tuple(x)[1:] for x in got if x["run_id"] == r) == walk_loop(f, pages, links, ranked[r], ages, mode)
