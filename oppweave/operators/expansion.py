"""Candidate scores, final lists and bounded expansion of list pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as v
from ..functions.lexicon import rule_matches, stage_terms, state_code, student_stage
from ..functions.ranks import top_n
from ..functions.text import clean, flag, has, listed, nonblank, norm, num
from ..functions.urls import domain
from ..session import cut
from .history import history_gate, history_lookup, select_revisits


def score_candidate_fit(candidates: DataFrame, profiles: DataFrame) -> DataFrame:
    """Score, reasons and blockers of each candidate for its run's profile.

    Joined on ``profile_id``.  A profile value that is missing blocks.
    """
    df = candidates.join(profiles, "profile_id")
    none = F.array().cast("array<string>")
    state = state_code("state")
    gpa = F.expr("try_cast(nullif(trim(gpa), '') AS DOUBLE)")
    df = df.withColumns(
        {
            "__stage": student_stage("student_stage", "grade_level"),
            "__need": F.coalesce("required_stages", none),
            "__major": rule_matches(F.col("allowed_majors"), "intended_major"),
            "__eth": rule_matches(F.col("allowed_ethnicities"), "ethnicity"),
            "__state": F.array_contains("required_states", state),
            "__gpa": flag(gpa >= F.col("min_gpa")),
        }
    )

    def need(s: str) -> Column:
        return F.array_contains("__need", s)

    asks_m, asks_e = F.size("allowed_majors") > 0, F.size("allowed_ethnicities") > 0
    asks_s, asks_g = F.size("required_states") > 0, F.col("min_gpa").isNotNull()
    asks_t = F.size("__need") > 0
    m, e, s, g = (flag(F.col(c)) for c in ("__major", "__eth", "__state", "__gpa"))
    starting = asks_t & (F.col("__stage") == "starting_college")
    enrolled = asks_t & F.col("__stage").isin("in_college", "transfering_college", "transferring_college")
    fresh = need("incoming_freshman") | need("high_school")
    only_school = need("high_school") & ~need("incoming_freshman") & ~need("undergraduate")
    settled = need("continuing_college") | need("undergraduate")
    grad = need("graduate")
    free_start = starting & ~grad & ~need("continuing_college")
    free_enrol = enrolled & ~grad & ~only_school
    stage_ok = (free_start & fresh) | (free_enrol & settled)
    # Candidate points.
    score = (
        F.when(F.col("award_amount") > 0, F.least(F.lit(4.0), F.log10(F.col("award_amount") + 1))).otherwise(0.0)
        + num(nonblank("deadline").isNotNull(), 0.6)
        + num(asks_m & m, 3.0) + num(asks_e & e, 2.0) + num(asks_s & s, 1.5) + num(asks_g & g, 1.2)
        + F.when(free_start & fresh, 2.0).when(free_start & need("undergraduate"), 0.8)
        .when(free_enrol & settled, 1.5).otherwise(0.0)
        + F.greatest(F.lit(0.0), 2 - F.coalesce("global_rank", F.lit(0)) * 0.2)
    )
    blockers = listed(
        (asks_m & ~m, "major_mismatch"), (asks_e & ~e, "ethnicity_mismatch"), (asks_s & ~s, "state_mismatch"),
        (asks_g & ~g, "gpa_mismatch"), ((starting | enrolled) & grad, "stage_mismatch_graduate"),
        (starting & ~grad & need("continuing_college"), "stage_mismatch_continuing_college"),
        (enrolled & ~grad & only_school, "stage_mismatch_high_school"),
    )
    reasons = listed(
        (F.col("award_amount") > 0, F.concat(F.lit("award:"), F.col("award_amount").cast("bigint"))),
        (nonblank("deadline").isNotNull(), "deadline"), (asks_m & m, "major_match"), (asks_e & e, "ethnicity_match"),
        (asks_s & s, "state_match"), (asks_g & g, "gpa_match"), (stage_ok, "stage_match"),
    )
    return df.withColumns(
        {"score": F.round(score, 3), "reasons": reasons, "blockers": blockers}
    ).withColumn("is_eligible", F.size("blockers") == 0).drop("__stage", "__need", "__major", "__eth", "__state", "__gpa")


def final_candidates(scored: DataFrame, k: int, tie: str = "ord") -> DataFrame:
    """Best score per URL (else name and domain) and run, then the best ``k`` runs."""
    key = F.coalesce(
        F.concat(F.lit("url:"), F.lower(nonblank("source_url"))),
        F.concat(F.lit("name_domain:"), F.lower("name"), F.lit("::"), F.lower("source_domain")),
    )
    order = [F.col("score").desc(), F.col(tie).asc()]
    best = top_n(scored.withColumn("__key", key), ["run_id", "__key"], order, 1, "__rn").drop("__rn", "__key")
    return top_n(best, ["run_id"], order, k, "position")


def fetch_frontier(frontier: DataFrame, pages: DataFrame) -> DataFrame:
    """Frontier URLs joined to the stored pages; a page not stored has failed."""
    return frontier.join(pages, "normalized_url", "left").withColumn(
        "fetch_error", F.when(F.col("page_id").isNull(), "page_fetch_failed")
    )


def expand_quota(
    children: DataFrame, seen: DataFrame, depth: int, used_in_run: DataFrame | None = None,
    per_depth: int | None = None, per_domain: int = v.EXPANSION_PER_DOMAIN, per_run: int = v.EXPANSION_PER_RUN,
) -> DataFrame:
    """Children of one depth that fit the quotas, in arrival order.

    ``children(run_id, url, source_domain, parent_ord, position)``.  All quotas are
    literals, so map tasks keep only a few rows per run and domain.
    """
    limit = per_depth or v.EXPANSION_PER_DEPTH[min(depth, max(v.EXPANSION_PER_DEPTH))]
    arrival = [F.col("parent_ord").asc(), F.col("position").asc(), F.col("url").asc()]
    one = top_n(children, ["run_id", "url"], arrival, 1, "__rn").drop("__rn")
    fresh = one.join(seen.select("run_id", "url"), ["run_id", "url"], "left_anti")
    dom = F.coalesce(nonblank("source_domain"), F.lit("unknown"))
    some = top_n(fresh.withColumn("__dom", dom), ["run_id", "__dom"], arrival, per_domain, "__rn").drop("__rn", "__dom")
    kept = top_n(some, ["run_id"], arrival, limit, "child_rank")
    if used_in_run is not None:
        kept = (
            kept.join(used_in_run.select("run_id", "n_used"), "run_id", "left")
            .filter(F.col("child_rank") + F.coalesce("n_used", F.lit(0)) <= per_run)
            .drop("n_used")
        )
    return kept.withColumn("depth", F.lit(depth))


def list_promise(lists: DataFrame, children_count: Column) -> Column:
    """Does a list page deserve the third depth? Needs text and profile columns."""
    text = F.lower(F.concat_ws("\n", clean("title"), "query", clean("text"), "path"))
    major, eth, state = norm("intended_major"), norm("ethnicity"), norm("state")
    terms = F.exists(stage_terms("student_stage", "grade_level"), lambda t: text.contains(t))
    groups = r"\bhispanic|latino|latinx\b"
    # Promise points and the pass mark.
    score = (
        F.when(children_count.between(2, 8), 2).when(children_count > 8, 1).otherwise(0)
        + num(terms, 3)
        + F.when((major != "") & text.contains(major), 3)
        .when(has(major, r"\bengineering\b") & has(text, r"\bengineering\b"), 2).otherwise(0)
        + F.when((eth != "") & text.contains(eth), 2).when(has(eth, groups) & has(text, groups), 2).otherwise(0)
        + num((state != "") & text.contains(state), 1)
        + num(has("path", r"/scholarships/(search/)?"), 1)
        + num(has(text, r"top \d+|scholarships for|engineering scholarships|scholarships for hispanic|mechanical engineering scholarships"), 1)
        - num(has(text, r"\bgraduate|phd|doctoral|master'?s|masters|fellowship\b"), 3)
        - num(children_count == 0, 4)
    )
    return score >= 5


#: URLs of a front, up to which a task holds them all to pick their links.
NEAR = 500_000


def links_from(links: DataFrame, urls: DataFrame) -> DataFrame:
    """The links whose ``src_url`` is one of ``urls(url)``, of a front that is written out.

    The URLs go to every task, so the rows of all other pages are dropped where they are read, below an aggregate
    that makes the links. A front beyond ``NEAR`` would be too much for that; all links are left to the join then.
    """
    here = urls.select(F.col("url").alias("src_url")).filter("src_url is not null").distinct()
    return links.join(F.broadcast(here), "src_url", "left_semi") if here.count() <= NEAR else links


def level(n: Column, of: int) -> Column:
    """0 for the first ``of`` places, 1 for the next, and twice as many with each further level."""
    q = F.floor((n - 1) / of).cast("bigint")
    return F.when(q > 0, F.length(F.bin(q))).otherwise(0)


def children(
    lists: DataFrame, links: DataFrame, seen: DataFrame, per_domain: int = v.EXPANSION_PER_DOMAIN
) -> DataFrame:
    """Links of the lists, without those that no quota of :func:`expand_quota` can reach.

    A run takes the first ``per_domain`` links of a domain that it has not seen. So of a list's links to one domain only
    as many of the first can count as that and the URLs of a domain that the run has seen. Pages of one URL give a list as many links as
    there are pages, and all runs may bring that list: the product of both would be moved. A link's
    ``source_domain`` must be the domain of its URL.
    """
    counts = seen.groupBy("run_id", domain("url").alias("__dom")).agg(F.count("*").alias("n"))
    counts = cut(counts.groupBy("run_id").agg((F.max("n") + per_domain).alias("__most")))
    most = counts.agg(F.max("__most")).first()[0] or per_domain
    arrival = [F.col("position").asc(), F.col("url").asc()]
    once = top_n(links, ["src_url", "url"], arrival, 1, "__rn").drop("__rn")
    first = top_n(once, ["src_url", "source_domain"], arrival, most, "__rn").withColumn("__level", level(F.col("__rn"), per_domain)).drop("__rn")
    reach = F.sequence(F.lit(0), level(F.coalesce("__most", F.lit(per_domain)), per_domain))
    wide = lists.join(counts, "run_id", "left").withColumn("__level", F.explode(reach)).drop("__most")
    return wide.join(first, ["src_url", "__level"]).drop("__level")


def walk_lists(
    front: DataFrame,
    reach: Callable[[DataFrame], tuple[DataFrame, DataFrame]],
    ranked: DataFrame | None = None,
    history: DataFrame | None = None,
    as_of: str | None = None,
    mode: str = "normal",
    max_depth: int = 2,
    promise: Callable[[DataFrame], DataFrame] | None = None,
    hosted: bool = False,
) -> DataFrame:
    """Breadth-first walk over list pages of many runs, with the fetch history's gate at every depth.

    ``front(run_id, url, ord, rank, fit_score, query)`` is depth 0. Each depth:

    1. gate: URLs that the history holds as recently fetched are skipped, unless ``mode`` bypasses them; a run with
       too little left takes its best skipped ones again, after its fresh ones (:func:`select_revisits`);
    2. ``reach`` is given the URLs to fetch and returns ``(pages(url, kind), links(src_url, url, source_domain,
       position))`` for them; kind is offer, list or other, a URL without a page has failed;
    3. children of the list pages, in the order of their parents, join the next front within the quotas. A run never
       queues a URL twice, nor one of ``ranked(run_id, url)``, its search hits; what the quotas count is what was queued, fetched or not.

    A child's rank is its parent's plus a hundredth of its place in the round, and it has no fit. Lists of depth 2 are expanded only if ``max_depth`` is 3
    and ``promise``, given them as (run_id, url, query), returns them. Returned: run_id, url, parent_url, depth, ord,
    rank, query, outcome and fetched (false for what the history skipped). Every round is written out, and the walk
    ends when no child is left. ``hosted``: the source_domain of every link is the domain of its URL (:func:`children`).
    """
    front = cut(front.withColumns({"parent_url": F.lit(None).cast("string"), "depth": F.lit(0)}))
    queued = front.select("run_id", "url")
    seen = queued if ranked is None else queued.unionByName(ranked.select("run_id", "url")).distinct()
    out, used = None, None
    columns = ["run_id", "url", "parent_url", "depth", "ord", "rank", "query", "outcome", "fetched"]
    for depth in range(max_depth + 1):
        go, skipped = _gated(front, history, as_of, mode)
        pages, links = reach(go.select("run_id", "url"))
        kind = F.col("kind")
        got = go.join(pages.select("url", "kind"), "url", "left").withColumn(
            "outcome",
            F.when(kind.isNull(), "page_fetch_failed").when(kind == "offer", "candidate")
            .when((kind == "list") & F.lit(depth >= max_depth), "max_list_expansion_depth_reached")
            .when(kind == "list", "scholarship_list_page").otherwise("insufficient_scholarship_signals"),
        )
        if depth == 2 and max_depth >= 3:
            got = cut(got)
            lists = got.filter("outcome = 'scholarship_list_page'").select("run_id", "url", "query")
            good = lists.limit(0) if promise is None else promise(lists)
            good = good.select("run_id", "url").distinct().withColumn("__good", F.lit(True))
            dull = (F.col("outcome") == "scholarship_list_page") & F.col("__good").isNull()
            got = got.join(good, ["run_id", "url"], "left").withColumn(
                "outcome", F.when(dull, "depth_3_not_promising").otherwise(F.col("outcome"))
            )
        got = cut(got.withColumn("fetched", F.lit(True)).select(*columns).unionByName(skipped.select(*columns)))
        out = got if out is None else out.unionByName(got)
        if depth == max_depth:
            break
        lists = got.filter("outcome = 'scholarship_list_page'").select(
            "run_id", F.col("url").alias("src_url"), F.col("ord").alias("parent_ord"), F.col("rank").alias("parent_rank"), "query"
        )
        born = children(lists, links, seen) if hosted else lists.join(links, "src_url")
        kids = expand_quota(born, seen, depth + 1, used)
        front = cut(
            kids.select(
                "run_id", "url", F.col("child_rank").cast("bigint").alias("ord"),
                (F.col("parent_rank") + F.col("child_rank") / 100).alias("rank"), F.lit(None).cast("double").alias("fit_score"),
                F.concat("query", F.lit(" [list-expanded]")).alias("query"), F.col("src_url").alias("parent_url"), "depth",
            )
        )
        if front.isEmpty():
            break
        seen = seen.unionByName(front.select("run_id", "url"))
        count = front.groupBy("run_id").agg(F.count("*").alias("n_used"))
        used = count if used is None else used.unionByName(count).groupBy("run_id").agg(F.sum("n_used").alias("n_used"))
    return out


#: Revisited pages are fetched, and their children queued, after all others.
LATER = 1 << 40


def _gated(front: DataFrame, history: DataFrame | None, as_of: str | None, mode: str) -> tuple[DataFrame, DataFrame]:
    """The rows of a front to fetch, and those that the history skips."""
    none = F.lit(None).cast("string")
    if history is None:
        return front, front.withColumns({"outcome": none, "fetched": F.lit(False)}).limit(0)
    known = front.withColumn("normalized_url", F.col("url"))
    gated = cut(history_gate(history_lookup(known, history, as_of), mode))
    again = cut(select_revisits(gated, mode == "fresh").select("run_id", "url", "revisit_rank"))
    fresh = gated.filter("decision <> 'skip'")
    both = gated.filter("decision = 'skip'").join(again, ["run_id", "url"], "left")
    later = both.filter("revisit_rank is not null").withColumn("ord", F.col("revisit_rank") + F.lit(LATER))
    skipped = both.filter("revisit_rank is null").withColumns(
        {"outcome": F.concat(F.lit("history_recent_"), "page_type"), "fetched": F.lit(False)}
    )
    return fresh.select(*front.columns).unionByName(later.select(*front.columns)), skipped


def expand_lists(
    seeds: DataFrame, pages: DataFrame, links: DataFrame, max_depth: int = 2, deep_ok: DataFrame | None = None
) -> DataFrame:
    """:func:`walk_lists` over stored tables, without a history or search hits.

    ``seeds(run_id, url, ord)``; the lists of ``deep_ok(run_id, url)`` may be expanded to depth 3.
    """
    front = seeds.select(
        "run_id", "url", F.col("ord").cast("bigint").alias("ord"), F.col("ord").cast("double").alias("rank"),
        F.lit(None).cast("double").alias("fit_score"), F.lit("").alias("query"),
    )
    promise = None if deep_ok is None else lambda lists: lists.join(deep_ok, ["run_id", "url"], "left_semi")
    walk = walk_lists(front, lambda urls: (pages, links_from(links, urls)), max_depth=max_depth, promise=promise)
    return walk.select("run_id", "url", "ord", "parent_url", "depth", "outcome")
