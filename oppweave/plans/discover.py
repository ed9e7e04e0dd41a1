"""Stored hits and pages to new candidates, for many runs at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as v
from ..functions.ranks import first_per
from ..functions.urls import canonical_url, path
from ..operators import bundles as b
from ..operators import expansion as e
from ..operators import history as h
from ..operators import hits as o
from ..operators import links as li
from ..operators import pages as p
from ..operators import queries as q
from ..operators import store as s
from ..session import cut
from ..sources.readers import explode_search_payload


def rank_for_discovery(
    hits: DataFrame, profiles: DataFrame, history: DataFrame, feedback: DataFrame, as_of: str
) -> DataFrame:
    """Scored, deduplicated and ranked hits of every run."""
    scores = h.domain_score(feedback, h.domain_yield(history, as_of))
    counts = h.recent_domain_counts(history, as_of, ["direct_scholarship", "scholarship_list_page"])
    known = history.select("normalized_url", "last_fetched_at", "page_type")
    feats = o.with_heuristics(o.hit_features(hits).join(profiles, "profile_id"), as_of, "discovery")
    scored = (
        feats.join(scores, "source_domain", "left").join(counts, "source_domain", "left")
        .join(known, "normalized_url", "left")
        .withColumns({"fit_score": o.discovery_fit_score(F.col("domain_score")), "novelty_score": o.novelty_score(as_of)})
    )
    slim = scored.select(
        "run_id", "profile_id", "ord", "query", "title", "url", "normalized_url", "source_domain", "surface_type",
        "fit_score", "novelty_score", "pass_priority", F.col("ord").alias("global_rank"),
    )
    return o.rank_hits(o.dedupe_hits(slim), "discovery", "first_ord")


def search_passes(
    profiles: DataFrame, payloads: DataFrame, total: int = 12, per_query: int | None = None, **planning
) -> DataFrame:
    """Hits of every profile's planned queries, from stored search answers, ranked by arrival.

    ``payloads(run_id, profile_id, pass, pass_priority, query, payload)``. Only answers to queries that
    :func:`plan_queries` plans for the profile (case and blanks aside) are read; answers are in the order of the passes and the plan.
    """
    planned = q.plan_queries(profiles, total, **planning).withColumn("__q", F.lower(F.trim("query")))
    asked = payloads.withColumn("__q", F.lower(F.trim("query"))).join(
        planned.select("profile_id", "__q", "query_ord"), ["profile_id", "__q"]
    )
    hits = explode_search_payload(asked.drop("__q"), per_query)
    ordered = hits.withColumn("ord", F.struct("pass_priority", "query_ord", "provider_rank"))
    return o.union_passes([(ordered, "stored", 0)]).withColumn("ord", F.col("global_rank").cast("bigint")).drop("pass")


def widen_weak_runs(base: DataFrame, ranked: DataFrame, extra: DataFrame) -> DataFrame:
    """``base`` hits with the ``extra`` ones of runs whose ranked hits are too weak to stop searching.

    Of the extra hits only URLs new to a run come in, behind all others.
    """
    weak = o.frontier_weakness(ranked).filter("weak").select("run_id")
    more = extra.join(weak, "run_id", "left_semi")
    keyed = [x.withColumn("normalized_url", canonical_url("url")) for x in (base, more)]
    merged = o.merge_expansion(keyed[0].withColumn("global_rank", F.col("ord").cast("int")), keyed[1])
    return merged.withColumn("ord", F.col("global_rank").cast("bigint")).drop("normalized_url", "global_rank")


class PageReader:
    """Parses stored pages on demand: HTML is read for the URLs of a front only.

    ``index(url, page_id)`` has the canonical URL of every stored page and no text; a front is looked up there, and
    only rows of the pages found go on to the parser. What has been parsed is kept in ``found`` and ``texts``.
    """

    def __init__(self, pages: DataFrame, as_of: str, n_links: int | None):
        self.pages, self.as_of, self.n_links = pages, as_of, n_links
        self.index = cut(pages.select(canonical_url("url").alias("url"), "page_id"))
        self.found: DataFrame | None = None
        self.texts: DataFrame | None = None

    def reached(self, front: DataFrame) -> DataFrame:
        """Rows of the stored pages with a URL of the front."""
        urls = front.select("url").distinct()
        ids = self.index.join(urls, "url", "left_semi").select("page_id")
        return self.pages.join(ids, "page_id", "left_semi")

    def __call__(self, front: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Kinds and child links of the front's pages, see :func:`walk_lists`."""
        pages = self.reached(front)
        if self.found is not None:  # parsed for another run at an earlier depth
            done = self.found.select("page_id").distinct()
            pages = pages.join(done, "page_id", "left_anti")
        new, links = self._parse(cut(pages))
        self.found = new if self.found is None else self.found.unionByName(new)
        self.links = links if getattr(self, "links", None) is None else self.links.unionByName(links)
        best = self.newest()
        skip = F.col("skip_reason")
        kind = F.when(skip.isNull(), "offer").when(skip == "scholarship_list_page", "list").otherwise("other")
        edges = self.links.select(
            canonical_url("src_url").alias("src_url"), canonical_url("url").alias("url"), "source_domain",
            F.col("page_rank").alias("position"),
        )
        return best.select("url", kind.alias("kind")), edges

    def newest(self) -> DataFrame:
        """Of several stored pages with one canonical URL the newest fetch counts, then the largest page id."""
        order = [F.col(c).desc_nulls_last() for c in ("fetched_at", "page_id") if c in self.found.columns]
        return first_per(self.found, ["url"], [*order, F.col("source_url").asc()])

    def _parse(self, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
        links = cut(li.best_links(li.page_links(pages, v.LINK_KEEP_CRAWL, v.LINK_DROP_CRAWL, crawl=True), self.n_links))
        counts = links.groupBy("page_id").agg(F.count("*").alias("n_links"))
        ok = p.classify_fetch(pages).filter("fetch_status = 'ok'")
        facts = cut(p.page_facts(p.with_sentences(p.page_text(ok), most=v.LIMITS["requirements"]), v.LIMITS["essay_prompts"]))
        found = b.extract_candidates(facts, counts, self.as_of).withColumn("url", canonical_url("source_url"))
        texts = facts.select("page_id", "title", "text")
        self.texts = texts if self.texts is None else self.texts.unionByName(texts)
        # A page belongs to no run here; the walk brings runs and pages together.
        return cut(found.drop("run_id", "profile_id", "depth", "global_rank", "query")), links


def promising_lists(reader: PageReader, owner: DataFrame, profiles: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """The test that a list of depth 2 must pass: its text against its run's profile (:func:`list_promise`)."""

    def test(lists: DataFrame) -> DataFrame:
        page = reader.newest().select("url", "page_id", "n_links", F.lower(path("source_url")).alias("path"))
        seen = lists.join(page, "url").join(reader.texts, "page_id").join(owner, "run_id").join(profiles, "profile_id")
        return seen.filter(e.list_promise(seen, F.col("n_links"))).select("run_id", "url")

    return test


def discover(
    profiles: DataFrame, hits: DataFrame, pages: DataFrame, history: DataFrame, feedback: DataFrame,
    known: DataFrame, as_of: str, k: int = 8, mode: str = "normal", max_depth: int = 2,
    extra: DataFrame | None = None, n_links: int | None = v.LIMITS["links_per_list"],
) -> dict[str, DataFrame]:
    """The whole flow: rank, widen weak runs, frontier, gated page walk, score, dedupe, top k.

    ``hits(run_id, profile_id, ord, query, title, url, snippet, pass_priority)``, such as those of
    :func:`search_passes`; ``extra`` are hits of a second search, for the runs whose first one is weak. ``pages`` with page_id and
    fetch columns, ``known(id, source_url, name, source_domain)``. ``mode`` is normal, rerun or fresh; the latter two
    go one level deeper, and a rerun expands promising lists there.
    """
    ranked = cut(rank_for_discovery(hits, profiles, history, feedback, as_of))
    if extra is not None:
        hits = cut(widen_weak_runs(hits, ranked, extra))
        ranked = cut(rank_for_discovery(hits, profiles, history, feedback, as_of))
    frontier = cut(o.initial_frontier(ranked))
    front = frontier.select(
        "run_id", F.col("normalized_url").alias("url"), F.col("frontier_position").cast("bigint").alias("ord"),
        F.col("rank").cast("double").alias("rank"), F.col("fit_score").cast("double").alias("fit_score"), "query",
    )
    owner = hits.select("run_id", "profile_id").distinct()
    reader = PageReader(pages, as_of, n_links)
    walk = cut(
        e.walk_lists(
            front, reader, ranked.select("run_id", F.col("normalized_url").alias("url")), history, as_of, mode,
            max_depth if mode == "normal" else max(max_depth, 3),
            promising_lists(reader, owner, profiles) if mode == "rerun" else None, hosted=True,
        )
    )
    cand = (
        walk.filter("outcome = 'candidate'").select("run_id", "url", "depth", "ord", F.col("rank").alias("global_rank"))
        .join(reader.newest().filter("skip_reason IS NULL"), "url")
        .join(owner, "run_id")
        .withColumns({"id": F.lit(None).cast("string"), "row": F.concat_ws("|", "run_id", "url")})
    )
    scored = cut(e.score_candidate_fit(cand, profiles))
    new = s.anti_known(scored, known, "row").select("row").withColumn("is_new", F.lit(True))
    judged = scored.join(new, "row", "left").withColumn(
        "reason",
        F.when(F.col("is_new").isNull(), "already_reviewed_or_known").when(~F.col("is_eligible"), "profile_ineligible"),
    )
    final = e.final_candidates(judged.filter("reason IS NULL"), k, "url")
    # A list that is not expanded counts as a list and by its reason.
    is_list = F.col("outcome").isin("max_list_expansion_depth_reached", "depth_3_not_promising")
    listed = F.when(is_list, F.array(F.lit("scholarship_list_page"), "outcome")).otherwise(F.array("outcome"))
    reasons = walk.filter("outcome <> 'candidate'").select("run_id", F.explode(listed).alias("reason")).unionByName(
        judged.select("run_id", "reason")
    )
    return {
        "ranked": ranked, "frontier": frontier, "walk": walk, "judged": judged, "candidates": final,
        "skip_counts": _counts(reasons), "history": h.upsert_history(history, _history_rows(ranked, walk, as_of)),
    }


def _history_rows(ranked: DataFrame, walk: DataFrame, as_of: str) -> DataFrame:
    """Every hit as seen, and behind it every fetched page with what it was."""
    now, none = F.lit(as_of).cast("timestamp"), F.lit("")
    empty = {c: none for c in ("last_error", "candidate_id", "candidate_name")}
    hits = ranked.groupBy(F.col("normalized_url")).agg(F.max_by("query", F.struct("run_id", "rank")).alias("last_search_query"))
    seen = hits.withColumns(
        {
            "url": F.col("normalized_url"), "source_domain": o.domain("normalized_url"), "page_type": none, "last_seen_at": now,
            "last_fetched_at": F.lit(None).cast("timestamp"), **empty, "ord": F.lit(0),
        }
    )
    got = walk.filter("fetched").groupBy("url").agg(
        F.max_by(F.struct("outcome", "query"), F.struct("ord", "run_id")).alias("x")
    )
    outcome = F.col("x.outcome")
    pages = got.withColumns(
        {
            "normalized_url": F.col("url"), "source_domain": o.domain("url"), "last_search_query": F.col("x.query"),
            "page_type": F.when(outcome == "candidate", "direct_scholarship").when(outcome == "page_fetch_failed", "fetch_error")
            .when(outcome.isin(*LISTS), "scholarship_list_page").otherwise("not_scholarship_page"),
            "last_seen_at": now, "last_fetched_at": now, **empty, "ord": F.lit(1),
        }
    ).withColumn("last_error", F.when(outcome.isin("page_fetch_failed", "insufficient_scholarship_signals"), outcome).otherwise(""))
    columns = [*h.HISTORY_COLUMNS, "ord"]
    return seen.select(*columns).unionByName(pages.select(*columns))


LISTS = ("scholarship_list_page", "max_list_expansion_depth_reached", "depth_3_not_promising")


def _counts(reasons: DataFrame) -> DataFrame:
    return reasons.filter(F.col("reason").isNotNull()).groupBy("run_id", "reason").agg(F.count("*").alias("n"))
