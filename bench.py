"""Headline queries on the test tables; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oppweave.session import SPLITS, local_session  # noqa: E402
from oppweave.workloads import load  # noqa: E402
from oppweave.workloads.registry import QUERIES  # noqa: E402

HEADLINE = [
    "match_eligibility", "score_profile_fit", "rank_offers", "essay_containment", "draft_fields",
    "canonical_urls", "dedupe_hits", "rank_hits", "same_domain_flag", "initial_frontier", "search_quality",
    "history_lookup", "upsert_history", "domain_score", "merge_claims", "claim_conflicts",
    "page_text", "page_sentences", "tag_lexicon", "page_links", "page_facts", "page_bundles", "triage_pages",
    "extract_candidates", "scan_sensitive", "score_hits", "batch_diversity_fill", "replay_scores",
    "anti_known", "candidate_risk", "import_candidates", "score_candidate_fit", "final_candidates",
    "expand_lists", "stage_leads", "lineage_outcomes", "assess_progress", "plan_queries", "extract_claims",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    load()
    n = int(cpus) if cpus.isdigit() else 8
    spark = local_session("bench", cpus, partitions=n)
    spark.conf.set(SPLITS, str(n))
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()  # start the workers
    times = {}
    for name in names:
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    print(
        json.dumps(
            {
                "metric": "total seconds of headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
                "queries": times, "sf": sf_dir.rstrip("/").split("sf")[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
