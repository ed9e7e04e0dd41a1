"""Documents and catalog to ranked offers and draft fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import claims as c
from ..operators import matching as m
from ..operators import texts as t
from ..session import cut

MATCH_FIELDS = {
    "intended_major": "personalInfo.intendedMajor",
    "ethnicity": "personalInfo.ethnicity",
    "gpa": "academics.gpa",
}


def profiles_from_claims(winners: DataFrame) -> DataFrame:
    """Wide profile rows of the fields that matching reads."""
    return winners.groupBy("profile_id").agg(
        *[F.max(F.when(F.col("field_path") == path, F.col("value"))).alias(name) for name, path in MATCH_FIELDS.items()]
    )


def match_profiles(
    documents: DataFrame, catalog: DataFrame, pairs: DataFrame, overrides: DataFrame | None = None,
    k: int | None = None,
) -> dict[str, DataFrame]:
    """Claims, merged profiles, ranked offers and draft fields of many profiles.

    ``pairs(profile_id, id)`` says which offers each profile considers.
    """
    claims = cut(t.extract_claims(documents))  # read by four of the tables below
    winners = c.merge_claims(claims)
    if overrides is not None:
        winners = c.apply_overrides(winners, overrides)
    people = profiles_from_claims(winners)
    prompts = catalog.select("id", F.array_join("essay_prompts", " ").alias("prompt"))
    # Every pair once, with its number; scored first, so that the pairs bring the score along and meet it in no wider join.
    once = cut(pairs.groupBy("profile_id", "id").agg(F.count("*").alias("__n")))
    overlap = cut(m.essay_containment(prompts, t.segment_essays(documents), once))
    again = once.filter("__n > 1")
    if not again.isEmpty():
        more = overlap.join(again, ["profile_id", "id"]).withColumn("__n", F.explode(F.sequence(F.lit(2), F.col("__n").cast("int"))))
        overlap = overlap.unionByName(more.drop("__n"))
    scored = m.with_fit(m.match_eligibility(people, catalog, overlap, keep=("essay_score",)))
    ranked = m.rank_offers(scored, k)
    values = winners.select("profile_id", F.col("field_path").alias("source_path"), "value")
    drafts = None
    if "form_fields" in catalog.columns:
        drafts = m.draft_fields(ranked.select("profile_id", "id", "form_fields"), values)
    return {
        "claims": claims, "conflicts": c.claim_conflicts(claims), "winners": winners, "profiles": people,
        "ranked": ranked, "drafts": drafts,
        "lists": c.merge_lists(
            t.prefixed_items(documents).select("profile_id", "kind", "doc_ord", "pos", "item")
        ),
    }
