"""Field claims: winners, conflicts, lists, overrides and model values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import running_max
from ..functions.text import distinct_ci, nonblank

KEY = ["profile_id", "field_path"]

# Fields an outside model may fill, and its thresholds.
MODEL_FIELDS = [
    "personalInfo.addressLine1", "personalInfo.addressLine2", "personalInfo.city",
    "personalInfo.state", "personalInfo.postalCode", "personalInfo.country",
    "academics.schoolName", "academics.gradeLevel", "academics.gpa",
]
SURE, ACCEPT = 0.85, 0.55


def _rank() -> Column:
    """Higher confidence wins, then the earlier document."""
    return F.struct(
        F.col("confidence").alias("confidence"), (-F.col("doc_ord")).alias("neg_ord"),
        F.col("value").alias("value"), F.col("document_id").alias("document_id"),
    )


def merge_claims(claims: DataFrame) -> DataFrame:
    """Winning value, confidence and source per profile and field."""
    return (
        claims.filter(nonblank("value").isNotNull())
        .groupBy(*KEY)
        .agg(F.max(_rank()).alias("w"))
        .select(
            *KEY, F.col("w.value").alias("value"), F.col("w.confidence").alias("confidence"),
            F.col("w.document_id").alias("document_id"),
        )
    )


def claim_conflicts(claims: DataFrame) -> DataFrame:
    """Claims that differ from the winner so far, in document order.

    The winner so far is a running maximum over even ranges, so a field with very many claims is not sorted in one task. Of
    claims with one ``doc_ord`` the larger value, then the larger document id, comes first, as in :func:`merge_claims`.
    """
    rows = claims.filter(nonblank("value").isNotNull())
    order = [F.col("doc_ord").asc(), F.col("value").desc(), F.col("document_id").desc()]
    best = running_max(rows, KEY, order, {"best": _rank()})
    wins = F.col("confidence") > F.col("best.confidence")
    return best.filter(F.col("best").isNotNull() & (F.col("value") != F.col("best.value"))).select(
        *KEY,
        "doc_ord",
        F.col("best.value").alias("previous_value"),
        F.col("value").alias("incoming_value"),
        F.when(wins, F.col("value")).otherwise(F.col("best.value")).alias("chosen_value"),
        F.when(wins, F.col("document_id")).otherwise(F.col("best.document_id")).alias("chosen_source"),
    )


def merge_lists(items: DataFrame) -> DataFrame:
    """Distinct list items per profile and kind, with their first position.

    Long form in and out (``profile_id, kind, doc_ord, pos, item``), so no list is
    gathered in one place; order by ``first_doc, first_pos`` to read it.
    """
    return (
        items.groupBy("profile_id", "kind", "item")
        .agg(F.min(F.struct("doc_ord", "pos")).alias("f"))
        .select(
            "profile_id", "kind", "item", F.col("f.doc_ord").alias("first_doc"), F.col("f.pos").alias("first_pos")
        )
    )


def apply_overrides(winners: DataFrame, overrides: DataFrame) -> DataFrame:
    """Human values replace a field with full confidence; blanks do nothing."""
    human = overrides.filter(nonblank(F.trim("value")).isNotNull()).select(
        *KEY, F.trim("value").alias("h")
    )
    return winners.join(human, KEY, "full_outer").select(
        *KEY,
        F.coalesce("h", "value").alias("value"),
        F.when(F.col("h").isNotNull(), F.lit(1.0)).otherwise(F.col("confidence")).alias("confidence"),
        F.when(F.col("h").isNotNull(), F.lit("human_input")).otherwise(F.col("document_id")).alias("document_id"),
    )


def fields_to_ask(winners: DataFrame, profiles: DataFrame, fields: list[str] = MODEL_FIELDS) -> DataFrame:
    """Fields of each profile that are missing or not sure enough."""
    wanted = profiles.select("profile_id", F.explode(F.array(*[F.lit(f) for f in fields])).alias("field_path"))
    sure = winners.filter(F.col("confidence") >= SURE)
    return wanted.join(sure, KEY, "left_anti")


def merge_model_values(
    winners: DataFrame, model: DataFrame, fields: list[str] = MODEL_FIELDS
) -> DataFrame:
    """Model values that are allowed, sure enough and surer than the current one.

    Only profiles that still miss something are touched.  ``model`` carries
    ``ord``; of several values for a field the surest, then the first, counts.
    """
    n_sure = winners.filter(F.col("field_path").isin(fields) & (F.col("confidence") >= SURE)).groupBy(
        "profile_id"
    ).agg(F.count_distinct("field_path").alias("n"))
    complete = n_sure.filter(F.col("n") >= len(fields)).select("profile_id")
    best = (
        model.filter(
            F.col("field_path").isin(fields) & nonblank(F.trim("value")).isNotNull()
            & (F.col("confidence") >= ACCEPT)
        )
        .join(complete, "profile_id", "left_anti")
        .groupBy(*KEY)
        .agg(F.max(F.struct("confidence", -F.col("ord"), F.trim("value").alias("value"))).alias("m"))
        .select(*KEY, F.col("m.value").alias("m_value"), F.col("m.confidence").alias("m_conf"))
    )
    both = winners.join(best, KEY, "full_outer")
    take = F.col("m_value").isNotNull() & (
        nonblank("value").isNull() | (F.col("m_conf") > F.coalesce("confidence", F.lit(0.0)))
    )
    return both.select(
        *KEY,
        F.when(take, F.col("m_value")).otherwise(F.col("value")).alias("value"),
        F.when(take, F.col("m_conf")).otherwise(F.col("confidence")).alias("confidence"),
        F.when(take, F.lit("ai_enrichment")).otherwise(F.col("document_id")).alias("document_id"),
    )


def merge_candidate_updates(candidates: DataFrame, updates: DataFrame) -> DataFrame:
    """Add a model's list values to a candidate's lists; scalars it names win."""
    lists = ["allowed_majors", "allowed_ethnicities", "required_states", "statements"]
    scalars = ["min_gpa", "min_age", "max_age"]
    none = F.array().cast("array<string>")
    u = updates.select("source_url", *[F.col(c).alias(f"u_{c}") for c in lists + scalars])
    j = candidates.join(u, "source_url", "left")
    return j.withColumns(
        {
            **{c: distinct_ci(F.concat(F.coalesce(c, none), F.coalesce(f"u_{c}", none))) for c in lists},
            **{c: F.coalesce(f"u_{c}", c) for c in scalars},
        }
    ).drop(*[f"u_{c}" for c in lists + scalars])
