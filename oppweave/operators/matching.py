"""Eligibility, fit, essay overlap, ranking and draft fields.

Every job works on (profile, offer) pairs that exist in a queue table, joined on
keys.  One profile against a whole catalog is ``pairs_for_profile``; all
profiles against all offers is deliberately not a job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import rule_matches
from ..functions.ranks import full_rank, top_n
from ..functions.text import flag, listed, nonblank, tokens
from .safety import mask, sensitive_name, sensitive_value

ACCOUNT_REASON = "Requires account creation/login (excluded in no-account MVP)"


def pairs_for_profile(profile_id: str, catalog: DataFrame) -> DataFrame:
    """Every catalog offer queued for one profile."""
    return catalog.select(F.lit(profile_id).alias("profile_id"), F.col("id"))


def match_pairs(profiles: DataFrame, catalog: DataFrame, pairs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Pairs, with the columns ``keep``, widened by profile and offer columns, joined on their keys.

    The planner guesses the size of a catalog made of short compressed columns far too low, so
    these joins are sort-merge joins: a broadcast would pass all offers and profiles through the driver.
    """
    return pairs.select("profile_id", "id", *keep).join(catalog.hint("merge"), "id").join(profiles.hint("merge"), "profile_id")


def _loose_match(rules: Column, value: Column) -> Column:
    """Equal or substring either way; blanks are not guarded, by design."""
    v = F.lower(F.trim(value))

    def one(r: Column) -> Column:
        r = F.lower(F.trim(r))
        return v.contains(r) | r.contains(v)

    return F.exists(rules, one)


def with_eligibility(pairs: DataFrame, include_account: bool = True) -> DataFrame:
    """Add status, failed rules, missing facts and the account exclusion flag."""
    gpa = F.expr("try_cast(nullif(trim(gpa), '') AS DOUBLE)")
    major, ethnicity = nonblank("intended_major"), nonblank("ethnicity")
    need_gpa = F.col("min_gpa").isNotNull()
    need_major = F.size("allowed_majors") > 0
    need_eth = F.size("allowed_ethnicities") > 0
    limit = F.format_string("%s", F.col("min_gpa"))
    failed = listed(
        (need_gpa & gpa.isNotNull() & (gpa < F.col("min_gpa")), F.concat(F.lit("GPA below minimum ("), limit, F.lit(")"))),
        (need_major & major.isNotNull() & ~_loose_match(F.col("allowed_majors"), major),
         "Intended major does not match scholarship requirements"),
        (need_eth & ethnicity.isNotNull() & ~_loose_match(F.col("allowed_ethnicities"), ethnicity),
         "Ethnicity/background requirement not matched"),
    )
    missing = listed(
        (need_gpa & gpa.isNull(), F.concat(F.lit("Missing GPA (minimum required is "), limit, F.lit(")"))),
        (need_major & major.isNull(), "Missing intended major"),
        (need_eth & ethnicity.isNull(), "Missing ethnicity/background information"),
    )
    out = pairs.withColumns({"failed_rules": failed, "missing_info": missing}).withColumn(
        "status",
        F.when(F.size("failed_rules") > 0, "ineligible")
        .when(F.size("missing_info") > 0, "needs_human_review")
        .otherwise("eligible"),
    )
    excluded = F.lit(False) if include_account else flag(F.col("requires_account"))
    return out.withColumn("excluded_reason", F.when(excluded, F.lit(ACCOUNT_REASON)))


def match_eligibility(
    profiles: DataFrame, catalog: DataFrame, pairs: DataFrame, include_account: bool = True, keep: tuple[str, ...] = ()
) -> DataFrame:
    return with_eligibility(match_pairs(profiles, catalog, pairs, keep), include_account)


def with_fit(pairs: DataFrame) -> DataFrame:
    """Add the share of applicable checks that a profile satisfies."""
    gpa = F.expr("try_cast(nullif(trim(gpa), '') AS DOUBLE)")
    checks = [
        (F.size("allowed_majors") > 0, rule_matches(F.col("allowed_majors"), "intended_major")),
        (F.size("allowed_ethnicities") > 0, rule_matches(F.col("allowed_ethnicities"), "ethnicity")),
        (F.col("min_gpa").isNotNull(), gpa >= F.col("min_gpa")),
    ]
    applicable = sum((c.cast("int") for c, _ in checks), F.lit(0))
    satisfied = sum((flag(c & s).cast("int") for c, s in checks), F.lit(0))
    return pairs.withColumn(
        "fit_score",
        F.when(applicable == 0, F.lit(0.5)).otherwise(F.round(satisfied / applicable, 3)),
    )


def essay_containment(prompts: DataFrame, essays: DataFrame, pairs: DataFrame) -> DataFrame:
    """Share of an offer's distinct prompt tokens found in a profile's essays.

    ``prompts(id, prompt)``, ``essays(profile_id, content)``, ``pairs(profile_id,
    id)``.  Both sides shrink to distinct tokens before they meet, a row per offer and per profile, so a
    pair stays one row that moves by offer and by profile; a row per pair and token would move as often as a prompt has
    tokens. The planner takes the tokens for as small as the texts' files, so both joins are sort-merge joins.
    """

    def gathered(df: DataFrame, key: str, text: str, out: str) -> DataFrame:
        return df.select(key, F.explode(tokens(text)).alias("token")).groupBy(key).agg(F.collect_set("token").alias(out))

    asked, said = gathered(prompts, "id", "prompt", "asked"), gathered(essays, "profile_id", "content", "said")
    return (
        pairs.select("profile_id", "id")
        .distinct()
        .join(asked.hint("merge"), "id", "left")
        .join(said.hint("merge"), "profile_id", "left")
        .select(
            "profile_id",
            "id",
            F.when(F.col("asked").isNull() | F.col("said").isNull(), F.lit(0.0))
            .otherwise(F.round(F.size(F.array_intersect("asked", "said")) / F.size("asked"), 3))
            .alias("essay_score"),
        )
    )


def parsed_deadline(c: Column | str = "deadline") -> Column:
    """Deadline as a date; text in other forms is NULL."""
    c = F.col(c) if isinstance(c, str) else c
    c = F.trim(c)
    return F.coalesce(
        F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd"),
        F.try_to_date(c, "MMMM d, yyyy"),
        F.try_to_date(c, "MMM d, yyyy"),
        F.try_to_date(c, "M/d/yyyy"),
    )


def rank_order() -> list[Column]:
    return [
        F.col("award_amount").desc(),
        F.col("fit_score").desc(),
        F.col("essay_score").desc(),
        parsed_deadline().asc_nulls_last(),
        F.col("effort_minutes").asc(),
        F.col("ord").asc(),
    ]


def rank_offers(scored: DataFrame, k: int | None) -> DataFrame:
    """Best ``k`` offers per profile, ties in catalog order; all of them without a ``k``."""
    if k is None:
        return full_rank(scored, ["profile_id"], rank_order(), "rank")
    return top_n(scored, ["profile_id"], rank_order(), k, "rank")


#: What speaks against filling in a field by itself, as one byte.
OPEN, SECRET, FILE = 0, 1, 2


def draft_fields(offers: DataFrame, field_values: DataFrame) -> DataFrame:
    """Form fields of queued offers joined to the profile's values.

    ``offers(profile_id, id, form_fields)``, ``field_values(profile_id,
    source_path, value)``.
    """
    name, file = F.col("field.field_name"), F.lower(F.coalesce("field.field_type", F.lit(""))) == "file"
    fields = (
        offers.select("profile_id", "id", F.posexplode("form_fields").alias("position", "field"))
        .withColumn("__manual", F.when(file, FILE).when(sensitive_name(name), SECRET).otherwise(OPEN).cast("tinyint"))
        .select("profile_id", "id", "position", "field.*", "__manual")
    )
    # What a value is read for is settled once per value, and a field's name and type before the rows move: a job that needs
    # no more than the counts moves and sorts keys and a byte.
    given = F.coalesce("value", F.lit("")) != ""
    values = field_values.withColumn(
        "__value", F.when(given, F.when(sensitive_value(F.col("value")), SECRET).otherwise(OPEN)).cast("tinyint")
    )
    joined = fields.join(values, ["profile_id", "source_path"], "left")
    file, none = F.col("__manual") == FILE, F.col("__value").isNull()
    secret = (F.col("__manual") == SECRET) | (F.col("__value") == SECRET)
    return joined.withColumn(
        "reason",
        F.when(file, "File upload required by scholarship form")
        .when(none, "No mapped value available")
        .when(secret, "Sensitive field manual entry required"),
    ).withColumns(
        {
            "mode": F.when(F.col("reason").isNull(), "autofill").otherwise("manual"),
            "masked_preview": F.when(~file & ~none & secret, mask(F.col("value"))),
            "filled_value": F.when(F.col("reason").isNull(), F.col("value")),
        }
    ).drop("__manual", "__value")


def draft_report(fields: DataFrame) -> DataFrame:
    """Autofill and manual field counts per profile and offer."""
    return fields.groupBy("profile_id", "id").agg(
        F.count_if(F.col("mode") == "autofill").alias("n_autofill"),
        F.count_if(F.col("mode") == "manual").alias("n_manual"),
    )
