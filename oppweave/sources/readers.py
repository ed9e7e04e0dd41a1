"""Readers: catalog JSON and CSV, documents, search payloads, run logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean, nonblank, first_items
from ..operators.store import split_list, to_boolean

CATALOG_JSON = """
id STRING, name STRING, sourceDomain STRING, sourceTier STRING, sourceUrl STRING, sourceName STRING,
requiresAccount BOOLEAN, awardAmount DOUBLE, deadline STRING, estimatedEffortMinutes INT,
eligibility STRUCT<minGpa: DOUBLE, allowedMajors: ARRAY<STRING>, allowedEthnicities: ARRAY<STRING>>,
inferredRequirements STRUCT<requiredMajors: ARRAY<STRING>, requiredEthnicities: ARRAY<STRING>,
  requiredStates: ARRAY<STRING>, minAge: INT, maxAge: INT, requirementStatements: ARRAY<STRING>>,
essayPrompts ARRAY<STRING>,
formFields ARRAY<STRUCT<fieldName: STRING, displayLabel: STRING, sourcePath: STRING, fieldType: STRING,
  acceptedFileTypes: STRING, essayPrompt: STRING, mappingReason: STRING>>,
status STRING, reviewNotes STRING, reviewedBy STRING, reviewedAt STRING, createdAt STRING,
riskScore INT, riskFlags ARRAY<STRING>, recommendedTier STRING, userSuggested BOOLEAN
"""

# Source tiers.
TIERS = ["Tier 1", "Tier 2", "Tier 3"]

CATALOG_CSV = [
    "id", "name", "sourceDomain", "sourceTier", "requiresAccount", "awardAmount", "deadline",
    "estimatedEffortMinutes", "minGpa", "allowedMajors", "allowedEthnicities", "essayPrompts",
    "sourceName", "verifiedAt",
]


def read_catalog_json(spark: SparkSession, path: str) -> DataFrame:
    """Candidates from JSON arrays; risk flags trimmed, blanks dropped, distinct.

    A file that is no array of objects fails the job instead of giving empty rows.
    """
    raw = (
        spark.read.schema(CATALOG_JSON).option("multiLine", True).option("mode", "FAILFAST").json(path)
    )
    none = F.array().cast("array<string>")
    flags = F.array_distinct(
        F.filter(F.transform(F.coalesce("riskFlags", none), lambda x: F.trim(x)), lambda x: x != "")
    )
    e, i = "eligibility", "inferredRequirements"
    return raw.select(
        "id", "name",
        F.col("sourceDomain").alias("source_domain"),
        F.col("sourceTier").alias("source_tier"),
        nonblank("sourceUrl").alias("source_url"),
        F.col("sourceName").alias("source_name"),
        F.coalesce("requiresAccount", F.lit(False)).alias("requires_account"),
        F.coalesce("awardAmount", F.lit(0.0)).alias("award_amount"),
        nonblank("deadline").alias("deadline"),
        F.coalesce("estimatedEffortMinutes", F.lit(30)).alias("effort_minutes"),
        F.col(f"{e}.minGpa").alias("min_gpa"),
        F.coalesce(F.col(f"{e}.allowedMajors"), none).alias("allowed_majors"),
        F.coalesce(F.col(f"{e}.allowedEthnicities"), none).alias("allowed_ethnicities"),
        F.coalesce(F.col(f"{i}.requiredStates"), none).alias("required_states"),
        F.col(f"{i}.minAge").alias("min_age"),
        F.col(f"{i}.maxAge").alias("max_age"),
        F.coalesce(F.col(f"{i}.requirementStatements"), none).alias("statements"),
        F.coalesce("essayPrompts", none).alias("essay_prompts"),
        F.transform(
            "formFields",
            lambda f: F.struct(
                f["fieldName"].alias("field_name"), f["displayLabel"].alias("display_label"),
                f["sourcePath"].alias("source_path"), f["fieldType"].alias("field_type"),
                f["acceptedFileTypes"].alias("accepted_file_types"), f["essayPrompt"].alias("essay_prompt"),
                f["mappingReason"].alias("mapping_reason"),
            ),
        ).alias("form_fields"),
        F.coalesce(nonblank("status"), F.lit("pending")).alias("status"),
        F.col("reviewNotes").alias("review_notes"),
        F.col("reviewedBy").alias("reviewed_by"),
        F.try_to_timestamp(nonblank("reviewedAt")).alias("reviewed_at"),
        F.try_to_timestamp(nonblank("createdAt")).alias("created_at"),
        F.col("riskScore").alias("risk_score"),
        flags.alias("risk_flags"),
        F.col("recommendedTier").alias("recommended_tier"),
        F.coalesce("userSuggested", F.lit(False)).alias("user_suggested"),
    )


def read_catalog_csv(spark: SparkSession, path: str) -> DataFrame:
    """Vetted offers from CSV with pipe-separated lists; rows land approved."""
    schema = ", ".join(f"{c} STRING" for c in CATALOG_CSV)
    raw = spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)

    def number(c: str, kind: str) -> Column:
        return nonblank(F.trim(c)).try_cast(kind)

    tier = F.trim("sourceTier")
    return raw.select(
        F.trim("id").alias("id"),
        F.trim("name").alias("name"),
        F.trim("sourceDomain").alias("source_domain"),
        F.when(tier.isin(TIERS), tier).otherwise(TIERS[0]).alias("recommended_tier"),
        to_boolean(F.col("requiresAccount")).alias("requires_account"),
        F.coalesce(number("awardAmount", "double"), F.lit(0.0)).alias("award_amount"),
        nonblank(F.trim("deadline")).alias("deadline"),
        F.coalesce(number("estimatedEffortMinutes", "int"), F.lit(30)).alias("effort_minutes"),
        number("minGpa", "double").alias("min_gpa"),
        split_list(F.col("allowedMajors")).alias("allowed_majors"),
        split_list(F.col("allowedEthnicities")).alias("allowed_ethnicities"),
        split_list(F.col("essayPrompts")).alias("essay_prompts"),
        F.trim("sourceName").alias("source_name"),
        F.lit("approved").alias("status"),
        F.lit("csv-import").alias("reviewed_by"),
        F.try_to_timestamp(nonblank(F.trim("verifiedAt"))).alias("reviewed_at"),
    )


def document_type(name: Column) -> Column:
    low = F.lower(name)
    return (
        F.when(low.contains("uc"), "uc_application")
        .when(low.contains("scholarship"), "scholarship_application")
        .when(low.contains("private"), "private_school_application")
        .otherwise("other")
    )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Text files as one row each, with the type their name suggests."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_name").alias("document_id"),
        document_type(F.col("_metadata.file_name")).alias("document_type"),
        F.trim("value").alias("raw_text"),
        F.col("_metadata.file_modification_time").alias("uploaded_at"),
    )


PAYLOAD = "web STRUCT<results: ARRAY<STRUCT<title: STRING, url: STRING, description: STRING, page_age: STRING>>>"


def explode_search_payload(payloads: DataFrame, limit: int | None = None) -> DataFrame:
    """Ranked hits of each stored search answer.

    Entries without an http URL or a title go before ranks are given; everything
    happens within the payload's row.
    """
    parsed = F.coalesce(
        F.from_json("payload", PAYLOAD)["web"]["results"],
        F.array().cast("array<struct<title:string,url:string,description:string,page_age:string>>"),
    )
    good = F.filter(
        F.transform(
            parsed,
            lambda r: F.struct(
                clean(r["title"]).alias("title"), clean(r["url"]).alias("url"),
                clean(F.coalesce(nonblank(r["description"]), nonblank(r["page_age"]))).alias("snippet"),
            ),
        ),
        lambda r: r["url"].rlike("(?i)^https?://") & (r["title"] != ""),
    )
    keep = [c for c in payloads.columns if c != "payload"]
    return payloads.select(*keep, F.posexplode(first_items(good, limit)).alias("i", "r")).select(
        *keep, (F.col("i") + 1).alias("provider_rank"), "r.*"
    )


RUN_LOG = """
runId STRING, timestamp STRING, mode STRING, userStore STRING, userId STRING, status STRING, reason STRING,
counts STRUCT<discoveredByAgent: INT, importedCount: INT, pendingCount: INT, approvedCount: INT>
"""


def parse_run_log(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.col("runId").alias("run_id"),
        F.try_to_timestamp("timestamp").alias("ts"),
        "mode",
        F.col("userStore").alias("user_store"),
        F.col("userId").alias("user_id"),
        "status",
        "reason",
        F.col("counts.discoveredByAgent").alias("discovered"),
        F.col("counts.importedCount").alias("imported"),
        F.col("counts.pendingCount").alias("pending"),
        F.col("counts.approvedCount").alias("approved"),
    )


def newest(log: DataFrame, n: int, ts: str = "ts", tie: str = "run_id") -> DataFrame:
    """Newest ``n`` entries; planned as a bounded top-n, not a full sort."""
    return log.orderBy(F.col(ts).desc(), F.col(tie).desc()).limit(n)


def read_run_log(spark: SparkSession, path: str, n: int) -> DataFrame:
    """Newest ``n`` valid entries of JSONL logs; malformed lines are skipped."""
    raw = spark.read.schema(RUN_LOG).option("mode", "DROPMALFORMED").json(path)
    return newest(parse_run_log(raw).filter(F.col("ts").isNotNull()), n)
