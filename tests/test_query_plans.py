"""Planned queries are made in their profile's row, once."""

from pyspark.sql import functions as F

from oppweave.operators import queries as q


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_queries_are_planned_once_per_profile(spark):
    text = F.concat(F.lit("Biology "), F.col("id"))
    people = spark.range(20).repartition(3).select(
        F.col("id").alias("profile_id"), text.alias("intended_major"), F.lit("").alias("ethnicity"), F.lit("Texas").alias("state"),
        F.lit("").alias("grade_level"), F.when(F.col("id") % 2 == 0, "starting_college").otherwise("").alias("student_stage"),
    )
    planned = q.plan_queries(people, 12)
    assert _plan(planned).count("regexp_replace(") < 50
    assert not [line for line in _plan(planned).splitlines() if "Filter" in line and "regexp_replace(" in line]
    rows = planned.collect()
    assert len({r["profile_id"] for r in rows}) == 20 and all(r["query"] for r in rows)
    for k in range(20):
        mine = [r["query_ord"] for r in rows if r["profile_id"] == k]
        assert mine == list(range(1, len(mine) + 1)) and len(mine) > 5
