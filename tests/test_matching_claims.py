import random

from oppweave.operators import claims as c
from oppweave.operators import expansion as e
from oppweave.operators import matching as m

PROFILE = "profile_id string, intended_major string, ethnicity string, gpa string"
OFFER = (
    "id string, ord int, award_amount double, deadline string, effort_minutes int, requires_account boolean, "
    "min_gpa double, allowed_majors array<string>, allowed_ethnicities array<string>"
)


def offers(spark):
    return spark.createDataFrame(
        [
            ("a", 1, 100.0, "2026-05-01", 30, False, 3.0, ["engineering"], []),
            ("b", 2, 100.0, None, 10, True, None, [], []),
            ("c", 3, 100.0, "2026-04-01", 30, False, None, [], ["latino"]),
            ("d", 4, 500.0, "soon", 30, False, 3.5, [], []),
            ("e", 5, 100.0, None, 10, False, None, [], []),
        ],
        OFFER,
    )


def people(spark):
    return spark.createDataFrame(
        [("p", "mechanical engineering", "latino", "3.2"), ("q", None, "", "n/a"), ("r", "  ", "x", "2.0")], PROFILE
    )


def scored(spark, account=True):
    from pyspark.sql import functions as F

    both = people(spark).select("profile_id", F.explode(F.array(*[F.lit(x) for x in "abcde"])).alias("id"))
    return m.with_fit(m.match_eligibility(people(spark), offers(spark), both, account)).withColumn("essay_score", F.lit(0.0))


def test_eligibility_and_fit(spark):
    got = {(x.profile_id, x.id): x for x in scored(spark, False).collect()}
    assert got["p", "a"].status == "eligible" and got["p", "a"].fit_score == 1.0
    assert got["p", "d"].status == "ineligible" and got["p", "d"].failed_rules == ["GPA below minimum (3.5)"]
    assert got["q", "a"].status == "needs_human_review"
    assert got["q", "a"].missing_info == ["Missing GPA (minimum required is 3.0)", "Missing intended major"]
    # A blank major matches every rule in the evaluator, but not in the fit score.
    assert got["r", "a"].failed_rules == ["GPA below minimum (3.0)"] and got["r", "a"].fit_score == 0.0
    assert got["p", "b"].fit_score == 0.5 and got["p", "b"].excluded_reason == m.ACCOUNT_REASON
    assert got["p", "a"].excluded_reason is None


def test_rank_ties(spark):
    rows = m.rank_offers(scored(spark), 5).filter("profile_id = 'p'").orderBy("rank").collect()
    # Award, fit, deadline (missing last), effort, then catalog order.
    assert [x.id for x in rows] == ["d", "c", "a", "b", "e"]


def test_essays(spark):
    prompts = spark.createDataFrame([("a", "Why do you code?"), ("b", "...")], "id string, prompt string")
    essays = spark.createDataFrame([("p", "I code. You do?"), ("p", "code")], "profile_id string, content string")
    pairs = spark.createDataFrame([("p", "a"), ("p", "b"), ("z", "a")], "profile_id string, id string")
    got = {(x.profile_id, x.id): x.essay_score for x in m.essay_containment(prompts, essays, pairs).collect()}
    assert got == {("p", "a"): 0.75, ("p", "b"): 0.0, ("z", "a"): 0.0}


def test_drafts(spark):
    form = "profile_id string, id string, form_fields array<struct<field_name:string,field_type:string,source_path:string>>"
    df = spark.createDataFrame(
        [("p", "a", [("cv", "FILE", "x"), ("SSN", "text", "v"), ("mail", "text", "v"), ("pass", "text", "w"), ("none", "text", "z")])], form
    )
    vals = spark.createDataFrame([("p", "v", "me@x.org"), ("p", "w", "AB12345")], "profile_id string, source_path string, value string")
    got = {x.field_name: (x["mode"], x.masked_preview) for x in m.draft_fields(df, vals).collect()}
    assert got == {
        "cv": ("manual", None), "SSN": ("manual", "***.org"), "mail": ("autofill", None), "pass": ("manual", "***2345"), "none": ("manual", None)
    }


CLAIM = "profile_id string, doc_ord int, document_id string, field_path string, value string, confidence double"


def test_claims_against_plain_loop(spark):
    rnd = random.Random(5)
    rows = []
    for p in "ab":
        for d in range(40):
            rows.append((p, d, f"d{d}", "f", rnd.choice(["", "x", "y", "z"]), rnd.choice([0.5, 0.8, 0.9])))
    df = spark.createDataFrame(rows, CLAIM)
    want, conflicts = {}, []
    for p, d, doc, f, val, conf in rows:
        if not val:
            continue
        cur = want.get(p)
        if cur is None:
            want[p] = (val, conf, doc)
        elif conf > cur[1]:
            if cur[0] != val:
                conflicts.append((p, d, cur[0], val, val, doc))
            want[p] = (val, conf, doc)
        elif cur[0] != val:
            conflicts.append((p, d, cur[0], val, cur[0], cur[2]))
    got = {x.profile_id: (x.value, x.confidence, x.document_id) for x in c.merge_claims(df).collect()}
    assert got == want
    out = c.claim_conflicts(df).collect()
    assert sorted(
        (x.profile_id, x.doc_ord, x.previous_value, x.incoming_value, x.chosen_value, x.chosen_source) for x in out
    ) == sorted(conflicts)


def test_overrides_and_model_values(spark):
    f = c.MODEL_FIELDS
    win = spark.createDataFrame([("p", f[0], "old", 0.8, "d"), ("p", f[1], "keep", 0.9, "d")], "profile_id string, field_path string, value string, confidence double, document_id string")
    over = spark.createDataFrame([("p", f[0], " new "), ("p", f[1], " ")], "profile_id string, field_path string, value string")
    got = {x.field_path: (x.value, x.confidence, x.document_id) for x in c.apply_overrides(win, over).collect()}
    assert got == {f[0]: ("new", 1.0, "human_input"), f[1]: ("keep", 0.9, "d")}
    model = spark.createDataFrame(
        [("p", f[0], "m", 0.8, 1), ("p", f[1], "m", 0.95, 1), ("p", f[2], "lo", 0.54, 1), ("p", f[3], "ok", 0.55, 1), ("p", "x.y", "no", 1.0, 1)],
        "profile_id string, field_path string, value string, confidence double, ord int",
    )
    got = {x.field_path: x.value for x in c.merge_model_values(win, model).collect()}
    assert got == {f[0]: "old", f[1]: "m", f[3]: "ok"}


def test_candidate_fit(spark):
    cand = spark.createDataFrame(
        [
            ("p", "a", 999.0, "2026-01-01", ["physics"], [], [], None, ["incoming_freshman"], 0),
            ("p", "b", 0.0, "", [], [], ["CA"], 3.5, ["graduate"], 20),
        ],
        "profile_id string, id string, award_amount double, deadline string, allowed_majors array<string>, allowed_ethnicities array<string>, "
        "required_states array<string>, min_gpa double, required_stages array<string>, global_rank int",
    )
    prof = spark.createDataFrame([("p", "physics", "", "California", "", "starting_college", "")], PROFILE.replace("gpa string", "state string, gpa string, student_stage string, grade_level string"))
    got = {x.id: x for x in e.score_candidate_fit(cand, prof).collect()}
    assert got["a"].score == 10.6 and got["a"].reasons == ["award:999", "deadline", "major_match", "stage_match"]
    assert got["b"].score == 1.5 and got["b"].blockers == ["gpa_mismatch", "stage_mismatch_graduate"]
    assert got["a"].is_eligible and not got["b"].is_eligible
