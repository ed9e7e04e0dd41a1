import random

import pytest
from pyspark.sql import functions as F

from oppweave.functions import vocab as v
from oppweave.functions.lexicon import (
    stage_conflicts, stage_fits, state_code, student_stage, tag_states, tag_values,
)
from oppweave.functions.ranks import full_rank
from oppweave.functions.text import ascii_words, clean, clip, distinct_ci, has, tokens
from oppweave.functions.urls import base_domain, canonical_url, domain, path, resolve


@pytest.mark.parametrize(
    "raw,want",
    [
        ("HTTPS://WWW.Example.org/A/B//?x=1&ref=z#top", "https://www.example.org/A/B?x=1"),
        ("https://a.org", "https://a.org/"),
        ("https://a.org:443/x/", "https://a.org/x"),
        ("https://a.org/x?utm_source=feed", "https://a.org/x?utm_source=feed"),
        ("https://a.org/x?utm_=1&GCLID=2", "https://a.org/x"),
        ("  Not a   URL ", "not a url"),
        (None, ""),
    ],
)
def test_canonical_url(one, raw, want):
    assert one(canonical_url(F.lit(raw))) == want


def test_strip_utm_option(one):
    assert one(canonical_url(F.lit("https://a.org/x?utm_source=f&b=1"), True)) == "https://a.org/x?b=1"


def test_domain_parts(one):
    assert one(domain(F.lit("https://www.Sub.a.org:80/x"))) == "sub.a.org"
    assert one(base_domain(F.lit("x.sub.a.org"))) == "a.org"
    assert one(path(F.lit("https://a.org"))) == "/"
    assert one(path(F.lit("nope"))) == ""


@pytest.mark.parametrize(
    "href,want",
    [
        ("/x", "https://a.org/x"),
        ("y", "https://a.org/b/c/y"),
        ("./y", "https://a.org/b/c/y"),
        ("../y", "https://a.org/b/y"),
        ("../../../y", "https://a.org/y"),
        ("?q=1", "https://a.org/b/c/d?q=1"),
        ("//c.org/z", "https://c.org/z"),
        ("http://d.org/", "http://d.org/"),
        ("mailto:x@y", None),
    ],
)
def test_resolve(one, href, want):
    assert one(resolve(F.lit(href), F.lit("https://a.org/b/c/d?z=1"))) == want


def test_text_helpers(one):
    assert one(clean(F.lit(" a  b\n c "))) == "a b c"
    assert one(has(F.lit("über"), r"\bber\b")) is True
    assert one(has(F.lit("uber"), r"\bber\b")) is False
    assert one(clip(F.lit("abcdefghij"), 8)) == "abcde..."
    assert one(distinct_ci(F.array(F.lit("A b"), F.lit("a  B"), F.lit(" "), F.lit("c")))) == ["A b", "c"]
    assert one(tokens(F.lit("The cat, the CAT2!"))) == ["the", "cat", "cat2"]
    assert ascii_words(r"\b(a|b)\b|x\b(?!y)") == r"(?<!\w)(a|b)(?!\w)|x(?!\w)(?!y)"


def test_one_scan_equals_rule_by_rule(spark):
    rnd = random.Random(7)
    words = (
        "civil engineering biomedical computer science math arts art fine stem pre-med medical african american "
        "indian asian native hawaiian black latino mena software informatics the of"
    ).split()
    rows = [(i, " ".join(rnd.choice(words) for _ in range(9))) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, t string")
    for rules in (v.MAJORS, v.ETHNICITIES):
        diff = df.select("t", tag_values("t", rules).alias("a"), tag_values("t", rules, False).alias("b")).filter("a <> b")
        assert diff.count() == 0


def test_states(one):
    got = one(tag_states(F.lit("West  Virginia and virginia, also NM or new york")))
    assert got == ["NM", "NY", "OR", "VA", "WV"]
    assert one(state_code(F.lit(" california "))) == "CA"
    assert one(state_code(F.lit("tx"))) == "TX"
    assert one(state_code(F.lit("Bavaria"))) == "Bavaria"


def test_stages(one):
    def arr(*x):
        return F.array(*[F.lit(s) for s in x]) if x else F.array().cast("array<string>")

    assert one(student_stage(F.lit(""), F.lit("12th grade"))) == "starting_college"
    assert one(student_stage(F.lit(""), F.lit("college sophomore"))) == "in_college"
    start = F.lit("starting_college")
    assert one(stage_fits(arr("undergraduate"), start)) is True
    assert one(stage_fits(arr("undergraduate", "graduate"), start)) is False
    assert one(stage_conflicts(arr("undergraduate", "graduate"), start)) is True
    assert one(stage_conflicts(arr(), start)) is False


@pytest.mark.parametrize("parts", [1, 7])
def test_full_rank_equals_plain_window(spark, parts):
    rnd = random.Random(3)
    # One key holds most rows, and many scores tie.
    rows = [(0 if rnd.random() < 0.8 else rnd.randint(1, 4), i, float(rnd.randint(0, 5))) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, ord int, s double").repartition(parts)
    got = full_rank(df, ["k"], [F.col("s").desc(), F.col("ord")], "r")
    want = {}
    for k in range(5):
        for r, x in enumerate(sorted((x for x in rows if x[0] == k), key=lambda x: (-x[2], x[1])), 1):
            want[(k, x[1])] = r
    assert {(x.k, x.ord): x.r for x in got.collect()} == want
