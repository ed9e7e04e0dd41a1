"""Texts are read no more often than their columns need, with the same results."""

import random
import re

from pyspark.sql import functions as F

from oppweave.functions import vocab as v
from oppweave.functions.lexicon import _first_letters, tag_states, tag_values
from oppweave.functions.text import WS, clean
from oppweave.operators import links as li
from oppweave.operators import pages as p


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_anchors_are_shaped_once_and_pages_without_links_give_no_row(spark):
    body = F.when(F.col("id") > 0, "<a href='/scholarships/one'>One scholarship</a><a href='/x'></a>").otherwise("plain")
    pages = spark.range(3).select(
        F.col("id").alias("page_id"), F.concat(F.lit("https://WWW.a.org/p/"), F.col("id")).alias("url"), body.alias("html")
    )
    links = li.page_links(pages)
    assert not [line for line in _plan(links).splitlines() if "Filter" in line and "transform(" in line]
    got = links.collect()
    assert sorted(r["page_id"] for r in got) == [1, 2]
    assert {(r["url"], r["source_domain"], r["same_domain"], r["position"]) for r in got} == {("https://www.a.org/scholarships/one", "a.org", True, 1)}


def test_clean_collapses_every_run_of_blanks(spark):
    rnd = random.Random(7)
    texts = ["".join(rnd.choice("ab. \t\n\xa0 ﻿\x1c\u0085é") for _ in range(rnd.randrange(14))) for _ in range(400)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", clean("t").alias("c")).collect()
    blank = re.compile(WS.replace(r"\s", r" \t\n\x0b\f\r") + "+")
    assert all(r["c"] == blank.sub(" ", r["t"]).strip(" ") for r in got)


def test_sentences_split_after_marks_as_before(spark):
    rnd = random.Random(8)
    texts = ["".join(rnd.choice(["word and more words here", ".", "!", " ", "\n", "\t", "x"]) for _ in range(12)) for _ in range(200)]
    old = F.split("t", r"(?<=[.!?])\s+|[\r\n]+")
    want = F.filter(F.transform(old, clean), lambda s: F.length(s) >= 20)
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(want.alias("a"), p.sentences("t").alias("b")).collect()
    assert all(r["a"] == r["b"] for r in rows) and any(len(r["a"]) > 1 for r in rows)


def test_a_partial_deadline_is_one_read_per_phrase(spark):
    df = spark.range(1).select(F.concat(F.lit("Closing date: March 3 "), F.col("id")).alias("t"))
    got = df.select(p.partial_deadline("t").alias("d"))
    assert _plan(got).count("regexp_extract(") == len(v.DEADLINE_LEADS)
    assert got.first()["d"].asDict() == {"month": 3, "day": 3}


def test_states_are_the_words_and_names_of_the_table(one):
    state = lambda t: one(tag_states(F.lit(t)))
    assert state("TX, new  york and Washington") == ["NY", "TX", "WA"]
    assert state("texas_x caé 4ok newyork") == ["CA"]  # words end at letters that are not ASCII, not at underscores
    assert state("nothing there") == [] and state(None) == []


def test_rules_with_other_starts_are_not_gated(one):
    assert _first_letters([(r"\bone\b|\btwo\b", ["x"])]) == "(?=[ot])"
    assert _first_letters([(r"(one|two)", ["x"])]) == "" and _first_letters([(r"\bx?one", ["x"])]) == ""
    assert one(tag_values(F.lit("A Physics major, not unphysics; pre-med"), v.MAJORS)) == ["physics", "medicine"]
