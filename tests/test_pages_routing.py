import pytest
from pyspark.sql import functions as F

from oppweave.operators import bundles as bu
from oppweave.operators import links as li
from oppweave.operators import pages as p
from oppweave.operators import routing as r
from oppweave.operators import safety as sa

AS_OF = "2026-03-10 12:00:00"


@pytest.mark.parametrize(
    "text,want",
    [
        ("Deadline: March 5, 2027.", "2027-03-05"),
        ("Apply by 3/5/27", "2027-03-05"),
        ("Applications due Sept 9, 2026", "2026-09-09"),
        ("Deadline: November 1", ""),
        ("Closing date: 12/31/2026", "2026-12-31"),
        ("nothing here", ""),
    ],
)
def test_deadline(one, text, want):
    assert one(p.deadline(F.lit(text))) == want


def test_facts(one):
    assert one(p.award_amount(F.lit("Fee $90. Award of $1,500 and grant up to $2,000.50"))) == 2000.5
    assert one(p.award_amount(F.lit("Costs $90 or $70"))) == 90.0
    assert one(p.award_amount(F.lit("award $999,999"))) == 0.0
    assert one(p.partial_deadline(F.lit("deadline March 3 each year"))).asDict() == {"month": 3, "day": 3}
    assert one(p.partial_deadline(F.lit("deadline March 3, 2026"))) is None
    assert one(p.expired_partial(p.partial_deadline(F.lit("deadline March 3")), AS_OF)) is True
    assert one(p.expired_deadline(F.lit("2026-03-10"), AS_OF)) is False
    assert one(p.first_number(F.lit("a minimum of 3.25 GPA"), p.v.MIN_GPA)) == 3.25


def test_entities(one):
    assert one(p.decode_entities(F.lit("a&amp;b&nbsp;&#65;&#x42;&#8364;&#36;"))) == "a&b AB€$"
    assert one(p.html_text(F.lit("<p>a</p><script>var t='</p>';</script><b>c</b>"))) == "a c"


def page(spark, rows):
    return spark.createDataFrame(
        rows, "page_id int, url string, html string, http_status int, content_type string"
    ).withColumns(
        {"intended_major": F.lit("physics"), "ethnicity": F.lit(""), "state": F.lit(""), "grade_level": F.lit(""), "student_stage": F.lit("starting_college")}
    )


def test_title_choice_and_fetch_status(spark):
    rows = [
        (1, "https://a.org/x", "<title>Big Grant</title><h1>Welcome</h1>", 200, "text/html"),
        (2, "https://a.org/y", "<meta property=\"og:title\" content=\"OG\"><h1>Head</h1>", 200, ""),
        (3, "https://a.org/z", "", 200, "application/xhtml+xml"),
        (4, "https://a.org/p", "x", 200, "application/pdf"),
        (5, "https://a.org/q", "x", 404, "text/html"),
    ]
    df = p.classify_fetch(page(spark, rows))
    assert [x.fetch_status for x in df.orderBy("page_id").collect()] == ["ok", "ok", "ok", "unsupported_content_type", "error"]
    titles = {x.page_id: x.title for x in p.page_text(df).collect()}
    assert titles == {1: "Big Grant", 2: "Head", 3: "https://a.org/z", 4: "https://a.org/p", 5: "https://a.org/q"}


def test_links(spark):
    html = (
        "<a href='/scholarships/blue'>Blue scholarship</a><a class=x href=\"/scholarships/blue/\">Blue scholarship award</a>"
        "<a href='#top'>Scholarship</a><a href='mailto:a@b'>apply</a><a href='/f.pdf'>Award form</a><a href='/contact'>Award contact</a>"
        "<a href='https://o.org/apply?ref=1'>Apply</a><a href='page'>Nothing</a><a href='/here'>program</a>"
    )
    df = page(spark, [(1, "https://www.a.org/here", html, 200, "text/html")])
    got = {(x.position, x.url, x.same_domain, x.detail_path_likely) for x in li.page_links(df).collect()}
    assert got == {
        (1, "https://www.a.org/scholarships/blue", True, True),
        (2, "https://www.a.org/scholarships/blue", True, True),
        (7, "https://o.org/apply", False, False),
    }
    best = li.best_links(li.page_links(df)).orderBy("page_rank").collect()
    assert [(x.position, x.page_rank) for x in best] == [(2, 1), (7, 2)]
    crawl = li.page_links(df, p.v.LINK_KEEP_CRAWL, p.v.LINK_DROP_CRAWL, crawl=True).collect()
    assert {x.url for x in crawl} == {"https://www.a.org/scholarships/blue", "https://www.a.org/scholarships/blue/"}


SIGNALS = ["direct", "hub", "list", "deadline", "amount", "eligibility", "application", "indirect", "aggregator", "original_source"]
BLOCK = ["closed", "past_cycle", "stage_mismatch", "access_blocked"]
FIT = ["major", "ethnicity", "state", "stage", "institution", "school"]
EVID = ["deadline", "eligibility", "amount", "stage", "closed"]


def bundle(spark, rows):
    def struct(names, on, kind):
        return ("struct<" + ",".join(f"{n}:{kind}" for n in names) + ">", on)

    ddl = (
        "run_id string, page_id int, ord bigint, title string, canonical_url string, source_domain string, "
        f"evidence {struct(EVID, 0, 'string')[0]}, blockers {struct(BLOCK, 0, 'boolean')[0]}, "
        f"fit {struct(FIT, 0, 'boolean')[0]}, signals {struct(SIGNALS, 0, 'boolean')[0]}"
    )
    data = []
    for i, (title, dom, on, evidence) in enumerate(rows):
        data.append(
            (
                "r", i, i, title, f"https://{dom}/p{i}", dom, tuple(evidence.get(e) for e in EVID),
                tuple(b in on for b in BLOCK), tuple("fit_" + f in on for f in FIT), tuple(x in on for x in SIGNALS),
            )
        )
    return spark.createDataFrame(data, ddl)


def link_rows(spark, rows):
    return spark.createDataFrame(
        rows, "page_id int, position int, url string, anchor_text string, source_domain string, same_domain boolean, detail_path_likely boolean, seen_recently boolean"
    )


FULL = {"deadline", "amount", "eligibility", "application"}
PROOF = {"eligibility": "For a high school senior, verified by the scholarship providing organization"}


def test_triage_rules_in_order(spark):
    cases = [
        ("T", "a.org", {"access_blocked", "direct"}, {}, "access"),
        ("T", "a.org", {"closed", "past_cycle"}, {}, "closed"),
        ("T", "a.org", {"past_cycle", "stage_mismatch"}, {}, "past"),
        ("T", "a.org", {"stage_mismatch", "direct"}, {}, "stage_direct"),
        ("T", "a.org", {"stage_mismatch"}, {}, "stage"),
        ("What is FAFSA", "a.org", set(), {}, "explainer"),
        ("Blue Scholarship", "a.org", {"direct", "deadline", "amount"}, {}, "strong"),
        ("Blue Scholarship", "a.org", {"direct", "deadline"}, {"amount": "$5"}, "strong"),
        ("Blue Scholarship", "x.scholarships360.org", {"aggregator", "list"} | FULL, PROOF, "trusted"),
        ("Top 5 scholarships", "x.org", {"aggregator", "list"} | FULL, PROOF, "mirror_hold"),
        ("Blue", "x.org", {"original_source"}, {}, "mirror_drop"),
        ("Hub", "a.org", {"hub"}, {}, "gateway"),
        ("List", "a.org", {"list", "fit_school"}, {}, "school_narrow"),
        ("Blog", "a.org", {"indirect"}, {}, "indirect"),
        ("Dept", "a.org", {"fit_school"}, {}, "school"),
        ("Plain", "a.org", set(), {}, "default"),
    ]
    b = bundle(spark, [c[:4] for c in cases])
    links = link_rows(
        spark, [(i, 1, f"https://l.org/{i}", "Named award", "l.org", False, False, False) for i in (9, 11, 12)]
    )
    got = {x.page_id: x.rule for x in r.triage_pages(b, links, ["page_id"]).collect()}
    assert [got[i] for i in range(len(cases))] == [c[4] for c in cases]
    spent = {x.page_id: x.action for x in r.triage_pages(b, links, ["page_id"], 0, 1).collect()}
    assert spent[11] == "drop"
    control = {x.page_id: x.rule for x in r.triage_pages(b, links, ["page_id"], variant="control").collect()}
    assert control[8] == "mirror_drop"


def test_children(spark):
    b = bundle(spark, [("Agg", "agg.org", {"aggregator", "original_source"}, {}), ("Hub", "a.org", {"hub"}, {}), ("Shut", "a.org", {"closed"}, {})])
    rows = [
        (0, 1, "https://s.org/apply", "Official website", "s.org", False, False, False),
        (0, 2, "https://agg.org/x", "Blue scholarship", "agg.org", True, True, False),
        (1, 1, "https://a.org/login", "Login", "a.org", True, False, False),
        (1, 2, "https://a.org/b", "Blue award", "a.org", True, False, False),
        (1, 3, "https://a.org/c", "Red award", "a.org", True, True, True),
        (1, 4, "https://d.edu/e", "Green grant", "d.edu", False, True, False),
        (2, 1, "https://a.org/z", "Blue award", "a.org", True, True, False),
    ]
    out = r.select_children(link_rows(spark, rows), b, ["page_id"]).collect()
    assert {(x.page_id, x.url) for x in out if x.selected} == {
        (0, "https://s.org/apply"), (1, "https://a.org/b"), (1, "https://d.edu/e")
    }
    scores = {x.url: x.child_score for x in out}
    assert scores["https://d.edu/e"] == 5.5 and scores["https://a.org/login"] == -6.0 and scores["https://a.org/c"] == -4.0
    assert not [x for x in out if x.page_id == 2]


def test_leads(spark):
    b = bundle(spark, [("Agg page", "agg.org", {"aggregator"}, {}), ("Hub", "a.org", {"hub"}, {})])
    rows = [
        (0, 1, "https://s.org/blue-fund.html", "Learn more", "s.org", False, False, False),
        (0, 2, "https://agg.org/guide", "Scholarship guide", "agg.org", True, False, False),
        (0, 3, "https://s.org/x?clickid=1", "Blue scholarship", "s.org", False, True, False),
        (1, 1, "https://a.org/juniors", "Award for juniors", "a.org", True, False, False),
        (1, 2, "https://a.org/ok", "Red award", "a.org", True, True, False),
    ]
    leads, rejected = r.extract_leads(link_rows(spark, rows), b, ["page_id"], "starting_college", total=2)
    got = {x.lead_url: (x.lead_name, x.lead_type, x.verification_priority, x.needs_verification) for x in leads.collect()}
    assert got == {
        "https://s.org/blue-fund.html": ("Blue Fund", "official_source", "high", False),
        "https://a.org/ok": ("Red award", "scholarship_detail", "medium", False),
    }
    assert {x.url for x in rejected.collect()} == {"https://agg.org/guide", "https://s.org/x?clickid=1", "https://a.org/juniors"}


@pytest.mark.parametrize(
    "name,value,want",
    [
        ("ssn", "x", True), ("note", "123-45-6789", True), ("note", "123456789", True), ("note", "12345678", False),
        ("note", "4111111111111111", True), ("note", "AB12345", True), ("note", "ABCDEFG", False), ("note", "ab12345", False),
        ("Driver's License", "", True),
    ],
)
def test_sensitive(one, name, value, want):
    assert one(sa.is_sensitive(F.lit(name), F.lit(value))) is want


def test_candidates_and_reviews(spark):
    text = "Applicants must be enrolled. "
    rows = [
        (1, "https://a.org/scholarships/blue", f"<h1>Blue Scholarship</h1><p>Award $500. Deadline: May 1, 2027. {text}</p>", 200, "text/html"),
        (2, "https://a.org/", "<h1>Welcome</h1><p>Scholarship office apply</p>", 200, "text/html"),
        (3, "https://a.org/x", "<h1>Red Award</h1><p>Applications closed</p>", 200, "text/html"),
    ]
    pages = p.page_facts(p.with_sentences(p.page_text(p.classify_fetch(page(spark, rows)))))
    none = spark.createDataFrame([], "page_id int, n_links int")
    got = {x.page_id: x for x in bu.extract_candidates(pages, none, AS_OF).collect()}
    assert got[1].skip_reason is None and got[1].award_amount == 500.0 and got[1].deadline == "2027-05-01"
    assert got[2].skip_reason == "insufficient_scholarship_signals" and got[3].skip_reason == "scholarship_closed"
