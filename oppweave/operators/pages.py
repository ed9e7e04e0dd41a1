"""Page text, sentences, facts, evidence and staleness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as v
from ..functions.lexicon import tag_states, tag_values
from ..functions.text import clean, clip, col, distinct_ci, first_items, find, find_all, first_items, has, let, nonblank
from ..functions.urls import canonical_url, domain
from .hits import years_are_stale

# Named entities, decoded in this order.
ENTITIES = [
    ("&nbsp;", " "), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
    ("&lt;", "<"), ("&gt;", ">"),
]
NO_STRINGS = "array<string>"


def _numeric(text: Column, pattern: str, forms: list[str], radix: int) -> Column:
    """Replace numeric character references; the loop runs over distinct codes."""
    codes = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))

    def step(acc: Column, code: Column) -> Column:
        low16 = F.right(F.concat(F.lit("0000"), F.conv(code, radix, 16)), F.lit(4))
        char = F.decode(F.unhex(low16), "UTF-16BE")
        for form in forms:
            acc = F.replace(acc, F.concat(F.lit(form), code, F.lit(";")), char)
        return acc

    return F.aggregate(codes, text, step)


def decode_entities(c: Column | str) -> Column:
    def named(t: Column) -> Column:
        for name, char in ENTITIES:
            t = F.regexp_replace(t, f"(?i){name}", char)
        return t

    def numbered(x: Column) -> Column:
        return F.when(~x.contains("&#"), x).otherwise(
            let(
                _numeric(x, r"&#(\d+);", ["&#"], 10),
                lambda y: _numeric(y, "(?i)&#x([0-9a-f]+);", ["&#x", "&#X"], 16),
            )
        )

    # A text without an ampersand has no entity.
    return let(col(c), lambda t: F.when(~t.contains("&"), t).otherwise(let(named(t), numbered)))


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", " ")


def html_text(html: Column | str) -> Column:
    t = F.coalesce(col(html), F.lit(""))
    for tag in ("script", "style", "noscript"):
        t = F.regexp_replace(t, f"(?is)<{tag}.*?</{tag}>", " ")
    return clean(decode_entities(strip_tags(t)))


def _meta(html: Column, attr: str, value: str) -> Column:
    pattern = f"<meta[^>]+{attr}=[\"']{value}[\"'][^>]+content=[\"']([^\"']+)[\"'][^>]*>"
    return clean(decode_entities(F.regexp_extract(html, "(?i)" + pattern, 1)))


def page_text(pages: DataFrame, max_html: int | None = None, max_text: int | None = None) -> DataFrame:
    """Visible text and title of each page; the html column is dropped.

    The limits are off by default so that whole pages are read.
    """
    html = F.coalesce("html", F.lit(""))
    if max_html:
        html = F.substring(html, 1, max_html)
    text = html_text(html)
    if max_text:
        text = F.substring(text, 1, max_text)
    out = pages.withColumns(
        {
            "text": text,
            "heading": clean(decode_entities(strip_tags(F.regexp_extract(html, "(?is)<h1[^>]*>(.*?)</h1>", 1)))),
            "document_title": F.coalesce(
                nonblank(_meta(html, "property", "og:title")),
                nonblank(_meta(html, "name", "twitter:title")),
                clean(decode_entities(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1))),
            ),
            "n_anchors": F.size(F.regexp_extract_all(html, F.lit(r"(?i)<a(?!\w)"), F.lit(0))),
            "canonical_url": canonical_url("url"),
            "source_domain": domain("url"),
        }
    )
    h, d = F.col("heading"), F.col("document_title")
    prefer_doc = (h != "") & (d != "") & has(d, v.KEYWORD) & ~has(h, v.KEYWORD)
    return out.withColumn(
        "title", F.when(prefer_doc, d).otherwise(F.coalesce(nonblank(h), nonblank(d), clean("url")))
    ).drop("html")


def sentences(text: Column | str) -> Column:
    """Sentences of at least 20 characters."""
    parts = F.split(F.coalesce(col(text), F.lit("")), r"\s(?<=[.!?]\s)\s*|[\r\n]+")  # the blank first: it is rarer
    return F.filter(F.transform(parts, clean), lambda s: F.length(s) >= 20)


def is_requirement(s: Column) -> Column:
    return has(s, v.REQUIREMENT) | (
        has(s, v.REQUIREMENT_SUBJECT) & has(s, v.REQUIREMENT_DETAIL) & has(s, v.REQUIREMENT_MODAL)
    )


def with_sentences(df: DataFrame, text_col: str = "text", most: int | None = None) -> DataFrame:
    """Add the sentence, requirement and stage-sentence arrays of each row."""
    return (
        df.withColumn("sentences", sentences(text_col))
        .withColumn("requirements", first_items(F.filter("sentences", is_requirement), most))
        .withColumn("stage_sentences", F.filter("sentences", lambda s: has(s, v.STAGE_SENTENCE)))
    )


def page_sentences(df: DataFrame, key: str, text_col: str = "text", most: int | None = None) -> DataFrame:
    """Sentence rows with position; the first ``most`` requirement sentences, or all, are numbered."""
    joined = df.select(key, sentences(text_col).alias("__s")).withColumn(
        "__req",
        first_items(
            F.filter(F.transform("__s", lambda s, i: F.when(is_requirement(s), i)), lambda i: i.isNotNull()), most
        ),
    )
    return joined.select(key, "__req", F.posexplode("__s").alias("pos", "sentence")).select(
        key,
        "pos",
        "sentence",
        F.nullif(F.array_position("__req", F.col("pos")), F.lit(0)).alias("requirement_rank"),
    )


# ---- facts -----------------------------------------------------------------------------------


def award_amount(text: Column | str) -> Column:
    """Largest plausible amount, near an award word if there is one."""

    def amounts(found: Column) -> Column:
        values = F.transform(found, lambda m: F.regexp_replace(m, r"[$,\s]", "").try_cast("double"))
        return F.filter(values, lambda x: (x > 0) & (x <= 250000))

    near = F.concat(
        find_all(text, v.MONEY_AFTER), find_all(text, v.MONEY_BEFORE)
    )
    return F.coalesce(
        F.array_max(amounts(near)), F.array_max(amounts(find_all(text, v.MONEY, 0))), F.lit(0.0)
    )


def _month(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in v.MONTHS.items() for x in kv])
    return F.try_element_at(table, F.lower(name))


def normalize_date(raw: Column) -> Column:
    """ISO form of a date text; without a year, or unreadable, it is empty."""

    def build(r: Column) -> Column:
        mdy = r"^(\d{1,2})/(\d{1,2})/(\d{2,4})$"
        named = r"^([A-Za-z]{3,9})\s+(\d{1,2}),\s*(\d{4})$"
        year = F.regexp_extract(r, mdy, 3)
        day = F.regexp_extract(r, named, 2).try_cast("int")
        month = _month(F.substring(F.regexp_extract(r, named, 1), 1, 3))
        date = F.date_add(
            F.try_make_timestamp(
                F.regexp_extract(r, named, 3).try_cast("int"), month, F.lit(1), F.lit(0), F.lit(0), F.lit(0)
            ).cast("date"),
            day - 1,
        )
        return (
            F.when(r.rlike(r"^\d{4}-\d{2}-\d{2}$"), r)
            .when(
                r.rlike(mdy),
                F.concat_ws(
                    "-",
                    F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(F.lpad(year, 4, "0")),
                    F.lpad(F.regexp_extract(r, mdy, 1), 2, "0"),
                    F.lpad(F.regexp_extract(r, mdy, 2), 2, "0"),
                ),
            )
            .when(
                r.rlike(named) & month.isNotNull() & day.between(1, 31),
                F.date_format(date, "yyyy-MM-dd"),
            )
            .otherwise("")
        )

    return let(clean(raw), build)


# The phrases behind a look at their first letters, which most places of a text fail.
_DEADLINE_LEADS = [f"(?=[{letters}]){lead}" for letters, lead in zip(("ads", "ac"), v.DEADLINE_LEADS, strict=True)]


def deadline(text: Column | str, leads: list[str] | None = None) -> Column:
    """Date after a deadline phrase, by the first pattern that matches."""
    found = [
        nonblank(find(text, lead + v.DEADLINE_GAP + form))
        for lead in (leads or _DEADLINE_LEADS)
        for form in v.DEADLINE_FORMS
    ]
    return normalize_date(F.coalesce(*found, F.lit("")))


# The month and the day as one group, so that a text is read once for both.
_PARTIAL_DEADLINE = v.PARTIAL_DEADLINE.replace(r"([A-Z][a-z]{2,8})\s+(\d{1,2})", r"([A-Z][a-z]{2,8}\s+\d{1,2})")


def partial_deadline(text: Column | str) -> Column:
    """Month and day of a deadline given without a year, as a struct."""

    def one(lead: str) -> Column:
        both = find(text, lead + v.DEADLINE_GAP + _PARTIAL_DEADLINE)
        words = let(both, lambda x: F.split(x, r"\s+"))
        return let(
            let(
                words,
                lambda w: F.struct(
                    _month(w[0]).alias("month"), F.try_element_at(w, F.lit(2)).try_cast("int").alias("day")
                ),
            ),
            lambda d: F.when(d["month"].isNotNull() & d["day"].between(1, 31), d),
        )

    return F.coalesce(*[one(lead) for lead in _DEADLINE_LEADS])


def first_number(text: Column | str, patterns: list[str]) -> Column:
    return F.coalesce(*[nonblank(find(text, p)).try_cast("double") for p in patterns])


def essay_prompts(sents: Column, most: int | None = None) -> Column:
    cut = F.transform(
        F.filter(sents, lambda s: has(s, v.ESSAY_CUE)),
        lambda s: F.when(F.length(s) > 260, F.concat(F.substring(s, 1, 257), F.lit("..."))).otherwise(s),
    )
    return let(cut, lambda c: first_items(distinct_ci(c), most))


def page_facts(text_df: DataFrame, prompts: int | None = None) -> DataFrame:
    """Award, deadline, GPA, ages, account and closed flags, essay prompts.

    Input is ``page_text`` plus ``with_sentences``.
    """
    reqs = F.array_join("requirements", " ")
    return text_df.withColumns(
        {
            "award_amount": award_amount("text"),
            "deadline": deadline("text"),
            "partial_deadline": partial_deadline("text"),
            "min_gpa": first_number(reqs, v.MIN_GPA),
            "min_age": first_number(reqs, [v.MIN_AGE]).cast("int"),
            "max_age": first_number(reqs, [v.MAX_AGE]).cast("int"),
            "requires_account": has("text", v.ACCOUNT),
            "closed_words": has("title", v.CLOSED) | has("text", v.CLOSED),
            "essay_prompts": essay_prompts(F.col("sentences"), prompts),
        }
    )


def evidence_snippets(df: DataFrame, size: int = 400) -> DataFrame:
    """First sentence for each evidence facet, cut to ``size`` characters."""
    s, r, st = F.col("sentences"), F.col("requirements"), F.col("stage_sentences")
    source = {
        "deadline": s,
        "eligibility": F.when(F.size(r) > 0, r).otherwise(s),
        "amount": s,
        "stage": F.when(F.size(st) > 0, st).when(F.size(r) > 0, r).otherwise(s),
        "closed": s,
    }

    def first(facet: str) -> Column:
        patterns = v.EVIDENCE[facet]

        def hit(x: Column) -> Column:
            out = F.lit(False)
            for p in patterns:
                out = out | has(x, p)
            return out

        return F.try_element_at(F.filter(source[facet], hit), F.lit(1))

    return df.withColumns(
        {
            f"{k}_snippet": let(first(k), lambda s: F.when(s.isNotNull(), clip(s, size)))
            for k in v.EVIDENCE
        }
    )


def expired_deadline(iso: Column, as_of: str) -> Column:
    today = F.date_format(F.lit(as_of).cast("timestamp"), "yyyy-MM-dd")
    return iso.rlike(r"^\d{4}-\d{2}-\d{2}$") & (iso < today)


def expired_partial(partial: Column, as_of: str) -> Column:
    now = F.lit(as_of).cast("timestamp")
    m, d = partial["month"], partial["day"]
    return F.coalesce(
        (m < F.month(now)) | ((m == F.month(now)) & (d < F.dayofmonth(now))), F.lit(False)
    )


def stale_flags(facts: DataFrame, as_of: str) -> DataFrame:
    """Stale-cycle, expired and closed flags of each page."""
    year = F.year(F.lit(as_of).cast("timestamp"))
    return facts.withColumns(
        {
            "stale_cycle": years_are_stale(F.concat_ws(" ", "title", "text"), year, v.STALE_WORDS_PAGE),
            "expired": expired_deadline(F.col("deadline"), as_of)
            | expired_partial(F.col("partial_deadline"), as_of),
            "closed": F.col("closed_words"),
        }
    )


def stale_shares(flags: DataFrame) -> DataFrame:
    """Share of stale, expired and closed pages per domain."""
    return flags.groupBy("source_domain").agg(
        F.count("*").alias("n_pages"),
        *[F.round(F.avg(F.col(c).cast("int")), 3).alias(f"{c}_share") for c in ("stale_cycle", "expired", "closed")],
    )


def tag_lexicon(
    df: DataFrame, text_col: str, rules: list[tuple[str, list[str]]], out: str, scan_once: bool = False
) -> DataFrame:
    """Distinct values of a rule list per row."""
    return df.withColumn(out, tag_values(text_col, rules, scan_once))


def tag_all(df: DataFrame, text_col: str) -> DataFrame:
    """Fields of study, ethnicities, states and required stages named in a text."""
    return df.withColumns(
        {
            "majors": tag_values(text_col, v.MAJORS),
            "ethnicities": tag_values(text_col, v.ETHNICITIES),
            "states": tag_states(text_col),
            "stages": tag_values(text_col, v.REQUIRED_STAGES, scan_once=False),
        }
    )


def classify_fetch(pages: DataFrame, max_html: int | None = None) -> DataFrame:
    """Outcome of each fetch: ok, error or unsupported content type."""
    status = F.coalesce("http_status", F.lit(0))
    ctype = F.coalesce("content_type", F.lit(""))
    outcome = (
        F.when(~status.between(200, 299), "error")
        .when((ctype != "") & ~ctype.rlike("(?i)html|xml"), "unsupported_content_type")
        .otherwise("ok")
    )
    html = F.coalesce("html", F.lit(""))
    if max_html:
        html = F.substring(html, 1, max_html)
    return pages.withColumns(
        {
            "fetch_status": outcome,
            "canonical_url": canonical_url("url"),
            "source_domain": domain("url"),
            "access_blocked": outcome != "ok",
            "html": F.when(outcome == "ok", html).otherwise(""),
        }
    )
