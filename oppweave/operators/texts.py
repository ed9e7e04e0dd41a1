"""Application documents: labelled values, entries, essays, prompts, form fields."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ranks import first_per, top_n
from ..functions.text import clean, flag, has, let, nonblank, first_items
from .safety import sensitive_name  # noqa: F401  (re-exported for form checks)

PAGE_MARK = r"^--\s*\d+\s+of\s+\d+\s*--$"

# Label phrases per profile field, in order of trial.
PROFILE_LABELS = {
    "firstName": ["first / given name", "first name"],
    "middleName": ["middle name"],
    "lastName": ["last / family / surname", "last name", "surname"],
    "personalInfo.fullName": ["student name", "name", "first / given name"],
    "personalInfo.email": ["email address", "email"],
    "personalInfo.phone": ["primary phone number", "phone"],
    "personalInfo.address": ["address", "mailing address"],
    "personalInfo.addressLine1": ["address line 1", "street address", "mailing address line 1"],
    "personalInfo.addressLine2": ["address line 2", "apt, suite, unit, building, etc.", "apartment", "suite"],
    "personalInfo.city": ["city"],
    "personalInfo.state": ["state/province", "state"],
    "personalInfo.postalCode": ["zip code", "postal code"],
    "personalInfo.country": ["country"],
    "personalInfo.dateOfBirth": ["when were you born?", "date of birth"],
    "personalInfo.intendedMajor": ["intended major", "academic major or interest", "major(s)"],
    "race": ["race/ethnicity"],
    "academics.schoolName": ["school you will graduate from", "school name", "high school name", "current school"],
    "academics.gradeLevel": ["current grade level", "select grade level"],
}

# Patterns of single facts.
STATE_FORMS = [
    r"(?:^|\n)\s*State\s*\t+([^\n]+)", r"(?:^|\n)\s*State\s*\n([^\n]+)",
    r"(?:^|\n)\s*State\s*:\s*([^\n]+)", r"(?:^|\n)\s*State/Province\s*\n([^\n]+)",
]
GPA_FORM = r"(?:gpa|grade point average)\s*:?\s*([0-9]+(?:\.[0-9]+)?)"
YEAR_FORM = r"(?:graduation year|class of)\s*:?\s*([0-9]{4})"
SCHOOL_FORM = r"High schools[\s\S]{0,300}?\n([A-Z][A-Z0-9 '&.\-]+SCHOOL)\n"
MAJORS_SECTION = r"(?i)Choose majors([\s\S]{0,4500})"
CAMPUS_LINE = r"(?i)^UC\s+(Davis|Merced|Riverside|Santa Barbara|Berkeley|Irvine|Los Angeles|San Diego|Santa Cruz)\s+"
NO_MAJOR = r"(undergraduate|undeclared|alternate major|school of|college of|campus\s+major|do you want to select)"
NO_STATE = "(student id|ssid|school code|code|number)"
LATINO_TABLE = r"hispanic\s*/\s*latino\s*\t+([^\n]+)"
LATINO_ANSWER = r"do you consider yourself hispanic or latino\?\s*(?:\t| )*yes"
ETHNICITY_FORM = r"(?:^|\n)\s*ethnicity\s*:\s*([^\n]+)"
LATINO_WORDS = r"\bhispanic\s*/\s*latino\b"
GRADES_SECTION = r"(?i)Grades attended([\s\S]{0,220})"
GRADE_LINE = r"^\d{1,2}(st|nd|rd|th)\s+grade$"
CITY_FORM = r"(?:^|\n)\s*City\s*\t+([^\n]+)"


def _words(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def plain_lines(lines: Column) -> Column:
    """Lines as padded lower-case words, worked out once for all labels."""
    return F.transform(lines, lambda x: F.concat(F.lit(" "), _words(x), F.lit(" ")))


def _plain(label: str) -> str:
    return " ".join("".join(ch if ch.isalnum() else " " for ch in label.lower()).split())


def _label_value(lines: Column, plain_words: Column, label: str, k: int) -> Column:
    """The label's values in the lines that hold it, with the line's and the label's place."""
    plain = _plain(label)

    def at(line: Column, i: Column) -> Column:
        named = F.get(plain_words, i).contains(f" {plain} ")
        rest = F.regexp_replace(F.ltrim(line), "^.{%d}" % len(label), "")
        after = F.when(
            F.lower(F.ltrim(line)).startswith(label), F.trim(F.regexp_replace(rest, r"^[:\-\t\s]+", ""))
        )
        following = F.filter(
            F.transform(F.slice(lines, i + 2, F.size(lines)), clean), lambda x: (x != "") & ~has(x, PAGE_MARK)
        )
        value = F.coalesce(
            nonblank(F.regexp_extract(line, r"\t+(.+)$", 1)),
            nonblank(F.regexp_extract(line, r":\s*(.+)$", 1)),
            nonblank(after),
            F.try_element_at(following, F.lit(1)),
        )
        return F.when(named, F.struct(i.alias("i"), F.lit(k).alias("k"), clean(value).alias("value")))

    return F.filter(F.transform(lines, at), lambda x: x.isNotNull())


def labelled(lines: Column, plain_words: Column, labels: list[str]) -> Column:
    """Value of the earliest line that holds one of the labels, in label order.

    Lines are read one by one only for a label that the text has at all.
    """
    none = F.array().cast("array<struct<i:int,k:int,value:string>>")

    def found(whole: Column) -> Column:
        each = [F.when(whole.contains(f" {_plain(x)} "), _label_value(lines, plain_words, x, k)).otherwise(none) for k, x in enumerate(labels)]
        return F.array_min(F.concat(*each))["value"]

    return let(F.array_join(plain_words, "\n"), found)


def label_values(documents: DataFrame, labels: dict[str, list[str]]) -> DataFrame:
    """Label and value claims of line-structured texts, one row per field found."""
    lines = F.split("raw_text", "\n")
    pairs = F.array(*[F.struct(F.lit(k).alias("field_path"), labelled(F.col("lines"), F.col("plain"), v).alias("value")) for k, v in labels.items()])
    keep = [c for c in documents.columns if c != "raw_text"]
    return (
        documents.withColumn("lines", lines)
        .withColumn("plain", plain_lines(F.col("lines")))
        .select(*keep, F.explode(F.filter(pairs, lambda p: nonblank(p["value"]).isNotNull())).alias("p"))
        .select(*keep, "p.*")
    )


def _primary_major(text: Column) -> Column:
    """First degree line that follows a campus line by at most five lines."""
    section = F.regexp_extract(text, MAJORS_SECTION, 1)
    lines = F.filter(F.transform(F.split(section, "\n"), clean), lambda x: (x != "") & ~has(x, PAGE_MARK))
    campus = CAMPUS_LINE
    junk = NO_MAJOR

    def pick(ls: Column) -> Column:
        def major(line: Column, i: Column) -> Column:
            start = F.greatest(i - 4, F.lit(1))
            near = F.slice(ls, start, i - start + 2)
            bare = clean(F.regexp_replace(F.regexp_replace(line, campus, ""), r"(?i),\s*B\.[A-Z.]+.*$", ""))
            ok = has(line, r",\s*B\.[A-Z.]+") & F.exists(near, lambda x: x.rlike(r"^UC\s+[A-Za-z]"))
            return F.when(ok & (bare != "") & ~has(bare, junk), bare)

        return F.try_element_at(F.filter(F.transform(ls, major), lambda x: x.isNotNull()), F.lit(1))

    return let(lines, pick)


def extract_claims(documents: DataFrame, confidence: float = 0.8) -> DataFrame:
    """Profile field claims of each document.

    ``documents(profile_id, document_id, doc_ord, raw_text)``.  Each document is
    read within its own row; no shuffle.
    """
    text = F.coalesce("raw_text", F.lit(""))
    d = documents.withColumns({"lines": F.split(text, "\n"), "low": F.lower(text)}).withColumn("plain", plain_lines(F.col("lines")))
    d = d.withColumns(
        {f"l_{i}": labelled(F.col("lines"), F.col("plain"), v) for i, v in enumerate(PROFILE_LABELS.values())}
    )
    at = {k: F.col(f"l_{i}") for i, k in enumerate(PROFILE_LABELS)}

    def holds(*words: str) -> Column:
        # A pattern reads only texts with a word that it cannot do without; lower-casing loses none of its matches.
        return reduce(or_, [F.col("low").contains(w) for w in words])

    def first(pattern: str, *words: str) -> Column:
        return F.when(holds(*words), nonblank(F.trim(F.regexp_extract(text, "(?im)" + pattern, 1))))

    state = F.try_element_at(
        F.filter(
            F.array(*[clean(F.coalesce(first(p, "state"), F.lit(""))) for p in STATE_FORMS]),
            lambda x: ~has(x, NO_STATE)
            & (x.rlike("^[A-Za-z]{2}$") | x.rlike(r"^[A-Za-z][A-Za-z .'-]{2,40}$")),
        ),
        F.lit(1),
    )
    latino = F.lit("hispanic/latino")
    ethnicity = (
        F.when(first(LATINO_TABLE, "hispanic").isNotNull(), latino)
        .when(holds("hispanic") & has(text, LATINO_ANSWER), latino)
        .otherwise(
            F.coalesce(
                first(ETHNICITY_FORM, "ethnicity"), at["race"], F.when(holds("hispanic") & has(text, LATINO_WORDS), latino)
            )
        )
    )
    grades = F.filter(
        F.transform(F.split(F.when(holds("grades attended"), F.regexp_extract(text, GRADES_SECTION, 1)).otherwise(""), "\n"), clean),
        lambda x: has(x, GRADE_LINE),
    )
    # Values that also enter the address are worked out once, in columns of their own.
    d = d.withColumns(
        {
            "v_city": F.coalesce(first(CITY_FORM, "city"), at["personalInfo.city"]),
            "v_zip": F.coalesce(first(r"(?:^|\n)\s*ZIP code\s*\t+([^\n]+)", "zip code"), at["personalInfo.postalCode"]),
            "v_state": F.coalesce(state, at["personalInfo.state"]),
        }
    )
    city, zip_, state = F.col("v_city"), F.col("v_zip"), F.col("v_state")
    name = F.concat_ws(" ", at["firstName"], at["middleName"], at["lastName"])
    address = F.concat_ws(
        ", ", at["personalInfo.addressLine1"], at["personalInfo.addressLine2"], city, state, zip_, at["personalInfo.country"]
    )
    plain = [
        "personalInfo.email", "personalInfo.phone", "personalInfo.addressLine1", "personalInfo.addressLine2",
        "personalInfo.country", "personalInfo.dateOfBirth",
    ]
    fields = {
        **{k: at[k] for k in plain},
        "personalInfo.fullName": F.coalesce(nonblank(name), at["personalInfo.fullName"]),
        "personalInfo.address": F.coalesce(nonblank(address), at["personalInfo.address"]),
        "personalInfo.city": city,
        "personalInfo.state": state,
        "personalInfo.postalCode": zip_,
        "personalInfo.intendedMajor": F.coalesce(F.when(holds("choose majors"), _primary_major(text)), at["personalInfo.intendedMajor"]),
        "personalInfo.ethnicity": ethnicity,
        "academics.gpa": first(GPA_FORM, "gpa", "grade point average"),
        "academics.graduationYear": first(YEAR_FORM, "graduation year", "class of"),
        "academics.schoolName": F.coalesce(nonblank(clean(F.coalesce(first(SCHOOL_FORM, "high schools"), F.lit("")))), at["academics.schoolName"]),
        "academics.gradeLevel": F.coalesce(at["academics.gradeLevel"], F.try_element_at(grades, F.lit(-1))),
    }
    pairs = F.array(*[F.struct(F.lit(k).alias("field_path"), c.alias("value")) for k, c in fields.items()])
    return d.select(
        "profile_id", "document_id", "doc_ord", F.explode(F.filter(pairs, lambda p: nonblank(p["value"]).isNotNull())).alias("p")
    ).select("profile_id", "doc_ord", "document_id", "p.field_path", "p.value", F.lit(confidence).alias("confidence"))


# Labels inside numbered entries of the activities section.
ENTRY_LABELS = [
    "program name", "program description", "activity name", "activity description", "course name",
    "course description", "organization, group or program name",
    "organization, group or program description", "description of volunteer experience",
    "name of the award or honor", "level of recognition", "type of award", "grade participation",
    "grade level when awarded", "time commitment", "award requirements",
    "what you did to earn award",
]


def segment_islands(lines: DataFrame, keys: list[str], order: list[str], header: Column) -> DataFrame:
    """Number the runs of lines that each header line starts, per key."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return lines.withColumn("segment", F.sum(flag(header).cast("int")).over(w))


def segment_entries(documents: DataFrame, labels: list[str] = ENTRY_LABELS) -> DataFrame:
    """Numbered entries of the activities section as (entry, label, text) rows.

    Works inside each document's row: the section is cut to lines, an entry runs to
    the next numbered line, a label's text to the next label.
    """
    lines = F.filter(F.transform(F.split("raw_text", "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~has(x, PAGE_MARK))

    def section(ls: Column) -> Column:
        def cut_from(start: Column) -> Column:
            rest = F.slice(ls, start + 1, F.size(ls))
            ends = F.filter(F.transform(rest, lambda x, i: F.when(has(x, "^personal insight"), i)), lambda x: x.isNotNull())
            return F.slice(rest, F.lit(1), F.coalesce(F.try_element_at(ends, F.lit(1)), F.size(rest)))

        starts = F.filter(
            F.transform(ls, lambda x, i: F.when(has(x, "^activities/awards$"), i + 1)), lambda x: x.isNotNull()
        )
        start = F.try_element_at(starts, F.lit(1))
        return F.when(start.isNotNull(), cut_from(start)).otherwise(F.array().cast("array<string>"))

    rows = documents.select(
        "profile_id", "document_id", F.posexplode(let(lines, section)).alias("pos", "line")
    )
    key = ["profile_id", "document_id"]
    header = r"^(\d+)\.\s+(.+)$"
    rows = segment_islands(rows, key, ["pos"], has("line", header)).filter("segment > 0")
    is_label = F.lower("line").isin(labels)
    part = [*key, "segment"]
    w = W.partitionBy(*part).orderBy("pos")
    rows = rows.withColumns(
        {
            "kind": F.first(F.when(has("line", header), clean(F.regexp_extract("line", header, 2))), ignorenulls=True).over(
                w.rowsBetween(W.unboundedPreceding, 0)
            ),
            "label": F.last(F.when(is_label, F.lower("line")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)),
        }
    )
    body = F.when(~is_label & ~has("line", header), F.struct("pos", "line"))
    return rows.groupBy(*part, "kind", "label").agg(
        clean(
            F.array_join(F.transform(F.sort_array(F.collect_list(body)), lambda x: x["line"]), " ")
        ).alias("text")
    )


def entry_summaries(entries: DataFrame) -> DataFrame:
    """One summary line per entry, as an activity or an award."""

    def get(label: str) -> Column:
        return nonblank(F.max(F.when(F.col("label") == label, F.col("text"))))

    e = entries.groupBy("profile_id", "document_id", "segment", "kind").agg(
        get("name of the award or honor").alias("award"),
        get("type of award").alias("award_type"),
        get("grade level when awarded").alias("grade"),
        F.coalesce(
            get("activity name"), get("program name"), get("course name"), get("organization, group or program name")
        ).alias("activity"),
        F.coalesce(
            get("activity description"), get("program description"), get("course description"),
            get("description of volunteer experience"), get("organization, group or program description"),
        ).alias("about"),
    )
    award = F.concat(
        F.coalesce("award", F.lit("Unnamed award")),
        F.coalesce(F.concat(F.lit(" ("), "award_type", F.lit(")")), F.lit("")),
        F.coalesce(F.concat(F.lit(" - "), "grade"), F.lit("")),
    )
    activity = F.concat(
        F.coalesce("activity", "kind"), F.coalesce(F.concat(F.lit(" - "), F.substring("about", 1, 160)), F.lit(""))
    )
    is_award = has("kind", "award or honor")
    return e.select(
        "profile_id", "document_id", "segment",
        F.when(is_award, "award").otherwise("activity").alias("list_kind"),
        clean(F.when(is_award, award).otherwise(activity)).alias("item"),
    )


def prefixed_items(documents: DataFrame) -> DataFrame:
    """Lines that start with ``Activity:`` or ``Award:``."""
    return (
        documents.select("profile_id", "document_id", "doc_ord", F.posexplode(F.split("raw_text", "\n")).alias("pos", "line"))
        .withColumn("kind", F.lower(F.regexp_extract(F.trim("line"), r"(?i)^(activity|award)\s*:", 1)))
        .filter("kind <> ''")
        .select(
            "profile_id", "kind", "doc_ord", "pos",
            F.trim(F.regexp_replace(F.trim("line"), r"(?i)^(activity|award)\s*:", "")).alias("item"),
        )
    )


# Openings of the essay prompts, and of responses.
PROMPT_STARTS = [
    "describe an example of your leadership experience",
    "describe how you have taken advantage of a significant educational opportunity",
    "describe the most significant challenge",
    "think about an academic subject that inspires you",
    "what have you done to make your school or your community a better place",
    "what would you say is your greatest talent or skill",
    "every person has a creative side",
    "beyond what has already been shared in your application",
]
RESPONSE_START = r"^(I|My|Ever|From|Growing|Since|When|As|Baseball|One|This|That)(?!\w)"


def segment_essays(documents: DataFrame, least: int = 400, most: int | None = None) -> DataFrame:
    """Prompt and response blocks, else long paragraphs, of each document.

    A block runs from one prompt opening to the next; its prompt takes up to four
    lines, ending before a response opening or after a line that ends a sentence.
    """
    text = F.coalesce("raw_text", F.lit(""))
    insight = F.regexp_extract(text, r"(?i)(Personal insight questions[\s\S]*?)(?:\n(?:Additional comments|Verified information)(?!\w)|\z)", 1)
    lines = F.filter(F.transform(F.split(insight, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~has(x, PAGE_MARK))
    opening = "^(" + "|".join(PROMPT_STARTS) + ")"
    shape = "array<struct<prompt:string,content:string>>"

    def blocks(ls: Column) -> Column:
        starts = F.filter(
            F.transform(ls, lambda x, i: F.when(clean(x).rlike("(?i)" + opening), i + 1)), lambda x: x.isNotNull()
        )

        def block(s: Column, j: Column, all_: Column) -> Column:
            stop = F.coalesce(F.try_element_at(all_, j + 2), F.size(ls) + 1)
            part = F.slice(ls, s, stop - s)

            def split(p: Column) -> Column:
                marks = F.filter(
                    F.transform(
                        F.slice(p, 2, 3),
                        lambda x, i: F.when(clean(x).rlike(RESPONSE_START), i + 1).when(x.rlike("[?.]$"), i + 2),
                    ),
                    lambda m: m.isNotNull(),
                )
                n = F.coalesce(F.try_element_at(marks, F.lit(1)), F.least(F.size(p), F.lit(4)))
                return let(
                    n,
                    lambda k: F.struct(
                        clean(F.array_join(F.slice(p, F.lit(1), k), " ")).alias("prompt"),
                        clean(F.array_join(F.slice(p, k + 1, F.size(p)), " ")).alias("content"),
                    ),
                )

            return let(part, split)

        return let(starts, lambda st: F.transform(st, lambda s, j: block(s, j, st)))

    good = F.filter(let(lines, blocks), lambda b: F.length(b["content"]) > 120)
    paragraphs = first_items(
        F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda x: F.trim(x)), lambda x: F.length(x) > least), most
    )
    plain = F.transform(paragraphs, lambda x: F.struct(F.lit(None).cast("string").alias("prompt"), x.alias("content")))
    essays = let(good.cast(shape), lambda g: F.when(F.size(g) > 0, g).otherwise(plain.cast(shape)))
    return documents.select("profile_id", "document_id", "doc_ord", F.posexplode(essays).alias("i", "e")).select(
        "profile_id", "document_id", "doc_ord",
        F.concat("document_id", F.lit("-essay-"), F.col("i") + 1).alias("essay_id"),
        "e.prompt", "e.content",
    )


# ---- essay prompts ---------------------------------------------------------------------------

# What spoils a prompt.
CODE_LIKE = [
    r"\b(width|height|margin|padding|font-size|line-height|background|display|position|border|color)\s*:\s*[^;]+;",
    r"(^|\s)[.#][a-z0-9_-]+\s+[a-z0-9_.#-]+\s*\{",
    r"```|</?[a-z][^>]*>|function\s*\(|const\s+[a-z0-9_]+\s*=|=>",
]
NOT_PROMPT = (
    r"\b(to be considered eligible|eligibility|read more about eligibility"
    r"|all applications must be received|no late applications|on the day of the deadline)\b"
)


def prompt_score(c: Column) -> Column:
    """How much a text looks like an essay prompt; code and rules score 0."""
    t = F.trim(c)
    low = F.lower(t)
    code = (t.rlike(r"\{[^{}]{1,240}\}") & t.rlike("[:;]")) | (F.regexp_count(t, F.lit(";")) >= 4)
    for p in CODE_LIKE:
        code = code | has(low, p)
    rules = (
        has(low, NOT_PROMPT)
        | (has(low, r"\bsubmit answer to the essay question\b") & has(low, r"\bfound on the application page\b"))
        | ((F.regexp_count(t, F.lit(r"(?<!\w)\d+\)\s+")) >= 2) & has(low, r"\bmust\b"))
    )
    # Prompt points.
    points = (
        F.when(low.contains("essay question"), 9).otherwise(0)
        + F.when(low.rlike("(essay|personal statement|short answer|long answer|writing prompt)"), 6).otherwise(0)
        + F.when(low.rlike("(why do you|describe|tell us|explain|how have|what does)"), 3).otherwise(0)
        + F.when(low.rlike("(minimum|max(imum)?|word|words|characters?)"), 2).otherwise(0)
        + F.when(t.contains("?"), 2).otherwise(0)
        - F.when(F.length(t) > 1400, 2).otherwise(0)
    )
    return F.when((F.length(t) < 24) | code | rules, 0).otherwise(points)


def word_limits(c: Column) -> Column:
    """Least, most and target words named by a prompt."""
    low = F.lower(F.coalesce(c, F.lit("")))

    def n(pattern: str, i: int = 1) -> Column:
        return F.regexp_extract(low, pattern, i).try_cast("int")

    dash = r"(?<!\w)(\d{2,4})\s*[-–]\s*(\d{2,4})\s*words?(?!\w)"
    between = r"(?<!\w)between\s+(\d{2,4})\s+and\s+(\d{2,4})\s+words?(?!\w)"
    a, b = F.coalesce(n(between, 1), n(dash, 1)), F.coalesce(n(between, 2), n(dash, 2))
    least = F.coalesce(n(r"(?<!\w)at\s+least\s+(\d{2,4})\s+words?(?!\w)"), n(r"(?<!\w)minimum\s+(\d{2,4})\s+words?(?!\w)"), F.least(a, b))
    most = F.coalesce(
        n(r"(?<!\w)up\s+to\s+(\d{2,4})\s+words?(?!\w)"), n(r"(?<!\w)max(?:imum)?\s*[:\-]?\s*(\d{2,4})\s+words?(?!\w)"),
        n(r"(?<!\w)maximum\s+(\d{2,4})\s+words?(?!\w)"), F.greatest(a, b),
    )

    def target(x: Column) -> Column:
        lo, hi = x["lo"], x["hi"]
        both = lo.isNotNull() & hi.isNotNull()
        small, big = F.when(both, F.least(lo, hi)).otherwise(lo), F.when(both, F.greatest(lo, hi)).otherwise(hi)
        # Target words.
        goal = (
            F.when(both, F.floor((lo + hi) / 2 + 0.5)).when(lo.isNotNull(), lo + 40)
            .when(hi.isNotNull(), F.greatest(F.lit(120), hi - 30)).otherwise(320)
        )
        return F.struct(small.alias("min_words"), big.alias("max_words"), goal.cast("int").alias("target_words"))

    return let(F.struct(least.alias("lo"), most.alias("hi")), target)


def essay_prompt_report(prompts: DataFrame, key: str) -> DataFrame:
    """Best prompt per key with its word limits; keys without one are left out."""
    scored = prompts.withColumn("prompt_score", prompt_score(F.col("text"))).filter("prompt_score > 0")
    best = first_per(scored, [key], [F.col("prompt_score").desc(), F.col("ord").asc()])
    after = F.regexp_replace(clean("text"), r"(?i)^.*?essay question:\s*", "")
    return best.withColumns({"prompt": after, "limits": word_limits(F.col("text"))}).select(
        key, "prompt_score", "prompt", "limits.*"
    )


# ---- form fields -----------------------------------------------------------------------------

# Descriptor words to profile path, first match wins; the first two go to a person.
FORM_RULES = [
    ("(ssn|social security|passport|credit card|cvv|security code|routing number|account number|bank)", None),
    ("(upload|attach|attachment|choose file|drop files|transcript|resume|cv)", None),
    ("(full name|legal name|applicant name|student name|name)", "personalInfo.fullName"),
    ("(email|e mail)", "personalInfo.email"),
    ("(phone|mobile|cell)", "personalInfo.phone"),
    ("(major|intended major|field of study|program of study)", "personalInfo.intendedMajor"),
    ("(gpa|grade point)", "academics.gpa"),
    ("(ethnicity|race|hispanic|latino|latinx|background)", "personalInfo.ethnicity"),
    ("(date of birth|birth date|dob)", "personalInfo.dateOfBirth"),
    ("(essay|personal statement|short answer|long answer|response)", "essays.0.content"),
]
# Fields that a form's page text reveals, (name, label, pattern, path, type).
FORM_CLUES = [
    ("street_address", "Street Address", "(street address|address line 1)", "personalInfo.addressLine1", None),
    ("address_line_2", "Address Line 2", "(apt|suite|unit|building|address line 2)", "personalInfo.addressLine2", None),
    ("city", "City", r"\bcity\b", "personalInfo.city", None),
    ("state_region", "State/Province/Region", "(state|province|region)", "personalInfo.state", None),
    ("postal_code", "Postal Code", "(postal code|zip code|zipcode)", "personalInfo.postalCode", None),
    ("country", "Country", r"\bcountry\b", "personalInfo.country", None),
    ("school_name", "School Name", "(school name|high school)", "academics.schoolName", None),
    ("grade_level", "Grade Level", "(grade level|current grade)", "academics.gradeLevel", None),
    ("transcript_upload", "Transcript Upload", "(upload transcript|transcript upload|transcript)", "__manual__.transcript_upload", "file"),
    ("personal_essay_upload", "Personal Essay Upload", "(upload personal essay|personal essay upload)", "__manual__.personal_essay_upload", "file"),
    ("personal_statement", "Personal Statement", "(personal statement|minimum 500 words|essay response|short answer)", "essays.0.content", "textarea"),
]


def manual_path(name: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.concat(F.lit("__manual__."), F.coalesce(nonblank(slug), F.lit("manual_field")))


def map_form_fields(fields: DataFrame, most: int | None = None) -> DataFrame:
    """Profile path of each raw form field, one row per name and label, ``most`` per form or all.

    ``fields(form_id, ord, name, id, display_label, placeholder, aria_label, type)``.
    """
    name = F.coalesce(*[nonblank(F.trim(c)) for c in ("name", "id", "display_label", "placeholder", "aria_label")])
    label = F.coalesce(
        *[nonblank(F.trim(c)) for c in ("display_label", "placeholder", "aria_label", "name", "id")], name
    )
    words = F.concat_ws(
        " ", label, *[nonblank(F.trim(c)) for c in ("placeholder", "aria_label", "name", "id", "type")]
    )
    df = fields.withColumns(
        {"field_name": name, "label": label, "__d": F.trim(F.regexp_replace(F.lower(words), "[^a-z0-9]+", " "))}
    ).filter(F.col("field_name").isNotNull())
    path = F.when(F.lit(False), F.lit(""))
    for pattern, target in FORM_RULES:
        path = path.when(F.col("__d").rlike(pattern), F.lit(target).cast("string"))
    df = df.withColumn("__p", path).withColumns(
        {
            "source_path": F.coalesce("__p", manual_path(F.col("field_name"))),
            "field_type": F.coalesce(nonblank("type"), F.lit("text")),
            "mapped": F.col("__p").isNotNull(),
            "__k": F.lower(F.concat_ws("::", "field_name", "label")),
        }
    )
    one = first_per(df, ["form_id", "__k"], [F.col("ord").asc()])
    return top_n(one, ["form_id"], [F.col("ord").asc()], most, "position").select(
        "form_id", "position", "field_name", "label", "field_type", "source_path", "mapped"
    )


def form_clues(forms: DataFrame, mapped: DataFrame) -> DataFrame:
    """Fields that only a form's page text reveals; ``forms(form_id, text)``."""
    clues = F.array_compact(
        F.array(
            *[
                F.when(
                    has(F.lower("text"), p),
                    F.struct(
                        F.lit(n).alias("field_name"), F.lit(lb).alias("label"), F.lit(sp).alias("source_path"),
                        F.lit(t).cast("string").alias("field_type"),
                    ),
                )
                for n, lb, p, sp, t in FORM_CLUES
            ]
        )
    )
    found = forms.select("form_id", F.inline(clues))
    have = mapped.select("form_id", F.lower("field_name").alias("field_name"))
    return found.join(have, ["form_id", "field_name"], "left_anti")
