"""Search queries per profile from template families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import state_code
from ..functions.text import clean, distinct_ci, let, nonblank, norm

# Stage words of query texts.
STAGE_WORDS = {
    "starting_college": ["incoming college freshman", "high school senior", "first year college"],
    "in_college": ["undergraduate", "college student", "university student"],
    "transfering_college": ["transfer student", "college transfer", "undergraduate transfer"],
    "12": ["high school senior", "incoming college freshman"],
    "11": ["high school junior scholarship", "high school scholarship"],
    "": ["college scholarship", "student scholarship", "undergraduate scholarship"],
}

# Query templates. {m} major, {e} ethnicity, {s} state, {0} {1} {2} stage words.
# A template whose hole has no value is left out.
SPECIFIC = [
    "{m} scholarship {0}", "{m} scholarship {s} {0}", "{e} {m} scholarship {0}",
    "{m} scholarship incoming freshman", "{m} scholarship first-year student",
    "{m} scholarship {s} incoming freshman", "{e} {m} incoming freshman scholarship",
    "{m} scholarship {2}", "{e} scholarship {2}",
]
BROAD_STARTING = [
    "{m} scholarships {0}", "{0} {m} scholarship", "{e} scholarship {0}", "{s} {0} scholarship",
    "{m} scholarship {1}", "{m} scholarship {s} {1}", "{e} {m} scholarship {1}",
    "{e} scholarship {s} {0}", "{m} scholarship {2}", "{s} {2} scholarship",
    "{m} scholarship {s} first-year student", "{m} STEM scholarship {0}", "{e} {m} scholarship",
    "{e} STEM scholarship {s} {0}", "{s} {1} scholarship", "STEM scholarship {0}",
    "college freshman scholarship {s}",
]
BROAD = [
    "{m} undergraduate scholarship", "{m} undergraduate scholarship {s}", "{m} scholarships {0}",
    "{0} {m} scholarship", "{e} scholarship {0}", "{s} {0} scholarship", "{m} scholarship {1}",
    "{m} scholarship {s} {1}", "{e} {m} scholarship {1}", "{e} scholarship {s} {0}",
    "{m} scholarship {2}", "{s} {2} scholarship", "{m} scholarship undergraduate freshman",
    "{m} scholarship {s} first-year student", "{m} STEM scholarship", "{e} {m} scholarship",
    "{e} STEM scholarship {s}", "{s} {1} scholarship",
]
GENERIC_STARTING = [
    "{0} scholarship", "{s} {0} no essay scholarship", "{s} college freshman scholarship",
    "no essay scholarship incoming freshman", "scholarship open to all majors incoming freshman",
    "easy apply scholarship incoming freshman", "college freshman no essay scholarship",
    "STEM scholarship incoming freshman", "high school senior scholarship",
    "college freshman scholarship",
]
GENERIC = [
    "{0} scholarship", "{s} {0} no essay scholarship", "{s} no essay scholarship",
    "no essay scholarship undergraduate", "no essay scholarship incoming freshman",
    "scholarship open to all majors undergraduate", "easy apply scholarship undergraduate",
    "general undergraduate scholarship", "college freshman no essay scholarship",
    "STEM scholarship open to all majors", "scholarship open to all students",
    "college scholarship application",
]

# Direct-link strategies.
_DIRECT = [
    "{m} scholarship apply {0}", "{m} scholarship deadline {0}", "{m} scholarship eligibility {0}",
    "{m} scholarship award {0}", "{s} {m} scholarship apply {0}", "{e} {m} scholarship apply {0}",
    "{e} STEM scholarship deadline {0}", "{0} scholarship apply",
]
STRATEGIES = {
    "control": [],
    "direct_action_mix": _DIRECT,
    "direct_action_precision": _DIRECT,
    "singular_detail_mix": [
        "{m} scholarship {0}", "{m} scholarship incoming freshman", "{m} scholarship deadline incoming freshman",
        "{m} scholarship eligibility incoming freshman", "{s} {m} scholarship incoming freshman",
        "{e} {m} scholarship incoming freshman", "{e} scholarship incoming freshman",
        "incoming freshman scholarship apply",
    ],
    "control_plus_singular": [
        "{m} scholarship {0}", "{m} scholarship {s} {0}", "{e} {m} scholarship {0}",
        "{m} scholarship incoming freshman", "{m} scholarship first-year student", "{0} {m} scholarship",
        "{e} scholarship {0}", "{0} scholarship", "{m} award incoming freshman",
        "{S} engineering scholarship incoming freshman",
    ],
    "singular_synonym_mix": [
        "{m} scholarship incoming freshman", "{m} award incoming freshman", "{m} grant incoming freshman",
        "{e} {m} scholarship incoming freshman", "{e} engineering award incoming freshman",
        "{S} engineering scholarship incoming freshman", "incoming freshman scholarship {m}",
        "first-year student {m} scholarship", "incoming freshman STEM scholarship",
        "{e} scholarship incoming freshman",
    ],
    "detail_phrase_mix": [
        "{m} scholarship incoming freshman", "{m} scholarship deadline incoming freshman",
        "{m} scholarship eligibility incoming freshman", "{m} scholarship award incoming freshman",
        "{e} {m} scholarship incoming freshman", "{e} scholarship deadline incoming freshman",
        "{S} engineering scholarship incoming freshman", "incoming freshman scholarship apply",
        "first-year student scholarship engineering", "incoming freshman STEM scholarship",
    ],
}


def query_budget(total: int, aggressive: bool = False) -> tuple[int, int, int]:
    """Queries for the specific, broad and generic family."""
    total = max(1, int(total))
    if total <= 2:
        return min(1, total), max(0, total - 1), 0
    if total <= 4:
        return 2, max(1, total - 3), 1
    share_s, share_b = (0.42, 0.33) if aggressive else (0.5, 0.3)
    s, b = max(3, int(total * share_s + 0.5)), max(2, int(total * share_b + 0.5))
    g = max(1, total - s - b)
    while s + b + g > total:
        if s > b and s > 3:
            s -= 1
        elif b > 2:
            b -= 1
        elif g > 1:
            g -= 1
        else:
            break
    while s + b + g < total:
        if aggressive and g <= b:
            g += 1
        elif b <= s:
            b += 1
        else:
            s += 1
    return s, b, g


def search_phrase(c: Column | str) -> Column:
    """A field value as query words: degrees and punctuation dropped."""
    t = clean(c)
    for pattern in (r"(?i)(?<!\w)B\.?\s*S\.?(?!\w)", r"(?i)(?<!\w)B\.?\s*A\.?(?!\w)", r"(?i)(?<!\w)Bachelor(?:'s)?(?!\w)"):
        t = F.regexp_replace(t, pattern, "")
    t = F.regexp_replace(t, r"[().,/]", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"\s+[.-]\s*$", ""), r"\s+[.-]\s+", " ")
    return clean(t)


def _fill(templates: list[str], holes: dict[str, Column]) -> Column:
    filled = []
    for t in templates:
        out = F.lit(t)
        for hole, value in holes.items():
            if hole in t:
                # A NULL value makes the whole query NULL, which drops it.
                out = F.replace(out, F.lit(hole), value)
        filled.append(out)
    return F.array_compact(F.array(*filled)) if filled else F.array().cast("array<string>")


def query_families(profiles: DataFrame) -> DataFrame:
    """The three families of each profile as arrays, distinct in template order."""
    stage, grade = norm("student_stage"), norm("grade_level")

    def words(key: str) -> Column:
        return F.array(*[F.lit(x) for x in STAGE_WORDS[key]])

    df = profiles.withColumns(
        {
            "m": nonblank(search_phrase("intended_major")),
            "e": nonblank(search_phrase("ethnicity")),
            "s": nonblank(state_code("state")),
            "starting": (stage == "starting_college") | grade.contains("12"),
            "w": F.when(stage.isin("starting_college", "in_college", "transfering_college"),
                        F.when(stage == "starting_college", words("starting_college"))
                        .when(stage == "in_college", words("in_college")).otherwise(words("transfering_college")))
            .when(grade.contains("12"), words("12")).when(grade.contains("11"), words("11")).otherwise(words("")),
        }
    )
    holes = {
        "{m}": F.col("m"), "{e}": F.col("e"), "{s}": F.col("s"),
        "{S}": F.when(F.col("s") == "CA", "California").otherwise(F.col("s")),
        **{"{%d}" % i: F.try_element_at("w", F.lit(i + 1)) for i in range(3)},
    }
    df = df.withColumns(
        {
            "specific": distinct_ci(_fill(SPECIFIC, holes), True),
            "broad": distinct_ci(F.when(F.col("starting"), _fill(BROAD_STARTING, holes)).otherwise(_fill(BROAD, holes)), True),
            "generic": distinct_ci(F.when(F.col("starting"), _fill(GENERIC_STARTING, holes)).otherwise(_fill(GENERIC, holes)), True),
            **{f"direct_{k}": distinct_ci(_fill(t, holes), True) for k, t in STRATEGIES.items() if t},
        }
    )
    return df.drop("m", "e", "s", "w")


def with_site_hints(families: DataFrame, domains: list[str]) -> DataFrame:
    """Queries aimed at up to three hinted domains, added to the families in turn.

    A hint goes to the specific family while that has room (18), then to the broad
    one, then to the generic one.
    """
    picked = list(dict.fromkeys(d.strip() for d in domains if d.strip()))[:3]
    if not picked:
        return families
    base = F.concat("specific", "broad", "generic")
    share = F.greatest(F.lit(2), F.ceil(F.size("__base") / len(picked)).cast("int"))
    df = families.withColumn("__base", base).withColumn("__head", F.slice(F.col("__base"), F.lit(1), share))

    def aimed(site: str) -> Column:
        return F.transform("__head", lambda q: F.concat(F.lit(f"site:{site} "), q))

    sites = F.flatten(F.array(*[aimed(d) for d in picked]))
    room_s, room_b = F.greatest(F.lit(0), 18 - F.size("specific")), F.greatest(F.lit(0), 18 - F.size("broad"))
    df = df.withColumn("__sites", distinct_ci(sites, True))
    n = F.size("__sites")
    return df.withColumns(
        {
            "specific": F.concat("specific", F.slice(F.col("__sites"), F.lit(1), room_s)),
            "broad": F.concat("broad", F.slice(F.col("__sites"), room_s + 1, room_b)),
            "generic": F.concat("generic", F.slice(F.col("__sites"), room_s + room_b + 1, n)),
        }
    ).drop("__base", "__head", "__sites")


def plan_queries(
    profiles: DataFrame, total: int = 12, strategy: str = "control", aggressive: bool = False,
    domains: list[str] | None = None, avoid: list[str] | None = None,
) -> DataFrame:
    """Query rows per profile, within the budget of each family.

    ``avoid`` are domains kept out by some of the queries.  All work stays in the
    profile's row; templates are literals, so there is no join.
    """
    s, b, g = query_budget(total, aggressive)
    f = with_site_hints(query_families(profiles), domains or [])
    direct = F.col(f"direct_{strategy}") if STRATEGIES.get(strategy) else F.array().cast("array<string>")
    parts = [direct, F.slice("specific", 1, s), F.slice("broad", 1, b)]
    if strategy != "singular_detail_mix" and g:
        parts.append(F.slice("generic", 1, g))
    base = F.slice(distinct_ci(F.concat(*parts), True), 1, total)
    avoid = (avoid or [])[:3]
    starting = norm("student_stage") == "starting_college"

    def diversify(q: Column) -> Column:
        room = F.greatest(F.lit(1), total - len(avoid) - F.when(starting, 1).otherwise(0))
        at = lambda i: q[F.pmod(F.lit(i), F.greatest(F.size(q), F.lit(1)))]
        extra = [F.concat(at(i), F.lit(f" -site:{d}")) for i, d in enumerate(avoid)]
        extra.append(F.when(starting, F.concat(q[0], F.lit(" -graduate -fellowship -phd -masters"))))
        more = distinct_ci(F.concat(F.slice(q, F.lit(1), room), F.array_compact(F.array(*extra))), True)
        return F.slice(more, 1, total)

    out = f.withColumn("queries", let(base, diversify))
    # The outer form, as Spark would filter profiles by their planned queries at the scan, and so plan them there as well.
    rows = out.select("profile_id", F.posexplode_outer("queries").alias("i", "query"))
    return rows.filter("i IS NOT NULL").select("profile_id", (F.col("i") + 1).alias("query_ord"), "query")
