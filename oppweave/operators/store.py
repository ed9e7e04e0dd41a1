"""Candidate store: normal form, risk, dedupe, reviews, queue and export."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as v
from ..functions.ranks import running_max
from ..functions.text import clean, listed, nonblank, num
from ..functions.urls import canonical_url, domain, path
from ..session import cut, near

NONE = "array<string>"


def slugify(c: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.substring(s, 1, 80)


def split_list(c: Column) -> Column:
    """Pipe-separated text as a list without blanks."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\|"), lambda x: F.trim(x)), lambda x: x != "")


def to_boolean(c: Column) -> Column:
    return F.coalesce(F.trim(c.cast("string")).rlike("(?i)^(true|1|yes)$"), F.lit(False))


def normalize_candidates(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates in normal form, and the rows that lack a name or domain.

    Defaults: award 0, effort 30, status pending.  A missing id is the name's slug
    and a hash of the row's keys, so that a rerun gives the same id.
    """
    named = nonblank("name").isNotNull()
    placed = nonblank("source_domain").isNotNull()
    bad = raw.filter(~named | ~placed).withColumn(
        "reject_reason",
        F.when(~named, "Candidate missing required field: name").otherwise(
            "Candidate missing required field: sourceDomain"
        ),
    )
    suffix = F.substring(
        F.lower(F.hex(F.xxhash64("name", "source_domain", F.coalesce("source_url", F.lit(""))))), 1, 8
    )
    good = raw.filter(named & placed).withColumns(
        {
            "id": F.coalesce(nonblank(F.trim("id")), F.concat_ws("-", slugify(F.col("name")), suffix)),
            "name": F.trim("name"),
            "source_domain": F.trim("source_domain"),
            "source_url": F.trim(F.coalesce("source_url", F.lit(""))),
            "source_name": F.trim(F.coalesce("source_name", F.lit(""))),
            "award_amount": F.coalesce("award_amount", F.lit(0.0)),
            "deadline": F.trim(F.coalesce("deadline", F.lit(""))),
            "effort_minutes": F.when(F.coalesce("effort_minutes", F.lit(0)) == 0, 30).otherwise(F.col("effort_minutes")),
            "requires_account": to_boolean(F.col("requires_account")),
            "status": F.lit("pending"),
        }
    )
    return good, bad


def identity_keys(canonical: bool = False) -> Column:
    """The identity keys of a record: id, URL, (name, domain), as far as it has them."""
    url = canonical_url("source_url") if canonical else F.lower(F.trim("source_url"))
    name, dom = F.lower(F.trim("name")), F.lower(F.trim("source_domain"))
    return F.array_compact(
        F.array(
            F.when(nonblank(F.col("id").cast("string")).isNotNull(), F.concat(F.lit("id:"), F.col("id").cast("string"))),
            F.when(nonblank("source_url").isNotNull(), F.concat(F.lit("url:"), url)),
            F.when(
                nonblank("name").isNotNull() & nonblank("source_domain").isNotNull(),
                F.concat(F.lit("name_domain:"), name, F.lit("::"), dom),
            ),
        )
    )


def typed_keys(df: DataFrame, row: str, canonical: bool = False) -> DataFrame:
    """One row per identity key of each record: id, URL, (name, domain).

    Equality on these keys replaces an OR over three columns, which Spark could
    only plan as a nested loop.
    """
    return df.select(row, F.explode(identity_keys(canonical)).alias("key"))


def known_keys(df: DataFrame, canonical: bool = False) -> DataFrame:
    """Distinct identity keys of a table."""
    return typed_keys(df.withColumn("__none", F.lit(0)), "__none", canonical).select("key").distinct()


def anti_known(candidates: DataFrame, known: DataFrame, row: str) -> DataFrame:
    """Candidates that share no identity key with a known record."""
    seen = (
        typed_keys(candidates, row, canonical=True)
        .join(known_keys(known, canonical=True), "key", "left_semi")
        .select(row)
        .distinct()
    )
    return candidates.join(seen, row, "left_anti")


def catalog_duplicates(candidates: DataFrame, catalog: DataFrame, row: str) -> DataFrame:
    """First catalog offer with the candidate's domain or id."""
    dom = F.lower(F.coalesce("source_domain", F.lit("")))
    mine = candidates.select(
        row,
        F.explode(F.array(F.concat(F.lit("d:"), dom), F.concat(F.lit("i:"), F.coalesce(F.col("id").cast("string"), F.lit("\0"))))).alias("key"),
    )
    theirs = catalog.select(
        F.explode(F.array(F.concat(F.lit("d:"), F.col("source_domain")), F.concat(F.lit("i:"), F.col("id").cast("string")))).alias("key"),
        F.struct("ord", F.col("id").cast("string").alias("id")).alias("offer"),
    ).groupBy("key").agg(F.min("offer").alias("offer"))
    return mine.join(theirs, "key").groupBy(row).agg(F.min("offer").alias("offer")).select(
        row, F.col("offer.id").alias("duplicate_id")
    )


def candidate_risk(candidates: DataFrame, catalog: DataFrame, row: str) -> DataFrame:
    """Risk score 0..100, flags and the tier they suggest."""
    df = candidates.join(catalog_duplicates(candidates, catalog, row), row, "left")
    dom = F.lower(F.coalesce("source_domain", F.lit("")))
    url = F.lower(F.coalesce("source_url", F.lit("")))

    def first(words: list[str], test) -> Column:
        out = F.when(F.lit(False), F.lit(""))
        for w in words:
            out = out.when(test(w), F.lit(w))
        return out

    tld = first(v.RISKY_TLDS, lambda w: dom.endswith(w))
    word = first(v.RISKY_KEYWORDS, lambda w: dom.contains(w))
    df = df.withColumns({"__tld": tld, "__word": word})
    checks = [
        # Risk points.
        (dom == "", F.lit("missing_source_domain"), 35),
        ((url != "") & ~url.startswith("https://"), F.lit("non_https_source_url"), 20),
        (F.col("__tld").isNotNull(), F.concat(F.lit("high_risk_tld:"), "__tld"), 35),
        (F.col("__word").isNotNull(), F.concat(F.lit("suspicious_keyword:"), "__word"), 30),
        (F.col("duplicate_id").isNotNull(), F.concat(F.lit("already_exists_in_catalog:"), "duplicate_id"), 20),
        (nonblank("deadline").isNull(), F.lit("missing_deadline"), 10),
        (nonblank("source_name").isNull(), F.lit("missing_source_name"), 8),
        (~F.coalesce("has_eligibility", F.lit(False)), F.lit("missing_eligibility_details"), 8),
    ]
    total = sum((num(c, p) for c, _, p in checks), F.lit(0.0))
    df = df.withColumns(
        {
            "risk_score": F.least(F.lit(100), F.greatest(F.lit(0), total.cast("int"))),
            "risk_flags": listed(*[(c, f) for c, f, _ in checks]),
        }
    )
    tier = F.when(F.col("risk_score") < 25, "Tier 1").when(F.col("risk_score") < 55, "Tier 2")
    return df.withColumn("recommended_tier", tier.otherwise("Tier 3")).drop("__tld", "__word", "duplicate_id")


def first_wins(rows: DataFrame, row: str, order: str, max_rounds: int | None = None) -> DataFrame:
    """Rows kept by greedy first-wins over shared identity keys.

    A row falls if it shares a key with an earlier *kept* row; a fallen row blocks
    nobody.  Keys of one row only decide nothing, so just the shared ones, as numbers, and the rows that have
    them enter the rounds.  Each round keeps every row that is the earliest of all its keys (a
    grouped minimum per key, combined on the map side), drops the rows that share
    a key with a kept one, and goes on with the rest until none is left.  The
    number of rounds is the longest chain of such decisions.
    """
    marked = rows.withColumn("__rec", F.struct(F.col(order).alias("o"), *([F.col(row).alias("r")] if row != order else [])))
    keys = typed_keys(marked, "__rec")
    if row == order == "id":  # rows are told apart by their id, so no two share it
        keys = keys.filter(~F.col("key").startswith("id:"))
    shared = keys.groupBy("key").agg(F.min("__rec").alias("a"), F.max("__rec").alias("b"), F.count("*").alias("n")).filter("a <> b")
    # The least and the greatest row of a key of two are all that it has; only keys of more rows are looked up again.
    two = F.col("n") == 2
    kept = shared.select(F.when(~two, F.col("key")).alias("key"), F.when(two, F.array("a", "b")).alias("both"))
    # Numbers hold only for one run of the task that gives them, so they are written once.
    numbered = cut(kept.withColumn("kid", F.monotonically_increasing_id()))
    pairs = numbered.filter("key IS NULL").select("kid", F.explode("both").alias("__rec"))
    many = numbered.filter("key IS NOT NULL").select("key", "kid")
    if not many.isEmpty():
        pairs = pairs.unionByName(keys.join(near(many), "key").select("kid", "__rec"))
    todo = cut(pairs.groupBy("__rec").agg(F.collect_set("kid").alias("kids")))
    settled = []
    rounds = 0
    while not todo.isEmpty():
        rounds += 1
        if max_rounds and rounds > max_rounds:
            raise RuntimeError(f"not settled after {max_rounds} rounds")
        open_ = todo.select("__rec", F.size("kids").alias("n"), F.explode("kids").alias("kid"))
        firsts = open_.groupBy("kid").agg(F.min(F.struct("__rec", "n")).alias("f")).select("kid", "f.*")
        # A row has three keys at most.
        won = firsts.groupBy("__rec", "n").agg(F.collect_list("kid").alias("kids")).filter(F.size("kids") == F.col("n"))
        by = won.select(F.col("__rec").alias("by"), F.explode("kids").alias("kid"))
        gone = cut(open_.join(by, "kid").select("__rec", (~F.col("by").eqNullSafe(F.col("__rec"))).alias("fell")).distinct())
        settled.append(gone.filter("fell"))
        todo = cut(todo.join(gone, "__rec", "left_anti"))
    fell = reduce(DataFrame.unionByName, settled).select("__rec") if settled else None
    if row == order == "id" and rows.schema["id"].dataType.typeName() != "string":  # a number is a key that no other row has
        named = rows.filter("id IS NOT NULL")
        return named if fell is None else named.join(fell.select(F.col("__rec.o").alias("id")), "id", "left_anti")
    known = marked.filter((F.size(identity_keys()) > 0) & F.col(row).isNotNull())
    if settled:
        known = known.join(fell, "__rec", "left_anti")
    return rows.join(known.select(row), row, "left_semi")


def import_candidates(
    incoming: DataFrame, preserved: DataFrame, catalog: DataFrame, row: str, order: str
) -> DataFrame:
    """Incoming rows that are new to the store, the catalog and each other."""
    known = known_keys(preserved).union(known_keys(catalog)).distinct()
    seen = typed_keys(incoming, row).join(known, "key", "left_semi").select(row).distinct()
    return first_wins(incoming.join(seen, row, "left_anti"), row, order)


def replace_pending(existing: DataFrame, imported: DataFrame, replace: bool = True) -> DataFrame:
    """Store after an import: reviewed rows stay, pending ones give way if asked."""
    kept = existing.filter(F.col("status") != "pending") if replace else existing
    return kept.unionByName(imported, allowMissingColumns=True)


def review_updates(
    candidates: DataFrame, reviews: DataFrame, prefix_reviewer: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Apply reviews, marks and field patches in ``ord`` order; refused ones come back with a reason.

    ``reviews(id, ord, decision, reviewer, notes, tier_override, reviewed_at)``; decision is approve, reject, submit,
    suggest (marks the candidate as suggested by its user) or patch. A patch has a struct ``patch`` with any of the
    candidates' columns; null fields are left as they are, and a status in it counts like a review's. A candidate that is rejected at
    that point, by its stored status or by an earlier update, cannot be submitted. A submit without notes or reviewer
    keeps the earlier ones. With ``prefix_reviewer`` the notes begin with the reviewer in brackets, before the earlier
    notes in case of such a submit.
    """
    fields = reviews.schema["patch"].dataType.fieldNames() if "patch" in reviews.columns else []
    r = reviews.join(candidates.select("id", F.col("status").alias("__old")), "id", "left")
    d = F.col("decision")
    reviewed = d.isin("approve", "reject")
    set_status = F.when(d == "patch", F.col("patch.status")) if "status" in fields else F.lit(None).cast("string")
    verdict = F.when(d == "approve", "approved").when(d == "reject", "rejected").otherwise(set_status)
    # A submit that is not refused follows no rejection, so only the other updates decide about refusals.
    seen = F.when(verdict.isNotNull(), F.struct(F.col("ord").alias("at"), verdict.alias("status")))
    r = running_max(r, ["id"], [F.col("ord").asc()], {"__seen": seen})
    now = F.coalesce("__seen.status", "__old")
    known = ("approve", "reject", "submit", "suggest", *(["patch"] if fields else []))
    r = r.withColumn(
        "refused",
        F.when(F.col("__old").isNull(), "Candidate not found")
        .when(~d.isin(*known) | d.isNull(), "decision must be 'approve' or 'reject'")
        .when((d == "submit") & (now == "rejected"), "Rejected candidates cannot be marked as submitted"),
    )
    refused = r.filter(F.col("refused").isNotNull()).select(*reviews.columns, "refused")
    given = F.concat_ws(" ", F.concat(F.lit("["), nonblank("reviewer"), F.lit("]")), nonblank("notes")) if prefix_reviewer else F.col("notes")
    ok = r.filter(F.col("refused").isNull()).withColumns(
        {
            "__status": F.when(d == "submit", "submitted").otherwise(verdict),
            # Notes that replace the earlier ones, and submits that keep them.
            "__notes": F.when(reviewed | ((d == "submit") & nonblank("notes").isNotNull()), given),
            "__keeps": (d == "submit") & nonblank("notes").isNull() & nonblank("reviewer").isNotNull(),
            "__by": F.when(reviewed, F.coalesce("reviewer", F.lit(""))).when(d == "submit", nonblank("reviewer")),
            "__at": F.when(reviewed | (d == "submit"), F.col("reviewed_at")),
        }
    )

    def last(value: str) -> Column:
        return F.max_by(value, F.when(F.col(value).isNotNull(), F.col("ord")))

    patched = [f for f in fields if f != "status"]
    final = ok.groupBy("id").agg(
        last("__status").alias("__status"), last("__notes").alias("__notes"), last("__by").alias("__by"), last("__at").alias("__at"),
        F.max(F.when(F.col("__notes").isNotNull(), F.col("ord"))).alias("__noted"),
        F.collect_list(F.when(F.col("__keeps"), F.struct((-F.col("ord")).alias("o"), "reviewer"))).alias("__kept"),
        F.max_by("tier_override", F.when(nonblank("tier_override").isNotNull(), F.col("ord"))).alias("__tier"),
        F.bool_or(d == "suggest").alias("__suggested"),
        *[F.max_by(f"patch.{f}", F.when(F.col(f"patch.{f}").isNotNull(), F.col("ord"))).alias(f"__p_{f}") for f in patched],
    )
    j = candidates.join(final, "id", "left")
    notes = F.coalesce("__notes", "review_notes")
    if prefix_reviewer:
        later = F.filter("__kept", lambda x: F.col("__noted").isNull() | (-x["o"] > F.col("__noted")))
        marks = F.transform(F.array_sort(later), lambda x: F.concat(F.lit("["), F.trim(x["reviewer"]), F.lit("]")))
        notes = F.when(F.size("__kept") > 0, F.concat_ws(" ", marks, nonblank(notes))).otherwise(notes)
    out = {
        "status": F.coalesce("__status", "status"), "review_notes": notes, "reviewed_by": F.coalesce("__by", "reviewed_by"),
        "reviewed_at": F.coalesce("__at", "reviewed_at"), "recommended_tier": F.coalesce("__tier", "recommended_tier"),
    }
    out |= {f: F.coalesce(f"__p_{f}", f) for f in patched}
    old_mark = F.col("user_suggested") if "user_suggested" in candidates.columns else F.lit(False)
    if "user_suggested" in patched:
        old_mark = out["user_suggested"]
    out["user_suggested"] = F.coalesce("__suggested", F.lit(False)) | F.coalesce(old_mark, F.lit(False))
    return j.withColumns(out).drop(*[c for c in j.columns if c.startswith("__")]), refused


def judge_suggestions(suggestions: DataFrame, catalog: DataFrame, queue: DataFrame) -> DataFrame:
    """What becomes of suggested offers: ``user_id, ord, status, existing_id, reprioritized``.

    ``suggestions(user_id, ord, ...)`` as :func:`suggested_offers` gives them, ``queue(user_id, ...)`` and ``catalog`` with
    id, source_url, name and source_domain. In ``ord`` order: an offer with the URL of a catalog offer is
    already_in_catalog, and that offer is given priority if it is in the user's queue; one that shares an identity (id, URL, name
    and domain) with the catalog, the user's queue or an imported suggestion of the same user before it is already_in_queue; the rest is imported.
    """
    slim = ["user_id", "ord", "source_url", "name", "source_domain"]
    rows = suggestions.select(*slim, F.lower("source_url").alias("__url"))
    offers = catalog.filter(nonblank("source_url").isNotNull()).groupBy(F.lower("source_url").alias("__url")).agg(
        F.min(F.col("id").cast("string")).alias("existing_id")
    )
    # Written once, with what the catalog has at the URL: all that follows reads it, and moves no more than it needs.
    looked = cut(rows.join(offers, "__url", "left").select(*slim, "existing_id"))
    rows = looked.withColumn("__row", F.struct("user_id", "ord"))
    listed_ = rows.filter("existing_id IS NOT NULL").select("user_id", "ord", "__row", "existing_id")
    mine = queue.select("user_id", F.col("id").cast("string").alias("existing_id"), F.lit(True).alias("reprioritized")).distinct()
    vetted = listed_.join(mine, ["user_id", "existing_id"], "left")
    found = F.col("existing_id").isNotNull()
    # Rows that bear the name of one with an offer's URL, and have another URL, are not judged.
    mixed = rows.groupBy("user_id", "ord").agg(F.bool_or(found).alias("some"), F.bool_and(found).alias("all")).filter("some AND NOT all")
    mixed = cut(mixed.select(F.struct("user_id", "ord").alias("__row")))
    rest = rows.filter(~found).drop("existing_id").join(near(mixed), "__row", "left_anti")
    # Nameless in every key, so the id of a queued offer meets none.
    keys = typed_keys(rest.withColumn("id", F.lit(None).cast("string")), "__row")
    in_catalog = cut(keys.join(known_keys(catalog), "key", "left_semi").select("__row").distinct())
    queued = typed_keys(queue.withColumn("id", F.lit(None).cast("string")), "user_id").distinct()
    in_queue = cut(keys.withColumn("user_id", F.col("__row.user_id")).join(queued, ["user_id", "key"], "left_semi").select("__row").distinct())
    known = in_catalog.unionByName(in_queue)
    # Suggestions of different users do not meet: the user is part of every key.
    def own(c: str) -> Column:
        return F.when(nonblank(c).isNotNull(), F.concat_ws("|", "user_id", F.lower(F.trim(c))))

    new = rest.join(near(known), "__row", "left_anti").select(
        "__row", "ord", F.lit(None).cast("string").alias("id"), own("source_url").alias("source_url"), own("name").alias("name"),
        own("source_domain").alias("source_domain"),
    )
    imported = first_wins(new, "__row", "ord").select("__row").withColumn("__new", F.lit(True))
    judged = rest.select("user_id", "ord", "__row").join(imported, "__row", "left").select(
        "user_id", "ord", F.when(F.col("__new"), "imported").otherwise("already_in_queue").alias("status"),
        F.lit(None).cast("string").alias("existing_id"), F.lit(False).alias("reprioritized"),
    )
    return judged.unionByName(
        vetted.select(
            "user_id", "ord", F.lit("already_in_catalog").alias("status"), "existing_id", F.coalesce("reprioritized", F.lit(False)).alias("reprioritized")
        )
    )


def export_offers(candidates: DataFrame) -> DataFrame:
    """Candidates as catalog offers."""
    keep = [
        c for c in ("id", "name", "source_domain", "requires_account", "award_amount", "deadline", "effort_minutes",
                    "min_gpa", "allowed_majors", "allowed_ethnicities", "essay_prompts", "form_fields", "source_name",
                    "source_url") if c in candidates.columns
    ]
    return candidates.select(
        *keep,
        F.col("recommended_tier").alias("source_tier"),
        F.coalesce(F.date_format("reviewed_at", "yyyy-MM-dd"), F.lit("")).alias("verified_at"),
        F.col("review_notes").alias("notes"),
    )


# Queue status to candidate status and back.
CANDIDATE_STATUS = {
    "queued": "pending", "approved": "approved", "rejected": "rejected",
    "in_progress": "approved", "submitted": "submitted",
}
QUEUE_STATUS = {"pending": "queued", "approved": "approved", "rejected": "rejected", "submitted": "submitted"}


def mapped(c: Column, table: dict[str, str], default: str) -> Column:
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(m, c), F.lit(default))


def load_user_queue(queue: DataFrame, offers: DataFrame) -> DataFrame:
    """Queued offers of every user as candidates, with defaults filled in."""
    return queue.join(offers, queue.scholarship_id == offers.id).select(
        "user_id",
        offers["id"],
        F.coalesce(nonblank("title"), F.lit("Unknown Scholarship")).alias("name"),
        F.coalesce("source_domain", F.lit("")).alias("source_domain"),
        F.coalesce("source_url", F.lit("")).alias("source_url"),
        F.coalesce("award_amount", F.lit(0.0)).alias("award_amount"),
        F.coalesce("deadline", F.lit("")).alias("deadline"),
        F.when(F.coalesce("effort_minutes", F.lit(0)) == 0, 30).otherwise(F.col("effort_minutes")).alias("effort_minutes"),
        mapped(F.col("status"), CANDIDATE_STATUS, "pending").alias("status"),
        F.coalesce("notes", F.lit("")).alias("review_notes"),
        F.when(F.col("status") != "queued", F.col("last_action_at")).alias("reviewed_at"),
        F.col("date_added").alias("created_at"),
    )


def upsert_offers(offers: DataFrame, incoming: DataFrame) -> DataFrame:
    """Offers after an upsert keyed by source URL; the latest row wins."""
    old = offers.withColumn("__ord", F.lit(-1).cast("bigint"))
    new = incoming.withColumn("__ord", F.col("ord").cast("bigint")).drop("ord")
    rest = [c for c in offers.columns if c not in ("source_url", "id")]
    rows = old.unionByName(new, allowMissingColumns=True)
    # The first id of a URL stays, so queue rows keep pointing at their offer.
    return rows.groupBy("source_url").agg(
        F.min_by("id", "__ord").alias("id"),
        *[F.max_by(c, "__ord").alias(c) for c in rest],
    )


def upsert_queue(queue: DataFrame, links: DataFrame) -> DataFrame:
    """Queue with new (user, offer) links; existing links stay as they are."""
    key = ["user_id", "scholarship_id"]
    other = [c for c in links.columns if c not in key]
    # Of several rows for one link the smallest in column order counts, whatever order they come in.
    once = links.groupBy(*key).agg(F.min(F.struct(*other)).alias("l")).select(*key, "l.*") if other else links.select(*key).distinct()
    fresh = once.join(queue.select(*key), key, "left_anti")
    return queue.unionByName(fresh.withColumns({"status": F.lit("queued"), "notes": F.lit("")}), allowMissingColumns=True)


def title_from_path(url: Column | str) -> Column:
    """Title-cased last path segment of a URL without its file ending."""
    pieces = F.filter(
        F.transform(
            F.split(path(url), "/"),
            lambda s: F.trim(F.regexp_replace(F.coalesce(F.try_url_decode(s), s), r"(?i)\.[a-z0-9]+$", "")),
        ),
        lambda s: s != "",
    )
    words = F.regexp_replace(F.coalesce(F.try_element_at(pieces, F.lit(-1)), F.lit("")), "[-_+]+", " ")
    return F.initcap(clean(words))


def suggested_offers(urls: DataFrame, facts: DataFrame) -> DataFrame:
    """Suggested URLs as offers: given values first, then page facts, then the URL.

    ``urls(ord, url, name, award_amount, deadline)``; ``facts`` keyed by
    ``canonical_url`` with ``title, award_amount, deadline``.
    """
    dom = domain("url")
    label = clean(F.regexp_replace(F.regexp_replace(dom, r"(?i)\.[a-z]{2,}$", ""), r"[.\-_]+", " "))
    from_domain = F.initcap(clean(F.concat(label, F.lit(" scholarship"))))
    base = urls.filter(F.trim("url").rlike("(?i)^https?://[^/?#]+")).withColumns(
        {"url": F.trim("url"), "canonical_url": canonical_url("url"), "source_domain": dom}
    )
    f = facts.select(
        "canonical_url", F.col("title").alias("f_title"), F.col("award_amount").alias("f_award"),
        F.col("deadline").alias("f_deadline"),
    )
    award = F.when(F.col("award_amount") > 0, F.col("award_amount"))
    page_award = F.when((F.col("f_award") > 0) & (F.col("f_award") <= 1_000_000), F.col("f_award"))
    return base.join(f, "canonical_url", "left").select(
        "ord",
        F.col("url").alias("source_url"),
        "source_domain",
        F.coalesce(
            nonblank(F.trim("name")), nonblank("f_title"), nonblank(title_from_path("url")), from_domain
        ).alias("name"),
        F.coalesce(award, page_award, F.lit(0.0)).alias("award_amount"),
        F.coalesce(nonblank(F.trim("deadline")), nonblank("f_deadline"), F.lit("")).alias("deadline"),
        F.lit(30).alias("effort_minutes"),
        F.lit(True).alias("user_suggested"),
    )


def refresh_metadata(candidates: DataFrame, facts: DataFrame) -> DataFrame:
    """Page title over the name, page facts over blanks, and what changed."""
    f = facts.select(
        "canonical_url", F.col("title").alias("f_title"), F.col("award_amount").alias("f_award"),
        F.col("deadline").alias("f_deadline"),
    )
    j = candidates.withColumn("canonical_url", canonical_url("source_url")).join(f, "canonical_url", "left")

    def squash(c: str) -> Column:
        return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")

    j = j.withColumns(
        {"__name": F.coalesce(nonblank("f_title"), "name"), "__path": title_from_path("source_url")}
    )
    generic = (
        (squash("source_domain") != "") & squash("__name").startswith(squash("source_domain"))
        & squash("__name").endswith("scholarship")
    )
    use_path = (F.col("__path") != "") & generic & (F.lower("__path") != F.lower("__name"))
    j = j.withColumns(
        {
            "new_name": F.when(use_path, F.col("__path")).otherwise(F.col("__name")),
            "new_deadline": F.coalesce(nonblank("deadline"), nonblank("f_deadline"), F.lit("")),
            "new_award": F.when(
                (F.coalesce("award_amount", F.lit(0.0)) == 0) & (F.col("f_award") > 0), F.col("f_award")
            ).otherwise(F.coalesce("award_amount", F.lit(0.0))),
        }
    )
    changed = listed(
        (F.col("new_name") != F.col("name"), "name"),
        (F.col("new_deadline") != F.coalesce("deadline", F.lit("")), "deadline"),
        (F.col("new_award") != F.coalesce("award_amount", F.lit(0.0)), "awardAmount"),
    )
    return j.withColumn("changed_fields", changed).withColumns(
        {"name": F.col("new_name"), "deadline": F.col("new_deadline"), "award_amount": F.col("new_award")}
    ).drop("canonical_url", "f_title", "f_award", "f_deadline", "__name", "__path", "new_name", "new_deadline", "new_award")
