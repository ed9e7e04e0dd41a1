"""URL columns: canonical form, domain, base domain, path, resolution."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean, col, flag, let

_URL = r"^(?i)(https?|ftp)://([^/?#\s]+)([^?#]*)(\?[^#]*)?"

# Query parameters that are dropped. "utm_" is matched whole.
TRACKING = ["utm_", "fbclid", "gclid", "mc_cid", "mc_eid", "ref", "source"]


def parse(url: Column | str) -> Column:
    """Scheme, authority, path and query of a URL; empty parts for other text."""
    t = F.trim(F.coalesce(col(url), F.lit("")))
    return F.struct(
        F.lower(F.regexp_extract(t, _URL, 1)).alias("scheme"),
        F.lower(F.regexp_extract(t, _URL, 2)).alias("authority"),
        F.regexp_extract(t, _URL, 3).alias("route"),
        F.regexp_extract(t, _URL, 4).alias("query"),
    )


def is_url(url: Column | str) -> Column:
    return F.regexp_extract(F.trim(F.coalesce(col(url), F.lit(""))), _URL, 2) != ""


def hostname(url: Column | str) -> Column:
    """Lower-case host without port; empty for text that is not a URL."""
    authority = F.lower(F.regexp_extract(F.trim(F.coalesce(col(url), F.lit(""))), _URL, 2))
    return F.regexp_replace(authority, r"^.*@|:\d*$", "")


def domain(url: Column | str) -> Column:
    return F.regexp_replace(hostname(url), r"^www\.", "")


def base_domain(dom: Column | str) -> Column:
    """Last two labels of a domain."""
    labels = F.filter(F.split(F.lower(clean(dom)), r"\."), lambda x: x != "")
    return F.array_join(F.reverse(F.slice(F.reverse(labels), 1, 2)), ".")


def path(url: Column | str) -> Column:
    """Path of a URL ("/" when it has none), empty for other text."""
    return let(
        parse(url),
        lambda u: F.when(u["authority"] == "", F.lit(""))
        .when(u["route"] == "", F.lit("/"))
        .otherwise(u["route"]),
    )


def canonical_url(url: Column | str, strip_utm: bool = False) -> Column:
    """Canonical form: no fragment, tracking parameters or trailing slashes.

    By default only a parameter named exactly ``utm_`` goes; ``strip_utm`` drops
    every ``utm_*`` parameter.  Text that is no URL is cleaned and lower-cased.
    """
    names = "|".join(TRACKING)
    drop = f"(?i)^({names})(=|$)" + ("|(?i)^utm_" if strip_utm else "")

    def build(u: Column) -> Column:
        kept = F.array_join(
            F.filter(F.split(F.substring(u["query"], 2, 1 << 30), "&"), lambda p: ~p.rlike(drop)), "&"
        )
        port = F.when(u["scheme"] == "http", ":80$").otherwise(":443$")
        return F.concat(
            u["scheme"],
            F.lit("://"),
            F.regexp_replace(u["authority"], port, F.lit("")),
            F.coalesce(F.nullif(F.regexp_replace(u["route"], "/+$", ""), F.lit("")), F.lit("/")),
            let(kept, lambda k: F.when(k == "", F.lit("")).otherwise(F.concat(F.lit("?"), k))),
        )

    return let(
        parse(url),
        lambda u: F.when(u["authority"] == "", F.lower(clean(url))).otherwise(build(u)),
    )


def domain_suffixes(dom: Column | str) -> Column:
    """All label suffixes of a domain: a.b.c -> [a.b.c, b.c, c]."""
    labels = F.split(col(dom), r"\.")
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))


def domain_hint(c: Column | str) -> Column:
    """Bare domain of a hint such as ``site:https://www.x.org/a``."""
    c = F.lower(F.trim(F.coalesce(col(c), F.lit(""))))
    for pattern in ("^site:", "^https?://", r"^www\.", "/.*$"):
        c = F.regexp_replace(c, pattern, "")
    return c


def resolve(href: Column, base: Column) -> Column:
    """Absolute form of a link on a page; NULL when it cannot be http(s).

    Dot segments at the front of a relative link are resolved against the folder
    of the base path.
    """

    def build(u: Column) -> Column:
        b, h = u["base"], u["href"]
        root = F.concat(b["scheme"], F.lit("://"), b["authority"])
        folder = F.regexp_replace(
            F.coalesce(F.nullif(b["route"], F.lit("")), F.lit("/")), r"[^/]*$", ""
        )
        ups = (F.length(F.regexp_extract(h, r"^((?:\.\./)+)", 1)) / 3).cast("int")

        def climb(f: Column) -> Column:
            parts = F.filter(F.split(f, "/"), lambda p: p != "")
            kept = F.slice(parts, 1, F.greatest(F.size(parts) - ups, F.lit(0)))
            return F.concat(
                F.lit("/"), F.array_join(F.transform(kept, lambda p: F.concat(p, F.lit("/"))), "")
            )

        return (
            F.when(h.rlike("(?i)^https?://"), h)
            .when(h.rlike(r"(?i)^[a-z][a-z0-9+.\-]*:"), F.lit(None).cast("string"))
            .when(h.startswith("//"), F.concat(b["scheme"], F.lit(":"), h))
            .when(h.startswith("/"), F.concat(root, h))
            .when(
                h.startswith("?"),
                F.concat(root, F.coalesce(F.nullif(b["route"], F.lit("")), F.lit("/")), h),
            )
            .when(
                h.startswith("../"),
                F.concat(root, let(folder, climb), F.regexp_replace(h, r"^(\.\./)+", "")),
            )
            .otherwise(F.concat(root, folder, F.regexp_replace(h, r"^(\./)+", "")))
        )

    return let(F.struct(parse(base).alias("base"), href.alias("href")), build)


def same_host(a: Column, b: Column) -> Column:
    return flag((hostname(a) == hostname(b)) & (hostname(a) != ""))
