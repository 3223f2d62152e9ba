"""URL columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from regdelta import constants as C


def any_of(text: Column, fragments) -> Column:
    """Whether the text contains any of the fragments."""
    out = F.lit(False)
    for x in fragments:
        out = out | text.contains(x)
    return out


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def query_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def netloc_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def host_of(url: Column) -> Column:
    """Lower-case host without port and trailing dots; URLs without a scheme are taken as http."""
    full = F.when(url.contains("://"), url).otherwise(F.concat(F.lit("http://"), url))
    return F.regexp_replace(F.regexp_extract(netloc_of(full), "^([^:]*)", 1), r"\.+$", "")


def normalize_domain(text: Column) -> Column:
    out = F.lower(F.trim(text))
    for prefix in ("https://", "http://", "www."):
        out = F.when(out.startswith(prefix), F.substring(out, len(prefix) + 1, 2**30)).otherwise(out)
    return F.regexp_replace(out, "/+$", "")


def normalize_url(url: Column) -> Column:
    """Canonical absolute http(s) URL; null for others."""
    u = F.trim(url)
    scheme = F.lower(F.regexp_extract(u, "^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    path = F.regexp_replace(F.regexp_replace(path_of(u), ";[^/]*$", ""), "/+$", "")
    pairs = F.filter(F.split(query_of(u), "&"), lambda p: p.rlike("^[^=]*=."))
    parts = F.transform(
        pairs,
        lambda p: F.struct(
            F.coalesce(F.try_url_decode(F.regexp_extract(p, "^([^=]*)=", 1)), F.lit("")).alias("k"),
            F.coalesce(F.try_url_decode(F.regexp_extract(p, "^[^=]*=(.*)$", 1)), F.lit("")).alias("v"),
        ),
    )
    kept = F.array_sort(F.filter(parts, lambda p: ~F.lower(p["k"]).isin(*C.TRACKING_PARAMS)))
    query = F.array_join(F.transform(kept, lambda p: F.concat(F.url_encode(p["k"]), F.lit("="), F.url_encode(p["v"]))), "&")
    full = F.concat(scheme, F.lit("://"), netloc_of(u), F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(scheme.isin("http", "https"), full)


def _without_dots(path: Column) -> Column:
    """Path whose `.` and `..` segments are followed; those that lead above the root are dropped."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)

    def follow(done, x):
        up = F.when(F.size(done) > 1, F.slice(done, 1, F.size(done) - 1)).otherwise(done)
        return F.when(x == "..", up).when(x == ".", done).otherwise(F.array_append(done, x))

    followed = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), follow), "/")
    folder = F.when(last.isin(".", ".."), F.concat(F.regexp_replace(followed, "/$", ""), F.lit("/"))).otherwise(followed)
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), folder).otherwise(path)


def resolve_url(href: Column, base: Column) -> Column:
    """The absolute URL that a link of a page stands for, by RFC 3986; null if either is null."""
    h = F.trim(href)
    scheme = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    root = F.concat(scheme, F.lit("://"), F.regexp_extract(base, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    here = F.when(path_of(base) == "", "/").otherwise(path_of(base))
    folder = F.regexp_extract(here, "^(.*/)", 1)
    path = F.regexp_extract(h, "^([^?#]*)", 1)
    rest = F.regexp_extract(h, "^[^?#]*(.*)$", 1)
    query = F.regexp_extract(base, r"^[^?#]*(\?[^#]*)", 1)
    return (
        F.when(h.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), h)
        .when(h.startswith("//"), F.concat(scheme, F.lit(":"), h))
        .when(path.startswith("/"), F.concat(root, _without_dots(path), rest))
        .when(path != "", F.concat(root, _without_dots(F.concat(folder, path)), rest))
        .when(rest.startswith("?"), F.concat(root, here, rest))
        .otherwise(F.concat(root, here, query, rest))
    )


def is_spider_trap(url: Column) -> Column:
    path = path_of(url)
    return (F.length(url) > 512) | url.rlike(C.SESSION_PATTERN) | path.rlike(C.CALENDAR_PATTERN) | path.rlike(C.REPEATED_PATTERN)


def is_skippable(url: Column) -> Column:
    path = F.lower(path_of(url))
    endings = "|".join(x.replace(".", r"\.") for x in C.SKIPPED_ENDINGS)
    return path.rlike(f"({endings})$") | any_of(path, C.SKIPPED_FRAGMENTS)


def link_class(url: Column) -> Column:
    path = F.lower(path_of(url))
    return F.when(path.endswith(".pdf"), "pdf").when(path.endswith(".xml") & ~any_of(path, C.NOT_LEGAL_XML), "xml").otherwise("html")


def is_same_domain(url: Column, domain: str | Column) -> Column:
    """Same domain or a subdomain; leading characters w and . are stripped on both sides."""
    d = F.regexp_replace(F.lower(domain if isinstance(domain, Column) else F.lit(domain)), "^[w.]+", "")
    host = F.regexp_replace(netloc_of(url), "^[w.]+", "")
    return (netloc_of(url) != "") & ((host == d) | host.endswith(F.concat(F.lit("."), d)))


def path_prefix(url: Column, prefix: str) -> Column:
    return path_of(url).startswith(prefix)


def infer_kind(url: Column) -> Column:
    path, low = F.lower(path_of(url)), F.lower(url)
    return (
        F.when(path.endswith(".pdf"), "pdf")
        .when(path.endswith(".xml") & any_of(path, ("rss", "feed", "atom")), "rss")
        .when(path.endswith(".xml"), "xml")
        .when(any_of(low, ("rss", "atom", "feed")), "rss")
        .otherwise("web")
    )


def extract_links(html: Column) -> Column:
    """The href of every anchor that is neither script, mail nor a fragment."""
    hrefs = F.regexp_extract_all(html, F.lit(r"""(?i)<a\s[^>]*?href=["']([^"']*)["']"""), 1)
    return F.filter(F.transform(hrefs, lambda h: F.trim(h)), lambda h: (h != "") & ~h.rlike("(?i)^(javascript:|mailto:|#)"))
