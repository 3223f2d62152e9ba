"""Entity, country, money and label columns."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from regdelta import constants as C
from regdelta.functions.text import collapse
from regdelta.functions.url import host_of


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])


def infer_entity_type(surface: Column) -> Column:
    out = F
    for kind, pattern in C.ENTITY_PATTERNS:
        out = out.when(surface.rlike(pattern), kind)
    return out.otherwise("other")


def normalize_entity(surface: Column) -> Column:
    """struct(key, display, type); null below two characters."""
    t = F.left(collapse(surface), F.lit(255))
    low = F.lower(t)
    agency, law = (F.try_element_at(literal_map(m), low) for m in (C.AGENCIES, C.REGULATIONS))
    titles = {v: v.title() for m in (C.AGENCIES, C.REGULATIONS) for v in m.values()}
    full = F.coalesce(agency, law)
    made = F.struct(
        F.coalesce(full, low).alias("key"),
        F.coalesce(F.try_element_at(literal_map(titles), full), t).alias("display"),
        F.when(agency.isNotNull(), "agency").when(law.isNotNull(), "regulation").otherwise(infer_entity_type(t)).alias("type"),
    )
    return F.when(F.length(t) >= 2, made)


def normalize_countries(names: Column) -> Column:
    """Codes in first-seen order, at most twelve; what is neither a known name nor two letters is dropped."""

    def code(x):
        s = F.trim(x)
        upper = F.upper(s)
        return F.coalesce(F.try_element_at(literal_map(C.COUNTRIES), F.lower(s)), F.when(upper == "UK", "GB").when(upper.rlike("^[A-Z]{2}$"), upper))

    found = F.filter(F.transform(names, code), lambda c: c.isNotNull())
    return F.coalesce(F.slice(F.array_distinct(found), 1, 12), F.array().cast("array<string>"))


def resolve_jurisdiction(url: Column) -> Column:
    """Codes of the longest known suffix of the host; empty if none is known."""
    parts = F.split(host_of(url), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    known = F.filter(F.transform(suffixes, lambda s: F.try_element_at(literal_map(C.JURISDICTIONS), s)), lambda c: c.isNotNull())
    return F.coalesce(F.slice(known, 1, 1), F.array().cast("array<string>"))


def assign_trade(jurisdiction: Column, countries: Column, flow: Column) -> tuple[Column, Column]:
    both = F.array_union(jurisdiction, countries)
    f = F.coalesce(F.lower(F.trim(flow)), F.lit(""))
    origins = F.when(f == "outbound", jurisdiction).when(f == "bilateral", both).otherwise(countries)
    destinations = F.when(f == "outbound", countries).when(f == "bilateral", both).otherwise(jurisdiction)
    return origins, destinations


def compute_cost(prompt: Column, completion: Column, model: Column) -> Column:
    """Dollars, rounded to eight places; unknown models at the default price."""
    into, out = (F.coalesce(F.try_element_at(literal_map({k: v[i] for k, v in C.PRICES.items()}), model), F.lit(d)) for i, d in ((0, C.Config.price_input), (1, C.Config.price_output)))
    return F.round(prompt / 1e6 * into + completion / 1e6 * out, 8)


def score_band(score: Column) -> Column:
    return (
        F.when(score.isNull(), "unscored").when(score >= 0.8, "CRITICAL").when(score >= 0.6, "substantive").when(score >= 0.4, "clarification").when(score >= 0.2, "minor").otherwise("cosmetic")
    )


def render_subject(score: Column, topic: Column, label: Column) -> Column:
    named = lambda x, d: F.when(x.isNull() | (x == ""), d).otherwise(x)
    return F.concat(F.lit("["), score_band(score), F.lit("] "), F.replace(named(topic, "regulatory"), F.lit("_"), F.lit(" ")), F.lit(": "), named(label, "alert"))


def artifact_key(source_type: Column, at: Column, content_hash: Column) -> Column:
    return F.concat(F.lit("artifacts/"), source_type, F.lit("/"), F.date_format(at, "yyyy-MM-dd"), F.lit("/"), F.left(content_hash, F.lit(8)), F.lit("_text.txt"))


def retry_at(failed_at: Column, attempt: Column, base: int, cap: int) -> Column:
    """When the attempt after that failure is due; null once attempts exceed the cap."""
    seconds = F.lit(base) * F.pow(F.lit(2), attempt)
    return F.when(attempt < cap, F.timestamp_seconds(F.unix_timestamp(failed_at) + seconds.cast("long")))
