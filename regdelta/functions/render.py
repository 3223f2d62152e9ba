"""Alert messages as text and HTML columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from regdelta.functions.entity import score_band


def escape(text: Column) -> Column:
    out = text
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out


def listed(items: Column) -> Column:
    return F.when(F.coalesce(F.size(items), F.lit(0)) > 0, F.array_join(items, ", ")).otherwise("—")


def _fields(e: dict[str, Column]) -> list[tuple[str, Column]]:
    dash = lambda c: F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit("—"))
    return [
        ("Band", score_band(e["significance_score"])),
        ("Score", F.when(e["significance_score"].isNotNull(), F.format_string("%.2f", e["significance_score"])).otherwise("—")),
        ("Topic", dash(e["topic"])),
        ("Change type", dash(e["change_type"])),
        ("Origin", listed(e["origin_countries"])),
        ("Destination", listed(e["destination_countries"])),
        ("Matched keywords", listed(e["matched_keywords"])),
        ("Source", dash(e["source_url"])),
    ]


def _quote(e: dict[str, Column]) -> tuple[Column, Column]:
    mark = F.when(e["span_start"].isNotNull(), "verified").otherwise("unverified")
    return F.coalesce(F.nullif(e["quote"], F.lit("")), F.lit("")), mark


def render_text(e: dict[str, Column]) -> Column:
    """e: columns significance_score, topic, change_type, origin_countries, destination_countries, matched_keywords, source_url, summary, quote, span_start."""
    lines = [F.concat(F.lit(f"{k}: "), v) for k, v in _fields(e)]
    quote, mark = _quote(e)
    cited = F.when(quote != "", F.concat(F.lit("\n\nCitation ("), mark, F.lit("):\n> "), quote)).otherwise("")
    return F.concat(F.concat_ws("\n", *lines), F.lit("\n\n"), F.coalesce(e["summary"], F.lit("(no summary)")), cited)


def render_html(e: dict[str, Column]) -> Column:
    rows = [F.concat(F.lit(f"<tr><th>{k}</th><td>"), escape(v), F.lit("</td></tr>")) for k, v in _fields(e)]
    quote, mark = _quote(e)
    cited = F.when(quote != "", F.concat(F.lit('<blockquote class="'), mark, F.lit('">'), escape(quote), F.lit("</blockquote>"))).otherwise("")
    return F.concat(F.lit("<table>"), F.concat(*rows), F.lit("</table><p>"), escape(F.coalesce(e["summary"], F.lit("(no summary)"))), F.lit("</p>"), cited)
