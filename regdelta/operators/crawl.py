"""Frontier expansion over pages that were fetched already."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regdelta.functions import url as L
from regdelta.storage import cut


def expand_frontier(edges: DataFrame, seeds: DataFrame, max_depth: int = 3) -> DataFrame:
    """(node, depth): breadth first from the seeds, each node at its least depth; one join and one anti-join a level.

    edges: src, dst; seeds: node.
    """
    links = edges.select("src", "dst").distinct()
    front = seeds.select("node").distinct().withColumn("depth", F.lit(0))
    seen = cut(front, "frontier")
    level = seen
    for depth in range(1, max_depth + 1):
        reached = level.join(links, level["node"] == links["src"]).select(F.col("dst").alias("node")).distinct()
        level = cut(reached.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen


def first_pages(frontier: DataFrame, most: int = 50) -> DataFrame:
    """The first nodes by depth and then by node, as a crawl with a page budget keeps them."""
    return frontier.orderBy("depth", "node").limit(most)


def link_positions(edges: DataFrame) -> DataFrame:
    return edges.withColumn("place", F.row_number().over(Window.partitionBy("src").orderBy("pos")))


def page_edges(pages: DataFrame) -> DataFrame:
    """(src, pos, dst, class) of every followable link of pages (url, html): both ends canonical, links resolved against their page.

    Of pages with the same canonical URL the one whose markup has the greatest hash speaks. Links are taken where a page
    lies, so that its markup is never moved. class: pdf, xml or html.
    """
    known = pages.select(L.normalize_url(F.col("url")).alias("src"), "url", F.xxhash64("html").alias("hash"), L.extract_links(F.col("html")).alias("hrefs")).where("src is not null and html is not null")
    one = known.groupBy("src").agg(F.max_by(F.struct("url", "hrefs"), F.struct("hash", "url")).alias("p"))
    links = one.select("src", "p.url", F.posexplode("p.hrefs").alias("pos", "href"))
    dst = L.normalize_url(L.resolve_url(F.col("href"), F.col("url")))
    out = links.select("src", "pos", dst.alias("dst")).where("dst is not null")
    return out.where(~L.is_skippable(F.col("dst"))).withColumn("class", L.link_class(F.col("dst")))


def crawl_frontier(
    pages: DataFrame, seeds: DataFrame, domain: str, prefix: str = "", max_depth: int = 3, max_pages: int | None = 50, max_pdfs: int | None = 20, max_xmls: int | None = 10
) -> DataFrame:
    """(url, depth, class, trail): what a breadth-first crawl over pages fetched already would visit, and the files it would harvest.

    pages: url, html, and optionally kept, false for a page that gave no document; seeds: url, pos.
    trail is the place of the seed and of each link on the way, so that (depth, trail) is the order of
    the queue; a URL has its first place. html links stay in the domain and under the prefix and are
    no traps; pdf and xml links may lead anywhere. The crawl ends when max_pages pages were kept;
    links of pages after that are not read. None: no cap, and nothing is put in order.
    """
    edges = cut(page_edges(pages), "edges")
    kept = F.col("kept") if "kept" in pages.columns else F.lit(True)
    known = pages.select(L.normalize_url(F.col("url")).alias("url"), kept.alias("kept"))
    good = cut(known.where("url is not null and kept").select("url").distinct(), "kept")
    first = lambda df: df.groupBy("url").agg(F.min("trail").alias("trail"))
    starts = seeds.select(L.normalize_url(F.col("url")).alias("url"), F.array(F.col("pos").cast("int")).alias("trail")).where("url is not null")
    level = cut(first(starts).withColumn("depth", F.lit(0)), "level")
    seen, files, left = [], [], max_pages
    for depth in range(max_depth + 1):
        if left is not None:
            level, left = _within(level, good, left)
        seen.append(level)
        if depth == max_depth:
            break
        met = level.join(edges, F.col("url") == F.col("src")).select(F.col("dst").alias("url"), "class", F.array_append("trail", F.col("pos")).alias("trail"), F.lit(depth + 1).alias("depth"))
        met = cut(met, "met")
        files.append(met.where("class <> 'html'"))
        if left == 0:
            break
        url = F.col("url")
        inside = met.where((F.col("class") == "html") & L.is_same_domain(url, domain) & L.path_prefix(url, prefix) & ~L.is_spider_trap(url))
        fresh = first(inside).withColumn("depth", F.lit(depth + 1))
        for old in seen:
            fresh = fresh.join(old.select("url"), "url", "left_anti")
        level = cut(fresh, "level")
        if level.isEmpty():
            break
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    out = [union(seen).withColumn("class", F.lit("html"))]
    if files:
        found = union(files).groupBy("url", "class").agg(F.min(F.struct("depth", "trail")).alias("at")).select("url", "class", "at.*")
        for kind, most in (("pdf", max_pdfs), ("xml", max_xmls)):
            one = found.where(F.col("class") == kind)
            out.append(one if most is None else one.orderBy("depth", "trail").limit(most))
    return union(out).select("url", "depth", "class", "trail")


def _within(level: DataFrame, good: DataFrame, left: int) -> tuple[DataFrame, int]:
    """The rows of a level up to the one that fills the budget of kept pages, and what is left of it."""
    last = level.join(good, "url", "left_semi").orderBy("trail").select("trail").limit(left).agg(F.count("*").alias("n"), F.max("trail").alias("trail")).first()
    if last["n"] < left:
        return level, left - last["n"]
    return level.where(F.col("trail") <= F.array(*map(F.lit, last["trail"]))) if left else level.where("false"), 0
