"""Mixing sources to target weights: repetition rates of sources, whole copies and one drawn copy of each document."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regdelta.llm.common import cut, table
from regdelta.operators.ranks import numbered

WORDS = r"[^\x20\x09-\x0D]+"
#: Most rows of sources that are sent to the documents.
BROADCAST_SOURCES = 1 << 17


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORDS)).cast("long")


def source_targets(sources: DataFrame, weights: Sequence[int], share: float, most_rate: int) -> DataFrame:
    """Adds target (double): what each source is to give.

    sources: (source, source_size), each source once. Sources by code point, null last, weigh `weights`, repeating,
    and share `share` times all sizes. A target stops at most_rate times its source's size; the excess is reshared by
    weight until none is above. Every round is an aggregate over the sources; two sums a round reach the driver.
    Sources without words get 0. ValueError if share exceeds most_rate, as no targets add up to it then.
    """
    if not 0 <= share <= most_rate:
        raise ValueError("share has to be between 0 and most_rate")
    place = numbered(sources, [F.col("source").asc_nulls_last()])
    weigh = F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    rows = cut(place.withColumn("_weight", weigh).withColumn("_most", F.col("source_size") * most_rate).drop("place"), "sources")
    # a source is full if its share reaches its most; more are full each round, as the shares of the others grow
    share_of = lambda left, weight: F.lit(left) * F.col("_weight") / F.lit(weight)
    budget = float(rows.agg(F.sum("source_size")).first()[0] or 0) * share
    weight = float(rows.agg(F.sum("_weight")).first()[0] or 1)
    left, seen = budget, -1
    while True:
        full = share_of(left, weight) >= F.col("_most")
        got = rows.agg(F.count_if(full).alias("n"), F.sum(F.when(full, F.col("_most"))).alias("given"), F.sum(F.when(~full, F.col("_weight"))).alias("weight")).first()
        if got["n"] == seen or not got["weight"]:
            break
        seen, left, weight = got["n"], budget - float(got["given"] or 0), float(got["weight"])
    target = F.when(full, F.col("_most").cast("double")).otherwise(share_of(left, weight))
    return rows.select("source", "source_size", target.alias("target"))


def _draw(sizes: DataFrame, weights: Sequence[int], share: float, most_rate: int, seed: int) -> DataFrame:
    """sizes (doc_id, source, size and others, a table) with source_size, target, rate, copies and taken."""
    place = numbered(sizes, [F.col("source").asc_nulls_last(), F.col("size"), F.col("doc_id").asc_nulls_first()])
    sums = cut(place.groupBy("source").agg(F.sum("size").alias("source_size"), F.min("place").alias("_first")), "sums")
    targets = source_targets(sums.select("source", "source_size"), weights, share, most_rate).withColumnRenamed("source", "_source")
    known = cut(targets.join(sums.select(F.col("source").alias("_also"), "_first"), F.col("_source").eqNullSafe(F.col("_also"))).drop("_also"), "rates")
    known = F.broadcast(known) if known.count() <= BROADCAST_SOURCES else known
    rows = place.join(known, F.col("source").eqNullSafe(F.col("_source")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    start = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit(""))), 256), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    at = F.col("place") - F.col("_first")
    upto = lambda i: F.floor(F.col("_start") + (F.col("rate") - F.floor("rate")) * i)
    rows = rows.withColumn("rate", rate).withColumn("_start", start)
    rows = rows.withColumn("copies", (F.floor("rate") + upto(at + 1) - upto(at)).cast("long"))
    return rows.withColumn("taken", F.col("size") * F.col("copies")).drop("place", "_source", "_first", "_start")


def _sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), words(F.col(text_col)).alias("size"), *more)


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most_rate: int = 2, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies, taken): how often the mix takes each row of docs.

    size is the number of words. A source's rate is target / source_size. Every row is taken floor(rate) times, and once more
    with the fraction f of the rate as probability. That draw is a Bernoulli variable, seeded by a hash of the
    source, and drawn jointly: the row at place i of its source, by size and id, is drawn if an integer lies in
    (u + f(i - 1), u + fi], u being uniform by the hash. As sizes grow along the places, what is drawn of a source differs from
    f times its size by less than its largest document; independent draws miss the more, the fewer and the more unlike its documents are. Rows that repeat an id are rows
    like others. Reruns agree.

    Null texts have no words; a null source is a source; a null id comes first among equal sizes; a source without words has rate
    0. An empty table gives an empty result; other columns are not read. Ids, sizes and sources alone are put
    in order, by range: a source with a third of all rows is many tasks.
    """
    return _draw(cut(_sizes(docs, id_col, text_col, source_col), "sizes"), weights, share, most_rate, seed)


def mixed_documents(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most_rate: int = 2, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: the rows of docs, each as often as `mix` draws it. Rows are numbered in a table first, so that repeated ones are told apart."""
    rows = cut(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    drawn = _draw(cut(_sizes(rows, id_col, text_col, source_col, "_row"), "sizes"), weights, share, most_rate, seed).where("copies > 0").select("_row", "copies")
    each = rows.join(drawn, "_row")
    return each.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*docs.columns)


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP13_SQL = r"""
WITH RECURSIVE sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM sizes GROUP BY source),
-- a source is full if the level at which it fills is below the level of the sources that fill at that level or later
levels AS (
  SELECT *, 1.5 * sum(source_size) OVER () AS budget, 2 * source_size / w AS fills FROM sources),
tried AS (
  SELECT a.source, a.source_size, a.w, a.budget,
         coalesce((SELECT sum(2 * b.source_size) FROM levels b WHERE b.fills < a.fills), 0) AS given,
         (SELECT sum(b.w) FROM levels b WHERE b.fills >= a.fills) AS weight, a.fills FROM levels a),
marked AS (SELECT *, (budget - given) / weight >= fills AS is_full FROM tried),
ended AS (
  SELECT max(budget) AS budget, coalesce(sum(2 * source_size) FILTER (is_full), 0) AS given, sum(w) FILTER (NOT is_full) AS weight FROM marked),
targets AS (
  SELECT m.source, m.source_size,
         CASE WHEN m.is_full THEN (2 * m.source_size)::DOUBLE ELSE (e.budget - e.given)::DOUBLE * m.w / e.weight::DOUBLE END AS target
  FROM marked m, ended e),
rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
         ('0x' || substr(sha256('42:' || coalesce(source, '')), 1, 8))::BIGINT::DOUBLE / 4294967296.0 AS u
  FROM targets),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, doc_id NULLS FIRST) AS i FROM sizes)
SELECT p.doc_id, p.size::BIGINT AS size, r.source_size, r.target,
       (p.size * (floor(r.rate) + floor(r.u + (r.rate - floor(r.rate)) * p.i) - floor(r.u + (r.rate - floor(r.rate)) * (p.i - 1))))::BIGINT AS taken
FROM placed p JOIN rates r ON p.source IS NOT DISTINCT FROM r.source
"""
