"""The prefix trie of conversations and its rollup by centroid decomposition.

A node is a distinct sequence of first turns. Its smallest member and its depth name it: that member passes at each depth
through one node. Prefixes are told apart by polynomial hashes of the SHA-256 of their turns in four prime fields (124 bits),
which add up, so the turns of one long conversation can lie in many tasks.

Rollup. The weight of a subtree is the number of turns (of members) in it; it follows from lengths and counts of members without
any walk. A component of the forest of parent edges is split at its centroid, the deepest node with more than half of
the weight: what hangs below becomes components of their own, what is above stays one. The totals of the parts at and below
the centroid, aggregated by component, are its rollup in the component; they are added to the nodes on the path from
the centroid to the component's top, and its weight is taken off them. Each round splits all large components at once and halves their
weights, however deep or broad the trie is. Components of few nodes are rolled up whole by the task that holds them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from regdelta.llm.common import cut, python_tasks, table
from regdelta.llm.mixing import words
from regdelta.operators.ranks import numbered

#: Primes below 2^31, and a base of the hash for each.
PRIMES = np.array([2147483647, 2147483629, 2147483587, 2147483579], np.int64)
BASES = np.array([1103515245, 1664525, 1597334677, 1181783497], np.int64)
#: Nodes of a component that a task rolls up.
WHOLE = 1 << 12
#: Most rows of a table that is sent to all tasks.
BROADCAST_ROWS = 1 << 16
#: Members in a part of the list that is digested for a node.
PART_MEMBERS = 1 << 14


def _sized(rows: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it is small; else Spark joins it as it sees fit."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, sha, words), a table: the turns of each conversation in order, turn from 1.

    Order: turn (null first), then role, then text, null role and text being empty. Rows without conv_id belong to no conversation.
    sha is the digest of role and text. All turns are put in one order by range, so one conversation can be many tasks.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", empty("role").alias("role"), empty("text").alias("text"))
    sha = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    placed = numbered(rows, order, columns=["conv_id", sha.alias("sha"), words(F.col("text")).alias("words")])
    first = placed.groupBy("conv_id").agg(F.min("place").alias("_first"))
    return cut(placed.join(first, "conv_id").select("conv_id", (F.col("place") - F.col("_first") + 1).alias("turn"), "sha", "words"), "turns")


def with_shared_heads(turns: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """(turns, lengths) of rebuilt conversations: the first h turns of conversation c - c % every (the sign of % is that of c), then c's own after its first h.

    h is the crc32 of c as text modulo `most`. lengths has a row (conv_id, length) for each conversation, also where no turn is left.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h")
    convs = cut(turns.groupBy("conv_id").agg(F.count("*").alias("n")).select("conv_id", "n", h, (F.col("conv_id") - F.col("conv_id") % every).alias("base")), "convs")
    bases = convs.where("conv_id = base").select("base", F.col("n").alias("_base_n"))
    taken = F.least("h", F.coalesce("_base_n", F.lit(0))).alias("taken")
    known = cut(convs.join(bases, "base", "left").select("conv_id", "n", "h", "base", taken), "heads")
    lengths = known.select("conv_id", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    own = turns.join(known.select("conv_id", "h", "taken"), "conv_id").where("turn > h").select("conv_id", (F.col("turn") - F.col("h") + F.col("taken")).alias("turn"), "sha", "words")
    heads = turns.where((F.col("turn") < most) & (F.col("conv_id") % every == 0)).withColumnRenamed("conv_id", "base")
    head = heads.join(known.where("taken > 0").select("conv_id", "base", "taken"), "base").where("turn <= taken").select("conv_id", "turn", "sha", "words")
    return own.unionByName(head), lengths


def _power_tables() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the bases: of 0 to 2^16 - 1, and of these times 2^16."""

    def powers(base: np.ndarray) -> np.ndarray:
        out, done = np.ones((1 << 16, 4), np.int64), 1
        while done < len(out):
            out[done : 2 * done] = out[:done] * base % PRIMES
            base, done = base * base % PRIMES, 2 * done
        return out

    low = powers(BASES % PRIMES)
    return low, powers(low[-1] * BASES % PRIMES)


def _running_hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Hashes of the turns of each conversation up to each row, as far as they lie in this partition; rows are in order."""
    low, high = _power_tables()
    part, conv, carried = TaskContext.get().partitionId(), None, np.zeros(4, np.int64)
    for b in batches:
        if not len(b):
            continue
        depth, ids = b["depth"].to_numpy(np.int64), b["conv_id"].to_numpy(np.int64)
        sha = np.frombuffer(b"".join(b["sha"]), "<u8").reshape(-1, 4)
        term = (sha % PRIMES.astype(np.uint64)).astype(np.int64) + 1
        term = term % PRIMES * (low[depth & 0xFFFF] * high[depth >> 16 & 0xFFFF] % PRIMES) % PRIMES
        term[depth == 0] = 0
        total = np.cumsum(term, axis=0)
        first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        before = np.zeros((len(first), 4), np.int64)
        before[1:] = total[first[1:] - 1]
        if ids[0] == conv:
            before[0] = -carried
        at = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(b)]))
        own = (total - before[at]) % PRIMES
        conv, carried = ids[-1], own[-1]
        out = b.drop(columns="sha")
        out["part"] = part
        for i in range(4):
            out[f"p{i}"] = own[:, i]
        yield out


def hashed_prefixes(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """(conv_id, depth, words, length, a, b), a table: for each conversation and depth from 0 the hash (a, b) of its first turns."""
    python_tasks(turns.sparkSession)
    root = lengths.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(bytes(32)).alias("sha"), F.lit(0).cast("long").alias("words"))
    rows = cut(turns.withColumnRenamed("turn", "depth").unionByName(root).join(lengths, "conv_id"), "prefixes")
    order = ["conv_id", "depth"]
    lying = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    sums = [f"p{i}" for i in range(4)]
    local = cut(lying.mapInPandas(_running_hashes, "conv_id long, depth long, words long, length long, part long, " + ", ".join(f"{p} long" for p in sums)), "hashes")
    # conversations that lie in several partitions: at most one begins before each partition
    cuts = local.groupBy("conv_id").agg(F.min("part").alias("_a"), F.max("part").alias("_b")).where("_a < _b").select("conv_id")
    ends = local.join(_sized(cut(cuts, "cuts")), "conv_id").groupBy("conv_id", "part").agg(F.max_by(F.struct(*sums), "depth").alias("_s"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select("conv_id", "part", *[F.coalesce(F.sum(f"_s.{p}").over(earlier), F.lit(0)).alias(f"c{i}") for i, p in enumerate(sums)])
    whole = local.join(_sized(cut(carry, "carry")), ["conv_id", "part"], "left")
    p = [((F.col(f"p{i}") + F.coalesce(F.col(f"c{i}"), F.lit(0))) % int(PRIMES[i])) for i in range(4)]
    pair = lambda x, y: F.shiftleft(x, 31).bitwiseOR(y)
    return cut(whole.select("conv_id", "depth", "words", "length", pair(p[0], p[1]).alias("a"), pair(p[2], p[3]).alias("b")), "prefixes")


def paths_and_nodes(prefixes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(paths, nodes), tables. paths: (conv_id, depth, node, up): smallest members of the node of that prefix and of its parent.
    nodes: (node, depth, up, n_convs, weight, words, n_children)."""
    key = ["a", "b", "depth"]
    groups = prefixes.groupBy(*key).agg(F.min("conv_id").alias("node"), F.count("*").alias("n_convs"), F.sum(F.col("length") - F.col("depth") + 1).alias("weight"), F.first("words").alias("words"))
    groups = cut(groups, "groups")
    # prefixes of very many conversations, at most 4096, are known to all tasks
    total = prefixes.count()
    often = F.col("n_convs") >= max(2, total >> 12)
    named = lambda g: g.select(*key, "node")
    hot = _sized(cut(named(groups.where(often)), "hot"))
    near = prefixes.select("conv_id", *key).join(hot, key, "left")
    far = near.where("node is null").drop("node").join(named(groups.where(~often)), key)
    paths = cut(near.where("node is not null").unionByName(far, allowMissingColumns=True).select("conv_id", "depth", "node"), "paths")
    above = paths.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("node").alias("up"))
    paths = cut(paths.join(above, ["conv_id", "depth"], "left"), "paths")
    ups = paths.where("node = conv_id").select("node", "depth", "up")
    counts = ups.where("depth > 0").groupBy(F.col("up").alias("node"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = groups.drop("a", "b").join(ups, ["node", "depth"]).join(counts, ["node", "depth"], "left").fillna(0, "n_children")
    return paths, cut(nodes, "nodes")


def _whole_components(values: list[str]):
    """Rolls up whole components that come one after the other, and keeps at most one of them beside a batch."""

    def roll(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["node", "depth"], ignore_index=True)
        node, depth, up = rows["node"].to_numpy(), rows["depth"].to_numpy(), rows["up"].to_numpy()
        # a node and its parent, found by (smallest member, depth); members that stand in these rows have a number
        members = np.unique(node)
        deepest = int(depth.max()) + 2
        keys = np.searchsorted(members, node) * deepest + depth
        at = np.minimum(np.searchsorted(members, up), len(members) - 1)
        wanted = at * deepest + depth - 1
        place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        there = (members[at] == up) & (depth > 0) & (keys[place] == wanted)
        # of another component, if it is one above this component's top
        comp = rows["top"].to_numpy(), rows["top_depth"].to_numpy()
        there &= (comp[0][place] == comp[0]) & (comp[1][place] == comp[1])
        sums = rows[values].to_numpy(np.int64)
        order = np.argsort(-depth, kind="stable")
        bounds = np.flatnonzero(np.r_[True, np.diff(depth[order]) != 0, True])
        for a, b in zip(bounds[:-1], bounds[1:]):
            level = order[a:b]
            level = level[there[level]]
            np.add.at(sums, place[level], sums[level])
        for i, v in enumerate(values):
            rows[f"sum_{v}"] = sums[:, i] + rows[f"sum_{v}"].to_numpy()
        return rows[["node", "depth", *[f"sum_{v}" for v in values]]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting = None
        for b in batches:
            rows = b if waiting is None else pd.concat([waiting, b], ignore_index=True)
            last = (rows["top"] == rows["top"].iloc[-1]) & (rows["top_depth"] == rows["top_depth"].iloc[-1]) if len(rows) else None
            if last is None:
                continue
            waiting = rows[last]
            if not last.all():
                yield roll(rows[~last])
        if waiting is not None and len(waiting):
            yield roll(waiting)

    return run


def subtree_sums(nodes: DataFrame, paths: DataFrame, values: list[str], whole: int = WHOLE) -> DataFrame:
    """(node, depth, sum_<value> for each of values): sums over the subtree of each node, by centroid decomposition.

    nodes: (node, depth, up, weight, values), paths as of `paths_and_nodes`, both tables. Components of up to `whole` nodes end in
    a task each; larger ones are split, round after round, at most log2 of the root's weight of them. Each round reaches the driver
    with a few counts only.
    """
    sums = [f"sum_{v}" for v in values]
    comp = ["top", "top_depth"]
    out_columns = ["node", "depth", *sums]
    root = nodes.where("depth = 0").first()
    top = [F.lit(root["node"] if root else 0).cast("long").alias("top"), F.lit(0).cast("long").alias("top_depth")]
    state = nodes.select("node", "depth", F.coalesce("up", "node").alias("up"), "weight", *values, *[F.lit(0).cast("long").alias(s) for s in sums], *top)
    asides, ended = [], []
    while True:
        sizes = state.groupBy(*comp).agg(F.count("*").alias("n"), F.max("weight").alias("total"))
        large = _sized(cut(sizes.where(F.col("n") > whole).drop("n"), "large"))
        asides.append(state.join(large.select(*comp), comp, "left_anti"))
        if large.isEmpty():
            break
        split = state.join(large, comp)
        # the heavy nodes of a component are a path from its top, of falling weight
        heavy = split.where(2 * F.col("weight") > F.col("total"))
        centroids = heavy.groupBy(*comp).agg(F.min_by(F.struct("node", "depth", "weight"), "weight").alias("c"))
        centroids = cut(centroids.select(*comp, F.col("c.node").alias("c_node"), F.col("c.depth").alias("c_depth"), F.col("c.weight").alias("c_weight")), "centroids")
        known = _sized(centroids)
        # a node is below the centroid if its smallest member passes through it; the next node on that way is the top of its new component
        way = paths.select(F.col("conv_id").alias("_conv"), F.col("depth").alias("_depth"), F.col("node").alias("_next"), F.col("up").alias("_up"))
        met = split.drop("total").join(known, comp).join(way, (F.col("node") == F.col("_conv")) & (F.col("c_depth") + 1 == F.col("_depth")) & (F.col("depth") > F.col("c_depth")), "left")
        below = F.coalesce(F.col("_up") == F.col("c_node"), F.lit(False))
        here = (F.col("node") == F.col("c_node")) & (F.col("depth") == F.col("c_depth"))
        parted = cut(met.withColumn("_below", below).withColumn("_here", here).drop("_conv", "_depth", "_up"), "parted")
        parts = parted.where("_below or _here").groupBy(*comp, F.when(F.col("_below"), F.col("_next")).alias("_part")).agg(*[F.sum(v).alias(v) for v in values])
        totals = cut(parts.groupBy(*comp).agg(*[F.sum(v).alias(f"add_{v}") for v in values]).join(known, comp), "totals")
        adds = [f"add_{v}" for v in values]
        # the path from the centroid to the top, itself included
        on_path = _sized(totals).join(way, (F.col("c_node") == F.col("_conv")) & (F.col("_depth") >= F.col("top_depth")) & (F.col("_depth") <= F.col("c_depth")))
        on_path = cut(on_path.select(F.col("_next").alias("node"), F.col("_depth").alias("depth"), F.col("c_weight").alias("off"), *adds), "path")
        moved = parted.join(_sized(on_path), ["node", "depth"], "left")
        moved = moved.withColumns({s: F.col(s) + F.coalesce(a, F.lit(0)) for s, a in zip(sums, adds)} | {"weight": F.col("weight") - F.when(F.col("off").isNull() | F.col("_here"), 0).otherwise(F.col("off"))})
        moved = moved.withColumns({"top": F.when(F.col("_below"), F.col("_next")).otherwise(F.col("top")), "top_depth": F.when(F.col("_below"), F.col("c_depth") + 1).otherwise(F.col("top_depth"))})
        moved = cut(moved.select("_here", *state.columns), "moved")
        ended.append(moved.where("_here").select(*out_columns))
        state = moved.where("not _here").drop("_here")
    python_tasks(nodes.sparkSession)
    rest = asides[0]
    for a in asides[1:]:
        rest = rest.unionByName(a)
    done = rest.repartition(*comp).sortWithinPartitions(*comp).mapInPandas(_whole_components(values), ", ".join(f"{c} long" for c in out_columns))
    for e in ended:
        done = done.unionByName(e)
    return done


def _joined_ids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Parts of the lists of members: runs of rows of one node, at most PART_MEMBERS long."""
    for b in batches:
        if not len(b):
            continue
        node, depth = b["node"].to_numpy(), b["depth"].to_numpy()
        ids = b["conv_id"].astype(str).tolist()
        cuts = np.flatnonzero(np.r_[True, (node[1:] != node[:-1]) | (depth[1:] != depth[:-1])])
        cuts = np.unique(np.r_[cuts, np.arange(0, len(b), PART_MEMBERS)])
        bounds = list(zip(cuts.tolist(), np.r_[cuts[1:], len(b)].tolist()))
        yield pd.DataFrame({"node": node[cuts], "depth": depth[cuts], "first": b["conv_id"].to_numpy()[cuts], "ids": [",".join(ids[x:y]) for x, y in bounds]})


def _digest_parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One digest for each node from its parts in order; only the digest's state is held."""
    key, digest = None, None
    for b in batches:
        out = []
        for node, depth, ids in zip(b["node"].tolist(), b["depth"].tolist(), b["ids"]):
            if (node, depth) == key:
                digest.update(b",")
            else:
                if key is not None:
                    out.append((*key, digest.hexdigest()))
                key, digest = (node, depth), hashlib.sha256()
            digest.update(ids.encode())
        yield pd.DataFrame(out, columns=["node", "depth", "ends_sha256"])
    if key is not None:
        yield pd.DataFrame([(*key, digest.hexdigest())], columns=["node", "depth", "ends_sha256"])


def ends(paths: DataFrame, lengths: DataFrame) -> DataFrame:
    """(node, depth, ends_sha256) of nodes where conversations end: SHA-256 of their ids, ascending, with commas between.

    Ids are joined to parts where they lie by range; the digest of a node is one stream over its parts.
    """
    python_tasks(paths.sparkSession)
    rows = cut(paths.join(lengths.withColumnRenamed("length", "depth"), ["conv_id", "depth"]).select("node", "depth", "conv_id"), "ends")
    order = ["node", "depth", "conv_id"]
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(_joined_ids, "node long, depth long, first long, ids string")
    return parts.repartition("node", "depth").sortWithinPartitions("node", "depth", "first").mapInPandas(_digest_parts, "node long, depth long, ends_sha256 string")


def trie(turns: DataFrame, lengths: DataFrame, whole: int = WHOLE) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): a row for each node.

    turns: (conv_id, turn from 1 without gaps, sha, words); lengths: (conv_id, length), a row for each conversation, those without
    turns too. conv_id is a node's smallest member, n_leaves counts childless nodes in its subtree, itself included, and saved_tokens adds
    up (n_convs - 1) * words of the last turn over the subtree. No conversation, no row. A first turn, a whole conversation or a conv_id
    with a third of all rows is split by range, aggregated before it moves, or met by broadcast.
    """
    prefixes = hashed_prefixes(turns, lengths)
    paths, nodes = paths_and_nodes(prefixes)
    nodes = nodes.withColumns({"leaves": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("words")})
    key = ["node", "depth"]
    sums = subtree_sums(nodes, paths, ["leaves", "saved"], whole)
    out = nodes.select(*key, "up", "n_convs", "n_children").join(sums, key).join(ends(paths, lengths), key, "left")
    return out.select(
        F.col("node").alias("conv_id"), "depth", F.col("up").alias("parent_conv_id"), "n_convs", "n_children", F.col("sum_leaves").alias("n_leaves"), F.col("sum_saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame, whole: int = WHOLE) -> DataFrame:
    """The trie of the conversations as they are (columns conv_id, turn, role, text; others are not read)."""
    turns = ordered_turns(conversations)
    return trie(turns, cut(turns.groupBy("conv_id").agg(F.count("*").alias("length")), "lengths"), whole)


def rebuilt_trie(conversations: DataFrame, whole: int = WHOLE) -> DataFrame:
    """The trie of the conversations rebuilt by `with_shared_heads`, as `trie` returns it."""
    turns, lengths = with_shared_heads(ordered_turns(conversations))
    return trie(turns, cut(lengths, "lengths"), whole)


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rebuilt_trie(table(spark, sf_dir, "conversations"))


OP12_SQL = r"""
WITH own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS t
  FROM conversations WHERE conv_id IS NOT NULL),
counted AS (SELECT conv_id, conv_id - conv_id % 20 AS base, count(*) AS n FROM own GROUP BY conv_id),
-- CRC-32 by bits: a character is added to the register, then eight times -1 stands for a shift
hashed AS (
  SELECT conv_id, base, n,
         xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
                         lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END), 4294967295::BIGINT) % 4 AS h
  FROM counted),
convs AS (
  SELECT c.conv_id, c.base, c.h, least(c.h, coalesce(b.n, 0)) AS taken, least(c.h, coalesce(b.n, 0)) + greatest(c.n - c.h, 0) AS length
  FROM hashed c LEFT JOIN hashed b ON b.conv_id = c.base),
turns AS (
  SELECT c.conv_id, c.length, o.t - c.h + c.taken AS d, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.conv_id WHERE o.t > c.h
  UNION ALL SELECT c.conv_id, c.length, o.t, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.base WHERE o.t <= c.taken
  UNION ALL SELECT conv_id, length, 0, '', '' FROM convs),
prefixes AS (
  SELECT conv_id, length, d, text,
         sha256(string_agg(CASE WHEN d = 0 THEN '' ELSE sha256(length(role)::VARCHAR || ':' || role || text) END, '') OVER (PARTITION BY conv_id ORDER BY d)) AS k
  FROM turns),
nodes AS (
  SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs,
         (count(*) - 1) * (CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(min(text), '[^\x20\x09-\x0D]+')) END) AS saved,
         sha256(coalesce(string_agg(CASE WHEN length = d THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM prefixes GROUP BY k, d),
above AS (
  SELECT n.k, n.d, p.k AS up FROM nodes n JOIN prefixes p ON p.conv_id = n.conv_id AND p.d = n.d - 1),
children AS (SELECT up, count(*) AS n_children FROM above GROUP BY up),
full_nodes AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.up = n.k),
sums AS (
  SELECT p.k, count(*) FILTER (u.n_children = 0) AS n_leaves, sum(u.saved)::BIGINT AS saved_tokens
  FROM full_nodes u JOIN prefixes p ON p.conv_id = u.conv_id AND p.d <= u.d GROUP BY p.k)
SELECT n.conv_id, n.d AS depth, v.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM full_nodes n JOIN sums s ON s.k = n.k LEFT JOIN above a ON a.k = n.k LEFT JOIN nodes v ON v.k = a.up
"""
