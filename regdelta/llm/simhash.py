"""SimHash near-duplicates by a binary trie self-join.

A sorted array of fingerprints is a binary trie: a node is a range of the array whose
members agree in the bits read so far. The self-join walks pairs of nodes downwards, one
bit at a time, adds up the bits in which the two paths differ and drops a pair as soon
as the sum is over the error budget.

To share the walk out, the blocks of a fingerprint are moved so that each in turn comes
first. Of four 16-bit blocks that hold at most three errors one holds none, so in some
order the two fingerprints lie below the same node at depth 16. These nodes are the groups
that Spark deals out. Beyond 2^30 fingerprints it is each three of six blocks that come
first, and the nodes lie at depth 31 to 33. A group that is too large for a task is replaced
by pairs of its child nodes, eight bits deeper, that are still within the budget, and so on.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regdelta.llm.common import cut, leave_out, python_tasks, table
from regdelta.llm.components import components

BUDGET = 3
#: Fingerprints that one task's walk takes at once; larger nodes are divided.
NODE_ROWS = 1 << 16
#: Node pairs that a walk holds at once; more are walked one part after the other.
FRONTIER = 1 << 20


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the ASCII-lowercased words of a text; zero if it has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.r_[0, ends[:-1] + 1].tolist()
    width = min(shingle, len(words))
    spans = zip(starts[: len(words) - width + 1], ends[width - 1 :].tolist())
    h = np.fromiter((digest(joined[s:e], seed) for s, e in spans), np.uint64, len(words) - width + 1)
    set_bits = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        part = h[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(set_bits * 2 > len(h)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        h = np.fromiter((fingerprint(t) for t in b.column("body").to_pylist()), np.uint64, b.num_rows)
        kept = [c for c in b.schema.names if c != "body"]
        yield pa.RecordBatch.from_arrays([*map(b.column, kept), pa.array(h.view(np.int64))], [*kept, "fp"])


def text_key(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keyed: bool = False) -> DataFrame:
    """(doc_id, fp): the fingerprint of every whole text as a signed 64-bit integer. keyed: with text_key between them."""
    python_tasks(docs.sparkSession)
    key = [text_key(text_col).alias("text_key")] if keyed else []
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *key, F.col(text_col).alias("body"))
    return rows.mapInArrow(_fingerprints, "doc_id long, text_key long, fp long" if keyed else "doc_id long, fp long")


class Roots:
    """Union-find over array positions; the root of a set is its least position."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        while True:
            y = self.up[x]
            z = self.up[y]
            if np.array_equal(y, z):
                return y
            self.up[x] = z
            x = z if len(x) < 64 else x

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.find(a), self.find(b)
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.up, np.maximum(ra, rb), np.minimum(ra, rb))


def walk(f: np.ndarray, pairs: list[np.ndarray], roots: Roots, depth: int, budget: int = BUDGET) -> None:
    """Joins positions of f whose members differ in at most `budget` bits.

    f: fingerprints, sorted within every node. pairs: node pairs as arrays of
    (start, end) of the one, (start, end) of the other, and the bits in which they
    differ so far; all at the same depth. A node may be paired with itself.
    """
    stack = [(depth, *pairs)]
    zero = np.uint64(0)
    while stack:
        depth, a0, a1, b0, b1, e = stack.pop()
        while len(a0):
            if len(a0) > FRONTIER:
                half = len(a0) // 2
                stack.append((depth, a0[half:], a1[half:], b0[half:], b1[half:], e[half:]))
                a0, a1, b0, b1, e = a0[:half], a1[:half], b0[:half], b1[:half], e[:half]
            single = (a1 - a0 == 1) & (b1 - b0 == 1)
            if single.any():
                x, y = a0[single], b0[single]
                near = np.bitwise_count(f[x] ^ f[y]) <= budget
                roots.join(x[near & (x != y)], y[near & (x != y)])
                a0, a1, b0, b1, e = (v[~single] for v in (a0, a1, b0, b1, e))
                if not len(a0):
                    break
            if depth == 64:
                # equal paths to the last bit: all members of both nodes link
                roots.join(a0, b0)
                break
            bit = np.uint64(1) << np.uint64(63 - depth)
            ones = np.r_[0, np.cumsum((f & bit) != zero)]
            am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
            same = (a0 == b0) & (a1 == b1)
            kids = [
                (a0, am, b0, bm, e, np.ones(len(e), bool)),
                (am, a1, bm, b1, e, np.ones(len(e), bool)),
                (a0, am, bm, b1, e + 1, e < budget),
                (am, a1, b0, bm, e + 1, (e < budget) & ~same),
            ]
            kept = [[v[k] for v in vs] for *vs, ok in kids for k in [ok & (vs[1] > vs[0]) & (vs[3] > vs[2])]]
            a0, a1, b0, b1, e = (np.concatenate(v) for v in zip(*kept))
            depth += 1


def _layout(widths: tuple[int, ...], held: int) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """For each choice of `held` blocks: their bits in all, and how the blocks move when these come first.

    A move is (shift to the right, mask, shift to the left). With `held` of held + BUDGET blocks, any two
    fingerprints within the budget agree on all blocks of some choice.
    """
    from_right = [64 - sum(widths[: i + 1]) for i in range(len(widths))]
    tables = []
    for first in combinations(range(len(widths)), held):
        order, left, moves = [*first, *(i for i in range(len(widths)) if i not in first)], 64, []
        for i in order:
            left -= widths[i]
            moves.append((from_right[i], (1 << widths[i]) - 1, left))
        tables.append((sum(widths[i] for i in first), moves))
    return tables


#: Four tables with keys of 16 bits; twenty with keys of 31 to 33 bits, for so many fingerprints that
#: nodes of 16 bits would all be large: division would multiply each row by up to 93.
NARROW, WIDE = _layout((16,) * 4, 1), _layout((11, 11, 11, 11, 10, 10), 3)
TABLES = NARROW + WIDE


def _restored(f: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The fingerprints whose blocks were moved for these tables."""
    out = np.empty_like(f)
    for t in np.unique(table):
        at = table == t
        out[at] = sum(((f[at] >> np.uint64(left)) & np.uint64(mask)) << np.uint64(right) for right, mask, left in TABLES[t][1])
    return out


def _links(rows: pd.DataFrame) -> pd.DataFrame:
    """Walks the node pairs of some groups together; emits a link to its root for each member that has another root.

    rows: grp, side (0: the one node, 1: the other, 2: a node with itself), spent, depth, f (its blocks moved), tab (index in TABLES).
    """
    rows = rows.assign(f=rows["f"].to_numpy(np.int64).view(np.uint64)).sort_values(["grp", "side", "f"], kind="stable")
    f, grp, side = rows["f"].to_numpy(), rows["grp"].to_numpy(), rows["side"].to_numpy()
    spent, depth = rows["spent"].to_numpy(np.int64), rows["depth"].to_numpy(np.int64)
    starts = np.flatnonzero(np.r_[True, (grp[1:] != grp[:-1]) | (side[1:] != side[:-1])])
    ends = np.r_[starts[1:], len(f)]
    roots = Roots(len(f))
    for d in np.unique(depth):
        own = np.flatnonzero((side[starts] == 2) & (depth[starts] == d))
        first = np.flatnonzero((side[starts] == 0) & (depth[starts] == d))
        first = first[first + 1 < len(starts)]
        first = first[(grp[starts[first + 1]] == grp[starts[first]])]
        a = np.r_[own, first]
        b = np.r_[own, first + 1]
        walk(f, [starts[a], ends[a], starts[b], ends[b], spent[starts[a]]], roots, int(d))
    at = roots.find(np.arange(len(f)))
    moved = at != np.arange(len(f))
    plain = _restored(f, rows["tab"].to_numpy(np.int64)).view(np.int64)
    return pd.DataFrame({"a": plain[moved], "b": plain[at[moved]]})


def _walk_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """batches come sorted by group; whole groups are gathered up to NODE_ROWS rows and walked together."""
    held: list[pd.DataFrame] = []
    n = 0
    for b in batches:
        held.append(b)
        n += len(b)
        if n >= NODE_ROWS:
            rows = pd.concat(held)
            last = rows["grp"].iloc[-1]
            ready = rows[rows["grp"] != last]
            held = [rows[rows["grp"] == last]]
            n = len(held[0])
            if len(ready):
                yield _links(ready)
    if n:
        yield _links(pd.concat(held))


NODE = "grp string, side int, spent int, depth int, f long, tab int"


def _nodes(fps: DataFrame, layout: list) -> DataFrame:
    rows = []
    for t, (depth, moves) in enumerate(layout, TABLES.index(layout[0])):
        blocks = [F.shiftleft(F.shiftrightunsigned("fp", right).bitwiseAND(F.lit(mask).cast("long")), left) for right, mask, left in moves]
        f = reduce(Column.bitwiseOR, blocks)
        key = F.concat(F.lit(f"{t}:"), F.lower(F.hex(F.shiftrightunsigned(f, 64 - depth))))
        rows.append(F.struct(key.alias("grp"), F.lit(2).alias("side"), F.lit(0).alias("spent"), F.lit(depth).alias("depth"), f.alias("f"), F.lit(t).alias("tab")))
    return fps.select(F.inline(F.array(*rows)))


def _divide(nodes: DataFrame) -> DataFrame:
    """Replaces node pairs by the pairs of their children eight bits deeper that are within the budget.

    A child takes part in the pairs whose partner exists; the partner is found by
    toggling at most the bits that the budget leaves.
    """
    byte = F.expr("shiftrightunsigned(f, 56 - depth)").bitwiseAND(F.lit(255)).cast("int")
    masks = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(bin(m).count("1")).alias("c")) for m in range(256) if bin(m).count("1") <= BUDGET])
    # side 2: child x with itself, and with x ^ m for m > 0; the lesser of the two is side 0
    spread = nodes.withColumn("x", byte).withColumn("t", F.explode(masks)).where(F.col("spent") + F.col("t.c") <= BUDGET)
    partner = F.col("x").bitwiseXOR(F.col("t.m"))
    own = F.col("side") == 2
    left = F.when(own, F.least("x", partner)).when(F.col("side") == 0, F.col("x")).otherwise(partner)
    right = F.when(own, F.greatest("x", partner)).when(F.col("side") == 0, partner).otherwise(F.col("x"))
    new_side = F.when(own & (F.col("t.m") == 0), F.lit(2)).when(own, F.when(F.col("x") < partner, 0).otherwise(1)).otherwise(F.col("side"))
    return spread.select(
        F.concat_ws("/", "grp", left.cast("string"), right.cast("string")).alias("grp"),
        new_side.cast("int").alias("side"),
        (F.col("spent") + F.col("t.c")).cast("int").alias("spent"),
        (F.col("depth") + 8).alias("depth"),
        "f",
        "tab",
    )


def near_links(fps: DataFrame, layout: list | None = None) -> DataFrame:
    """(a, b): links between different fingerprints, enough of them to connect whatever lies within the budget.

    layout: NARROW or WIDE, by the number of fingerprints if not given; the links connect the same.
    """
    if layout is None:
        layout = NARROW if fps.count() <= NODE_ROWS << 14 else WIDE
    parts, deepest = _nodes(fps, layout), max(depth for depth, _ in layout)
    found = None
    for level in range(7):
        sizes = parts.groupBy("grp").agg(F.count("*").alias("n"), F.countDistinct("side").alias("sides"), F.max("side").alias("kind"))
        # a group needs two members: two of one node, or one on either side
        sizes = cut(sizes.where("n > 1 and (kind = 2 or sides = 2)"), "nodes")
        large = sizes.where(F.col("n") > NODE_ROWS).select("grp")
        last = deepest + 8 * (level + 1) > 64 or large.isEmpty()
        fit = sizes.select("grp") if last else sizes.where(F.col("n") <= NODE_ROWS).select("grp")
        ready = parts.join(fit, "grp", "left_semi")
        links = ready.repartition("grp").sortWithinPartitions("grp").mapInPandas(_walk_groups, "a long, b long")
        found = links if found is None else found.unionByName(links)
        if last:
            return found
        parts = cut(_divide(parts.join(large, "grp", "left_semi")), "children")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint, component_id: one row per input row.

    Words are what is left of the text, A-Z lowered, between ASCII blanks; a text of
    one or two words has one shingle, a text without words (null and empty included)
    fingerprint zero, which links like any other. Equal fingerprints form one vertex,
    so copies and repeated rows cost nothing beyond their own row. component_id is the
    smallest id reachable; null ids take part, and a component of null ids alone keeps
    null. An empty input gives an empty result. Other columns are not read.
    """
    return _members(cut(fingerprints(docs, id_col, text_col), "simhash")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def _members(marks: DataFrame) -> DataFrame:
    """The rows of marks with root, a fingerprint that names the component, and component_id."""
    least = cut(marks.groupBy("fp").agg(F.min("doc_id").alias("least")), "vertices")
    links = cut(near_links(least.select("fp")), "links")
    root = components(links, "stars").select(F.col("a").alias("fp"), F.col("b").alias("root"))
    member = least.join(root, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    smallest = member.groupBy("root").agg(F.min("least").alias("component_id"))
    return marks.join(member.join(smallest, "root").select("fp", "root", "component_id"), "fp", "left")


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component stays: the row with its smallest id, and of rows that share that id the first by text_key.

    All columns are kept. Null ids come last. A row is known by its id and its text_key, so an
    id that stands on texts of several components is decided in each of them.
    """
    marks = _members(cut(fingerprints(docs, id_col, text_col, keyed=True), "simhash"))
    alike = cut(marks.groupBy("root", "doc_id", "text_key").agg(F.count("*").alias("n")), "alike")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key", "n")).alias("r")
    keep = cut(alike.groupBy("root").agg(first).select(F.col("r.doc_id").alias("_keep"), F.col("r.text_key").alias("_kept"), F.col("r.n").alias("_n")), "keep")
    going = alike.join(keep, F.col("doc_id").eqNullSafe(F.col("_keep")) & (F.col("text_key") == F.col("_kept")), "left_anti")
    key = ["_leave_id", "_leave_key"]
    same = F.col(id_col).cast("long").eqNullSafe(F.col("_leave_id")) & (text_key(text_col) == F.col("_leave_key"))
    return leave_out(docs, going.select("doc_id", "text_key").toDF(*key), keep.where("_n > 1").select("_keep", "_kept").toDF(*key), same)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
