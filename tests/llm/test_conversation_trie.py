import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from regdelta.llm import conversation_trie as C

SCHEMA = "conv_id long, turn long, role string, text string, depth string, words string"


def brute(rows, rebuild=True):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(x)] for c, x in own.items()}
    built = {}
    for c, x in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(turns.get(c - int(math.fmod(c, 20)), [])[:h] + x[h:]) if rebuild else tuple(x)
    members = defaultdict(list)
    for c, x in built.items():
        for d in range(len(x) + 1):
            members[x[:d]].append(c)
    children = defaultdict(int)
    leaves, saved = defaultdict(int), defaultdict(int)
    for x in members:
        if x:
            children[x[:-1]] += 1
    for x, m in members.items():
        cost = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) if x else 0
        for d in range(len(x) + 1):
            saved[x[:d]] += cost
            leaves[x[:d]] += x not in children
    out = []
    for x, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(x))
        out.append((min(m), len(x), min(members[x[:-1]]) if x else None, len(m), children.get(x, 0), leaves[x], saved[x], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def some_rows(convs, seed=1, longest=9):
    draw = random.Random(seed)
    texts = ["", None, "a b", "hello  there\tyou", "x" * 40, "é ü"]
    rows = []
    for i in range(convs):
        c = draw.choice((i, i, i, i + 1000, -i))
        for t in range(draw.choice((1, 2, 3, 4, 5, longest))):
            rows.append((c, draw.choice((t, t, t, None)), draw.choice(("user", "bot", None)), draw.choice(texts[: 1 + draw.randrange(6)]), "p", None))
    return rows + rows[:7]


def result(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


@pytest.mark.parametrize("whole", [40, 1 << 12])
def test_rebuilt_conversations_equal_the_definition(spark, whole):
    rows = some_rows(90) + [(None, 0, "user", "lost", "", "")]
    got = C.rebuilt_trie(spark.createDataFrame(rows, SCHEMA).repartition(5), whole)
    assert result(got) == brute(rows)


@pytest.mark.parametrize("shape", ["path", "comb", "star", "copies"])
def test_shapes_are_split_to_single_nodes(spark, shape):
    rows = {
        "path": [(3, i, "u", f"w {i}") for i in range(12)],
        "comb": [(c, i, "u", f"w {i}" if i < c else f"end {c}") for c in range(6) for i in range(c + 1)],
        "star": [(c, 0, "u", f"only {c} w") for c in range(20)],
        "copies": [(c, i, "u", f"a b {i}") for c in range(40) for i in range(5)] + [(99, 0, "u", "a b 0"), (98, 0, "u", "other")],
    }[shape]
    got = C.conversation_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 1)
    assert result(got) == brute(rows, rebuild=False)


def test_no_conversation_and_none_with_turns_left(spark):
    assert result(C.rebuilt_trie(spark.createDataFrame([], SCHEMA))) == []
    # no base, and fewer turns than are left out
    rows = [(c, 0, "u", "t", "", "") for c in (21, 23, 25, 27, 29)]
    assert result(C.rebuilt_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_a_conversation_over_many_partitions_hashes_as_one(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(c, i, "u", f"turn {i} of many" if i < 290 else f"own {c}", "", "") for c in (1, 2, 3) for i in range(300)]
        table = spark.createDataFrame(rows, SCHEMA)
        turns = C.ordered_turns(table)
        lengths = turns.groupBy("conv_id").agg(F.count("*").alias("length"))
        same = C.hashed_prefixes(turns, lengths).groupBy("depth", "a", "b").count().groupBy("count").count().collect()
        assert {r[0]: r[1] for r in same} == {3: 291, 1: 30}
        assert result(C.conversation_trie(table, 50)) == brute(rows, rebuild=False)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_query_on_the_smallest_tables(spark):
    sf = "/root/testdata/sf0.001"
    got = C.op12_conversation_trie(spark, sf)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert dict(got.dtypes) == dict.fromkeys(("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"), "bigint") | {"ends_sha256": "string"}
    assert result(got) == brute(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{sf}/conversations.parquet')")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(con.sql(C.OP12_SQL).project(", ".join(columns)).fetchall(), key=str) == brute(rows)
