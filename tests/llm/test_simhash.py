import numpy as np
import pytest
import xxhash

from regdelta.llm import simhash as S


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\x0b\x0c\r":
        words = words.replace(blank, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def least_reachable(fps, ids):
    f = np.array(fps, np.uint64)
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= S.BUDGET
    best = np.array(ids)
    while True:
        new = np.array([best[row].min() for row in near])
        if (new == best).all():
            return best.tolist()
        best = new


@pytest.mark.parametrize("text", [None, "", " \n", "one", "One TWO", "a b c d", "Ärger ÄRGER x\x1fy z", "la la la la", "x\ty\x0bz\x0cq " * 50])
def test_fingerprint(text):
    assert S.fingerprint(text) == plain_fingerprint(text)


def clustered(n, seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, 5, dtype=np.uint64)
    out = []
    for i in range(n):
        x = int(base[rng.integers(5)]) if i % 4 else int(rng.integers(0, 2**63))
        for b in rng.integers(0, 64, rng.integers(0, 5)):
            x ^= 1 << int(b)
        out.append(x)
    return sorted(set(out))


@pytest.mark.parametrize("node_rows,frontier,layout", [(1 << 16, 1 << 20, S.NARROW), (3, 7, S.NARROW), (3, 7, S.WIDE), (1 << 16, 1 << 20, S.WIDE)])
def test_components_match_brute_force(spark, monkeypatch, node_rows, frontier, layout):
    """With nodes of three rows, the division of large nodes does most of the work."""
    monkeypatch.setattr(S, "NODE_ROWS", node_rows)
    monkeypatch.setattr(S, "FRONTIER", frontier)
    fps = clustered(250, 3)
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    links = S.near_links(spark.createDataFrame([(x,) for x in signed], "fp long"), layout)
    pairs = [(r.a, r.b) for r in links.collect()]
    at = {x: i for i, x in enumerate(signed)}
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        assert bin((a ^ b) & (2**64 - 1)).count("1") >= 1
        x, y = find(at[a]), find(at[b])
        root[max(x, y)] = min(x, y)
    assert [find(i) for i in range(len(fps))] == least_reachable(fps, range(len(fps)))


SCHEMA = "doc_id long, text string, component_id string, fp string, a string"


def test_documents(spark):
    words = [f"w{i}" for i in range(400)]
    rows = [
        (5, " ".join(words), "x", "y", "z"),
        (9, " ".join([*words[:200], "changed", *words[201:]]), "x", "y", "z"),
        (5, " ".join(words), "x", "y", "z"),
        (3, None, None, None, None),
        (2, "", None, None, None),
        (None, " \t", None, None, None),
        (7, "x" * 500_000, "x", "y", "z"),
        (8, "alone here", "x", "y", "z"),
    ]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in S.near_duplicates(docs).collect()), key=str)
    fps = [plain_fingerprint(r[1]) for r in rows]
    least = least_reachable(fps, [10**9 if r[0] is None else r[0] for r in rows])
    assert got == sorted(((r[0], f"{f:016x}", c) for r, f, c in zip(rows, fps, least)), key=str)
    kept = S.without_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(least))


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert S.near_duplicates(empty).count() == 0 and S.without_near_copies(empty).count() == 0


def test_null_and_repeated_ids_keep_a_row_of_each_component(spark):
    text = lambda k: " ".join(f"{k}{i}" for i in range(300))
    near = text("a").upper()
    rows = [
        *[(None, t, "", "", "") for t in (text("a"), near, text("b"), text("b"), text("c"))],
        *[(5, t, "", "", "") for t in (text("d"), text("e"), text("e"))],
        (None, text("d"), "", "", ""),
        (4, text("e"), "", "", ""),
    ]
    kept = [(r.doc_id, r.text) for r in S.without_near_copies(spark.createDataFrame(rows, SCHEMA)).collect()]
    one = [t for i, t in kept if t in (text("a"), near)]
    assert len(one) == 1
    rest = sorted(((i, t) for i, t in kept if t not in one), key=str)
    assert rest == sorted([(None, text("b")), (None, text("c")), (5, text("d")), (4, text("e"))], key=str)
