"""The prefix trie against SQL and against a trie built node by node."""

import hashlib
import random
import zlib

import pytest

import __spark_entry__ as contract
from almanac.llm import prefix_trie, queries
from tools.check_oracle import compare, connect

SF = "/root/testdata/sf0.001"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(built):
    """Nodes of {conv_id: [(role, text), ...]} as tuples of COLUMNS."""
    members = {}
    for c, w in built.items():
        for d in range(len(w) + 1):
            members.setdefault(tuple(w[:d]), []).append(c)
    kids = {p: 0 for p in members}
    for p in members:
        if p:
            kids[p[:-1]] += 1
    rows = []
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(p))
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q)
        parent = min(members[p[:-1]]) if p else None
        rows.append((min(m), len(p), parent, len(m), kids[p], sum(not kids[q] for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=str)


def rebuilt(turns):
    own = {}
    for c, t, role, text in sorted((r for r in turns if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0)):
        own.setdefault(c, []).append((role or "", text or ""))
    out = {}
    for c, w in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = own.get(base, [])[:h] + w[h:]
    return out


def found(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.1"])
def test_sql(spark, sf):
    assert compare(spark, connect(sf), sf, "op12_prefix_trie").startswith("ok")


@pytest.mark.parametrize(("parts", "seed"), [(1, 0), (2, 1), (5, 2), (30, 3), (200, 4)])
def test_nodes_are_the_same_for_any_shards(spark, monkeypatch, parts, seed):
    """Random conversations over few turns, with copies and chains, cut into more or fewer shards than they have nodes."""
    monkeypatch.setattr(prefix_trie, "PIECE", 12)
    monkeypatch.setattr(prefix_trie, "FLUSH", 3)
    rng = random.Random(seed)
    turns = [("user", "a"), ("user", "bb"), ("assistant", "a"), ("", "ccc")]
    built = {}
    for c in rng.sample(range(-500, 5000), 120):
        kind = rng.random()
        if kind < 0.3:
            built[c] = [turns[0]] * 3  # a third are copies of one
        elif kind < 0.4:
            built[c] = []
        else:
            built[c] = [rng.choice(turns) for _ in range(rng.randrange(7))]
    rows = [(c, i, *w) for c, ws in built.items() for i, w in enumerate(ws)]
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
        paths = prefix_trie.sequences(df).select("conv_id", prefix_trie.path_of("tokens").alias("path"))
        empty = spark.createDataFrame([(c, bytearray()) for c, w in built.items() if not w], "conv_id bigint, path binary")
        assert found(prefix_trie.prefix_trie(paths.union(empty))) == plain(built)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_odd_conversations(spark):
    """Nulls anywhere, negative ids, no base, repeated turns, other widths of numbers, long ones, clashing columns."""
    turns = [
        (100, 0, "user", "base"), (100, 1, "assistant", "more"), (100, 2, "user", "and"), (100, 3, "user", "so"), (100, 4, "user", "on"),
        (101, None, "user", "first"), (101, 3, "user", "x"), (101, -2, None, None), (102, 0, "user", "short"),
        (205, 0, "user", "no base"), (205, 1, None, "é\U0001f600"), (-3, 0, "user", "below"), (-103, 5, "user", "below"), (-100, 0, "user", "base"),
        (None, 0, "user", "no id"), (107, 0, "user", ""), (108, 0, "", ""), (109, 0, None, None),
    ]
    turns += [(300 + k % 2, i, "user", "again and again") for i in range(300) for k in range(2)]
    schema = "conv_id int, turn int, role string, text string, tokens string, path int, h string, shard string"
    df = spark.createDataFrame([(*t, "mine", 4, "kept", "s") for t in turns], schema)
    assert found(prefix_trie.prefix_trie(queries.rebuilt(df))) == plain(rebuilt(turns))
    assert found(prefix_trie.prefix_trie(queries.rebuilt(df.limit(0)))) == []
    one = found(prefix_trie.prefix_trie(queries.rebuilt(df.where("conv_id = 205"))))
    assert one == plain(rebuilt([t for t in turns if t[0] == 205]))


def test_ties_of_a_turn_have_one_order(spark):
    rows = [(1, 0, "user", t) for t in "abcd"]
    runs = []
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order + order, "conv_id int, turn int, role string, text string").repartition(3)
        runs.append(prefix_trie.sequences(df).first()["tokens"])
    assert runs[0] == runs[1] and len(runs[0]) == 8


def test_registered():
    assert "op12_prefix_trie" in contract.queries() and "op12_prefix_trie" in contract.oracle_sql()
