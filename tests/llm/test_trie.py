"""The prefix trie against a plain version, its contraction on odd trees, and its edge cases."""

import collections
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from docweave.llm import trie

TURNS = "conv_id long, turn long, role string, text string"


def plain(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - c % 5 if c >= 0 else c + -c % 5, [])[:h] + own[c][h:]
    members = collections.defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    out = []
    for key, convs in members.items():
        below = [k for k in members if k[: len(key)] == key]
        children = sum(len(k) == len(key) + 1 for k in below)
        ends = ",".join(str(c) for c in sorted(convs) if len(built[c]) == len(key))
        saved = sum((len(members[k]) - 1) * len(k[-1][1].encode()) for k in below if k)
        leaves = sum(not any(len(x) == len(k) + 1 and x[: len(k)] == k for x in below) for k in below)
        out.append((min(convs), len(key), min(members[key[:-1]]) if key else None, len(convs), children, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def result(spark, rows, tmp_path):
    spark.createDataFrame(rows, TURNS).withColumns({"node": F.lit("mine"), "idx": F.lit(1)}).write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    return sorted((tuple(r) for r in trie.op11_trie(spark, str(tmp_path)).collect()), key=str)


def test_trie_equals_the_plain_version(spark, tmp_path):
    rng = random.Random(1)
    words = ["a", "b", "é", "", None]
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(words)) for c in range(120) for t in range(rng.randint(1, 7)) if c % 15 or c % 2]
    rows += [(7, None, "user", "first"), (7, 3, "user", "same"), (7, 3, "user", "same"), (None, 1, "user", "x"), (-3, 1, "user", "y")]
    rows += [(1000, t, "user", f"t{t}") for t in range(60)] + [(1001, t, "user", f"t{t}") for t in range(60)]
    assert result(spark, rows, tmp_path) == plain(rows)


def test_one_long_conversation_is_cut_among_tasks(spark, tmp_path):
    rows = [(5, t, "user", f"{t % 3}") for t in range(700)] + [(c, t, "user", "x") for c in range(10, 60) for t in range(2)]
    turns = trie.numbered_turns(spark.createDataFrame(rows, TURNS).repartition(8))
    got = turns.where("conv_id = 5").orderBy("idx").collect()
    assert [r.idx for r in got] == list(range(1, 701)) and len({r.prefix for r in got}) == 700
    assert result(spark, rows, tmp_path) == plain(rows)


def test_empty_table(spark, tmp_path):
    assert result(spark, [], tmp_path) == []
    assert result(spark, [(None, 1, "user", "x")], tmp_path) == []


@pytest.mark.parametrize("shape", ["chain", "star", "comb", "random"])
def test_contraction_equals_a_loop(spark, shape):
    rng, n = random.Random(shape), 150
    parent = {0: None}
    for i in range(1, n):
        parent[i] = {"chain": i - 1, "star": 0, "comb": i - 1 if i % 2 == 0 else max(0, i - 2), "random": rng.randrange(max(0, i - 3), i)}[shape]
    depth = {0: 0}
    for i in range(1, n):
        depth[i] = depth[parent[i]] + 1
    inner = set(parent.values())
    own = {i: (int(i not in inner), rng.randint(0, 9)) for i in range(n)}
    want = {i: list(own[i]) for i in range(n)}
    for i in sorted(parent, key=lambda i: -depth[i]):
        if i:
            want[parent[i]][0] += want[i][0]
            want[parent[i]][1] += want[i][1]
    key = lambda i: None if i is None else bytearray(i.to_bytes(16))
    nodes = spark.createDataFrame([(key(i), key(parent[i]), depth[i], *own[i]) for i in range(n)], "node binary, parent binary, depth long, leaves long, saved long")
    got = {int.from_bytes(r.node): [r.leaves, r.saved] for r in trie.subtree_totals(nodes).collect()}
    assert got == want


def test_query_equals_sql(spark, small):
    import duckdb

    duckdb.sql(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{small}/conversations.parquet'")
    assert {tuple(r) for r in trie.op11_trie(spark, small).collect()} == set(duckdb.sql(trie.OP11_SQL).fetchall())
