"""The prefix trie against brute force, with shards of all sizes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sparkgas.llm import prefix_trie as pt

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def rebuilt(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}:{text}".encode()).hexdigest(), role, text))
    own = {c: [t[3:] for t in sorted(found)] for c, found in turns.items()}
    return {c: own.get(c - c % 5, [])[: zlib.crc32(str(c).encode()) % 9] + own[c][zlib.crc32(str(c).encode()) % 9 :] for c in own}


def nodes(sequences):
    members, ends, below = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, turns in sorted(sequences.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                below[tuple(turns[: d - 1])].add(tuple(turns[:d]))
        ends[tuple(turns)].append(c)
    out = []
    for path, convs in members.items():
        under = [p for p in members if p[: len(path)] == path]
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in under if p)
        digest = hashlib.sha256(",".join(map(str, ends.get(path, ()))).encode()).hexdigest()
        parent = members[path[:-1]][0] if path else None
        out.append((convs[0], len(path), parent, len(convs), len(below[path]), sum(not below[p] for p in under), saved, digest))
    return sorted(out, key=lambda n: n[:2])


def found(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=lambda n: n[:2])


def trie(chats, shard_turns=pt.SHARD_TURNS):
    return pt.prefix_trie(pt.share_heads(pt.encode(chats)), shard_turns)


def odd_rows():
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "çç", "", None])) for c in range(-6, 40) for t in range(rng.randint(1, 5))]
    rows += [(41, None, "user", "no turn"), (41, 0, "user", "x"), (41, 0, "user", "x"), (41, 0, "assistant", "x"), (None, 0, "user", "nobody's")]
    # many equal conversations, one of a single turn, one long
    rows += [(c, t, "user", f"same {t}") for c in range(100, 190, 5) for t in range(3)] + [(203, 0, "user", "own")]
    return rows + [(300, t, "user", "long") for t in range(60)] + [(305, t, "user", "long") for t in range(45)]


@pytest.mark.parametrize("shard_turns", [1, 9, 60, pt.SHARD_TURNS])
def test_odd_rows_against_brute_force(spark, shard_turns):
    rows = odd_rows()
    chats = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({c: F.lit("clash") for c in ("ids", "sizes", "digest", "id", "t", "node", "kind")})
    assert found(trie(chats, shard_turns)) == nodes(rebuilt(rows))


def test_whole_table_against_brute_force(spark):
    chats = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in chats.collect()]
    assert found(trie(chats, 50)) == nodes(rebuilt(rows))


def test_nothing_and_turnless(spark):
    chats = spark.createDataFrame([], SCHEMA)
    assert trie(chats).collect() == []
    # 7 takes over one turn of the missing conversation 5, and has no more of its own
    few = next(c for c in range(6, 10_000) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 0)
    only = spark.createDataFrame([(few, 0, "user", "hello")], SCHEMA)
    assert found(trie(only)) == [(few, 0, None, 1, 0, 1, 0, hashlib.sha256(str(few).encode()).hexdigest())]


def test_median_insertion_keeps_the_tree_low():
    order = list(pt.balanced(1000))
    assert sorted(order) == list(range(1000)) and order[0] == 500
    tree = pt.SearchTree()
    for i in order:
        tree.insert([i], [1], [i])
    deepest, todo = 0, [(tree.equal[0], 1)]
    while todo:
        at, depth = todo.pop()
        if at:
            deepest = max(deepest, depth)
            todo += [(tree.low[at], depth + 1), (tree.high[at], depth + 1)]
    assert deepest <= 11


def test_a_hot_first_turn_is_spread(spark):
    """A third of all conversations begin alike: their rows are dealt over all shards."""
    chats = spark.range(3000).select(
        F.col("id").alias("conv_id"), F.explode(F.expr("array(0L, 1L)")).alias("turn"), F.lit("user").alias("role")
    ).withColumn("text", F.when((F.col("turn") == 0) & (F.col("conv_id") % 3 == 0), "hello").otherwise(F.concat_ws("-", "conv_id", "turn")))
    rows = [tuple(r) for r in chats.collect()]
    got = found(trie(chats, 100))
    sequences = rebuilt(rows)
    root = [n for n in got if n[1] == 0][0]
    assert root[3] == 3000 and sum(n[3] for n in got if n[1] == 1) == sum(bool(s) for s in sequences.values())
    assert len(got) == len({tuple(s[:d]) for s in sequences.values() for d in range(len(s) + 1)})
