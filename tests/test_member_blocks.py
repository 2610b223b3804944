"""Functions of whole sets of messages, held in blocks."""

import random

from pyspark.sql import functions as F

from sparkgas import PropertyGraph
from sparkgas.functions.reducers import MemberBlocks
from sparkgas.operators import messages


def size_and_top(block_ids=16):
    return MemberBlocks(
        lambda members: F.struct(F.size(members).alias("n"), F.array_max(members).alias("top")),
        lambda part: F.struct(F.sum(part["n"]).alias("n"), F.max(part["top"]).alias("top")),
        block_ids,
    )


def test_no_row_above_a_block(spark):
    """A third of the messages go to one key, which hears 5,000 numbers twice each."""
    msgs = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 50).alias("k"), (F.col("id") % 15_000).alias("v")
    )
    blocks = size_and_top().blocks(msgs, ["k"], "v")
    assert blocks.agg(F.max(F.size("_members"))).first()[0] <= 16
    assert blocks.where("k = -1").agg(F.sum(F.size("_members"))).first()[0] == 5_000
    got = {r["k"]: tuple(r["acc"]) for r in size_and_top().reduce(msgs, ["k"], "v", "acc").collect()}
    assert got[-1] == (5_000, 14_997) and len(got) == 51


def test_random_messages(spark):
    """Several key columns, negative numbers, repeats, NULL messages and NULL keys, with flags and without."""
    rng = random.Random(6)
    rows = [
        (rng.choice([None, "a"]), rng.randrange(30), None if rng.random() < 0.4 else rng.randrange(-60, 60), rng.random() < 0.3)
        for _ in range(120)
    ]
    df = spark.createDataFrame(rows, "a string, b bigint, v bigint, f boolean").repartition(5)
    sets, flags = {}, {}
    for a, b, v, f in rows:
        flags[a, b] = flags.get((a, b), False) or f
        if v is not None:
            sets.setdefault((a, b), set()).add(v)
    want = {k: (len(s), max(s)) for k, s in sets.items()}
    plain = size_and_top().reduce(df, ["a", "b"], "v", "acc").collect()
    assert {(r["a"], r["b"]): tuple(r["acc"]) for r in plain} == want
    flagged = size_and_top().reduce(df, ["a", "b"], "v", "acc", "f").collect()
    assert {(r["a"], r["b"]): r["acc"] and tuple(r["acc"]) for r in flagged} == {k: want.get(k) for k in flags}
    assert {(r["a"], r["b"]): r["f"] for r in flagged} == flags
    assert size_and_top().reduce(df.limit(0), ["a", "b"], "v", "acc", "f").collect() == []


def test_blocks_meet_their_vertex(spark):
    """A hub of 100 neighbours, each heard from both ways; vertex data decides which members count."""
    edges = [(0, i) for i in range(1, 101)] + [(i, 0) for i in range(1, 101)] + [(1, 2), (2, 2)]
    g = PropertyGraph.from_rows(spark, [(i, 10 * i + 50) for i in range(102)], [(s, d, 0) for s, d in edges], vertex_schema="id bigint, cap int")
    found = messages.apply_by_block(
        g, lambda t: t.other["id"], lambda v, members: F.size(F.filter(members, lambda m: m < v["cap"])), F.sum, "both", 16, "n"
    )
    got = {r["id"]: r["n"] for r in found.collect()}
    assert got == {0: 49, 1: 2, 2: 3, **{i: 1 for i in range(3, 101)}}
