"""Folds in Python are combined within their tasks."""

import random

from pyspark.sql import functions as F

from sparkgas.functions.reducers import VectorFold


# a lambda travels by value; a named function of this file would have to be installed on the workers
larger = lambda a, b: a.where(a >= b, b)


def test_one_row_for_each_task_and_key(spark):
    """A third of 60,000 messages go to one key; the exchange gets at most keys x tasks rows."""
    msgs = spark.range(0, 60_000, 1, 6).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("v")
    )
    fold = VectorFold(lambda a, b: a + b)
    assert fold.partial(msgs, ["k"], "v").count() <= 50 * 6
    got = {r["k"]: r["s"] for r in fold.reduce(msgs, ["k"], "v", "s").collect()}
    want = {r["k"]: r["s"] for r in msgs.groupBy("k").agg(F.sum("v").alias("s")).collect()}
    assert got == want


def test_a_small_table_gives_the_same(spark):
    """More keys than the bound, several key columns, large numbers, NULL messages and NULL keys."""
    rng = random.Random(4)
    rows = [
        (rng.choice([None, "a", "b"]), rng.randrange(40), None if rng.random() < 0.2 else rng.randrange(2**53, 2**62))
        for _ in range(700)
    ]
    df = spark.createDataFrame(rows, "a string, b bigint, v bigint").repartition(5)
    want = {}
    for a, b, v in rows:
        if v is not None:
            want[a, b] = max(v, want.get((a, b), v))
    for bound in (1, 65_536):
        got = {(r["a"], r["b"]): r["m"] for r in VectorFold(larger, bound).reduce(df, ["a", "b"], "v", "m").collect()}
        assert got == want


def test_flags_and_nothing(spark):
    df = spark.createDataFrame([(1, 5, False), (1, 7, True), (2, None, True)], "k int, v int, f boolean")
    got = sorted(map(tuple, VectorFold(larger).reduce(df, ["k"], "v", "m", "f").collect()))
    assert got == [(1, 7, True), (2, None, True)]
    assert VectorFold(larger).reduce(df.limit(0), ["k"], "v", "m").collect() == []
