"""Least sums along long ways: regions come to rest by themselves, and only what crosses their borders moves in a round.

A round of :func:`run_gas` goes one edge further, so a long graph takes as many
rounds as its longest way has edges.  Here vertices that are near each other share a
part; a task carries values on inside its part until nothing there changes, and a
round hands on the values that leave one.  The number of parts is bounded, so
the number of rounds follows the parts on a way, not its edges.  Regions only decide how
much work a round does; whatever they are, it ends at the same least sums.
"""

from __future__ import annotations

import math
import sys
from functools import reduce

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkgas.plans.cluster import cut_counting, cut_in_loop, delete_path, drop, scratch_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have this library

PARTS = 16
# Arcs of a region: a sixteenth of all, within these bounds.
LEAST, MOST = 1_000_000, 3_000_000
LEVELS = 10
# A weight from here on could reach infinity, which stands for "not reached".
HUGE = 1e290
FILES = 4
ROWS = "part int, id bigint, far double, sent boolean, better boolean"


def regions(links: DataFrame, most: int) -> DataFrame:
    """``(id, region)`` for the ends of ``links`` ``(a, b, n)``, which hold every link both ways.

    Level by level, a region joins the one of least hash among itself and its
    neighbours, unless the union would have more than ``most`` arcs.
    """
    nodes = cut_in_loop(links.groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("size")))
    home, n, idle = None, nodes.count(), 0
    for level in range(LEVELS):
        place = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(level)).alias("hash"), F.col(c).alias("id"))  # noqa: E731, B023
        near = links.groupBy(F.col("a").alias("id")).agg(F.min(place("b")).alias("near"))
        chosen = nodes.join(near, "id", "left").select("id", "size", F.least(place("id"), "near")["id"].alias("label"))
        chosen = cut_in_loop(chosen)
        whole = chosen.groupBy("label").agg(F.sum("size").alias("whole"))
        region = F.when(F.col("whole") <= most, F.col("label")).otherwise(F.col("id"))
        step = cut_in_loop(chosen.join(whole, "label").select("id", region.alias("region"), "size"))
        moved = step.select(F.col("id").alias("before"), F.col("region").alias("after"))
        home = cut_in_loop(
            step.select("id", "region")
            if home is None
            else home.join(moved, F.col("region") == F.col("before")).select("id", F.col("after").alias("region"))
        )
        ends = links.join(moved.toDF("a", "_a"), "a").join(moved.toDF("b", "_b"), "b").where("_a <> _b")
        links = cut_in_loop(ends.groupBy(F.col("_a").alias("a"), F.col("_b").alias("b")).agg(F.sum("n").alias("n")))
        nodes = cut_in_loop(step.groupBy(F.col("region").alias("id")).agg(F.sum("size").alias("size")))
        before, n = n, nodes.count()
        idle = idle + 1 if n > 0.9 * before else 0
        if n <= 1 or idle > 1 or links.isEmpty():
            break
    return home


def _relax(arcs, rows):
    """One part comes to rest: its values and what leaves it, one row each."""
    import numpy as np
    import pandas as pd

    names = ["part", "id", "far", "sent", "better"]
    if not len(rows):
        return pd.DataFrame({c: [] for c in names})
    part = rows["part"].iloc[0]
    source, rcv, weight, to_part = (arcs[c].to_numpy() for c in ("snd", "rcv", "w", "to_part"))
    inside = to_part == part
    ids = np.unique(np.concatenate([source, rcv[inside], rows["id"].to_numpy()]))
    source = np.searchsorted(ids, source)
    order = np.argsort(source, kind="stable")
    source, rcv, weight, to_part, inside = source[order], rcv[order], weight[order], to_part[order], inside[order]
    first = np.searchsorted(source, np.arange(len(ids) + 1))
    target = np.searchsorted(ids, rcv)
    far = np.full(len(ids), np.inf)
    place, value, sent = np.searchsorted(ids, rows["id"].to_numpy()), rows["far"].to_numpy(), rows["sent"].to_numpy(bool)
    np.minimum.at(far, place[~sent], value[~sent])
    before = far.copy()
    np.minimum.at(far, place[sent], value[sent])
    better = far < before
    front = np.flatnonzero(better)
    while len(front):
        n = first[front + 1] - first[front]
        arc = np.arange(n.sum()) + np.repeat(first[front] - (np.cumsum(n) - n), n)
        arc = arc[inside[arc]]
        to, new = target[arc], far[source[arc]] + weight[arc]
        gains = new < far[to]
        np.minimum.at(far, to[gains], new[gains])
        front = np.unique(to[gains])
        better[front] = True
    reached = np.isfinite(far)
    own = pd.DataFrame({"part": part, "id": ids[reached], "far": far[reached], "sent": False, "better": better[reached]})
    leaving = np.flatnonzero(~inside & better[source])
    out = pd.DataFrame({"part": to_part[leaving], "id": rcv[leaving], "far": far[source[leaving]] + weight[leaving]})
    out = out.groupby(["part", "id"], as_index=False)["far"].min().assign(sent=True, better=False)
    return pd.concat([own[names], out[names]]) if len(out) else own[names]


def least_sums(arcs: DataFrame, reached: DataFrame) -> tuple[DataFrame, list[int]] | None:
    """``(id, far)``, the least of the values in ``reached`` carried along ``arcs``, and how many changed in each round.

    ``arcs`` ``(snd, rcv, w)`` have weights from 0 on, ``reached`` ``(id, far)`` has values from 0 on; an id
    without arcs is left out.  None if a weight is huge or a sender has more arcs than a region may have.
    """
    spark = arcs.sparkSession
    arcs = cut_in_loop(arcs.where("snd <> rcv and w is not null"))
    seen = arcs.groupBy("snd").agg(F.count("*").alias("n"), F.max("w").alias("w"))
    seen = seen.agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max("w").alias("w")).first()
    if not seen.n or seen.most > MOST or not seen.w < HUGE:
        return None
    most = min(MOST, max(LEAST, seen.n // PARTS))
    both = F.explode(F.array(F.struct(F.col("snd").alias("a"), F.col("rcv").alias("b")), F.struct(F.col("rcv").alias("a"), F.col("snd").alias("b"))))
    links = arcs.select(both.alias("l")).select("l.a", "l.b", F.lit(1).cast("bigint").alias("n"))
    parts = 3 * math.ceil(seen.n / most)
    # a link is counted from both ends, so a region may have twice as many
    part = F.pmod(F.xxhash64("region"), F.lit(parts)).cast("int").alias("part")
    home = cut_in_loop(regions(links, 2 * most).select("id", part))
    path = scratch_path(spark, "regions")
    laid = arcs.join(home.withColumnRenamed("id", "snd"), "snd").join(home.toDF("rcv", "to_part"), "rcv")
    laid = laid.select("part", "snd", "rcv", F.col("w").cast("double").alias("w"), "to_part")
    try:
        laid.repartition("part", F.pmod(F.xxhash64("snd"), F.lit(FILES))).write.partitionBy("part").parquet(path)
        laid = spark.read.schema("snd bigint, rcv bigint, w double, to_part int, part int").parquet(path)
        start = reached.where("far is not null").join(home, "id")
        sent = cut_in_loop(start.select("part", "id", F.col("far").cast("double"), F.lit(True).alias("sent"), F.lit(False).alias("better")))
        held: dict[int, DataFrame] = {}
        history = []
        while active := [r.part for r in sent.where("sent").select("part").distinct().collect()]:  # at most one row per part
            rows = [sent.where("sent"), *_states({b: held[b] for b in active if b in held})]
            here = laid.where(F.col("part").isin(active)).groupBy("part")
            out = here.cogroup(reduce(DataFrame.unionByName, rows).groupBy("part")).applyInPandas(_relax, ROWS)
            after, changed = cut_counting(out, "better")
            spent = [sent, *held.values()]
            held.update(dict.fromkeys(active, after))
            sent = after
            for table in {id(t): t for t in spent}.values():
                if not any(table is t for t in held.values()):
                    drop(table)
            history.append(changed)
        ends = _states(held)
        found = reduce(DataFrame.unionByName, ends) if ends else sent
        return cut_in_loop(found.select("id", "far")), history
    finally:
        delete_path(spark, path)


def _states(held: dict[int, DataFrame]) -> list[DataFrame]:
    """The values of parts, each read from the table that holds its newest ones."""
    out = []
    for table in {id(t): t for t in held.values()}.values():
        parts = [b for b, t in held.items() if t is table]
        out.append(table.where(~F.col("sent") & F.col("part").isin(parts)))
    return out
