"""Ways to reduce the messages of one vertex to one value.

No reducer holds all messages of a vertex in one row, so a vertex that receives
a large part of all messages is no heavier for any single task than its share
of the input.  All but :class:`Fold` also combine before they exchange.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Reducer:
    """Turns ``(keys…, msg[, flag])`` rows into one ``(keys…, acc[, flag])`` row per key.

    NULL messages count as no contribution.  ``flag``, if given, is a boolean
    column that is or-ed alongside.
    """

    def reduce(self, msgs: DataFrame, keys: list[str], msg: str, out: str, flag: str | None = None) -> DataFrame:
        raise NotImplementedError


class Builtin(Reducer):
    """A Spark aggregate function, e.g. ``F.sum`` or ``F.min``."""

    def __init__(self, aggregate: Callable[[Column], Column]):
        self.aggregate = aggregate
        self._known: dict = {}

    def reduce(self, msgs, keys, msg, out, flag=None):
        asked = (msg, out, flag)
        if asked not in self._known:
            flags = [F.bool_or(flag).alias(flag)] if flag else []
            self._known[asked] = [self.aggregate(F.col(msg)).alias(out), *flags]
        return msgs.groupBy(*keys).agg(*self._known[asked])


class Mex(Reducer):
    """Smallest whole number >= 0 that is not among the messages.

    Works in levels of ``WIDTH`` numbers: a level notes in one bit mask which
    parts of a range are present and keeps the smallest free number found in
    them.  ``limit`` is an upper bound for the number of messages of any one
    vertex; the answer cannot exceed it, so it fixes the number of levels, and
    larger message values cannot matter.
    """

    WIDTH = 60

    def __init__(self, limit: int):
        self.levels = max(1, math.ceil(math.log(max(2, limit + 1), self.WIDTH)))
        while self.WIDTH**self.levels <= limit:
            self.levels += 1
        self._known: dict = {}

    def _steps(self, keys, msg, out, flag):
        """Column lists of the levels: the input, then (children, groups, aggregates, result) each."""
        flags = [flag] if flag else []
        inside = F.col(msg).between(0, self.WIDTH**self.levels - 1)
        first = [
            *keys,
            F.when(inside, F.col(msg)).otherwise(0).cast("bigint").alias("_at"),
            inside.alias("_present"),
            F.lit(None).cast("bigint").alias("_free"),
            *flags,
        ]
        none_present = F.lit(0).cast("bigint")
        aggs = [
            F.coalesce(F.bit_or(F.when(F.col("_present"), F.expr("shiftleft(1L, _child)"))), none_present).alias("_mask"),
            F.min("_free").alias("_low"),
            *[F.bool_or(f).alias(f) for f in flags],
        ]
        steps = []
        span = 1
        for depth in range(self.levels):
            last = depth == self.levels - 1
            children = [
                *keys,
                F.expr(f"_at div {span * self.WIDTH}").alias("_block"),
                F.pmod(F.expr(f"_at div {span}"), F.lit(self.WIDTH)).cast("int").alias("_child"),
                "_present",
                "_free",
                *flags,
            ]
            start = F.lit(0) if last else F.col("_block") * (span * self.WIDTH)
            mask = F.col("_mask")
            # the lowest zero bit of the mask is the first part with no number at all
            lowest_gap = F.bit_count(F.bitwise_not(mask).bitwiseAND(mask + 1) - 1)
            gap = F.when(lowest_gap < self.WIDTH, start + lowest_gap.cast("bigint") * span)
            free = F.least(gap, F.col("_low"))
            if last:
                result = [*keys, free.alias(out), *flags]
            else:
                result = [*keys, start.alias("_at"), F.lit(True).alias("_present"), free.alias("_free"), *flags]
            steps.append((children, keys if last else [*keys, "_block"], aggs, result))
            span *= self.WIDTH
        return first, steps

    def reduce(self, msgs, keys, msg, out, flag=None):
        asked = (tuple(keys), msg, out, flag)
        if asked not in self._known:
            self._known[asked] = self._steps(list(keys), msg, out, flag)
        first, steps = self._known[asked]
        level = msgs.select(*first)
        for children, groups, aggs, result in steps:
            level = level.select(*children).groupBy(*groups).agg(*aggs).select(*result)
        return level


class Members(Reducer):
    """Set union: the distinct messages of a vertex as a sorted array.

    Members are made distinct before they are brought together, each combined
    before its exchange.  More than ``limit`` members of one vertex are an error
    before any row holds them; a set without a bound is a table of pairs.
    """

    def __init__(self, limit: int = 65_536):
        self.limit = limit

    def reduce(self, msgs, keys, msg, out, flag=None):
        present = msgs.where(F.col(msg).isNotNull()).select(*keys, msg).distinct()
        sizes = present.groupBy(*keys).agg(F.count("*").alias("_n"))
        wrong = F.raise_error(F.concat(F.lit("more members than the limit: "), F.col("_n").cast("string"))).cast("boolean")
        checked = sizes.where(F.when(F.col("_n") <= self.limit, True).otherwise(wrong)).select(*keys)
        sets = present.join(checked, keys).groupBy(*keys).agg(F.sort_array(F.collect_list(msg)).alias(out))
        if flag is None:
            return sets
        return msgs.groupBy(*keys).agg(F.bool_or(flag).alias(flag)).join(sets, keys, "left").select(*keys, out, flag)


class MemberBlocks(Reducer):
    """A function of the set of distinct messages, however many there are.

    Messages are whole numbers.  A set is held as rows ``(key, block, members)``: block
    ``b`` has the sorted members in ``[b * block_ids, (b + 1) * block_ids)``, so no row is
    longer than that.  ``per_block(members)`` gives a value of each block, and the aggregate
    ``combine`` brings the values of a key together.  A key without messages has none.
    """

    def __init__(self, per_block, combine, block_ids: int = 65_536):
        self.per_block = per_block
        self.combine = combine
        self.block_ids = block_ids

    def blocks(self, msgs, keys, msg, flag=None):
        """``(*keys, _block, _members)``, with the flag of a block's messages; a block NULL holds none."""
        told = [] if flag is None else [F.bool_or(flag).alias(flag)]
        if flag is None:
            msgs = msgs.where(F.col(msg).isNotNull())
        once = msgs.groupBy(*keys, msg).agg(*told) if told else msgs.select(*keys, msg).distinct()
        block = F.floor(F.col(msg) / self.block_ids).alias("_block")
        return once.groupBy(*keys, block).agg(F.sort_array(F.collect_list(msg)).alias("_members"), *told)

    def reduce(self, msgs, keys, msg, out, flag=None):
        value = F.when(F.col("_block").isNotNull(), self.per_block(F.col("_members")))
        told = [] if flag is None else [flag]
        parts = self.blocks(msgs, keys, msg, flag).select(*keys, F.col("_block").isNotNull().alias("_any"), value.alias("_part"), *told)
        whole = [F.count_if("_any").alias("_n"), self.combine(F.col("_part")).alias(out), *[F.bool_or(f).alias(f) for f in told]]
        return parts.groupBy(*keys).agg(*whole).select(*keys, F.when(F.col("_n") > 0, F.col(out)).alias(out), *told)


class Fold(Reducer):
    """Any commutative and associative function of two Columns.

    Messages are folded in bounded chunks: a local sort brings the messages of
    a vertex together within each partition, every chunk of at most ``chunk``
    rows becomes one partial value, and a second fold joins the partial values
    of a vertex, one for each partition or ``chunk`` messages.

    Spark has no partial step for a function it does not know, so the first
    exchange moves every message once.  Use a built-in aggregate where one fits,
    or :class:`VectorFold`, which folds before it exchanges.
    """

    def __init__(self, merge: Callable[[Column, Column], Column], chunk: int = 4096):
        self.merge = merge
        self.chunk = chunk

    def _folded(self, values: str) -> Column:
        rest = F.slice(F.col(values), 2, F.greatest(F.size(values) - 1, F.lit(0)))
        return F.when(F.size(values) > 0, F.aggregate(rest, F.col(values)[0], self.merge))

    def _level(self, df, keys, msg, flag, chunked):
        flags = [F.bool_or(flag).alias(flag)] if flag else []
        by = [*keys]
        if chunked:
            # at most `chunk` rows per (key, _chunk): the ids count rows within a partition
            # and their order is fixed by the rows themselves, so a rerun task repeats them
            df = df.sortWithinPartitions(*keys, msg).withColumn(
                "_chunk", F.expr(f"monotonically_increasing_id() div {self.chunk}")
            )
            by.append("_chunk")
        out = df.groupBy(*by).agg(F.collect_list(msg).alias("_values"), *flags)
        return out.select(*by, self._folded("_values").alias(msg), *([flag] if flag else [])).drop("_chunk")

    def reduce(self, msgs, keys, msg, out, flag=None):
        df = msgs.select(*keys, msg, *([flag] if flag else []))
        for chunked in (True, False):
            df = self._level(df, keys, msg, flag, chunked)
        return df.withColumnRenamed(msg, out)


class VectorFold(Reducer):
    """Any commutative and associative function of two pandas Series, element by element.

    Every task folds its messages as they come, in a table of at most ``bound``
    keys and one Arrow batch; a fuller table is handed on and started anew.  So the
    exchange moves at most one row for each task and key, or for each ``bound``
    messages, and a vertex with very many messages is no heavier than others.
    After the exchange the same fold goes over the rows in the order of their keys.

    A flag is or-ed apart, from a second look at the messages.
    """

    def __init__(self, merge: Callable[[pd.Series, pd.Series], pd.Series], bound: int = 65_536):
        self.merge = merge
        self.bound = bound

    def partial(self, msgs: DataFrame, keys: list[str], msg: str) -> DataFrame:
        """Messages folded within their tasks, before any exchange."""
        present = msgs.where(F.col(msg).isNotNull()).select(*keys, msg)
        return present.mapInPandas(_folding(self.merge, keys, msg, self.bound, False), present.schema)

    def reduce(self, msgs, keys, msg, out, flag=None):
        partial = self.partial(msgs, keys, msg)
        rows = partial.repartition(*keys).sortWithinPartitions(*keys)
        sums = rows.mapInPandas(_folding(self.merge, keys, msg, self.bound, True), rows.schema).withColumnRenamed(msg, out)
        if flag is None:
            return sums
        return msgs.groupBy(*keys).agg(F.bool_or(flag).alias(flag)).join(sums, keys, "left").select(*keys, out, flag)


def _folding(merge, keys: list[str], msg: str, bound: int, ordered: bool):
    """A function over batches that folds rows of equal keys; ``ordered`` if these come one after the other."""

    def folded(rows: pd.DataFrame) -> pd.DataFrame:
        code = rows.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
        order = np.argsort(code, kind="stable")
        rows, code = rows.iloc[order].reset_index(drop=True), code[order]
        while True:
            # neighbours are merged in pairs, so a key of n rows is done after log2(n) passes
            starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            place = np.arange(len(code)) - np.repeat(starts, np.diff(np.r_[starts, len(code)]))
            right = np.flatnonzero(place % 2 == 1)
            if not len(right):
                return rows
            values = rows[msg]
            merged = merge(values.iloc[right - 1].reset_index(drop=True), values.iloc[right].reset_index(drop=True))
            values = values.copy()
            values.iloc[right - 1] = merged.to_numpy()
            rows = rows.assign(**{msg: values}).iloc[np.flatnonzero(place % 2 == 0)].reset_index(drop=True)
            code = code[place % 2 == 0]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            if not len(batch):
                continue
            held = folded(batch if held is None else pd.concat([held, batch], ignore_index=True))
            if ordered:
                # only the last key can go on in the next batch
                yield held.iloc[:-1]
                held = held.iloc[-1:]
            elif len(held) > bound:
                yield held
                held = None
        if held is not None:
            yield held

    return fold


def as_reducer(how: Reducer | Callable[[Column], Column]) -> Reducer:
    return how if isinstance(how, Reducer) else Builtin(how)
