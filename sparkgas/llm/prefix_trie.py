"""The trie of conversation prefixes, built from ternary search trees over range shards.

Turns become numbers through a dictionary of distinct turns.  Conversations are
range-partitioned and sorted by their numbers, so a shard, a bounded run of them,
holds whole subtrees but for the nodes on the paths of its first and its last
conversation.  A shard is built as a ternary search tree, median first, and walked
once.  Its boundary nodes are then merged over all shards, corrected for what
neighbouring shards both counted: just the path that the last conversation of one
and the first of the next have in common.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkgas.llm.common import bounded_batches
from sparkgas.operators.derive import number_edges
from sparkgas.plans.cluster import cut

SHARD_TURNS = 200_000  # turns, counting one more for each conversation, that a search tree takes in
SHARED = 8  # the most turns taken over from another conversation
ENCODED = "conv_id bigint, ids array<bigint>, sizes array<bigint>"

#: closed: all members seen; inner: below a boundary node; boundary: part of a node; ends: first and last path of a partition
CLOSED, INNER, BOUNDARY, ENDS = range(4)
PARTS = (
    "kind int, part int, shard int, node binary, parent binary, depth bigint, conv_id bigint, parent_conv_id bigint, "
    "n_convs bigint, n_children bigint, n_leaves bigint, saved bigint, ends string, ids array<bigint>, sizes array<bigint>"
)
EDGE = "part bigint, first_ids array<bigint>, first_sizes array<bigint>, last_ids array<bigint>, last_sizes array<bigint>"


def encode(chats: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv_id, ids, sizes)``: each conversation's turns as numbers in a dictionary of distinct turns, and their bytes.

    Turns are in order, null first; rows of one turn are ordered by a digest of
    role and text.  A null role or text is an empty one.  Rows without a
    conversation id belong to none and are left out.  Texts are not exchanged,
    only their digests.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    role, text = empty(role_col), empty(text_col)
    rows = chats.select(
        F.col(id_col).cast("bigint").alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.sha2(F.concat_ws(":", F.length(role), role, text).cast("binary"), 256).alias("digest"),
        F.octet_length(text).cast("bigint").alias("size"),
    ).where("conv_id is not null")
    distinct = rows.groupBy("digest").agg(F.min("size").alias("size"))
    dictionary = cut(number_edges(distinct.select("digest"), ["digest"], "id"))
    # what a turn weighs rides on its own rows; the dictionary gives numbers only
    numbered = rows.join(dictionary, "digest").select("conv_id", F.struct("turn", "digest", "id", "size").alias("t"))
    turns = numbered.groupBy("conv_id").agg(F.array_sort(F.collect_list("t"), _in_order).alias("t"))
    return turns.select("conv_id", F.col("t.id").alias("ids"), F.col("t.size").alias("sizes"))


def _in_order(a: Column, b: Column) -> Column:
    """Null turns first, then by turn and digest."""
    of = lambda t: F.struct(t["turn"].isNotNull(), t["turn"], t["digest"])
    return F.when(of(a) < of(b), -1).when(of(a) > of(b), 1).otherwise(0)


def share_heads(encoded: DataFrame, group: int = 5, most: int = SHARED) -> DataFrame:
    """Conversations rebuilt: the first ``crc32(id) % (most + 1)`` turns are those of the group's head, the rest their own.

    The head of a group is the conversation whose id is the next lower multiple
    of ``group``; one that is not there gives no turns.
    """
    c = F.col("conv_id")
    h = (F.crc32(c.cast("string").cast("binary")) % (most + 1)).cast("int")
    first = lambda name: F.slice(name, 1, most).alias(f"head_{name}")
    heads = encoded.where(F.pmod(c, F.lit(group)) == 0).select(c.alias("head"), first("ids"), first("sizes"))
    own = encoded.withColumns({"head": c - F.pmod(c, F.lit(group)), "h": h})
    none = F.array().cast("array<bigint>")

    def joined(name: str) -> Column:
        return F.concat(F.slice(F.coalesce(f"head_{name}", none), F.lit(1), F.col("h")), F.slice(name, F.col("h") + 1, F.size(name))).alias(name)

    return own.join(heads, "head", "left").select("conv_id", joined("ids"), joined("sizes"))


class SearchTree:
    """A ternary search tree over number sequences; node 0 is the root of the trie, all others stand for one more number.

    ``low`` and ``high`` lead to other last numbers, ``equal`` to longer sequences.
    """

    def __init__(self):
        self.number, self.low, self.equal, self.high = [0], [0], [0], [0]
        self.above, self.depth, self.size, self.ends = [0], [0], [0], [None]

    def _node(self, number: int, above: int, size: int) -> int:
        for column, value in (
            (self.number, number), (self.low, 0), (self.equal, 0), (self.high, 0), (self.above, above),
            (self.depth, self.depth[above] + 1), (self.size, size), (self.ends, None),
        ):
            column.append(value)
        return len(self.number) - 1

    def insert(self, ids: list[int], sizes: list[int], members: list[int]) -> None:
        at = 0
        for number, size in zip(ids, sizes):
            above, at = at, self.equal[at]
            if not at:
                at = self.equal[above] = self._node(number, above, size)
                continue
            while self.number[at] != number:
                side = self.low if number < self.number[at] else self.high
                if not side[at]:
                    side[at] = self._node(number, above, size)
                at = side[at]
        self.ends[at] = members

    def path(self, ids: list[int]) -> list[int]:
        """The nodes of a sequence that is in the tree, from the root on."""
        at, out = 0, [0]
        for number in ids:
            at = self.equal[at]
            while self.number[at] != number:
                at = self.low[at] if number < self.number[at] else self.high[at]
            out.append(at)
        return out


def balanced(n: int) -> Iterator[int]:
    """0 to n - 1, the middle first, then the middles of both halves."""
    spans = [(0, n)]
    while spans:
        a, b = spans.pop()
        if a < b:
            middle = (a + b) // 2
            yield middle
            spans += [(a, middle), (middle + 1, b)]


def _below(node: bytes, number: int) -> bytes:
    import hashlib

    return hashlib.blake2b(node + (number & (1 << 64) - 1).to_bytes(8, "big"), digest_size=16).digest()


def _nodes(ids: list[int]) -> list[bytes]:
    """A name for the root and every node on the path of a sequence, the same in all shards."""
    out = [b"\0" * 16]
    for number in ids:
        out.append(_below(out[-1], number))
    return out


def shard_rows(part: int, shard: int, rows: list[tuple[int, list[int], list[int]]]) -> Iterator[tuple]:
    """The nodes of some sorted ``(conv_id, ids, sizes)``; members, leaves and savings summed up from the last node back."""
    import hashlib

    sequences: list[tuple[list, list, list]] = []
    for conv_id, ids, sizes in rows:
        if sequences and sequences[-1][0] == ids:
            sequences[-1][2].append(conv_id)
        else:
            sequences.append((ids, sizes, [conv_id]))
    tree = SearchTree()
    for i in balanced(len(sequences)):
        tree.insert(*sequences[i])
    n = len(tree.number)
    convs, children, leaves, saved, least = [0] * n, [0] * n, [0] * n, [0] * n, [None] * n
    # a node is made after the one above it, so the last ones come first
    for at in range(n - 1, -1, -1):
        if own := tree.ends[at]:
            convs[at] += len(own)
            least[at] = own[0] if least[at] is None else min(least[at], own[0])
        leaves[at] += not children[at]
        saved[at] += (convs[at] - 1) * tree.size[at]
        if at:
            above = tree.above[at]
            convs[above] += convs[at]
            children[above] += 1
            leaves[above] += leaves[at]
            saved[above] += saved[at]
            least[above] = least[at] if least[above] is None else min(least[above], least[at])
    named: dict[int, bytes] = {}
    for ids, _, _ in (sequences[0], sequences[-1]):
        named.update(zip(tree.path(ids), _nodes(ids)))
    for at in range(n):
        above, ends = tree.above[at], ",".join(map(str, tree.ends[at] or ()))
        values = (convs[at], children[at], leaves[at], saved[at])
        if at in named:
            yield (BOUNDARY, part, shard, named[at], named[above] if at else None, tree.depth[at], least[at], None, *values, ends, None, None)
        else:
            kind, outer, parent = (INNER, named[above], None) if above in named else (CLOSED, None, least[above])
            ends = hashlib.sha256(ends.encode()).hexdigest()
            yield (kind, part, shard, None, outer, tree.depth[at], least[at], parent, *values, ends, None, None)


def shared_rows(part: int, shard: int, last: tuple[list, list], first: tuple[list, list]) -> Iterator[tuple]:
    """What the shards on both sides of a boundary counted twice, to be added to the nodes that they share.

    ``last`` and ``first`` are the ``(ids, sizes)`` of the conversations that meet there.
    """
    (ids, sizes), (others, _) = last, first
    both = 0
    while both < min(len(ids), len(others)) and ids[both] == others[both]:
        both += 1
    nodes, saved = _nodes(ids[:both]), 0
    # the deepest shared node was a leaf to the left shard if its last conversation ends there
    leaf = -(both == len(ids))
    for depth in range(both, -1, -1):
        saved += sizes[depth - 1] if depth else 0
        values = (0, -(depth < both), leaf, saved)
        yield (BOUNDARY, part, shard, nodes[depth], nodes[depth - 1] if depth else None, depth, None, None, *values, "", None, None)


def _batch(rows: list[tuple], schema: str):
    import pyarrow as pa

    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64())}
    names, types = zip(*(f.split(" ") for f in schema.split(", ")))
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types)], names=list(names))


def _shards(sequences: DataFrame, shard_turns: int) -> DataFrame:
    """Node rows of all shards, and one row with the outer paths of each partition."""

    def build(batches):
        from itertools import islice

        from pyspark import TaskContext

        part, shard, held, weight, first, last = TaskContext.get().partitionId(), 0, [], 0, None, None

        def shard_of(rows):
            if last is not None:
                yield from shared_rows(part, shard, last, rows[0][1:])
            yield from shard_rows(part, shard, rows)

        def in_batches(rows):
            while some := list(islice(rows, 8192)):
                yield _batch(some, PARTS)

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "ids", "sizes"))):
                first = first or row[1:]
                held.append(row)
                weight += 1 + len(row[1])
                if weight >= shard_turns:
                    yield from in_batches(shard_of(held))
                    last, held, weight, shard = held[-1][1:], [], 0, shard + 1
        if held:
            yield from in_batches(shard_of(held))
            last = held[-1][1:]
        if first is not None:
            none = (None,) * 9
            yield _batch([(ENDS, part, k, None, *none, *path) for k, path in enumerate((first, last))], PARTS)

    return sequences.mapInArrow(build, PARTS)


def _merged(rows: DataFrame) -> DataFrame:
    """Boundary nodes, each summed over its shards; the ids that end at a node are hashed shard by shard as they come."""

    def merge(batches):
        import hashlib

        names = ("node", "parent", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends")
        now, out = None, []
        for batch in batches:
            for node, parent, depth, conv_id, *values, ends in zip(*(batch.column(c).to_pylist() for c in names)):
                if now is None or now[0] != node:
                    if now:
                        out.append((*now[:4], *now[4], now[5].hexdigest()))
                    now = [node, parent, depth, conv_id, [0] * 4, hashlib.sha256(), False]
                if conv_id is not None:
                    now[3] = conv_id if now[3] is None else min(now[3], conv_id)
                now[4] = [a + b for a, b in zip(now[4], values)]
                if ends:
                    now[5].update(f",{ends}".encode() if now[6] else ends.encode())
                    now[6] = True
            if out:
                yield _batch(out, MERGED)
                out = []
        if now:
            yield _batch([(*now[:4], *now[4], now[5].hexdigest())], MERGED)

    return rows.repartition("node").sortWithinPartitions("node", "part", "shard").mapInArrow(merge, MERGED)


MERGED = (
    "node binary, parent binary, depth bigint, conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
    "saved bigint, ends string"
)


def prefix_trie(sequences: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per node of the trie of ``(conv_id, ids, sizes)`` sequences.

    ``conv_id`` (the smallest member) and ``depth`` name a node; ``parent_conv_id``
    (null for the root), ``n_convs`` (members), ``n_children``, ``n_leaves`` (of its
    subtree), ``saved_tokens`` (of its subtree: each node's members but one, times
    the size of its last number) and ``ends_sha256``, the digest of the ids that end
    there, ascending and comma-joined.

    An empty sequence ends at the root; equal sequences share all nodes; without
    sequences there is no node; other columns are ignored.  A sequence is one row
    and never cut; a task holds ``shard_turns`` numbers, or one sequence that has more.
    Equal sequences may fill any number of shards; the ids at one node pass through
    the task that hashes them as a stream.
    """
    bounded_batches(sequences.sparkSession)
    rows = sequences.select("conv_id", "ids", "sizes")
    found = cut(_shards(rows.repartitionByRange("ids", "conv_id").sortWithinPartitions("ids", "conv_id"), shard_turns))
    boundary = found.where(F.col("kind") == BOUNDARY).select(*(c for c in MERGED_INPUT))
    merged = cut(_merged(boundary.unionByName(_between(found.where(F.col("kind") == ENDS)))))
    above = merged.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    values = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256")]
    inner = found.where(F.col("kind") == INNER).drop("parent_conv_id").join(above, "parent")
    outer = merged.join(above, "parent", "left")
    return found.where(F.col("kind") == CLOSED).select(*values).unionByName(inner.select(*values)).unionByName(outer.select(*values))


MERGED_INPUT = ("node", "parent", "part", "shard", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends")


def _between(ends: DataFrame) -> DataFrame:
    """Corrections where partitions meet: one row per partition is brought in order."""
    first = ends.where("shard = 0").select("part", F.col("ids").alias("first_ids"), F.col("sizes").alias("first_sizes"))
    last = ends.where("shard = 1").select("part", F.col("ids").alias("last_ids"), F.col("sizes").alias("last_sizes"))
    order = Window.orderBy("part")
    before = [F.lag(c).over(order).alias(c) for c in ("last_ids", "last_sizes")]
    pairs = first.join(last, "part").select("part", "first_ids", "first_sizes", *before).where("last_ids is not null")

    def correct(batches):
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("part", "first_ids", "first_sizes", "last_ids", "last_sizes"))
            for part, *paths in zip(*columns):
                yield _batch(list(shared_rows(part, -1, tuple(paths[2:]), tuple(paths[:2]))), PARTS)

    return pairs.mapInArrow(correct, PARTS).select(*MERGED_INPUT)
