"""SimHash near-duplicates: all links within a few bits, by the generalised pigeonhole principle.

The 64 bits are grouped into parts.  If the thresholds of the parts sum up to
``distance - parts + 1``, two fingerprints within ``distance`` lie within the
threshold of some part; a part with threshold -1 need not be looked at.
Correlated bits share a part, and thresholds are chosen by dynamic programming
on the rows and candidates that each would cost.  Candidates are verified on
the whole fingerprint.

Only distinct fingerprints are compared, so copies cost nothing.  A bucket of
many distinct fingerprints is not compared pair by pair: two fingerprints are
within two bits exactly if some word is within one bit of both, so its members
meet at these words instead, which costs 65 rows per member.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgas.algorithms.contraction import star_labels
from sparkgas.llm.common import bounded_batches, texts
from sparkgas.plans.cluster import cut

BITS = 64
DISTANCE = 2
MOST_PARTS = 4
MOST_THRESHOLD = 1
BUCKET = 128  # distinct fingerprints of a bucket that are compared pair by pair
SEED = 42
CHUNK = 1 << 16


def fingerprint(text: str, size: int = 3) -> int:
    """SimHash over word shingles, repeats included; 0 without words."""
    import xxhash

    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - size + 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:n].tolist()
    ends = ends[min(size, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    set_bits = np.zeros(BITS, np.int64)
    for at in range(0, n, CHUNK):
        some = [digest(joined[a:b], SEED) for a, b in zip(starts[at : at + CHUNK], ends[at : at + CHUNK])]
        octets = np.array(some, "<u8").view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """``(doc_id, fp)``, the fingerprint as a signed 64-bit number.  A null text is an empty one."""
    return _marked(texts(docs, id_col, text_col), size)


def _marked(rows: DataFrame, size: int = 3) -> DataFrame:
    """``rows`` with ``fp`` in place of ``text``."""
    bounded_batches(rows.sparkSession)
    kept = [f for f in rows.schema.fields if f.name != "text"]
    names = [f.name for f in kept]

    def make(batches):
        import pyarrow as pa

        for batch in batches:
            found = np.array([fingerprint(t, size) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(found.view(np.int64))], [*names, "fp"])

    return rows.mapInArrow(make, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", fp bigint")


def bit_statistics(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many of them have bits i and j set, summed partition by partition."""

    def sums(batches):
        import pyarrow as pa

        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            fp = np.asarray(batch.column("fp")).astype(np.int64)
            bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
            n += len(fp)
        cells = np.append(total.ravel(), n).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], ["cell", "n"])

    cells = distinct.select("fp").mapInArrow(sums, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    found = {r.cell: r.n for r in cells.collect()}  # one row per pair of bits
    values = np.array([found.get(i, 0) for i in range(BITS * BITS + 1)], float)
    return int(values[-1]), values[:-1].reshape(BITS, BITS)


def group_bits(n: int, together: np.ndarray, parts: int) -> list[list[int]]:
    """The bits in ``parts`` groups of about equal width, each grown around the strongest correlation left."""
    share = together / max(n, 1)
    p = np.diag(share)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    r = np.abs((share - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(r, 0)
    left, groups = list(range(BITS)), []
    for k in range(parts):
        width = len(left) // (parts - k)
        near = r[np.ix_(left, left)]
        group = [left[int(near.max(axis=1).argmax())]]
        while len(group) < width:
            rest = [b for b in left if b not in group]
            group.append(rest[int(r[np.ix_(rest, group)].mean(axis=1).argmax())])
        groups.append(sorted(group))
        left = [b for b in left if b not in group]
    return groups


def within(n: int, together: np.ndarray, group: list[int], equal_pairs: float) -> list[float]:
    """Estimated pairs that differ in at most 0, 1, ... bits of a group.

    Independent bits give the growth from one threshold to the next; the
    measured number of equal pairs gives the level.
    """
    p = np.diag(together)[group] / max(n, 1)
    chance = np.array([1.0])
    for differs in 2 * p * (1 - p):
        chance = np.convolve(chance, [1 - differs, differs])
    up_to = np.cumsum(chance) * n * (n - 1) / 2
    return [equal_pairs * up_to[t] / max(up_to[0], 1e-9) if equal_pairs else up_to[t] for t in range(MOST_THRESHOLD + 1)]


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds of the parts with the given sum and the least cost; ``costs[i][t + 1]`` is part i's at threshold t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for have, (paid, chosen) in best.items():
            for t in range(-1, len(cost) - 1):
                now = (paid + cost[t + 1], [*chosen, t])
                if have + t not in step or now < step[have + t]:
                    step[have + t] = now
        best = step
    return best.get(total, (float("inf"), []))


def _mask(bits) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >= 1 << 63 else value


def plan_parts(distinct: DataFrame, distance: int = DISTANCE) -> list[tuple[list[int], int]]:
    """``(bits, threshold)`` of each part to be looked at, for the cheapest grouping."""
    n, together = bit_statistics(distinct)
    if n < 2:
        return []
    groupings = {m: group_bits(n, together, m) for m in range(2, MOST_PARTS + 1)}
    keys = [
        F.struct(F.lit(m).alias("m"), F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(_mask(g))).alias("key"))
        for m, groups in groupings.items()
        for i, g in enumerate(groups)
    ]
    counted = distinct.select(F.explode(F.array(*keys)).alias("k")).select("k.*").groupBy("m", "i", "key").count()
    pairs = counted.groupBy("m", "i").agg(F.sum(F.col("count") * (F.col("count") - 1.0) / 2).alias("pairs"))
    equal = {(r.m, r.i): r.pairs for r in pairs.collect()}  # one row per part
    choices = []
    for m, groups in groupings.items():
        costs = []
        for i, g in enumerate(groups):
            found = within(n, together, g, equal.get((m, i), 0.0))
            rows = [n * (1 + sum(comb(len(g), d) for d in range(t + 1))) for t in range(MOST_THRESHOLD + 1)]
            costs.append([0.0, *(a + b for a, b in zip(found, rows))])
        cost, thresholds = allocate(costs, distance - m + 1)
        choices.append((cost, m, thresholds))
    _, m, thresholds = min(choices)
    return [(g, t) for g, t in zip(groupings[m], thresholds) if t >= 0]


def _bits_apart(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _keys(fp: Column, parts, probe: bool) -> Column:
    """Where a fingerprint stands (one key per part), or where it has to look (all keys within the threshold)."""

    def of_part(i: int, bits: list[int], threshold: int) -> Column:
        flips = [_mask(c) for d in range(threshold + 1) for c in combinations(bits, d)]
        own = fp.bitwiseAND(F.lit(_mask(bits)))
        return F.transform(F.lit(flips), lambda f: F.struct(F.lit(i).alias("part"), own.bitwiseXOR(f).alias("key")))

    return F.concat(*(of_part(i, bits, t if probe else 0) for i, (bits, t) in enumerate(parts)))


def links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``(src, dst)``: enough links between distinct fingerprints to connect all that lie within ``distance``.

    Pairs of small buckets are complete; members of large ones are linked at
    common words one bit away, a star per word.
    """
    if distance != DISTANCE:
        raise ValueError("large buckets are resolved for a distance of 2")
    parts = plan_parts(distinct, distance)
    if not parts:
        return distinct.select(F.col("fp").alias("src"), F.col("fp").alias("dst")).limit(0)
    stand = distinct.select("fp", F.explode(_keys(F.col("fp"), parts, False)).alias("k")).select("fp", "k.*")
    look = distinct.select("fp", F.explode(_keys(F.col("fp"), parts, True)).alias("k")).select("fp", "k.*")
    large = cut(stand.groupBy("part", "key").count().where(F.col("count") > BUCKET).select("part", "key"))
    small_stand = stand.join(large, ["part", "key"], "left_anti")
    a, b = small_stand.select("part", "key", F.col("fp").alias("src")), look.select("part", "key", F.col("fp").alias("dst"))
    close = (_bits_apart(F.col("src"), F.col("dst")) <= distance) & (F.col("src") < F.col("dst"))
    pairs = a.join(b, ["part", "key"]).where(close).select("src", "dst")
    crowd = look.join(large, ["part", "key"], "left_semi").select("fp").distinct()
    near = F.transform(F.lit([0, *(_mask([b]) for b in range(BITS))]), lambda f: F.col("fp").bitwiseXOR(f))
    meet = cut(crowd.select("fp", F.explode(near).alias("word")))
    first = meet.groupBy("word").agg(F.min("fp").alias("src"), F.count("*").alias("n")).where("n > 1").select("word", "src")
    stars = meet.join(first, "word").where("fp <> src").select("src", F.col("fp").alias("dst"))
    return pairs.unionByName(stars).distinct()


def components(marked: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``(fp, root)``: for every distinct fingerprint of written ``(…, fp)`` rows, the smallest one it is linked to."""
    distinct = cut(marked.select("fp").distinct())
    labels, _ = star_labels(links(distinct, distance))
    return distinct.join(labels.withColumnRenamed("id", "fp"), "fp", "left").select("fp", F.coalesce("label", "fp").alias("root"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, distance: int = DISTANCE
) -> DataFrame:
    """``(doc_id, fp, component_id)``, one row per document: its fingerprint and the smallest id it is linked to.

    Links are transitive.  Null and empty texts have fingerprint 0 and are linked
    like any other; texts shorter than a shingle are one shingle; rows with equal
    ids are rows of their own; a null id is never a component id unless its whole
    component has none; an empty table gives no rows; other columns are ignored.
    """
    marked = cut(fingerprints(docs, id_col, text_col, size))
    first = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    rooted = cut(components(marked, distance).join(first, "fp"))
    roots = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = cut(rooted.join(roots, "root").select("fp", "component_id"))
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of every group of near-duplicates, all columns kept.

    The row with the smallest id stays, then that with the smallest hash of its
    text, then that with the smallest hash of all columns; null ids come last.  Groups
    are made of texts alone: rows with equal ids and unrelated texts are in groups of
    their own, and each group keeps a row.  Null and empty texts are one group.  An
    empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(text).alias("h"))
    marked = cut(_marked(docs.select(key.alias("key"), text.alias("text"))))
    # a text has one fingerprint, so a key is in one group and names the first of just one
    best = marked.groupBy("fp").agg(F.min("key").alias("key"), F.count("*").alias("n"))
    rooted = components(marked).join(best, "fp")
    winners = rooted.groupBy("root").agg(F.min("key").alias("key")).select("key")
    counted = cut(marked.join(winners, "key", "left_semi").groupBy("key").agg(F.count("*").alias("n")))
    keyed = docs.select(F.struct("*").alias("_doc"), key.alias("_key"))

    def of(keys: DataFrame) -> DataFrame:
        return keyed.join(keys.select(F.col("key").alias("_key")), "_key", "left_semi")

    alone = of(counted.where("n = 1")).select("_doc")
    # repeated rows are combined before they are exchanged
    repeated = of(counted.where("n > 1")).groupBy("_key").agg(F.min_by("_doc", F.xxhash64("_doc")).alias("_doc")).select("_doc")
    return alone.unionByName(repeated).select(*(F.col("_doc")[c].alias(c) for c in docs.columns))
