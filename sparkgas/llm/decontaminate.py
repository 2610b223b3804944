"""Benchmark decontamination on a distributed positional inverted index.

The documents of a task are cut into segments.  A segment is one row: the
postings (positions in increasing order) of each term in its documents.  A
window of benchmark words is looked up by intersecting the postings of its
terms, moved back by the term's place in the window, from the rarest term of
the corpus on.  Terms of a window that lie near their places, but not all at
them, make a proximity match.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkgas.llm.common import bounded_batches, texts
from sparkgas.plans.cluster import cut

SEGMENT_WORDS = 1_000_000
GAP = 64  # positions left free between documents; no window reaches across
MOST_SLOP = 16
VOCABULARY = 200_000  # terms that one job carries along; beyond it all terms are indexed
WINDOWS = 100_000  # windows looked up in one pass over the index
SEPARATORS = [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
LOWER = bytes(32 if b in SEPARATORS else b + 32 if 65 <= b <= 90 else b for b in range(256))

SEGMENTS = (
    "segment bigint, doc_ids array<bigint>, doc_starts array<int>, doc_words array<int>, "
    "terms array<string>, counts array<int>, postings binary"
)
FOUND = (
    "segment bigint, place int, doc_id bigint, n_words bigint, starts array<int>, ends array<int>, "
    "windows array<bigint>, near array<bigint>"
)


def words(text: str) -> list[bytes]:
    """Words of a text as UTF-8: A-Z lower-cased, then runs of digits, a-z and all that is not ASCII."""
    return text.encode("utf-8", "replace").translate(LOWER).split()


def build_index(docs: DataFrame, vocabulary: frozenset[bytes] | None = None, segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """The segments of ``(doc_id, text)`` rows, with postings of the terms in ``vocabulary`` (None: of all terms).

    A segment holds about ``segment_words`` words, more only if one document
    has more.  Documents without words have a place in it but no postings.
    """
    bounded_batches(docs.sparkSession)

    def build(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        schema = pa.schema(
            [
                ("segment", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_starts", pa.list_(pa.int32())),
                ("doc_words", pa.list_(pa.int32())), ("terms", pa.list_(pa.string())), ("counts", pa.list_(pa.int32())),
                ("postings", pa.binary()),
            ]
        )
        number = TaskContext.get().partitionId() << 32

        def segment():
            ids = np.fromiter(chain.from_iterable(numbered), np.int32, at_word)
            lengths = np.array(sizes, np.int64)
            starts = np.cumsum(lengths + GAP) - lengths - GAP
            place = np.arange(at_word) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
            kept = np.flatnonzero(ids >= 0)
            kept = kept[np.argsort(ids[kept], kind="stable")]
            counts = np.bincount(ids[kept], minlength=len(terms))
            found = place[kept].astype(np.int32)
            steps = np.diff(found, prepend=np.int32(0))
            heads = (np.cumsum(counts) - counts)[counts > 0]
            steps[heads] = found[heads]
            used = np.flatnonzero(counts)
            named = list(terms)
            row = [number, doc_ids, starts, sizes, [named[i] for i in used], counts[used], steps.astype("<i4").tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema)], schema=schema)

        from itertools import chain

        doc_ids, sizes, numbered, at_word = [], [], [], 0
        terms = _numbers(vocabulary)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                own = words(text)
                numbered.append(list(map(terms.__getitem__, own)))
                doc_ids.append(doc_id)
                sizes.append(len(own))
                at_word += len(own)
                if at_word >= segment_words:
                    yield segment()
                    number += 1
                    doc_ids, sizes, numbered, at_word = [], [], [], 0
                    terms = _numbers(vocabulary)
        if doc_ids:
            yield segment()

    return docs.mapInArrow(build, SEGMENTS)


class _numbers(dict):
    """Number of each term: given for a vocabulary (-1 outside of it), else counted up."""

    def __init__(self, vocabulary):
        super().__init__({term: i for i, term in enumerate(sorted(vocabulary))} if vocabulary is not None else {})
        self.closed = vocabulary is not None

    def __missing__(self, term):
        if self.closed:
            return -1
        number = self[term] = len(self)
        return number


def windows_of(items: DataFrame, size: int = 10) -> DataFrame:
    """``(window, item)``: the distinct windows of ``size`` words of each item, or of all words of a shorter one."""

    def split(batches):
        import pyarrow as pa

        for batch in batches:
            found, owners = [], []
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
                own = words(text)
                if own:
                    distinct = {b" ".join(own[i : i + size]) for i in range(max(1, len(own) - size + 1))}
                    found += distinct
                    owners += [item] * len(distinct)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(owners, pa.string())], ["window", "item"])

    named = items.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("item_id"), "text")
    return named.mapInArrow(split, "window string, item string").distinct()


def term_counts(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(term, n)``: occurrences in the corpus of each term in ``wanted``, summed over all segments."""
    own = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).select(
        F.col("t.terms").alias("term"), F.col("t.counts").cast("bigint").alias("n")
    )
    return own.join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("n"))


def _plans(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """``(number, terms, offsets)`` per window that can occur, its terms from the rarest on."""
    placed = windows.select("number", F.posexplode(F.split("window", " ")).alias("at", "term"))
    return (
        placed.join(counts, "term", "left")
        .groupBy("number")
        .agg(
            F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "at", "term"))).alias("by"),
        )
        .where(F.col("by")[0]["n"] > 0)
        .select("number", F.col("by.term").alias("terms"), F.col("by.at").alias("offsets"))
    )


def look_up(index: DataFrame, plans: list, slop: int = 0, every_doc: bool = True) -> DataFrame:
    """Matches of some windows in every document of the index, one row per document.

    ``starts`` and ``ends`` are the merged word ranges of exact matches, ``windows``
    the numbers of the windows there; the terms of the windows in ``near`` all lie at
    most ``slop`` words from their places, the rarest one at its place.
    """

    def match(batches):
        import pyarrow as pa

        names = [f.split()[0] for f in FOUND.split(", ")]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
        asked = [(p[1], np.array(p[2], np.int32), len(p[1]), p[0]) for p in plans]
        for batch in batches:
            for row in batch.to_pylist():
                lists, at = {}, 0
                steps = np.frombuffer(row["postings"], "<i4")
                for term, n in zip(row["terms"], row["counts"]):
                    lists[term] = np.cumsum(steps[at : at + n], dtype=np.int32)
                    at += n
                doc_starts = np.array(row["doc_starts"], np.int32)
                covered, windows, near = {}, {}, {}
                for terms, offsets, size, number in asked:
                    starts, exact = _intersect(lists, terms, offsets, slop)
                    if not len(starts):
                        continue
                    # the rarest term lies in the document, a displaced window may start before it
                    docs = np.searchsorted(doc_starts, starts + offsets[0], "right") - 1
                    for doc, start, hit in zip(docs.tolist(), (starts - doc_starts[docs]).tolist(), exact.tolist()):
                        if hit:
                            covered.setdefault(doc, []).append((start, start + size))
                            windows.setdefault(doc, set()).add(number)
                        else:
                            near.setdefault(doc, set()).add(number)
                out = []
                for doc in range(len(doc_starts)) if every_doc else sorted({*covered, *near}):
                    ranges = _merged(covered.get(doc, ()))
                    out.append((
                        row["segment"], doc, row["doc_ids"][doc], row["doc_words"][doc],
                        [a for a, _ in ranges], [b for _, b in ranges], sorted(windows.get(doc, ())), sorted(near.get(doc, ())),
                    ))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(map(list, zip(*out)), types)], names)

    return index.mapInArrow(match, FOUND)


def _intersect(lists: dict, terms: list[str], offsets: np.ndarray, slop: int):
    """Starts of a window, and whether all its terms lie exactly there."""
    none = np.zeros(0, np.int32)
    own = []
    for term in terms:
        if (found := lists.get(term)) is None:
            return none, none
        own.append(found)
    starts = own[0] - offsets[0]
    exact = np.ones(len(starts), bool)
    for found, offset in zip(own[1:], offsets[1:]):
        due = starts + offset
        after = np.searchsorted(found, due)
        step = np.minimum(np.abs(found[np.minimum(after, len(found) - 1)] - due), np.abs(found[np.maximum(after - 1, 0)] - due))
        kept = step <= slop
        starts, exact = starts[kept], exact[kept] & (step[kept] == 0)
        if not len(starts):
            break
    return starts, exact


def _merged(ranges) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    size: int = 10,
    slop: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """One row per document: ``doc_id, n_words, ranges, items, near_items``.

    ``ranges`` are the merged word ranges ``(start, end)`` of windows that occur,
    ``items`` the sorted ids (as text) of their benchmark items, ``near_items``
    those with a proximity match.  Null and empty texts have no words, so no
    window and no hit; a null item id counts as the empty id; rows with equal ids
    are documents of their own, and equal items each count; an empty table on
    either side gives rows without hits, or no rows; other columns are ignored.

    The windows are counted first.  Up to ``WINDOWS`` of them go to all tasks in
    one pass; more are looked up in blocks of that size, one pass each.  The index
    is written once to the checkpoint folder.  Only one row per document and pass
    is exchanged.  Tasks know windows by number; whose they are is joined afterwards.
    """
    if not 0 <= slop <= MOST_SLOP or not 1 <= size <= GAP - 2 * MOST_SLOP:
        raise ValueError(f"slop up to {MOST_SLOP} and windows up to {GAP - 2 * MOST_SLOP} words")
    owned = cut(windows_of(texts(benchmark, item_col, item_text_col), size))
    windows = cut(owned.select("window").distinct().withColumn("number", F.monotonically_increasing_id()))
    wanted = cut(windows.select(F.explode(F.split("window", " ")).alias("term")).distinct())
    n_terms, n_windows = wanted.count(), windows.count()
    vocabulary = frozenset(r[0].encode() for r in wanted.collect()) if n_terms <= VOCABULARY else None
    index = cut(build_index(texts(docs, id_col, text_col), vocabulary))
    plans = _plans(windows, term_counts(index, wanted))
    blocks = max(1, -(-n_windows // WINDOWS))
    if blocks == 1:
        found = look_up(index, plans.collect(), slop)
    else:
        plans = cut(plans.withColumn("block", F.pmod(F.xxhash64("terms", "offsets"), F.lit(blocks))))
        passes = [cut(look_up(index, plans.where(F.col("block") == b).drop("block").collect(), slop, b == 0)) for b in range(blocks)]
        found = passes[0]
        for more in passes[1:]:
            found = found.unionByName(more)
        found = _together(found)
    found = _owners(cut(found), owned.join(windows, "window").select("number", "item"))
    return found.select(
        "doc_id",
        "n_words",
        F.arrays_zip(F.col("starts").alias("start"), F.col("ends").alias("end")).alias("ranges"),
        "items",
        "near_items",
    )


def _owners(found: DataFrame, owned: DataFrame) -> DataFrame:
    """``items`` and ``near_items`` of each document, from a join of its windows with those of the items.

    Only documents with a window are exchanged, one row per window and then one per item.
    """
    any_ = (F.size("windows") > 0) | (F.size("near") > 0)
    place = ["segment", "place"]
    marks = F.concat(*(F.transform(c, lambda w: F.struct(w.alias("number"), F.lit(exact).alias("exact"))) for c, exact in (("windows", True), ("near", False))))
    pairs = found.where(any_).select(*place, F.explode(marks).alias("w")).select(*place, "w.number", "w.exact")
    items = pairs.join(owned, "number").select(*place, "item", "exact").distinct().groupBy(*place).agg(
        *(F.array_sort(F.collect_list(F.when(F.col("exact") == exact, F.col("item")))).alias(c) for c, exact in (("items", True), ("near_items", False)))
    )
    none = F.array().cast("array<string>")
    without = found.where(~any_).select("doc_id", "n_words", "starts", "ends", none.alias("items"), none.alias("near_items"))
    return without.unionByName(found.where(any_).join(items, place).select(*without.columns))


def _together(found: DataFrame) -> DataFrame:
    """The rows of each document from several passes as one."""
    lists = {c: F.flatten(F.collect_list(c)) for c in ("starts", "ends", "windows", "near")}
    rows = found.groupBy("segment", "place", "doc_id", "n_words").agg(*(v.alias(c) for c, v in lists.items()))
    ranges = F.array_sort(F.arrays_zip(F.col("starts").alias("start"), F.col("ends").alias("end")))
    grown = lambda out, r: F.when(
        F.size(out) == 0, F.array(r)
    ).when(
        r["start"] <= F.element_at(out, -1)["end"],
        F.concat(
            F.slice(out, F.lit(1), F.size(out) - 1),
            F.array(F.struct(F.element_at(out, -1)["start"].alias("start"), F.greatest(F.element_at(out, -1)["end"], r["end"]).alias("end"))),
        ),
    ).otherwise(F.concat(out, F.array(r)))
    merged = F.aggregate("ranges", F.array().cast("array<struct<start:int,end:int>>"), grown)
    return (
        rows.withColumn("ranges", ranges)
        .withColumn("ranges", merged)
        .select(
            "segment", "place", "doc_id", "n_words",
            F.col("ranges.start").alias("starts"), F.col("ranges.end").alias("ends"),
            F.array_distinct("windows").alias("windows"),
            F.array_distinct("near").alias("near"),
        )
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose own text holds a window of a benchmark item, all columns kept.

    A row is judged by its text alone, named by a hash of it, so rows with equal or
    null ids do not touch each other.  Null and empty texts stay; an empty table on
    either side changes nothing.
    """
    own = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    found = decontaminate(docs.select(own.alias("doc_id"), F.col(text_col).alias("text")), benchmark, size, slop=0)
    hit = cut(found.where(F.size("ranges") > 0).select(F.col("doc_id").alias("_own")).distinct())
    kept = docs.select(F.struct("*").alias("_doc"), own.alias("_own")).join(hit, "_own", "left_anti")
    return kept.select(*(F.col("_doc")[c].alias(c) for c in docs.columns))
