"""Document fingerprints by consistent weighted sampling.

A text is a set of weighted terms: its words, where a longer one counts as its
character windows, weighted by one plus the logarithm of their number.  Every
sample draws, for each term, two gamma variables and a uniform one from the term
alone, finds the term's greatest active weight below its own, and keeps the term
that would be hit first.  Two texts agree in a sample with the probability of
their generalised Jaccard similarity, the sum of the smaller weights over the sum
of the larger ones.
"""

from __future__ import annotations

import gc
import json

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgas.llm.common import bounded_batches, texts

SAMPLES = 128
SEED = 17
LONG_WORD, WINDOW = 32, 8  # longer words, in code points, count as their windows
KNOWN = 1 << 17  # weighted terms whose samples a task remembers
SAMPLED = 64  # sampled keys for each range of documents; they only set the bounds of the ranges
MOST_RANGES = 20_000
TOGETHER = 128  # new terms that are drawn in one step
GOLDEN = np.uint32(0x9E3779B9)


def terms(text: str) -> dict[bytes, int]:
    """How often each term occurs: words between ASCII white space with A-Z lower-cased, and windows of long ones."""
    from collections import Counter

    found = Counter(text.encode("utf-8", "replace").lower().split())
    for word in [w for w in found if len(w) > LONG_WORD] if found and len(max(found, key=len)) > LONG_WORD else ():
        if len(letters := word.decode("utf-8", "replace")) > LONG_WORD:
            n = found.pop(word)
            for i in range(len(letters) - WINDOW + 1):
                found[letters[i : i + WINDOW].encode("utf-8", "replace")] += n
    return found


def _mixed(x: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Every bit of a 32-bit number and its key changes about half of the result.  Works in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= key
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def draws(hashes: np.ndarray, samples: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(r, c, beta)`` of each term and sample: two Gamma(2, 1) variables and a uniform one, from the term's hash alone."""
    low, high = hashes.astype(np.uint32), (hashes >> np.uint64(32)).astype(np.uint32)
    at = np.arange(5 * samples, dtype=np.uint32) * GOLDEN
    bits = _mixed(low[:, None] + at[None, :], high[:, None])
    bits >>= np.uint32(9)
    u = bits.view(np.int32).astype(np.float32)
    u += np.float32(0.5)
    u *= np.float32(2.0**-23)
    u = u.reshape(len(hashes), 5, samples)
    return -np.log(u[:, 0] * u[:, 1]), -np.log(u[:, 2] * u[:, 3]), u[:, 4]


def sampled(hashes: np.ndarray, weights: np.ndarray, samples: int) -> tuple[np.ndarray, np.ndarray]:
    """For each weighted term and sample: the logarithm of when it is hit, and the step of its greatest active weight."""
    r, c, beta = draws(hashes, samples)
    t = np.log(weights).astype(np.float32)[:, None] / r
    t += beta
    np.floor(t, out=t)
    step = t.astype(np.int32)
    t -= beta
    t += 1
    t *= r
    hit = np.log(c)
    hit -= t
    return hit, step


class Signer:
    """Signatures of texts; the samples of a bounded number of weighted terms are remembered."""

    def __init__(self, samples: int = SAMPLES, seed: int = SEED, known: int = KNOWN):
        self.samples, self.seed, self.known = samples, seed, known
        self.hit, self.step = np.empty((known, samples), np.float32), np.empty((known, samples), np.int32)
        self.hashes, self.every, self.place = np.empty(known, np.uint64), np.arange(samples), {}

    def _places(self, some: list) -> list[int]:
        import xxhash

        places = list(map(self.place.get, some))
        if None not in places:
            return places
        new = [term for term, place in zip(some, places) if place is None]
        if len(self.place) + len(new) > self.known:
            self.place, new, places = {}, some, [None] * len(some)
        first = len(self.place)
        to = first + len(new)
        self.hashes[first:to] = [xxhash.xxh64_intdigest(t, self.seed) for t, _ in new]
        weights = 1 + np.log([n for _, n in new])
        for at in range(0, len(new), TOGETHER):
            rows = slice(first + at, min(first + at + TOGETHER, to))
            self.hit[rows], self.step[rows] = sampled(self.hashes[rows], weights[at : at + TOGETHER], self.samples)
        self.place.update(zip(new, range(first, to)))
        fresh = iter(range(first, to))  # ``new`` in its order
        return [next(fresh) if place is None else place for place in places]

    def sign(self, text: str) -> np.ndarray:
        """16 bits of the term and step that each sample keeps; all 0 without terms."""
        weighted = list(terms(text).items())
        out, best = np.zeros(self.samples, np.uint16), np.full(self.samples, np.inf, np.float32)
        for at in range(0, len(weighted), self.known // 4):
            rows = np.array(self._places(weighted[at : at + self.known // 4]))
            hits = self.hit.take(rows, axis=0)
            first = hits.argmin(axis=0)
            hits, rows = hits[first, self.every], rows[first]
            kept = self.hashes[rows]
            left = kept.astype(np.uint32) + self.step[rows, self.every].astype(np.uint32) * GOLDEN
            left = _mixed(left, (kept >> np.uint64(32)).astype(np.uint32)) >> np.uint32(16)
            out = np.where(hits < best, left.astype(np.uint16), out)
            best = np.minimum(hits, best)
        return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated generalised Jaccard similarity: the share of samples that agree."""
    return float(np.mean(a == b))


def shown(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


def fingerprints(docs: DataFrame, samples: int = SAMPLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint)``, four hexadecimal digits a sample, one row per input row.

    Equal texts have equal fingerprints.  Null and empty texts have no terms and a
    fingerprint of zeros; null ids stay; repeated rows are signed one by one; an
    empty table gives no rows; other columns are ignored.  Nothing is exchanged.
    """
    bounded_batches(docs.sparkSession)

    def sign(batches):
        import pyarrow as pa

        signer = Signer(samples)
        for batch in batches:
            found = [shown(signer.sign(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.string())], ["doc_id", "fingerprint"])

    return texts(docs, id_col, text_col).mapInArrow(sign, "doc_id bigint, fingerprint string")


# -------------------------------------------------------------------- documents beside the next one


KEY = "struct<doc_id:bigint,h:bigint,part:int>"


def _lookup(rows: list) -> Column:
    return F.from_json(F.lit(json.dumps(rows)), f"array<{KEY}>")


def _bounds(keyed: DataFrame, ranges: int) -> list[dict]:
    """Keys that part the documents into about equal ranges, from a sample of about ``SAMPLED`` keys for each."""
    n = keyed.count()
    step = max(1, n // (SAMPLED * ranges))
    chosen = F.pmod(F.xxhash64("key", F.monotonically_increasing_id()), F.lit(step)) == 0
    some = [r.key.asDict() for r in keyed.where(chosen).select("key").collect()]
    some.sort(key=lambda k: (k["doc_id"] is not None, k["doc_id"] or 0, k["h"], k["part"]))
    cuts = [some[len(some) * i // ranges] for i in range(1, ranges)] if some else []
    return [k for i, k in enumerate(cuts) if not i or k != cuts[i - 1]]


def beside_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """``(range, head, key, text)``: documents in ranges of ascending ids, each range sorted and in one partition.

    A range ends with a copy (``head``) of the document behind its last one, which
    for the last range is the first of all.  ``docs`` is ``(doc_id, text)``.

    Null ids come first; rows with equal ids are ordered by a hash of their text
    and then by their input partition, so that a range of equal rows can be cut too.
    Texts are exchanged once.  The ranges' bounds and first keys go through the
    driver, a few keys for each range, of which there are ``spark.sql.shuffle.partitions``,
    at most ``MOST_RANGES``.
    """
    spark = docs.sparkSession
    ranges = min(MOST_RANGES, ranges or int(spark.conf.get("spark.sql.shuffle.partitions")))
    key = F.struct(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("h"), F.spark_partition_id().alias("part"))
    keyed = docs.select(key.alias("key"), "text")
    bounds = _bounds(keyed, ranges)
    cuts, steps = _lookup(bounds), [1 << i for i in reversed(range(len(bounds).bit_length()))]
    # binary search: how many bounds are not above the key
    below = lambda at, step: F.when(F.get(cuts, at + step - 1) <= F.col("key"), at + step).otherwise(at)
    number = F.aggregate(F.lit(steps), F.lit(0), below) if bounds else F.lit(0)
    placed = keyed.select("key", "text", number.alias("range"))
    first = {r.range: r.key.asDict() for r in placed.groupBy("range").agg(F.min("key").alias("key")).collect()}  # one row per range
    used = sorted(first)
    before = {b: used[i - 1] for i, b in enumerate(used)}
    n = len(bounds) + 1
    heads, previous = _lookup([first.get(b) for b in range(n)]), F.lit([before.get(b, 0) for b in range(n)])
    own = F.struct(F.col("range").alias("range"), F.lit(False).alias("head"))
    copy = F.struct(F.get(previous, F.col("range")).alias("range"), F.lit(True).alias("head"))
    to = F.when(F.get(heads, F.col("range")) == F.col("key"), F.array(own, copy)).otherwise(F.array(own))
    dealt = placed.select("key", "text", F.explode(to).alias("to")).select("to.*", "key", "text")
    return dealt.repartitionById(n, F.col("range")).sortWithinPartitions("range", "head", "key")


EDITED = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def with_edits(docs: DataFrame, samples: int = SAMPLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's fingerprint beside those of its edited text and of the next document.

    The edited text has its last quarter (rounded down) replaced by as many code
    points from the head of the next document, or all of it; the next one of the
    last document is the first, and a document alone is its own next one.
    ``near_edited`` and ``near_next`` are the shares of samples that agree.

    Null and empty texts have no terms: their fingerprints are zeros and agree with
    each other.  Null ids come first; rows with equal ids are rows of their own,
    ordered by a hash of their text; an empty table gives no rows; other columns are
    ignored.  A task holds two documents at a time.
    """
    bounded_batches(docs.sparkSession)

    def compare(batches):
        import hashlib

        import pyarrow as pa

        gc.disable()  # nothing here refers to itself, and looking for that among many terms takes long
        names = [f.split()[0] for f in EDITED.split(", ")]
        types = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
        signer, held = Signer(samples), None
        for batch in batches:
            out = []
            ranges, heads = batch.column("range").to_pylist(), batch.column("head").to_pylist()
            for number, head, key, text in zip(ranges, heads, batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                if held is not None and held[0] != number:
                    raise ValueError("a range of documents has lost the head of the next one")
                if head and held is None:
                    continue  # further copies of a head
                own = signer.sign(text)
                if held is not None:
                    _, doc_id, old, signature = held
                    quarter = len(old) // 4
                    edited = old[: len(old) - quarter] + text[:quarter]
                    other = signer.sign(edited)
                    digest = hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest()
                    near = likeness(signature, other), likeness(signature, own)
                    out.append((doc_id, len(old), digest, shown(signature), shown(other), *near))
                held = None if head else (number, key["doc_id"], text, own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
        gc.enable()
        if held is not None:
            raise ValueError("a range of documents has lost the head of the next one")

    return beside_next(texts(docs, id_col, text_col)).mapInArrow(compare, EDITED)
