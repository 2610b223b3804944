"""Every score of the classifier against one machine that holds all rows and follows the definitions."""

import math
import struct
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sparkgas.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def described(text):
    """The 15 statistics, byte by byte."""
    raw = (text or "").encode()
    n, words = max(len(raw), 1), raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip()]
    k = max(len(words), 1)
    share = lambda test: sum(1 for b in raw if test(chr(b))) / n
    shouted, i = 0, 0
    while i < len(raw) - 1:
        found = raw[i] in b"!?" and raw[i + 1] in b"!?"
        shouted += found
        i += 2 if found else 1
    return [
        math.log(len(raw) + 1),
        math.log(len(words) + 1),
        min(sum(len(w) for w in words) / k, 50),
        share(lambda c: c >= "\x80" or "a" <= c <= "z" or "A" <= c <= "Z"),
        share(lambda c: "A" <= c <= "Z"),
        share(lambda c: "0" <= c <= "9"),
        share(lambda c: c in "#*$%&|<>@^~=_{}[]\\/"),
        share(lambda c: c in ".,;:!?\"'()-"),
        share(lambda c: c in " \t\n\r\x0b\x0c"),
        len(set(words)) / k,
        sum(words[i] == words[i + 1] for i in range(len(words) - 1)) / k,
        len(set(lines)) / max(len(lines), 1),
        math.log(len(lines) + 1),
        shouted / k,
        len(zlib.compress(raw, 1)) / n if raw else 0,
    ]


def isotonic(good, all_):
    """For each bin, the largest over starts of the smallest over ends of the share of good ones between them."""
    g, n = np.concatenate([[0], np.cumsum(good)]), np.concatenate([[0], np.cumsum(all_)])
    m = len(good)
    return [
        max(min((g[e] - g[s]) / (n[e] - n[s]) for e in range(i + 1, m + 1)) for s in range(i + 1)) for i in range(m)
    ]


def brute_force(docs, labels, features=128, width=3.0, penalty=1e-3):
    x = {i: described(t) for i, t in docs}
    marked = [(i, y) for i, y in labels if i in x and y in (0, 1) and zlib.crc32(str(i).encode()) % 3 != 1]
    # Spark's hash of a long: XXH64 with seed 42 over its eight bytes, as a signed number
    signed = lambda i: struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(struct.pack("<q", i), 42)))[0]
    aside = [r for r in marked if signed(r[0]) % 5 == 0]
    fitted = [r for r in marked if signed(r[0]) % 5 != 0]
    assert aside and {y for _, y in fitted} == {0, 1}
    rows, y = np.array([x[i] for i, _ in fitted]), np.array([float(v) for _, v in fitted])
    mean, scale = rows.mean(0), np.sqrt(np.maximum(rows.var(0), 1e-6))
    rng = np.random.default_rng(7)
    weights, phases = rng.normal(0, 1 / width, (15, features)), rng.uniform(0, 2 * np.pi, features)

    def waves(some):
        z = np.clip((np.array(some) - mean) / scale, -8, 8)
        return np.hstack([math.sqrt(2 / features) * np.cos(z @ weights + phases), np.ones((len(some), 1))])

    # ridge as least squares with one more row for every weight, each class worth half of all rows
    root = np.sqrt(np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum())))
    size = features + 1
    extra = math.sqrt(penalty * len(y) / size) * np.eye(size)
    ridge = np.linalg.lstsq(np.vstack([root[:, None] * waves(rows), extra]), np.concatenate([root * y, np.zeros(size)]), rcond=None)[0]
    raw = waves([x[i] for i, _ in aside]) @ ridge
    bins = {}
    for s, (_, v) in zip(raw, aside):
        bins.setdefault(min(max(int((s + 0.5) / 2 * 1000), 0), 999), []).append((s, v))
    kept = [bins[b] for b in sorted(bins)]
    chances = isotonic([sum(v for _, v in b) for b in kept], [len(b) for b in kept])
    # a pool is a run of bins with the same share
    pools = {}
    for b, c in zip(kept, chances):
        pools.setdefault(round(c, 12), []).extend(s for s, _ in b)
    at, share = [float(np.mean(s)) for s in pools.values()], list(pools)
    at = [min(-0.5, at[0] - 1), *at, max(1.5, at[-1] + 1)]
    share = [0.5 * share[0], *[0.005 + 0.99 * c for c in share], 0.5 + 0.5 * share[-1]]
    share = np.maximum.accumulate(share)
    return {i: float(np.interp(waves([v])[0] @ ridge, at, share)) for i, v in x.items()}


def test_scores(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality").collect()]
    want = brute_force(docs, labels)
    got = QUERIES["op5_quality_classifier"](spark, SF).collect()
    assert len(got) == len(docs) == len(want)
    for r in got:
        assert r["score"] == pytest.approx(want[r["doc_id"]], abs=1e-6)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert r["predicted"] == int(r["score"] >= 0.5)


def test_hash_of_ids(spark):
    """The rule by which the test above sets rows aside is Spark's."""
    for r in spark.range(-3, 40).select("id", F.pmod(F.xxhash64("id"), F.lit(5)).alias("part")).collect():
        digest = xxhash.xxh64_intdigest(struct.pack("<q", r["id"]), 42)
        assert (digest - 2**64 * (digest >= 2**63)) % 5 == r["part"]
