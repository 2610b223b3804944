"""Consistent weighted sampling against exact similarities, and documents beside their next one."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkgas.llm import fingerprints as fp

CLASH = "key range head part h text2 fingerprint n_chars doc".split()


def jaccard(a: dict, b: dict) -> float:
    weight = lambda found, k: 1 + math.log(found[k]) if k in found else 0.0
    both = {*a, *b}
    low, high = (sum(f(weight(a, k), weight(b, k)) for k in both) for f in (min, max))
    return low / high if both else 1.0


def test_collision_rate_is_the_generalised_jaccard_similarity(monkeypatch):
    monkeypatch.setattr(fp, "terms", lambda found: found)
    rng, signer, errors = np.random.default_rng(3), fp.Signer(samples=256), []
    for trial in range(300):
        a = {f"{trial}a{i}".encode(): int(rng.integers(1, 9)) for i in range(40)}
        b = {k: int(rng.integers(1, 9)) for k in list(a)[: int(rng.integers(0, 41))]} | {f"{trial}b{i}".encode(): 2 for i in range(12)}
        errors.append(fp.likeness(signer.sign(a), signer.sign(b)) - jaccard(a, b))
    assert abs(np.mean(errors)) < 0.006 and np.std(errors) < 0.045


def test_draws_have_the_right_moments():
    r, c, beta = fp.draws(np.random.default_rng(1).integers(0, 1 << 63, 4000).astype(np.uint64), 64)
    for gamma in (r, c):
        assert gamma.min() > 0 and abs(gamma.mean() - 2) < 0.02 and abs(gamma.var() - 2) < 0.05
    assert abs(beta.mean() - 0.5) < 0.005 and abs(np.corrcoef(r.ravel(), c.ravel())[0, 1]) < 0.01


def test_what_a_task_remembers_does_not_change_a_signature():
    texts = [" ".join(f"w{i * j % 97}" for i in range(n)) for j, n in enumerate((0, 1, 30, 400, 90, 400), 3)]
    wide, narrow = fp.Signer(), fp.Signer(known=16)
    for text in texts * 2:
        assert (wide.sign(text) == narrow.sign(text)).all()


def test_terms():
    assert fp.terms("A a\tÄ b") == {b"a": 2, "Ä".encode(): 1, b"b": 1}
    assert fp.terms("é" * 33) == {("é" * 8).encode(): 26}
    assert fp.terms("é" * 32) == {("é" * 32).encode(): 1} and fp.terms(" \n") == {}


ROWS = [
    (5, "one two three four five six seven eight"), (3, None), (None, "no id here"), (9, "x" * 5000), (4, ""), (4, "four words in four"),
    (4, "four words in four"), (-2, "the first one with an id"), (7, "Ünïcode 𝒳 " * 30), (11, "the last document of them all"),
]


def expected(spark, rows):
    hashes = spark.createDataFrame([(i, d, t or "") for i, (d, t) in enumerate(rows)], "i int, d bigint, t string")
    order = [(r.d, r.t) for r in hashes.orderBy(F.col("d").asc_nulls_first(), F.xxhash64("t")).collect()]
    signer, out = fp.Signer(), []
    for (d, text), (_, after) in zip(order, [*order[1:], *order[:1]]):
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + after[:quarter]
        own, other, next_one = (signer.sign(t) for t in (text, edited, after))
        digest = hashlib.sha256(edited.encode()).hexdigest()
        out.append((d, len(text), digest, fp.shown(own), fp.shown(other), fp.likeness(own, other), fp.likeness(own, next_one)))
    return sorted(out, key=str)


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_edits_against_brute_force(spark, ranges, monkeypatch):
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string").repartition(4).withColumns({c: F.lit("clash") for c in CLASH})
    beside = fp.beside_next
    monkeypatch.setattr(fp, "beside_next", lambda d: beside(d, ranges))
    assert sorted(map(tuple, fp.with_edits(docs).collect()), key=str) == expected(spark, ROWS)


def test_one_row_none_and_a_repeated_one(spark):
    one = spark.createDataFrame([(1, "alone among all the documents")], "doc_id bigint, text string")
    assert [tuple(r) for r in fp.with_edits(one).collect()] == expected(spark, [(1, "alone among all the documents")])
    assert fp.with_edits(one.limit(0)).collect() == [] and fp.fingerprints(one.limit(0)).collect() == []
    many = spark.range(0, 400, 1, 8).select(F.lit(6).alias("doc_id"), F.lit("the same text").alias("text"))
    assert fp.with_edits(many).groupBy("near_next", "edited_sha256").count().collect()[0]["count"] == 400


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, fp.with_edits(docs).collect()), key=str) == expected(spark, rows)
    plain = {(r.doc_id, r.fingerprint) for r in fp.fingerprints(docs).collect()}
    assert plain == {(r.doc_id, r.fingerprint) for r in fp.with_edits(docs).collect()}


def test_ranges_are_even(spark):
    docs = spark.range(0, 20_000, 1, 7).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"))
    sizes = [r["count"] for r in fp.beside_next(docs, 16).groupBy("range").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2.5 * 20_000 / 16 and sum(sizes) == 20_016
