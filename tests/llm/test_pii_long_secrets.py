"""Secrets of any length are found and redacted whole."""

import random

from pyspark.sql import functions as F

from sparkgas.llm import pii


def test_long_secrets(spark):
    rnd = random.Random(6)
    make = lambda n: "a1" + "".join(rnd.choice("abcXYZ0189+/_-") for _ in range(n - 2))
    rows = [(n, f"the token = {make(n)}, then more") for n in (23, 24, 128, 129, 700, 30_000)]
    df = spark.createDataFrame([*rows, (1, f"a commit {make(700)}")], "doc_id bigint, text string")
    spans = {r.doc_id: r.spans for r in pii.find_spans(df).select("doc_id", F.expr("filter(spans, s -> s.kind = 'secret')").alias("spans")).collect()}
    assert {i: [(s.start, s.end) for s in found] for i, found in spans.items()} == {
        1: [], 23: [], **{n: [(12, 12 + n)] for n in (24, 128, 129, 700, 30_000)}
    }
    clean = {r.doc_id: r.text for r in pii.redact(df.where("doc_id >= 24")).collect()}
    assert set(clean.values()) == {"the token = [SECRET], then more"}
