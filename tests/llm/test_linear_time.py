"""Rows with very many spans or turns take time in proportion; running values and places in chunks against plain Python."""

import random
import time

import pytest
from pyspark.sql import functions as F

from sparkgas.llm import chat_format, common, pii, url_filter


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 3000])
def test_scan(spark, n):
    rnd = random.Random(n)
    values = [rnd.randrange(-5, 100) for _ in range(n)]
    df = spark.createDataFrame([(values,)], "v array<bigint>")
    row = df.select(common.scan(F.col("v")).alias("s"), common.scan(F.col("v"), F.greatest).alias("m")).first()
    assert row.s == [sum(values[:i]) for i in range(n)] and row.m == [max([0, *values[:i]]) for i in range(n)]


def test_parts_of_a_text(spark):
    text = "".join(random.Random(2).choices("ab\néß𝒳 ", k=1700))
    places = [(a, b) for a in (0, 1, 511, 512, 513, 1024, 1699, 1700) for b in (a, a + 1, 512, 1024, 1536, 1700) if a <= b <= 1700]
    df = spark.createDataFrame([(text, [{"a": a, "b": b} for a, b in places])], "t string, p array<struct<a:int,b:int>>")
    found = df.select(common.let(common.chunked(F.col("t")), lambda c: F.transform("p", lambda p: common.part_of(c, p["a"], p["b"])))).first()[0]
    assert found == [text[a:b] for a, b in places]


def test_spans_and_redaction_of_200_000_addresses(spark):
    one = "someone@mail7.example "
    text = "write to " + one * 200_000 + "or call +49 30 1234567 now"
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    start = time.time()
    spans = pii.find_spans(docs).select("base").first().base
    assert len(spans) == 200_001 and [text[s.start : s.end] for s in spans[199_998:]] == ["someone@mail7.example"] * 2 + ["+49 30 1234567"]
    assert spans[0].score == 1.0
    clean = pii.redact(docs).first().text
    assert clean == "write to " + "[EMAIL] " * 200_000 + "or call [PHONE] now"
    assert time.time() - start < 90


def test_100_000_turns(spark):
    chats = spark.range(100_000).select(
        F.lit(1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("text ### "), "id").alias("text"),
    )
    start = time.time()
    row = chat_format.format_chats(chats).select("round_trip", chat_format.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    assert row.round_trip and row.loss == "".join(f"text ### {i}" for i in range(1, 100_000, 2))
    assert time.time() - start < 60


def plain_redaction(text, spans):
    at, out = 0, ""
    for start, _, kind, end in sorted((s, -e, k, e) for k, s, e in spans):
        if start >= at:
            out += text[at:start] + f"[{kind.upper()}]"
        at = max(at, end)
    return out + text[at:]


def test_redaction_of_overlapping_spans(spark):
    rnd, rows = random.Random(9), []
    for _ in range(60):
        text = "".join(rnd.choices("abcé𝒳\n ", k=rnd.randrange(1500)))
        spans = []
        for _ in range(rnd.randrange(8)):
            a = rnd.randrange(len(text) + 1)
            spans.append((rnd.choice(["email", "ip", "card"]), a, min(len(text), a + rnd.randrange(700))))
        rows.append((text, spans))
    given = [(t, [{"kind": k, "start": a, "end": b, "score": 1.0} for k, a, b in s]) for t, s in rows]
    df = spark.createDataFrame(given, f"text string, spans {pii.SPANS}")
    found = [r[0] for r in df.select(pii.redacted(F.col("text"), F.col("spans"))).collect()]
    assert found == [plain_redaction(t, s) for t, s in rows]


def test_context_reaches_over_matches(spark):
    kind = pii.Kind("x", "[0-9]", "[0-9]", words="mark", score=0.1, context=0.8)
    rnd = random.Random(3)
    texts = ["".join(rnd.choices(["1", "2", " ", "a", "mark ", "é"], [3, 3, 3, 2, 0.3, 1], k=200)) for _ in range(40)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    found = {r.doc_id: [s.start for s in r.base] for r in pii.find_spans(df, (kind,), ()).collect()}
    import re

    near = re.compile(r"(?i)(?<![a-z])(?:mark)")
    for i, t in enumerate(texts):
        assert found[i] == [m.start() for m in re.finditer("[0-9]", t) if near.search(t[max(0, m.start() - pii.AROUND) : m.start()])]


def test_urls_come_back_as_often_as_they_came(spark):
    url = "http://" + "İ" * 12 + ".example.com/a$b"
    pages = spark.createDataFrame([(1, url), (1, url), (2, None), (2, None), (2, None), (3, "$"), (None, "x"), (None, "x")], "page_id bigint, url string")
    rules = (url_filter.UrlRule("allow", "com"), url_filter.UrlRule("block", "net"))
    out = url_filter.filter_urls(pages, rules).groupBy("page_id").count().collect()
    assert {r.page_id: r["count"] for r in out} == {1: 2, 2: 3, 3: 1, None: 2}
