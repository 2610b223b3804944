"""Every operator and stage on nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkgas.llm import (
    chat_format,
    decontaminate,
    lm_scoring,
    packing,
    pii,
    quality_classifier,
    quality_rules,
    simhash,
    token_counts,
    url_filter,
)

LONG = "the cat sat on the mat and saw a dog " * 3000
TEXTS = [(1, None), (2, ""), (3, LONG), (3, LONG), (None, "one two three four"), (4, "x" * 30_000), (5, " \n\t "), (6, "ok then")]
CLASH = "n_words kept n_tokens fp row held_out score x t words base spans rule sequence_id _own".split()
RULES = (url_filter.UrlRule("allow", "com"), url_filter.UrlRule("block", "net"))

OPERATORS = {
    "rules": lambda d, s: quality_rules.apply_rules(d),
    "tokens": lambda d, s: token_counts.token_counts(d),
    "decontaminate": lambda d, s: decontaminate.decontaminate(d, s),
    "classifier": lambda d, s: quality_classifier.classify(d, d.select("doc_id", F.lit(1).alias("quality"))),
    "lm": lambda d, s: lm_scoring.score_texts(d),
    "pii": lambda d, s: pii.find_spans(d),
    "simhash": lambda d, s: simhash.near_duplicates(d),
    "urls": lambda d, s: url_filter.filter_urls(d, RULES, "doc_id", "text"),
}


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(TEXTS, "doc_id bigint, text string").repartition(3)
    return df.withColumns({c: F.lit("clash") for c in CLASH})


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(7, "saw a dog the cat sat on the mat and"), (None, None), (8, "")], "item_id bigint, text string")


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_document(docs, items, name):
    out = OPERATORS[name](docs, items).collect()
    ids = [(r["page_id"] if name == "urls" else r["doc_id"]) for r in out]
    assert sorted(ids, key=str) == sorted((i for i, _ in TEXTS), key=str)
    twice = [r for r, i in zip(out, ids) if i == 3]
    assert len({str({k: v for k, v in r.asDict().items()}) for r in twice}) == 1


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(docs, items, name):
    assert OPERATORS[name](docs.limit(0), items.limit(0)).collect() == []


def test_packing_and_chats_on_odd_rows(spark, docs):
    pieces = packing.pack(docs).collect()
    total = {r.doc_id: r.doc_tokens for r in pieces}
    assert total[1] == total[2] == total[5] == 1 and sum(r.length for r in pieces) == sum(
        total[i] for i, _ in TEXTS
    )
    assert packing.pack(docs.limit(0)).collect() == []
    chats = spark.createDataFrame(
        [(1, 0, None, None), (1, None, "user", "a"), (None, 0, "assistant", "b"), (2, 0, "assistant", "c"), (2, 0, "assistant", "c")],
        "conv_id bigint, turn bigint, role string, text string",
    ).withColumn("t", F.lit(1))
    shown = chat_format.format_chats(chats)
    assert sorted((str(r.conv_id), r.round_trip) for r in shown.collect()) == [("1", True), ("2", True), ("None", True)]
    twice = shown.where("conv_id = 2").select(chat_format.loss_text(F.col("formatted"), F.col("loss_spans"))).first()[0]
    assert twice == "cc"
    assert chat_format.format_chats(chats.limit(0)).collect() == []


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stages(spark, docs, tmp_path, stage):
    name, fn = stage
    for table, rows, schema in (
        ("labels", [(1, 0, 0), (3, 1, 0), (3, None, 0)], "doc_id bigint, quality int, toxic int"),
        ("benchmark", [(1, "words that are in no document of this test at all")], "item_id bigint, text string"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{table}.parquet")
    for rows in (docs, docs.limit(0)):
        out = fn(spark, rows, str(tmp_path))
        n = out.count()
        assert n == 0 or rows is docs
        if name != "packing":
            assert out.columns == docs.columns and out.dtypes[:2] == docs.dtypes[:2]
