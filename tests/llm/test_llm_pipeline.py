"""The pipeline against the operators its stages are made of."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkgas.llm import chat_format, decontaminate, quality_classifier, simhash

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """The documents before and after each stage, as the stages write them."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_quality_stage(spark, kept):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scored = quality_classifier.classify(kept[0], labels)
    assert ids(kept[1]) == ids(scored.where("score >= 0.5"))
    assert 0 < len(ids(kept[1])) < len(ids(kept[0]))


def test_near_duplicate_stage(kept):
    found = simhash.near_duplicates(kept[1])
    assert ids(kept[2]) == sorted(r[0] for r in found.select("component_id").distinct().collect())


def test_decontamination_stage(spark, kept):
    found = decontaminate.decontaminate(kept[2], spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert ids(kept[3]) == ids(found.where(F.size("ranges") == 0))


def test_personal_data_stage(kept):
    assert ids(kept[4]) == ids(kept[3]) and kept[4].columns == kept[0].columns
    assert kept[4].where(F.col("text").rlike(r"[a-z0-9]@mail[0-9]\.")).count() == 0
    assert kept[4].where(F.length("text") != F.col("n_chars")).count() == 0


def test_packing_stage_and_run(spark, kept):
    pieces = corpus_pipeline.run(spark, SF)
    assert sorted(map(str, pieces.select("doc_id", "start", "ids_crc32").collect())) == sorted(
        map(str, kept[5].select("doc_id", "start", "ids_crc32").collect())
    )
    assert {r.doc_id for r in pieces.collect()} == set(ids(kept[4]))


def test_chats_read_back(spark):
    import random

    rnd = random.Random(5)
    parts = ["\\", "###", "</turn>", "\n", "### user:\n", "#", "a", "</turn", ">", "n", ":", " ", "\n</turn>\n", "é"]
    text = lambda n: "".join(rnd.choice(parts) for _ in range(rnd.randrange(n)))
    rows = [(i, t, rnd.choice([text(4), "assistant", "user"]), text(9)) for i in range(1500) for t in range(rnd.randrange(1, 4))]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    shown = chat_format.format_chats(df).select(
        "conv_id", "round_trip", chat_format.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")
    )
    want = {}
    for i, _, role, body in rows:
        want[i] = want.get(i, "") + (body if role == "assistant" else "")
    found = {r.conv_id: r for r in shown.collect()}
    assert all(r.round_trip for r in found.values())
    assert {i: r.loss for i, r in found.items()} == want


def test_registered_once():
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert [n for n in names if n.startswith("op")] and "pipeline" in names
    assert len({n.split("_")[0] for n in names if n.startswith("op")}) == 13
