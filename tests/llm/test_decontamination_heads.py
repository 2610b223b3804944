"""Proximity matches at the head of documents belong to these documents."""

import pytest
from pyspark.sql import functions as F

from sparkgas.llm import decontaminate

WINDOW = "alpha beta gamma delta"


@pytest.mark.parametrize("windows", [100_000, 1])
def test_displaced_windows_at_the_head(spark, monkeypatch, windows):
    monkeypatch.setattr(decontaminate, "WINDOWS", windows)
    # delta is the rarest term; its place less its offset lies before the document
    rows = [
        (1, "beta alpha delta gamma and more"), (2, "none of it"), (3, "alpha beta delta gamma"), (4, "nothing alpha beta gamma"),
        (5, "beta gamma delta alpha alpha beta gamma"), (6, "alpha beta gamma delta"),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    items = spark.createDataFrame([(7, WINDOW), (8, "other words that occur nowhere"), (9, "none of it")], "item_id bigint, text string")
    found = decontaminate.decontaminate(docs, items, slop=2).collect()
    assert sorted(r.doc_id for r in found) == [1, 2, 3, 4, 5, 6]
    near = {r.doc_id: r.near_items for r in found}
    # 5: alpha lies four words from its place
    assert near == {1: ["7"], 2: [], 3: ["7"], 4: [], 5: [], 6: []}
    assert {r.doc_id: r.items for r in found} == {1: [], 2: ["9"], 3: [], 4: [], 5: [], 6: ["7"]}


def test_owners_of_a_shared_window_do_not_pass_the_driver(spark, monkeypatch):
    """10,000 items share a prompt line: the driver gets one plan for each of its windows."""
    line = " ".join(f"prompt{i}" for i in range(11))
    items = spark.range(10_000).select(F.col("id").alias("item_id"), F.lit(line).alias("text"))
    docs = spark.createDataFrame([(1, f"so {line} it goes"), (2, "nothing here"), (3, line[:-1] + "x")], "doc_id bigint, text string")
    asked, look_up = [], decontaminate.look_up
    monkeypatch.setattr(decontaminate, "look_up", lambda index, plans, *a: (asked.extend(plans), look_up(index, plans, *a))[1])
    found = {r.doc_id: r for r in decontaminate.decontaminate(docs, items).collect()}
    assert len(asked) == 2 and sum(len(str(p)) for p in asked) < 2000
    assert len(found[1]["items"]) == 10_000 and found[1]["items"] == sorted(map(str, range(10_000)))
    assert found[2]["items"] == [] and len(found[3]["items"]) == 10_000
