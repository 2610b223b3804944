"""Pipeline stages work on rows: equal ids, null ids and repeated rows lose nothing."""

import random

import pytest

from sparkgas.llm import decontaminate, simhash

SCHEMA = "doc_id bigint, text string, source string"


def prose(seed: int) -> str:
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choices("abcdefghij", k=5)) for _ in range(60))


A, B, C, D = map(prose, range(4))


def rows(df):
    return sorted(((r.doc_id, r.text, r.source) for r in df.collect()), key=str)


@pytest.mark.parametrize(
    ("given", "kept"),
    [
        ([(1, A), (1, B), (2, A), (3, B)], [(1, A), (1, B)]),
        ([(1, A), (1, B), (1, C), (0, C)], [(0, C), (1, A), (1, B)]),
        ([(None, A), (None, B), (5, A), (None, None), (None, "")], [(5, A), (None, B), (None, None)]),
        ([(1, A), (1, A), (1, A), (2, B), (2, B)], [(1, A), (2, B)]),
        ([(4, None), (3, ""), (9, D)], [(3, ""), (9, D)]),
        ([(7, A), (7, A + " end"), (8, A), (7, B)], [(7, A), (7, B)]),
        ([], []),
    ],
)
def test_every_group_keeps_one_row(spark, given, kept):
    docs = spark.createDataFrame([(i, t, "s") for i, t in given], SCHEMA).repartition(3)
    got = rows(simhash.keep_one(docs))
    groups = {(r.doc_id, r.fp): r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert len(got) == len(kept) and len({(i) for i, _, _ in got}) == len({i for i, _ in kept}) and groups is not None
    for (i, t, _), (j, u) in zip(got, sorted(kept, key=str)):
        assert i == j and (t == u or {t, u} <= {A, A + " end"} or not (t or u))


def test_the_same_row_stays_whatever_the_order(spark):
    given = [(1, A, s) for s in "zyxw"] + [(1, B, s) for s in "ab"] + [(2, A, "q")]
    found = {str(rows(simhash.keep_one(spark.createDataFrame(given, SCHEMA).repartition(n)))) for n in (1, 2, 5)}
    assert len(found) == 1


def test_a_row_goes_by_its_own_hit(spark):
    words = " ".join(f"word{i}" for i in range(12))
    items = spark.createDataFrame([(1, words)], "item_id bigint, text string")
    given = [(1, f"x {words} y", "a"), (1, A, "b"), (2, B, "c"), (None, f"{words} z", "d"), (None, C, "e"), (3, None, "f"), (3, words, "g"), (2, B, "c")]
    docs = spark.createDataFrame(given, SCHEMA).repartition(2)
    assert rows(decontaminate.keep_clean(docs, items)) == sorted([given[i] for i in (1, 2, 4, 5, 7)], key=str)
    assert rows(decontaminate.keep_clean(docs, items.limit(0))) == sorted(given, key=str)
