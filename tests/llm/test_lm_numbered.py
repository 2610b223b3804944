"""The scorer cuts text into words and ids once, and works on that."""

import numpy as np
import pytest

from sparkgas.llm import attention, lm_scoring
from sparkgas.llm.tokens import IdCache, default_file, read_file

TEXTS = [
    "  the cat sat\ton the mat \n",
    "",
    " \r\n ",
    None,
    "A\x1cb C\x85d \x0bE\x0cf g\x00h \xa0 k\xa0l",
    "ÀÉ Σας İx don't <|endoftext|> foo!! foo," + " zebra" * 40,
    "many other words " + " ".join(f"w{i}" for i in range(300)),
]


def decoded(table, vocabulary):
    """Words of every document, by way of the dictionary before it, and the ids of every word."""
    words, ids = {}, {}
    for rows in table.rdd.glom().collect():
        entries, names = lm_scoring.Entries(vocabulary), []
        for r in rows:
            if r.part is not None:
                entries.add(r.asDict())
                size, first, pool = entries.made()
                names = [w for e in entries.rows for w in e["words"].split(" ")]
                ids.update((w, pool[a : a + n].tolist()) for w, a, n in zip(names, first, size))
            else:
                words[r.doc_id] = [names[k] for k in np.frombuffer(r.numbers, "<u4")]
    return words, ids


@pytest.mark.parametrize("learnt, entries, gathered", [(600_000, 50_000, 8 << 20), (20, 7, 1)])
def test_numbers_give_the_words_and_ids_back(spark, monkeypatch, learnt, entries, gathered):
    for name, value in (("LEARNT", learnt), ("ENTRIES", entries), ("GATHERED", gathered)):
        monkeypatch.setattr(lm_scoring, name, value)
    spec = read_file(default_file())
    vocabulary = lm_scoring._vocabulary_size(spec)
    rows = [(i, i % 3 == 1, TEXTS[i % len(TEXTS)] or "") for i in range(30)]
    table = lm_scoring.numbered(spark.createDataFrame(rows, "doc_id bigint, held_out boolean, text string").coalesce(2), spec, vocabulary)
    words, ids = decoded(table, vocabulary)
    assert words == {i: [w.decode() for w in lm_scoring.words(t)] for i, _, t in rows}
    alone = IdCache(spec).tokenizer
    assert all(found == alone.encode(w, add_special_tokens=False).ids for w, found in ids.items())
    want = {}
    for i, out, t in rows:
        for w in ["", *words[i]] if not out else []:
            want[w] = want.get(w, 0) + 1
    assert {r.word: r.c for r in lm_scoring.count_words(table).collect()} == want


def test_text_is_cut_once_and_dictionaries_do_not_change_the_scores(spark, monkeypatch):
    calls, numbered, words_of = [], lm_scoring.numbered, lm_scoring.words
    monkeypatch.setattr(lm_scoring, "numbered", lambda *a: calls.append(a) or numbered(*a))
    docs = spark.createDataFrame([(i, TEXTS[i % len(TEXTS)]) for i in range(30)], "doc_id bigint, text string").coalesce(1)

    def scores():
        rows = lm_scoring.score_texts(docs).orderBy("doc_id").collect()
        return [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in rows], np.array([(r.base_score, r.score) for r in rows])

    once = scores()
    assert len(calls) == 1 and words_of(" a B ") == [b"a", b"b"]
    for name, value in (("LEARNT", 20), ("ENTRIES", 7), ("GATHERED", 1), ("TOGETHER", 50), ("HELD", 60)):
        monkeypatch.setattr(lm_scoring, name, value)
    cut = scores()
    assert once[0] == cut[0] and np.abs(once[1] / cut[1] - 1).max() < 1e-4


def test_the_model_works_in_single_precision():
    p = attention.start(np.arange(1, 257))
    x = (np.arange(200) * 7 % 256).astype(np.uint8)
    h, weights, mixed, _ = attention.Scorer(p).attend(x.astype(np.intp), np.arange(195, dtype=np.int32))
    assert {a.dtype for a in (h, mixed, *weights)} == {np.dtype(np.float32)}


def test_large_logits_give_finite_scores():
    p = attention.start(np.arange(1, 257))
    p["group_bias"] = np.linspace(-150, 150, 16).astype(np.float32)
    p["class_bias"] = p["class_bias"] + np.linspace(-120, 120, 16).astype(np.float32)
    y = np.arange(256).astype(np.uint8)
    x, place = np.append(np.uint8(0), y[:-1]), np.arange(256, dtype=np.int32)
    logs = attention.Scorer(p).log_probs(x, y, place)
    assert np.isfinite(logs).all() and logs.min() < -300 and logs.max() <= 0
