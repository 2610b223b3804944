"""The scorer's model learns from all training text."""

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from sparkgas.llm import attention, lm_scoring
from sparkgas.llm.tokens import IdCache, default_file, read_file


def test_blocks_give_the_gradient_of_the_whole_text():
    rng = np.random.default_rng(1)
    p = {k: v.astype(float) + rng.normal(0, 0.1, v.shape) for k, v in attention.start(rng.integers(1, 100, 256)).items()}
    texts = [rng.integers(0, 256, n).astype(np.uint8) for n in (45, 0, 16, 3)]
    parts = []
    for t in texts:
        for own in range(0, len(t) or 1, 8):
            first = max(0, own - attention.CONTEXT)
            parts.append((t[first : own + 8], first, own - first, own + 8 >= len(t)))
    loss, g = attention.gradients(p, *attention.sequences(texts))
    got, of_blocks = attention.gradients(p, *attention.sequences_of_blocks(parts[::-1]))
    assert abs(loss - got) < 1e-9
    for name in g:
        assert np.abs(g[name] - of_blocks[name]).max() < 1e-9, name


def test_blocks_hold_every_id_and_end_once(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "BLOCK", 16)
    spec = read_file(default_file())
    vocabulary = lm_scoring._vocabulary_size(spec)
    texts = ["", "One two", "the cat sat on the mat and saw a dog " * 30, "x" * 3000, "only far behind " + "a b " * 500 + "zebra"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(2)
    found = lm_scoring.blocks(df, spec, vocabulary)
    want = Counter()
    for ids in IdCache(spec).batch([t.lower() for t in texts]):
        want.update(np.frombuffer(ids, "<u4").tolist())
    seen, ends = lm_scoring.id_counts(found, vocabulary)
    assert ends == len(texts) and {i: n for i, n in enumerate(seen.tolist()) if n} == dict(want)
    assert found.count() > 100 and found.where("length(ids) > 2 * 16 + 2 * 6").count() == 0


def test_training_counts_every_token(spark, monkeypatch):
    counted = []
    step = attention.Trainer.step
    monkeypatch.setattr(attention.Trainer, "step", lambda self, x, y, place, c: (counted.append(int(c.sum())), step(self, x, y, place, c))[1])
    spec = read_file(default_file())
    vocabulary = lm_scoring._vocabulary_size(spec)
    text = "the cat sat on the mat and saw a dog " * 300
    found = lm_scoring.blocks(spark.createDataFrame([(text,), ("ok",)], "text string"), spec, vocabulary)
    seen, ends = lm_scoring.id_counts(found, vocabulary)
    lm_scoring.train(found, lm_scoring.Classes(seen), ends)  # the warm-up runs here, three times over
    assert sum(counted) == 3 * (int(seen.sum()) + ends)


def test_the_warm_up_is_bounded_and_spread(spark):
    rows = spark.range(0, 30_000, 1, 12).select(
        F.col("id").alias("at"), F.lit(0).alias("context"), F.lit(False).alias("last"), F.lit("same").cast("binary").alias("ids")
    )
    some = lm_scoring.settling(rows, most=500)
    assert 350 <= len(some) <= 700 and some == lm_scoring.settling(rows, most=500)
    assert {b[0] // 5000 for b in some} == set(range(6))
    assert len(lm_scoring.settling(rows.limit(40), most=500)) == 40


def plain_log_prob(p, stream, t) -> float:
    """Natural logarithm of the chance of class ``stream[t]``, from the classes before it, one sum after the other."""
    before = [0, *stream[:t]]
    query = p["embed"][before[t]] @ p["query"]
    weights, values = [], []
    for r in range(min(attention.CONTEXT, t + 1)):
        seen = p["embed"][before[t - r]]
        match = np.clip(query @ (seen @ p["key"]) / np.sqrt(attention.WIDTH), -15, 15)
        weights.append(np.exp(match) * np.exp(np.clip(p["near"][r], -10, 10)))
        values.append(seen @ p["value"])
    mixed = sum(w * v for w, v in zip(weights, values)) / sum(weights)
    h = np.maximum(p["embed"][before[t]] @ p["own"] + p["hidden"] + mixed, 0)
    group, inner = divmod(stream[t], attention.GROUP)
    logits, within = h @ p["group"] + p["group_bias"], h @ p["class"][group] + p["class_bias"][group]
    return float(logits[group] - np.log(np.exp(logits).sum()) + within[inner] - np.log(np.exp(within).sum()))


def test_scores_against_brute_force(spark, monkeypatch):
    """All of it again in plain Python, but for the fit itself, whose parameters are taken from the operator."""
    found = {}
    train = lm_scoring.train
    monkeypatch.setattr(lm_scoring, "train", lambda *a: found.setdefault("p", train(*a)))
    texts = ["the cat sat on the mat and saw a dog", "A DOG saw Ünïcode words", None, "", "new zebra words here " * 9, "the cat " * 40]
    rows = [(i, texts[i % len(texts)]) for i in range(60)]
    got = {r.doc_id: r for r in lm_scoring.score_texts(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()}
    split = {i: lm_scoring.words(t or "") for i, t in rows}
    out = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in split}
    counts = Counter(w for i, ws in split.items() if not out[i] for w in [*ws, b""])
    n, v = sum(counts.values()), len(counts)
    cache = IdCache(read_file(default_file()))
    ids = {w: np.frombuffer(cache.batch([w.decode()])[0], "<u4").tolist() for ws in split.values() for w in ws}
    seen = np.zeros(lm_scoring._vocabulary_size(read_file(default_file())), np.int64)
    for i, ws in split.items():
        for w in ws if not out[i] else ():
            np.add.at(seen, ids[w], 1)
    classes, p = lm_scoring.Classes(seen), found["p"]
    for i, ws in split.items():
        stream, ends = [], []
        for w in ws:
            stream += [int(classes.of[k]) for k in ids[w]]
            ends.append(len(stream))
        stream.append(0)
        logs = [plain_log_prob(p, stream, t) for t in range(len(stream))]
        base = score = 0.0
        for w, a, b in zip([*ws, b""], [0, *ends], [*ends, len(stream)]):
            chance = (counts[w] + 0.5) / (n + 0.5 * (v + 1))
            model = np.exp(sum(logs[a:b]) + sum(classes.log_share[k] for k in ids.get(w, ())))
            base, score = base + np.log10(chance), score + np.log10(lm_scoring.MIX * chance + (1 - lm_scoring.MIX) * model)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (out[i], len(ws) + 1, n)
        assert r.n_known == sum(counts[w] > 0 for w in [*ws, b""])
        assert abs(r.base_score - base) < 1e-9 * abs(base) + 1e-9 and abs(r.score - score) < 1e-3 * abs(score) + 1e-4, (i, r.score, score)


def test_held_out_texts_score_above_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = lm_scoring.score_texts(docs).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert held.s > held.b
