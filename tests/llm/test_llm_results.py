"""Operators against brute force on small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkgas.llm import attention, decontaminate, lm_scoring, packing, pii, quality_classifier, quality_rules, simhash, tokens, url_filter
from sparkgas.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_file())


# ------------------------------------------------------------------- tokens and packing


def test_tokens_as_the_library_gives_them(library):
    spec = tokens.read_file(tokens.default_file())
    counter, cache = tokens.MergeCounter(spec), tokens.IdCache(spec)
    rnd = random.Random(1)
    signs = "aA%$_`bBcsStTrevmdl'' \n\t\x1c\x1d\xa0ΣσςİßÄé\u0301日本1234!!..<|>endoftext😀\u200d\x85ﬁ½²"
    samples = ["", "<|endoftext|>", "a<|endoftext|>b<|startoftext|>", "ΑΣ ΣΑΣ", "don't 's I'LL", "a" * 5000]
    samples += ["".join(rnd.choice(signs) for _ in range(rnd.randrange(60))) for _ in range(3000)]
    for text, ids in zip(samples, cache.batch(samples)):
        want = library.encode(text, add_special_tokens=False).ids
        assert counter.count(text) == len(want), text
        assert ids == np.asarray(want, "<u4").tobytes(), text


def test_token_counts(spark, documents, library):
    found = by_id(QUERIES["op3_token_counts"](spark, SF))
    assert all(found[i].n_tokens == len(library.encode(t, add_special_tokens=False).ids) for i, t in documents.items())
    assert all(found[i].n_bytes == len(t.encode()) for i, t in documents.items())


def test_caches_forget_but_stay_right(library, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 5)
    cache = tokens.IdCache(tokens.read_file(tokens.default_file()))
    words = [f"w{a}ord{b}" for a in "abcdef" for b in "xyz"]
    for _ in range(3):
        for w in words:
            assert cache.batch([w])[0] == np.asarray(library.encode(w, add_special_tokens=False).ids, "<u4").tobytes()
    assert len(cache.known) + len(cache.before) <= 20


def check_packing(rows, docs, limits, library):
    ids = {i: np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4") for i, t in docs.items()}
    at = Counter()
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == at[r.doc_id] and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        at[r.doc_id] += r.length
    assert at == {i: len(v) for i, v in ids.items()}
    used, segments, loss = Counter(), Counter(), Counter()
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used[r.sequence_id]
        used[r.sequence_id] += r.length
        segments[r.sequence_id] += 1
        loss[r.sequence_id] += r.loss_tokens
    assert max(used.values()) <= limits.tokens and max(segments.values()) <= limits.segments
    assert max(loss.values()) <= limits.loss_tokens
    return used


def test_packing(spark, documents, library):
    used = check_packing(QUERIES["op10_packing"](spark, SF).collect(), documents, packing.Limits(), library)
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in used.values())
    assert padding <= 0.01 * sum(used.values())


@pytest.mark.parametrize("limits", [packing.Limits(64, 3, 64, 8), packing.Limits(128, 50, 20, 16), packing.Limits(16, 1, 16, 4)])
def test_packing_under_tight_limits(spark, library, limits):
    rnd = random.Random(3)
    docs = {i: " ".join("abcdefgh"[rnd.randrange(8)] for _ in range(rnd.randrange(150))) for i in range(60)}
    rows = [(i, t, rnd.choice([None, 0, 5, 40, 500])) for i, t in docs.items()]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, prompt bigint").coalesce(2)
    found = packing.pack(df, limits, loss_from_col="prompt").collect()
    check_packing(found, docs, limits, library)
    first = {i: p or 0 for i, _, p in rows}
    for r in found:
        assert r.loss_tokens == max(0, r.start + r.length - max(r.start, first[r.doc_id]))


# ---------------------------------------------------------------------------- rules, PII


def test_quality_rules(spark, documents):
    found = by_id(QUERIES["op1_quality_rules"](spark, SF))
    for i, text in documents.items():
        words = re.findall("[^\x20\x09-\x0d]+", text)
        seen, dup = set(), 0
        for line in text.split("\n"):
            if line.strip(" \t\n\r\x0b\x0c"):
                dup += line in seen
                seen.add(line)
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        n = Counter(windows)
        covered = {k + j for k, w in enumerate(windows) if n[w] > 1 for j in range(3)}
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered))
        r = found[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    judged = [(labels[i], r.kept) for i, r in found.items() if i in labels and not r.base_failed]
    assert sum(q == k for q, k in judged) >= 0.95 * len(judged)


def test_rules_are_a_table(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "a # # #")], "doc_id bigint, text string")
    judged = by_id(quality_rules.apply_rules(df, (quality_rules.Rule("symbol_word_ratio", None, 0.5),)))
    assert judged[1].passed and not judged[2].passed and judged[2].failed_rules == ["symbol_word_ratio"]


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


KINDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15),
]


def test_pii_base_spans(spark):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("aZ.@@++-%_ 0123456789012345 ()-.\né😀") for _ in range(rnd.randrange(120))) for _ in range(2000)]
    texts += ["4111111111111111", "x 4111-1111-1111-1111.", "a@b.c%d@e.f", "256.1.1.1 001.02.3.4.5", "+1 (555) 123-4567", "1" * 900, "1." * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = by_id(pii.find_spans(df).select("doc_id", pii.listed(F.col("base")).alias("base"), pii.listed(F.col("spans")).alias("spans")))
    for i, text in enumerate(texts):
        want = [f"{k}:{m.start()}:{m.end()}" for k, p, ok in KINDS for m in re.finditer(p, text) if ok(m[0])]
        assert found[i].base == ",".join(want), text
        assert set(want) <= set(found[i].spans.split(",")) | {""}


def test_pii_context_checksums_and_redaction(spark):
    token = "0123456789abcdef0123456789abcdef01234567"
    rows = [
        (1, f'the token = "{token}" here'), (2, f'the commit "{token}" here'),
        (3, "pay to DE89 3704 0044 0532 0130 00 now"), (4, "pay to DE89 3704 0044 0532 0130 01 now"),
        (5, "call (826) 555-4081"), (6, "part (826) 555-4081"), (7, "mail é a.b@c.de!"), (8, None),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("spans", F.lit("kept"))
    found = by_id(pii.find_spans(df).select("doc_id", F.col("spans.kind").alias("kinds")))
    assert [found[i].kinds for i in range(1, 8)] == [["secret"], [], ["iban"], [], ["national_phone"], [], ["email"]]
    clean = by_id(pii.redact(df))
    assert clean[1].text == 'the token = "[SECRET]" here' and clean[2].text == rows[1][1]
    assert clean[7].text == "mail é [EMAIL]!" and clean[8].text is None and clean[7].spans == "kept"


# ------------------------------------------------------------- decontamination, simhash


def brute_hits(docs, items, size=10):
    find = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+").findall
    windows = {}
    for i, t in items.items():
        w = find(lower(t or ""))
        for k in range(max(1, len(w) - size + 1)) if w else ():
            windows.setdefault(tuple(w[k : k + size]), set()).add(str(i))
    out = {}
    for i, t in docs.items():
        w, hit, own = find(lower(t or "")), set(), set()
        for n in set(map(len, windows)):
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    own |= found
                    hit |= set(range(k, k + n))
        out[i] = (len(w), len(hit), sorted(own))
    return out


def test_decontamination(spark, documents):
    found = by_id(QUERIES["op4_decontamination"](spark, SF))
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    for i, (n, hit, own) in brute_hits(documents, items).items():
        digest = hashlib.sha256(",".join(own).encode()).hexdigest()
        assert tuple(found[i])[1:6] == (n, hit, len(own), digest, hit > 0)
    assert any(r.contaminated for r in found.values())


@pytest.mark.parametrize("patch", [{}, {"WINDOWS": 7}, {"VOCABULARY": 3}])
def test_decontamination_in_blocks_and_without_vocabulary(spark, monkeypatch, patch):
    for name, value in patch.items():
        monkeypatch.setattr(decontaminate, name, value)
    rnd = random.Random(2)
    text = lambda n: " ".join(rnd.choice("Ab cd e3 ÉF g".split()) for _ in range(n))
    items = {i: text(rnd.randrange(8)) for i in range(12)} | {99: "Ab"}
    docs = {i: text(rnd.randrange(60)) for i in range(80)}
    frames = [spark.createDataFrame(list(x.items()), s) for x, s in ((docs, "doc_id bigint, text string"), (items, "item_id bigint, text string"))]
    found = by_id(decontaminate.decontaminate(*frames, size=4))
    for i, (n, hit, own) in brute_hits(docs, items, 4).items():
        r = found[i]
        assert (r.n_words, sum(x.end - x.start for x in r.ranges), r.items) == (n, hit, own)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x beta gamma"), (2, "alpha x y z w beta gamma"), (3, "alpha beta gamma")], "doc_id bigint, text string")
    items = spark.createDataFrame([(5, "alpha beta gamma")], "item_id bigint, text string")
    found = by_id(decontaminate.decontaminate(docs, items, slop=2))
    assert [found[i].near_items for i in (1, 2, 3)] == [["5"], [], []] and found[3].items == ["5"]


def brute_components(fps):
    ids = sorted(fps)
    values = np.array([fps[i] for i in ids], np.uint64)
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(values[k + 1 :] ^ values[k]) <= 2):
            a, b = find(k), find(k + 1 + int(j))
            root[max(a, b)] = min(a, b)
    return {ids[k]: ids[find(k)] for k in range(len(ids))}


def test_simhash(spark, documents):
    import xxhash

    found = by_id(QUERIES["op9_simhash"](spark, SF))
    fps = {}
    for i, text in documents.items():
        words = re.findall("[^\x20\x09-\x0d]+", lower(text))
        shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        fps[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0
    assert {i: r.fingerprint for i, r in found.items()} == {i: format(f, "016x") for i, f in fps.items()}
    assert {i: r.component_id for i, r in found.items()} == brute_components(fps)


@pytest.mark.parametrize("bucket", [2, 16, 128])
def test_links_with_crowded_buckets(spark, monkeypatch, bucket):
    """Many fingerprints around a few centres: all links hold, whichever way a bucket takes."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rnd = random.Random(bucket)
    centres = [rnd.getrandbits(64) for _ in range(4)]
    fps = {rnd.choice(centres) ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(6))) for _ in range(500)}
    fps |= {rnd.getrandbits(64) for _ in range(200)}
    signed = {f - (1 << 64) if f >> 63 else f: f for f in fps}
    links = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp bigint")).collect()
    assert all((signed[r.src] ^ signed[r.dst]).bit_count() <= 2 for r in links)
    root = {s: s for s in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in links:
        root[find(r.src)] = find(r.dst)
    want = brute_components(signed)
    groups = lambda of: sorted(sorted(s for s in signed if of[s] == r) for r in set(of.values()))
    assert groups({s: find(s) for s in signed}) == groups(want)


def test_thresholds_have_the_sum_and_least_cost():
    costs = [[0, 5, 9], [0, 1, 100], [0, 2, 3]]
    import itertools

    for total in (-2, -1, 0, 1):
        want = min(
            (sum(c[t + 1] for c, t in zip(costs, ts)) for ts in itertools.product((-1, 0, 1), repeat=3) if sum(ts) == total)
        )
        cost, chosen = simhash.allocate(costs, total)
        assert cost == want and sum(chosen) == total


# ----------------------------------------------------------- classifier, URLs, scoring


def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    found = by_id(QUERIES["op5_quality_classifier"](spark, sf))
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 for i, r in found.items())
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(labels[i], r) for i, r in found.items() if i in labels and r.held_out]
    assert sum(q == r.predicted for q, r in held) >= 0.95 * len(held)
    good, bad = ([r.score for q, r in held if q == k] for k in (1, 0))
    assert sum((a > b) + (a == b) / 2 for a in good for b in bad) >= 0.97 * len(good) * len(bad)


def test_isotonic_pools():
    scores, chances = quality_classifier.pool(np.array([1.0, 2, 3, 4]), np.array([0.0, 3, 1, 4]), np.array([4.0, 4, 4, 4]))
    assert list(scores) == [1, 2.5, 4] and list(chances) == [0, 0.5, 1]


def test_fourier_features_approximate_the_kernel():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 5))
    kernel = quality_classifier.Kernel.drawn(np.zeros(5), np.ones(5), 2.0, 4000, 1)
    z = kernel.features(x)[:, :-1]
    exact = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / (2 * 2.0**2))
    assert np.abs(z @ z.T - exact).max() < 0.1


def test_url_filter(spark):
    found = by_id(QUERIES["op6_url_filter"](spark, SF), "page_id")
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    counts, followers, contexts = ([Counter(), Counter()] for _ in range(3))
    parsed = {}

    def grams(url):
        rest = re.sub("[^a-z0/.?&=#:%_+-]", "~", re.sub("[0-9]", "0", url.split("://", 1)[-1].lower()))
        z = f"^^^{rest}$"
        return [z[i - 3 : i + 1] for i in range(3, len(z))]

    for i, url in pages.items():
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
        host = lower(host)
        fits = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        rule = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
        parsed[i] = host, path, rule
        if rule and zlib.crc32(host.encode()) % url_filter.KEPT_OUT:
            for g in grams(url):
                for k in range(4):
                    counts[rule[0] == "block"][g[3 - k :]] += 1
    for c in (0, 1):
        for g, n in counts[c].items():
            followers[c][len(g), g[:-1]] += 1
            contexts[c][len(g), g[:-1]] += n

    def chance(c, g, k):
        if k < 0:
            return 1 / url_filter.ALPHABET
        s = g[3 - k :]
        n, t = contexts[c][len(s), s[:-1]], followers[c][len(s), s[:-1]]
        return (counts[c][s] + t * chance(c, g, k - 1)) / (n + t) if n else chance(c, g, k - 1)

    for i, url in pages.items():
        host, path, rule = parsed[i]
        r = found[i]
        assert (r.host, r.path, r.rule) == (host, path, rule and rule[1] + rule[2])
        assert rule is None or r.verdict == rule[0]
        ratios = [math.log10(chance(0, g, 3) / chance(1, g, 3)) for g in grams(url)]
        assert abs(r.score - sum(ratios) / len(ratios)) < 1e-9
    free = [(r.score, r.verdict) for r in found.values() if r.rule is None]
    allowed, blocked = ([s for s, v in free if v == k] for k in ("allow", "block"))
    assert not allowed or not blocked or min(allowed) > max(blocked)


def test_url_threshold():
    assert url_filter.best_threshold([]) == 0.0 and url_filter.best_threshold([(3, 5, 0)]) == 0.0
    low, high = url_filter.BINS // 2 - 10, url_filter.BINS // 2 + 10
    assert abs(url_filter.best_threshold([(low, 0, 9), (high, 4, 0)])) <= 1 / (url_filter.BINS / 4)


def test_odd_urls(spark):
    df = spark.createDataFrame([(1, None), (2, "no scheme"), (3, "http://A.COM"), (4, "x://a.com?u://b.net/"), (5, "://")], "page_id bigint, url string")
    found = by_id(url_filter.filter_urls(df, (url_filter.UrlRule("block", "com"),)), "page_id")
    assert [(found[i].host, found[i].path, found[i].rule) for i in range(1, 6)] == [
        ("", "", None), ("", "", None), ("a.com", "", None), ("a.com", "", None), ("", "", None)
    ]


def test_attention_gradients_and_windows(monkeypatch):
    rng = np.random.default_rng(0)
    p = {k: v.astype(float) + rng.normal(0, 0.1, v.shape) for k, v in attention.start(rng.integers(1, 100, 256)).items()}
    x, y, place = attention.sequences([rng.integers(0, 256, n).astype(np.uint8) for n in (5, 0, 20, 13)])
    loss, g = attention.gradients(p, x, y, place)
    for name in ("embed", "query", "value", "near", "hidden", "group", "own"):
        at = tuple(rng.integers(0, s) for s in p[name].shape)
        at = (int(x[3]), at[1]) if name == "embed" else at
        moved = []
        for d in (1e-5, -1e-5):
            q = {k: v.copy() for k, v in p.items()}
            q[name][at] += d
            moved.append(attention.gradients(q, x, y, place)[0])
        assert abs((moved[0] - moved[1]) / 2e-5 - g[name][at]) < 1e-3
    scorer = attention.Scorer({k: v.astype(np.float32) for k, v in p.items()})
    whole = scorer.log_probs(x, y, place)
    assert abs(-whole.mean() - loss) < 1e-4
    monkeypatch.setattr(attention, "WINDOW", 7)
    assert np.abs(scorer.log_probs(x, y, place) - whole).max() < 1e-4
    # a text's scores do not depend on its neighbours
    alone = scorer.log_probs(x[:6], y[:6], place[:6])
    assert np.abs(alone - whole[:6]).max() < 1e-4


@pytest.mark.parametrize("frequent", [200_000, 30])
def test_lm_base_scores(spark, documents, monkeypatch, frequent):
    monkeypatch.setattr(lm_scoring, "FREQUENT", frequent)
    monkeypatch.setattr(lm_scoring.frequent_words, "__defaults__", (frequent,))
    found = by_id(QUERIES["op7_lm_scoring"](spark, SF))
    words = {i: [*t.encode().lower().split(), b""] for i, t in documents.items()}
    counts = Counter()
    for i, ws in words.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update(ws)
    n, v = sum(counts.values()), len(counts)
    for i, ws in words.items():
        r = found[i]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(counts[w] > 0 for w in ws), n)
        assert abs(r.base_score - base) < 1e-6 * abs(base)
        assert r.score < 0 and math.isfinite(r.score)
