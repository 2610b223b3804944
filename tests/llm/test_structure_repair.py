"""Structure repair against exhaustive search and against dynamic programming over whole strings."""

import hashlib
import itertools
import random
import re
import time
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sparkgas.llm import structure_repair as sr
from sparkgas.llm.queries import QUERIES

GOAL = re.compile(r"(s?(ua)+)?\Z")


def every_repair(rows, most_inserts=2):
    """The best (cost, audit) over all edit sequences, by trying them."""
    best = None
    choices = [[(2, "D", "")] + ([] if f in (1, 2) else [(5 * (f == 3), "K", i), *((1 + 5 * (f == 3), "R", x) for x in "ua")]) for i, f in rows]
    inserts = [[(), *itertools.product("ua", repeat=1), *itertools.product("ua", repeat=2)]] * (len(rows) + 1)
    for edits in itertools.product(*choices):
        for more in itertools.product(*inserts):
            if sum(map(len, more)) > most_inserts:
                continue
            cost, audit, roles = 5 * sum(map(len, more)), "", ""
            for k in range(len(rows) + 1):
                audit, roles = audit + "I" * len(more[k]), roles + "".join(more[k])
                if k < len(rows):
                    cost, audit, roles = cost + edits[k][0], audit + edits[k][1], roles + edits[k][2]
            if GOAL.match(roles) and (best is None or (cost, audit) < best):
                best = cost, audit
    return best


def by_layers(rows):
    """The best (cost, audit), carried from row to row for every state."""

    def closed(best):
        for q in (0, 1, 3, 2):
            if q in best:
                to, found = (3 if q == 2 else 2), (best[q][0] + 5, best[q][1] + "I")
                best[to] = min(best.get(to, found), found)
        return best

    best = closed({0: (0, "")})
    for initial, fault in rows:
        after = defaultdict(list)
        for q, (cost, audit) in best.items():
            after[q].append((cost + 2, audit + "D"))
            if fault not in (1, 2):
                more = cost + 5 * (fault == 3)
                if (q, initial) in sr.NEXT:
                    after[sr.NEXT[q, initial]].append((more, audit + "K"))
                after[3 if q == 2 else 2].append((more + 1, audit + "R"))
        best = closed({q: min(found) for q, found in after.items()})
    return min(best[q] for q in (0, 3) if q in best)


def test_agenda_against_exhaustive_search():
    rng = random.Random(2)
    for n, times in ((0, 1), (1, 30), (2, 60), (3, 8)):
        for _ in range(times):
            rows = [(rng.choice("suax"), rng.choice([0, 0, 1, 2, 3])) for _ in range(n)]
            assert sr.lightest(rows) == every_repair(rows), rows


def test_agenda_against_layers():
    rng = random.Random(3)
    for _ in range(4000):
        rows = [(rng.choice(["s", "u", "a", "x", ""]), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randint(0, 14))]
        assert sr.lightest(rows) == by_layers(rows), rows
    rows = [(rng.choice("sua"), rng.choice([0, 0, 3])) for _ in range(500)]
    assert sr.lightest(rows) == by_layers(rows)


def test_long_conversations_take_near_linear_time():
    rows = [("u", 0), ("u", 3), ("a", 0), ("s", 0), ("a", 1)] * 10_000
    start = time.time()
    cost, audit = sr.lightest(rows)
    assert time.time() - start < 30 and len(audit) >= len(rows) and cost > 0


def test_audits_compare_like_strings():
    rng, audits = random.Random(5), sr.Audits()
    made = []
    for _ in range(300):
        at, text = rng.choice(made) if made and rng.random() < 0.7 else (0, "")
        for letter in rng.choices("DIKR", k=rng.randint(0, 9)):
            at, text = audits.longer(at, letter), text + letter
        made.append((at, text))
        assert audits.text(at) == text
    for a, x in made:
        for b, y in rng.sample(made, 40):
            assert audits.less(a, b) == (x < y)


def brute(rows):
    """All columns of the query, in Python."""
    space = lambda v: " " if v is None else str(v)
    out, convs = [], defaultdict(list)
    for c, turn, role, text in rows:
        how = zlib.crc32(f"{space(c)}:{space(turn)}".encode()) % 20
        role, text, own = space(role), space(text), convs[c]
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        own += [(turn is not None, turn or 0, "user" if how == 4 else role, text)] * (0 if how == 0 else 2 if how == 3 else 1)
    for c, own in convs.items():
        own.sort()
        turns = {t for known, t, _, _ in own if known}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        faults, seen = [], set()
        for _, _, role, text in own:
            marks = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append(1 if not marks else 2 if (role, text) in seen else 0 if marks[-1] in ".!?" else 3)
            seen.add((role, text))
        initials = [r[:1] for _, _, r, _ in own]
        cost, audit = by_layers(list(zip(initials, faults)))
        lines, at, last = [], 0, ""
        for letter in audit:
            role, text = ("", "") if letter == "I" else own[at][2:]
            at += letter != "I"
            if letter != "D":
                role = role if letter == "K" else "assistant" if last == "u" else "user"
                last = role[:1]
                lines.append(f"{role}:{text}")
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((c, gaps, *(faults.count(k) for k in (1, 2, 3)), illegal, cost, audit, digest))
    return sorted(out, key=str)


def odd_rows():
    rng = random.Random(8)
    texts = ["Yes.", "No!", "what", "", None, " \n", "end. ", "a?\t", "x\x1f"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", None, ""]), rng.choice(texts)) for c in range(60) for t in range(rng.randint(1, 9))]
    rows += [(70, None, "user", "a."), (70, None, "user", "a."), (70, 4, "assistant", "b."), (70, 9, "assistant", "b.")]
    rows += [(None, 1, "user", "nobody."), (None, None, "assistant", "yes.")] + [(71, t, "user", "long.") for t in range(300)]
    return rows + [(c, 0, "user", "one.") for c in range(100, 180)]  # some of them lose their only row


@pytest.mark.parametrize("source", ["odd", "table"])
def test_query_against_brute_force(spark, tmp_path, source):
    path = "/root/testdata/sf0.01"
    if source == "odd":
        path = str(tmp_path)
        chats = spark.createDataFrame(odd_rows(), "conv_id bigint, turn bigint, role string, text string").repartition(3)
        chats.withColumns({c: F.lit("clash") for c in ("t", "how", "kept", "copy", "gaps", "roles")}).write.parquet(f"{path}/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{path}/conversations.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op13_structure_repair"](spark, path).collect()), key=str) == brute(rows)


def test_empty_table_and_plain_repair(spark):
    schema = "conv_id bigint, turn bigint, role string, text string"
    assert sr.repair(spark.createDataFrame([], schema)).collect() == []
    chats = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 2, "tool", "Well."), (1, 3, "user", "")], schema)
    row = sr.repair(chats).first()
    assert (row.gaps, row.blank, row.cost, row.audit) == (1, 1, 3, "KRD")
    assert row.roles == ["user", "assistant"] and row.texts == ["Hi.", "Well."]
