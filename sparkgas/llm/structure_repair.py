"""Conversation structure repair by lightest derivations.

A conversation's rows are to spell a conversation: perhaps a system turn, then
user and assistant turns in pairs.  A repair is a derivation: a *prefix* item says
that the first rows are edited and which turn is expected, and a deduction joins it
with one edit of the next row, or with an inserted turn, to a longer prefix.  Its
weight is the pair of cost and audit, the letters of the edits.  Costs add up and
audits are joined, neither gets smaller, so an agenda that pops the lightest item
finalises it (Knuth 1977); the first goal popped is the cheapest repair, and of
those the one with the least audit.

Audits are nodes of a tree of letters: a longer one shares its beginning, and two
are compared through jumps towards where they part, so that a conversation of n
rows takes about n log n steps.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkgas.llm.common import bounded_batches

SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
START, SYSTEM, USER, ASSISTANT = range(4)  # what a prefix ends in
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
WHOLE = (START, ASSISTANT)
ROLE = {USER: "user", ASSISTANT: "assistant"}
REROLE, DELETE, INSERT, OPEN_END = 1, 2, 5, 5  # costs; keeping is free
REMEMBERED, SHORT = 100_000, 256  # repairs that a task remembers, of conversations up to so many rows
WHITE = " \t\n\v\f\r"


class Audits:
    """Strings of edit letters as nodes of a tree, each made once; node 0 is the empty one."""

    def __init__(self):
        self.above, self.letter, self.length, self.jump, self.known = [0], [""], [0], [0], {}

    def longer(self, at: int, letter: str) -> int:
        found = self.known.get((at, letter))
        if found is None:
            found = self.known[at, letter] = len(self.above)
            far = self.jump[at]
            same = self.length[at] - self.length[far] == self.length[far] - self.length[self.jump[far]]
            self.jump.append(self.jump[far] if same else at)
            self.above.append(at)
            self.letter.append(letter)
            self.length.append(self.length[at] + 1)
        return found

    def _head(self, at: int, length: int) -> int:
        while self.length[at] > length:
            far = self.jump[at]
            at = far if self.length[far] >= length else self.above[at]
        return at

    def less(self, a: int, b: int) -> bool:
        """Whether string ``a`` comes before string ``b``."""
        if a == b:
            return False
        shorter = min(self.length[a], self.length[b])
        x, y = self._head(a, shorter), self._head(b, shorter)
        if x == y:
            return self.length[a] < self.length[b]
        while self.above[x] != self.above[y]:
            far = self.jump[x] != self.jump[y]
            x, y = (self.jump[x], self.jump[y]) if far else (self.above[x], self.above[y])
        return self.letter[x] < self.letter[y]

    def text(self, at: int) -> str:
        out = []
        while at:
            out.append(self.letter[at])
            at = self.above[at]
        return "".join(reversed(out))


class _Weight:
    """A place on the agenda, ordered by cost, then audit."""

    __slots__ = ("audit", "audits", "cost", "item")

    def __init__(self, cost: int, audit: int, item: tuple[int, int], audits: Audits):
        self.cost, self.audit, self.item, self.audits = cost, audit, item, audits

    def __lt__(self, other: _Weight) -> bool:
        return self.cost < other.cost or self.cost == other.cost and self.audits.less(self.audit, other.audit)


def deductions(rows: list[tuple[str, int]], item: tuple[int, int]) -> Iterator[tuple[int, str, tuple[int, int]]]:
    """``(cost, letter, conclusion)`` of every deduction that starts from a prefix item."""
    n, state = item
    if n < len(rows):
        initial, fault = rows[n]
        yield DELETE, "D", (n + 1, state)
        if fault not in (BLANK, DUPLICATE):
            more = OPEN_END if fault == TRUNCATED else 0
            if (state, initial) in NEXT:
                yield more, "K", (n + 1, NEXT[state, initial])
            yield REROLE + more, "R", (n + 1, ASSISTANT if state == USER else USER)
    yield INSERT, "I", (n, ASSISTANT if state == USER else USER)


def lightest(rows: list[tuple[str, int]]) -> tuple[int, str]:
    """``(cost, audit)`` of the cheapest repair of rows given by their role's initial and their fault."""
    from heapq import heappop, heappush

    audits, final = Audits(), set()
    agenda, best = [_Weight(0, 0, (0, START), audits)], {(0, START): (0, 0)}
    while True:
        now = heappop(agenda)
        if now.item in final:
            continue
        final.add(now.item)
        n, state = now.item
        if n == len(rows) and state in WHOLE:
            return now.cost, audits.text(now.audit)
        for cost, letter, item in deductions(rows, now.item):
            if item in final:
                continue
            cost, audit = now.cost + cost, audits.longer(now.audit, letter)
            before = best.get(item)
            if before is None or cost < before[0] or cost == before[0] and audits.less(audit, before[1]):
                best[item] = cost, audit
                heappush(agenda, _Weight(cost, audit, item, audits))


def faults(roles: list[str], texts: list[str]) -> list[int]:
    """The first fault of each row: blank, seen before in role and text, or without an end mark."""
    seen, out = set(), []
    for role, text in zip(roles, texts):
        end = text.rstrip(WHITE)[-1:]
        if not end:
            out.append(BLANK)
        elif (role, text) in seen:
            out.append(DUPLICATE)
        else:
            out.append(SOUND if end in ".!?" else TRUNCATED)
        seen.add((role, text))
    return out


def repaired(roles: list[str], texts: list[str], audit: str) -> Iterator[tuple[str, str]]:
    """The ``(role, text)`` rows that an audit leaves."""
    rows, state = zip(roles, texts), START
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(rows)
        if letter == "D":
            continue
        state = NEXT[state, role[:1]] if letter == "K" else ASSISTANT if state == USER else USER
        yield role if letter == "K" else ROLE[state], text


REPAIRS = (
    "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, "
    "audit string, roles array<string>, texts array<string>"
)


def gathered(chats: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv_id, gaps, roles, texts)``, one row per conversation, its rows by turn, null first, then by role and text.

    ``gaps`` are the turns missing between the first and the last one.  A null
    role or text is a space.  Rows whose ``kept`` column is false only say that
    their conversation is there.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kept = F.col("kept") if "kept" in chats.columns else F.lit(True)
    turn = F.col(turn_col)
    rows = chats.select(
        F.col(id_col).cast("bigint").alias("conv_id"),
        F.when(kept, F.struct(turn.isNotNull().alias("known"), turn.alias("turn"), space(role_col).alias("role"), space(text_col).alias("text"))).alias("t"),
    )
    span = F.max("t.turn") - F.min("t.turn") + 1 - F.count_distinct("t.turn")
    turns = rows.groupBy("conv_id").agg(F.coalesce(span, F.lit(0)).cast("bigint").alias("gaps"), F.array_sort(F.collect_list("t")).alias("t"))
    return turns.select("conv_id", "gaps", F.col("t.role").alias("roles"), F.col("t.text").alias("texts"))


def repair(chats: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: its faults, the cheapest repair and its rows after it.

    ``blank``, ``duplicate`` and ``truncated`` count rows by their first fault,
    ``illegal`` the neighbours whose roles do not follow each other, ``gaps`` the
    missing turns.  ``audit`` has a letter for each edit: K keeps a row, R gives it
    the role due (cost 1), D deletes it (2; required for blank and repeated rows), I
    inserts an empty turn (5); a truncated row that stays costs 5 more.  ``roles`` and
    ``texts`` are the repaired conversation.

    A null role or text is a space; rows of one turn are ordered by role and text,
    so repeated rows are neighbours; a null id is a conversation of its own; an
    empty table gives no rows; other columns are ignored.  A conversation is one
    row, brought together once; conversations with the same roles and faults are
    worked out once for each task.
    """
    bounded_batches(chats.sparkSession)

    def mend(batches):
        import pyarrow as pa

        names = [f.split()[0] for f in REPAIRS.split(", ")]
        types = [pa.int64()] * 7 + [pa.string(), pa.list_(pa.string()), pa.list_(pa.string())]
        known: dict = {}
        for batch in batches:
            out = []
            for conv_id, gaps, roles, texts in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "gaps", "roles", "texts"))):
                own = faults(roles, texts)
                initials = [r[:1] for r in roles]
                # a repair depends on the order of initials and faults alone
                shape = (tuple(i if i in ("s", "u", "a") else "" for i in initials), bytes(own))
                if (found := known.get(shape)) is None:
                    found = lightest(list(zip(initials, own)))
                    if len(own) <= SHORT:
                        if len(known) >= REMEMBERED:
                            known = {}
                        known[shape] = found
                illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
                counts = (own.count(BLANK), own.count(DUPLICATE), own.count(TRUNCATED), illegal)
                rows = list(repaired(roles, texts, found[1]))
                out.append((conv_id, gaps, *counts, *found, [r for r, _ in rows], [t for _, t in rows]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return gathered(chats, id_col, turn_col, role_col, text_col).mapInArrow(mend, REPAIRS)


def damage(chats: DataFrame) -> DataFrame:
    """Conversation rows damaged by ``crc32("conv_id:turn") % 20``, in place; nulls are one space.

    0 drops a row (``kept`` is false), 1 empties its text, 2 takes out its end
    marks, 3 repeats it beside itself, 4 makes it the user's.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20).cast("int")
    rows = chats.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), how.alias("how"))
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("how") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("how") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("how") != 0).alias("kept"), copies.alias("copy")).drop("copy")
