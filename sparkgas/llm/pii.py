"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust their score.

All of it is column expressions.  Patterns use possessive repeats where giving
back could not help, so that long runs take linear time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgas.llm.common import chunked, let, part_of, scan, texts

SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"
AROUND = 48  # code points before a span that are searched for context words
LOCAL = r"[A-Za-z0-9._%+-]"


def _true(_: Column) -> Column:
    return F.lit(True)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the last digit is the right check digit; every second digit from the right counts double."""

    def weight(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        doubled = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 1, doubled).otherwise(d)

    places = F.sequence(F.lit(0), F.length(digits) - 1)
    return F.aggregate(places, F.lit(0), lambda total, i: total + weight(i)) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number, its first four characters moved to the end and letters read as 10 to 35, leaves 1."""
    plain = F.regexp_replace(account, " ", "")
    moved = F.concat(F.substring(plain, F.lit(5), F.length(plain) - 4), F.substring(plain, 1, 4))

    def step(rest: Column, i: Column) -> Column:
        code = F.ascii(F.substring(moved, i, F.lit(1)))
        return F.when(code < 58, rest * 10 + code - 48).otherwise(rest * 100 + code - 55) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), step) == 1


@dataclass(frozen=True)
class Kind:
    """A kind of span: its pattern, a cheap test that a text may have one, a check, and how it is scored.

    A span starts with ``score``; it gains ``context`` if one of ``words`` stands
    shortly before it, and is reported from ``least`` on.
    """

    name: str
    pattern: str
    may: str
    check: Callable[[Column], Column] = _true
    score: float = 0.9
    words: str = ""
    context: float = 0.1
    least: float = 0.5


BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
BASE = (
    Kind(
        "email",
        rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        "@",
        words="mail|contact|write|kontakt|correo|courriel",
    ),
    Kind(
        "ip",
        r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
        r"[0-9]\.[0-9]++\.[0-9]",
        lambda m: m.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$"),
        words="ip|host|server|address|adresse|from",
    ),
    Kind(
        "card",
        r"[0-9](?:[\x20-]?[0-9])++",
        r"[0-9](?:[\x20-]?[0-9]){15}",
        lambda m: F.length(_digits(m)).between(16, 19) & luhn(_digits(m)),
        words="card|visa|credit|karte|tarjeta|carte|pay",
    ),
    Kind(
        "phone",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        r"\+[0-9]",
        lambda m: F.length(_digits(m)).between(8, 15),
        words="phone|tel|call|fax|mobile|anruf|llama|appel",
    ),
)
MORE = (
    Kind(
        "iban",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
        r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}",
        lambda m: F.length(F.regexp_replace(m, " ", "")).between(15, 34) & mod97(m),
        words="iban|account|konto|cuenta|compte",
    ),
    Kind(
        "secret",
        r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}+",
        r"[A-Za-z0-9+/_-]{24}",
        lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]"),
        score=0.3,
        words="key|token|secret|password|passwd|credential|bearer",
        context=0.4,
    ),
    Kind(
        "national_phone",
        r"(?<![0-9+)][\x20-]?)(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![0-9-])",
        r"[0-9]{3}[-.][0-9]{4}",
        score=0.3,
        words="phone|tel|call|fax|mobile|anruf|llama|appel",
        context=0.4,
    ),
)


def _placed(text: Column, kind: Kind) -> Column:
    """``(start, match, before)`` of all matches from left to right: what lies between them tells where they are.

    ``before`` are the ``AROUND`` code points before a match, put together from the
    ends of the pieces before it, so that nothing is looked up from the text's start.
    """
    matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    between = F.split(text, kind.pattern, -1)
    pairs = F.zip_with(matches, F.slice(between, F.lit(1), F.size(matches)), lambda m, b: F.struct(m.alias("match"), b.alias("between")))

    def of(pairs: Column) -> Column:
        ends = F.transform(
            pairs, lambda p, i: F.right(F.concat(F.coalesce(F.get(pairs, i - 1)["match"], F.lit("")), p["between"]), F.lit(AROUND))
        )
        # every piece but the first has a match, and so at least one code point
        before = lambda ends, i: F.right(F.array_join(F.slice(ends, F.greatest(i - AROUND, F.lit(0)) + 1, F.least(i + 1, F.lit(AROUND + 1))), ""), F.lit(AROUND))
        starts = scan(F.transform(pairs, lambda p: F.length(p["between"]) + F.length(p["match"])))
        placed = lambda starts, ends: F.transform(
            pairs,
            lambda p, i: F.struct(
                (F.get(starts, i) + F.length(p["between"])).cast("int").alias("start"), p["match"].alias("match"), before(ends, i).alias("before")
            ),
        )
        return let(starts, lambda starts: let(ends, lambda ends: placed(starts, ends)))

    return let(pairs, of)


def _spans(kind: Kind) -> Column:
    """Checked and scored spans of one kind in ``text``; texts that cannot have one are passed over."""
    text = F.col("text")

    def scored(x: Column) -> Column:
        near = F.regexp_like(x["before"], F.lit(rf"(?i)(?<![a-z])(?:{kind.words})")) if kind.words else F.lit(False)
        score = F.lit(kind.score) + F.when(near, kind.context).otherwise(0.0)
        return F.struct(
            F.lit(kind.name).alias("kind"), x["start"].alias("start"), (x["start"] + F.length(x["match"])).alias("end"), score.alias("score")
        )

    confirmed = F.filter(_placed(text, kind), lambda x: kind.check(x["match"]))
    found = F.filter(F.transform(confirmed, scored), lambda s: s["score"] >= kind.least)
    may = F.contains(text, F.lit(kind.may)) if kind.may == "@" else text.rlike(kind.may)
    return F.when(may, found).otherwise(F.array().cast(SPANS)).cast(SPANS)


def find_spans(
    docs: DataFrame, base: tuple[Kind, ...] = BASE, more: tuple[Kind, ...] = MORE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, text, base, spans)``: spans of the base kinds, and of all kinds, in the order of kinds and starts.

    Places count code points from 0, ends are exclusive.  Spans of one kind do
    not overlap; those of different kinds may.  Null and empty texts have none;
    null ids stay; repeated rows are searched one by one; an empty table gives no
    rows; other columns are ignored.  Nothing is exchanged.
    """
    kinds = (*base, *more)
    found = texts(docs, id_col, text_col).select("doc_id", "text", *(_spans(k).alias(f"_{k.name}") for k in kinds))
    return found.select(
        "doc_id",
        "text",
        F.concat(*(F.col(f"_{k.name}") for k in base)).alias("base"),
        F.concat(*(F.col(f"_{k.name}") for k in kinds)).alias("spans"),
    )


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; overlapping spans by that of the first."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), s["kind"].alias("kind"))))

    def clean(ordered: Column) -> Column:
        # how far the spans before each one reach, and all of them
        reach = scan(F.concat(F.transform(ordered, lambda s: -s["end"]), F.array(F.lit(0))), F.greatest)

        def shown(reach: Column, chunks: Column) -> Column:
            own = lambda s, i: F.when(
                s["start"] >= F.get(reach, i), F.concat(part_of(chunks, F.get(reach, i), s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
            ).otherwise("")
            last = part_of(chunks, F.element_at(reach, -1), F.length(text))
            return F.concat(F.array_join(F.transform(ordered, own), ""), last)

        return let(reach, lambda reach: let(chunked(text), lambda chunks: shown(reach, chunks)))

    return F.when(F.size(spans) == 0, text).otherwise(let(ordered, clean))


def redact(docs: DataFrame, kinds: tuple[Kind, ...] = (*BASE, *MORE), text_col: str = "text") -> DataFrame:
    """``docs`` with all spans in its text replaced; other columns, null texts and the order of columns stay."""
    own = docs.select(F.struct("*").alias("_doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = own.select("_doc", "text", F.concat(*(_spans(k) for k in kinds)).alias("spans"))
    clean = found.select("_doc", redacted(F.col("text"), F.col("spans")).alias("clean"))
    shown = {c: F.col("_doc")[c] for c in docs.columns}
    shown[text_col] = F.when(shown[text_col].isNotNull(), F.col("clean"))
    return clean.select(*(v.alias(c) for c, v in shown.items()))
