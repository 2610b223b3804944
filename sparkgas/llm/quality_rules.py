"""Quality rules: a table of thresholds, compiled into one projection without user functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgas.llm.common import texts

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """``measure`` must lie within ``low`` and ``high``, both included; None leaves a side open."""

    measure: str
    low: float | None = None
    high: float | None = None


#: common words of the languages at hand, to tell running text from lists of names and numbers
STOP_WORDS = (
    "a an and are as at be but by for from has have he his i in is it its not of on or that the this to was were will with you "
    "aber als auch auf aus bei das dem den der des die ein eine einer es für ich im in ist mit nicht sich sie sind und von war wie zu zum zur "
    "al con de del el en es la las lo los no para pero por que se ser su sus un una y "
    "au aux avec ce ces dans de des du elle en est et il ils je la le les mais ne nous ou par pas pour qui sa se son sur un une vous"
)

RULES = (
    Rule("n_words", 50, 100_000),
    Rule("mean_word_chars", 2, 12),
    Rule("symbol_word_ratio", None, 0.1),
    Rule("repeat_word_ratio", None, 0.5),
    Rule("stop_words", 2, None),
    Rule("stop_word_ratio", 0.02, None),
    Rule("dup_line_ratio", None, 0.5),
    Rule("dup_line_char_ratio", None, 0.5),
    Rule("bullet_line_ratio", None, 0.9),
    Rule("ellipsis_line_ratio", None, 0.3),
    Rule("letter_word_ratio", 0.6, None),
    Rule("upper_char_ratio", None, 0.5),
    Rule("exclaimed_word_ratio", None, 0.3),
)


def passes(rules: tuple[Rule, ...]) -> Column:
    """All rules as one boolean expression; a measure without a value passes."""
    verdict = F.lit(True)
    for rule in rules:
        for bound, holds in ((rule.low, F.col(rule.measure) >= rule.low), (rule.high, F.col(rule.measure) <= rule.high)):
            if bound is not None:
                verdict = verdict & F.coalesce(holds, F.lit(True))
    return verdict


def failed(rules: tuple[Rule, ...]) -> Column:
    """Names of the measures out of bounds."""
    names = [F.when(~passes((rule,)), F.lit(rule.measure)) for rule in rules]
    return F.array_compact(F.array(*names))


def _with(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words in windows of three that are found twice or more.

    Windows are sorted with their places; equal ones are then neighbours, and
    the places of the repeated ones cover three words each, less their overlap.
    """
    n = F.size(words)
    windows = F.transform(
        F.sequence(F.lit(0), n - 3), lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    )

    def repeated(placed: Column) -> Column:
        own = lambda x, j: (F.get(placed, j - 1)["w"].eqNullSafe(x["w"])) | (F.get(placed, j + 1)["w"].eqNullSafe(x["w"]))
        return F.sort_array(F.transform(F.filter(placed, own), lambda x: x["i"]))

    def covered(windows: Column) -> Column:
        placed = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
        start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
        step = lambda s, i: F.struct((s["n"] + F.least(i - s["last"], F.lit(3))).alias("n"), i.alias("last"))
        total = F.aggregate(_with(placed, repeated), start, step, lambda s: s["n"])
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(total)

    return F.when(n < 4, F.lit(0)).otherwise(_with(windows, covered)).cast("bigint")


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measures that rules may name, one row per document."""
    split = texts(docs, id_col, text_col).select(
        "doc_id",
        "text",
        F.filter(F.split("text", SPACE), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda line: F.length(F.regexp_replace(line, SPACE, "")) > 0).alias("lines"),
    )
    text, words, lines = F.col("text"), F.col("words"), F.col("lines")
    gone = lambda pattern: F.length(F.regexp_replace(text, pattern, "")).cast("bigint")
    stop = F.array(*(F.lit(w) for w in dict.fromkeys(STOP_WORDS.split())))
    counted = split.select(
        "doc_id",
        F.size(words).cast("bigint").alias("n_words"),
        F.length(F.array_join(words, "")).cast("bigint").alias("word_chars"),
        gone(r"[^#*$%&|<>]+").alias("n_symbols"),
        F.size(lines).cast("bigint").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
        F.length(F.array_join(lines, "")).cast("bigint").alias("_line_chars"),
        F.length(F.array_join(F.array_distinct(lines), "")).cast("bigint").alias("_new_line_chars"),
        _repeat_words(words).alias("n_repeat_words"),
        F.size(F.array_intersect(F.transform(F.array_distinct(words), lambda w: F.lower(w)), stop)).cast("bigint").alias("stop_words"),
        (F.size(words) - F.size(F.filter(words, lambda w: ~F.lower(w).isin(STOP_WORDS.split())))).alias("_stop"),
        F.regexp_count(text, F.lit(r"\p{L}[^\x20\x09-\x0D]*+")).alias("_letter_words"),
        F.regexp_count(text, F.lit(r"[!?][\x20\x09-\x0D]")).alias("_exclaimed"),
        gone(r"[^\p{Lu}]+").alias("_upper"),
        F.size(F.filter(lines, lambda x: x.rlike(r"^[\x20\t]*[-*•]"))).alias("_bullets"),
        F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)[\x20\t]*$"))).alias("_ellipses"),
    )
    per = lambda a, b: (F.col(a) / F.nullif(F.col(b), F.lit(0))).cast("double")
    return counted.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "n_lines",
        "stop_words",
        per("word_chars", "n_words").alias("mean_word_chars"),
        per("n_symbols", "n_words").alias("symbol_word_ratio"),
        per("n_repeat_words", "n_words").alias("repeat_word_ratio"),
        per("_stop", "n_words").alias("stop_word_ratio"),
        per("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        (1 - per("_new_line_chars", "_line_chars")).alias("dup_line_char_ratio"),
        per("_bullets", "n_lines").alias("bullet_line_ratio"),
        per("_ellipses", "n_lines").alias("ellipsis_line_ratio"),
        per("_letter_words", "n_words").alias("letter_word_ratio"),
        per("_upper", "word_chars").alias("upper_char_ratio"),
        per("_exclaimed", "n_words").alias("exclaimed_word_ratio"),
    )


def apply_rules(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The measures of every document with ``passed`` and the names of the rules it fails.

    Null and empty texts have no words and no lines; their ratios are null and
    pass, their counts are 0 and are held against the rules.  Null ids stay,
    repeated rows are judged one by one, an empty table gives no rows, and other
    columns are ignored.  Nothing is exchanged.
    """
    return measures(docs, id_col, text_col).withColumns({"passed": passes(rules), "failed_rules": failed(rules)})
