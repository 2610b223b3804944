"""One query per operator over its whole tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgas.llm import (
    chat_format,
    decontaminate,
    fingerprints,
    lm_scoring,
    packing,
    pii,
    prefix_trie,
    quality_classifier,
    quality_rules,
    simhash,
    structure_repair,
    token_counts,
    url_filter,
)
from sparkgas.llm.common import table
from sparkgas.llm.sql import PREFIX_TRIE, QUALITY_RULES, STRUCTURE_REPAIR
from sparkgas.plans.cluster import cut

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op3_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


@query
def op4_decontamination(spark, sf_dir):
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("ranges", F.lit(0).cast("bigint"), lambda n, r: n + r["end"] - r["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        F.size("near_items").cast("bigint").alias("n_near_items"),
    )


@query
def op9_simhash(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op1_quality_rules(spark, sf_dir):
    judged = quality_rules.apply_rules(table(spark, sf_dir, "documents"))
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    base = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select(*base, base_failed.alias("base_failed"), (~base_failed & F.col("passed")).alias("kept"))


@query
def op8_pii(spark, sf_dir):
    found = pii.find_spans(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *(count(kind.name) for kind in pii.BASE),
        F.sha2(pii.listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        pii.listed(F.col("spans")).alias("spans"),
    )


@query
def op2_chat_format(spark, sf_dir):
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = F.lit(r"\### Assistant: </turn> ok")
    more = spark.range(1).select(F.posexplode(F.array(F.lit("user"), F.lit("assistant"))).alias("turn", "role")).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", hard.alias("text")
    )
    formatted = chat_format.format_chats(chats.unionByName(more))
    turns = chat_format.parse(F.col("formatted"))
    read = F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    texts = formatted.select(
        "conv_id",
        "round_trip",
        F.array_join(read, "").alias("turns"),
        F.size(turns).cast("bigint").alias("n_turns"),
        chat_format.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
    return texts.select(
        "conv_id",
        "n_turns",
        F.sha2(F.col("turns").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
        "round_trip",
    )


ORACLES["op2_chat_format"] = r"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, t, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)
), shown AS (
    SELECT *, regexp_replace(text, '(\\*)(###|</turn>)', '\\\1\2', 'g') AS hard FROM rows
), chats AS (
    SELECT conv_id, count(*) AS n_turns,
        string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
        coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
        sum(length(role) + length(hard) + 15) AS formatted_chars
    FROM shown GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars,
    sha256(loss) AS loss_sha256, formatted_chars::BIGINT AS formatted_chars, true AS round_trip
FROM chats
"""


URL_RULES = (
    url_filter.UrlRule("allow", "com"),
    url_filter.UrlRule("block", "example.com", "/en/"),
    url_filter.UrlRule("allow", "www.example.com", "/en/"),
    url_filter.UrlRule("block", "net", "/es/"),
    url_filter.UrlRule("block", "net", "/fr/"),
)


@query
def op6_url_filter(spark, sf_dir):
    judged = url_filter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "score")


@query
def op5_quality_classifier(spark, sf_dir):
    scored = quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query
def op7_lm_scoring(spark, sf_dir):
    return lm_scoring.score_texts(table(spark, sf_dir, "documents"))


@query
def op10_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op11_fingerprints(spark, sf_dir):
    return fingerprints.with_edits(table(spark, sf_dir, "documents"))


@query
def op12_prefix_trie(spark, sf_dir):
    encoded = cut(prefix_trie.encode(table(spark, sf_dir, "conversations")))
    return prefix_trie.prefix_trie(prefix_trie.share_heads(encoded))


@query
def op13_structure_repair(spark, sf_dir):
    damaged = structure_repair.damage(table(spark, sf_dir, "conversations"))
    lines = F.array_join(F.transform(F.arrays_zip("roles", "texts"), lambda t: F.concat_ws(":", t["roles"], t["texts"])), "\n")
    found = structure_repair.repair(damaged)
    return found.select(*found.columns[:8], F.sha2(lines.cast("binary"), 256).alias("repaired_sha256"))


ORACLES["op1_quality_rules"] = QUALITY_RULES
ORACLES["op12_prefix_trie"] = PREFIX_TRIE
ORACLES["op13_structure_repair"] = STRUCTURE_REPAIR
