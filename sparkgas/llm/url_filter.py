"""URL filter: rules by host and path, and for the rest a ratio of two character language models.

URLs that a rule allows and those that a rule blocks train one variable-order
Markov model each, with contexts of up to three characters, each order smoothed
by the next lower one.  A URL is judged by the mean over its characters of the
log ratio of both, against a threshold found on hosts kept out of the training.
All of it is joins and aggregates.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgas.plans.cluster import cut

ORDER = 3
ALPHABET = 64  # size of the alphabet after folding, at most
BROADCAST_GRAMS = 200_000
BINS = 400
KEPT_OUT = 5  # one host of so many calibrates


@dataclass(frozen=True)
class UrlRule:
    """``verdict`` for a host and all its subdomains, below a path that starts with a slash."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(F.coalesce(rest, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: tuple[UrlRule, ...]) -> Column:
    """Name of the longest rule that fits, or null."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, rule.name).otherwise(found)
    return found


def grams(url: Column) -> Column:
    """Every character with the three before it; letters in lower case, digits as 0, other signs outside ASCII as one."""
    rest = F.regexp_replace(F.lower(url), r"^(?s:.*?)://", "")
    folded = F.regexp_replace(F.regexp_replace(rest, r"[0-9]", "0"), r"[^a-z0/.?&=#:%_+-]", "~")
    signs = F.regexp_extract_all(F.concat(F.lit("^" * ORDER), folded, F.lit("$")), F.lit("."), F.lit(0))
    ends = F.sequence(F.lit(ORDER), F.length(folded) + ORDER)
    joined = lambda c: F.transform(ends, lambda i: F.concat(*(F.get(c, i - k) for k in range(ORDER, -1, -1))))
    return F.transform(F.array(signs), joined)[0]


def log_ratios(counts: DataFrame) -> DataFrame:
    """``(gram, ratio)``: log10 of the two smoothed probabilities of a gram's last character, for every counted gram.

    ``counts`` has ``(gram, a, b)``, the gram's training counts in both classes,
    which may be 0.  An order's own counts weigh against its number of distinct
    followers, which is what the lower order gets.
    """
    lower = None
    for k in range(ORDER + 1):
        own = counts.groupBy(F.right("gram", F.lit(k + 1)).alias("gram")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        context = F.substring("gram", 1, k)
        seen = own.groupBy(context.alias("context")).agg(
            F.sum("a").alias("na"), F.sum("b").alias("nb"), F.count_if(F.col("a") > 0).alias("ta"), F.count_if(F.col("b") > 0).alias("tb")
        )
        rows = own.withColumn("context", context).join(seen, "context")
        if lower is None:
            rows = rows.withColumns({"la": F.lit(1 / ALPHABET), "lb": F.lit(1 / ALPHABET)})
        else:
            rows = rows.join(lower, F.right(rows["gram"], F.lit(k)) == lower["low"])
        smooth = lambda n, total, kinds, p: F.when(F.col(total) + F.col(kinds) == 0, F.col(p)).otherwise(
            (F.col(n) + F.col(kinds) * F.col(p)) / (F.col(total) + F.col(kinds))
        )
        rows = rows.select("gram", smooth("a", "na", "ta", "la").alias("pa"), smooth("b", "nb", "tb", "lb").alias("pb"))
        lower = cut(rows.select(F.col("gram").alias("low"), F.col("pa").alias("la"), F.col("pb").alias("lb")))
    return lower.select(F.col("low").alias("gram"), F.log10(F.col("la") / F.col("lb")).alias("ratio"))


def _scores(rows: DataFrame, ratios: DataFrame, small: bool) -> DataFrame:
    """``(page_id, url, copies, score)``: the mean log ratio of each distinct row."""
    placed = rows.select("page_id", "url", F.explode(grams(F.col("url"))).alias("gram"))
    joined = placed.join(F.broadcast(ratios) if small else ratios, "gram")
    # every row has one gram for its end
    summed = joined.groupBy("page_id", "url").agg(F.avg("ratio").alias("score"), F.count_if(F.right("gram", F.lit(1)) == "$").alias("copies"))
    return summed.select("page_id", "url", F.col("copies").cast("int").alias("copies"), "score")


def best_threshold(bins: list) -> float:
    """Middle of the bins that part the classes best, each class weighing the same; 0 if one of them is missing.

    ``bins`` are ``(bin, allowed, blocked)`` rows; a URL is allowed from the threshold on.
    """
    allowed, blocked = sum(b[1] for b in bins), sum(b[2] for b in bins)
    if not allowed or not blocked:
        return 0.0
    by = {b[0]: (b[1], b[2]) for b in bins}
    right, values = 1.0, []
    for at in range(min(by), max(by) + 2):
        values.append((round(right, 12), at))
        a, b = by.get(at, (0, 0))
        right += b / blocked - a / allowed
    best = max(values)[0]
    ties = [at for value, at in values if value == best]
    return ((ties[0] + ties[-1]) / 2 - BINS / 2) / (BINS / 4)


def filter_urls(
    pages: DataFrame, rules: tuple[UrlRule, ...], id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """``(page_id, host, path, rule, verdict, score)``, one row per page.

    The longest fitting rule decides; without one the score does.  Null urls
    and those without ``://`` have an empty host and path and no rule, and are
    scored by their characters (a null one by its end alone).  Rows that are equal
    in id and url are counted and given back as often; an empty table gives no
    rows; other columns are ignored.  If no rule of one kind ever fits, all
    scores are held against 0.

    The models are tables of grams over a bounded alphabet, sent to all tasks
    only up to ``BROADCAST_GRAMS`` rows.  The characters of a page are summed up in
    the task that reads it, so one row per page is exchanged.
    """
    verdicts = F.create_map(*(F.lit(x) for r in rules for x in (r.name, r.verdict)))
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), url.alias("url"))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    ruled = F.element_at(verdicts, fitting_rule(host, path, rules))
    kept_out = F.pmod(F.crc32(host.cast("binary")), F.lit(KEPT_OUT)) == 0
    classed = rows.select("page_id", "url", ruled.alias("class"), kept_out.alias("kept_out"))
    training = lambda verdict: F.sum(((F.col("class") == verdict) & ~F.col("kept_out")).cast("int")).alias
    spread = classed.select(F.coalesce("class", F.lit("")).alias("class"), "kept_out", F.explode(grams(F.col("url"))).alias("gram"))
    counts = cut(spread.groupBy("gram").agg(training("allow")("a"), training("block")("b")))
    ratios = cut(log_ratios(counts))
    small = ratios.count() <= BROADCAST_GRAMS
    known = _scores(classed.where("kept_out and class is not null"), ratios, small)
    place = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor(F.col("score") * (BINS / 4) + BINS / 2)))
    bins = known.groupBy(place.alias("bin")).agg(
        F.sum(F.when(ruled == "allow", F.col("copies")).otherwise(0)), F.sum(F.when(ruled == "block", F.col("copies")).otherwise(0))
    )
    threshold = best_threshold([tuple(r) for r in bins.collect()])  # at most BINS rows
    scored = _scores(rows, ratios, small)
    judged = scored.select(
        "page_id",
        host.alias("host"),
        path.alias("path"),
        fitting_rule(host, path, rules).alias("rule"),
        F.coalesce(ruled, F.when(F.col("score") >= threshold, "allow").otherwise("block")).alias("verdict"),
        "score",
        F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("_copy"),
    )
    return judged.drop("_copy")
