"""Quality rules with risk-controlled thresholds. DataFrame functions only.

Base statistics fail a text outright. Beyond that, four ratios have a cutoff each, and a text goes if it exceeds any. The
cutoffs come in levels, fixed in advance from loose to tight, and each stratum (language) takes the tightest level for
which labelled good documents bound the rate of false rejections by the verdict as it is given, that is by the four rules
together: if k of n good documents would go, the exact binomial test P(Bin(n, alpha) <= k) must be at most delta divided
by the number of strata (Bonferroni). Within a stratum the levels are tested in their order until one fails, which needs
no further correction (fixed-sequence testing). So with probability 1 - delta no stratum loses more than the share alpha
of its good documents. A stratum without enough labels certifies no level, and its rules reject nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, LOWER, UPPER, bounded_broadcast, cut, held

SYMBOLS = "#*$%&|<>"
RULES = ("symbol_ratio", "dup_line_ratio", "repeat_ratio", "upper_ratio")
#: The cutoffs of each rule, from loose to tight; the levels go through them side by side.
LEVELS = {
    "symbol_ratio": (0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03, 0.02),
    "dup_line_ratio": (0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1),
    "repeat_ratio": (0.2, 0.19, 0.18, 0.17, 0.16, 0.15, 0.12, 0.1, 0.08, 0.05),
    "upper_ratio": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15),
}
ALPHA, DELTA = 0.01, 0.05


def _repeats(at: str) -> Column:
    """Words inside 5-word windows that are found twice or more; at: a column of (hash, place) sorted.

    It must be a column and no expression: a lambda would work an expression out again for every element.
    """
    same = lambda x, j: F.coalesce(F.get(at, j)["h"] == x["h"], F.lit(False))
    twice = F.filter(F.transform(at, lambda x, j: F.when(((j > 0) & same(x, j - 1)) | same(x, j + 1), x["i"])), lambda x: x.isNotNull())
    return F.aggregate(
        F.array_sort(twice),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-5).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(5), p - a["last"])).alias("n"), p.alias("last")),
    )["n"]


def statistics(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """doc_id, stratum, the base statistics, base_failed and the four ratios of each row; a null text counts as empty.

    Rows stay as many as they are, so repeated rows give repeated results. A null stratum is the stratum "".
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    split = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda s: F.translate(s, BLANKS, "") != "")
    a = docs.select("doc_id", F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), text.alias("text"), lines.alias("ln"))
    a = held(a, "w", split)
    n = F.size("w")
    hashes = F.when(n >= 5, F.transform(F.sequence(F.lit(1), F.greatest(n - 4, F.lit(1))), lambda i: F.xxhash64(F.slice("w", i, 5)))).otherwise(F.array().cast("array<long>"))
    b = a.select(
        "doc_id", "stratum", n.cast("long").alias("n_words"), F.length(F.translate("text", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"), F.size("ln").cast("long").alias("n_lines"),
        (F.size("ln") - F.size(F.array_distinct("ln"))).cast("long").alias("n_dup_lines"), (F.length("text") - F.length(F.translate("text", UPPER, ""))).alias("n_upper"), "w",
    )
    b = held(b, "h", hashes).drop("w")
    # The dearer path is taken only by texts in which some window comes twice.
    rep = F.when(F.size(F.array_distinct("h")) < F.size("h"), F.lit(True)).otherwise(F.lit(False))
    at = held(b, "at", F.when(rep, F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))).drop("h")
    c = at.withColumn("n_repeat_words", F.when(F.col("at").isNotNull(), _repeats("at")).otherwise(F.lit(0)).cast("long")).drop("at")
    per = lambda x, y: F.col(x) / F.greatest(F.col(y), F.lit(1))
    return c.select(
        "doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"),
        per("n_symbols", "word_chars").alias("symbol_ratio"), per("n_dup_lines", "n_lines").alias("dup_line_ratio"), per("n_repeat_words", "n_words").alias("repeat_ratio"), per("n_upper", "word_chars").alias("upper_ratio"),
    )


def _log_factorial(x: Column) -> Column:
    """ln x! by Stirling's series after a shift by 10; good to about 1e-13."""
    z = x + 11.0
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z)
    for j in range(1, 11):
        series = series - F.log(x + float(j))
    return series


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), summed downwards from k until terms vanish in double precision; 1 where k >= n p."""
    n, k = n.cast("double"), k.cast("double")
    top = F.exp(_log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * math.log(p) + (n - k) * math.log(1 - p))
    reach = F.least(k, F.ceil(12 * F.sqrt(n * p * (1 - p))) + 60).cast("int")
    total = F.aggregate(F.sequence(F.lit(0), reach), F.struct(F.lit(1.0).alias("t"), F.lit(0.0).alias("s")), lambda a, j: F.struct((a["t"] * (k - j) * (1 - p) / ((n - k + j + 1) * p)).alias("t"), (a["s"] + a["t"]).alias("s")))["s"]
    return F.when(k >= n * p, F.lit(1.0)).otherwise(top * total)


def _over(level: Column) -> Column:
    """Whether a row's ratios exceed a cutoff of the level, a number from 1; no cutoff is exceeded at a null level."""
    out = F.lit(False)
    for r in RULES:
        out = out | F.coalesce(F.col(r) > F.get(F.array(*map(F.lit, LEVELS[r])), level - 1), F.lit(False))
    return out


def certified(stats: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, n, level): for each stratum with labelled good documents, their number and its level, null if none holds.

    A document with several labels is good only if all call it good; null labels are none. Documents that base statistics
    fail are left out, as the rules never decide on them.
    """
    good = labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")
    held_ = stats.where("not base_failed").join(good, "doc_id", "left_semi")
    steps = range(1, len(LEVELS[RULES[0]]) + 1)
    counts = cut(held_.groupBy("stratum").agg(F.count("*").alias("n"), *(F.count_if(_over(F.lit(t))).alias(f"k{t}") for t in steps)))
    strata = max(counts.count(), 1)
    tests = counts.select("stratum", "n", F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.col(f"k{t}").alias("k")) for t in steps))).alias("x"))
    tests = tests.select("stratum", "n", "x.t", (binomial_tail(F.col("n"), F.col("x.k"), alpha) <= delta / strata).alias("ok"))
    # Every level rejects what a looser one does: k grows with the level, so no level holds beyond the first that fails.
    return tests.groupBy("stratum").agg(F.first("n").alias("n"), F.max(F.when(F.col("ok"), F.col("t"))).alias("level"))


def judge(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, stratum: str = "lang") -> DataFrame:
    """statistics of each row with level and kept: false if base_failed or some cutoff of the stratum's level is exceeded."""
    stats = cut(statistics(docs, stratum))
    levels = cut(certified(stats, labels, alpha, delta).select("stratum", "level"))
    out = stats.join(bounded_broadcast(levels, F.octet_length("stratum") + 64), "stratum", "left")
    return out.withColumn("kept", ~F.col("base_failed") & ~_over(F.col("level")))
