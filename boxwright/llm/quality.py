"""Quality rules with risk-controlled thresholds, made of DataFrame functions alone.

Each rule is a feature of a text for which more is worse and a grid of cutoffs from
lenient to strict.  On labelled documents that pass the base rules, a cutoff's false
rejections k among the n good documents of a stratum (language) give an exact
binomial test of "this cutoff rejects more than ``risk / rules`` of good documents":
its p-value is P(Bin(n, risk / rules) <= k).  Cutoffs are tested in order from the
lenient end and testing stops at the first that fails (a fixed sequence, which needs
no further correction); the level is split over all strata and rules (Bonferroni).
So with probability 1 - ``delta`` no stratum loses more than ``risk`` of its good
documents.  A stratum without enough labels gets no cutoff and rejects nothing.

Defined results: a null or blank text has zero words and fails the base rules;
documents of null language are a stratum of their own; a
document labelled more than once counts once, with its lowest quality; labels
without a document or a quality are ignored; repeated rows give one result row each;
an empty table gives no rows, empty labels no cutoffs.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .native import let, words

SYMBOLS = "#*$%&|<>"
WIDTH = 5
#: The stratum of documents without a language.
NO_LANGUAGE = "\x01none"
#: Good documents that all rules together may reject, and the chance that a stratum's true rate is above it.
RISK, DELTA = 0.02, 0.05
#: Strata whose cutoffs may be broadcast.
MOST_STRATA = 10_000

#: Feature and cutoffs (lenient to strict) of each rule; a text is rejected above the cutoff.
RULES: dict[str, tuple[str, list[float]]] = {
    "symbols": ("n_symbols / n_words", [2.0 * 0.8**k for k in range(24)]),
    "dup_lines": ("n_dup_lines / n_lines", [1.0 - k / 24 for k in range(24)]),
    "repeats": ("n_repeat_words / n_words", [0.2 - k / 120 for k in range(24)]),
    "long_words": ("word_chars / n_words", [24.0 * 0.94**k for k in range(24)]),
    "short_words": ("n_words / word_chars", [1.0 * 0.94**k for k in range(24)]),
    "capitals": ("n_capitals / word_chars", [1.0 - k / 24 for k in range(24)]),
}


def _repeated(hashes: Column) -> Column:
    """Words inside 5-word windows that occur twice or more."""
    grams = F.when(
        F.size(hashes) > WIDTH,
        F.transform(F.sequence(F.lit(0), F.size(hashes) - WIDTH), lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(WIDTH)))),
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(g: Column) -> Column:
        ranked = F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
        twice = let(
            ranked,
            lambda s: F.filter(F.transform(s, lambda x, k: F.when((F.get(s, k - 1)["g"] == x["g"]) | (F.get(s, k + 1)["g"] == x["g"]), x["i"])), lambda p: p.isNotNull()),
        )
        zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        step = lambda acc, p: F.struct((p + WIDTH).alias("end"), (acc["n"] + p + WIDTH - F.greatest(p, acc["end"])).alias("n"))
        return F.aggregate(F.array_sort(twice), zero, step, lambda acc: acc["n"])

    return let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g)))


def text_stats(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """doc_id, stratum and the counts of every whole text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    bare = F.translate(text, " \t\n\x0b\f\r", "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\x0b\f\r", "")) > 0)
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col(stratum).cast("string"), F.lit(NO_LANGUAGE)).alias("stratum"),
        let(F.transform(words(text), lambda w: F.xxhash64(w)), lambda h: F.struct(F.size(h).cast("bigint").alias("n"), _repeated(h).cast("bigint").alias("r"))).alias("w"),
        F.char_length(bare).cast("bigint").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.char_length(text) - F.char_length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("bigint").alias("n_capitals"),
        let(lines, lambda x: F.struct(F.size(x).cast("bigint").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("d"))).alias("l"),
    ).select(
        "doc_id", "stratum", F.col("w.n").alias("n_words"), "word_chars", "n_symbols", "n_capitals",
        F.col("l.n").alias("n_lines"), F.col("l.d").alias("n_dup_lines"), F.col("w.r").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _feature(expression: str) -> Column:
    top, bottom = (F.col(x).cast("double") for x in expression.split(" / "))
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def log_binomial_tail(n: Column, k: Column, p: float) -> Column:
    """log P(Bin(n, p) <= k), for k below n p: the last term in logs, then the terms below it by their ratios."""
    import math

    one_to = F.sequence(F.lit(1), F.greatest(k.cast("int"), F.lit(1)))
    choose = F.when(k > 0, F.aggregate(one_to, F.lit(0.0), lambda acc, i: acc + F.log((n - k + i).cast("double") / i))).otherwise(0.0)
    last = choose + k * math.log(p) + (n - k) * math.log1p(-p)
    zero = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))

    def below(acc: Column, i: Column) -> Column:
        j = k - i + 1  # from k down to 1
        t = acc["t"] * j / (n - j + 1) * ((1 - p) / p)
        return F.struct(t.alias("t"), (acc["s"] + t).alias("s"))

    return last + F.when(k > 0, F.log(F.aggregate(one_to, zero, below, lambda acc: acc["s"]))).otherwise(0.0)


def thresholds(stats: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(stratum, rule, cutoff, n_good, n_rejected): the strictest cutoff of each rule that its labelled holdout supports."""
    import math

    good = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min("quality").alias("q")).where("q > 0")
    held = stats.where(~base_failed()).join(good.select("doc_id"), "doc_id", "left_semi")
    counts = [F.count(F.lit(1)).alias("n")]
    for name, (expression, cutoffs) in RULES.items():
        counts += [F.count_if(_feature(expression) > c).alias(f"{name}_{k}") for k, c in enumerate(cutoffs)]
    wide = written(held.groupBy("stratum").agg(*counts), "holdout")
    level = math.log(delta / (max(1, wide.count()) * len(RULES)))
    rows = wide.select(
        "stratum", "n",
        F.explode(F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(k).alias("step"), F.lit(c).alias("cutoff"), F.col(f"{name}_{k}").alias("k")) for name, (_, cutoffs) in RULES.items() for k, c in enumerate(cutoffs)))).alias("t"),
    ).select("stratum", "n", "t.*")
    p = risk / len(RULES)
    passed = F.when(F.col("k") < F.col("n") * p, log_binomial_tail(F.col("n"), F.col("k"), p) <= level).otherwise(False)
    so_far = Window.partitionBy("stratum", "rule").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    tested = rows.withColumn("passed", passed).withColumn("held", F.min("passed").over(so_far)).where("held")
    best = Window.partitionBy("stratum", "rule").orderBy(F.desc("step"))
    return tested.withColumn("r", F.row_number().over(best)).where("r = 1").select("stratum", "rule", "cutoff", F.col("n").alias("n_good"), F.col("k").alias("n_rejected"))


def apply_rules(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """Per document row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed_rules."""
    stats = written(text_stats(docs), "stats")
    cuts = thresholds(stats, labels, risk, delta)
    wide = written(cuts.groupBy("stratum").agg(*(F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in RULES)), "cutoffs")
    side = F.broadcast(wide) if wide.count() <= MOST_STRATA else wide
    failed = F.array_compact(F.array(*(F.when(_feature(x) > F.col(f"cut_{r}"), F.lit(r)) for r, (x, _) in RULES.items())))
    return (
        stats.join(side, "stratum", "left")
        .withColumn("base_failed", base_failed())
        .withColumn("failed_rules", failed)
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"), "failed_rules")
    )
