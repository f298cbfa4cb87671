"""Quality rules whose cutoffs are certified on labelled documents.

For each rule and stratum the cutoffs are tried from the loosest to the
tightest. A cutoff is certified while the exact binomial test rejects, on the
stratum's good labelled documents, that it turns away more than its share of
good documents; the first cutoff that fails ends the sequence, so the tries of
one rule need no correction, and the level is divided by the number of rules
and strata (Bonferroni). All cutoffs together turn away more than ``RISK`` of
the good documents of any stratum with a probability of ``LEVEL`` at most.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirebook.llm.common import WORD, durable

SPACES = r"[\x20\x09-\x0D]+"
WINDOW = 8
MIN_WORDS, REPEAT_PERCENT = 20, 30
RISK, LEVEL = 0.02, 0.05
#: The measure that may not exceed the cutoff, and its cutoffs from the loosest to the tightest.
RULES: dict[str, tuple[float, ...]] = {
    "symbol_share": (0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03, 0.02, 0.01),
    "dup_line_share": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1),
    "repeat_share": (0.28, 0.25, 0.2, 0.15, 0.1, 0.05),
    "word_chars_mean": (20.0, 15.0, 12.0, 11.0, 10.0, 9.0, 8.5, 8.0, 7.5, 7.0, 6.5),
    "word_chars_mean_below": (-1.5, -2.0, -2.5, -3.0, -3.5, -4.0, -4.5, -5.0),
}


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _repeat_words(words: Column) -> Column:
    """How many words are in windows of ``WINDOW`` words that the text has twice or more.

    Words are compared by 64-bit hashes, runs of four by the hash of theirs and
    windows by the hash of their two runs. Most texts repeat no run, which a
    set of the hashes shows, and so no window; only the others go on to windows
    and sort them to find the places.
    """

    def places(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        again = lambda s: F.filter(s, lambda e, j: (e["x"] == F.get(s, j - 1)["x"]) | (e["x"] == F.get(s, j + 1)["x"]))
        return F.array_sort(F.transform(_let(pairs, again), lambda e: e["i"]))

    # A place covers its window up to the next place's.
    covered = lambda p: F.aggregate(
        F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x
    )
    half = WINDOW // 2
    unlike = lambda h: F.size(F.array_distinct(h)) == F.size(h)
    repeated = lambda h: F.when(unlike(h), 0).otherwise(_let(places(h), covered))
    joined = lambda q: F.transform(F.sequence(F.lit(0), F.size(q) - half - 1), lambda i: F.xxhash64(F.get(q, i), F.get(q, i + half)))
    by_runs = lambda q: F.when(unlike(q), 0).otherwise(_let(joined(q), repeated))
    runs = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - half), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(half)]))
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) > WINDOW, _let(hashed, lambda h: _let(runs(h), by_runs))).otherwise(0)


def measures(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """``doc_id, stratum`` and the measures of every row's whole text; a null text counts as an empty one."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(stratum_col).cast("string").alias("stratum"), text.alias("text"))

    def counted(words: Column) -> Column:
        chars = F.length(F.array_join(words, "")).cast("bigint").alias("word_chars")
        return F.struct(F.size(words).cast("bigint").alias("n_words"), chars, _repeat_words(words).cast("bigint").alias("n_repeat_words"))

    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(WORD))
    of_lines = _let(lines, lambda x: F.struct(F.size(x).cast("bigint").alias("n_lines"), F.size(F.array_distinct(x)).cast("bigint").alias("n_distinct")))
    found = plain.select(
        "doc_id", "stratum",
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        of_lines.alias("lines"),
        _let(F.array_remove(F.split("text", SPACES), ""), counted).alias("words"),
    )
    flat = found.select(
        "doc_id", "stratum", "words.n_words", "words.word_chars", "n_symbols", (F.col("lines.n_lines") - F.col("lines.n_distinct")).alias("n_dup_lines"), "words.n_repeat_words", "lines.n_lines"
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return flat.withColumn("base_failed", failed).withColumns({
        "symbol_share": share("n_symbols", "word_chars"), "dup_line_share": share("n_dup_lines", "n_lines"), "repeat_share": share("n_repeat_words", "n_words"),
        "word_chars_mean": share("word_chars", "n_words"), "word_chars_mean_below": -share("word_chars", "n_words"),
    })


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """The probability of at most ``k`` of ``n`` with chance ``p``, for k up to n * p; beyond it 1.

    Terms are added in logarithms, each from the one before, relative to the
    last: so nothing underflows for large n.
    """
    odds = math.log(p) - math.log1p(-p)
    first = F.struct((n * F.lit(math.log1p(-p))).alias("term"), (n * F.lit(math.log1p(-p))).alias("sum"))

    def add(acc: Column, j: Column) -> Column:
        term = acc["term"] + F.log((n - j + 1) / j) + F.lit(odds)
        return F.struct(term.alias("term"), (F.greatest(acc["sum"], term) + F.log1p(F.exp(-F.abs(acc["sum"] - term)))).alias("sum"))

    # From 1 to k; from 1 to 0 would count down, so k = 0 adds nothing by the filter.
    steps = F.filter(F.sequence(F.lit(1).cast("bigint"), F.greatest(k, F.lit(1).cast("bigint"))), lambda j: j <= k)
    return F.when(k > n * p, F.lit(1.0)).otherwise(F.exp(F.aggregate(steps, first, add, lambda acc: acc["sum"])))


def cutoffs(measured: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """``stratum`` and for each rule its certified cutoff, null where none is.

    Only labelled rows of quality 1 that pass the base rules count; an id that
    is labelled more than once is good if all its labels say so, null labels
    and ids are passed over. The counts are one row per stratum, summed before
    the shuffle.
    """
    good = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("y")).dropna().groupBy("doc_id").agg(F.min("y").alias("y")).filter("y = 1").select("doc_id")
    held = measured.filter(~F.col("base_failed")).join(good, "doc_id")
    sums = [F.sum((F.col(rule) > cut).cast("bigint")).alias(f"{rule}_{i}") for rule, cuts in RULES.items() for i, cut in enumerate(cuts)]
    counts = held.groupBy("stratum").agg(F.count("*").alias("n"), *sums)
    tries = [F.struct(F.lit(rule).alias("rule"), F.lit(i).alias("i"), F.lit(cut).alias("cut"), F.col(f"{rule}_{i}").alias("k")) for rule, cuts in RULES.items() for i, cut in enumerate(cuts)]
    strata = F.count("*").over(Window.partitionBy())  # one row for each stratum
    each = counts.withColumn("strata", strata).select("stratum", "n", "strata", F.inline(F.array(*tries)))
    certified = (binomial_tail(F.col("k"), F.col("n"), RISK / len(RULES)) <= F.lit(LEVEL) / (len(RULES) * F.col("strata"))).cast("int")
    so_far = Window.partitionBy("stratum", "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    passed = each.withColumn("passed", certified).withColumn("all_passed", F.min("passed").over(so_far))
    return passed.groupBy("stratum").agg(*[F.min(F.when((F.col("rule") == rule) & (F.col("all_passed") == 1), F.col("cut"))).alias(f"{rule}_cut") for rule in RULES])


def judge(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", label_col: str = "quality") -> DataFrame:
    """Every row's measures, ``base_failed`` and ``kept``.

    A row is kept if it passes the base rules and no certified cutoff of its
    stratum is exceeded. A stratum without a certified cutoff, as one with few
    labels, turns nothing away beyond the base rules. Null strata are a stratum
    of their own. Repeated rows are judged alike; no rows give none; columns
    other than those named are not read.
    """
    measured = durable(measures(docs, id_col=id_col, text_col=text_col, stratum_col=stratum_col), "measures")
    limits = durable(cutoffs(measured, labels, label_col=label_col), "cutoffs")
    # The key is never null; the table has one row for each stratum, and Spark broadcasts it only while its files are small.
    told = limits.withColumn("s", F.struct(F.coalesce("stratum", F.lit("")), F.col("stratum").isNull())).drop("stratum")
    met = measured.withColumn("s", F.struct(F.coalesce("stratum", F.lit("")), F.col("stratum").isNull())).join(told, "s", "left")
    exceeded = [F.coalesce(F.col(rule) > F.col(f"{rule}_cut"), F.lit(False)) for rule in RULES]
    kept = ~F.col("base_failed")
    for rule in exceeded:
        kept = kept & ~rule
    return met.withColumn("kept", kept).select(*measured.columns, "kept")
