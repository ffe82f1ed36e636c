"""Quality rules whose cutoffs are chosen under a proven risk, with DataFrame functions only.

A rule rejects a document whose feature exceeds a cutoff. The rules tighten together, one step at a
time, from lenient to strict: a document has a first step that rejects it, or none. For each stratum
(language) the steps are tried in that order on the labelled documents of good quality: ``k`` of ``n``
good ones would go at a step, by any rule. The exact binomial test asks whether the true share of good
documents that are lost can still be above ``risk``: its p-value is P(Binomial(n, risk) <= k), which is at
most a level exactly if the Clopper-Pearson upper bound at that level is at most ``risk``. The rejected
sets are nested, so steps are tested in a fixed sequence that ends at the first failure, each at the
full level of its stratum; over strata the level is shared out by Bonferroni. With probability 1 - delta
no stratum falsely loses more than ``risk`` of its good documents, all rules together. Copies would
count one text as many independent ones: labelled documents with the same least 8-word
window are one trial, lost if any of them is. A stratum without enough labels gets no step and only the
base rules hold.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackmill.llm.common import WORD_BREAK, let, settle

WORD = r"[^\x20\x09-\x0D]+"
WINDOW = 8
#: Rule: feature of the columns below, then cutoffs from lenient to strict.
RULES = {
    "symbols": ("n_symbols / greatest(word_chars, 1)", (0.5, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03)),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", (0.9, 0.7, 0.5, 0.3, 0.2, 0.1)),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", (0.28, 0.24, 0.2, 0.16, 0.12, 0.08)),
    "long_words": ("word_chars / greatest(n_words, 1)", (20.0, 15.0, 12.0, 10.0, 9.0, 8.0)),
}
#: The order in which cutoffs are tightened: all rules' most lenient ones, then all next ones.
STEPS = [(rule, cuts[i]) for i in range(max(len(cuts) for _, cuts in RULES.values())) for rule, (_, cuts) in RULES.items() if i < len(cuts)]
#: Share of a stratum's good documents that its rules together may lose, and the chance that any bound fails.
RISK, DELTA = 0.03, 0.1
#: Strata whose steps are broadcast, at most.
LISTED = 100_000


def _windows(hashes: Column) -> Column:
    """Hashes of all runs of 8 neighbours, by doubling; empty for fewer."""

    def pair(values: Column, gap: int) -> Column:
        return F.zip_with(values, F.slice(values, F.lit(gap + 1), F.size(values)), lambda a, b: F.xxhash64(a, b))

    return let(pair(hashes, 1), lambda two: let(pair(two, 2), lambda four: F.slice(pair(four, 4), F.lit(1), F.greatest(F.size(four) - (WINDOW - 1), F.lit(0)))))


def _covered(windows: Column) -> Column:
    """Words that repeated windows cover: sorted with their places, equal neighbours are repeats, and gaps between places add up."""

    def places(sorted_pairs: Column) -> Column:
        def place(p: Column, j: Column) -> Column:
            same = F.coalesce(F.get(sorted_pairs, j - 1)["h"] == p["h"], F.lit(False)) | F.coalesce(F.get(sorted_pairs, j + 1)["h"] == p["h"], F.lit(False))
            return F.when(same, p["i"])

        return F.sort_array(F.filter(F.transform(sorted_pairs, place), lambda i: i.isNotNull()))

    def cover(at: Column) -> Column:
        gaps = F.transform(at, lambda i, j: F.least(F.lit(WINDOW), F.coalesce(F.get(at, j + 1) - i, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(let(pairs, places), cover))


def features(docs: DataFrame) -> DataFrame:
    """doc_id, stratum (lang; empty if null), copy (what copies have in common), n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["lang"].cast("string"), F.lit("")).alias("stratum"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    hashed = rows.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    lines = let(F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD)), lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    repeats = let(_windows(F.col("hashes")), _covered)
    found = hashed.select("doc_id", "stratum", F.size("hashes").alias("n_words"), F.length(F.regexp_replace("text", WORD_BREAK, "")).alias("word_chars"), F.length(F.regexp_replace("text", "[^#*$%&|<>]+", "")).alias("n_symbols"), lines.alias("lines"), F.when(F.size("hashes") > WINDOW, repeats).otherwise(0).alias("n_repeat_words"), _copy_key().alias("copy"))
    return found.select("doc_id", "stratum", "copy", *[F.col(c).cast("long").alias(c) for c in ("n_words", "word_chars", "n_symbols")], F.col("lines.n").cast("long").alias("n_lines"), F.col("lines.dup").cast("long").alias("n_dup_lines"), F.col("n_repeat_words").cast("long").alias("n_repeat_words"))


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k), summed in logarithms; 1 where k reaches the mean, which no test below needs."""
    odds = math.log(p / (1 - p))
    begin = F.struct((n * math.log1p(-p)).cast("double").alias("log"), F.lit(0.0).alias("sum"))

    def step(s: Column, i: Column) -> Column:
        return F.struct((s["log"] + F.log((n - i) / (i + 1)) + odds).alias("log"), (s["sum"] + F.exp(s["log"])).alias("sum"))

    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.aggregate(F.sequence(F.lit(0).cast("long"), k), begin, step, lambda s: s["sum"]))


def base_failed() -> Column:
    return F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words")


def rejected_at() -> Column:
    """The first step that rejects a row of features; null if none does."""
    return F.expr("case " + " ".join(f"when {RULES[rule][0]} > {cut} then {i}" for i, (rule, cut) in enumerate(STEPS)) + " end")


def _copy_key() -> Column:
    """A hash of the least 8-word window by its first word, then as a whole: the same for copies, and for most near copies."""

    def least(firsts: Column) -> Column:
        windows = lambda m: F.transform(firsts, lambda w, i: F.when(w == m, F.array_join(F.slice("words", i + 1, F.lit(WINDOW)), " ")))
        return let(F.array_min(firsts), lambda m: F.array_min(windows(m)))

    return F.xxhash64(let(F.slice("words", F.lit(1), F.greatest(F.size("words") - (WINDOW - 1), F.lit(1))), least))


def calibrate(found: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(stratum, last): the last step that passes in each stratum, from features. Labels: (doc_id, quality); 1 is good.

    Rows without doc_id or quality are left out; repeated labels of a document count once if they agree
    and not at all if they don't.
    """
    good = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("least"), F.max("quality").alias("most")).where("least = 1 and most = 1").select("doc_id")
    held = found.where(~base_failed()).select("doc_id", "stratum", "copy", rejected_at().alias("at")).join(good, "doc_id", "left_semi")
    trials = held.groupBy("stratum", "copy").agg(F.min("at").alias("at"))
    lost = F.array(*[F.struct(F.lit(i).alias("step"), F.count_if(F.col("at") <= i).alias("k")) for i in range(len(STEPS))])
    counts = trials.groupBy("stratum").agg(F.count("*").alias("n"), lost.alias("steps"))
    strata = counts.agg(F.count("*").alias("strata"))
    rows = counts.select("stratum", "n", F.explode("steps").alias("t")).select("stratum", "n", "t.*").crossJoin(F.broadcast(strata))
    tested = rows.withColumn("fails", binomial_cdf(F.col("k"), F.col("n"), risk) > delta / F.col("strata"))
    sequence = Window.partitionBy("stratum").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return tested.withColumn("stopped", F.max("fails").over(sequence)).where("not stopped").groupBy("stratum").agg(F.max("step").alias("last"))


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """The features of every row of docs with base_failed, kept, and the rule that rejected it (null if none).

    A null or empty text has no words and fails the base rules. Labels may be empty: then only the base
    rules hold.
    """
    found = settle(features(docs), "quality", free=False)
    steps = settle(calibrate(found, labels, risk, delta), "quality-steps", free=False)
    few = steps.count() <= LISTED
    ruled = found.withColumn("at", rejected_at()).join(F.broadcast(steps) if few else steps, "stratum", "left")
    names = F.array(*[F.lit(rule) for rule, _ in STEPS])
    broken = F.when(F.col("at") <= F.col("last"), F.get(names, F.col("at")))
    return ruled.select("doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), broken.alias("broken_rule")).withColumn("kept", ~F.col("base_failed") & F.col("broken_rule").isNull())
