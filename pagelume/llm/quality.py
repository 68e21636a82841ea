"""Operator 8: quality rules with risk-controlled cutoffs, in DataFrame functions only.

Counts come from each whole text. On the labelled documents, each rule (a measure of which large values speak against a
document) is tried at the cutoffs of a fixed grid, from the mildest to the strictest. A cutoff is certified while the
exact binomial test rejects, at level delta / (strata x rules), that more than alpha / rules of the stratum's good
documents lie beyond it: P(Bin(n, alpha / rules) <= rejected good ones). Testing in this fixed order and stopping at the
first failure needs no further correction, and the split of delta over strata and rules (Bonferroni) corrects for their
number, so with probability 1 - delta every stratum loses at most a share alpha of its good documents. Among certified
cutoffs the strictest is taken whose rejects are mostly bad; else the rule is off. With ALPHA = 0.05 a rule needs some 480
good labelled documents in a stratum. quality_cutoffs() returns each cutoff with the labels and the bound it rests on.

Scale: one pass over the texts, no shuffle of text; apply_quality() writes the rows with their counts once. Labelled counts
are partial sums of at most strata x rules x grid rows, of which only the chosen cutoffs (strata x rules numbers at most,
both parameters) reach the driver.

Defined cases: null text has no words (base_failed); an empty text likewise; null or other languages form the stratum
'other'; a stratum without enough labels has no cutoff and rejects nothing beyond the base; repeated rows are judged each;
an empty table gives an empty result; extra columns pass through apply_quality().
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .native import BLANKS, let, total, words
from .store import Scratch, table

SYMBOLS = "#*$%&|<>"
STRATA = ("en", "fr", "de", "es")
ALPHA, DELTA = 0.05, 0.05
GRID = 200
#: A rule is used only where, among what its cutoff rejects, bad documents are at least this many times the good ones.
ODDS = 4


def repeated_words(w: Column) -> Column:
    """Words that lie in a 3-word window found twice or more."""
    last = F.lit(2**31 - 1)

    def covered(t: Column) -> Column:
        pairs = F.sort_array(F.transform(t, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            same = lambda x, j: F.coalesce(x["h"] == F.get(s, j)["h"], F.lit(False))
            places = F.sort_array(F.transform(F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))
            return let(places, lambda p: total(F.transform(p, lambda a, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1), last) - a))))

        return let(pairs, twice)

    def of(ws: Column) -> Column:
        starts = F.when(F.size(ws) >= 3, F.sequence(F.lit(0), F.size(ws) - 3)).otherwise(F.array().cast("array<int>"))
        hashes = F.transform(starts, lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)))
        return let(hashes, lambda t: F.when(F.size(F.array_distinct(t)) == F.size(t), F.lit(0).cast("long")).otherwise(covered(t)))

    return of(w)


def quality_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """df with a struct column `q` of the counts."""
    t = F.coalesce(F.col(text), F.lit(""))
    chars = lambda drop: F.length(F.translate(t, drop, ""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    counted = let(words(t), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r")))
    repeated = let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    out = df.withColumn("q", F.struct(counted.alias("w"), chars(BLANKS).cast("long").alias("word_chars"), (F.length(t) - chars(SYMBOLS)).cast("long").alias("n_symbols"), repeated.alias("n_dup_lines")))
    w = F.col("q.w.n"), F.col("q.w.r")
    failed = (w[0] < 50) | (100 * w[1] > 50 * w[0])
    return out.withColumn("q", F.struct(w[0].alias("n_words"), "q.word_chars", "q.n_symbols", "q.n_dup_lines", w[1].alias("n_repeat_words"), failed.alias("base_failed")))


def measures() -> dict[str, Column]:
    """Rules: measures in 0 .. 1 of the counts in `q`; the larger, the worse."""
    n = F.greatest(F.col("q.n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("q.word_chars"), F.lit(1)).cast("double")
    return {
        "symbols": F.least(F.lit(1.0), F.col("q.n_symbols") / chars * 2),
        "repeats": F.least(F.lit(1.0), F.col("q.n_repeat_words") / n),
        "lines": F.least(F.lit(1.0), F.col("q.n_dup_lines") / n * 10),
        "long_words": F.least(F.lit(1.0), chars / n / 40),
    }


def stratum(strata: tuple[str, ...]) -> Column:
    return F.when(F.col("lang").isin(*strata), F.col("lang")).otherwise("other")


def binomial_below(n: Column, k: Column, p: float) -> Column:
    """log P(Bin(n, p) <= k), summed term by term in logarithms; k is at most n p here, so the sum has few terms."""
    step = math.log(p / (1 - p))
    first = n * math.log1p(-p)

    def add(a: Column, i: Column) -> Column:
        term = a["t"] + F.log((n - i + 1) / i) + F.lit(step)
        high = F.greatest(a["s"], term)
        return F.struct(term.alias("t"), (high + F.log1p(F.exp(-F.abs(a["s"] - term)))).alias("s"))

    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(steps, F.struct(first.alias("t"), first.alias("s")), add)["s"]


def certified_cutoffs(counted: DataFrame, labels: DataFrame, strata: tuple[str, ...] = STRATA, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, rule, step, n_good, n_lost, log_p): documents whose measure reaches step / GRID are rejected; of n_good good
    labelled ones n_lost are, which has the log probability log_p if the true share is alpha / rules. `counted` has doc_id, lang, q."""
    rules = measures()
    share = alpha / len(rules)
    level = math.log(delta / (len(rules) * (len(strata) + 1)))
    labelled = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    seen = counted.where(~F.col("q.base_failed")).select("doc_id", stratum(strata).alias("stratum"), F.array(*[F.struct(F.lit(k).alias("rule"), F.floor(v * GRID).cast("int").alias("step")) for k, v in rules.items()]).alias("m")).join(labelled, "doc_id")
    cells = seen.select("stratum", "quality", F.explode("m").alias("m")).groupBy("stratum", "m.rule", "m.step").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"))
    every = Window.partitionBy("stratum", "rule")
    down = every.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    tried = cells.select("stratum", "rule", "step", F.sum("good").over(every).alias("n"), F.sum("good").over(down).alias("k"), F.sum("bad").over(down).alias("bad"))
    tried = tried.withColumn("log_p", F.when(F.col("k") <= F.col("n") * share, binomial_below(F.col("n"), F.col("k"), share)))
    passes = F.coalesce(F.col("log_p") <= level, F.lit(False))
    tried = tried.withColumn("certified", F.min(passes.cast("int")).over(down) == 1)
    chosen = tried.where(F.col("certified") & (F.col("step") > 0) & (F.col("bad") > ODDS * F.col("k")))
    return chosen.groupBy("stratum", "rule").agg(F.min(F.struct("step", F.col("n").alias("n_good"), F.col("k").alias("n_lost"), "log_p")).alias("c")).select("stratum", "rule", "c.*")


def verdict(cutoffs: list, strata: tuple[str, ...] = STRATA) -> Column:
    """kept, from the counts in `q` and the language."""
    out = ~F.col("q.base_failed")
    rules = measures()
    for x in cutoffs:
        out = out & ~((stratum(strata) == x["stratum"]) & (F.floor(rules[x["rule"]] * GRID) >= x["step"]))
    return out


def apply_quality(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs that the rules keep, with their own columns only."""
    columns = docs.columns
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)], F.col("doc_id"), F.col("text"), F.col("lang"))
    counted = Scratch(spark, "quality").table(quality_counts(plain).drop("text"), "counts")
    cutoffs = certified_cutoffs(counted, labels).collect()
    return counted.where(verdict(cutoffs)).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])


def quality_cutoffs(spark: SparkSession, docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The chosen cutoffs by stratum and rule: cutoff of the measure, good labels, good labels lost, bound on their true share."""
    found = certified_cutoffs(quality_counts(docs.select("doc_id", "lang", "text")), labels, alpha=alpha, delta=delta)
    return found.select("stratum", "rule", (F.col("step") / GRID).alias("cutoff"), "n_good", "n_lost", F.lit(alpha / len(measures())).alias("bound"), F.exp("log_p").alias("p_value"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "quality")
    counted = scratch.table(quality_counts(table(spark, sf_dir, "documents").select("doc_id", "lang", "text")).select("doc_id", "lang", "q"), "counts")
    cutoffs = certified_cutoffs(counted, table(spark, sf_dir, "labels")).collect()
    return counted.select("doc_id", "q.*", verdict(cutoffs).alias("kept"))
