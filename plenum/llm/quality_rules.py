"""Quality rules whose cutoffs hold a guarantee, in DataFrame functions only.

Base: counts of words, symbols, repeated lines and repeated 3-word windows, and a fixed rule on them.

Method: each rule is a ratio of the counts that is high in bad texts. Labelled documents are the holdout,
dealt to two halves by a hash of doc_id. The first half chooses: for every stratum (language), level of a
fixed list and rule, of the cutoffs of a fixed grid that reject at most that share of its good documents the
one that rejects most bad documents, with the fewest good ones and then the strictest among equals. A level's
cutoffs together are a union of rules. Two unions come first, of cutoffs that reject no good document, the most
lenient among equals: the best rule alone, and all. Each union contains those before it. The second half certifies the unions in that order:
k of its n good documents are rejected, and a union holds if the exact binomial test refutes that its false
rejection rate is above ``limit``: P(Bin(n, limit) <= k) <= ``risk`` / strata. k does not fall from level to
level, so the tests stop at the first failure and need no correction within a stratum. So with probability
1 - ``risk`` no stratum loses more than ``limit`` of its good documents by all rules together. Of the certified
unions the one that rejects most bad documents is taken, that of the lowest level among equals. With four
strata a certificate takes at least 86 good documents in the second half; a stratum without one rejects nothing
beyond the base rule.

The counts are computed where the texts are read; only numbers are shuffled, to meet the labels. The
thresholds are a table of strata times rules, checked to be small before it is broadcast.

Windows are compared by 64-bit hashes inside one text. Null or empty text has no words and fails the base
rule. Null languages are a stratum of their own. Null labels and ids aren't part of the holdout; of several labels of a
document the largest counts; repeated documents count each. Columns named like those that are added are
replaced, others pass through. An empty table gives no rows; without labels nothing but the base rule
rejects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, written

BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]+"
#: Rules: the ratio, and the grid of its cutoffs, fixed before any label is seen.
GRID = {
    "symbol_share": [0.001, 0.002, 0.005, 0.01, 0.02, 0.03, 0.05, 0.08, 0.1, 0.15, 0.2, 0.3],
    "dup_line_share": [0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8],
    "repeat_share": [0.01, 0.02, 0.03, 0.05, 0.08, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4],
    "long_words": [6.0, 7.0, 8.0, 9.0, 10.0, 11.0, 12.0, 14.0, 16.0, 20.0, 25.0, 30.0],
    "short_words": [-6.0, -5.5, -5.0, -4.5, -4.0, -3.5, -3.0, -2.5, -2.0, -1.75, -1.5, -1.25],
}
#: Shares of the first half's good documents that a rule's cutoff may reject, fixed before any label is seen; -2 and -1: none, and lenient cutoffs of the best rule and of all.
LEVELS = [-2.0, -1.0, 0.0, 0.002, 0.005, 0.01, 0.015, 0.02, 0.03, 0.05]
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Rows of thresholds that may be broadcast.
MOST_THRESHOLDS = 100_000


def bound(value: Column, f) -> Column:
    """``f`` of ``value``, which is computed once however often ``f`` uses it."""
    return F.transform(F.array(value), f)[0]


def _covered(hashes: Column) -> Column:
    """Words in 3-word windows whose hash occurs twice or more. ``hashes``: of the windows in order."""

    def positions(s: Column) -> Column:
        again = lambda e, j: ((j > 0) & (F.get(s, j - 1)["h"] == e["h"])) | F.coalesce(F.get(s, j + 1)["h"] == e["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, again), lambda e: e["i"]))

    def count(h: Column) -> Column:
        by_hash = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("total"))
        step = lambda a, i: F.struct(i.alias("last"), (a["total"] + F.least(F.lit(3), i - a["last"])).alias("total"))
        repeated = F.aggregate(bound(by_hash, positions), start, step, lambda a: a["total"])
        return F.when(F.size(F.array_distinct(h)) < F.size(h), repeated).otherwise(F.lit(0))

    return bound(hashes, count)


def _word_counts(words: Column) -> Column:
    n = F.size(words)
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.struct(
        n.cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.when(n < 4, F.lit(0)).otherwise(_covered(windows)).cast("long").alias("n_repeat_words"),
    )


def with_counts(docs: DataFrame) -> DataFrame:
    """``docs`` with the counts of its texts, base_failed and the ratios of the rules."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANKS))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    by_line = bound(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    added = [*COUNTS, "base_failed", *GRID, "_w", "_l"]
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in added]
    d = docs.select(*keep, bound(words, _word_counts).alias("_w"), by_line.alias("_l"), (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"))
    d = d.select(*keep, "_w.n_words", "_w.word_chars", "n_symbols", F.col("_l.dup").alias("n_dup_lines"), "_w.n_repeat_words", F.col("_l.n").alias("_l"))
    n = F.greatest("n_words", F.lit(1))
    return d.select(
        *keep,
        *COUNTS,
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        (F.col("n_symbols") / F.greatest("word_chars", F.lit(1))).alias("symbol_share"),
        (F.col("n_dup_lines") / F.greatest("_l", F.lit(1))).alias("dup_line_share"),
        (F.col("n_repeat_words") / n).alias("repeat_share"),
        (F.col("word_chars") / n).alias("long_words"),
        (-F.col("word_chars") / n).alias("short_words"),
    )


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), exact up to rounding; 1 where k is not below the mean, which no test needs."""
    log_top = F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), F.lit(0.0), lambda a, i: a + F.when(i <= k, F.log((n - k + i) / i)).otherwise(0.0))
    log_top = log_top + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))
    # The terms below k, each from the one above it.
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def step(a, j):
        i = k - j + 1
        term = F.when(i >= 1, a["term"] * i / (n - i + 1) * ((1 - p) / p)).otherwise(F.lit(0.0))
        return F.struct(term.alias("term"), (a["total"] + term).alias("total"))

    rest = F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), start, step, lambda a: a["total"])
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.exp(log_top) * rest))


def thresholds(counted: DataFrame, labels: DataFrame, stratum: str = "lang", limit: float = 0.05, risk: float = 0.05) -> DataFrame:
    """stratum, rule, cutoff, n_good, n_false, n_bad, tail of the cutoffs that are used; the last four are of a stratum's rules together.

    ``counted``: of with_counts(); ``labels`` (doc_id, quality 0 or 1) mark the holdout. n_good, n_false and tail are of the
    half that certifies, n_bad is of both.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("good")).where("doc_id is not null and good in (0, 1)")
    own = own.groupBy("doc_id").agg(F.max("good").alias("good"))
    rows = counted.where("not base_failed").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), *GRID).join(own, "doc_id")
    rows = written(rows.select("stratum", "good", F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(2)).alias("half"), *GRID), "holdout")
    # For each rule how many cutoffs of the grid a document exceeds: the counts of all cutoffs follow from sums over a small table.
    over = [F.struct(F.lit(r).alias("rule"), sum((F.col(r) > c).cast("int") for c in grid).alias("over")) for r, grid in GRID.items()]
    tally = rows.where("half = 0").select("stratum", "good", F.explode(F.array(*over)).alias("x")).groupBy("stratum", "x.rule", "x.over", "good").count()
    grid = F.create_map(*(x for r, g in GRID.items() for x in (F.lit(r), F.array(*map(F.lit, g)))))
    cut = tally.select("stratum", "rule", "over", "good", "count", F.posexplode(grid[F.col("rule")]).alias("at", "cutoff"))
    rejected = F.when(F.col("over") > F.col("at"), F.col("count")).otherwise(F.lit(0))
    good, bad = F.col("good") == 1, F.col("good") == 0
    tests = cut.groupBy("stratum", "rule", "at", "cutoff").agg(
        F.sum(F.when(good, F.col("count")).otherwise(F.lit(0))).alias("n_good"),
        F.sum(F.when(good, rejected).otherwise(F.lit(0))).alias("n_false"),
        F.sum(F.when(bad, rejected).otherwise(F.lit(0))).alias("n_bad"),
    )
    tests = tests.where("n_bad > 0").withColumn("level", F.explode(F.array(*map(F.lit, LEVELS)))).where("n_false <= greatest(level, 0) * n_good")
    lenient = F.col("level") < 0
    first = F.struct("n_bad", F.when(lenient, 0).otherwise(-F.col("n_false")), F.when(lenient, F.col("cutoff")).otherwise(-F.col("cutoff")))
    chosen = tests.groupBy("stratum", "level", "rule").agg(F.max_by(F.struct("cutoff", "n_bad"), first).alias("c")).select("stratum", "level", "rule", "c.*")
    unions = chosen.groupBy("stratum", "level").agg(F.max_by("rule", F.struct("n_bad", "rule")).alias("best"), *(F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"_{r}") for r in GRID))
    unions = written(unions.select("stratum", "level", *(F.when((F.col("level") > -2) | (F.col("best") == r), F.col(f"_{r}")).alias(f"_{r}") for r in GRID)), "unions")
    small = unions.count() <= MOST_THRESHOLDS
    fails = F.lit(False)
    for r in GRID:
        fails = fails | F.coalesce(F.col(r) > F.col(f"_{r}"), F.lit(False))
    held = rows.join(F.broadcast(unions) if small else unions, "stratum").withColumn("fails", fails)
    later = F.col("half") == 1
    held = held.groupBy("stratum", "level", *(f"_{r}" for r in GRID)).agg(F.count_if(good & later).alias("n_good"), F.count_if(good & later & F.col("fails")).alias("n_false"), F.count_if(bad & F.col("fails")).alias("n_bad"))
    strata = rows.select("stratum").distinct().agg(F.count("*").alias("strata"))
    held = held.crossJoin(F.broadcast(strata)).withColumn("tail", binomial_tail(F.col("n_false"), F.col("n_good"), limit))
    certified = held.where((F.col("n_good") > 0) & (F.col("tail") <= risk / F.col("strata")))
    best = certified.groupBy("stratum").agg(F.max_by(F.struct("n_good", "n_false", "n_bad", "tail", *(f"_{r}" for r in GRID)), F.struct("n_bad", -F.col("level"))).alias("b")).select("stratum", "b.*")
    rules = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(f"_{r}").alias("cutoff")) for r in GRID))).alias("x")
    return best.select("stratum", "n_good", "n_false", "n_bad", "tail", rules).where("x.cutoff is not null").select("stratum", "x.rule", "x.cutoff", "n_good", "n_false", "n_bad", "tail")


def judged(counted: DataFrame, limits: DataFrame, stratum: str = "lang") -> DataFrame:
    """``counted`` with kept: neither the base rule nor a threshold of its stratum rejects."""
    wide = limits.groupBy("stratum").pivot("rule", list(GRID)).agg(F.first("cutoff"))
    wide = wide.select(F.col("stratum").alias("_s"), *(F.col(r).alias(f"_{r}") for r in GRID))
    small = limits.count() <= MOST_THRESHOLDS
    out = counted.join(F.broadcast(wide) if small else wide, F.coalesce(F.col(stratum).cast("string"), F.lit("")) == F.col("_s"), "left")
    fails = [F.coalesce(F.col(r) > F.col(f"_{r}"), F.lit(False)) for r in GRID]
    kept = ~F.col("base_failed")
    for f in fails:
        kept = kept & ~f
    return out.withColumn("kept", kept).drop("_s", *(f"_{r}" for r in GRID))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    counted = written(with_counts(docs).drop("text"), "counts")
    limits = written(thresholds(counted, table(spark, sf_dir, "labels")), "thresholds")
    return judged(counted, limits).select("doc_id", *COUNTS, "base_failed", "kept")
