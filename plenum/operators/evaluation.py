"""Error rates, verification curves, term recall, splits."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.functions.cleaning import normal_form

from .windows import prefix_sums


def held_out(key: str, share: float) -> Column:
    """A split by the key's MD5, so that all rows of a key fall on one side, wherever the split is made."""
    return F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long") % 1000 < int(share * 1000)


def unseen(rows: DataFrame, used: DataFrame, key: str, n: int) -> DataFrame:
    """``n`` rows, in the order of their key's MD5, of those whose key is not among the ``used`` ones; null keys don't count."""
    pool = rows.where(F.col(key).isNotNull()).join(used.select(key), key, "left_anti")
    return pool.orderBy(F.md5(F.col(key).cast("string")), key).limit(n)


def word_distance(ref: Column, hyp: Column) -> Column:
    """Edit distance over words, with any number of different words; null if a text is null."""

    def run(refs: pd.Series, hyps: pd.Series) -> pd.Series:
        words = lambda t: [w for w in re.split(r"[ \t\n\x0b\f\r]+", t) if w]
        return pd.Series([None if r is None or h is None else edit_distance(words(r), words(h)) for r, h in zip(refs, hyps)], dtype="Int64")

    return F.pandas_udf(run, "int")(ref, hyp)


def edit_distance(ref, hyp) -> int:
    """Levenshtein distance of two sequences, whole and exact: one column of the table as bits of an integer, memory in proportion to ``ref``."""
    low, high = 0, min(len(ref), len(hyp))
    while low < high and ref[low] == hyp[low]:
        low += 1
    end = 0
    while end < high - low and ref[-1 - end] == hyp[-1 - end]:
        end += 1
    ref, hyp = ref[low : len(ref) - end], hyp[low : len(hyp) - end]
    if not ref or not hyp:
        return len(ref) + len(hyp)
    places: dict = {}
    for i, x in enumerate(ref):
        places.setdefault(x, []).append(i)
    masks = {}
    for x, at in places.items():
        bits = bytearray(len(ref) // 8 + 1)
        for i in at:
            bits[i >> 3] |= 1 << (i & 7)
        masks[x] = int.from_bytes(bits, "little")
    full, last, cost = (1 << len(ref)) - 1, len(ref) - 1, len(ref)
    up, down = full, 0
    for x in hyp:
        eq = masks.get(x, 0)
        zero = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | (full & ~(zero | up)), up & zero
        cost += (plus >> last & 1) - (minus >> last & 1)
        plus, minus = (plus << 1 | 1) & full, (minus << 1) & full
        up, down = minus | (full & ~(zero | plus)), plus & zero
    return cost


def page_text(text: str | None) -> str:
    """A page without the marks of tables (raised characters, separators, bars) and the dots of contents, with single blanks."""
    t = re.sub(r"\\\(\^\{+([^{}]*)\}+\\\)", r"\1", text or "")
    t = re.sub(r"(?m)^\s*\|[\s:|-]+\|\s*$", "", t).replace("|", " ")
    return " ".join(re.sub(r"[·.]{2,}", " ", t).split())


def page_errors(pairs: DataFrame) -> DataFrame:
    """The group, char_errors, chars, word_errors, words of ``pairs`` (group, ref, hyp): whole texts after ``page_text``; an empty reference counts nothing."""
    group = pairs.schema["group"].dataType.simpleString()

    def run(batches):
        for rows in batches:
            out = []
            for g, ref, hyp in zip(rows["group"], rows["ref"], rows["hyp"]):
                ref, hyp = page_text(ref), page_text(hyp)
                a, b = ref.split(), hyp.split()
                out.append([g, edit_distance(ref, hyp), len(ref), edit_distance(a, b), len(a)] if ref else [g, 0, 0, 0, 0])
            yield pd.DataFrame(out, columns=["group", "char_errors", "chars", "word_errors", "words"])

    return pairs.select("group", "ref", "hyp").mapInPandas(run, f"`group` {group}, char_errors long, chars long, word_errors long, words long")


def corpus_rate(errors: str, total: str) -> Column:
    """A micro average: all errors over all reference units."""
    return F.sum(errors) / F.greatest(F.sum(total), F.lit(1))


def occurrences(text: Column, term: Column) -> Column:
    """How often ``term`` occurs without overlap."""
    return F.when(F.length(term) > 0, (F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).otherwise(F.lit(0)).cast("long")


def curve(trials: DataFrame, score: str, label: str, tie: str) -> DataFrame:
    """far and frr of each threshold: the trials from the best score down to this one are accepted."""
    d = trials.where(F.col(score).isNotNull()).withColumns({"pos": F.col(label).cast("long"), "neg": (1 - F.col(label)).cast("long")})
    total = d.agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    d = prefix_sums(d, score, tie, ["pos", "neg"]).crossJoin(F.broadcast(total))  # one row
    return d.withColumns({"frr": 1 - F.try_divide(F.col("cum_pos").cast("double"), F.col("n_pos").cast("double")), "far": F.try_divide(F.col("cum_neg").cast("double"), F.col("n_neg").cast("double"))})


def equal_error_rate(points: DataFrame, tie: str) -> DataFrame:
    """eer: the mean of both rates where they are nearest; of equal gaps the first threshold."""
    best = F.min_by(F.struct("far", "frr"), F.struct(F.round(F.abs(F.col("far") - F.col("frr")), 12), F.col("cum_pos") + F.col("cum_neg")))
    return points.agg(best.alias("b")).select(((F.col("b.far") + F.col("b.frr")) / 2).alias("eer"))


def min_cost(points: DataFrame, prior: float = 0.01) -> DataFrame:
    cost = prior * F.col("frr") + (1 - prior) * F.col("far")
    return points.agg((F.min(cost) / min(prior, 1 - prior)).alias("min_dcf"))


def align(ref: list[str], hyp: list[str]) -> list[tuple[str, int, int]]:
    """Edit operations (equal, substitute, delete, insert) with the words' places.

    Of equally short ways the one that, from the end on, pairs words before it deletes and deletes before it inserts.
    Memory grows with the product of the lengths: a byte for each pair of words.
    """
    n, m = len(ref), len(hyp)
    words = {w: k for k, w in enumerate(dict.fromkeys(hyp))}
    b, steps = np.array([words[w] for w in hyp], int), np.arange(m + 1)
    # moves[i, j]: how the best way reaches (i, j).
    moves, row = np.full((n + 1, m + 1), 2, np.uint8), steps.copy()
    for i, word in enumerate(ref, 1):
        pair = np.append(row[0] + n + m + 2, row[:-1] + (b != words.get(word, -1)))
        best = np.minimum(pair, row + 1)
        best = np.minimum.accumulate(best - steps) + steps
        moves[i] = np.where(best == pair, 0, np.where(best == row + 1, 1, 2))
        row = best
    out, i, j = [], n, m
    while i or j:
        move = moves[i, j]
        i, j = i - (move != 2), j - (move != 1)
        out.append(("delete" if move == 1 else "insert" if move == 2 else "equal" if ref[i] == hyp[j] else "substitute", int(i), int(j)))
    return out[::-1]


def aligned(pairs: DataFrame) -> DataFrame:
    """id, at, op, ref_word, hyp_word of ``pairs`` (id, ref, hyp): the edit operations between both texts' normal forms."""

    def run(batches):
        for rows in batches:
            out = []
            for r in rows.itertuples():
                ref, hyp = normal_form(r.ref).split(), normal_form(r.hyp).split()
                for at, (op, i, j) in enumerate(align(ref, hyp)):
                    out.append((r.id, at, op, None if op == "insert" else ref[i], None if op == "delete" else hyp[j]))
            yield pd.DataFrame(out, columns=["id", "at", "op", "ref_word", "hyp_word"])

    return pairs.select("id", "ref", "hyp").mapInPandas(run, "id long, at int, op string, ref_word string, hyp_word string")


def biased_errors(operations: DataFrame, terms: list[str]) -> DataFrame:
    """id, term_errors, term_words, other_errors, other_words, invented of ``aligned`` operations.

    A word belongs to the terms if it holds one, as particles are attached to it. An inserted word counts by itself;
    inserted terms are ``invented``.
    """
    wanted = [t for t in (normal_form(x).replace(" ", "") for x in terms) if t]
    ins, wrong = F.col("op") == "insert", F.col("op") != "equal"
    word = F.when(ins, F.col("hyp_word")).otherwise(F.col("ref_word"))
    term = F.exists(F.array(*map(F.lit, wanted)), lambda t: F.contains(word, t)) if wanted else F.lit(False)
    d = operations.withColumn("_term", term)
    term = F.col("_term")
    return d.groupBy("id").agg(
        F.count_if(term & wrong).alias("term_errors"),
        F.count_if(term & ~ins).alias("term_words"),
        F.count_if(~term & wrong).alias("other_errors"),
        F.count_if(~term & ~ins).alias("other_words"),
        F.count_if(term & ins).alias("invented"),
    )


def term_recall(ref: Column, hyp: Column, terms: list[str]) -> Column:
    """struct<expected, found>: how often the terms occur in ``ref``, and how many of these in ``hyp`` too; blanks don't count. Texts in normal form."""
    a, b = (F.replace(F.coalesce(x, F.lit("")), F.lit(" "), F.lit("")) for x in (ref, hyp))
    own = [occurrences(a, F.lit(t)) for t in (normal_form(x).replace(" ", "") for x in terms)]
    both = [F.least(occurrences(a, F.lit(t)), occurrences(b, F.lit(t))) for t in (normal_form(x).replace(" ", "") for x in terms)]
    zero = F.lit(0).cast("long")
    return F.struct(sum(own, zero).alias("expected"), sum(both, zero).alias("found"))


def z_scores(rows: DataFrame, key: str, score: str) -> DataFrame:
    """key, top, margin, z: the best score, its lead over the next, and its distance from the others' mean in their deviations; z is 0 for fewer than two others."""
    from pyspark.sql import Window

    d = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score))))
    rest = lambda f: f(F.when(F.col("_n") > 1, F.col(score)))
    g = d.groupBy(key).agg(F.max(score).alias("top"), rest(F.max).alias("_next"), rest(F.avg).alias("_mean"), rest(F.stddev_pop).alias("_dev"), rest(F.count).alias("_k"))
    z = F.when(F.col("_k") >= 2, (F.col("top") - F.col("_mean")) / (F.col("_dev") + 1e-6)).otherwise(F.lit(0.0))
    return g.select(key, "top", F.coalesce(F.col("top") - F.col("_next"), F.lit(0.0)).alias("margin"), z.alias("z"))


def resampled(rows: DataFrame, key: str, sums: list[str], draws: int = 10_000) -> DataFrame:
    """draw and the ``sums`` of integer columns in each of ``draws`` resamples.

    Each row counts a Poisson number of times in a draw. Rows with equal sums are drawn at once: together they count a Poisson
    number of times whose mean is how many they are, so the work follows the different values. The generator is that of the values and the
    least key: the result depends neither on the partitioning nor on the order. Tasks add their rows up; a row for each draw leaves them.
    """

    def run(batches):
        total = np.zeros((len(sums), draws), np.int64)
        for batch in batches:
            for seed, rows, *values in zip(batch["_k"], batch["_n"], *(batch[s] for s in sums)):
                times = np.random.default_rng(seed & (1 << 64) - 1).poisson(float(rows), draws)
                total += times * np.array(values, np.int64)[:, None]
        yield pd.DataFrame({"draw": np.arange(draws), **dict(zip(sums, total))})

    d = rows.select(F.xxhash64(key).alias("_k"), *(F.coalesce(F.col(s).cast("long"), F.lit(0)).alias(s) for s in sums))
    d = d.groupBy(*sums).agg(F.count("*").alias("_n"), F.min("_k").alias("_k")).withColumn("_k", F.xxhash64("_k", *sums))
    part = d.mapInPandas(run, ", ".join(["draw long", *(f"{s} long" for s in sums)]))
    return part.groupBy("draw").agg(*(F.sum(s).alias(s) for s in sums))


def bootstrap(rows: DataFrame, key: str, errors: str, total: str, draws: int = 10_000) -> DataFrame:
    """low, high: a 95 % interval of the micro average of ``rows``."""
    d = resampled(rows, key, [errors, total], draws).select((F.col(errors) / F.greatest(F.col(total), F.lit(1))).alias("rate"))
    return d.agg(F.percentile("rate", 0.025).alias("low"), F.percentile("rate", 0.975).alias("high"))


def paired_bootstrap(rows: DataFrame, key: str, a: tuple[str, str], b: tuple[str, str], draws: int = 10_000) -> DataFrame:
    """point, low, high, p: the difference of two systems' rates (errors, total) over the same rows, both resampled alike; p is two-sided."""
    rate = lambda x: F.col(x[0]) / F.greatest(F.col(x[1]), F.lit(1))
    d = resampled(rows, key, list(dict.fromkeys([*a, *b])), draws).select((rate(a) - rate(b)).alias("d"))
    ends = d.agg(F.percentile("d", 0.025).alias("low"), F.percentile("d", 0.975).alias("high"), F.avg((F.col("d") <= 0).cast("double")).alias("_l"), F.avg((F.col("d") >= 0).cast("double")).alias("_h"))
    point = rows.agg((corpus_rate(*a) - corpus_rate(*b)).alias("point"))
    # One row each.
    return point.crossJoin(ends).select("point", "low", "high", F.least(F.lit(1.0), 2 * F.least("_l", "_h")).alias("p"))


def speaker_trials(rows: DataFrame, session: str, speaker: str, item: str, partners: int = 2) -> DataFrame:
    """label, a, b: each item meets the ``partners`` next ones of its session in the order of their MD5; label 1 for one speaker."""
    from pyspark.sql import Window

    w = Window.partitionBy(session).orderBy(F.md5(F.col(item).cast("string")), item)
    cols = [F.struct(F.lead(item, k).over(w).alias("b"), F.lead(speaker, k).over(w).alias("s")) for k in range(1, partners + 1)]
    d = rows.select(session, F.col(item).alias("a"), F.col(speaker).alias("_s"), F.array(*cols).alias("next"))
    d = d.select(session, "a", "_s", F.explode("next").alias("x"))
    return d.where("x.b is not null").select(session, "a", F.col("x.b").alias("b"), (F.col("_s") == F.col("x.s")).cast("int").alias("label"))
