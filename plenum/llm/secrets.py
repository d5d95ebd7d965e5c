"""Secret scans: a random forest over candidates takes the false positives out, in DataFrame functions only.

Candidates are runs of key characters with a letter and a digit, of 16 characters or more, or of 8 or more
behind a word such as ``password``. The forest sees a candidate's length, its character transitions, how much
of it a dictionary covers, its path, and the neighbouring words; it is trained from labelled findings. The dictionary
holds a few words of placeholders and every word of four letters or more that stands alone in five documents or
more; it is counted over all documents, for the words that occur in candidates. Scanning is one pass over whole texts in
the read tasks; only candidates, a few to a document, become rows. No candidate is dropped: each is returned with its
score and verdict.

A finding's text is returned as its SHA-256, so a report spreads no secret; ``redact`` replaces the secrets
in the texts.

Null or empty texts have no candidates. Null ids and paths are kept. Repeated rows are scanned each. ``redact`` tells
rows apart by doc_id and text, so rows without an id don't meet. Other
columns are not read by ``scan`` and pass through ``redact``. An empty table gives no rows. Findings with a null
label aren't learned from; without any of both classes training is refused.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, written

#: What a candidate is made of, and words that stand near secrets or near other keys.
RUN = r"[A-Za-z0-9+/_\-]{8,}={0,2}"
LONG = 16
NEAR_SECRET = r"(?i)(secret|token|passw|pwd|api.?key|access.?key|auth|credential|bearer|private)"
NEAR_OTHER = r"(?i)(commit|sha\d*|md5|checksum|digest|uuid|revision|version|isbn|serial|hash|order|ticket|build)"
DUMMY = r"(?i)(example|sample|your|dummy|placeholder|change.?me|test|xxxx|1234567|abcdef|foobar|lorem)"
WORDS = (
    "example sample your dummy placeholder change changeme test token secret password value here insert replace public "
    "name admin account access login index image file path page data document report version section images docs archive articles"
).split()
#: A word of a candidate, and one that stands alone in a text.
PIECE, ALONE = r"[a-z]{4,}", r"(?<![^\x20\x09-\x0D(\"'])([a-z]{4,})(?=[.,;:!?)\"']*(?:[\x20\x09-\x0D]|$))"
PATH_TEST = r"(?i)(test|example|fixture|mock|sample|doc)"
PATH_CONFIG = r"(?i)(\.env|config|settings|secrets?|credential|\.ya?ml|\.ini|\.properties)"
FEATURES = [
    "length", "digit_share", "upper_share", "lower_share", "mark_share", "transitions", "vowel_turns", "hex_share", "distinct_share", "longest_run",
    "coverage", "dummy", "path_test", "path_config", "path_like", "near_secret", "near_other", "assigned", "quoted", "after_letters",
]


def _share(text: Column, pattern: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))) / F.greatest(F.length(text), F.lit(1))


def features(before: Column, word: Column, candidate: Column, after: Column, path: Column, known: Column) -> list[Column]:
    """The forest's columns of a candidate inside ``word``, between ``before`` and ``after``, with ``known`` letters in words of the dictionary."""
    n = F.greatest(F.length(candidate), F.lit(1))
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(candidate, r"[0-9]", "0"), r"[a-z]", "a"), r"[A-Z]", "A"), r"[^0aA]", "-")
    sounds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(candidate), r"[^a-z]", ""), r"[aeiouy]", "0"), r"[a-z]", "1")
    turns = lambda c: F.length(F.regexp_replace(c, r"(.)\1+", "$1"))
    chars = F.split(candidate, "")
    near = F.concat_ws(" ", before, F.replace(word, candidate, F.lit(" ")))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    of = {
        "length": n,
        "digit_share": _share(candidate, "[0-9]+"),
        "upper_share": _share(candidate, "[A-Z]+"),
        "lower_share": _share(candidate, "[a-z]+"),
        "mark_share": _share(candidate, "[^A-Za-z0-9]+"),
        "transitions": turns(kinds) / n,
        "vowel_turns": turns(sounds) / F.greatest(F.length(sounds), F.lit(1)),
        "hex_share": _share(candidate, "[0-9a-f]+"),
        "distinct_share": F.size(F.array_distinct(chars)) / n,
        "longest_run": F.array_max(F.transform(F.split(kinds, "[^a]+"), lambda x: F.length(x))) / n,
        "coverage": known / n,
        "dummy": flag(candidate.rlike(DUMMY)),
        "path_test": flag(path.rlike(PATH_TEST)),
        "path_config": flag(path.rlike(PATH_CONFIG)),
        "path_like": flag(word.rlike(r"://|\w/\w.*/|\.\w{2,4}(/|$)")),
        "near_secret": flag(near.rlike(NEAR_SECRET)),
        "near_other": flag(near.rlike(NEAR_OTHER)),
        "assigned": flag(near.rlike(r"[:=]\W*$|[:=]")),
        "quoted": flag(word.rlike("[\"'`]")),
        "after_letters": _share(after, r"\p{L}+"),
    }
    return [of[f].cast("double").alias(f) for f in FEATURES]


def candidates(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, t (a hash of the text), at (the word's place), before (three words), word, candidate, after, path."""
    text = F.btrim(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(SPACE))
    where = F.coalesce(F.col(path).cast("string"), F.lit("")) if path else F.lit("")

    def found(words: Column) -> Column:
        def hit(i: Column) -> Column:
            w = F.get(words, i)
            long_run = w.rlike(r"[A-Za-z0-9+/_\-]{%d}" % LONG)
            behind = F.concat_ws(" ", F.slice(words, F.greatest(i - 1, F.lit(1)), F.lit(2)), F.regexp_extract(w, r"^[^:=]*[:=]", 0)).rlike(NEAR_SECRET)
            return (F.length(w) >= 8) & w.rlike("[0-9]") & w.rlike(RUN) & (long_run | ((i > 0) & behind) | w.rlike(NEAR_SECRET))

        def row(i: Column) -> Column:
            return F.struct(
                i.alias("at"),
                F.array_join(F.slice(words, F.greatest(i - 2, F.lit(1)), F.least(i, F.lit(3))), " ").alias("before"),
                F.get(words, i).alias("word"),
                F.coalesce(F.get(words, i + 1), F.lit("")).alias("after"),
            )

        return F.transform(F.filter(F.sequence(F.lit(0), F.size(words) - 1), hit), row)

    words = F.split(text, r"[\x20\x09-\x0D]+")
    rows = docs.select(F.col("doc_id").cast("long"), where.alias("path"), F.xxhash64("text").alias("t"), F.explode(F.transform(F.array(words), found)[0]).alias("x"))
    rows = rows.select("doc_id", "t", "path", "x.*", F.explode(F.regexp_extract_all("x.word", F.lit(RUN), F.lit(0))).alias("candidate"))
    return rows.where(F.col("candidate").rlike("[0-9]") & F.col("candidate").rlike("[A-Za-z]")).select("doc_id", "t", "at", "before", "word", "candidate", "after", "path")


def labelled_findings(spark: SparkSession, rows: int = 6000) -> DataFrame:
    """Findings with known labels, ``rows`` of them, drawn by rule from hashes of their numbers: before, word, candidate, after, path, is_secret.

    True ones are random keys in assignments; false ones are digests, identifiers, addresses, long words and
    placeholders, some of them in assignments too, and random keys behind words for digests.
    """
    n = F.col("id")
    pick = lambda salt, *of: F.element_at(F.array(*map(F.lit, of)), (F.pmod(F.xxhash64(n, F.lit(salt)), F.lit(len(of))) + 1).cast("int"))
    hexes = lambda salt: F.sha2(F.concat_ws("-", F.lit(salt), n), 256)
    b64 = lambda salt: F.regexp_replace(F.base64(F.unhex(hexes(salt))), r"[=\s]", "")
    size = lambda salt, c, low, high: F.substr(c, F.lit(1), (F.lit(low) + F.pmod(F.xxhash64(n, F.lit(salt)), F.lit(high - low + 1))).cast("int"))
    syllable = lambda salt: pick(salt, "tion", "ment", "er", "an", "the", "ing", "ou", "re", "st", "ver", "ung", "que", "ción", "al", "on", "heit")
    word = F.concat(*(syllable(f"w{i}") for i in range(4)))
    long_word = F.concat(*(syllable(f"l{i}") for i in range(6)), pick("ld", "1", "2", "12", "2024"))
    secret_name = pick("sn", "token", "secret", "api_key", "password", "access_key", "auth_token", "client_secret", "private_key", "credential")
    other_name = pick("on", "commit", "sha256", "md5", "checksum", "uuid", "revision", "digest", "build", "order", "ticket")
    # (weight, label, name before, candidate, form)
    kinds = [
        (6, 1, secret_name, F.substr(hexes("a"), F.lit(1), F.lit(40))),
        (2, 1, secret_name, size("b", hexes("b"), 32, 64)),
        (4, 1, secret_name, size("c", b64("c"), 20, 43)),
        (2, 1, secret_name, F.concat(pick("pre", "ghx_", "sk-live-", "xk-", "AKIZ", "pat_"), size("d", b64("d"), 16, 36))),
        (1, 1, secret_name, size("e", b64("e"), 10, 15)),
        (3, 0, other_name, F.substr(hexes("f"), F.lit(1), F.lit(40))),
        (2, 0, other_name, size("g", hexes("g"), 32, 64)),
        (1, 0, other_name, size("gb", b64("gb"), 20, 43)),
        (2, 0, other_name, F.concat_ws("-", *(F.substr(hexes("h"), F.lit(a), F.lit(k)) for a, k in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))),
        (3, 0, word, long_word),
        (2, 0, word, F.concat(pick("p1", "/images/", "/docs/v2/", "/archive/2023/", "articles/"), long_word)),
        (2, 0, secret_name, F.concat(pick("ph", "your_token_here_", "example_key_", "changeme-please-", "test-password-", "sample_secret_value_"), pick("pn", "1", "123", "0000", "2024"))),
        (1, 0, secret_name, F.concat(pick("xx", "xxxxxxxxxxxxxxxx", "abcdef1234567890", "aaaaaaaaaaaaaaaaaaaa"), pick("xn", "1", "00", "7"))),
    ]
    total, at, spread = sum(k[0] for k in kinds), 0, None
    case = F.pmod(F.xxhash64(n, F.lit("kind")), F.lit(total))
    for weight, label, name, candidate in kinds:
        at += weight
        value = F.struct(F.lit(label).alias("is_secret"), name.alias("name"), candidate.alias("candidate"))
        spread = F.when(case < at, value) if spread is None else spread.when(case < at, value)
    form = pick("form", "spaced", "colon", "joined", "plain")
    quote = pick("q", '"', '"', "'", "")
    d = spark.range(rows).select("id", spread.alias("k"), form.alias("form"), quote.alias("q"), word.alias("w1"), syllable("w9").alias("w2"), pick("path", "", "", "src", "app/config.yml", "tests/test_app.py", "docs/readme.md").alias("path"))
    c, name = F.col("k.candidate"), F.col("k.name")
    quoted = F.concat("q", c, "q")
    before = F.when(F.col("form") == "spaced", F.concat_ws(" ", "w2", name, F.lit("="))).when(F.col("form") == "colon", F.concat_ws(" ", "w1", "w2", F.concat(name, F.lit(":"))))
    before = before.when(F.col("form") == "joined", F.concat_ws(" ", "w1", "w2", "w1")).otherwise(F.concat_ws(" ", "w1", "w2", name))
    whole = F.when(F.col("form") == "joined", F.concat(name, F.lit("="), quoted)).when(F.col("form") == "plain", c).otherwise(quoted)
    return d.select(before.alias("before"), whole.alias("word"), c.alias("candidate"), F.col("w1").alias("after"), "path", F.col("k.is_secret").alias("is_secret"))


def known_words(found: list[DataFrame], docs: DataFrame | None, least: int = 5) -> DataFrame:
    """word: those words of the candidates in ``found`` that the dictionary holds: of ``WORDS``, or alone in ``least`` or more of ``docs`` (text)."""
    own = [f.select(F.explode(F.regexp_extract_all(F.lower("candidate"), F.lit(PIECE), F.lit(0))).alias("word")) for f in found]
    asked = written(reduce(DataFrame.union, own).distinct(), "asked")
    base = F.array(*map(F.lit, WORDS))
    known = asked.where(F.array_contains(base, F.col("word")))
    if docs is not None:
        # Only the asked words leave the rows; a text counts a word once.
        alone = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.col("text").cast("string")), F.lit(ALONE), F.lit(1)))).alias("word"))
        common = alone.join(asked, "word", "left_semi").groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("word")
        known = known.union(common).distinct()
    return written(known, "words")


def _covered(found: DataFrame, words: DataFrame) -> DataFrame:
    """``found`` with ``known``: how many of a candidate's letters lie in ``words``."""
    own = found.select("candidate").distinct().select("candidate", F.explode(F.regexp_extract_all(F.lower("candidate"), F.lit(PIECE), F.lit(0))).alias("word"))
    known = own.join(words, "word").groupBy("candidate").agg(F.sum(F.length("word")).alias("known"))
    return found.join(written(known, "covered"), "candidate", "left").withColumn("known", F.coalesce("known", F.lit(0)))


def _vectors(found: DataFrame, words: DataFrame, *keep: str) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    cols = [F.coalesce(F.col(c), F.lit("")) for c in ("before", "word", "candidate", "after", "path")]
    d = _covered(found, words)
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(d.select(*keep, *features(*cols, F.col("known")))).select(*keep, "features")


def train(findings: DataFrame, words: DataFrame, trees: int = 30, depth: int = 9, seed: int = 7):
    """A forest from findings (before, word, candidate, after, path, is_secret), such as ``labelled_findings``, and the dictionary's ``words``."""
    from pyspark.ml.classification import RandomForestClassifier

    found = findings.where("is_secret in (0, 1)").withColumn("label", F.col("is_secret").cast("double"))
    rows = _vectors(found, words, "label", "word", "candidate")
    if rows.select("label").distinct().count() < 2:
        raise ValueError("findings of both labels are needed")
    # Sorted and written, so that the forest doesn't follow the order in which rows arrive.
    rows = written(rows.orderBy("candidate", "word", "label").select("label", "features"), "findings")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird").fit(rows)


def judge(found: DataFrame, forest, words: DataFrame, cutoff: float = 0.5) -> DataFrame:
    """doc_id, t, at, candidate, score, is_secret of ``candidates``."""
    from pyspark.ml.functions import vector_to_array

    judged = forest.transform(_vectors(found, words, "doc_id", "t", "at", "candidate"))
    score = F.round(F.get(vector_to_array("probability"), F.lit(1)), 6)
    return judged.select("doc_id", "t", F.col("at").cast("long").alias("at"), "candidate", score.alias("score"), (score >= cutoff).alias("is_secret"))


def scan(docs: DataFrame, findings: DataFrame, path: str | None = None, **how) -> DataFrame:
    """The verdict on every candidate in ``docs`` (doc_id, text, and the column ``path``), by a forest trained from ``findings``; one dictionary serves both."""
    found = written(candidates(docs, path), "candidates")
    words = known_words([findings, found], docs)
    return judge(found, train(findings, words, **how), words)


def redact(docs: DataFrame, found: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with the secrets that were ``found`` in them replaced, all other columns as they are."""
    key, text, keys = (f"_found{i}" + "_" * max(map(len, docs.columns)) for i in (0, 1, 2))  # longer than any column's name
    own = found.where("is_secret").groupBy(F.col("doc_id").alias(key), F.col("t").alias(text)).agg(F.collect_set("candidate").alias(keys))
    # Longest first, so that a secret inside another one leaves no rest.
    own = own.withColumn(keys, F.reverse(F.array_sort(F.transform(keys, lambda c: F.struct(F.length(c).alias("n"), c.alias("c"))))))
    # Written, so that Spark sends it to the texts if it is small by its files' size.
    d = docs.join(written(own, "secrets"), docs["doc_id"].cast("long").eqNullSafe(F.col(key)) & (F.xxhash64(docs["text"]) == F.col(text)), "left")
    clean = F.aggregate(keys, F.col("text"), lambda t, c: F.replace(t, c["c"], F.lit(mark)))
    return d.withColumn("text", F.when(F.col(keys).isNotNull(), clean).otherwise(F.col("text"))).select(*(F.col(f"`{c}`") for c in docs.columns))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    found = scan(docs, labelled_findings(spark), "source")
    return found.select("doc_id", "at", F.length("candidate").alias("length"), F.sha2("candidate", 256).alias("candidate_sha256"), "score", "is_secret")
