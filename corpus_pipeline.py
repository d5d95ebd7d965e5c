"""The training-data pipeline: quality rules, line dedup, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns the columns of documents, but for the last, which returns
the packed pieces. ``run`` writes each stage's rows as Parquet to the shared folder and reads them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.llm import line_dedup, packing, quality_rules, secrets, simhash_texts
from plenum.llm.common import table, written
from plenum.shared import scratch, shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents; n_chars follows the text."""
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go.

    Null and empty texts have no words, so they fail the base rule. Rows without an id are judged by their counts; labels of theirs don't count. Of repeated
    rows each is judged. Long texts are counted whole. An empty table gives no rows; columns beyond those of documents go.
    """
    labels = table(spark, sf_dir, "labels")
    # Written with the texts: counting costs far more than writing, and the thresholds read only the counts.
    counted = written(quality_rules.with_counts(docs.select(*COLUMNS)), "counted")
    limits = written(quality_rules.thresholds(counted, labels), "thresholds")
    return quality_rules.judged(counted, limits).where("kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Frequent lines stay in one document; every document stays.

    A null text becomes an empty one. Rows without an id hold no lines for others and lose none. Rows that repeat an id count as one document of it. Texts are read whole, of any
    length. An empty table gives no rows; columns beyond those of documents go.
    """
    index = line_dedup.LineIndex(spark)
    index.insert(docs)
    return _documents(index.clean(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word Jaccard similarity of 0.8 or more the one with the smallest id stays; documents without an id stay.

    Rows that repeat the id of the one that stays are the same document, and all stay. Null and empty texts have equal, empty shingle sets. Ties go to
    the smaller id. Texts are compared whole. An empty table gives no rows; columns beyond those of documents go.
    """
    gone = simhash_texts.near_duplicates(docs).where("doc_id <> keeper").select("doc_id", "t").distinct()
    return docs.withColumn("t", F.xxhash64("text")).join(gone, ["doc_id", "t"], "left_anti").select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; every document stays.

    Null and empty texts hold none and stay as they are. Rows without an id are changed too, told apart by their texts. Repeated rows are changed alike. Long texts
    are scanned whole. An empty table gives no rows; columns beyond those of documents go.
    """
    found = secrets.scan(docs, secrets.labelled_findings(spark), "source")
    return _documents(secrets.redact(docs, found))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece, with its ids.

    A null or empty text is the end id alone. Rows without an id, and rows that repeat one, are documents of their own. Long texts are cut into as many pieces as they
    need. An empty table gives no rows; of the columns only the id is kept.
    """
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("simhash_near_dedup", near_duplicates), ("secret_scan", secret_scan), ("packing", pack)]
#: The stages hash, train and tokenise, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_folder(spark, name)
        # A stage's own tables go once its rows are written.
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
