"""A corpus pipeline over documents: five stages, each written as Parquet and read again as the next one's input.

Rows are judged one by one, but for near duplicates. Null and empty texts pass all stages; null ids too. Repeated rows stay, but for those with words, of
which near duplicates leave one. Columns beside those of documents stay as they are, but where a stage's operator returns a column of that name and
the pipeline keeps it (the last stage's). Empty tables give empty tables. Near duplicates are those of five words and 0.8, the rule for such stages; the operator's
query takes three and 0.9, as its contract says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontamination, ngram_join, pii, sentencepiece_sampling, toxicity
from tidemark.llm.common import Steps, cut, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under the threshold; learnt from this stage's documents and the labels."""
    model = toxicity.train_on(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where(F.col("score") < toxicity.THRESHOLD).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked ones (five-word shingles, similarity of 0.8 or more), decided per row: the one with the least
    doc_id (nulls last), then the least hash of its text, then, of rows equal in both, the least by all columns. A doc_id with
    several texts can lose some and keep others. Rows without words are linked with nothing and all stay."""
    identity = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64("text").alias("rank"))
    groups = ngram_join.join_groups(docs.select(identity.alias("_row"), "text"), "_row").where("n_shingles > 0")
    # rows to remove, and rows to keep once; an identity has one text, so it has one component
    marks = groups.groupBy("_row").agg(F.first("component_id").alias("_kept"), F.count("*").alias("_copies")).where("_row != _kept OR _copies > 1")
    marks = cut(marks.select("_row", (F.col("_row") == F.col("_kept")).alias("_once")), "marks")
    rows = docs.select(identity.alias("_row"), F.struct(*docs.columns).alias("_all"))
    once = rows.join(marks.where("_once"), "_row", "left_semi").groupBy("_row").agg(F.min("_all").alias("_all"))
    return rows.join(marks, "_row", "left_anti").select("_all.*").unionByName(once.select("_all.*"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind in brackets, n_chars those of the new text."""
    masked = pii.find(docs, pii.train(docs), masked="text")
    return masked.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("bigint"))).select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their sampled pieces."""
    return sentencepiece_sampling.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("PII", mask_personal_data),
    ("SentencePiece encoding and decoding", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's output is a table in the shared scratch folder, deleted when the next one's is written."""
    steps, docs = Steps(spark), table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = steps.cut(stage(spark, docs, sf_dir), f"stage-{name.split()[0].lower()}")
        steps.drop_all_but(docs)
    return docs


#: The learnt stages aren't expressible in SQL.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
