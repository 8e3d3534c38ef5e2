"""A pipeline over ``documents``: each stage reads what the stage before has kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir). ``run`` writes each
stage's rows as Parquet to the shared folder and reads them again for the next stage; what a stage
has read goes once its own rows are written.

Every stage takes the columns of documents and ignores others. Empty tables stay empty; rows with a
null doc_id or text are judged by each operator's own rules, given with the stages. Rows that are
equal throughout are one document: they stay or go together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.linededup import dedup_lines
from lectern.llm.minhash import near_duplicates
from lectern.llm.mixing import mixed
from lectern.llm.pieces import encode_n_best
from lectern.llm.shared import discard, settled, table
from lectern.llm.toxicity import score_toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is under 0.7; null and empty texts score the share of toxic labels and stay, unless that is 0.7."""
    return score_toxicity(docs.select(*COLUMNS), table(spark, sf_dir, "labels")).where("toxicity < 0.7").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated lines, with their new lengths; a document all of whose text was repeated goes. Null and empty texts stay."""
    rows = dedup_lines(docs.select(*COLUMNS))
    rows = rows.where((F.col("n_removed") == 0) | F.col("n_removed").isNull() | F.col("text").rlike(r"[^ \t\r\n]"))
    return rows.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates; texts without words, and a null doc_id, stay."""
    kept = near_duplicates(docs, percent=80).where("kept").select(F.col("doc_id").alias("__id")).distinct()
    docs = docs.select(*COLUMNS)
    return docs.join(kept.hint("merge"), docs["doc_id"].eqNullSafe(F.col("__id")), "left_semi")


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the fitted rates of their domains ask for. A text without words has the rate of the prior; equal documents have equal rates."""
    return mixed(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of the best segmentation, with the scores of the four best; nulls for a null text, no ids for an empty one."""
    made = encode_n_best(docs.select("doc_id", "lang", "source", "text"), n=4)
    return made.select("doc_id", "lang", "source", "ids", F.size("ids").alias("n_pieces"), "scores", "round_trip")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("minhash_near_dedup", drop_near_duplicates),
    ("mixing", mix_domains),
    ("sentencepiece", encode_pieces),
]

#: SQL can express neither the classifier nor the piece search; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, read = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(*read)
        read = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
