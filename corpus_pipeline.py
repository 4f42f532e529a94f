"""From raw documents to packed training sequences, stage by stage.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and
returns the columns of documents, but for the last, which returns the packed pieces.
``run`` writes each stage's rows as Parquet in the shared folder and reads them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epigrid.llm.common import Workspace
from epigrid.llm.language_id import known_language
from epigrid.llm.line_dedup import drop_boilerplate
from epigrid.llm.mixing import mixed_documents
from epigrid.llm.near_dedup import without_near_duplicates
from epigrid.llm.packing import pack_documents
from epigrid.llm.tokens import default_vocabulary


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those without letters, or unlike any, go."""
    return known_language(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of each source taken out; n_chars follows the text."""
    clean = drop_boilerplate(docs.withColumnsRenamed({"removed_lines": "_own_removed_lines"}), host="source", ratio=0.1, least_pages=3)
    clean = clean.drop("removed_lines").withColumnsRenamed({"_own_removed_lines": "removed_lines"})
    clean = clean.withColumn("n_chars", F.length("text").cast("long"))
    return clean.select(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near-duplicates."""
    return without_near_duplicates(docs, width=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, at most twice."""
    return mixed_documents(docs, weights=(5, 2, 1), share=1.5, repeats=2)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their sequence and offset."""
    return pack_documents(docs, default_vocabulary(), capacity=2048, end_id=0)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("mix", mix), ("pack", pack)]

#: Language identification and packing are not SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = Workspace(spark, f"pipeline-{name}").result(stage(spark, docs, sf_dir))
    return docs
