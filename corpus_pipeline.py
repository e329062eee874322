"""The corpus pipeline: language ID, near-duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``docs``. ``run`` writes every stage to the shared folder and reads it back for the next.

Rows travel as one struct, so extra columns may have any names. Defined cases, for each stage:

* language ID: a document with a null text, without letters or that no language claims goes; with no labels to learn from, all go.
* near-duplicates: groups are of rows, by text; of a group stays the row of the smallest id, one without an id only if none has one, and
  one of several equal ones. A text without words is in no group and stays.
* decontamination: a null text has no hits and stays; an empty benchmark drops nothing.
* mixing: a row comes as often as it is taken, rows that repeat an id each for themselves; a null source is a source.
* sharding: a null id is a key like others; repeated rows take a slot each.

An empty table gives an empty table at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkfold.llm import decontamination, language_id, mixing, setsketch, sharding
from larkfold.llm.common import cut, table, whole_row

#: A document whose best language scores below this is claimed by no language.
MIN_LANGUAGE_SCORE = 0.25


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: no letters, or no language that claims them."""
    named = language_id.identify(docs, language_id.fit_language_model(docs), key=None)
    return named.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SCORE)).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each group stays, one without an id only if none has one. Rows with one id are told apart by a hash of 96 bits of all
    columns (but maps, which have none); of equal rows one stays."""
    columns = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind]
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.xxhash64(*columns).alias("long"), F.hash(*columns).alias("short"))
    rows = docs.select(rank.alias("rank"), F.col("text").alias("text"))
    kept = setsketch.near_duplicates(rows, key="rank").where("kept").groupBy("rank").agg((F.count("*") > 1).alias("several"))
    met = docs.select(rank.alias("rank"), whole_row(docs)).join(cut(kept, "pipeline-kept"), "rank")
    once = met.where("several").dropDuplicates(["rank"])  # only rows that repeat travel for this
    return met.where("not several").unionByName(once).select("row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    scanned = decontamination.scan_documents(docs, table(spark, sf_dir, "benchmark"), key=None)
    return scanned.where(F.size("word_spans") == 0).select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in the order of the mix."""
    return mixing.mix_sources(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every row."""
    return sharding.shard_documents(docs)


STAGES = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("sharding", shard),
]

#: String kernels and sketches can't be put in SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
