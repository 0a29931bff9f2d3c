"""A corpus pipeline over `documents`: each stage reads what its predecessor kept.

Counted as part of the subpackage codeloom.llm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.decontaminate import decontaminate
from codeloom.llm.jaccard import jaccard_dedup
from codeloom.llm.pieces import encode_decode, model_file
from codeloom.llm.quality import quality_rules
from codeloom.llm.substring import substring_dedup
from codeloom.llm._tables import discard, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: What a stage that makes new texts carries besides them; the old text is not sent along.
REST = ["doc_id", "lang", "source"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null and empty texts have too few words and go. Repeated rows are judged alike. An empty table
    stays empty; columns besides those of documents are dropped.
    """
    return quality_rules(docs, keep=COLUMNS).filter("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of least doc_id (null ids last).

    Documents without a word stay, null texts included. Of fully equal rows one stays, and so does
    an empty table; columns besides those of documents are dropped.
    """
    return jaccard_dedup(docs.select(*COLUMNS))


def _with_text(out: DataFrame) -> DataFrame:
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of windows that stand elsewhere too; every document stays.

    A text that loses words has the others joined by one space (none: an empty text), any other is
    unchanged, null included. Repeated rows lose each other's windows. n_chars is counted anew
    (null for null); an empty table stays empty.
    """
    return _with_text(substring_dedup(docs, keep=REST, digests=False, kept_text="text"))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of benchmark windows; every document stays.

    Hit words go with what stands between two of them; other texts are unchanged, null included.
    Repeated rows are cut alike. n_chars is counted anew; an empty table stays empty.
    """
    return _with_text(decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=REST, cut="text"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the text they decode to (null is encoded as empty)."""
    return encode_decode(docs, model_file(), keep=REST)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", substrings),
    ("benchmark decontamination", benchmark),
    ("SentencePiece encoding and decoding", pieces),
]

#: SQL can't segment words as SentencePiece does; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
