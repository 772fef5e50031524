"""A corpus for training: toxic, odd and repeated documents go, sources are mixed, texts become tokens.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns the columns of documents, but for the
last, which returns a digest of each mixed document's tokens. Labels are read from sf_dir; they train the toxicity grammar alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattico.llm import bpe, jaccard, mixing, quality, simhash, toxicity
from lattico.llm.common import cut, table
from lattico.llm.components import united

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar learned from the labels doesn't predict as toxic.

    Null and empty texts match no clause and stay; repeated rows share a verdict. Without usable labels all stay, unless most labelled
    rows are toxic. An empty table stays empty.
    """
    scorer = toxicity.learn(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(*COLUMNS), scorer).filter(F.col("predicted") == 0).select(*COLUMNS)


def drop_odd(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null, empty and short texts have under 10 words and go. Null languages and sources are groups of their own; repeated rows count as
    often as they occur and share a verdict. An empty table stays empty.
    """
    return quality.keep_documents(docs.select(*COLUMNS))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of the smallest doc_id.

    SimHash links documents whose fingerprints differ in at most four of 64 bits, as op6_simhash does. Copies of 0.8 of the five-word
    shingles differ in some 10 bits, so the pairs that fingerprints can't show are found beside that by prefixes of the shingle sets,
    without loss; a group is what links of both lead to. Of repeated rows one stays. Null ids yield to others, and null and empty texts
    are copies of each other; one id with two texts is two documents. An empty table stays empty.
    """
    return simhash.keep_one(docs.select(*COLUMNS), near=_near)


def _near(rows: DataFrame, text: str, id_: str) -> DataFrame:
    """(id, component_id) of rows by fingerprints and by whole sets of shingles."""
    by_fingerprint = cut(simhash.near_duplicates(rows, text, id_).select(id_, "component_id"), "by-fingerprint")
    return united(by_fingerprint, jaccard.near_copies(rows, text, id_), id_)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as often as the mixture draws them; a repeated document is a repeated row.

    Null sources are one source, null texts have size 0, and equal rows are drawn alike. An empty table stays empty.
    """
    return mixing.mix(docs.select(*COLUMNS), whole=True).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row; a null text has no tokens, as an empty one."""
    return bpe.encode_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_odd),
    ("simhash near-dedup", drop_copies),
    ("mixing", mix_sources),
    ("byte-level bpe", tokenize),
]

#: Finite-state scores, determinants, fingerprints, hypergeometric draws and merges aren't SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
