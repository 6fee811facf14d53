"""Corpus cleaning in five stages; each works on all that the one before it kept."""

from __future__ import annotations

import hashlib
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from twinfold.common import exists, files_below, get_text, put_text, remove, scratch, ship, table
from twinfold.llm import bpe, decontam, langid, simhash, toxicity
from twinfold.llm.queries import tokenizer_file
from twinfold.llm.sampling import remainder

#: Probability from which a document counts as toxic and goes.
TOXIC = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a letter, whether or not a language could be learned."""
    model = langid.fit(docs.filter(remainder("doc_id", 5) != 0))
    if not model.langs:
        # One language without words: every text with a letter is of it.
        model = langid.Model(["any"], table=np.zeros((1, 1)))
    told = langid.predict(docs, model, lang="_lang_pred", score="_lang_score", keep_text=True)
    return told.filter(F.col("_lang_pred") != langid.UNDETERMINED).select(*docs.columns)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic."""
    labels = table(spark, sf_dir, "labels").filter(remainder("doc_id", 5) != 0)
    scored = toxicity.score(docs, toxicity.fit(docs, labels), out="_toxic_score", keep_text=True)
    return scored.filter(F.col("_toxic_score") < TOXIC).select(*docs.columns)


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.deduplicate(docs)


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What each document encodes to, checked by decoding."""
    path = tokenizer_file()
    coded = bpe.encode(docs.select("doc_id", "text"), path, decoded="decoded", keep_text=False)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), bpe.ids_digest(F.col("ids")).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language", language), ("toxicity", clean), ("near_duplicates", unique), ("decontamination", unseen), ("tokens", tokens)]

#: Trained models and fingerprints are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


#: Tables that the stages read.
TABLES = ("documents", "labels", "benchmark")


def told_by(spark: SparkSession, sf_dir: str) -> str:
    """A digest of the tables' files, with their lengths and times of change, and of the code of the stages."""
    here = Path(__file__).resolve().parent
    code = sorted([Path(__file__), *(here / "twinfold").rglob("*.py")])
    state = [[files_below(spark, f"{sf_dir}/{t}.parquet") for t in TABLES], TOXIC, [name for name, _ in STAGES], [hashlib.sha256(p.read_bytes()).hexdigest() for p in code]]
    return hashlib.sha256(repr(state).encode()).hexdigest()


def run(spark: SparkSession, sf_dir: str, at: str | None = None) -> DataFrame:
    """Applies the stages to ``documents``; what each returns is written to the shared folder and read again.

    A stage's folder is deleted when the next is written. With a folder of the caller's, ``at``, a run that failed
    goes on after the last stage that it finished, if that was of the same tables, unchanged, and the same code; else the folder is
    deleted when the driver ends.
    """
    ship(spark)
    docs, folder = table(spark, sf_dir, "documents"), at or scratch(spark, "pipeline")
    told = told_by(spark, sf_dir) if at else ""
    done = [k for k in range(len(STAGES)) if at and exists(spark, f"{folder}/{k}/_SUCCESS") and get_text(spark, f"{folder}/{k}/_told_by") == told]
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        if not done or k > done[-1]:
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
            if at:
                put_text(spark, f"{path}/_told_by", told)
            if k:
                remove(spark, f"{folder}/{k - 1}")
        if not done or k >= done[-1]:
            docs = spark.read.parquet(path)
    return docs
