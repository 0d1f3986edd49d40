"""A training-data pipeline over ``documents``: five stages, each written as Parquet and read by the next."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickpulse.llm import bpe, langid, minhash, mixing, pii
from clickpulse.llm.common import free_name, hash_share, scratch, shared_dir
from clickpulse.llm.queries import MIX_TARGETS, RANK_FILE, fit_on_train, label_domains

#: Tokens to reach, as a multiple of those given. At 1, rates of documents that the classifier takes for clean come out above 1,
#: so all of these stay.
BUDGET = 1.0
#: Texts of which no language explains this part of the n-grams go.
LEAST_LANGUAGE_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those that no known language explains; ``lang`` becomes the prediction.

    Null and empty texts have no letter and go; repeated rows are decided alike; without labelled rows no language is known
    and all go; an empty table stays empty. Other columns stay as they are, whatever their names.
    """
    name, score = free_name("lang_pred", docs.columns), free_name("score", docs.columns)
    known = langid.identify(docs, fit_on_train(docs), into=(name, score)).where((F.col(name) != langid.UNKNOWN) & (F.col(score) >= LEAST_LANGUAGE_SCORE))
    return known.withColumn("lang", F.col(name)).select(docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays, whatever ids repeat or are null.

    Null texts and texts without words are no duplicates and stay; an empty table stays empty.
    """
    return minhash.one_of_each(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes its kind in angle brackets; ``n_chars`` follows.

    Null texts stay null and ``n_chars`` with them; repeated rows stay; an empty table stays empty.
    """
    spans = free_name("pii", docs.columns)
    clean = pii.redact(pii.find_pii(docs, into=spans), spans=spans).withColumn("n_chars", F.length("text").cast("long"))
    return clean.select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as its fitted rate says.

    Null and empty texts have no tokens and the chances of an average document; repeated rows and rows without an id share
    their draw; an empty table stays empty. Columns stay as they are, whatever their names.
    """
    labels = label_domains(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    words, chances, rate, copies, copy = (free_name(n, docs.columns) for n in ("tokens", "chances", "rate", "copies", "copy"))
    members, _, steps = mixing.fit_mix(docs, labels, MIX_TARGETS, budget=BUDGET, keep=tuple(docs.columns), into=(words, chances))
    rated = mixing.with_rates(members, steps, hash_share(F.col("doc_id").cast("string"), 31), chances, (rate, copies))
    return rated.where(F.col(copies) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The number of token ids, and digests of the ids and of the text that they decode to; one row for each row.

    A null text is empty; an empty table gives an empty one.
    """
    return bpe.digest_tokens(docs, public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN, keep=("doc_id", "lang", "source"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("deduplicate", deduplicate),
    ("private", private),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: SQL can't express the classifier, the signatures or the encoder; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Every other stage is written, and its operators' tables are deleted then."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        if i == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        path = f"{shared_dir(spark)}/{uuid.uuid4().hex}.parquet"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
