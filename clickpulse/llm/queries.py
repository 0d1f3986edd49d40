"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, embed_dedup, langid, minhash, mixing, pii, quality, runs, secret_scan, spelling, toxicity, url_rules
from .common import cut
from .spans import count_kind, listed

URL_RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
RANK_FILE = "byte_bpe_50k.tiktoken"
#: Shares of tokens by the domains that ``labels`` tell apart.
MIX_TARGETS = {"clean": 0.90, "toxic": 0.05, "junk": 0.05}
CONTROL_TURNS = "</s>[INST] ok [/INST]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def label_domains(labels: DataFrame) -> DataFrame:
    """``doc_id, domain`` from the label table: junk (quality 0), else toxic, else clean."""
    domain = F.when(F.col("quality") == 0, "junk").when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "clean")
    return labels.select("doc_id", domain.alias("domain"))


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's soft membership, fitted rate and copies."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"), label_domains(table(spark, sf_dir, "labels")), MIX_TARGETS)
    chances = [F.round(F.get("chances", F.lit(i)), 6).alias(f"p_{d}") for i, d in enumerate(MIX_TARGETS)]
    return mixed.select("doc_id", "source", "tokens", *chances, F.round("rate", 6).alias("rate"), "copies")


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats all conversations, and one that speaks control strings, and reads them back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", CONTROL_TURNS), (-1, 1, "assistant", CONTROL_TURNS)], "conv_id long, turn long, role string, text string")
    template = chat.ChatTemplate()
    return chat.read_back(chat.format_chat(rows.unionByName(more), template), template)


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judges every page; null urls and those without ``://`` get the default verdict."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class and whether it stays; null texts and texts without words are classes of their own."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first scan (the ledger is empty) of all distinct blobs; what the ledger then holds is joined back to all documents."""
    versions = table(spark, sf_dir, "documents").select("doc_id", "text")
    scanned = cut(secret_scan.scan_unseen(versions))
    found = secret_scan.findings_by_path(versions, secret_scan.ledger_rows(scanned))
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in secret_scan.RULES if r.base]))
    counts = [count_kind(F.col("spans"), k).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of every whole text; a null text has none."""
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("pii", lambda s: s["kind"].isin([k.kind for k in pii.KINDS if k.base]))
    counts = [count_kind(F.col("pii"), k).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every whole text; a null text has no words and fails the base."""
    judged = quality.judge_quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & F.col("good")).alias("kept"), F.round("p_good", 6).alias("p_good"))


def _held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def fit_on_train(documents: DataFrame) -> langid.LanguageFilters:
    return langid.fit_languages(documents.where(~_held_out()))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and score of every whole text; ``und`` with score 0 for null texts and those without a letter."""
    documents = table(spark, sf_dir, "documents")
    filters = fit_on_train(documents)
    return langid.identify(documents.select("doc_id", "text"), filters).select("doc_id", _held_out().alias("held_out"), "lang_pred", "score")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded bytes of every whole text; a null text is empty."""
    return bpe.digest_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN)


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors; unusable vectors link with nothing."""
    return embed_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def _toxic_held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every whole text by what labels of the rows that aren't held out teach."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit_toxicity(documents, labels.where(~_toxic_held_out()))
    scored = toxicity.score_toxicity(documents.select("doc_id", "text"), model)
    return scored.select("doc_id", _toxic_held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every whole text, of which every tenth is made to repeat; null texts have none."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return runs.digest_runs(documents.withColumn("text", runs.plant_runs(F.col("text"), F.col("doc_id"))))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all whole texts, of which a known share lacks a letter."""
    words = spelling.letter_runs(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "word")
    return spelling.group_variants(spelling.count_words(words.withColumn("word", spelling.plant_misspellings(F.col("word"), F.col("doc_id")))))


QUERIES = {
    "op1_mix": op1_mix,
    "op2_chat": op2_chat,
    "op3_urls": op3_urls,
    "op4_minhash": op4_minhash,
    "op5_secrets": op5_secrets,
    "op6_pii": op6_pii,
    "op7_quality": op7_quality,
    "op8_langid": op8_langid,
    "op9_bpe": op9_bpe,
    "op10_embeddings": op10_embeddings,
    "op11_toxicity": op11_toxicity,
    "op12_runs": op12_runs,
    "op13_spelling": op13_spelling,
}
