"""Ids beyond 2^53 beside nulls; time and memory that follow the input."""

from __future__ import annotations

import time
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from clickpulse.llm import chat, common, embed_dedup, minhash, mixing, pii, quality

BIG = 1 << 53
IDS = [BIG + 1, BIG + 2, BIG + 3, BIG + 4, None]


def whole(rows, key="doc_id"):
    return sorted((r[key] for r in rows), key=lambda x: (x is None, x))


def test_ids_stay_whole_beside_nulls(spark, sf_dir):
    docs = spark.createDataFrame([(i, f"a text of its own {i}", "en", "s", 9) for i in IDS], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    assert whole(quality.measure(docs).collect()) == IDS and whole(quality.judge_quality(docs).collect()) == IDS
    assert whole(corpus_pipeline.tokens(spark, docs, sf_dir).collect()) == IDS
    short = docs.selectExpr("cast(doc_id % 100 as short) as doc_id", "text", "cast(doc_id as decimal(20,0)) as source")
    kept = quality.measure(short, keep=("doc_id", "source"))
    assert kept.schema["doc_id"].dataType.typeName() == "short" and {r["source"] for r in kept.collect()} == set(IDS)


def test_conversations_stay_apart_beside_nulls(spark):
    turns = [(i, t, role, f"{i} {role}") for i in IDS for t, role in enumerate(("user", "assistant"))]
    rows = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").coalesce(1)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        segments = chat.format_chat(rows)
        assert set(whole(segments.collect(), "conv_id")) == set(IDS)
        got = chat.read_back(segments).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert whole(got, "conv_id") == IDS and all(r["n_turns"] == 2 and r["valid"] for r in got)


def plainly(text: str, spans: list[tuple[int, int, str]]) -> str:
    merged: list[list] = []
    for start, end, kind in sorted(spans):
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end, kind])
    for start, end, kind in reversed(merged):
        text = f"{text[:start]}<{kind.upper()}>{text[end:]}"
    return text


@pytest.mark.parametrize("seed", range(4))
def test_redact_against_plain_replacement(spark, seed):
    rng, rows = np.random.default_rng(seed), []
    for _ in range(40):
        n = int(rng.choice([1, 3, 511, 512, 513, 1024, 1500, 5000]))
        text = "".join(rng.choice(list("ab \né\U0001f600"), n))
        spans = []
        for _ in range(int(rng.choice([0, 1, 3, 20, 600]))):
            start = int(rng.integers(0, n))
            spans.append((start, int(min(n, start + rng.integers(1, 1 + rng.choice([2, 30, 900])))), str(rng.choice(["ip", "email"]))))
        rows.append((text, spans))
    rows += [(None, []), ("", [])]
    df = spark.createDataFrame([(i, t, [(k, s, e, "", 0.9) for s, e, k in x]) for i, (t, x) in enumerate(rows)], "i int, text string, pii array<struct<kind:string,start:int,end:int,found:string,score:double>>")
    got = {r["i"]: r["text"] for r in pii.redact(df).collect()}
    for i, (text, spans) in enumerate(rows):
        assert got[i] == (plainly(text, spans) if text else text)


def test_redact_takes_linear_time(spark):
    """Twice the text and twice the spans take at most two and a half times as long."""

    def seconds(n: int) -> float:
        text = "".join(f"some prose before user{i}@mail.example.org and after it " for i in range(n))
        df = pii.find_pii(spark.createDataFrame([(text,)], "text string")).cache()
        df.count()
        began = time.perf_counter()
        found = pii.redact(df).selectExpr("length(text) as n").first()["n"]
        took = time.perf_counter() - began
        df.unpersist()
        assert found == len(text) - n * (len("user@mail.example.org") - len("<EMAIL>")) - sum(len(str(i)) for i in range(n))
        return took

    seconds(2000)
    assert seconds(32_000) < 2.5 * max(0.4, min(seconds(16_000), seconds(16_000)))


def test_the_index_of_many_rows_fits_in_little_memory():
    rng = np.random.default_rng(5)
    rows = 100_000_000
    unit = rng.standard_normal((embed_dedup.sample_size(rows), 64))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    tracemalloc.start()
    index = embed_dedup.fit_index(unit, rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6 and len(index.books[0]) == 442 and index.visits >= 1
    assert embed_dedup.sample_size(10**12) == embed_dedup.FIT_MOST and embed_dedup.sample_size(10) == embed_dedup.FIT_SAMPLE


def test_ranks_of_cells_against_the_whole_order():
    rng = np.random.default_rng(6)
    sample, partner = rng.standard_normal((2, 50, 8))
    books = (rng.standard_normal((7, 4)), rng.standard_normal((7, 4)))
    index = embed_dedup.MultiIndex(books, 1)
    wanted = (index.order(sample, 49) == index.order(partner, 1)).argmax(1)
    assert (embed_dedup._ranks(books, sample, partner) == wanted).all()


def test_a_key_with_many_labels_is_one_row_of_the_sample(spark):
    """A key that repeats a million times can't swell what is broadcast; its repeats still count as they are."""
    keys = spark.range(4000).withColumn("domain", F.when(F.col("id") % 2 == 0, "a").otherwise("b"))
    repeated = keys.unionByName(spark.range(0, 1_000_000, 1, 8).select(F.lit(6).cast("long").alias("id"), F.lit("a").alias("domain")))
    sample = mixing.label_sample(repeated, 500, "id", "domain").toPandas()
    assert len(sample) == sample["id"].nunique() and all(400 < (sample["domain"] == d).sum() < 600 for d in "ab")
    assert mixing.label_sample(repeated, 4000, "id", "domain").where("id = 6").first()["_times"] == 1_000_001
    texts = [(i, "red green blue" if i % 2 else "black white grey") for i in range(60)]
    labels = [(i, "b" if i % 2 else "a") for i in range(60)]
    thrice = [(4, "a")] * 2
    fit = lambda t, g: mixing.fit_domains(spark.createDataFrame(t, "doc_id long, text string"), spark.createDataFrame(g, "doc_id long, domain string"), ["a", "b"])
    by_label, by_text = fit(texts, labels + thrice), fit(texts + [texts[4]] * 2, labels)
    assert by_label.lift and by_label.buckets() == by_text.buckets() and all((by_label.lift[b] == by_text.lift[b]).all() for b in by_label.lift)
    assert by_label.prior[0] > by_text.prior[0]


def test_rows_without_a_partner_are_dropped_before_a_shuffle(spark, monkeypatch):
    rows = spark.range(20_000).select(F.sha2(F.col("id").cast("string"), 256).alias("key"), F.col("id"))
    keys = rows.where("id % 100 = 7").select("key")
    got = common.maybe_among(rows, keys, "key")
    kept = {r["id"] for r in got.collect()}
    assert kept >= set(range(7, 20_000, 100)) and len(kept) < 300
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert common.maybe_among(rows, keys.limit(0), "key").count() == 0
    assert common.maybe_among(rows.withColumn("key", F.lit(None).cast("string")), keys.unionByName(rows.limit(1).select(F.lit(None).cast("string").alias("key"))), "key").count() == 20_000
    monkeypatch.setattr(common, "FILTER_BITS", 64)  # more keys than bits: all rows may pass, none is lost
    assert {r["id"] for r in common.maybe_among(rows, keys, "key").collect()} >= set(range(7, 20_000, 100))


def test_signatures_of_texts_alone_in_their_buckets_are_not_carried(spark):
    texts = spark.createDataFrame([(b"a", "one two three four five six"), (b"b", "x")], "key binary, text string")
    assert minhash.band_table(texts).columns == ["key", "bands", "n"]
    bands = {bytes(r["key"]): (r["bands"], r["n"]) for r in minhash.band_table(texts).collect()}
    bags = {bytes(r["key"]): r for r in minhash.bag_table(texts).collect()}
    assert {k: (r["bands"], r["n"]) for k, r in bags.items()} == bands and all(len(r["marks"]) == minhash.BANDS * minhash.ROWS for r in bags.values())
