"""Operator 13 against the definition of one edit, word by word."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from clickpulse.llm import spelling
from clickpulse.llm.queries import op13_spelling


def neighbours(words: dict[str, int]) -> dict[str, set[str]]:
    """Near words by what one deletion leaves: equal remains at one place are replacements, a word among them an insertion."""
    near, remains = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            rest = w[:i] + w[i + 1 :]
            remains[i, rest].add(w)
            if rest in words:
                near[w].add(rest)
                near[rest].add(w)
    for same in remains.values():
        for w in same:
            near[w] |= same - {w}
    return near


def by_definition(words: dict[str, int], ratio: int = 5) -> set[tuple]:
    near, form = neighbours(words), {}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= ratio * words[w] else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return out


def rows(df) -> list[tuple]:
    return [tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()]


def test_acceptors_accept_their_strings_and_share_states():
    words = ["abcd", "abed", "zbcd", "zbed"]
    found = spelling.Acceptor(words)
    assert len(found.arcs) == 5  # one path with two forks
    assert sorted(spelling.common(found, found, found.start, found.start)) == words


def test_pairs_of_random_words():
    rng = random.Random(13)
    for _ in range(400):
        alphabet, size = "abc"[: rng.choice([1, 2, 3])] + "é" * rng.randrange(2), rng.randrange(1, 7)
        words = {"".join(rng.choice(alphabet) for _ in range(size + rng.randrange(2))) for _ in range(rng.randrange(1, 40))}
        found = [tuple(sorted(p)) for p in spelling.near_pairs(sorted(words), size, 0, 0)]
        near = neighbours(dict.fromkeys(words, 1))
        wanted = {tuple(sorted((a, b))) for a in words for b in near[a] if min(len(a), len(b)) == size}
        assert sorted(found) == sorted(wanted)


@pytest.mark.parametrize("partition", [spelling.PARTITION, 3])
def test_variants_of_random_words_with_and_without_splitting(spark, partition):
    rng = random.Random(partition)
    words = {}
    for _ in range(1500):
        w = "".join(rng.choice("abcß") for _ in range(rng.randrange(6, 10)))
        words[w] = rng.choice([5, 6, 30, 200, 2000])
    words |= {"a" * 30: 5, "a" * 31: 30, "a" * 32: 200, "aaaaaaab" + "a" * 23: 1000}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    found = rows(spelling.group_variants(df, partition=partition))
    assert len(found) == len(words) and set(found) == by_definition(words)


def test_a_chain_of_forms_and_ties(spark):
    chain = {"abcdefgh" + "x" * i: 5**i for i in range(1, 12)}
    ties = {"muster": 5, "mustez": 25, "mustea": 25, "mustia": 10**12, "ÿmusteÀ": 7}
    words = chain | ties
    found = {r[0]: r for r in rows(spelling.group_variants(spark.createDataFrame(list(words.items()), "word string, n long")))}
    assert set(found.values()) == by_definition(words)
    assert found["abcdefghx"][2] == "abcdefgh" + "x" * 11 and found["muster"][1] == "mustea"
    with pytest.raises(ValueError):
        spelling.group_variants(spark.createDataFrame(list(words.items()), "word string, n long"), ratio=1)


def test_very_long_words_and_empty_tables(spark):
    long = "ab" * 20_000
    words = {long: 5, long[:-1]: 25, long[:100] + "c" + long[101:]: 9}
    found = rows(spelling.group_variants(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert set(found) == by_definition({k: v for k, v in words.items()})
    empty = spark.createDataFrame([], "word string, n long")
    assert spelling.group_variants(empty).count() == 0
    one = spark.createDataFrame([("single", 6)], "word string, n long")
    assert rows(spelling.group_variants(one)) == [("single", None, "single", 6, 0, None)]


def test_words_of_texts(spark):
    texts = [(1, "Straße STRASSE naïve×mot÷ÀÖ abc-defghi ABCDEFG"), (None, "abcdefg Ábcdefg"), (2, None), (3, ""), (4, "x" * 300_000)]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumnRenamed("doc_id", "key")
    found = sorted(r["word"] for r in spelling.letter_runs(df).collect() if len(r["word"]) < 100)
    assert found == sorted(["straße", "strasse", "naïve×mot÷ÀÖ", "defghi", "abcdefg", "abcdefg", "Ábcdefg"])
    counted = spelling.count_words(spelling.letter_runs(df), 6, 2)
    assert [tuple(r) for r in counted.collect()] == [("abcdefg", 2)]
    planted = spelling.letter_runs(df).withColumn("word", spelling.plant_misspellings(F.col("word"), F.col("key")))
    assert {"abcdefg", "Ábcdefg"} <= {r["word"] for r in planted.where("key is null").collect()}


def test_the_query_on_the_whole_table(spark, sf_dir):
    counts: Counter[str] = Counter()
    upper = {i: i + 32 for i in range(65, 91)}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        for w in re.findall("[A-Za-zÀ-ÿ]+", (r["text"] or "").translate(upper)):
            h = zlib.crc32(f"{r['doc_id']}:{w}".encode())
            counts[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 199 == 0 else w] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    found = rows(op13_spelling(spark, sf_dir))
    assert len(found) == len(words) > 5000 and set(found) == by_definition(words)
    assert sum(r[1] is not None for r in found) > 100
