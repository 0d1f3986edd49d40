"""Operator 12 against the definition of runs, period by period."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from clickpulse.llm import runs
from clickpulse.llm.queries import op12_runs


def by_definition(words: list, least: int = 24, times: int = 3) -> list[tuple[int, int, int]]:
    """Maximal stretches of every period; those with a smaller period are left out."""
    ids: dict = {}
    code = np.array([ids.setdefault(w, len(ids)) for w in words], dtype=int)
    out = []
    for q in range(1, len(code) // times + 1):
        same = np.concatenate(([0], (code[q:] == code[:-q]).astype(int), [0]))
        edges = np.diff(same)
        for start, end in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1), strict=True):
            size = int(end - start) + q
            part = code[start : start + size]
            if size >= max(least, times * q) and not any((part[d:] == part[:-d]).all() for d in range(1, q) if q % d == 0):
                out.append((int(start), size, q))
    return sorted(out)


def random_words(rng: random.Random) -> list[int]:
    n, kinds = rng.randrange(260), rng.choice([1, 2, 3, 5, 30])
    words = [rng.randrange(kinds) for _ in range(n)]
    for _ in range(rng.randrange(4)):
        if n > 10:
            start, q = rng.randrange(n), rng.randrange(1, n // 4 + 1)
            for i in range(start + q, min(n, start + q * rng.randrange(2, 9) + rng.randrange(9))):
                words[i] = words[i - q]
    return words


def test_catchers_find_the_runs_of_random_words_in_any_portions():
    rng = random.Random(12)
    for _ in range(2500):
        words = random_words(rng)
        catcher, i = runs.RunCatcher(), 0
        while i < len(words):
            m = rng.choice([1, 7, 40, 300])
            catcher.append(np.array(words[i : i + m], dtype=np.int64))
            i += m
            if rng.random() < 0.1:  # what is known midway is right, too
                assert catcher.runs() == by_definition(words[:i])
        assert catcher.runs() == by_definition(words)


def test_runs_inside_runs_and_fibonacci_words():
    a, b = [0], [0, 1]
    while len(b) < 2000:
        a, b = b, b + a
    inner = [*range(10)] * 4 + [77, 78]
    for words in (b, inner * 5, [1] * 500, [1] * 100 + [2] + [1] * 100, [*range(9)] * 3, [*range(8)] * 3, [*range(7)] * 3 + [0, 1, 2], [0, 1] * 12, [0, 1] * 11 + [0]):
        catcher = runs.RunCatcher()
        catcher.append(np.array(words))
        assert catcher.runs() == by_definition(words)


def test_larger_bounds_and_smaller_ones():
    words = [*range(9)] * 4 + [*range(50, 60)] * 3
    catcher = runs.RunCatcher(30, 4)
    catcher.append(np.array(words))
    assert catcher.runs() == by_definition(words, 30, 4) == [(0, 36, 9)]
    for bad in ((23, 3), (24, 2)):
        with pytest.raises(ValueError):
            runs.RunCatcher(*bad)


def test_fingerprints_that_collide_make_no_runs(monkeypatch):
    """Comparisons of fingerprints only propose: with the base 1, sequences with equal sums collide."""
    monkeypatch.setattr(runs, "_powers", np.ones(1 << 12, dtype=np.uint64))
    rng = random.Random(3)
    for _ in range(60):
        words = random_words(rng)
        catcher = runs.RunCatcher()
        catcher.append(np.array(words, dtype=np.int64))
        assert catcher.runs() == by_definition(words)


def test_the_query_on_the_whole_table(spark, sf_dir):
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    found = {r["doc_id"]: r for r in op12_runs(spark, sf_dir).collect()}
    assert found.keys() == rows.keys()
    with_runs = 0
    for key, text in rows.items():
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
        n, h = len(words), zlib.crc32(str(key).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        wanted = by_definition(words)
        best = min(wanted, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        left = [w for i, w in enumerate(words) if not any(s + q <= i < s + size for s, size, q in wanted)]
        row = found[key]
        assert row["n_runs"] == len(wanted)
        assert (row["start"], row["length"], row["period"]) == (best or (None, None, None))
        assert row["exponent_milli"] == (1000 * best[1] // best[2] if best else None)
        assert row["runs_sha256"] == hashlib.sha256("".join(f"{s},{size},{q}\n" for s, size, q in wanted).encode()).hexdigest()
        assert row["collapsed_sha256"] == hashlib.sha256(b" ".join(left)).hexdigest()
        with_runs += bool(wanted)
    assert with_runs > 100


def test_runs_and_collapsed_texts_of_edge_rows(spark):
    long = "x y z\t" * 40_000 + "end"
    big = (1 << 53) + 1
    rows = [(None, None, "a"), (big, "", "b"), (big + 2, " \n ", "c"), (big + 4, "a " * 23, "d"), (big + 4, "a " * 24, "d"), (None, "a  b\n" * 12 + "c", "e"), (7, long, "f"), (8, "no runs  here", "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string")
    found = sorted(((r["doc_id"] or 0, r["length"], r["period"]) for r in runs.find_runs(df).collect()))
    assert found == [(0, 24, 2), (7, 120_000, 3), (big + 4, 24, 1)]
    kept = runs.collapse_runs(df)
    assert kept.columns == df.columns
    texts = {(r["doc_id"], r["start"]): r["text"] for r in kept.where("doc_id is null or doc_id <> 9007199254740997").collect()}
    assert texts[7, "f"] == "x y z end" and texts[8, "g"] == "no runs  here" and texts[None, "e"] == "a b c" and texts[None, "a"] is None and texts[big + 2, "c"] == " \n "
    assert sorted(r["text"] for r in kept.where(f"doc_id = {big + 4}").collect()) == ["a", "a " * 23]
    digests = runs.digest_runs(df).collect()
    assert sorted((r["doc_id"] or 0) for r in digests) == sorted((r[0] or 0) for r in rows)
    assert {r["runs_sha256"] for r in digests if not r["n_runs"]} == {hashlib.sha256(b"").hexdigest()}
    assert runs.digest_runs(df.limit(0)).count() == 0 and runs.find_runs(df.limit(0)).count() == 0
    planted = df.withColumn("text", runs.plant_runs(df["text"], df["doc_id"])).collect()
    assert [r["text"] for r in planted if r["doc_id"] is None] == [None, "a  b\n" * 12 + "c"]
