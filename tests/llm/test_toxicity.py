"""Operator 11: the composed grammar against its parts read one after another, the fit, and held-out accuracy."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from clickpulse.llm import toxicity
from clickpulse.llm.queries import op11_toxicity

MODEL = toxicity.ToxicityModel({"idiot": 4.0, "idiotic$": 1.0, "trash$": 3.0}, (-4.0, 2.0, 1.0, 0.0, 0.0))


def plainly(kinds: list[str]) -> list[tuple[str, str]]:
    """What the grammar writes, from the words' places in the clause: quotes and verbs of saying, then negation, targets and threats."""
    out, said, opened = [], False, False
    notes = []
    for kind in kinds:
        if kind == "said":
            said, opened = True, False  # an open quotation is over once somebody speaks again
        elif kind == "quote":
            said, opened = False, not opened
        notes.append("r" if (said or opened) and kind in ("insult", "harm") else "")
    since = lambda i, kind, reach: any(k == kind for k in kinds[max(0, i - reach) : i])
    waiting = 0
    for i, kind in enumerate(kinds):
        if kind in ("insult", "harm"):
            notes[i] += ("n" if since(i, "not", 3) else "") + ("a" if since(i, "target", 4) else "")
        if kind == "insult":
            waiting = 0 if "a" in notes[i] else 4
        elif kind == "target" and waiting:
            kind, waiting = "aim", 0
        else:
            waiting = max(0, waiting - 1)
            if kind == "harm" and since(i, "will", 3):
                kind = "threat"
        out.append((kind, notes[i]))
    return out


def test_the_composed_grammar_against_the_definition():
    grammar, rng = toxicity.clause_grammar(), random.Random(11)
    kinds = [k for k, _ in grammar.alphabet]
    for _ in range(3000):
        read = [rng.choice([*kinds, "insult", "insult", "other", "other", "target"]) for _ in range(rng.randrange(1, 14))]
        state, written = 0, []
        for kind in read:
            state, symbol = grammar.arcs[state, (kind, "")]
            written.append(symbol)
        assert written == plainly(read)


def test_clauses_weigh_by_what_they_say():
    weigh = lambda text: MODEL.clause(text)[0]
    assert weigh("an idiot") == 4.0 and weigh("you idiot") == 5.0 and weigh("idiot that you are") == 5.0
    assert weigh("you are not an idiot") == 4.0 * 1.25 * 0.25 and weigh("she said he is an idiot") == 4.0 * 1.25 * 0.4
    assert weigh('the word "idiot" is old') == 4.0 * 0.4 and weigh("idiots and idiotic trash") == 4.0 + 1.0 + 3.0
    assert weigh("i will kill you") == 6.0 and weigh("they kill time") == 0 and weigh("i will never kill you") == 6.0 * 0.25
    assert weigh("trashy idio") == 0 and MODEL.weight("idiotically") == 4.0


def test_texts():
    measure = MODEL.measure
    assert measure("You idiot! Trash.")[0] == math.log1p(8.0) and measure("You idiot! Trash.")[2] == math.log1p(2)
    assert measure("He said so. You idiot")[0] == math.log1p(5.0)  # reported speech ends with its clause
    assert measure("postidiot, pretrash")[0] == 0 and measure(None) == measure("") == (0, 0, 0, 0)
    long = "word " * 200_000
    assert measure(long + "idiot " + long)[0] == math.log1p(4.0)
    assert measure("idiot " * 50_000)[2] == math.log1p(50_000)  # one clause, read once
    assert MODEL.score("you idiot") > 0.5 > MODEL.score("a fine day") == MODEL.score(None) + 0.0
    assert toxicity.ToxicityModel({}, (0.0,) * 5).score("idiot") == 0.5


def test_heads_and_evidence(spark):
    assert toxicity.heads("Abcd ab") == {"abc", "abcd", "abcd$"} and toxicity.heads(None) == set()
    assert max(map(len, toxicity.heads("x" * 1000))) == toxicity.LONGEST
    rows = spark.createDataFrame([(10, 0), (0, 10), (5, 5), (20, 1)], "a long, b long")
    got = [r[0] for r in rows.select(toxicity.evidence(rows["a"], rows["b"], 50, 50)).collect()]

    def term(k, of, p):
        return k * math.log(k / of / p) if k else 0.0

    want = [sum(term(*x) for x in ((a, a + b, 0.5), (b, a + b, 0.5), (50 - a, 100 - a - b, 0.5), (50 - b, 100 - a - b, 0.5))) if a > b else 0.0 for a, b in ((10, 0), (0, 10), (5, 5), (20, 1))]
    assert np.allclose(got, want)


def labelled(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("aeioubdfgl") for _ in range(rng.randrange(3, 9)))
    rows, labels = [], []
    for i in range(400):
        words = [word() for _ in range(60)]
        if i % 4 == 0:
            for stem in rng.sample(["zorgh", "klimpf", "wrackt", "vutz"], 2):
                words.insert(rng.randrange(60), stem + rng.choice(["", "en", "ix", word()]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    rows += [(4, rows[4][1])] * 300 + [(10_000 + i, rows[0][1] + f" {word()}") for i in range(60)]  # copies and near copies
    labels += [(4, 1)] * 5 + [(10_000 + i, 1) for i in range(60)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_the_fit_learns_heads_not_the_words_of_copies(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit_toxicity(docs, labels)
    assert {k[:3] for k in model.insults} == {"zor", "kli", "wra", "vut"}
    scores = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, model).where("doc_id < 400").collect()}
    wrong = [i for i, s in scores.items() if (s >= 0.5) != (i % 4 == 0)]
    assert len(wrong) <= 4


@pytest.mark.parametrize("kind", [None, 0, 1])
def test_without_labels_of_both_kinds(spark, kind):
    docs, labels = labelled(spark)
    labels = labels.where("doc_id is null" if kind is None else f"toxic = {kind}")
    model = toxicity.fit_toxicity(docs, labels)
    score = toxicity.score_toxicity(docs.limit(1), model).first()["score"]
    assert score > 0.99 if kind == 1 else score < 0.01


def test_edge_rows(spark):
    schema = "doc_id long, text string, score string, _text int, toxic int, lang string"
    big = (1 << 53) + 1
    rows = [(None, "you idiot", "s", 1, 1, None), (big, None, "s", 1, 1, None), (big + 2, "", "s", 1, 1, None), (big + 2, "", "s", 1, 1, None), (5, "you idiot. " * 100_000, None, None, None, None), (6, "😀 !!! …", None, 1, None, "x")]
    df = spark.createDataFrame(rows, schema)
    got = toxicity.score_toxicity(df, MODEL).collect()
    assert sorted(r["doc_id"] or 0 for r in got) == [0, 5, 6, big, big + 2, big + 2]
    assert all((r["score"] > 0.5) == (r["doc_id"] in (None, 5)) and 0 <= r["score"] <= 1 for r in got)
    assert toxicity.score_toxicity(df.limit(0), MODEL).count() == 0
    empty = toxicity.fit_toxicity(df.limit(0), df.select("doc_id", "toxic"))
    assert empty.insults == {}


@pytest.mark.parametrize(("sf", "recall", "wrong"), [("sf0.1", 0.9, 0.01)])
def test_held_out_labels(spark, sf, recall, wrong):
    """About one in sixteen toxic texts of this table shows no sign of it."""
    sf_dir = f"/root/testdata/{sf}"
    scored = op11_toxicity(spark, sf_dir).where("held_out").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").select("toxic", "predicted", "score").toPandas()
    toxic = scored["toxic"] == 1
    assert scored["predicted"][toxic].mean() >= recall and scored["predicted"][~toxic].mean() <= wrong
    assert ((scored["score"] >= 0.5) == (scored["predicted"] == 1)).all()
