"""Each registered query against a plain version of its contract, over whole tables of sf0.01."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import regex
import xxhash

from clickpulse.llm import bpe, chat, minhash, mixing
from clickpulse.llm.queries import QUERIES, URL_RULES


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


@pytest.fixture(scope="module")
def docs(sf_dir):
    return duckdb.sql(f"select * from '{sf_dir}/documents.parquet'").df()


def rows(spark, sf_dir, name, key):
    return QUERIES[name](spark, sf_dir).toPandas().set_index(key).sort_index()


def test_op2_chat(spark, sf_dir):
    got = rows(spark, sf_dir, "op2_chat", "conv_id")
    table = duckdb.sql(f"select * from '{sf_dir}/conversations.parquet' order by conv_id, turn").df()
    more = pd.DataFrame({"conv_id": -1, "turn": [0, 1], "role": ["user", "assistant"], "text": ["</s>[INST] ok [/INST]"] * 2})
    table = pd.concat([more, table])
    template = chat.ChatTemplate()
    assert len(got) == table["conv_id"].nunique()
    for conv, part in table.groupby("conv_id"):
        part = part.fillna("").sort_values("turn")
        loss = "".join(part["text"][part["role"] == "assistant"])
        made = "".join(template.open + r + template.says + template.escape(t) + template.close for r, t in zip(part["role"], part["text"], strict=True))
        row = got.loc[conv]
        assert row["n_turns"] == len(part)
        assert row["turns_sha256"] == sha("".join(f"{r}\n{t}\n" for r, t in zip(part["role"], part["text"], strict=True)))
        assert (row["loss_chars"], row["loss_sha256"], row["formatted_chars"]) == (len(loss), sha(loss), len(made))


def test_op3_urls(spark, sf_dir):
    got = rows(spark, sf_dir, "op3_urls", "page_id")
    pages = duckdb.sql(f"select page_id, url from '{sf_dir}/pages.parquet'").df()
    assert len(got) == len(pages)
    for page, url in pages.itertuples(index=False):
        rest = url.partition("://")[2] if url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [(len(h + p), h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        _, rule, verdict = max(fits, default=(0, None, "allow"))
        row = got.loc[page]
        assert (row["host"], row["path"], row["rule"], row["verdict"]) == (host, path, rule, verdict)


def found(pattern, text, keep=lambda m: True, flags=0):
    return [m.span() for m in re.finditer(pattern, text, flags) if keep(m)]


def luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def digits(m):
    return re.sub("[^0-9]", "", m[0])


def secret_spans(text):
    return {
        "assign": found(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, lambda m: len(m[2]) >= 6, re.I | re.A),
        "access": found(r"AKIA[A-Z0-9]+", text, lambda m: len(m[0]) >= 20),
        "hex": found(r"[0-9a-f]+", text, lambda m: len(m[0]) >= 24),
    }


def pii_spans(text):
    return {
        "email": found(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text),
        "ip": found(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text, lambda m: all(int(x) <= 255 for x in m[0].split("."))),
        "card": found(r"[0-9]([\x20-]?[0-9])+", text, lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": found(r"\+[0-9][\x20().0-9-]+[0-9]", text, lambda m: 8 <= len(digits(m)) <= 15),
    }


def test_op5_secrets(spark, sf_dir, docs):
    got = rows(spark, sf_dir, "op5_secrets", "doc_id")
    assert len(got) == len(docs)
    for doc, text in zip(docs["doc_id"], docs["text"].fillna(""), strict=True):
        want = secret_spans(text)
        spans = sorted((a, list(want).index(k), f"{k}:{a}:{b}") for k, x in want.items() for a, b in x)
        row = got.loc[doc]
        assert [row[f"n_{k}"] for k in want] == [len(x) for x in want.values()]
        assert row["base_sha256"] == sha(",".join(s for *_, s in spans))
        listed = [s for s in row["spans"].split(",") if s.split(":")[0] in want]
        assert listed == [s for *_, s in spans]


def test_op6_pii(spark, sf_dir, docs):
    got = rows(spark, sf_dir, "op6_pii", "doc_id")
    assert len(got) == len(docs)
    for doc, text in zip(docs["doc_id"], docs["text"].fillna(""), strict=True):
        want = pii_spans(text)
        spans = [f"{k}:{a}:{b}" for k, x in want.items() for a, b in x]
        row = got.loc[doc]
        assert [row[f"n_{k}"] for k in want] == [len(x) for x in want.values()]
        assert row["base_sha256"] == sha(",".join(spans))
        assert set(spans) <= set(row["spans"].split(","))
    assert got["n_email"].sum() and got["n_ip"].sum() and got["n_card"].sum() and got["n_phone"].sum()


def test_op7_quality(spark, sf_dir, docs):
    got = rows(spark, sf_dir, "op7_quality", "doc_id")
    for doc, text in zip(docs["doc_id"], docs["text"].fillna(""), strict=True):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = Counter(zip(words, words[1:], words[2:], strict=False))
        inside = {j for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if windows[w] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        row = got.loc[doc]
        assert (row["n_words"], row["word_chars"], row["n_symbols"]) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)))
        assert (row["n_dup_lines"], row["n_repeat_words"]) == (len(lines) - len(set(lines)), len(inside))
        assert row["base_failed"] == (len(words) < 50 or 100 * len(inside) > 50 * len(words))
        assert not (row["base_failed"] and row["kept"])


def test_op7_follows_labels(spark, sf_dir):
    """The votes are fitted without labels; held against them, good texts stay and most of the bad that pass the base go."""
    got = rows(spark, sf_dir, "op7_quality", "doc_id")
    labels = duckdb.sql(f"select * from '{sf_dir}/labels.parquet'").df().set_index("doc_id")
    both = got.join(labels, how="inner")
    good = both[(both["quality"] == 1) & ~both["base_failed"]]
    assert good["kept"].mean() > 0.99
    bad = both[(both["quality"] == 0) & ~both["base_failed"]]
    assert bad["kept"].mean() < 0.3


def test_op8_langid(spark, sf_dir, docs):
    got = rows(spark, sf_dir, "op8_langid", "doc_id").join(docs.set_index("doc_id")[["lang", "text"]])
    assert len(got) == len(docs)
    assert (got["held_out"] == [zlib.crc32(str(x).encode()) % 4 == 2 for x in got.index]).all()
    assert got["score"].between(0, 1).all()
    none = ~got["text"].fillna("").map(lambda t: any(c.isalpha() for c in t))
    assert ((got["lang_pred"] == "und") == none).all()
    held = got[got["held_out"] & ~none]
    assert (held["lang_pred"] == held["lang"]).mean() > 0.97


def test_op9_bpe(spark, sf_dir, docs):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    own = bpe.BytePairCoder.from_rank_file(path, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    got = rows(spark, sf_dir, "op9_bpe", "doc_id")
    for doc, text in zip(docs["doc_id"], docs["text"].fillna(""), strict=True):
        ids = library.encode_ordinary(text)
        row = got.loc[doc]
        assert (row["n_tokens"], row["ids_sha256"]) == (len(ids), sha(" ".join(map(str, ids))))
        assert row["decoded_sha256"] == sha(text)


def components(keys, links):
    root = {k: k for k in keys}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {k: find(k) for k in keys}


def bags(texts):
    for text in texts:
        words = text.lower().encode().split()
        yield Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def test_op4_minhash(spark, sf_dir, docs):
    got = rows(spark, sf_dir, "op4_minhash", "doc_id")
    table = dict(zip(docs["doc_id"], bags(docs["text"].fillna("")), strict=True))
    holders = defaultdict(list)
    for doc, bag in table.items():
        for s in bag:
            holders[s].append(doc)
    near = {(a, b) for h in holders.values() for i, a in enumerate(h) for b in h[i + 1 :]}
    links = [(a, b) for a, b in near if (s := sum((table[a] & table[b]).values())) >= 0.8 * (table[a].total() + table[b].total() - s)]
    want = components(table, links)
    assert got["class_id"].to_dict() == want
    assert (got["kept"] == (got.index == got["class_id"])).all()
    assert len(set(want.values())) < len(want)


def test_bag_signature_is_unbiased():
    rng = np.random.default_rng(1)
    errors = []
    for shared in (0.3, 0.6, 0.9):
        for _ in range(12):
            words = [f"w{i}" for i in range(300)]
            a = list(rng.choice(words, 400))
            b = list(a)
            for i in rng.choice(len(b), int((1 - shared) * 100), False):
                b[i] = f"x{i}"
            made, stops = minhash.shingles([" ".join(a * 2), " ".join(b * 2)], words=1)
            sig = minhash.bag_signatures(made, stops, 1024)
            x, y = Counter(a * 2), Counter(b * 2)
            errors.append((sig[0] == sig[1]).mean() - (x & y).total() / (x | y).total())
    assert abs(np.mean(errors)) < 0.008 and np.abs(errors).max() < 0.06


def test_signature_does_not_depend_on_its_batch():
    texts = ["a b c d e f g h", "one two", " ".join(map(str, range(3000))), "", "x y " * 500]
    made, stops = minhash.shingles(texts)
    together = minhash.bag_signatures(made, stops, 64)
    for i, text in enumerate(texts):
        alone = minhash.bag_signatures(*minhash.shingles([text]), 64)[0]
        assert (alone == together[i]).all()


def test_op10_embeddings(spark, sf_dir, tmp_path):
    rng = np.random.default_rng(0)
    base = duckdb.sql(f"select * from '{sf_dir}/embeddings.parquet'").df()
    x = np.stack(base["embedding"])
    near = np.repeat(x[:40], 12, axis=0) + 0.03 * rng.standard_normal((480, 64))
    exact = np.repeat(x[50:53], 30, axis=0)
    x = np.concatenate([x, near, exact]).astype(np.float32)
    bad = [None, [0.0] * 64, [float("nan")] + [1.0] * 63, [float("inf")] + [1.0] * 63, [None] + [1.0] * 63]
    table = [(i, v.tolist()) for i, v in enumerate(x)] + [(len(x) + i, v) for i, v in enumerate(bad)]
    spark.createDataFrame(table, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = rows(spark, str(tmp_path), "op10_embeddings", "vec_id")
    y = x.astype(float)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    s = y @ y.T >= 0.95
    np.fill_diagonal(s, False)
    i, j = np.nonzero(s)
    assert len(got) == len(table)
    n = got["n_links"].to_numpy()
    assert (n[len(x) :] == 0).all() and (n[: len(x)] <= s.sum(1)).all()
    assert n.sum() >= 0.97 * len(i)
    if n.sum() == len(i):
        want = components(range(len(table)), zip(i.tolist(), j.tolist(), strict=True))
        assert got["component_id"].to_dict() == want
    assert (got["kept"] == (got["component_id"] == got.index)).all()


def test_op1_mix(spark, sf_dir):
    got = QUERIES["op1_mix"](spark, sf_dir).toPandas()
    chances = got[["p_clean", "p_toxic", "p_junk"]].to_numpy()
    assert np.allclose(chances.sum(1), 1, atol=1e-5) and (got["rate"] >= 0).all()
    expected = (got["tokens"] * got["rate"]).to_numpy() @ chances
    total = got["tokens"].sum()
    assert np.allclose(expected / total, [0.90, 0.05, 0.05], atol=0.002)
    assert ((got["copies"] - got["rate"]).abs() < 1).all()
    labels = duckdb.sql(f"select * from '{sf_dir}/labels.parquet'").df()
    both = got.merge(labels, on="doc_id")
    assert (both["p_junk"][both["quality"] == 0].mean() > 0.8) and (both["p_junk"][both["quality"] == 1].mean() < 0.1)


def test_op1_against_plain(spark, sf_dir, docs):
    """The chances of all documents against the same model, fitted and applied in plain Python."""
    domains = ["clean", "toxic", "junk"]
    got = rows(spark, sf_dir, "op1_mix", "doc_id")
    labels = duckdb.sql(f"select doc_id, case when quality = 0 then 'junk' when toxic = 1 then 'toxic' else 'clean' end as domain from '{sf_dir}/labels.parquet'").df()
    domain = dict(labels.itertuples(index=False))
    bags = {}
    for doc, text in zip(docs["doc_id"], docs["text"].fillna(""), strict=True):
        pieces = regex.findall(r"\p{L}+|\p{N}+|[^\p{L}\p{N}\x20\x09-\x0D]+", text.lower())
        bags[doc] = Counter(((xxhash.xxh64_intdigest(w.encode(), seed=42) + 2**63) % 2**64 - 2**63) % mixing.BUCKETS for w in pieces)
    mass, times, prior = np.zeros((mixing.BUCKETS, 3)), np.zeros((mixing.BUCKETS, 3)), np.ones(3)
    for doc, name in domain.items():
        prior[domains.index(name)] += 1
        for b, c in bags[doc].items():
            mass[b, domains.index(name)] += np.log1p(c)
            times[b, domains.index(name)] += 1
    expected = mass.sum(1, keepdims=True) * mass.sum(0) / mass.sum()
    chi = np.divide((mass - expected) ** 2, expected, out=np.zeros_like(mass), where=expected > 0).sum(1)
    rate = np.log((mass + 0.5) / mass.sum(0))
    telling = np.flatnonzero((chi >= mixing.LEAST_CHI_SQUARE) & (np.ptp(rate, axis=1) >= mixing.LEAST_LIFT))
    assert 20 < len(telling) <= mixing.FEATURES
    other = np.log(2) * (times.sum(0) - times[telling].sum(0))
    whole = other + mass[telling].sum(0)
    lift = dict(zip(telling, np.log((mass[telling] + 0.5) / whole), strict=True))
    rest = np.log((other + 0.5) / whole)
    for doc, bag in bags.items():
        logs = np.log(prior / prior.sum())
        for b, c in bag.items():
            v = lift.get(b)
            logs = logs + (np.log(2) * (rest - rest.mean()) if v is None else np.log1p(c) * (v - v.mean()))
        chance = np.exp(logs - logs.max())
        assert np.allclose(got.loc[doc, [f"p_{d}" for d in domains]].astype(float), chance / chance.sum(), atol=2e-6)


def test_op7_against_plain_em(spark, sf_dir, docs):
    """The posteriors of all documents against expectation-maximisation over single documents, rules and measures in plain Python."""
    got = rows(spark, sf_dir, "op7_quality", "doc_id")
    votes = []
    for text in docs["text"].fillna(""):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = list(zip(words, words[1:], words[2:], strict=False))
        seen = Counter(windows)
        n, chars = len(words), sum(map(len, words))
        symbols, dup = len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines))
        repeats = len({j for i, w in enumerate(windows) if seen[w] > 1 for j in (i, i + 1, i + 2)})
        upper = len(re.findall("[A-Z]", text))
        letters = len(re.findall("[A-Za-z]", text)) + sum(c > "\x7f" for w in words for c in w)
        bare = sum(not re.search(r"[A-Za-z0-9\x80-\U0010ffff]", w) for w in words)
        at = lambda a, b: a / b if b else None
        more, less = (lambda x, y: x is not None and x > y), (lambda x, y: x is not None and x < y)
        mean = at(chars, n)
        pairs = [
            (n < 10, n >= 300),
            (more(at(symbols, n), 0.25), n >= 20 and less(at(symbols, n), 0.05)),
            (dup >= 3 and more(at(dup, len(lines)), 0.3), len(lines) >= 4 and less(at(dup, len(lines)), 0.1)),
            (more(at(repeats, n), 0.45), n >= 30 and less(at(repeats, n), 0.2)),
            (n >= 10 and (more(mean, 15) or less(mean, 2.5)), n >= 20 and 3 <= mean <= 10),
            (letters >= 30 and more(at(upper, letters), 0.5), letters >= 60 and less(at(upper, letters), 0.2)),
            (n >= 10 and less(at(letters, chars), 0.7), n >= 20 and more(at(letters, chars), 0.75)),
            (n >= 10 and more(at(bare, n), 0.15), n >= 20 and less(at(bare, n), 0.05)),
            (n >= 50 and less(at(len(set(words)), n), 0.15), n >= 50 and more(at(len(set(words)), n), 0.3)),
        ]
        votes.append([-1 if bad else 1 if good else 0 for bad, good in pairs])
    votes = np.array(votes)
    right, wrong, share = np.full(9, 0.99), np.full(9, 0.2), 0.7
    for _ in range(200):
        up, down = votes > 0, votes < 0
        good = share * np.where(up, right, np.where(down, 1 - right, 1)).prod(1)
        bad = (1 - share) * np.where(down, wrong, np.where(up, 1 - wrong, 1)).prod(1)
        p = good / (good + bad)
        n = len(votes)
        right = np.clip(((p[:, None] * up).sum(0) / n + 0.99e-4) / ((p[:, None] * (up | down)).sum(0) / n + 1e-4), 0.9, 0.998)
        wrong = np.clip((((1 - p)[:, None] * down).sum(0) / n + 0.2e-4) / (((1 - p)[:, None] * (up | down)).sum(0) / n + 1e-4), 0.11, 0.98)
        share = np.clip(p.mean(), 0.05, 0.95)
    mine = got.loc[docs["doc_id"]]
    assert np.allclose(mine["p_good"], p, atol=1e-5)
    sure = np.abs(p - 0.5) > 1e-6
    assert (mine["kept"].to_numpy() == (~mine["base_failed"].to_numpy(dtype=bool) & (p >= 0.5)))[sure].all()


def test_op8_against_plain_sets(spark, sf_dir, docs):
    """The decisions of all documents against plain sets of n-grams, which have no false positives."""
    got = rows(spark, sf_dir, "op8_langid", "doc_id")

    def grams(text):
        words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        return [w[i : i + n] for w in (f" {x} " for x in words) for n in (2, 3, 4) for i in range(len(w) - n + 1)]

    counts = defaultdict(Counter)
    table = {d: grams(t) for d, t in zip(docs["doc_id"], docs["text"].fillna(""), strict=True)}
    for doc, lang in zip(docs["doc_id"], docs["lang"], strict=True):
        if lang is not None and zlib.crc32(str(doc).encode()) % 4 != 2:
            counts[lang].update(table[doc])
    sets = {lang: {g for g, _ in c.most_common(3000)} for lang, c in sorted(counts.items())}
    same = []
    for doc, found in table.items():
        if not found:
            assert tuple(got.loc[doc, ["lang_pred", "score"]]) == ("und", 0.0)
            continue
        share = {lang: sum(g in s for g in found) / len(found) for lang, s in sets.items()}
        best, second = sorted(share.values())[-1], sorted(share.values())[-2]
        same.append(abs(got.loc[doc, "score"] - best) < 0.05)
        if best - second > 0.05:
            assert share[got.loc[doc, "lang_pred"]] == best
    assert np.mean(same) > 0.99
