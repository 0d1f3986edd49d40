"""Nulls, empty and very long texts, ties, repeated rows, empty tables and columns with clashing names."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from clickpulse.llm import bpe, chat, common, components, embed_dedup, langid, minhash, mixing, pii, quality, secret_scan, url_rules
from clickpulse.llm.queries import MIX_TARGETS, label_domains

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, score double, ids int, bands int, tokens int, pii int, spans int, blob int"
LONG = "word and another word of prose " * 40_000


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (1, "the cat sat on the mat and the dog sat on the log today", "en"),
        (2, "the cat sat on the mat and the dog sat on the log today", "en"),
        (3, None, "en"),
        (4, "", None),
        (5, " \n\t ", "fr"),
        (None, "a text without an id", None),
        (6, "123 456 !!", "fr"),
        (7, LONG, "en"),
        (7, LONG, "en"),
        (8, "le chat est sur la table et le chien est dans la maison", "fr"),
        (9, "one", "en"),
        (10, "mail me at a.b@c.org or a@b \U0001f600 pässword = token=geheim99 x", "en"),
    ]
    return spark.createDataFrame([(i, t, x, "s", 0, "k", 1.0, 1, 1, 1, 1, 1, 1) for i, t, x in rows], DOCS)


def test_chat(spark):
    schema = "conv_id long, turn long, role string, text string, segment string, loss int"
    rows = [(1, 1, "assistant", "b", "", 0), (1, 0, "user", "a", "", 0), (1, 1, "assistant", "b", "", 0), (2, None, None, None, "", 0), (None, 0, "user", "<|turn|>\\</s>\\\\[INST]<", "", 0), (3, 0, "user", "x" * 500_000, "", 0), (4, 0, "assistant", "early", "", 0)]
    df = spark.createDataFrame(rows, schema)
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_chat(df)).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    assert got[1]["n_turns"] == 3 and not got[1]["valid"] and got[1]["loss_chars"] == 2
    assert got[2]["n_turns"] == 1 and not got[4]["valid"] and got[4]["loss_chars"] == 5
    assert chat.read_back(chat.format_chat(df.limit(0))).count() == 0
    template = chat.ChatTemplate()
    for text in ("\\", "\\\\", "<\\s>", "[INST", "<<|turn|>", "</s></s>\n", "a\\<|says|>", "<s>\\"):
        made = template.escape(text)
        assert template.unescape(made) == text and not any(c in made for c in template.controls)


def test_chat_turn_order(spark):
    def valid(*roles):
        rows = spark.createDataFrame([(1, i, r, "t") for i, r in enumerate(roles)], "conv_id long, turn long, role string, text string")
        return chat.read_back(chat.format_chat(rows)).first()["valid"]

    assert valid("system", "user", "assistant", "tool", "assistant") and valid("user", "assistant")
    assert not valid("user", "user", "assistant") and not valid("user") and not valid("system", "assistant")


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.ORG/es/x", "http://org/", "http://xorg/", "http://example.org", "http://b.a.com/fr/x?/de/", "http://a.com/frx", "ftp://u@a.com:80/fr/", "x://y://org/", "http://" + "a." * 3000 + "com/de/" + "z" * 100_000]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)] + [(5, urls[5], "h", "r")], "page_id long, url string, host string, rule string")
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"), (None, "/", "block"), ("com", None, "block"), ("com", "/de/", "block")]
    got = {r["page_id"]: r for r in url_rules.judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    assert [got[i]["rule"] for i in range(13)] == [None, None, None, None, "example.org/es/", "org/", None, None, "com/fr/", None, None, None, "com/de/"]
    assert got[12]["verdict"] == "block" and got[0]["verdict"] == "allow" and got[11]["host"] == "y:"
    nothing = spark.createDataFrame([], "host string, path string, verdict string")
    assert url_rules.judge_urls(pages, nothing).where("rule is not null").count() == 0
    assert url_rules.judge_urls(pages.limit(0), nothing).count() == 0


@pytest.mark.parametrize("urls_of_sweep", [3, 100_000])
def test_url_stack(spark, monkeypatch, urls_of_sweep):
    """Nested, sibling and repeated opening paths: the innermost rule decides, the outer one again after it."""
    monkeypatch.setattr(url_rules, "SWEEP_URLS", urls_of_sweep)
    rules = [("a.b", p, p) for p in ("", "/", "/x", "/x/y", "/x/y/z", "/xx", "/y")]
    urls = ["/", "/w", "/x", "/x/", "/x/y", "/x/y/", "/x/y/z9", "/x/z", "/xx/y", "/xy", "/y/x", "/z", ""]
    pages = spark.createDataFrame([(i, f"http://s.a.b{u}") for i, u in enumerate(urls)], "page_id long, url string")
    got = {r["path"]: r["verdict"] for r in url_rules.judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    for u in urls:
        assert got[u] == max((p for _, p, _ in rules if u.startswith(p)), key=len)


def test_secret_ledger(spark, docs):
    first = secret_scan.scan_unseen(docs)
    found = {r["doc_id"]: [s["found"] for s in r["spans"]] for r in secret_scan.findings_by_path(docs, secret_scan.ledger_rows(first)).collect()}
    assert found[10] == ["token=geheim99"] and found[3] == [] and len(found) == 11
    ledger = secret_scan.ledger_rows(first)
    assert first.count() == 9 and ledger.count() == 9 * len(secret_scan.RULES)
    assert secret_scan.scan_unseen(docs, ledger).count() == 0
    newer = (secret_scan.SecretRule("hex", secret_scan.HEX, version=2), *secret_scan.RULES[:2])
    again = secret_scan.scan_unseen(docs, ledger, newer)
    assert {tuple(r["rules"]) for r in again.collect()} == {("hex@2",)} and again.count() == 9
    more = spark.createDataFrame([(11, "AKIA" + "B" * 16)], "doc_id long, text string")
    assert [s["kind"] for s in secret_scan.scan_unseen(more, ledger).first()["spans"]] == ["access"]
    assert secret_scan.scan_unseen(docs.limit(0)).count() == 0


def test_secret_ledger_of_two_runs(spark):
    """Findings of an earlier run reach old and new paths of a blob; a new rule version supersedes the old one's findings."""
    old = "x token=geheim99 AKIA" + "Z" * 16
    one = spark.createDataFrame([(1, old), (2, "nothing"), (3, None)], "doc_id long, text string")
    ledger = secret_scan.ledger_rows(secret_scan.scan_unseen(one))
    two = one.union(spark.createDataFrame([(4, old), (5, "secret: abcdef1 " + "0a" * 12)], "doc_id long, text string"))
    scanned = secret_scan.scan_unseen(two, ledger)
    assert [r["blob"] for r in scanned.collect()] == [r["b"] for r in two.where("doc_id = 5").select(secret_scan.blob_of(F.col("text")).alias("b")).collect()]
    both = ledger.unionByName(secret_scan.ledger_rows(scanned))

    def kinds(table, rules=secret_scan.RULES):
        got = secret_scan.findings_by_path(two, table, rules).collect()
        assert len(got) == 5
        return {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in got}

    assert kinds(both) == {1: ["assign", "access"], 4: ["assign", "access"], 2: [], 3: [], 5: ["assign", "hex"]}
    assert kinds(both.union(ledger)) == kinds(both)
    newer = (secret_scan.SecretRule("access", r"AKIAY[A-Z]{16,}+", version=2), *secret_scan.RULES[:1])
    again = secret_scan.scan_unseen(two, both, newer)
    assert again.count() == 4 and kinds(both.unionByName(secret_scan.ledger_rows(again)), newer)[1] == ["assign"]


def test_many_spans_and_runs(spark):
    texts = ["x@y.zz " * 3000, "a" * 300_000, "1" * 300_000, "1 " * 100_000, "+1" * 100_000, "a@" * 50_000, "1." * 50_000, "token" * 50_000, "password= " * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["pii"] for r in pii.find_pii(df).collect()}
    assert [(s["start"], s["end"]) for s in got[0]] == [(7 * i, 7 * i + 6) for i in range(3000)]
    assert got[1] == [] and got[3] == []
    assert secret_scan.scan_unseen(df).count() == len(texts)


def test_pii(spark, docs):
    found = pii.find_pii(docs)
    assert found.count() == docs.count() and found.columns.count("pii") == 1
    assert {r["doc_id"]: [s["found"] for s in r["pii"]] for r in found.collect()}[10] == ["a.b@c.org"]
    text = "\U0001f600 card 4111 1111 1111 1111, bank DE89 3704 0044 0532 0130 00, ssn 123-45-6789, 123-45-6780, call +1 (555) 010-9999 ip 10.0.0.256 10.0.0.255"
    row = pii.redact(pii.find_pii(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string"))).orderBy("doc_id").collect()
    assert [s["kind"] for s in row[0]["pii"]] == ["ip", "card", "phone", "iban", "national_id"]
    assert row[0]["text"] == "\U0001f600 card <CARD>, bank <IBAN>, ssn <NATIONAL_ID>, 123-45-6780, call <PHONE> ip 10.0.0.256 <IP>"
    assert row[1]["text"] is None and row[2]["text"] == ""
    alone = pii.find_pii(spark.createDataFrame([(1, "number 123-45-6789 here")], "doc_id long, text string")).first()
    assert alone["pii"] == []  # no context, no national id


def test_quality(docs):
    got = quality.judge_quality(docs).collect()
    assert len(got) == docs.count() and all(r["p_good"] is not None for r in got)
    assert quality.judge_quality(docs.limit(0)).count() == 0


def test_vote_patterns():
    """Rules that fail together mark bad texts; a rule that alone calls few texts bad weighs less."""
    votes = np.array([[1, 1, 1, 1], [-1, -1, 1, 1], [0, 0, 0, 0], [1, 1, 1, 0]])
    good = quality.fit_votes(votes, np.array([80.0, 10.0, 5.0, 5.0]))
    assert good[0] > 0.9 and good[1] < 0.1 and good[3] > 0.9


def test_langid(spark, docs):
    filters = langid.fit_languages(docs)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs, filters).collect()}
    assert len(got) == 11 and all(got[i] == ("und", 0.0) for i in (3, 4, 5, 6))
    assert got[8][0] == "fr" and got[7][0] == "en"
    none = langid.fit_languages(docs.limit(0))
    assert {r["lang_pred"] for r in langid.identify(docs, none).collect()} == {"und"}
    assert langid.identify(docs.limit(0), filters).count() == 0


def test_filters_of_many_languages():
    grams = {f"l{i:03}": np.arange(i * 1000, i * 1000 + 500, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) for i in range(70)}
    filters = langid.LanguageFilters.build(grams)
    for i in (0, 63, 64, 69):
        masks = filters.masks(grams[f"l{i:03}"])
        assert (masks[:, i // 64] & np.uint64(1 << (i % 64))).all()
        other = (i + 5) % 70
        assert np.count_nonzero(masks[:, other // 64] & np.uint64(1 << (other % 64))) < 10


def test_bpe(docs):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coder = bpe.BytePairCoder.from_rank_file(path, pattern)
    got = bpe.encode_documents(docs, path, pattern).select("text", "ids").collect()
    assert len(got) == docs.count() and all(coder.decode(r["ids"]).decode() == (r["text"] or "") for r in got)
    assert bpe.digest_tokens(docs.limit(0), path, pattern).count() == 0


def test_bpe_random_pieces():
    import tiktoken

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coder = bpe.BytePairCoder.from_rank_file(path, pattern)
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=coder.ranks, special_tokens={})
    rng = np.random.default_rng(5)
    letters = list("abcdeinorst") + ["é", "ß", "日", "\U0001f600", "\x00", " ", "  ", "\n", "'s", "12", "!!"]
    texts = ["".join(rng.choice(letters, rng.integers(1, 60))) for _ in range(1500)] + ["a" * 4000, " " * 3000, "ab" * 3000, "é" * 2000, "=" * 5000]
    for text in texts:
        assert coder.encode(text) == library.encode_ordinary(text)


def test_bpe_compatible_pairs():
    """Against the definition: merging the joined bytes by rank gives the two tokens again. Small memories change nothing."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coder = bpe.BytePairCoder.from_rank_file(path, pattern)

    def merged(raw):
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while True:
            able = [(coder.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in coder.ranks]
            if not able:
                return parts
            i = min(able)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    rng = np.random.default_rng(4)
    tokens = list(coder.ranks)
    near = [t for t in tokens if len(t) < 6 and set(t) <= set(b"aeinorst ")]
    pairs = [(tokens[i], tokens[j]) for i, j in rng.integers(0, len(tokens), (2000, 2))] + [(near[i], near[j]) for i, j in rng.integers(0, len(near), (6000, 2))]
    got = [coder.compatible(coder.ranks[a], coder.ranks[b]) for a, b in pairs]
    assert got == [merged(a + b) == [a, b] for a, b in pairs] and 0.05 < np.mean(got) < 0.95


def test_bpe_small_memory(monkeypatch):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    rng = np.random.default_rng(6)
    texts = [" ".join("".join(rng.choice(list("aeinorsth"), rng.integers(1, 12))) for _ in range(60)) for _ in range(40)]
    wide = bpe.BytePairCoder.from_rank_file(path, pattern)
    want = [wide.encode(t) for t in texts]
    monkeypatch.setattr(bpe, "PIECES", 10)
    monkeypatch.setattr(bpe, "PAIRS", 10)
    small = bpe.BytePairCoder.from_rank_file(path, pattern)
    assert [small.encode(t) for t in texts] == want


def test_components(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, 1001), (1001, 1000), (5, 5), (None, 3), (7, None), (1000, 1001)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, 1000: 1000, 1001: 1000}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_minhash(docs):
    got = {(r["doc_id"], r["class_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect()}
    assert (1, 1, True) in got and (2, 1, False) in got and (3, 3, True) in got and (4, 4, True) in got and (7, 7, True) in got
    assert (None, None, True) in got and minhash.near_duplicates(docs).count() == docs.count()
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("seed", "texts_of_block", "texts_of_stream"), [(3, 1024, 8192), (4, 16, 50)])
def test_minhash_hot_cloud(spark, monkeypatch, seed, texts_of_block, texts_of_stream):
    """Hundreds of texts around the similarity asked for, in shared buckets: no link of different components is lost."""
    monkeypatch.setattr(minhash, "BLOCK_TEXTS", texts_of_block)
    monkeypatch.setattr(minhash, "STREAM_TEXTS", texts_of_stream)
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(300):
        words = list(base)
        for at in rng.choice(60, rng.integers(0, 3), False):
            words[at] = f"v{rng.integers(1000)}"
        texts.append(" ".join(words))
    got = minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).toPandas().set_index("doc_id")["class_id"].to_dict()
    from tests.llm.test_brute_force import bags, components as plain

    table = list(bags(texts))
    links = [(a, b) for a in range(300) for b in range(a) if (s := (table[a] & table[b]).total()) >= 0.8 * (table[a].total() + table[b].total() - s)]
    assert got == plain(range(300), links)


def groups_of_three(spark, groups):
    """Classes that near_duplicates gives texts of which the first two of each three are alike (0.82), the third less (0.79), and
    those by the links of all pairs that share a band."""
    from tests.llm.test_brute_force import components as plain

    rng = np.random.default_rng(5)
    texts = []
    for g in range(groups):
        for changed in ([20], [50], [80, 81, 82]):  # of 100 shingles
            words = [f"g{g}w{i}" for i in range(104)]
            for at in changed:
                words[at] = f"g{g}v{at}"
            texts.append(" ".join(words))
    order = [int(i) for i in rng.permutation(len(texts))]
    made, stops = minhash.shingles(texts)
    bands = minhash.band_hashes(minhash.bag_signatures(made, stops, minhash.BANDS * minhash.ROWS))
    bags = [set(b.tolist()) for b in np.split(made, stops[:-1])]
    pairs = [pair for g in range(0, len(texts), 3) for pair in ((g, g + 1), (g, g + 2), (g + 1, g + 2))]
    links = [(order[a], order[b]) for a, b in pairs if (bands[a] == bands[b]).any() and len(bags[a] & bags[b]) >= 0.8 * len(bags[a] | bags[b])]
    assert len(links) > 0.99 * groups
    got = minhash.near_duplicates(spark.createDataFrame(list(zip(order, texts, strict=True)), "doc_id long, text string")).toPandas()
    return got.set_index("doc_id")["class_id"].to_dict(), plain(range(len(texts)), links)


def test_minhash_near_the_threshold(spark):
    """No link is lost where bytes of the marks agree by chance in a band that isn't shared."""
    got, want = groups_of_three(spark, 3000)
    assert got == want


def test_shingles_in_chunks(monkeypatch):
    """Where bytes are cut and how many shingles are drawn together changes nothing."""
    texts = ["", "one two three", " ".join(f"wörd{i % 37}" for i in range(300)), "x" * 400, " a  b\tc\nd e f " * 9]
    made, stops = minhash.shingles(texts)
    signature = minhash.bag_signatures(made, stops, 32)
    monkeypatch.setattr(minhash, "ELEMENTS", 7)
    for size in (1, 16, 100):
        monkeypatch.setattr(minhash, "PART_BYTES", size)
        again, ends = minhash.shingles(texts)
        assert (again == made).all() and (ends == stops).all()
    assert (minhash.bag_signatures(made, stops, 32) == signature).all()


def test_minhash_empty_blocks(spark, monkeypatch):
    """Buckets are cut by the sum of shingles, so that some blocks hold no text (as with a few texts of some MB each)."""
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 50)
    got, want = groups_of_three(spark, 50)
    assert got == want


def test_deduplicate_by_row(spark):
    """Repeated and null ids: a text that has no copy stays, and one row of each group."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(12)) for x in "abcd")
    rows = [(1, a), (2, a), (2, b), (None, a), (3, c), (3, c), (None, d), (None, d), (4, None), (4, None), (5, " ")]
    got = corpus_pipeline.deduplicate(spark, spark.createDataFrame([(i, "en", t) for i, t in rows], "doc_id long, lang string, text string"), "")
    assert got.columns == ["doc_id", "lang", "text"]
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in got.collect()))) == sorted(map(str, [(1, a), (2, b), (3, c), (None, d), (4, None), (4, None), (5, " ")]))


def test_embeddings(spark):
    schema = "vec_id long, embedding array<float>, label int, key int, home int"
    rows = [(None, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 1.0]), (5, [0.0, 3.0]), (6, [1e30, 1e30]), (7, [1.0])]
    df = spark.createDataFrame([(i, v, 0, 0, 0) for i, v in rows], schema)
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embed_dedup.near_vectors(df).collect()), key=str)
    assert (2, 1, 2, True) in got and (None, 1, 2, False) in got and got.count((5, 1, 5, True)) == 2 and (6, 0, 6, True) in got and (7, 0, 7, True) in got and len(got) == 8
    assert embed_dedup.near_vectors(df.limit(0)).count() == 0


def test_embeddings_of_doubles(spark):
    """Doubles that floats can't tell apart aren't copies, and values beyond a float's range link."""
    rows = [(1, [1.0, 0.0]), (2, [1.0, 1e-12]), (3, [1.0 + 1e-12, 0.0]), (4, [0.0, 1e200]), (5, [0.0, 2e200])]
    near = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embed_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert near == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (1, 4), 5: (1, 4)}


def test_index_recall():
    """Of pairs at exactly the similarity asked for, the fitted number of visits finds the target share."""
    rng = np.random.default_rng(0)
    x = rng.standard_normal((3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = embed_dedup.fit_index(x[:1500], 20_000)
    away = rng.standard_normal((1500, 64))
    away -= (away * x[1500:]).sum(1, keepdims=True) * x[1500:]
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    partner = 0.95 * x[1500:] + (1 - 0.95**2) ** 0.5 * away
    one_way = (index.order(x[1500:]) == index.order(partner, 1)).any(1)
    other = (index.order(partner) == index.order(x[1500:], 1)).any(1)
    assert one_way.mean() > 0.94 and (one_way | other).mean() > 0.97
    assert index.visits < len(index.books[0]) * len(index.books[1])


def test_multi_sequence_order():
    rng = np.random.default_rng(1)
    books = (rng.standard_normal((7, 3)), rng.standard_normal((5, 3)))
    x = rng.standard_normal((50, 6))
    got = embed_dedup.MultiIndex(books, 12).order(x)
    d = ((x[:, None, :3] - books[0]) ** 2).sum(2)[:, :, None] + ((x[:, None, 3:] - books[1]) ** 2).sum(2)[:, None, :]
    assert (got == np.argsort(d.reshape(50, -1), axis=1)[:, :12]).all()


def test_mix(spark, docs):
    labels = spark.createDataFrame([(1, "a"), (2, "a"), (8, "b"), (9, None), (None, "a"), (10, "z")], "doc_id long, domain string")
    got = mixing.mix(docs, labels, {"a": 0.5, "b": 0.5}).collect()
    assert len(got) == docs.count()
    assert all(abs(sum(r["chances"]) - 1) < 1e-9 and r["rate"] >= 0 and r["copies"] >= 0 for r in got)
    rows = [(i, ("red green " if i % 4 else "blue black ") * (i % 7 + 3)) for i in range(200)]
    told = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, "a" if i % 4 else "b") for i in range(100)], "doc_id long, domain string"), {"a": 0.5, "b": 0.5}, keep=("doc_id",)).collect()
    total = sum(r["tokens"] for r in told)
    for k in (0, 1):
        assert abs(sum(r["tokens"] * r["rate"] * r["chances"][k] for r in told) - total / 2) < 0.01 * total
    assert all((r["chances"][0] > 0.9) == bool(r["doc_id"] % 4) for r in told)
    assert mixing.mix(docs.limit(0), labels, {"a": 0.5, "b": 0.5}).count() == 0
    assert mixing.mix(docs, labels.limit(0), {"a": 0.5, "b": 0.5}).count() == docs.count()


@pytest.mark.parametrize(("sf", "least"), [("sf0.01", (0.93, 0.65, 0.6)), ("sf0.1", (0.98, 0.7, 0.65))])
def test_mix_on_held_out_labels(spark, sf_dir, sf, least):
    """Fitted on one half of the labels, the classifier tells the other half apart, in both directions: recall by domain."""
    table = sf_dir.rsplit("/", 1)[0] + "/" + sf
    documents, labels = spark.read.parquet(f"{table}/documents.parquet"), label_domains(spark.read.parquet(f"{table}/labels.parquet"))
    names, seen = list(MIX_TARGETS), []
    for half in (0, 1):
        mine = F.crc32(F.col("doc_id").cast("string")) % 2 == half
        model = mixing.fit_domains(documents, labels.where(~mine), names)
        seen.append(mixing.memberships(documents.join(labels.where(mine), "doc_id"), model).select("domain", "chances").toPandas())
    for k, name in enumerate(names):
        right = [np.argmax(p) == k for half in seen for p in half["chances"][half["domain"] == name]]
        assert np.mean(right) >= least[k], (name, np.mean(right))


def test_rates_against_plain_descent(spark):
    """The distributed fit meets feasible targets, with the same rates as the same steps in one process."""
    rng = np.random.default_rng(2)
    p = rng.dirichlet([0.3, 0.3, 0.3], 400)
    tokens = rng.integers(1, 500, 400)
    members = spark.createDataFrame([(int(t), [float(x) for x in row]) for t, row in zip(tokens, p, strict=True)], "tokens long, chances array<double>")
    target = tokens.sum() * np.array([0.6, 0.25, 0.15])
    steps = mixing.fit_rates(members, target)
    rate = np.ones(400)
    for _ in steps:
        moves = rate > 0
        gram = np.linalg.inv((p[moves] * tokens[moves, None]).T @ p[moves])
        rate = np.maximum(0, rate - p @ (gram @ ((tokens * rate) @ p - target)))
    got = np.array([r["rate"] for r in members.select(mixing.rate_of(F.col("chances"), steps).alias("rate")).collect()])
    assert np.allclose(got, rate, atol=1e-6) and np.allclose((tokens * got) @ p, target, rtol=1e-3)


def test_rates_of_targets_out_of_reach(spark):
    """The rates returned are close to the closest that there are, which lie on the ray of the most extreme document."""
    rng = np.random.default_rng(2)
    a = rng.uniform(0.3, 0.6, 400)
    p = np.stack([a, 1 - a], axis=1)
    tokens = rng.integers(1, 500, 400)
    members = spark.createDataFrame([(int(t), [float(x) for x in row]) for t, row in zip(tokens, p, strict=True)], "tokens long, chances array<double>")
    share = np.array([0.9, 0.1])
    steps = mixing.fit_rates(members, tokens.sum() * share)
    rate = np.array([r["rate"] for r in members.select(mixing.rate_of(F.col("chances"), steps).alias("rate")).collect()])
    ray = p[a.argmax()] / np.linalg.norm(p[a.argmax()])
    gap, least = np.linalg.norm((tokens * rate) @ p / tokens.sum() - share), np.linalg.norm(share - ray * (ray @ share))
    assert least <= gap + 1e-9 and gap < 1.03 * least


def test_pipeline(spark, sf_dir):
    """Stage by stage over sf0.01: columns, what goes and what stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir).persist()
        seen.append((name, docs.count()))
        if name != "tokens":
            assert docs.columns == names
        if name == "private":
            left = pii.find_pii(docs).select(F.explode("pii").alias("s")).where("s.kind in ('email', 'card', 'phone')")
            assert left.count() == 0
    counts = dict(seen)
    assert counts["language"] > 950 and counts["deduplicate"] < counts["language"] and counts["private"] == counts["deduplicate"]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    clean = labels.where("quality = 1 and toxic = 0").select("doc_id")
    before = minhash.near_duplicates(corpus_pipeline.language(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)).where("kept").join(clean, "doc_id").count()
    after = docs.select("doc_id").distinct().join(clean, "doc_id").count()
    assert after >= 0.97 * before


def test_language_is_evaluated_once(spark, docs):
    """A filter on the prediction doesn't make a second Python evaluation; other columns keep their values."""
    kept = corpus_pipeline.language(spark, docs, "")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert kept.columns == docs.columns and {r["score"] for r in kept.collect()} == {1.0}


def test_language_of_long_texts(spark):
    """Chunks of a text have the n-grams of the whole; a word longer than a chunk too."""
    text = " ".join(f"wort{i} ΣΑΣ é" for i in range(200)) + "x" * 500 + " ende"
    whole = np.sort(np.concatenate(list(langid.ngram_hashes(text))))
    for size in (20, 64, 300):
        parts = [langid._chunk_hashes(c) for c in langid.text_chunks(text, size)]
        assert (np.sort(np.concatenate(parts)) == whole).all() and len(parts) > 3


def test_pipeline_edges(spark, docs, sf_dir):
    """Every stage on nulls, empty and long texts, repeated rows, clashing names and an empty table."""
    clash = ("lang_pred", "tokens", "chances", "rate", "copies", "copy", "_found", "_draw", "_key", "_null", "_doc", "class", "pii", "text_")
    rows = docs.union(docs.where("doc_id = 10")).select(*[c for c in docs.columns if c not in clash], *[F.lit(f"own {c}").alias(c) for c in clash])
    names, size = rows.columns, rows.count()
    for table in (rows, rows.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            made = stage(spark, table, sf_dir)
            got = made.collect()
            if name == "tokens":
                assert made.columns[:3] == ["doc_id", "lang", "source"] and len(got) == (size if table is rows else 0)
                continue
            assert made.columns == names
            assert all(r[c] == f"own {c}" for r in got for c in clash) and all(r["score"] == 1.0 and r["key"] == "k" for r in got)
            if table is not rows:
                assert not got
            elif name == "private":
                assert len(got) == size and not any("a.b@c.org" in (r["text"] or "") for r in got)
            elif name == "deduplicate":
                assert len(got) == size - 3  # ids 2, 7 and 10 had copies
            elif name == "language":
                assert {r["doc_id"] for r in got} >= {1, 2, 7, 8} and not {r["doc_id"] for r in got} & {3, 4, 5, 6}


def test_pipeline_leaves_no_tables(spark, tmp_path):
    """run() keeps only what its result reads, and gives what the stages give one by one."""
    from pathlib import Path

    sf_dir = "/root/testdata/sf0.001"
    before = {p for p in Path(common.shared_dir(spark).removeprefix("file:")).iterdir()}
    got = sorted(map(str, corpus_pipeline.run(spark, sf_dir).collect()))
    made = {p for p in Path(common.shared_dir(spark).removeprefix("file:")).iterdir()} - before
    assert len(made) == len(corpus_pipeline.STAGES) - 1
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir).persist()
    assert got == sorted(map(str, docs.collect()))
