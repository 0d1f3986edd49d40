"""MinHash near-dedup (operator 4): BagMinHash signatures of word shingles, banding, exact verification.

A text is the multiset of its five-word shingles. A shingle of weight ``w`` owns the level range ``[0, w)``, which
is cut into dyadic blocks ``[0, 1), [1, 2), [2, 4), ...``; each block is a Poisson process whose points come in order
of time, carry a signature component, and in the last block a level that halving has drawn: points at or above
``w`` don't count. A component's value is the earliest point that falls on it, so two texts agree on a component
with a probability equal to their weighted Jaccard similarity. Points are only drawn until all components are set.

Bands of the signature propose pairs, which are verified by the overlap of the multisets:

1. Every text tries one partner: of its buckets' most popular members (that share most buckets) the most popular one.
2. What is left are buckets that still hold texts of different components. Those outside the bucket's largest component are
   dealt in blocks, so that a task holds one block of bounded size while the bucket's texts stream past it, and all its
   pairs across components are compared: by size and by their whole signatures first (pairs more than 4 standard
   deviations short of the similarity are out), then exactly. Only links leave the task.

So no pair is spelled out as a row, except one for each text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cut, free_name, maybe_among
from .components import connected_components

WORDS = 5
SIMILARITY = 0.8
#: 40 bands of 8: a pair at similarity 0.8 is proposed with probability 0.9993, at 0.85 with 0.999997.
BANDS = 40
ROWS = 8
#: Texts of a batch are worked on in parts of about so many bytes.
PART_BYTES = 1_000_000
#: Shingles whose points are drawn together.
ELEMENTS = 1 << 18
#: Bounds of a block of a bucket, and how many texts stream past one block in one task.
BLOCK_TEXTS = 1024
BLOCK_SHINGLES = 1_000_000
STREAM_TEXTS = 8192

_U = np.uint64
_GOLD, _M1, _M2 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_BASE = _U(0x100000001B3)
_BASE_INVERSE = _U(pow(0x100000001B3, -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of some bytes, and where each begins."""
    space = _SPACE[data]
    first = ~space
    first[1:] &= space[:-1]
    last = ~space
    last[:-1] &= space[1:]
    begin, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    powers = np.full(len(data) + 1, _BASE, dtype=_U)
    powers[0] = 1
    powers = np.cumprod(powers)
    total = np.concatenate((np.zeros(1, dtype=_U), np.cumsum((data.astype(_U) + _U(1)) * powers[:-1])))
    inverse = np.full(len(data) + 1, _BASE_INVERSE, dtype=_U)
    inverse[0] = 1
    inverse = np.cumprod(inverse)
    return _mix((total[stop] - total[begin]) * inverse[begin]), begin


def shingles(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of all texts, sorted within each text, and where each text's part ends.

    Words are parted by ASCII white space and lower-cased. A text of one to four words is one shingle; a text
    without words has none. Bytes are worked on in chunks that end between words, so that memory follows the words.
    """
    raws = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join([*raws, b""]), dtype=np.uint8)
    ends = np.cumsum([len(r) + 1 for r in raws])
    found, at = [], 0
    while at < len(data):
        end = at + PART_BYTES
        while end < len(data) and not (space := _SPACE[data[end : end + PART_BYTES]]).any():
            end += PART_BYTES
        end = end + int(space.argmax()) if end < len(data) else len(data)
        hashed, begin = _word_hashes(data[at:end])
        found.append((hashed, begin + at))
        at = end
    hashed, begin = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, dtype=_U), np.zeros(0, dtype=np.int64))
    owner = np.searchsorted(ends, begin, side="right")
    n = np.bincount(owner, minlength=len(texts))
    made = np.zeros(max(0, len(hashed) - words + 1), dtype=_U)
    for k in range(words):
        made = _mix((made * _GOLD) ^ hashed[k : k + len(made)])
    whole = owner[: len(made)] == owner[words - 1 :] if len(made) else np.zeros(0, dtype=bool)
    made, owner_of = made[whole], owner[: len(made)][whole]
    short = np.flatnonzero((n > 0) & (n < words))
    if len(short):
        at = np.cumsum(n) - n
        extra = []
        for d in short:
            h = np.zeros(1, dtype=_U)
            for k in range(n[d]):
                h = _mix((h * _GOLD) ^ hashed[at[d] + k])
            extra.append(_mix(h + _U(n[d]))[0])
        made = np.concatenate((made, np.array(extra, dtype=_U)))
        owner_of = np.concatenate((owner_of, short))
        order = np.argsort(owner_of, kind="stable")
        made = made[order]
    sizes = np.where(n >= words, n - words + 1, (n > 0).astype(int))
    stops = np.cumsum(sizes)
    for a, b in zip(stops - sizes, stops, strict=True):
        made[a:b].sort()
    return made, stops


def _runs(made: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal shingles of one text begin, and the text each shingle belongs to."""
    owner = np.repeat(np.arange(len(stops)), np.diff(stops, prepend=0))
    new = np.ones(len(made), dtype=bool)
    new[1:] = (made[1:] != made[:-1]) | (owner[1:] != owner[:-1])
    return np.flatnonzero(new), owner


def bag_signatures(made: np.ndarray, stops: np.ndarray, size: int, slack: float = 4.0) -> np.ndarray:
    """Signatures (a row of ``size`` times for each text) of the multisets from :func:`shingles`."""
    starts, owner = _runs(made, stops)
    weight = np.diff(starts, append=len(made))
    texts = len(stops)
    # a process for each element and dyadic block that its weight reaches into
    element, block = [np.arange(len(starts))], [np.zeros(len(starts), dtype=np.int64)]
    b = 1
    while len(more := np.flatnonzero(weight > 1 << (b - 1))):
        element.append(more)
        block.append(np.full(len(more), b))
        b += 1
    element, block = np.concatenate(element), np.concatenate(block)
    low = np.where(block > 0, 1 << np.maximum(block - 1, 0), 0)  # the block is [low, low + rate)
    rate = np.maximum(low, 1)
    seed = _mix(made[starts][element] + block.astype(_U) * _GOLD)
    text, most = owner[starts][element], weight[element]
    mass = np.bincount(owner, minlength=texts)
    limit = size * (np.log(size) + slack) / np.maximum(mass, 1)
    signature = np.full(texts * size, np.inf)
    for first in range(0, len(element), ELEMENTS):
        active = np.arange(first, min(first + ELEMENTS, len(element)))
        time, k = np.zeros(len(active)), 0
        while len(active):
            ahead = int(np.clip(100_000 // len(active), 1, 64))
            draw = _mix(seed[active][:, None] + _GOLD * np.arange(k + 1, k + ahead + 1, dtype=_U)[None, :])
            step = -np.log(((draw >> _U(11)).astype(float) + 1) * 2.0**-53) / rate[active][:, None]
            step[:, 0] += time
            times = np.cumsum(step, axis=1)  # in this order whatever ``ahead`` is, so that equal points have equal times
            other = _mix(draw + _M1)
            level = low[active][:, None] + ((other >> _U(32)) & (rate[active][:, None].astype(_U) - _U(1))).astype(np.int64)
            counts = (times <= limit[text[active]][:, None]) & (level < most[active][:, None])
            slot = text[active][:, None] * size + ((other & _U(0xFFFFFFFF)) % _U(size)).astype(np.int64)
            np.minimum.at(signature, slot[counts], times[counts])
            time = times[:, -1]
            go = time <= limit[text[active]]
            active, time, k = active[go], time[go], k + ahead
    signature = signature.reshape(texts, size)
    for d in np.flatnonzero((mass > 0) & np.isinf(signature).any(axis=1)):  # a component is still unset: draw further
        a, z = (stops[d - 1] if d else 0), stops[d]
        signature[d] = bag_signatures(made[a:z], np.array([z - a]), size, slack * 3)[0]
    return signature


def band_hashes(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    values = signature.view(_U).reshape(len(signature), bands, rows)
    h = np.broadcast_to(_mix(np.arange(1, bands + 1, dtype=_U) * _GOLD), values.shape[:2]).copy()
    for r in range(rows):
        h = _mix((h * _GOLD) ^ values[:, :, r])
    return h.view(np.int64)


def _parts(texts: pd.Series) -> Iterator[tuple[int, list[str]]]:
    at, part, size = 0, [], 0
    for i, t in enumerate(texts):
        part.append(t)
        size += len(t)
        if size >= PART_BYTES:
            yield at, part
            at, part, size = i + 1, [], 0
    if part:
        yield at, part


def content_key(text: Column) -> Column:
    """128 bits that stand for a text."""
    return F.unhex(F.left(F.sha2(text, 256), F.lit(32)))


def band_table(texts: DataFrame) -> DataFrame:
    """``key, text`` to ``key, bands`` and ``n`` (all shingles); texts without words are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at, part in _parts(batch["text"]):
                made, stops = shingles(part)
                full = np.flatnonzero(np.diff(stops, prepend=0) > 0)
                if len(full):
                    signature = bag_signatures(made, stops, BANDS * ROWS)[full]
                    yield pd.DataFrame({"key": batch["key"].iloc[at + full].to_numpy(), "bands": list(band_hashes(signature)), "n": np.diff(stops, prepend=0)[full]})

    return texts.mapInPandas(run, "key binary, bands array<long>, n int")


def bag_table(texts: DataFrame) -> DataFrame:
    """``key, text`` of texts with words to ``key, bag`` (its different shingles, sorted), ``times`` (how often each), ``bands, marks`` (a
    byte for each component) and ``n``.

    Signatures are made again here: only texts of shared buckets come, and what the others would carry isn't shuffled.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at, part in _parts(batch["text"]):
                made, stops = shingles(part)
                starts, _ = _runs(made, stops)
                times = np.diff(starts, append=len(made)).astype(np.int32)
                ends = np.searchsorted(starts, stops)[:-1]
                signature = bag_signatures(made, stops, BANDS * ROWS)
                yield pd.DataFrame({
                    "key": batch["key"].iloc[at : at + len(part)].to_numpy(),
                    "bag": np.split(made[starts].view(np.int64), ends),
                    "times": np.split(times, ends),
                    "bands": list(band_hashes(signature)),
                    "marks": [m.tobytes() for m in _mix(signature.view(_U)).astype(np.uint8)],
                    "n": np.diff(stops, prepend=0),
                })

    return texts.mapInPandas(run, "key binary, bag array<long>, times array<int>, bands array<long>, marks binary, n int")


def overlap(bag_a: np.ndarray, times_a: np.ndarray, bag_b: np.ndarray, times_b: np.ndarray) -> int:
    """Shingles that two multisets share."""
    _, i, j = np.intersect1d(bag_a, bag_b, assume_unique=True, return_indices=True)
    return int(np.minimum(times_a[i], times_b[j]).sum())


def _verified(pairs: DataFrame, bags: DataFrame, similarity: float) -> DataFrame:
    """Those pairs ``u, v`` whose multisets overlap enough: shared / (all - shared) >= ``similarity``."""
    sides = [bags.select(F.col("key").alias(x), F.col("bag").alias(f"bag_{x}"), F.col("times").alias(f"times_{x}"), F.col("n").alias(f"n_{x}")) for x in "uv"]
    sizes = [side.select(x, f"n_{x}") for side, x in zip(sides, "uv", strict=True)]
    able = pairs.join(sizes[0], "u").join(sizes[1], "v").where(F.least("n_u", "n_v") >= similarity * F.greatest("n_u", "n_v"))  # sizes alone rule out the rest
    joined = able.select("u", "v").join(sides[0], "u").join(sides[1], "v")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            shared = np.array([overlap(a, x, b, y) for a, x, b, y in zip(batch["bag_u"], batch["times_u"], batch["bag_v"], batch["times_v"], strict=True)], dtype=float)
            yield batch.loc[shared >= similarity * (batch["n_u"].to_numpy() + batch["n_v"].to_numpy() - shared), ["u", "v"]]

    return joined.mapInPandas(run, "u binary, v binary")


def _links_within(open_members: DataFrame, bags: DataFrame, similarity: float) -> DataFrame:
    """Links ``u, v`` between texts of one bucket and different components.

    ``open_members``: ``band, no`` (the band's number), ``key, root, outside`` (whether the root isn't the bucket's most
    frequent one), ``blocks, streams``. At least one text of a pair is outside, so those are held in blocks and all texts of
    the bucket stream past them: the work is their number times all, not all squared. A block's stream is dealt over
    several tasks, which hold a copy of the block each. Every pair meets once: a text from outside streams past its own
    block and those of lower numbers only.
    """
    own, stream = F.pmod(F.xxhash64("key"), "blocks").cast("int"), F.pmod(F.xxhash64("key", F.lit(7)), "streams").cast("int")
    placed = open_members.withColumn("own", F.when(F.col("outside"), own)).withColumn("stream", stream).join(bags, "key")
    columns = ["band", "block", "stream", "role", "no", "key", "root", "bands", "marks", "bag", "times", "n"]
    held = placed.where("outside").withColumn("block", F.col("own")).withColumn("stream", F.explode(F.sequence(F.lit(0), F.col("streams") - 1))).withColumn("role", F.lit(0)).select(columns)
    last = F.coalesce("own", F.col("blocks") - 1)
    passing = placed.withColumn("block", F.explode(F.sequence(F.lit(0), last))).withColumn("role", F.when(F.col("own") == F.col("block"), 1).otherwise(2)).select(columns)
    alike = similarity - 4 * (similarity * (1 - similarity) / (BANDS * ROWS)) ** 0.5

    def compare(here: dict, row, own: bool, joined: dict) -> Iterator[tuple]:
        def find(x: bytes) -> bytes:
            while joined.get(x, x) != x:
                x = joined[x]
            return x

        near = np.minimum(here["n"], row.n) >= similarity * np.maximum(here["n"], row.n)
        near &= here["root"] != row.root
        if own:
            near &= here["key"] < row.key
        at = np.flatnonzero(near)
        share = (here["marks"][at] == np.frombuffer(row.marks, dtype=np.uint8)).mean(1)
        at = at[share >= alike]
        if len(at):  # a pair that shares several bands belongs to the first of them; marks can't tell, as a byte may collide
            first = (here["bands"][at] == row.bands).argmax(1)
            at = at[first == row.no]
        for i in at:
            if find(here["root"][i]) == find(row.root):
                continue  # connected meanwhile
            shared = overlap(here["bag"][i], here["times"][i], row.bag, row.times)
            if shared >= similarity * (here["n"][i] + row.n - shared):
                joined[find(here["root"][i])] = find(row.root)
                yield here["key"][i], row.key

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, parts, here, joined = None, [], None, {}
        for batch in batches:
            found = []
            for (band, block, stream, role), part in batch.groupby(["band", "block", "stream", "role"], sort=False):
                if (band, block, stream) != at:
                    at, parts, here, joined = (band, block, stream), [], None, {}
                if role == 0:
                    parts.append(part)
                    continue
                if not parts:
                    continue  # no text hashed into this block
                if here is None:
                    whole = pd.concat(parts, ignore_index=True)
                    here = {c: whole[c].to_numpy() for c in ("key", "root", "bag", "times", "n")}
                    here["bands"] = np.stack(whole["bands"])
                    here["marks"] = np.stack([np.frombuffer(m, dtype=np.uint8) for m in whole["marks"]])
                for row in part.itertuples(index=False):
                    found += compare(here, row, role == 1, joined)
            yield pd.DataFrame(found, columns=["u", "v"])

    together = held.unionByName(passing).repartition("band", "block", "stream").sortWithinPartitions("band", "block", "stream", "role")
    return together.mapInPandas(run, "u binary, v binary").distinct()


#: Texts with a word.
_WORDED = r"[^\x20\x09-\x0D]"


def _roots(rows: DataFrame, similarity: float) -> DataFrame:
    """``text, key`` to ``node, root``: the keys of texts that link with others, and the smallest key of their group."""
    bound_batches(rows.sparkSession)
    worded = rows.where(F.col("text").rlike(_WORDED)).select("key", "text")
    signed = band_table(worded)
    bands = cut(signed.groupBy("key").agg(*[F.first(c).alias(c) for c in ("bands", "n")]))
    placed = bands.select("key", "n", F.posexplode("bands").alias("no", "band"))
    # what is joined to a bucket's members is written first: a bucket may hold a third of all texts, and Spark splits such a
    # key only if the other side isn't an aggregate of the same stage
    shared = cut(placed.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), short=True)
    # most buckets hold one text, and most texts share none: these are dropped before rows are shuffled
    members = cut(maybe_among(placed, shared, "band").join(shared, "band"))
    popular = cut(members.groupBy("key").agg(F.sum("size").alias("popular")), short=True)
    texts = maybe_among(worded, popular, "key").groupBy("key").agg(F.first("text").alias("text")).join(popular.select("key"), "key", "left_semi")
    bags = cut(bag_table(texts))

    known = members.join(popular, "key")
    leads = cut(known.groupBy("band").agg(F.max(F.struct("popular", "key")).alias("lead")), short=True)
    tries = known.join(leads, "band").where("key <> lead.key").groupBy("key").agg(F.max("lead").alias("lead"))
    links = cut(_verified(tries.select(F.col("key").alias("u"), F.col("lead.key").alias("v")), bags, similarity))
    roots = connected_components(links)

    held = cut(members.select("band", "no", "key", "n").join(roots.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key")))
    of_root = held.groupBy("band", "root").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("shingles"))
    of_band = of_root.groupBy("band").agg(F.max(F.struct("texts", "shingles", "root")).alias("most"), F.sum("texts").alias("texts"), F.sum("shingles").alias("shingles")).where("texts > most.texts")
    blocks = F.ceil(F.greatest((F.col("texts") - F.col("most.texts")) / BLOCK_TEXTS, (F.col("shingles") - F.col("most.shingles")) / BLOCK_SHINGLES)).cast("int")
    several = cut(of_band.select("band", F.col("most.root").alias("most"), blocks.alias("blocks"), F.ceil(F.col("texts") / STREAM_TEXTS).cast("int").alias("streams")), short=True)
    open_members = held.join(several, "band").select("band", "no", "key", "root", (F.col("root") != F.col("most")).alias("outside"), "blocks", "streams")
    links = cut(links.union(_links_within(cut(open_members, short=True), bags, similarity)), short=True)
    return connected_components(links)


def near_duplicates(documents: DataFrame, similarity: float = SIMILARITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``key``, ``class_id`` (the smallest key of its group) and ``kept`` (the row that stays).

    Groups are the connected components of links: exact copies, and texts with a weighted Jaccard similarity of
    their five-word shingles of ``similarity`` or more. Null texts and texts without words link with nothing and are
    kept. Rows that repeat a key share its verdict; a row with a null key goes if its group has a row with a key. An
    empty table gives no rows. Columns other than these two are ignored.
    """
    rows = documents.select(F.col(key).alias("doc"), F.col(text).alias("text"), content_key(F.coalesce(text, F.lit(""))).alias("key"))
    roots = _roots(rows, similarity)

    # exact copies share a key already; texts without words have a class for each row
    named = rows.select("doc", F.when(F.col("text").rlike(_WORDED), F.col("key")).alias("key"))
    named = cut(named.join(roots.select(F.col("node").alias("key"), "root"), "key", "left").select("doc", F.coalesce("root", "key").alias("class")))
    least = cut(named.where("class is not null").groupBy("class").agg(F.min("doc").alias("class_id")), short=True)
    judged = named.join(least, "class", "left")
    alone = F.col("class").isNull()
    return judged.select(F.col("doc").alias(key), F.when(alone, F.col("doc")).otherwise(F.col("class_id")).alias("class_id"), (alone | F.col("doc").eqNullSafe(F.col("class_id"))).alias("kept"))


def one_of_each(documents: DataFrame, similarity: float = SIMILARITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all their columns: one row of each group of :func:`near_duplicates`.

    It is the row with the group's smallest key (null comes last); if several texts of the group have that key, the
    one with the smallest hash; of rows that repeat both, any. All rows with null texts or without words stay.
    """
    content, null, doc = by = [free_name(n, documents.columns) for n in ("_key", "_null", "_doc")]
    named = documents.select("*", content_key(F.coalesce(text, F.lit(""))).alias(content), F.col(key).isNull().alias(null), F.coalesce(F.col(key).cast("string"), F.lit("")).alias(doc))
    worded = F.coalesce(F.col(text).rlike(_WORDED), F.lit(False))
    rows = named.where(worded).select(F.col(key).alias("id"), F.col(text).alias("text"), F.col(content).alias("key"), F.col(null).alias("null"), F.col(doc).alias("doc"))
    roots = _roots(rows, similarity).select(F.col("node").alias("key"), "root")
    least = rows.drop("text").join(roots, "key", "left").groupBy(F.coalesce("root", "key").alias("class")).agg(F.min(F.struct("null", "id", "key", "doc")).alias("least"))
    chosen = cut(least.select(F.col("least.key").alias(content), F.col("least.null").alias(null), F.col("least.doc").alias(doc)), short=True)
    stay = named.where(worded).join(chosen, by).dropDuplicates(by)
    return stay.select(documents.columns).unionByName(named.where(~worded).select(documents.columns))
