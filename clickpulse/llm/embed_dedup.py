"""Embedding near-dedup (operator 10): an inverted multi-index over the halves of unit vectors.

Two independent codebooks, one for each half, form a grid of cells; every vector lies in the cell of its nearest
pair of codewords. A search walks the cells in the order of the multi-sequence (sum of both squared distances) and
stops at the number of cells that a sample needed to reach the target recall, at the similarity asked for. Every
pair that meets in a cell is verified by its cosine in double precision.

Cells are dealt in blocks of bounded size, so a cell with a third of all vectors is many tasks. A task holds one
block; searches stream past it. It returns sums and a spanning forest of links, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cut
from .components import connected_components

SIMILARITY = 0.95
#: Of pairs at exactly the similarity asked for, seen from one side; pairs seen from either side count.
TARGET_RECALL = 0.97
#: Vectors that codebooks and the number of cells to visit are fitted on: at least, and at most where many rows want many codewords.
FIT_SAMPLE, FIT_MOST = 4096, 16384
#: Rows that a cell should have, and vectors of the sample that a codeword should have.
CELL_ROWS_WANTED, VECTORS_PER_CODEWORD = 512, 8
#: Vectors whose distances to all codewords the driver holds at once.
SLICE = 512
#: Vectors of a block.
BLOCK = 2048


@dataclass(frozen=True)
class MultiIndex:
    """``books[h]``: the codewords of half ``h``. ``visits``: cells that a search visits."""

    books: tuple[np.ndarray, np.ndarray]
    visits: int

    def order(self, unit: np.ndarray, visits: int | None = None) -> np.ndarray:
        """The first cells of each vector's multi-sequence, nearest first; the first is its own cell.

        The sequence of a sum of two sorted lists: the best n of it lie where (i + 1) * (j + 1) <= n.
        """
        visits = visits or self.visits
        half = self.books[0].shape[1]
        ranked, near = [], []
        for part, book in zip((unit[:, :half], unit[:, half:]), self.books, strict=True):
            d = (book**2).sum(1)[None, :] - 2 * part @ book.T
            by = np.argsort(d, axis=1, kind="stable")[:, : min(visits, len(book))]
            ranked.append(by)
            near.append(np.take_along_axis(d, by, 1))
        i, j = np.nonzero((np.arange(near[0].shape[1])[:, None] + 1) * (np.arange(near[1].shape[1])[None, :] + 1) <= visits)
        total = near[0][:, i] + near[1][:, j]
        best = np.argsort(total, axis=1, kind="stable")[:, :visits]
        return np.take_along_axis(ranked[0][:, i] * len(self.books[1]) + ranked[1][:, j], best, 1).astype(np.int32)


def _distances(points: np.ndarray, book: np.ndarray) -> Iterator[np.ndarray]:
    """Squared distances to all codewords, without the points' own squares, in slices of the points."""
    for i in range(0, len(points), SLICE):
        yield (book**2).sum(1)[None, :] - 2 * points[i : i + SLICE] @ book.T


def _codebook(points: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Lloyd's algorithm from evenly spaced points of the sample."""
    book = points[np.linspace(0, len(points) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = np.concatenate([d.argmin(1) for d in _distances(points, book)])
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(book)
        np.add.at(total, near, points)
        book[n > 0] = total[n > 0] / n[n > 0, None]
    return book


def codewords(rows: int) -> int:
    """Codewords of a half, so that cells have ``CELL_ROWS_WANTED`` rows on average."""
    return max(1, round((rows / CELL_ROWS_WANTED) ** 0.5))


def sample_size(rows: int) -> int:
    """Vectors to fit on: as many as the codewords need, three in four of them, within both bounds."""
    return min(FIT_MOST, max(FIT_SAMPLE, codewords(rows) * VECTORS_PER_CODEWORD * 4 // 3))


def _ranks(books: tuple[np.ndarray, np.ndarray], sample: np.ndarray, partner: np.ndarray) -> np.ndarray:
    """How many cells are nearer to each sample vector than the cell that its partner lies in.

    A cell's distance is a sum of one of each half, so with one half sorted the nearer ones are counted by binary search.
    """
    half = books[0].shape[1]
    at = [np.concatenate([d.argmin(1) for d in _distances(part, book)]) for part, book in zip((partner[:, :half], partner[:, half:]), books, strict=True)]
    ranks, i = np.zeros(len(sample), dtype=np.int64), 0
    for first, second in zip(_distances(sample[:, :half], books[0]), _distances(sample[:, half:], books[1]), strict=True):
        for a, b in zip(first, second, strict=True):
            left = a[at[0][i]] + b[at[1][i]] - a
            left[at[0][i]] = b[at[1][i]]  # exactly
            ranks[i] = np.searchsorted(np.sort(b), left, "left").sum()
            i += 1
    return ranks


def fit_index(sample: np.ndarray, rows: int, similarity: float = SIMILARITY, recall: float = TARGET_RECALL) -> MultiIndex:
    """Codebooks of a size that follows the number of ``rows`` to index, and the cells to visit.

    Every fourth sample vector is held out from the codebooks. For each of these a partner is drawn at the cosine
    ``similarity`` in a random direction (the hardest that must be found); ``visits`` is the rank of the partner's cell
    that ``recall`` of them stay within. Memory is the sample, the codebooks and ``SLICE`` rows of distances, however many cells
    there are. A sample of ``FIT_MOST`` gives 1,536 codewords; beyond 1.2 billion rows, cells grow with the rows.
    """
    held = np.arange(len(sample)) % 4 == 3
    train, sample = (sample[~held], sample[held]) if held.any() else (sample, sample)
    k = min(codewords(rows), max(1, len(train) // VECTORS_PER_CODEWORD))
    half = (sample.shape[1] + 1) // 2
    books = (_codebook(train[:, :half], k), _codebook(train[:, half:], k))
    rng = np.random.default_rng(20_011)
    away = rng.standard_normal(sample.shape)
    away -= (away * sample).sum(1, keepdims=True) * sample
    away /= np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-12)
    partner = similarity * sample + (1 - similarity**2) ** 0.5 * away
    visits = int(np.quantile(_ranks(books, sample, partner), recall, method="higher")) + 1
    return MultiIndex(books, visits)


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(v, dtype=float) for v in vectors])
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow of the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vector: Column, size: Column | int) -> Column:
    """Not null, of the usual size, not all zero, without null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) == size) & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0)


def _forest(i: np.ndarray, j: np.ndarray, nodes: int) -> np.ndarray:
    """The smallest node of each node's component under links ``i, j``."""
    label = np.arange(nodes)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


CELL_ROWS = "cell int, block int, role int, home int, key binary, copies long, vector array<float>, visited array<int>"
FOUND = "key binary, links long, other binary"


def near_vectors(embeddings: DataFrame, similarity: float = SIMILARITY, recall: float = TARGET_RECALL, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per vector: ``key, n_links, component_id, kept``.

    ``n_links``: other rows with a cosine of ``similarity`` or more among those found; exact copies always are.
    ``component_id``: the smallest key reachable by links. ``kept``: ``key = component_id``. Vectors that are null,
    zero, of another size than most, or hold a null or non-finite component link with nothing. Rows with a null key
    are linked like others, and keep a null ``component_id`` only where no key is reachable. Repeated rows are rows of
    their own. An empty table gives no rows. Columns other than these two are ignored.
    """
    spark = embeddings.sparkSession
    bound_batches(spark)
    plain = embeddings.select(F.col(key).alias("id"), F.col(vector).alias("vector"))
    kind = "float" if plain.schema["vector"].dataType.elementType.typeName() == "float" else "double"  # others fit into a double
    rows = plain.withColumn("vector", F.col("vector").cast(f"array<{kind}>"))
    usual = rows.where("vector is not null").agg(F.mode(F.size("vector"), True)).first()[0] or 0
    content = F.unhex(F.left(F.sha2(F.transform("vector", lambda x: x + F.lit(0.0).cast(kind)).cast("string"), 256), F.lit(32)))  # -0 is 0
    good = usable(F.col("vector"), F.lit(usual))
    keyed = cut(rows.select("id", "vector", F.when(good, content).alias("key")))
    # exact copies are one row from here on
    distinct = cut(keyed.where("key is not null").groupBy("key").agg(F.first("vector").alias("vector"), F.count(F.lit(1)).alias("copies")))
    total = distinct.count()
    if total > 1:
        sample = distinct.orderBy("key").limit(sample_size(total)).select("vector").toPandas()["vector"]  # keys are hashes: any rows
        index = spark.sparkContext.broadcast(fit_index(_unit(sample), total, similarity, recall))
        found = cut(_search(distinct, index, similarity))
        counts = found.where("other is null").groupBy("key").agg(F.sum("links").alias("links"))
        roots = connected_components(found.where("other is not null").select(F.col("key").alias("u"), F.col("other").alias("v")))
        # groups and least keys are written before they are joined, so that Spark can split copies of one vector
        groups = cut(
            distinct.select("key", "copies")
            .join(counts, "key", "left")
            .join(roots.select(F.col("node").alias("key"), "root"), "key", "left")
            .select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "key").alias("root")),
            short=True,
        )
    else:
        groups = distinct.select("key", (F.col("copies") - 1).alias("n_links"), F.col("key").alias("root"))
    named = cut(keyed.select("id", "key").join(groups, "key", "left").select("id", "n_links", "root"))
    least = cut(named.where("root is not null").groupBy("root").agg(F.min("id").alias("least")), short=True)
    judged = named.join(least, "root", "left").select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id"))
    return judged.select(F.col("id").alias(key), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _search(distinct: DataFrame, index, similarity: float) -> DataFrame:
    """``key, links, other``: partial sums of linked rows (``other`` null) and forest edges (``other`` set)."""

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(visited=list(index.value.order(_unit(batch["vector"]))))

    placed = cut(distinct.mapInPandas(place, f"key binary, vector {distinct.schema['vector'].dataType.simpleString()}, copies long, visited array<int>"))
    home = F.get("visited", F.lit(0))
    blocks = placed.groupBy(home.alias("cell")).agg(F.ceil(F.count(F.lit(1)) / F.lit(float(BLOCK))).cast("int").alias("blocks"))  # a row per cell
    residents = placed.join(blocks, home == F.col("cell")).select("cell", F.pmod(F.xxhash64("key"), "blocks").cast("int").alias("block"), F.lit(0).alias("role"), home.alias("home"), "key", "copies", "vector", "visited")
    asked = placed.select("*", F.explode("visited").alias("cell")).join(blocks, "cell")
    queries = asked.select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("role"), home.alias("home"), "key", "copies", "vector", F.lit(None).cast("array<int>").alias("visited"))

    def meet(here: pd.DataFrame, unit: np.ndarray, seen: np.ndarray, asking: pd.DataFrame) -> Iterator[pd.DataFrame]:
        q = _unit(asking["vector"])
        homes, keys = asking["home"].to_numpy(), np.concatenate((asking["key"].to_numpy(), here["key"].to_numpy()))
        copies = np.concatenate((asking["copies"].to_numpy(), here["copies"].to_numpy()))
        i, j = np.nonzero(q @ unit.T >= similarity)
        other = keys[i] != keys[len(q) + j]
        i, j = i[other], j[other]
        # if the resident visits the searcher's cell too, the pair is met there again, from the other side
        both = (seen[j] == homes[i][:, None]).any(1)
        links = np.bincount(i, weights=copies[len(q) + j], minlength=len(keys)) + np.bincount(len(q) + j[~both], weights=copies[i[~both]], minlength=len(keys))
        linked = np.flatnonzero(links)
        yield pd.DataFrame({"key": keys[linked], "links": links[linked].astype(np.int64), "other": None})
        label = _forest(i, len(q) + j, len(keys))
        tied = np.flatnonzero(label != np.arange(len(keys)))
        yield pd.DataFrame({"key": keys[tied], "links": 0, "other": keys[label[tied]]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, here, unit, seen = None, [], None, None
        for batch in batches:
            for (cell, block, role), part in batch.groupby(["cell", "block", "role"], sort=False):
                if (cell, block) != at:
                    at, here, unit = (cell, block), [], None
                if role == 0:
                    here.append(part)
                elif here:
                    if unit is None:
                        here = [pd.concat(here, ignore_index=True)]
                        unit, seen = _unit(here[0]["vector"]), np.stack(here[0]["visited"])
                    for a in range(0, len(part), 512):
                        yield from meet(here[0], unit, seen, part.iloc[a : a + 512])

    together = residents.unionByName(queries).repartition("cell", "block").sortWithinPartitions("cell", "block", "role")
    return together.mapInPandas(run, FOUND)
