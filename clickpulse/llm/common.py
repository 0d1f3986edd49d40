"""What several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: the session's checkpoint folder.

    A cluster names it in ``spark.checkpoint.dir``. Where that is unset, a local master gets a
    temporary folder and any other master a folder of the warehouse, which executors share.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            local = sc.master.split("[")[0] == "local"
            named = tempfile.mkdtemp(prefix="spark-") if local else spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


_FOLDER: ContextVar[str | None] = ContextVar("folder", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that operators write inside are deleted at the end; what is wanted of them must have been written by then."""
    folder = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    before = _FOLDER.set(folder)
    try:
        yield
    finally:
        _FOLDER.reset(before)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Files per core that a table of short rows is written as at most, or shuffle partitions per file, whichever are more files.
FILES_PER_CORE = 4
PARTITIONS_PER_FILE = 4


def cut(df: DataFrame, short: bool = False) -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it back: cuts lineage and survives lost executors.

    ``short``: rows of a few numbers. Such a table is written by no more tasks than a small multiple of the cores there are or a
    quarter of the session's shuffle partitions, each of which takes several partitions one after another, instead of as a great many
    tiny files. Shuffle partitions are set for the data's size, so a plan that is built while few executors are there isn't bound to these.
    """
    spark = df.sparkSession
    few = max(FILES_PER_CORE * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // PARTITIONS_PER_FILE)
    path = f"{_FOLDER.get() or shared_dir(spark)}/{uuid.uuid4().hex}.parquet"
    (df.coalesce(few) if short else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of texts that an Arrow batch brings to a Python worker at once.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's bound of an Arrow batch to ``BATCH_BYTES``, so that long texts don't add up in Python.

    Plans run later than they are built, so the bound stays lowered for the session; it changes no result.
    """
    if not 0 < int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH))) <= BATCH_BYTES:
        spark.conf.set(_BATCH, f"{BATCH_BYTES}b")


#: Arrow types of the column types that Python code returns.
ARROW = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "int": pa.int32()}


def map_texts(documents: DataFrame, start: Callable[[], Callable[[str | None], tuple]], into: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of every row with the columns ``into`` that a function makes of its whole text, one text at a time.

    ``start()`` runs once for each task and returns the function. ``into``: names and types (long, int, double, string, boolean).
    Kept columns pass through as Arrow columns, untouched: ids of any size and type stay exact beside nulls.
    """
    bound_batches(documents.sparkSession)
    rows = documents.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("_text"))
    kinds = [ARROW[f.rsplit(" ", 1)[1]] for f in into.split(", ")]
    names = [*keep, *[f.rsplit(" ", 1)[0].strip("`") for f in into.split(", ")]]
    kept = "".join(f"`{c}` {f.dataType.simpleString()}, " for c, f in zip(keep, rows.schema.fields, strict=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = start()
        for batch in batches:
            *others, texts = batch.columns
            made = [make(x.as_py()) for x in texts]
            yield pa.RecordBatch.from_arrays([*others, *[pa.array([m[i] for m in made], kind) for i, kind in enumerate(kinds)]], names)

    return rows.mapInArrow(run, kept + into)


def free_name(name: str, *taken: list[str]) -> str:
    """``name``, with underscores added until no column of ``taken`` has it (in any case of letters)."""
    used = {c.lower() for columns in taken for c in columns}
    while name.lower() in used:
        name += "_"
    return name


def text_chunks(text: str, size: int) -> Iterator[str]:
    """A text in chunks of about ``size`` characters, each cut before a blank; only a longer word makes a longer chunk."""
    at = 0
    while len(text) - at > size:
        end = text.rfind(" ", at + 1, at + size)
        if end < 0:
            end = text.find(" ", at + size)
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:]


def hash_share(key: Column, salt: int = 0) -> Column:
    """A number in [0, 1) that depends on ``key`` alone."""
    return F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(1 << 50)) / F.lit(float(1 << 50))


#: Bits of the filter that :func:`maybe_among` broadcasts: 4 MB, whatever the number of keys.
FILTER_BITS = 1 << 25


def maybe_among(rows: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """Rows whose column ``name`` is among the values that ``keys`` has in it, and some others: what a join can drop before it shuffles.

    The keys' hashes are bits of one bitmap of fixed size, which is broadcast. Far more keys than bits let more rows pass, and cost
    only work: an exact join has to follow.
    """
    slot = F.pmod(F.xxhash64(name), F.lit(FILTER_BITS))
    at = F.bitmap_bit_position(slot)
    bitmaps = keys.groupBy(F.bitmap_bucket_number(slot).alias("_bucket")).agg(F.bitmap_construct_agg(at).alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.getbit(byte, at.bitwiseAND(F.lit(7)).cast("int")) == 1
    return rows.join(F.broadcast(bitmaps), (F.bitmap_bucket_number(slot) == F.col("_bucket")) & hit, "left_semi")
