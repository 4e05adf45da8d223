"""What the operators share: the shared folder, written intermediate tables, document keys and ordinals."""

from __future__ import annotations

import contextlib
import contextvars
import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of (id) that may be broadcast after they have been counted; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors see; a temporary one in local mode where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = local_dir(spark.sparkContext.applicationId)
    return found.rstrip("/")


@functools.cache
def local_dir(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix=f"gazette-{application}-")


#: The folders that written() has made within the scopes that are open, the innermost last. Each thread has its own.
SCOPES: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("scopes", default=())


@contextlib.contextmanager
def scope():
    """A list of the folders that written() makes in this block and thread, in inner blocks too. Other callers' tables are not in it."""
    folders: list[str] = []
    token = SCOPES.set((*SCOPES.get(), folders))
    try:
        yield folders
    finally:
        SCOPES.reset(token)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, so that a lost executor costs no recomputation."""
    folder = f"{shared_dir(df.sparkSession)}/gazette-{uuid.uuid4().hex}"
    for folders in SCOPES.get():
        folders.append(folder)
    path = f"{folder}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession, folders: list[str], keep: DataFrame | None = None) -> None:
    """Deletes the folders of a scope but those that keep reads. For callers that have written all results that were made of them."""
    held = tuple(keep.inputFiles()) if keep is not None else ()
    for folder in list(folders):
        if not any(f"/{folder.rsplit('/', 1)[1]}/" in f for f in held):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
            folders.remove(folder)


def keyed_documents(docs: DataFrame) -> tuple[DataFrame, bool]:
    """(_k, doc_id, text, _n): one row per document with a unique, never null bigint _k in the order of doc_id.

    Where doc_id is unique and never null, _k is doc_id and nothing is shuffled but the ids. Otherwise rows that repeat
    doc_id and text are one document (_n copies), a null doc_id comes before all others, and documents of the same
    doc_id are ordered by their text. Null texts stay null. The flag tells whether _n can differ from 1.
    """
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ids = base.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c"))
    odd = ids.filter((F.col("c") > 1) | F.col("doc_id").isNull()).limit(1).count()
    if not odd:
        return base.select(F.col("doc_id").alias("_k"), "doc_id", "text", F.lit(1).cast("bigint").alias("_n")), False
    once = base.groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("_n"))
    once = written(once, "documents")
    return ordinals(once, "doc_id", "text").withColumnRenamed("_ord", "_k"), True


def ordinals(df: DataFrame, *by: str) -> DataFrame:
    """df with _ord: 0, 1, ... in the ascending order of by (nulls first).

    Two passes: a range partitioned, sorted and written table whose rows carry their partition and place in it; then
    prefix sums over the partitions' row counts, which are as few as the partitions.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *[F.col(c).asc_nulls_first() for c in by]).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in by])
    # monotonically_increasing_id is the partition in the upper 31 bits and the place in it in the lower 33
    placed = written(ranged.withColumn("_m", F.monotonically_increasing_id()), "ranged")
    placed = placed.withColumn("_p", F.shiftright("_m", 33)).withColumn("_i", F.col("_m").bitwiseAND((1 << 33) - 1))
    return add_offsets(placed, F.lit(1)).select(*df.columns, (F.col("_off") + F.col("_i")).alias("_ord"))


def add_offsets(df: DataFrame, amount) -> DataFrame:
    """df with _off: the sum of amount over all rows of smaller _p. The prefix sum runs over one row per partition."""
    totals = df.groupBy("_p").agg(F.sum(amount).cast("bigint").alias("_t"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_off", F.coalesce(F.sum("_t").over(before), F.lit(0)).cast("bigint")).drop("_t")
    return df.join(few(written(totals, "offsets")), "_p")


def few(df: DataFrame, limit: int = BROADCAST_IDS) -> DataFrame:
    """df with a broadcast hint if it has at most limit rows; df is a written table, so that counting is cheap."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def repeat_rows(df: DataFrame, n: str = "_n") -> DataFrame:
    """Each row n times, without n."""
    return df.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(n)))).drop("_copy", n)


def binary_text(batch, name: str = "text"):
    """(values uint8, offsets int64) of an Arrow string column; nulls are empty."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    col = batch.column(batch.schema.get_field_index(name))
    if col.null_count:
        col = pc.fill_null(col, "")
    col = col.cast(pa.large_binary())
    offsets = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
    data = col.buffers()[2]
    values = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return values, offsets


def small_batches(batches, column: int = 1, limit: int = 2 << 20):
    """The batches in slices of about limit bytes of the string column, so that a task holds few Python strings at a time."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column).cast(pa.binary())), 0)
        part = np.cumsum(np.asarray(sizes), dtype=np.int64) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)
