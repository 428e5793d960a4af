"""What the operators of this subpackage share: shared scratch tables, size-checked broadcasts, word splitting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwarden.runtime import ship_package

#: The characters that part words, space and U+0009..U+000D; ``bytes.split()`` parts at exactly these.
WORD_GAPS = " \t\n\x0b\x0c\r"
#: Rows and bytes in an Arrow batch sent to Python: texts are long, so batches are short.
ARROW_ROWS, ARROW_BYTES = 1_024, 1 << 20
#: A table may be broadcast below this many rows and characters.
BROADCAST_ROWS, BROADCAST_CHARS = 50_000, 4_000_000
#: Ids or band keys may be broadcast up to this many: 8 bytes each.
ID_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the session names none (local tests)."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_gridwarden_dir", None)
    if not root:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = sc._gridwarden_dir = tempfile.mkdtemp(prefix="gridwarden-")
    return root.rstrip("/")


def prepare(spark: SparkSession) -> None:
    """This package on the workers, and short Arrow batches, so that a batch of long texts stays small in a Python worker.

    Spark deletes the shuffle files of a query once it has ended: every step here ends in a written table, so no later
    one reads them, and they don't pile up until the driver collects its garbage.
    """
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written once to the shared folder and read back: lineage ends here, and a lost executor costs no recomputation.

    The files go when the driver's JVM ends, or earlier by drop_stored().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gridwarden/{name}-{uuid.uuid4().hex}"
    df.write.option("parquet.enable.dictionary", "false").parquet(path)  # hashes and ids: no value repeats often
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out._gridwarden_path = path
    return out


def drop_stored(*tables: DataFrame) -> None:
    """Deletes tables that stored() made and nothing reads any more."""
    for df in tables:
        path = getattr(df, "_gridwarden_path", None)
        if path:
            sc = df.sparkSession.sparkContext
            place = sc._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True)


def small_enough(df: DataFrame, text_col: str | None = None) -> bool:
    """Whether df is within the broadcast bound, by counting it."""
    chars = F.sum(F.length(text_col)) if text_col else F.lit(0)
    n, size = df.agg(F.count(F.lit(1)), chars).first()
    return n <= BROADCAST_ROWS and (size or 0) <= BROADCAST_CHARS


def maybe_broadcast(df: DataFrame, text_col: str | None = None) -> DataFrame:
    """df with a broadcast hint if it is within the bound; otherwise as it is, for a shuffled join that AQE splits when skewed."""
    return F.broadcast(df) if small_enough(df, text_col) else df


def bounded_ids(ids: DataFrame, most: int = ID_ROWS) -> DataFrame:
    """A table of a few longs, with a broadcast hint if its rows are few enough."""
    return F.broadcast(ids) if ids.count() <= most else ids


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches that arrive sorted by long keys, as larger ones of about so many rows that end where a group does."""
    waiting, held, goal = [], 0, rows
    for batch in batches:
        waiting.append(batch)
        held += batch.num_rows
        if held < goal:
            continue
        table = pa.Table.from_batches(waiting).combine_chunks()
        same = np.ones(len(table), bool)
        for k in keys:
            own = table.column(k).to_numpy()
            same &= own == own[-1]
        cut = len(table) - int(same.sum())
        if cut:
            yield table.slice(0, cut).combine_chunks().to_batches()[0]
        waiting, held = table.slice(cut).to_batches(), len(table) - cut
        goal = max(rows, 2 * held)  # a large group is not looked through with each batch
    if held:
        yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]


def word_count(col) -> Column:
    """Number of words of a text column; null counts as no words. Each word with the gap after it becomes one character."""
    without = F.regexp_replace(F.ltrim(col, F.lit(WORD_GAPS)), r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+", "x")
    return F.coalesce(F.length(without), F.lit(0)).cast("long")


def fresh(taken: list[str], *wanted: str) -> list[str]:
    """Column names made of those wanted that aren't among those taken, in any case."""
    lower, out = {c.lower() for c in taken}, []
    for name in wanted:
        name = f"__{name}"
        while name in lower:
            name = f"_{name}"
        lower.add(name)
        out.append(name)
    return out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
