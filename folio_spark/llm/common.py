"""What the operators of this subpackage share: the shared folder, written tables, tokens of bytes."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MASK = (1 << 64) - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it. Where that is unset, a session in one
    process (tests) gets one of its own, and a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


#: Settings while a table is written: Spark removes the execution's shuffle files when it ends (what is written isn't
#: computed again), and Python workers get whole texts in smaller batches.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


def materialize(df: DataFrame, tag: str, path: str | None = None) -> DataFrame:
    """Write df to the shared folder (or a path there) and read it back: cuts lineage, survives lost executors, and is computed once."""
    spark, path = df.sparkSession, path or new_path(df.sparkSession, tag)
    before = {k: spark.conf.get(k) for k in WRITING}
    for k, v in WRITING.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of ids up to which a table is broadcast.
SMALL = 500_000


def join_small(big: DataFrame, small: DataFrame, on: str | Column | list, how: str = "inner") -> DataFrame:
    """Join a written table: broadcast if its counted rows are few, else by a shuffle."""
    return big.join(F.broadcast(small) if small.count() <= SMALL else small, on, how)


def same_row(rows: DataFrame, id_col: str, text_col: str, keys: DataFrame) -> Column:
    """Joins rows to keys (_id, _text: the text's hash). Ids can be null or repeated, so an id alone names no row."""
    return rows[id_col].eqNullSafe(keys["_id"]) & (F.xxhash64(rows[text_col]) == keys["_text"])


def keep() -> None:
    """What a task frees stays with it until give_back(): else the system takes large arrays back and clears their pages anew
    for each batch."""
    if option := getattr(ctypes.CDLL(None), "mallopt", None):
        option(-1, 1 << 28)  # M_TRIM_THRESHOLD
        option(-3, 1 << 25)  # M_MMAP_THRESHOLD, its highest value


def give_back() -> None:
    """What a task held goes back to the system at its end: Python workers stay, for tasks of other stages."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], at: int, rows: int = 64, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most `rows` rows and about `size` bytes in column `at` (one longer text is a part)."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < b.num_rows:
            before = ends[lo - 1] if lo else 0
            hi = max(lo + 1, min(lo + rows, int(np.searchsorted(ends, before + size, side="right"))))
            yield b.slice(lo, hi - lo)
            lo = hi


def id_text(col: Column) -> Column:
    """An id as text; a null id counts as empty text."""
    return F.coalesce(col.cast("string"), F.lit(""))


def fold(col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n. A null id has crc32('') = 0, so it is always held out."""
    return F.crc32(id_text(col)) % n


def words(text: str | None) -> list[bytes]:
    """A-Z lowered, then the runs of bytes other than space and \\t \\n \\v \\f \\r (what bytes.split() does)."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser over uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
