"""Helpers that the text operators share: words, shared scratch tables, bounded broadcasts.

Words are the runs of bytes outside 0x20 and 0x09-0x0D. ``bytes.split()`` and
``bytes.lower()`` are exactly that definition and the lower-casing of A-Z alone,
so the Arrow operators work on UTF-8 bytes and never decode a text to split it.
"""

from __future__ import annotations

import atexit
import gc
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where intermediate tables go when the session names no shared folder (tests).
LOCAL_SCRATCH = "/tmp/checkpoints"
WORD_BREAK = r"[\x20\x09-\x0D]+"

_made: set[tuple[str, str]] = set()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of this application: under spark.checkpoint.dir, or LOCAL_SCRATCH where the master is local and none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    base = base or LOCAL_SCRATCH
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's Python ends."""
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clear, spark)
    _made.add((spark.sparkContext.applicationId, path))
    return path


def settle(df: DataFrame, name: str, free: bool = True) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage: what follows survives lost executors without running
    what came before again. With ``free`` the JVM is then asked for collections, on which
    Spark's cleaner removes the shuffle files of the plan that just ended.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    schema = df.schema
    df.write.parquet(path)
    del df
    shuffled = free and not spark.sparkContext.master.startswith("local[")  # one machine's shuffle files go when it ends
    for _ in range(3 * shuffled):  # the plan goes when its Python handle and the events that carry it are gone
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)
    return spark.read.schema(schema).parquet(path)


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Remove the scratch files that a settled ``df`` reads. It can't be read afterwards."""
    root = scratch_root(spark)
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if root.removeprefix("file://").rstrip("/") in path:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _clear(spark: SparkSession) -> None:
    try:
        app = spark.sparkContext.applicationId
        for of, path in list(_made):
            if of == app:
                _delete(spark, path)
    except Exception:  # the JVM may be gone already
        return


def text_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column of a batch."""
    return column.cast(pa.binary() if not pa.types.is_large_string(column.type) else pa.large_binary()).to_pylist()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """XXH3-64 of each word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of every ``width`` neighbours; empty if there are fewer. Built by doubling, so log2(width) passes."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, done, part, step = None, 0, hashes, 1
    while True:
        if width & step:
            tail = part[done : done + n]
            out = tail.copy() if out is None else mix(out * np.uint64(0x9E3779B97F4A7C15) + tail)
            done += step
        if done == width:
            return out
        part = mix(part[: len(part) - step] * np.uint64(0xD6E8FEB86659FD93) + part[step:])
        step *= 2


def batches(rows: Iterator[pa.RecordBatch], budget: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``budget`` bytes, so that long texts don't add up in one batch."""
    for batch in rows:
        n, size = batch.num_rows, batch.nbytes
        step = max(1, int(n * budget / size)) if size > budget else max(1, n)
        for at in range(0, n, step):
            yield batch.slice(at, step)


def crc32_of_id(doc_id: Column | str) -> Column:
    """crc32 of the decimal text of an id, unsigned; null ids count as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: as a lambda's variable it isn't inlined at each use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
