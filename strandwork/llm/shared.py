"""What the operators of this subpackage share: table reading, shared scratch tables, text batches.

Executors and driver share no local folder, so anything that outlives a job is written as Parquet
under ``spark.checkpoint.dir`` (read from the session; where it is unset a local folder serves a local master, and a
cluster is an error). A written table cuts lineage and survives the loss of executors. ``release`` deletes the tables
that nobody reads any more.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one Python step works on at a time (a longer text is a step of its own).
STEP_BYTES = 2 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="strandwork-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Paths of the tables that this process has written and not deleted.
_written: list[str] = []


def kept(df: DataFrame, tag: str) -> DataFrame:
    """df, written once to the shared folder and read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a table that kept() wrote and that no later step reads."""
    _delete(df.sparkSession, df.shared_path)


def mark() -> int:
    """A point in time for release()."""
    return len(_written)


def release(spark: SparkSession, since: int = 0, but: tuple[DataFrame, ...] = ()) -> None:
    """Delete the tables written since a mark, except some; call it once what reads them has been written or collected."""
    stay = {df.shared_path for df in but}
    for path in _written[since:]:
        if path not in stay:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    _written.remove(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def as_bytes(column: str = "text"):
    """The UTF-8 bytes of a text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")


def steps(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that each holds about ``most`` bytes of ``column`` (at least one row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = offsets(batch.column(column))[1:]
        at, base = 0, offsets(batch.column(column))[0]
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(at, to - at)
            base, at = ends[to - 1], to


def offsets(array: pa.Array) -> np.ndarray:
    """Where each value of a binary array starts in its buffer, and the last one's end."""
    kind = np.int64 if pa.types.is_large_binary(array.type) else np.int32
    return np.frombuffer(array.buffers()[1], dtype=kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)


def flat(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary array in one, and the offsets of its values there."""
    at = offsets(array)
    data = array.buffers()[2]
    held = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[at[0] : at[-1]], at - at[0]


#: Bytes of words stay (A-Z lower-cased), all others become a space: words of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z is lower-cased.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def words(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def concat_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The integers of all ranges [start, start + length), one after the other."""
    lengths = np.asarray(lengths, np.int64)
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, np.int64)
    return np.arange(ends[-1]) + np.repeat(np.asarray(starts, np.int64) - (ends - lengths), lengths)
