"""Corpus-wide counting of hashes without a row per hash.

Documents are dealt into chunks of a few MB.  A chunk sends its distinct hashes, cut
into ranges, as one blob per range; a range compares the blobs of all chunks and
answers each blob with one small array in the same order; the chunk, which makes the
same hashes again, reads the answers by position.  A hash that a third of all
documents hold is sent once per chunk, so it makes no hot task, and each task holds
one chunk or one range, both of bounded size.

The chunks are the result of one shuffle of the texts, which both passes read.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import U, flat, pack

#: bytes of text in a chunk, and hashes in a range (8 bytes each)
CHUNK_BYTES = 4 << 20
RANGE_HASHES = 4 << 20

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; only a local session that names
    none gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        context = spark.sparkContext
        if context.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = _own.get(context.applicationId) or _own.setdefault(context.applicationId, tempfile.mkdtemp(prefix="shared-"))
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with files in the shared folder; Spark removes them once nothing
    refers to them, if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(df: DataFrame, text: str) -> int:
    return df.agg(F.sum(F.octet_length(text))).first()[0] or 0


def chunked(df: DataFrame, id_col: str, text_col: str, total: int, size: int = CHUNK_BYTES) -> tuple[DataFrame, int]:
    """(chunk, id, text as bytes).  The chunk follows from the row alone, so that lost
    tasks can be run again; equal texts of different documents go to different chunks."""
    n = max(shuffle_partitions(df.sparkSession), -(-total // size))
    text = F.col(text_col).cast("string")
    return df.select(F.pmod(F.xxhash64(F.col(id_col), text), F.lit(n)).cast("int").alias("chunk"),
                     F.col(id_col).alias("id"), text.cast("binary").alias("text")), n


def range_bounds(n: int) -> np.ndarray:
    """First hash of ranges 1 .. n - 1 of n equal ranges."""
    return np.array([(i << 64) // n for i in range(1, n)], U)


BLOBS = T.StructType([T.StructField("range", T.IntegerType()), T.StructField("chunk", T.IntegerType()),
                      T.StructField("hashes", T.BinaryType())])
ANSWERS = T.StructType([T.StructField("chunk", T.IntegerType()), T.StructField("range", T.IntegerType()),
                        T.StructField("answer", T.BinaryType())])


def blobs_table(chunk: int, distinct: np.ndarray, bounds: np.ndarray) -> pa.Table:
    """One row per range that holds any of the sorted hashes."""
    cuts = np.concatenate(([0], np.searchsorted(distinct, bounds), [len(distinct)]))
    used = np.flatnonzero(np.diff(cuts))
    return pa.table({
        "range": pa.array(used, pa.int32()), "chunk": pa.array(np.full(len(used), chunk), pa.int32()),
        "hashes": pa.array([distinct[cuts[i]:cuts[i + 1]].tobytes() for i in used], pa.binary())})


def send(chunks: DataFrame, hashes_of, n_ranges: int) -> DataFrame:
    """Blobs of all chunks.  hashes_of(texts column) gives the sorted distinct hashes."""
    bounds = range_bounds(n_ranges)

    def chunk_blobs(table: pa.Table) -> pa.Table:
        return blobs_table(table["chunk"][0].as_py(), hashes_of(table["text"]), bounds)

    return chunks.groupBy("chunk").applyInArrow(chunk_blobs, BLOBS)


def in_several_chunks(blobs: DataFrame) -> DataFrame:
    """Answers with one bit per hash: whether another chunk sent it as well."""
    def compare(table: pa.Table) -> pa.Table:
        data, offsets = flat(table["hashes"])
        hashes = np.frombuffer(data.tobytes(), U)
        order = np.argsort(hashes, kind="stable")
        ordered = hashes[order]
        same = np.zeros(len(hashes), bool)
        same[1:] = ordered[1:] == ordered[:-1]
        same[:-1] |= same[1:]
        bits = np.zeros(len(hashes), bool)
        bits[order] = same
        cuts = offsets // 8
        return pa.table({"chunk": table["chunk"], "range": table["range"],
                         "answer": pa.array([pack(bits[a:b]) for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())})

    return blobs.groupBy("range").applyInArrow(compare, ANSWERS)


def read_answers(table: pa.Table) -> dict[int, bytes]:
    return dict(zip(table["range"].to_pylist(), table["answer"].to_pylist()))


def answer_bits(answers: dict[int, bytes], distinct: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The bit of each of the chunk's distinct hashes, in their order."""
    cuts = np.concatenate(([0], np.searchsorted(distinct, bounds), [len(distinct)]))
    out = np.zeros(len(distinct), bool)
    for i in np.flatnonzero(np.diff(cuts)):
        n = int(cuts[i + 1] - cuts[i])
        out[cuts[i]:cuts[i + 1]] = np.unpackbits(np.frombuffer(answers[int(i)], np.uint8), count=n).astype(bool)
    return out
