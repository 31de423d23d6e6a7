"""Shared pieces of the training-data operators: table access, shared scratch
tables, and the vectorised byte/word primitives that run inside Arrow tasks.

Every text primitive works on *blocks*: many short documents are laid out in
one byte array, one blank between them, so that one numpy call serves them all
and a task never holds more than a few megabytes of derived arrays.
"""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from functools import reduce
from operator import and_
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

BLOCK_BYTES = 1 << 20
U64 = np.uint64
_MULT = 0x9E3779B97F4A7C15
_ROOT = 0xD6E8FEB86659FD93  # odd: powers are invertible modulo 2**64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Bound what one Arrow batch can hold in a Python worker, by rows and by
    bytes (a longer row stands alone), and send this package to the executors
    (once for each application)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{8 << 20}b")
    sc = spark.sparkContext
    if getattr(sc, "_lakewright_sent", False):
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / "lakewright.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc._lakewright_sent = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only in local mode (tests, a laptop) is a temporary folder chosen where
    neither the session nor the context has one; a cluster must name one.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir().rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: the lineage is
    cut, the rows survive any executor, and later passes read only the columns
    they name."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    written(spark).append(path)
    return spark.read.schema(df.schema).parquet(path)


def written(spark: SparkSession) -> list[str]:
    """The paths of all tables that ``stored`` has written and that are there."""
    sc = spark.sparkContext
    if not hasattr(sc, "_lakewright_written"):
        sc._lakewright_written = []
    return sc._lakewright_written


def release(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Delete the stored tables from number ``since`` on, but for the last
    ``keep``. What was computed from them must not be read again."""
    paths = written(spark)
    gone = paths[since : len(paths) - keep]
    for path in gone:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
    paths[since : len(paths) - keep] = []


def need_integers(df: DataFrame, id_col: str) -> None:
    """Raise for an id column of another type than an integer."""
    kind = df.schema[id_col].dataType
    if not isinstance(kind, T.IntegralType):
        raise TypeError(f"ids must be integers; {id_col} is {kind.simpleString()}")


def held_out(doc_id: str, modulus: int, remainder: int) -> Column:
    """crc32 of the id's text, modulo ``modulus``; a null id counts as ''."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % modulus == remainder


def bounded_sample(df: DataFrame, by: list[str], order: str, most: int) -> DataFrame:
    """About ``most`` rows of each group of ``by`` at the most (all of them if
    there are fewer), chosen by a hash of ``order``; rows without an order are
    taken all or none.

    The group sizes come from a map-side combined count (one number for each
    class that is to be learned, so as small as the model itself); the rows
    are then filtered where they lie, so nothing is sorted or gathered.
    """
    key = F.struct(F.lit(0).alias("_"), *by).alias("k")
    sizes = df.groupBy(key).agg(F.count("*").alias("n")).collect()
    share = F.lit(0.0)
    for row in sizes:
        same = [F.col(c).eqNullSafe(F.lit(row["k"][c])) for c in by]
        share = F.when(reduce(and_, same, F.lit(True)), F.lit(most / row["n"])).otherwise(share)
    u = F.pmod(F.xxhash64(F.col(order), F.lit("sample")), F.lit(1 << 20)) / float(1 << 20)
    return df.where(u < share)


def dealt_anew(df: DataFrame, key: str) -> DataFrame:
    """``df``, of one row for each ``key``, dealt out by a hash of it. A join by
    the key then deals out both of its sides itself, and adaptive execution can
    split a hot key of the other side, which it can't next to an aggregate."""
    return df.repartition(F.xxhash64(key, F.lit(1)))


FILTER_BITS = 1 << 22


def filter_bit(id_col: str, bits: int = FILTER_BITS) -> Column:
    """The place of an id in a bit filter."""
    return F.pmod(F.xxhash64(id_col), F.lit(bits))


def bit_filter(ids: DataFrame, id_col: str, bits: int = FILTER_BITS) -> Broadcast:
    """A filter of fixed size in which the bits of all ``ids`` are set. Those
    that are not among them pass with the share of bits that are set."""
    at = filter_bit(id_col, bits)
    words = ids.select(at.alias("at")).groupBy(F.expr("at div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits")).toArrow()
    table = np.zeros(max(1, bits // 64), np.int64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy()
    return ids.sparkSession.sparkContext.broadcast(table.view(np.uint8))


# ---------------------------------------------------------------- text blocks


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n + 1 offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], (at - at[0]).astype(np.int64)


def blocks(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``most`` bytes; a longer one stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit value over all bits."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xCF1BBCDCB7A56463)
    x ^= x >> U64(29)
    return x


class Powers:
    """r**i and r**-i modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up, self.down = np.ones(1, U64), np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 2 * len(self.up))
            inverse = pow(_ROOT, -1, 1 << 64)
            for name, root in (("up", _ROOT), ("down", inverse)):
                steps = np.full(size, root, U64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))
        return self.up, self.down


POWERS = Powers()

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def segments(raw: np.ndarray, offsets: np.ndarray, most: int = 4 * BLOCK_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Cuts of a block at white space, so that no part is much longer than
    ``most``: the parts' offsets and the document of each part."""
    if not len(raw) or (np.diff(offsets) <= most).all():
        return offsets, np.arange(len(offsets) - 1)
    cuts, docs = [0], []
    for d in range(len(offsets) - 1):
        at, end = int(offsets[d]), int(offsets[d + 1])
        while end - at > most:
            stop, step = at + most, 1 << 16
            while stop < end and not (found := np.flatnonzero(_SPACE[raw[stop : min(stop + step, end)]])).size:
                stop += step
            if stop >= end:
                break
            at = stop + int(found[0])
            cuts.append(at)
            docs.append(d)
        cuts.append(end)
        docs.append(d)
    return np.array(cuts), np.array(docs)


class Words:
    """Words (maximal runs without ASCII white space) of a block of documents.

    ``doc``: the block-relative document of each word; ``start``, ``end``: its
    byte places in ``raw``; ``hash``: 64 bits of the word, A-Z lower-cased;
    ``first``: where each document's words begin in these arrays.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray) -> None:
        cuts, owner = segments(raw, offsets)
        found = []
        for i, j in blocks(cuts, 4 * BLOCK_BYTES):
            part, start, end, code = self._words(raw[cuts[i] : cuts[j]], cuts[i : j + 1] - cuts[i])
            found.append((owner[i:j][part], start + cuts[i], end + cuts[i], code))
        empty = np.zeros(0, np.int64)
        self.doc, self.start, self.end, self.hash = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (empty, empty, empty, empty.astype(U64))
        self.count = np.bincount(self.doc, minlength=len(offsets) - 1).astype(np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.count)))

    @staticmethod
    def _words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        n = len(offsets) - 1
        spaced = np.full(len(raw) + n + 1, 0x20, np.uint8)
        spaced[np.arange(len(raw)) + np.repeat(np.arange(1, n + 1), np.diff(offsets))] = raw
        space = _SPACE[spaced]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        start, end = edge[0::2], edge[1::2]
        up, down = POWERS.upto(len(spaced) + 1)
        total = np.zeros(len(spaced) + 1, U64)
        np.cumsum((_LOWER[spaced].astype(U64) + U64(1)) * up[: len(spaced)], out=total[1:])
        code = mix((total[end] - total[start]) * down[start])
        doc = np.searchsorted(offsets[:-1] + np.arange(1, n + 1), start, "right") - 1
        return doc, start - doc - 1, end - doc - 1, code


def spread(values: np.ndarray, starts: np.ndarray, op: np.ufunc = np.add, empty: float = 0) -> np.ndarray:
    """``op`` over the runs values[starts[i]:starts[i + 1]], ``empty`` for none."""
    n = len(starts) - 1
    shape = (n, *values.shape[1:])
    out = np.full(shape, empty, values.dtype if values.dtype != bool else np.int64)
    full = np.flatnonzero(starts[1:] > starts[:-1])
    if len(full):
        out[full] = op.reduceat(values.astype(out.dtype, copy=False), starts[full], axis=0)
    return out


def arrow(columns: dict[str, tuple[object, pa.DataType]]) -> pa.RecordBatch:
    names = list(columns)
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in columns.values()]
    arrays = [a if a.type == t else a.cast(t) for a, (_, t) in zip(arrays, columns.values(), strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=names)
