"""What the operators of this folder share: reading tables, shared scratch tables, byte words, hashing."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: The white space that separates words: a space and the bytes 9 to 13. ``bytes.split()`` splits on just these.
SPACE = " \t\n\x0b\x0c\r"
#: The same set as a Java/Python character class for words.
WORD = r"[^\x20\x09-\x0D]+"

_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)
_BASE_INV = np.uint64(pow(0x100000001B3, -1, 1 << 64))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch that a Python worker is given: whole texts would make batches of 64 MB.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the session's limit on Arrow batches to ``BATCH_BYTES``; a lower one stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(-?\d+)([a-z]*)", spark.conf.get(key).lower()).groups()
    if not 0 < int(number) * _UNITS[unit[:1]] <= BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


_UNITS = {"": 1, "b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40, "p": 1 << 50}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    It is ``spark.checkpoint.dir`` of the session. Only where that is unset and Spark runs on this machine alone (tests) a
    temporary folder is set as the checkpoint folder, once per session; on a cluster executors could not read it.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = sc.getCheckpointDir()
        if not root:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="tesserae-"))
            root = sc.getCheckpointDir()
    return root.rstrip("/")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


#: Bytes of a row group of intermediate tables: each writing task holds one in memory.
ROW_GROUP = 8 << 20


class Scratch:
    """Intermediate tables as Parquet in the shared folder; any executor can read them after others are lost."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def keep(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and read it back: the lineage is cut here."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *dfs: DataFrame) -> None:
        """Delete tables of ``keep`` that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        for df in dfs:
            path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class PowerTable:
    """Growing tables of powers and inverse powers for polynomial hashes."""

    def __init__(self):
        self.up = powers(1 << 16)
        self.down = powers(1 << 16, _BASE_INV)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > 4 * CHUNK:  # one very long text: not kept
            return powers(n), powers(n, _BASE_INV)
        if n > len(self.up):
            self.up, self.down = powers(n), powers(n, _BASE_INV)
        return self.up[:n], self.down[:n]


_TABLE = PowerTable()


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in bytes given as uint8."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(np.concatenate(([1], space.view(np.int8), [1])).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


#: Bytes hashed at a time; a longer span is taken alone.
CHUNK = 1 << 20


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, whatever its place. Spans are disjoint and in order."""
    if len(data) <= CHUNK:
        return _span_hashes(data, starts, ends)
    out, i = [np.zeros(0, np.uint64)], 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK, "right")))
        out.append(_span_hashes(data[starts[i] : ends[j - 1]], starts[i:j] - starts[i], ends[i:j] - starts[i]))
        i = j
    return np.concatenate(out)


def _span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _TABLE.get(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return mix64(h + (ends - starts).astype(np.uint64) * _GOLD)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` word hashes; of the whole sequence where there are fewer, none without words."""
    n = len(words)
    if n == 0:
        return words
    width = min(k, n)
    h = np.zeros(n - width + 1, np.uint64)
    for j in range(width):
        h = mix64(h + words[j : j + n - width + 1] + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    return mix64(h + np.uint64(width))


def release() -> None:
    """Give freed memory back to the system, so that idle Python workers don't hold it."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(keys, texts, most: int):
    """Runs of rows of a batch with ``most`` code points at a time, one row at least; null texts stay None."""
    key_run, text_run, size = [], [], 0
    for key, text in zip(keys, texts, strict=True):
        text = text if isinstance(text, str) else None
        n = len(text or "")
        if text_run and size + n > most:
            yield key_run, text_run
            key_run, text_run, size = [], [], 0
        key_run.append(key)
        text_run.append(text)
        size += n
    if text_run:
        yield key_run, text_run


def map_texts(docs: DataFrame, id_col: str, text_col: str, fields: str, worker, most: int = 4_000_000) -> DataFrame:
    """One pass over (id, text) in Arrow batches, without a shuffle.

    ``worker()`` runs once per task and gives a function from a list of texts (None for null) to an iterable of rows,
    in order, or of None for no row; if it has a ``close``, that is called at the task's end. ``fields`` is the schema of these rows; the id comes before them, unchanged, with
    its type. ``most`` code points are handed over at a time (a longer text alone), which bounds memory.
    """
    import pyarrow as pa
    from pyspark.sql import functions as F
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructField, StructType

    rest = StructType.fromDDL(fields)
    schema = StructType([StructField(id_col, docs.schema[id_col].dataType), *rest.fields])
    arrow = to_arrow_schema(schema)

    def run(batches):
        process = worker()
        for batch in batches:
            for keys, texts in slices(batch.column(0).to_pylist(), batch.column(1).to_pylist(), most):
                rows = [(k, *r) for k, r in zip(keys, process(texts), strict=True) if r is not None]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * len(arrow)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)
            release()
        # Workers live on after a task: what it remembered goes.
        getattr(process, "close", lambda: None)()
        del process
        release()

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)
