"""What the operators of this subpackage share: worker set-up, staged tables, bounded samples, byte helpers."""

from __future__ import annotations

import atexit
import gc
import os
import uuid
from collections.abc import Callable
from pathlib import Path
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

T_ = TypeVar("T_")
#: Rows and bytes of one Arrow batch, about: whole texts are long, so batches are kept short to bound a worker's memory.
BATCH_ROWS, BATCH_BYTES = 256, 4 << 20
#: Rows of one file of a table whose size is known.
FILE_ROWS = 5_000
#: Tasks a core that write a small staged table: what was dealt out more finely is written by fewer.
CORE_TASKS = 4
#: Of the codecs at hand the one that holds least memory outside of the heap, where an executor's limit counts too.
CODEC = "snappy"
#: How staged tables are written to a local folder: without a checksum file beside each file.  An executor starts a process
#: for each file that it creates there, which is counted with the executor's own memory until it has become another program.
LOCAL_WRITES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
#: ASCII white space, the separators of words: \x20 and \x09 to \x0D.
SPACES = " \t\n\v\f\r"

_held: dict[tuple, object] = {}
_staged: list[tuple[SparkSession, str]] = []


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> str:
    """Let Python workers import this package, bound their batches, and return the folder all executors share."""
    env = spark.sparkContext.environment
    root = str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [root, env.get("PYTHONPATH", "")]))
    env.setdefault("OMP_NUM_THREADS", "1")
    env.setdefault("OPENBLAS_NUM_THREADS", "1")
    env.setdefault("RAYON_NUM_THREADS", "1")
    env.setdefault("TOKENIZERS_PARALLELISM", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    # one process alone, as in tests: its own folder is seen by all its threads
    spark.conf.set("spark.checkpoint.dir", os.path.abspath("spark-warehouse/lockgrain-shared"))
    return spark.conf.get("spark.checkpoint.dir")


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _clean() -> None:
    for spark, path in _staged:
        try:
            _delete(spark, path)
        except Exception:  # the session is gone; the folder's owner cleans it
            return


def discard(*tables: DataFrame | None) -> None:
    """Delete staged tables whose last reader has been staged itself."""
    for df in tables:
        entry = df is not None and (df.sparkSession, getattr(df, "staged_path", ""))
        if entry and entry in _staged:
            _staged.remove(entry)
            _delete(*entry)


def _parts(df: DataFrame) -> int:
    """Partitions that the files behind ``df`` fill; very many if their size is not known."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    limit = df.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return min(size // limit + 1, 1_000_000)


def staged(df: DataFrame, tag: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, and a lost executor costs nothing written.

    ``rows``, a number that the table does not exceed, keeps a small one from being scattered over many files: it is
    written by as many tasks as it has ``FILE_ROWS`` rows.  No table is written by more than ``CORE_TASKS`` tasks a core,
    unless it is made from more bytes of files than so many partitions hold, or the cores come and go by dynamic
    allocation.  The files go by ``discard``, or when the process ends.
    """
    spark = df.sparkSession
    path = f"{prepare(spark)}/{tag}-{uuid.uuid4().hex}"
    tasks = [] if rows is None else [rows // FILE_ROWS + 1]
    if spark.conf.get("spark.dynamicAllocation.enabled", "false") != "true":
        tasks.append(max(CORE_TASKS * spark.sparkContext.defaultParallelism, _parts(df)))
    (df.coalesce(min(tasks)) if tasks else df).write.options(compression=CODEC, **LOCAL_WRITES).parquet(path)
    if not _staged:
        atexit.register(_clean)
    _staged.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def if_small(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """``df``, a written table of a few numbers a row, to be broadcast if its counted rows are ``rows`` at most.

    Larger tables are joined as the planner sees fit.
    """
    return F.broadcast(df) if df.count() <= rows else df


def model(key: tuple, make: Callable[[], T_]) -> T_:
    """What ``make`` gives, once in a process.  A worker holds the one model that it used last, however many stages it serves."""
    if key not in _held:
        _held.clear()
        gc.collect()
        _held[key] = make()
    return _held[key]


def arrow_schema(schema: T.StructType) -> pa.Schema:
    return to_arrow_schema(schema)


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop input columns whose names (in any case) an operator's own output takes."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def hash_sample(df: DataFrame, rows: int, *columns: str) -> DataFrame:
    """The ``rows`` distinct rows of ``columns`` with the smallest hashes, whatever the partitioning.

    Of a large table only the share that holds about twice as many rows is sorted, so where most rows are repeats the
    sample can be smaller.  Rows with a null in the first column are never sampled.
    """
    df = df.where(F.col(columns[0]).isNotNull()).select(*columns)
    h = F.xxhash64(*columns, F.lit(17))
    total = df.count()
    if total > 4 * rows:
        df = df.where(h < int(-(2**63) + 2**64 * (2 * rows / total)))
    return df.distinct().orderBy(h, *columns).limit(rows)
