"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the word pattern [^\x20\x09-\x0D]+ leaves it out.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows that a Python worker handles at a time.
ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only, whatever the locale or script."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: What operators remember in a Python worker.  Workers are shared: it makes room when another operator begins there.
remembered: list[dict] = []


def make_room(but: dict | None = None) -> None:
    for x in remembered:
        if x is not but:
            x.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc keeps freed memory unless it is asked to give it back
        ctypes.CDLL("libc.so.6").malloc_trim(0)


_working: list[str] = []


def enter(operator: str) -> None:
    """Called by a worker as it begins a partition: makes room if it worked for another operator before."""
    if _working != [operator]:
        _working[:] = [operator]
        make_room()


#: Bytes of an Arrow batch between the JVM and a worker; Spark's own bound is 64 MB, of which each side holds two or three.
BATCH_BYTES = 4 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches of the session to ``BATCH_BYTES``, unless the user has set a bound; no result depends on it."""
    if _BATCH_CONF not in spark.conf.getAll:
        spark.conf.set(_BATCH_CONF, BATCH_BYTES)


class Columns(dict):
    """The columns of a batch as lists, made when they are first asked for; lists of numbers as NumPy arrays."""

    def __init__(self, batch: pa.RecordBatch):
        self.batch = batch

    def __missing__(self, name: str) -> list:
        col = self.batch.column(name)
        if pa.types.is_list(col.type) and pa.types.is_primitive(col.type.value_type) and not (col.null_count or col.values.null_count):
            at, flat = col.offsets.to_numpy(), col.values.to_numpy(zero_copy_only=False)
            x = self[name] = [flat[i:j] for i, j in zip(at[:-1], at[1:])]
        else:
            x = self[name] = col.to_pylist()
        return x


def arrow_map(df: DataFrame, fn: Callable[[Columns], dict[str, list]], schema: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Applies ``fn`` (:class:`Columns` in, a dict of columns out) to each Arrow batch.

    The columns named by ``keep`` come first, as they are, whatever their types, and then those of ``schema``; with ``keep``,
    ``fn`` keeps the rows and their order.
    Spark bounds its batches in bytes; they are cut again to ``ROWS`` rows, which bounds what a worker holds as objects."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    made = _parse_datatype_string(schema)
    out = to_arrow_schema(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter(fn.__module__)
        for whole in batches:
            for k in range(0, whole.num_rows, ROWS):
                b = whole.slice(k, ROWS)
                cols = fn(Columns(b))
                columns = [*(b.column(n) for n in keep), *(pa.array(cols[f.name], f.type) for f in out)]
                yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([*(b.schema.field(n) for n in keep), *out]))

    return df.mapInArrow(run, StructType([*(df.schema[n] for n in keep), *made]))


def arrow_stream(df: DataFrame, fn: Callable[[Iterator[Columns]], Iterator[dict[str, list]]], schema: str) -> DataFrame:
    """Applies ``fn`` to the batches of a partition as they come, for groups of rows that go on from one batch to the next.

    ``fn`` takes :class:`Columns` of at most ``ROWS`` rows in the partition's order and yields dicts of columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    made = _parse_datatype_string(schema)
    out = to_arrow_schema(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter(fn.__module__)
        pieces = (Columns(b.slice(k, ROWS)) for b in batches for k in range(0, b.num_rows, ROWS))
        for cols in fn(pieces):
            yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in out], schema=out)

    return df.mapInArrow(run, made)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


#: Holds the columns that an operator doesn't read, so that no name of theirs can clash with its own.
REST = "__rest"


def pack(df: DataFrame, used: list[str]) -> DataFrame:
    """The ``used`` columns, and all others as one struct."""
    rest = [F.col(quoted(c)) for c in df.columns if c not in used]
    return df.select(*[F.col(quoted(c)) for c in used], (F.struct(*rest) if rest else F.lit(None).cast("struct<none:int>")).alias(REST))


def unpack(df: DataFrame, columns: list[str], used: list[str]) -> DataFrame:
    """The columns that ``pack`` was given, in their order."""
    return df.select(*[F.col(quoted(c)) if c in used else F.col(REST).getField(c).alias(c) for c in columns])


#: Folders of this process that may be deleted, in the order of their making.
_folders: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder under the cluster's shared checkpoint folder.

    Where none is configured, a local one is set for a local master, as in tests; on a cluster that is an error, as
    executors couldn't write where the driver reads."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        jdir = sc._jsc.sc().getCheckpointDir()
        if jdir.isEmpty():
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            import tempfile

            sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-ckpt-"))
            jdir = sc._jsc.sc().getCheckpointDir()
        base = jdir.get()
    path = f"{base.rstrip('/')}/tessera-{uuid.uuid4().hex}"
    _folders.append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder that ``shared_dir`` named."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def mark() -> int:
    return len(_folders)


def last_folder() -> str:
    return _folders[-1]


def sweep(spark: SparkSession, since: int, but: tuple[str, ...] = ()) -> None:
    """Deletes the folders made since ``mark`` gave ``since``; tables over them can't be read any more."""
    gone = [p for p in _folders[since:] if p not in but]
    _folders[since:] = [p for p in _folders[since:] if p in but]
    for p in gone:
        delete(spark, p)


def materialize(df: DataFrame) -> DataFrame:
    """Cuts lineage: writes ``df`` as Parquet in the shared folder and reads it again, so that lost executors cost nothing."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Narrow tables (keys and numbers, under 100 bytes a row) are broadcast up to so many rows, else the join shuffles.
BROADCAST_ROWS = 200_000


def small(df: DataFrame) -> DataFrame:
    """The table with a hint to broadcast it if a count shows that it is small; for tables that are cheap to read."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def xxh_bucket(c: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(n))
