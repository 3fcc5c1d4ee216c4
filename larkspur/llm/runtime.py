"""What every operator shares: tables, shared scratch folder, code shipping."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.sources.storage import shared_dir

#: A word: a longest run of characters other than space and U+0009..U+000D.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Rows that a Python worker gets at once.  Texts may be long, so this is far below Spark's default of 10,000.
BATCH_ROWS = 1_024
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Bytes that a Python worker gets at once, beyond a single row.
BATCH_BYTES = "2m"

#: Rows of a side that is broadcast; with more, the join is left to Spark.
BROADCAST_ROWS = 500_000
#: Rows of a key beyond which it is joined by broadcast, so that no task gets them all.
HEAVY = 256

_SHIPPED: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SCRATCH: list[Scratch] = []


@contextmanager
def released() -> Iterator[None]:
    """Intermediate tables made inside go at its end: for frames that are written inside as well."""
    before = len(_SCRATCH)
    try:
        yield
    finally:
        for own in _SCRATCH[before:]:
            own.clear()
            atexit.unregister(own.clear)
        del _SCRATCH[before:]


class Scratch:
    """Intermediate tables of one query, as Parquet in the shared folder.

    Written tables cut the lineage, survive lost executors and carry their
    statistics into later plans.  ``drop`` removes one that is no longer read;
    the rest go at the end of :func:`released` or of the driver's process.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        _SCRATCH.append(self)
        atexit.register(self.clear)

    def _delete(self, path: str) -> None:
        sc = self.spark.sparkContext
        if sc._jsc is None:
            return
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return it reread."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        self._delete(f"{self.root}/{name}")

    def clear(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the session may be gone at exit
            pass


def small(df: DataFrame) -> DataFrame:
    """Marked for broadcast if its rows, counted, are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def join_told(rows: DataFrame, told: DataFrame, key: str, size: str, how: str, own: Scratch, name: str) -> DataFrame:
    """``rows`` with what ``told`` (a row for each key, with the number ``size`` of its rows) says of their key.

    Keys of more than HEAVY rows are few, as each has that many rows; they are
    joined by broadcast where counted so, and only the others are dealt out by key.
    """
    heavy = own.keep(told.where(F.col(size) > HEAVY), name)
    n = heavy.count()
    if not n or n > BROADCAST_ROWS:  # Spark splits large partitions of such a join
        return rows.join(told, key, how)
    rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(told.where(F.col(size) <= HEAVY), key, how)
    return rows.join(F.broadcast(heavy), key).unionByName(rest)


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


class Shield:
    """A table under names of its own, so that an operator's working columns can't clash with it.

    ``extra`` are working columns computed from the table, by their names inside.
    """

    def __init__(self, df: DataFrame, **extra: Column):
        self.names = df.columns
        self.inner = df.select(*[_quoted(c).alias(f"in{i}") for i, c in enumerate(self.names)], *[c.alias(k) for k, c in extra.items()])

    def __call__(self, name: str) -> str:
        return f"in{self.names.index(name)}"

    def restore(self, out: DataFrame, *new: str, without: str | None = None) -> DataFrame:
        """The table's columns and the new ones; a new one takes the place of one of its name, whatever the case."""
        taken = {n.lower() for n in new}
        old = [F.col(f"in{i}").alias(c) for i, c in enumerate(self.names) if c.lower() not in taken and c != without]
        return out.select(*old, *new)


def ship(spark: SparkSession) -> None:
    """Make this package importable on executors that lack it on their path, and keep the session's Arrow batches small."""
    sc = spark.sparkContext
    if int(spark.conf.get(_BATCH_SETTING)) > BATCH_ROWS:
        spark.conf.set(_BATCH_SETTING, str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    root = Path(__file__).resolve().parents[2]
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    out = Path(tempfile.mkdtemp()) / "larkspur.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted((root / "larkspur").rglob("*.py")):
            z.write(p, p.relative_to(root))
    sc.addPyFile(str(out))


def lowered_words(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text, A-Z in lower case: bytes know no other letters, and split at just WORD's spaces."""
    return text.lower().split() if text else []


def crc32_mod(column: Column, n: int) -> Column:
    """crc32 of the value written as text, modulo n; null counts as empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % n


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
