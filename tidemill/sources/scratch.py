"""Tables that a query writes to the folder which driver and executors share, and reads back.

A written table is read once however often a plan uses it, has no lineage before it, and survives lost executors.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Folders of sessions on one machine that name none, by application.
_LOCAL: dict[str, str] = {}
#: Tables of the query that is being built; None outside of one.
_MADE: ContextVar[dict | None] = ContextVar("made", default=None)
#: Paths made since ``discarding`` began; None outside of it.
_PATHS: ContextVar[list[str] | None] = ContextVar("paths", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.

    Where it is unset, a session on one machine gets a temporary folder that goes when Python ends; on a cluster no
    folder can be guessed, so that is a RuntimeError.
    """
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if context.applicationId not in _LOCAL:
        made = tempfile.mkdtemp(prefix="spark-tidemill-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        _LOCAL[context.applicationId] = "file://" + made
    return _LOCAL[context.applicationId]


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if (made := _PATHS.get()) is not None:
        made.append(path)
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete what lies at the paths, in whatever store they name."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def discarding(spark: SparkSession) -> Iterator[None]:
    """Delete, at the end, all that was written to fresh paths within.  Results must have been written elsewhere by then."""
    token = _PATHS.set([])
    try:
        yield
    finally:
        made = _PATHS.get()
        _PATHS.reset(token)
        discard(spark, *made)


def once(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Write the table that ``f(spark, sf_dir, ...)`` gives, once for each query and arguments.

    Outside of ``shared`` it is an ordinary function.
    """

    def make(spark: SparkSession, sf_dir: str, *more) -> DataFrame:
        made = _MADE.get()
        if made is None:
            return f(spark, sf_dir, *more)
        key = (f.__name__, sf_dir, more)
        if key not in made:
            made[key] = materialise(f(spark, sf_dir, *more), f.__name__)
        return made[key]

    make.__doc__, make.__name__ = f.__doc__, f.__name__
    return make


@contextmanager
def shared(tables: dict | None = None) -> Iterator[None]:
    """Within it tables of ``once`` are written once; ``tables`` carries them from one such block to the next."""
    token = _MADE.set({} if tables is None else tables)
    try:
        yield
    finally:
        _MADE.reset(token)
