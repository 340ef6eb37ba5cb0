"""Session set-up and the shared folder for intermediate tables.

Intermediate results that several jobs read are written as Parquet under the folder the cluster names
in ``spark.checkpoint.dir``: the lineage ends there, a lost executor loses nothing, and later jobs read
only the columns they need. Nothing is kept in executor-local storage.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession


_TEST_FOLDERS: dict[str, str] = {}
_STAGED: dict[str, list[str]] = {}


def build_session(app: str = "washboard", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings this library is written for; keyword arguments override them
    (double underscores stand for dots, e.g. ``spark__sql__shuffle__partitions=2000``)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.parquet.compression.codec": "zstd",
        "spark.ui.showConsoleProgress": "false",
        # the date sample takes so many first values of a column in each task before its shuffle
        "spark.sql.optimizer.windowGroupLimitThreshold": "2000",
        # recording a call site for every column expression costs more than building the plan
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        # projections over many columns become methods the JIT skips by default
        "spark.driver.extraJavaOptions": "-XX:-DontCompileHugeMethods",
        "spark.executor.extraJavaOptions": "-XX:-DontCompileHugeMethods",
    }
    settings.update({k.replace("__", "."): str(v) for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables, taken from ``spark.checkpoint.dir``.

    Where it is unset, a local session (tests) gets a temporary folder; on a cluster that would lose
    data with its machine, so it is an error there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        app = spark.sparkContext.applicationId
        if app not in _TEST_FOLDERS:
            _TEST_FOLDERS[app] = tempfile.mkdtemp(prefix="spark-")
        folder = _TEST_FOLDERS[app]
    return folder.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh, unused path below the shared folder."""
    return f"{shared_folder(spark)}/washboard-{label}-{uuid.uuid4().hex}"


#: Marks the name of a catalog table among the paths to be deleted.
TABLE = "table "


def remember(spark: SparkSession, path: str) -> str:
    """Note an intermediate table, by its path or, behind ``TABLE``, its name, for ``staging`` or ``release`` to delete."""
    _STAGED.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def stage(df: DataFrame, label: str, spark: SparkSession | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back, in the session ``spark`` if that is not the one of ``df``."""
    spark = spark or df.sparkSession
    path = remember(spark, new_path(spark, label))
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, counts: dict[str, Column]) -> tuple[DataFrame, Observation | None]:
    """``df`` with aggregates taken of the rows that pass here while a later step is written, without a job of their own."""
    if not counts:
        return df, None
    seen = Observation()
    return df.observe(seen, *[c.alias(name) for name, c in counts.items()]), seen


def counts_of(seen: Observation | None, counts: dict[str, Column]) -> dict[str, int]:
    """What was observed, once the write is done. Where no task had rows there may be nothing, which is a count of zero."""
    found = seen.get if seen else {}
    return {name: found.get(name) or 0 for name in counts}


def stage_counted(df: DataFrame, label: str, counts: dict[str, Column]) -> tuple[DataFrame, dict[str, int]]:
    """``stage`` with aggregates of the rows written."""
    rows, seen = counted(df, counts)
    written = stage(rows, label)
    return written, counts_of(seen, counts)


def _delete(spark: SparkSession, paths: list[str]) -> int:
    count = 0
    while paths:
        last = paths.pop()
        if last.startswith(TABLE):
            spark.sql(f"DROP TABLE IF EXISTS `{last.removeprefix(TABLE)}`")
            continue
        path = spark._jvm.org.apache.hadoop.fs.Path(last)
        count += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return count


def stage_alone(spark: SparkSession, make: Callable[[], DataFrame], label: str) -> DataFrame:
    """``stage`` of what ``make`` returns; the intermediate tables it was made from are deleted, also after a failure."""
    path = remember(spark, new_path(spark, label))
    with staging(spark):
        df = make()
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the intermediate tables written inside, and no others. What is to stay has to be written out
    before, such as the outputs of a cleaning run; decisions kept for another run are not to be made inside."""
    app = spark.sparkContext.applicationId
    outer, _STAGED[app] = _STAGED.get(app, []), []
    try:
        yield
    finally:
        _delete(spark, _STAGED[app])
        _STAGED[app] = outer


def release(spark: SparkSession) -> int:
    """Delete the intermediate tables this application has written outside ``staging`` so far and return their number."""
    return _delete(spark, _STAGED.get(spark.sparkContext.applicationId, []))
