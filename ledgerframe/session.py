"""Session defaults and the shared folder for tables that cut lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no checkpoint folder (tests, a laptop).
LOCAL_FOLDER = "file:///tmp/checkpoints/ledgerframe"


def local_session(cores: str = "8", partitions: int = 8) -> SparkSession:
    """A local session with the settings that the queries expect."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("ledgerframe")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else, in a local session only, a local one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (folder or LOCAL_FOLDER).rstrip("/")


_written: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back.

    This cuts lineage: what is read again survives the loss of any executor, and is computed once.
    """
    path = scratch(df.sparkSession, name)
    _written.append((df.sparkSession, path))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, name: str) -> DataFrame:
    """`materialise` for tables that grow with the pages: joins with it go by key and never by broadcast.

    Selectors, steps and attributes repeat, so that files of a few MB hold rows of hundreds, which a plan that goes by the
    files' size would send through the driver.
    """
    return materialise(df, name).hint("merge")


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def forget(df: DataFrame) -> None:
    """Delete the files of a table that `materialise` wrote and nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, folder)


def clean_up(spark: SparkSession) -> None:
    """Delete all tables that `materialise` wrote for a session; call it when no result that reads them is needed any more."""
    for session, path in [x for x in _written if x[0] is spark]:
        _delete(session, path)
        _written.remove((session, path))
