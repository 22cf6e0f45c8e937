"""The folder that driver and executors share, and tables written there to cut lineage."""

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The paths written by this process, by application.
_written: dict[str, list[str]] = {}


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. A local session (as in tests) may leave it unset and gets a folder of its own, gone with the process; a cluster may not."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    master = spark.sparkContext.master or ""
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="spark-lexiweave-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return "file://" + _own[app]


def _forget(spark: SparkSession, app: str) -> None:
    """Delete what this application has stored, if its session still lives."""
    try:
        if spark.sparkContext._jsc is None:
            return
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for path in _written.pop(app, []):
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
    except Exception:  # noqa: BLE001 - the JVM may be gone by then; the folder is scratch space
        pass


def release(spark: SparkSession) -> None:
    """Delete every table stored so far by this application. Results not yet written that read from them are lost."""
    _forget(spark, spark.sparkContext.applicationId)


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; what is written there stays until release(), or until the process ends."""
    path = f"{shared_dir(spark)}/lexiweave/{label}-{uuid.uuid4().hex}"
    app = spark.sparkContext.applicationId
    if app not in _written:
        _written[app] = []
        atexit.register(_forget, spark, app)
    _written[app].append(path)
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write df once to the shared folder and read it back: executors may be lost, nothing is computed twice."""
    path = scratch(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
