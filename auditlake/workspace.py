"""Where intermediate tables go."""

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"

#: Temporary folders of local sessions without the setting, by application.
_own: dict[str, str] = {}
#: Folders written by ``stored`` and not yet released, by application.
_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as named by ``spark.checkpoint.dir``.

    Only a local-mode session without the setting gets a temporary folder of its own, removed at exit; on a
    cluster a missing setting is an error, because a machine-local folder would be lost with its machine.
    """
    configured = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING, None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"{SETTING} must name a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="auditlake-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return f"file://{_own[app]}"


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new folder in the shared folder, removed by ``release``."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def stored(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write a table once and read it back: later steps start from the stored rows."""
    spark = df.sparkSession
    target = path or fresh_path(spark, label)
    df.write.mode("overwrite").parquet(target)
    return spark.read.schema(df.schema).parquet(target)


def release(spark: SparkSession) -> int:
    """Remove the intermediate tables of this application: call it when the results have been written.

    Frames that still read them fail afterwards. Returns the number of folders removed.
    """
    paths = _written.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    removed = 0
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        removed += bool(path.getFileSystem(conf).delete(path, True))
    return removed
