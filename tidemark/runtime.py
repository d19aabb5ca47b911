"""Session, table reading and lineage cuts shared by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings that the engine relies on; a cluster's own values for sizes are left alone.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
}


def spark_session(name: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's settings; `conf` keys use `__` for dots."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    for k, v in (SESSION_CONF | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def reachable(spark: SparkSession) -> None:
    """Lets Python workers of this session import the package from where the
    driver did, whatever their working folder; on a cluster it is shipped with
    the job as usual."""
    root, env = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), spark.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a dataset folder, time-zone-free timestamps as UTC instants."""
    reachable(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    ntz = [c for c, t in df.dtypes if t == "timestamp_ntz"]
    if ntz:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        df = df.withColumns({c: F.col(c).cast("timestamp") for c in ntz})
    return df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`. Where
    that is unset a local session gets a temporary one; a cluster has none that
    is shared, so there it is an error."""
    reachable(spark)
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="tidemark-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d


def cut(df: DataFrame) -> DataFrame:
    """`df` computed once and kept in the shared folder; for small tables that
    an iteration rereads. Survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(df: DataFrame, name: str = "t") -> DataFrame:
    """`df` written as Parquet in the shared folder and read back; for tables
    whose columns are read apart or more than once."""
    path = f"{shared_dir(df.sparkSession)}/tidemark-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{name}")
    _WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/{name}")


#: Folders of the tables that this process wrote.
_WRITTEN: list[str] = []


def discard_tables(spark: SparkSession) -> int:
    """Deletes the tables written so far and says how many; for the end of a job,
    when nothing that was made from them is read any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    n = 0
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n
