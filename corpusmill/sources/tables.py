"""Reading of base tables and writing of shared intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders made for applications whose cluster names none.
_OWN_DIRS: dict[str, str] = {}


#: Bytes of an Arrow batch that goes to Python, where the session has Spark's default: rows alone say nothing of texts.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound the bytes of the batches that Python workers get, unless the session says otherwise."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("67108864", "67108864b", "64m"):
        spark.conf.set(key, str(BATCH_BYTES))


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The Parquet table ``name`` under ``sf_dir``, pruned to ``columns`` if any are given."""
    bound_batches(spark)
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """A folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, a temporary folder is
    made, once for each application, if the session runs on one machine (a local master); on a
    cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master.split("[")[0] != "local":
            raise ValueError(f"spark.checkpoint.dir must name a folder that driver and executors share (master {master})")
        app = spark.sparkContext.applicationId
        if app not in _OWN_DIRS:
            _OWN_DIRS[app] = tempfile.mkdtemp(prefix="corpusmill-")
            atexit.register(shutil.rmtree, _OWN_DIRS[app], ignore_errors=True)
        root = f"file://{_OWN_DIRS[app]}"
    return root.rstrip("/")


def materialise(df: DataFrame, name: str = "stage", codec: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return the table read back.

    It cuts the lineage and survives the loss of any executor, unlike a cached or
    locally checkpointed frame. The files go when the application ends. ``codec`` is their compression, if not the session's.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corpusmill/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)
