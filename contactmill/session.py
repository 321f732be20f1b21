"""Session settings for tests, bench and local runs; on a cluster the given session is used as it is."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str, cores: str = "8", **extra: str) -> SparkSession:
    b = (SparkSession.builder.master(f"local[{cores}]").appName(app)
         .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.driver.memory", "12g")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         # Call-site capture for every column call slows the building of large expressions.
         .config("spark.python.sql.dataFrameDebugging.enabled", "false"))
    for k, v in extra.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the run: the one the cluster names (``spark.checkpoint.dir``), with a folder of its own for
    this application below it. Only a local session without that setting gets a folder of ours."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can read")
        named = f"{tempfile.gettempdir()}/contactmill-checkpoints/{sc.applicationId}"
    sc.setCheckpointDir(named)
    return named


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: the plan is cut there, is computed once, and
    survives the loss of an executor. Runs a job; the folder is new for each call."""
    path = scratch(df.sparkSession, "written")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete ``tables``, which `written` made and nothing reads any more (others stay), and have the shuffle files of ended
    queries removed: Spark removes those once the driver's JVM has collected their plans, which on a long job is late."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for df in tables:
        # All files of such a table are in one folder.
        for file in df.inputFiles()[:1]:
            folder = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file)).getParent()
            if folder.getName().startswith("written-"):
                folder.getFileSystem(conf).delete(folder, True)
    gc.collect()
    jvm.System.gc()
