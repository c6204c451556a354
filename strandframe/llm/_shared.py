"""Scratch space every executor can reach, and plan-size helpers."""
import gc
import uuid


def shared_dir(spark) -> str:
    """Folder of spark.checkpoint.dir, which all executors share; where it is unset (tests on one machine) a folder of this machine is set."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file:///tmp/checkpoints"
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def scratch(spark, name: str) -> str:
    return f"{shared_dir(spark)}/strandframe/{name}-{uuid.uuid4().hex}"


def materialize(df, name: str):
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark, at = df.sparkSession, scratch(df.sparkSession, name)
    df.write.parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out.scratch_at = at
    return out


def discard(*tables) -> None:
    """Delete materialized tables that nothing reads any more, and let go the shuffle files of finished queries.

    Spark deletes a shuffle's files when the driver collects the garbage that refers to them, which may be hours later."""
    for df in tables:
        jvm, spark = df.sparkSession._jvm, df.sparkSession
        path = jvm.org.apache.hadoop.fs.Path(df.scratch_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if tables:
        del df
        gc.collect()
        spark._jvm.System.gc()


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts_for(df, bytes_each: int = 16 << 20) -> int:
    """Partitions that follow the planner's size estimate, at least the session's shuffle partitions."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(100_000, size // bytes_each))
