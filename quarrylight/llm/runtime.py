"""Session helpers shared by the operators: shared storage, column names, tables."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` below `sf_dir`, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a URI.

    A cluster names it in `spark.checkpoint.dir`. Only where that is unset, as in
    local tests, does a temporary folder stand in (driver and executors are one
    process there).
    """
    context = spark.sparkContext
    found, known = spark.conf.get(CHECKPOINT_CONF, None), context._jsc.sc().getCheckpointDir()
    if not found:
        found = known.get() if known.isDefined() else "file://" + tempfile.mkdtemp(prefix="quarrylight-")
    if not known.isDefined():
        context.setCheckpointDir(found)
    path = spark._jvm.org.apache.hadoop.fs.Path(found)
    whole = path.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return whole.replace("file:/", "file:///", 1) if whole.startswith("file:/") and not whole.startswith("file://") else whole


def new_shared_path(spark: SparkSession, what: str) -> str:
    """A path of its own below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared folder and read on from there.

    A reliable checkpoint: what later stages read survives the loss of any executor.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Like cut, as a Parquet table in the shared folder: columns are compressed, which suits large tables."""
    path = new_shared_path(df.sparkSession, "table")
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Remove the files of a table from `stored`, once nothing that is still to run reads them."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def sweep(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle and checkpoint files of what is no longer referenced.

    It does so only when the driver happens to collect its garbage; between the phases of a long job that would leave
    all earlier shuffles on the executors' disks.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of `df` has (without regard to case), one for each of `names`."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        new = f"__{name}"
        while new.lower() in taken:
            new = "_" + new
        taken.add(new.lower())
        out.append(new)
    return out


def col(name: str) -> Column:
    """The column of exactly that name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")
