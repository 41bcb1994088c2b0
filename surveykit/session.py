"""Session defaults and the one place that decides where lineage is cut."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # small shuffles keep their parallelism; large ones still aim at the advisory size
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.files.maxPartitionBytes": "128m",
    # shuffles of unknown size start wide; AQE joins small partitions to the advisory size
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "2000",
}


def build_session(app: str = "surveykit", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {**DEFAULTS, **extra}
    if "spark.sql.shuffle.partitions" in extra:  # a stated number holds from the start
        settings.pop("spark.sql.adaptive.coalescePartitions.initialPartitionNum")
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


#: packages sent, by application
_SHIPPED: dict[str, set[str]] = {}


def ship(spark: SparkSession, *packages: str) -> None:
    """Send Python packages that lie beside this one to the executors, once per application.

    Spark copies the archive to each executor's own folder; the temporary file is only where the driver packs it.
    """
    sc = spark.sparkContext
    sent = _SHIPPED.setdefault(sc.applicationId, set())
    new = {"surveykit", *packages} - sent
    if not new:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), f"{'-'.join(sorted(new))}.zip")
    with zipfile.ZipFile(path, "w") as out:
        for package in new:
            for folder, _, names in os.walk(os.path.join(top, package)):
                for name in names:
                    if name.endswith(".py"):
                        out.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), top))
    sc.addPyFile(path)
    sent |= new


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a local master may fall back to a temporary folder; on a cluster a missing setting is an
    error, because a machine-local folder is lost together with its executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        named = tempfile.mkdtemp(prefix="spark-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Cut lineage through a table in the shared folder (survives executor loss).

    Reading the table back starts a fresh plan. A checkpointed frame would carry the constraints of
    its old plan along, and in loops of self joins their number explodes in the optimizer.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "cut")
    df.write.parquet(path)
    cut = spark.read.schema(df.schema).parquet(path)
    cut._cut_path = path
    return cut


def settle_by(df: DataFrame, key: str) -> DataFrame:
    """A settled table in buckets of ``key``, which joins and groups on ``key`` read without shuffling it again.

    ``df`` should come from a shuffle on ``key``, so that each bucket is one file.
    """
    spark = df.sparkSession
    path, name = scratch_path(spark, "cut"), f"cut_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").bucketBy(buckets, key).option("path", path).saveAsTable(name)
    cut = spark.table(name)
    cut._cut_path, cut._cut_table = path, name
    return cut


def discard(cut: DataFrame) -> None:
    """Delete the table behind a settled frame that nothing reads any more, as loops do with the round before."""
    spark, path = cut.sparkSession, cut.__dict__.pop("_cut_path", None)
    if name := cut.__dict__.pop("_cut_table", None):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    if path:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
