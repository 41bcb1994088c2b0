"""Writers that publish complete results once."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession, functions as F

MANIFEST = "token string, attempt string, rows bigint"
ATTEMPT = "commit_attempt"


def _path(spark: SparkSession, where: str):
    return spark._jvm.org.apache.hadoop.fs.Path(where)


def _exists(spark: SparkSession, where: str) -> bool:
    path = _path(spark, where)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def _entry(root: str, token: str) -> str:
    """The manifest file of a token: its name is the claim, so two writers can't both make it."""
    return f"{root}/_manifest/t-{quote(token, safe='')}.json"


def _publish(spark: SparkSession, where: str, content: str) -> bool:
    """Write a file in full beside ``where`` and rename it there; false if the name is taken.

    The rename doesn't replace: on a file system with atomic renames one of several writers wins, and a reader never
    sees a part of the file.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = _path(spark, where)
    # hidden from readers of the manifest until it has its name
    draft = _path(spark, f"{target.getParent().toString()}/.{uuid.uuid4().hex}")
    fs = target.getFileSystem(conf)
    out = fs.create(draft, False)
    out.write(bytearray(content.encode()))
    out.close()
    modes = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    modes[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(draft, target, modes)
    except Exception as e:
        fs.delete(draft, False)
        if "FileAlreadyExistsException" in str(e):
            return False
        raise
    return True


def committed(spark: SparkSession, root: str) -> DataFrame:
    """Manifest rows of ``root``; a missing folder is an empty manifest."""
    if not _exists(spark, f"{root}/_manifest"):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).json(f"{root}/_manifest")


def commit_once(df: DataFrame, root: str, token: str, violations: DataFrame | None = None) -> str:
    """Publish ``df`` under ``token`` at most once, also if several writers try at the same time.

    The data is written to a folder of its own; readers only see folders named by the manifest, so a
    lost job leaves nothing visible. Returns ``committed``, ``refused`` (token known) or ``invalid``
    (the violation table has rows).
    """
    spark = df.sparkSession
    if violations is not None and not violations.isEmpty():
        return "invalid"
    if _exists(spark, _entry(root, token)):
        return "refused"
    attempt = f"a{uuid.uuid4().hex}"
    place = f"{root}/data/{ATTEMPT}={attempt}"
    df.write.mode("errorifexists").parquet(place)
    n = spark.read.parquet(place).count()
    if _publish(spark, _entry(root, token), json.dumps({"token": token, "attempt": attempt, "rows": n})):
        return "committed"
    path = _path(spark, place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return "refused"


def read_committed(spark: SparkSession, root: str) -> DataFrame:
    """Rows of all folders that the manifest names; the names meet the folders in a join, not on the driver."""
    known = committed(spark, root).select(F.col("attempt").alias(ATTEMPT))
    if known.isEmpty():
        raise FileNotFoundError(f"nothing committed below {root}")
    rows = spark.read.parquet(f"{root}/data")
    return rows.join(known, ATTEMPT, "left_semi").drop(ATTEMPT)


def batch_committer(root: str, run: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer of the run with token ``run``: a replayed batch is refused, so each batch lands once."""

    def write(df: DataFrame, batch_id: int) -> None:
        commit_once(df, root, f"{run}-{batch_id}")

    return write
