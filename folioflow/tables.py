"""Reading the parquet tables of a data folder, and the session they need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of ``folder``; columns are pruned by the caller's select."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def newest(df: DataFrame, key: str, *order: str) -> DataFrame:
    """One row per ``key``: the greatest by ``order`` (nulls are smallest).

    Rows that tie on every order column are alike in these tables; a hash of
    the whole row settles the rest so that the result doesn't depend on the
    partitioning. Rows with a null key are dropped.
    """
    plain = [c for c, t in df.dtypes if "map" not in t]
    by = [F.col(c).desc_nulls_last() for c in order] + [F.xxhash64(*plain).desc()]
    w = Window.partitionBy(key).orderBy(*by)
    return df.where(F.col(key).isNotNull()).withColumn("__row_of_key", F.row_number().over(w)).where("__row_of_key = 1").drop("__row_of_key")


def present(c: Column | str) -> Column:
    """True if the text has a visible character; false for null."""
    return F.coalesce(F.col(c).rlike(r"\S") if isinstance(c, str) else c.rlike(r"\S"), F.lit(False))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out evenly by a hash of ``keys`` over the session's shuffle partitions."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


def _shared(spark: SparkSession) -> str | None:
    """The cluster's shared checkpoint folder, from the session; None where it is unset, as in tests."""
    return spark.conf.get("spark.checkpoint.dir", None)


def ship(spark: SparkSession) -> None:
    """Give the workers this package, once a context, so that they needn't have it installed.

    The archive is written to the shared checkpoint folder where that is a
    path of the file system, else to a folder of the driver, and handed to
    Spark, which serves it to the executors.
    """
    import tempfile
    import zipfile
    from pathlib import Path
    from urllib.parse import urlparse

    sc = spark.sparkContext
    if getattr(sc, "_folioflow", False):
        return
    here = Path(__file__).resolve().parent
    shared = urlparse(_shared(spark) or "")
    if shared.path and shared.scheme in ("", "file"):
        Path(shared.path).mkdir(parents=True, exist_ok=True)
        base = tempfile.mkdtemp(prefix="folioflow-", dir=shared.path)
    else:
        base = tempfile.mkdtemp(prefix="folioflow-")
    to = Path(base) / "folioflow.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    sc.addPyFile(str(to))
    sc._folioflow = True


def settle(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept in the cluster's shared checkpoint folder.

    The folder is that of ``spark.checkpoint.dir``; only in local mode, where
    that is unset as in tests, a folder of the driver's machine is used. On a
    cluster without it there is none that all executors see: RuntimeError.
    Spark removes a checkpoint with its DataFrame where
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set. Runs an action.
    """
    import tempfile

    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = _shared(spark)
        if folder is None:
            if not is_local(sc.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors see")
            folder = tempfile.mkdtemp(prefix="folioflow-")
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def is_local(master: str) -> bool:
    """Whether a session runs in the driver's own process."""
    return master == "local" or master.startswith("local[")
