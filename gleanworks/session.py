"""Session, table access and lineage control shared by all operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "gleanworks", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings that the operators expect (UTC, AQE, ANSI)."""
    return (
        SparkSession.builder.appName(app)
        .master(f"local[{cores}]")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a folder; a file or a directory of parts."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so that a lost executor loses nothing.

    The folder is the session's ``spark.checkpoint.dir``. Only where neither that nor a folder on the
    context is set (a local test) a temporary one is made; on a cluster the setting must be present.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not sc.master.startswith("local["):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="gleanworks-checkpoint-")
        sc.setCheckpointDir(shared)
    return df.checkpoint(eager=True)


_WRITTEN: list[tuple[SparkSession, str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    try:
        sc = spark.sparkContext
        place = sc._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True)
    except Exception:  # noqa: BLE001  the session may have ended before
        pass


def release_tables() -> None:
    """Delete what ``written_table`` has written. To be called when no result that was made from it is needed any more."""
    while _WRITTEN:
        _delete(*_WRITTEN.pop())


atexit.register(release_tables)


def written_table(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back.

    Cuts the lineage like ``cut_lineage``, in compressed columns: for intermediate results that are read several times.
    The folder is removed by ``release_tables``, at the latest when the session's driver ends.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="gleanworks-tables-")
        sc.setCheckpointDir(base)
        base = sc.getCheckpointDir()
    path = f"{base}/gleanworks-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append((spark, path))
    return spark.read.parquet(path)


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], salt: str, how: str = "inner", fan: int = 16) -> DataFrame:
    """Equi-join in which a key that is frequent in ``big`` is spread over ``fan`` tasks by a hash of column ``salt``.

    ``small`` has few rows per key and is repeated ``fan`` times.
    """
    from pyspark.sql import functions as F

    left = big.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(fan)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(fan - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


class StageCache:
    """Results of the stages of a run in a shared folder: a stage that is complete there is read, not computed again.

    As a context it removes the folder when the run succeeds; after a failure the complete stages stay for the next run.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _place(self, name: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def stage(self, name: str, build) -> DataFrame:
        """The table of a stage; ``build()`` makes it if it is not complete."""
        place, files = self._place(f"{name}/_SUCCESS")
        if not files.exists(place):
            build().write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def __enter__(self) -> StageCache:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            place, files = self._place("")
            files.delete(place, True)
