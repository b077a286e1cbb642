"""Written intermediate results: they cut the lineage, survive lost executors and can be read by every later job."""

from __future__ import annotations

import tempfile
import threading
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shipped(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application: their Python workers import it by name."""
    context = spark.sparkContext
    if getattr(context, "_roadlens_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="roadlens-")) / "roadlens.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._roadlens_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names. Only a single machine may go without: there a private one is made."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not (spark.sparkContext.master or "").startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="roadlens-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/roadlens/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


_scopes = threading.local()
_SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lean_lock, _lean = threading.Lock(), {}  # per session, how many blocks are open and the setting they found


def _lean_session(spark: SparkSession, more: int) -> None:
    """Inside a block of :func:`scratch` shuffle files go with the job that made them; else they stay until the driver collects its garbage."""
    key = id(spark._jsparkSession)
    with _lean_lock:
        many, before = _lean.get(key) or (0, spark.conf.get(_SHUFFLES_GO, None))
        if not many:
            spark.conf.set(_SHUFFLES_GO, "true")
        if many + more:
            _lean[key] = (many + more, before)
            return
        del _lean[key]
        if before is None:
            spark.conf.unset(_SHUFFLES_GO)
        else:
            spark.conf.set(_SHUFFLES_GO, before)


@contextmanager
def scratch(spark: SparkSession):
    """What this thread writes inside is removed at the end, but for what it writes with the function that the block gets. Blocks may be nested:
    what is kept of an inner one belongs to the outer one."""
    above, own = getattr(_scopes, "paths", None), []
    _scopes.paths = own
    _lean_session(spark, 1)

    def keep(df: DataFrame, name: str) -> DataFrame:
        _scopes.paths = above
        try:
            return written(df, name)
        finally:
            _scopes.paths = own
    try:
        yield keep
    finally:
        _scopes.paths = above
        _lean_session(spark, -1)
        for path in own:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def written(df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Write once as Parquet, partitioned ``by`` columns, and read back."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    if getattr(_scopes, "paths", None) is not None:
        _scopes.paths.append(path)
    df.write.mode("error").option("compression", "zstd").parquet(path, partitionBy=list(by))
    return spark.read.schema(df.schema).parquet(path)


LEAST_BUCKETS, BUCKET_ROWS = 8, 250_000  # one task takes a whole bucket, of all directories: its rows bound what a window holds


def bucketed(df: DataFrame, name: str, keys, sort, rows: int, clustered: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """Write as a table bucketed on ``keys``, so that later windows, aggregates and joins on them need no shuffle. The number of buckets
    follows from the number of ``rows``.

    ``by`` names columns whose values become directories, each with the same buckets: a reader skips the directories it does not ask for.

    ``clustered`` says that the last step of ``df`` already is a window or aggregate on ``keys``: if it left as many partitions as there are
    buckets, the rows are not shuffled again.
    """
    spark = df.sparkSession
    buckets = max(LEAST_BUCKETS, -(-rows // BUCKET_ROWS))
    clustered = clustered and buckets == int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"roadlens_{name}_{uuid.uuid4().hex[:12]}"
    keys = list(keys)
    placed = df if clustered else df.repartition(buckets, *keys)
    writer = placed.write.mode("error").format("parquet").option("compression", "zstd")
    ((writer.partitionBy(*by) if by else writer)
       .option("path", fresh_path(spark, name)).bucketBy(buckets, *keys).sortBy(*sort).saveAsTable(table))
    return spark.table(table)


def clear(spark: SparkSession) -> None:
    """Removes what this application has written: its folder and its bucketed tables."""
    for t in spark.catalog.listTables():
        if t.name.startswith("roadlens_") and not t.isTemporary:
            spark.sql(f"DROP TABLE IF EXISTS `{t.name}`")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/roadlens/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder, for loops."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)
