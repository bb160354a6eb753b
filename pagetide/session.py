"""Session helpers.

On a cluster the session is created by the platform; we only read from it.
Local defaults are applied only when a setting is unset (tests, bench).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOCAL_DEFAULTS = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # pages are ~20 KB each: keep Arrow batches for the Python stage small
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.driver.memory": "8g",
}


def settings_master(master: str | None) -> str:
    return master or os.environ.get("PAGETIDE_MASTER", "local[8]")


def get_spark(master: str | None = None, app: str = "pagetide", **conf: str) -> SparkSession:
    """Return the active session, or build a local one with sane defaults."""
    active = SparkSession.getActiveSession()
    if active is not None:
        checkpoint_dir(active)
        return active
    builder = SparkSession.builder.appName(app)
    builder = builder.master(settings_master(master))
    settings = {**LOCAL_DEFAULTS, **conf}
    if "spark.checkpoint.dir" not in settings and settings_master(master).startswith("local"):
        scratch = os.environ.get("PAGETIDE_SCRATCH", "/tmp")
        settings["spark.checkpoint.dir"] = tempfile.mkdtemp(prefix="pagetide-ckpt-", dir=scratch)
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    The cluster's setting wins. Only when nothing is configured (local tests)
    do we create a scratch folder and register it on the context.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not current:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        scratch = os.environ.get("PAGETIDE_SCRATCH", "/tmp")
        current = tempfile.mkdtemp(prefix="pagetide-ckpt-", dir=scratch)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return sc.getCheckpointDir() or current


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts lineage, and
    later stages re-read files that survive a lost executor."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def computed(df: DataFrame, **columns) -> DataFrame:
    """``df`` with ``columns`` computed once per row, before anything that reads them.

    A filter or a projection above would else take in the expressions of the columns
    that it names, once for each use, and run long regex chains as often. What a
    generator gives out is a plain column to the optimizer. Joins on the columns of
    ``df`` still go below.
    """
    keep = [c for c in df.columns if c not in columns]
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def numbered(df: DataFrame) -> DataFrame:
    """``df``, as read from files, with a number per row (``_row``) for ``dealt``:
    the same one whenever a task reads its files again."""
    return df.withColumn("_row", F.monotonically_increasing_id())


def dealt(rows: DataFrame) -> DataFrame:
    """The rows of ``numbered`` dealt to tasks of equal size. A table may come as few
    files of one row group each, which one task reads, however many cores there are:
    work that costs far more than the move of a row must not stay in the tasks that
    read. Rows with equal or null keys are dealt like any others."""
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    return rows.repartition(tasks, "_row").drop("_row")


_shipped: set[tuple[int, str]] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``pagetide`` importable in executor Python workers.

    Python stages (mapInPandas) pickle module functions by reference, so the
    workers must import this package. The package is zipped in memory,
    written to the shared checkpoint folder through the Hadoop FS API and
    registered with ``addPyFile`` once per SparkContext.
    """
    import hashlib
    import io
    import zipfile

    root = os.path.dirname(os.path.abspath(__file__))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as zf:
        for folder, _, files in sorted(os.walk(root)):
            for name in sorted(files):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    arc = os.path.join("pagetide", os.path.relpath(full, root))
                    zf.writestr(zipfile.ZipInfo(arc, (2020, 1, 1, 0, 0, 0)), open(full, "rb").read())
    data = buf.getvalue()
    digest = hashlib.sha256(data).hexdigest()[:12]
    sc = spark.sparkContext
    key = (id(sc._jsc), digest)
    if key in _shipped:
        return
    jvm = sc._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{checkpoint_dir(spark).rstrip('/')}/pyfiles/pagetide-{digest}.zip")
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(path):
        out = fs.create(path, True)
        out.write(bytearray(data))
        out.close()
    sc.addPyFile(path.toString())
    _shipped.add(key)
