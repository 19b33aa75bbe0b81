"""Sessions, table access, shared-folder tables and the key rules of the corpus."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import time
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: list[str] = []
_shipped: set[str] = set()
_written: list[str] = []


def get_spark(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings that the library relies on (UTC, AQE)."""
    b = (
        SparkSession.builder.master(master)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python workers, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="corpusmill-zip-")
    atexit.register(shutil.rmtree, folder, True)
    with zipfile.ZipFile(f"{folder}/corpusmill.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(f"{folder}/corpusmill.zip")
    _shipped.add(sc.applicationId)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the folder ``sf_dir``."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session. Where that is
    unset, an own temporary folder on a local master (tests), an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="corpusmill-"))
        atexit.register(shutil.rmtree, _own_dir[0], True)
    return f"file://{_own_dir[0]}"


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    It cuts the lineage: the files survive the loss of any executor. They are removed by
    ``drop_intermediates`` or when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corpusmill/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    p, fs = _hadoop(spark, path)
    fs.deleteOnExit(p)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_intermediates(spark: SparkSession) -> int:
    """Removes the tables that ``materialize`` has written so far, and says how many. To be
    called once the results that read them have been written; they can't be read again."""
    n = len(_written)
    while _written:
        p, fs = _hadoop(spark, _written.pop())
        fs.delete(p, True)
    return n


def drop_shuffles(spark: SparkSession) -> None:
    """Removes the shuffle files of the queries that have ended. Spark does so once the driver's JVM
    finds them unused, which can be long after a disk is full."""
    for _ in range(2):  # what the first finds unused can hold others; files go in a thread of their own
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def strip_ws(c: Column) -> Column:
    """``c`` without white space of any kind at either end."""
    return F.regexp_replace(c, r"^[\s\x{1C}-\x{1F}\x{85}\p{Z}]+|[\s\x{1C}-\x{1F}\x{85}\p{Z}]+$", "")


def norm_key(c: Column | str) -> Column:
    """Segment ids, recording names and speaker ids: trimmed, in lower case; '' is null."""
    return F.nullif(F.lower(strip_ws(F.col(c) if isinstance(c, str) else c)), F.lit(""))


def norm_split(c: Column | str) -> Column:
    """Split labels: trimmed, in lower case, ``valid`` and ``dev`` as ``validation``; '' is null."""
    k = norm_key(c)
    return F.when(k.isin("valid", "dev"), F.lit("validation")).otherwise(k)


def rec_of(audio_id: Column | str) -> Column:
    """The recording name: the segment id up to its last underscore."""
    c = F.col(audio_id) if isinstance(audio_id, str) else audio_id
    return F.regexp_replace(c, "_[^_]*$", "")
