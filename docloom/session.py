"""Session settings and scratch tables that every executor can read.

Lineage is cut by writing Parquet below the folder named in
``spark.checkpoint.dir``.  A lost executor then costs a re-read, never a
recomputation from the sources, and nothing is left on a machine's own disk.
"""

from __future__ import annotations

import atexit
import shutil
import sys
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, app: str = "docloom", **conf: str) -> SparkSession:
    """A session on this machine, as tests and benches use it."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    base = {
        "spark.sql.shuffle.partitions": str(cores),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "6g",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    return b.config(map=base | conf).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    ``spark.checkpoint.dir`` is read from the session.  It is set here only
    where it is unset and Spark runs inside one JVM, as in tests.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir is unset: name a folder that all executors share")
    found = tempfile.mkdtemp(prefix="docloom-")
    spark.conf.set("spark.checkpoint.dir", found)
    _drop_at_exit(spark, found)
    return found


def _drop_at_exit(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)


def materialize(df: DataFrame, note: str = "t") -> DataFrame:
    """Write ``df`` once to a table in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docloom-{note}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _drop_at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._docloom_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete a table made by :func:`materialize` that no plan reads any more."""
    path = getattr(df, "_docloom_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers of all executors, once for each application."""
    sc = spark.sparkContext
    if getattr(sc, "_docloom_shipped", None) == sc.applicationId:
        return
    root = Path(__file__).parent
    path = Path(tempfile.mkdtemp(prefix="docloom-"), "docloom.zip")  # the driver serves it from here
    atexit.register(shutil.rmtree, path.parent, ignore_errors=True)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(path))
    sys.path[:] = [p for p in sys.path if not p.endswith("docloom.zip")]  # the driver has the package itself
    sc._docloom_shipped = sc.applicationId
