"""Session settings the engine expects, and the durable cut of long lineages."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # checkpoints nobody holds any more are deleted
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # an LLM call or an index append must not run twice side by side
    "spark.speculation": "false",
}


def build(master: str = "local[*]", app: str = "kronika", **conf: str) -> SparkSession:
    """A session with the engine's defaults; `conf` keys use `_` for `.` or are given whole in a dict."""
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as `spark.checkpoint.dir` names it. Only a local session without that setting
    gets one of its own; on a cluster a missing setting is an error, as a machine-local folder would be lost with its machine.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
        folder = os.path.join(tempfile.gettempdir(), f"kronika-checkpoint-{os.getpid()}")
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A new place for a table in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage with a checkpoint in the folder all executors share; see `shared_folder`."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager)


def ship(spark: SparkSession) -> SparkSession:
    """Give the package to the executors' Python, once per context; the driver serves the file itself."""
    sc = spark.sparkContext
    if getattr(sc, "_kronika_shipped", False):
        return spark
    package = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="kronika-"), "kronika.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(package):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("kronika", os.path.relpath(path, package)))
    sc.addPyFile(target)
    sc._kronika_shipped = True
    return spark
