"""Results that are materialised in the folder that all machines of a cluster share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.session import ConfigurationError


#: Temporary folders of local applications.
_LOCAL: dict[str, str] = {}
#: Scratch folders of applications.
_SCRATCH: set[str] = set()


def folder(spark: SparkSession) -> str:
    """The shared folder: what ``spark.checkpoint.dir`` names.

    Where it is unset, a local master gets a temporary folder for the application;
    a cluster is an error, as a folder of one machine isn't seen by the others.
    """
    held = spark.conf.get("spark.checkpoint.dir", None)
    if held:
        return held
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ConfigurationError("set spark.checkpoint.dir to a folder that all machines share")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL:
        _LOCAL[application] = tempfile.mkdtemp(prefix="skein-")
    return _LOCAL[application]


def scratch(spark: SparkSession, name: str = "scratch") -> str:
    """A new path in the shared folder, below one of this application's own, which goes when the driver's JVM ends."""
    base = f"{folder(spark)}/skein-{spark.sparkContext.applicationId}"
    if base not in _SCRATCH:
        place = spark._jvm.org.apache.hadoop.fs.Path(base)
        files = place.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(place)
        files.deleteOnExit(place)
        _SCRATCH.add(base)
    return f"{base}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """``df`` without its lineage, written to the shared folder.

    Spark deletes the files when nothing refers to them any more, and what is left goes when the driver's JVM ends.
    """
    context = df.sparkSession.sparkContext
    context._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(folder(df.sparkSession))
    made = df.checkpoint(eager=True)
    written = made._jdf.logicalPlan().rdd().getCheckpointFile()
    if written.isDefined():
        place = context._jvm.org.apache.hadoop.fs.Path(written.get())
        place.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(place)
    return made


#: Rows of a table that may be broadcast once they have been counted.
SMALL = 100_000


def small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """A materialised table of few columns, marked for a broadcast if it has been counted to have at most ``most`` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Spark knows."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
