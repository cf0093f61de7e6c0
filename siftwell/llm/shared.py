"""What several operators of the subpackage need."""

import io
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import siftwell
from siftwell.storage import shared_folder

# Words are what lies between space, tab, line feed, vertical tab, form feed and carriage return.
WORD_BREAK = r"[ \t-\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), "")


def fresh_folder(spark: SparkSession, kind: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{shared_folder(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the file system that Spark resolves it to, for readers and writers that are not Spark's."""
    context = spark.sparkContext
    hadoop = context._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application, through the shared folder.

    Workers then import it by name, whatever their own path holds, and keep its caches between tasks.
    """
    context = spark.sparkContext
    if getattr(context, "_siftwell_shipped", False):
        return
    root, packed = Path(siftwell.__file__).parent, io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(root.rglob("*.py")):
            out.writestr(str(Path("siftwell") / file.relative_to(root)), file.read_bytes())
    path = context._jvm.org.apache.hadoop.fs.Path(fresh_folder(spark, "package") + ".zip")
    stream = path.getFileSystem(context._jsc.hadoopConfiguration()).create(path)
    stream.write(bytearray(packed.getvalue()))
    stream.close()
    context.addPyFile(path.toString())
    context._siftwell_shipped = True
