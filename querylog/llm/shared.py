"""Folders, staged tables and column helpers that several operators use."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Words between ASCII white space, and words of letters, digits and all beyond ASCII.
SPACED_WORD = r"[^\x20\x09-\x0D]+"
PLAIN_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # before A to Z are lower-cased

#: Folders of local sessions that name none.
_OWN_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    A local session (as in tests) without that setting gets a temporary folder
    of its own; on a cluster the setting is required.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    if not re.fullmatch(r"local(\[[^-]*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _OWN_FOLDERS:
        _OWN_FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="querylog-shared-")
    return _OWN_FOLDERS[context.applicationId]


def staged(frame: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts its lineage.

    What was computed is then safe from lost executors and is not computed again.
    """
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/staged-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def drop_staged(*frames: DataFrame) -> None:
    """Delete the files behind staged frames that nobody reads any more."""
    for frame in frames:
        jvm = frame.sparkSession._jvm
        conf = frame.sparkSession._jsc.hadoopConfiguration()
        for folder in {name.rsplit("/", 1)[0] for name in frame.inputFiles()}:
            if "/staged-" in folder:
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate a value once per row and use it in an expression many times."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    """Lower-case A to Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def row_key(frame: DataFrame, *names: str) -> Column:
    """A digest of the named columns: rows that share it are equal in all of them."""
    parts = []
    for name in names:
        value = frame[name].cast("string")
        parts += [F.when(value.isNull(), "n").otherwise(F.concat(F.lit("v"), F.length(value), F.lit(":"), value))]
    return F.unhex(F.md5(F.concat(*parts)))


#: Labelled rows that trusted text is fitted on, at most.
MOST_TRUSTED = 20_000


def trusted_rows(docs: DataFrame, labels: DataFrame, most: int = MOST_TRUSTED) -> DataFrame:
    """Texts of at most ``most`` documents labelled as good."""
    ids = labels.filter("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.join(F.broadcast(ids), "doc_id", "left_semi")
