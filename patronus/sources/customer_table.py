"""The scored customer table, written once per content of its source tables.

Dashboards, clusters and training read the same customers.  ``stored_profiles`` writes
them as Parquet under the shared checkpoint folder, range-partitioned and sorted by
CustomerID, so that a point lookup or an id range prunes files and row groups by their
statistics and a summary reads its own columns only.  The folder's name carries a key of
the source files (paths, lengths, modification times) and of the layout: rewritten source
tables get a new folder.  Of writers at the same time each has its own folder; a folder
counts once its job has committed.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patronus.session import checkpoint_dir, scratch_path
from patronus.sources.tables import Tables

#: Raised when the meaning or the columns of the stored table change.
LAYOUT = 1
SOURCES = ["orders", "lineitem", "customer", "nation"]


def content_key(t: Tables, names: list[str] = SOURCES) -> str:
    """A key of the tables' files; their contents are not read."""
    files = t.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(
        [os.path.join(t.root, f"{n}.parquet") for n in names]).select("path", "length", "modificationTime")
    mark = F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")
    n, total = files.agg(F.count(F.lit(1)), F.coalesce(F.sum(mark), F.lit(0))).first()
    return f"{LAYOUT}-{n}-{int(total) % (1 << 64):016x}"


def _committed(spark: SparkSession, stem: str) -> str | None:
    """The folder of a finished write of that name, the first by name."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_path(spark, stem)}-*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    done = sorted(f.getPath().getParent().toString() for f in found)
    return done[0] if done else None


def stored_profiles(t: Tables) -> DataFrame:
    """``rfm.customer_profiles`` of the tables, from the stored table."""
    from patronus.operators.rfm import customer_profiles
    spark = t.spark
    checkpoint_dir(spark)
    stem = f"customers-{content_key(t)}"
    path = _committed(spark, stem)
    if path is None:
        path = scratch_path(spark, f"{stem}-{uuid.uuid4().hex}")
        customer_profiles(t).repartitionByRange("CustomerID").sortWithinPartitions("CustomerID").write.parquet(path)
    return spark.read.parquet(path)
