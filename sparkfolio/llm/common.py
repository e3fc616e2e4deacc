"""Helpers shared by the training-data operators.

Conventions that hold for every operator of this subpackage:

* a null text is an empty text unless the operator says otherwise;
* only the columns an operator is told about are read, so further columns of
  the input, whatever their names, neither reach it nor clash with its own;
* intermediate tables are written under ``spark.checkpoint.dir``, the folder
  that driver and executors share, so a lost executor costs no more than the
  tasks it was running.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs without the six ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of narrow intermediate tables in one file.
FILE_ROWS = 200_000
#: Places of rows, a path and a number each, that are broadcast at most.
BROADCAST_PLACES = 200_000


#: Folder of each application.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in ``spark.checkpoint.dir``; it is deleted when the driver ends.

    Where none is configured, one is made for a local master only: executors of
    a cluster do not share the driver's disk.
    """
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
            at = tempfile.mkdtemp(prefix="sparkfolio-checkpoint-")
        _OWN[app] = f"{at.rstrip('/')}/sparkfolio-{app}"
        path, system = _path(spark, _OWN[app])
        system.mkdirs(path)
        system.deleteOnExit(path)
    return _OWN[app]


def _path(spark: SparkSession, name: str) -> tuple:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def written(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Lineage is cut by a committed table instead of by cached blocks, so the
    result outlives the executors that made it and is computed only once.
    With ``rows``, how many there are about, the table gets no more files than
    they need, whatever the number of partitions they were computed in.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    (df if rows is None else df.repartition(1 + rows // FILE_ROWS)).write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def drop_written(df: DataFrame) -> None:
    """Delete a table made by ``written`` that no later step reads."""
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path, system = _path(df.sparkSession, name)
        system.delete(path, True)


def located(docs: DataFrame, label: str = "located") -> DataFrame:
    """``docs`` as they are, from a place where a row has a file and a number in it that each later read gives again.

    That is the table itself where ``docs`` are a file table just as it was
    read, else a copy in the shared folder.
    """
    plan = docs._jdf.queryExecution().analyzed().getClass().getSimpleName()
    try:
        docs.select(docs.metadataColumn("_metadata")["row_index"]).schema  # noqa: B018  asks the analyzer
    except AnalysisException:
        plan = ""
    return docs if plan == "LogicalRelation" else written(docs, label)


def location(docs: DataFrame) -> list[Column]:
    """File and row number of each row of ``located`` documents."""
    at = docs.metadataColumn("_metadata")
    return [at["file_path"], at["row_index"]]


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``located`` documents but those at the places ``gone(file, row)``, a written table.

    Up to BROADCAST_PLACES places are broadcast, so documents stay where they
    lie; more are joined like any table, which moves each document once.
    """
    file, row = fresh(docs, "file", "row")
    small = gone.count() <= BROADCAST_PLACES
    gone = gone.select(F.col("file").alias(file), F.col("row").alias(row))
    at = [c.alias(n) for c, n in zip(location(docs), (file, row))]
    every = docs.select(*[col(c) for c in docs.columns], *at)
    return every.join(F.broadcast(gone) if small else gone, [file, row], "left_anti").select(*[col(c) for c in docs.columns])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have yet."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def col(name: str):
    """A column by its literal name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def pinned(condition: Column) -> Column:
    """The same condition, computed where it stands.

    The optimizer puts a filter's definition in place of each column it names
    and pushes it down, and again below that.  Where the definition rests on
    chains of array functions it would grow beyond bounds and every part of it
    would be computed many times; a part that is not deterministic stops that.
    """
    return condition & (F.monotonically_increasing_id() >= 0)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
