"""Tables that are replaced as a whole or in parts, and are never gone in between.

Data goes to a folder that nothing was written to before. What the table consists of after a change is then appended to its
commits, as one file, and readers follow the last commit. A write that fails leaves no commit, so the table stays what it
was; and a table may be replaced by something that reads it. There is one writer of a table at a time.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_COMMIT = "version bigint, writer string, part string, folder string, fingerprint string"


@dataclass(frozen=True)
class Part:
    """Where a part of a table is, below the table's path, and what its data was made from. Without rows it has no folder."""

    folder: str | None
    fingerprint: str | None = None


@dataclass(frozen=True)
class Commit:
    version: int
    parts: dict[str, Part]


def _commits(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(_COMMIT).parquet(f"{path}/commits")
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def last_commit(spark: SparkSession, path: str) -> Commit:
    """What a table consists of; version 0 without parts if it has no commit."""
    commits = _commits(spark, path)
    last = commits and commits.agg(F.max(F.struct("version", "writer")).alias("last")).first()["last"]
    if not last:
        return Commit(0, {})
    rows = commits.where((F.col("version") == last["version"]) & (F.col("writer") == last["writer"])).collect()
    return Commit(last["version"], {r["part"]: Part(r["folder"], r["fingerprint"]) for r in rows if r["part"] is not None})


def commit(spark: SparkSession, path: str, parts: dict[str, Part]) -> None:
    """Make these the parts of the table."""
    version, writer = last_commit(spark, path).version + 1, uuid.uuid4().hex
    rows = [(version, writer, name, part.folder, part.fingerprint) for name, part in parts.items()]
    rows = rows or [(version, writer, None, None, None)]
    spark.createDataFrame(rows, _COMMIT).coalesce(1).write.mode("append").parquet(f"{path}/commits")


def new_folder() -> str:
    """A folder for data, below a table's path. Its name reads as a partition, and as text in any case."""
    return f"data/run=r{uuid.uuid4().hex}"


def replace_table(df: DataFrame, path: str) -> DataFrame:
    """Make these rows the table, whatever it held, and read it back."""
    folder = new_folder()
    df.write.parquet(f"{path}/{folder}")
    commit(df.sparkSession, path, {"": Part(folder)})
    return read_table(df.sparkSession, path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The table as of the last commit."""
    parts = last_commit(spark, path).parts
    if "" not in parts:
        raise FileNotFoundError(f"no table was committed to {path}")
    return spark.read.parquet(f"{path}/{parts[''].folder}")


def drop_superseded(spark: SparkSession, path: str) -> list[str]:
    """Empty the folders that earlier commits name and the last one does not; their names.

    For a time when nobody reads an earlier version any more. Folders of failed writes have no commit and stay.
    """
    commits = _commits(spark, path)
    if commits is None:
        return []
    live = {part.folder for part in last_commit(spark, path).parts.values()}
    old = sorted({r["folder"] for r in commits.where("folder IS NOT NULL").select("folder").distinct().collect()} - live)
    for folder in old:
        spark.createDataFrame([], "dropped boolean").write.mode("overwrite").parquet(f"{path}/{folder}")
    return old
