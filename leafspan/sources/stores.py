"""Index tables on shared storage: versioned Parquet with append, delete, cache lookup and resumable results."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class TableStore:
    """A named table whose rewrites go to a new version folder, so readers and retries never see half a table.

    A version counts once its ``_SUCCESS`` marker exists.
    """

    def __init__(self, spark: SparkSession, root: str, name: str, variant: str = "standard") -> None:
        self.spark = spark
        self.folder = f"{root.rstrip('/')}/{name}/variant={variant}"

    def _versions(self) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(path):
            return []
        found = []
        for status in files.listStatus(path):
            match = re.fullmatch(r"v(\d+)", status.getPath().getName())
            marker = self.spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
            if match and files.exists(marker):
                found.append(int(match.group(1)))
        return sorted(found)

    def exists(self) -> bool:
        return bool(self._versions())

    def read(self) -> DataFrame:
        """The current table; a store without one reads as a table without rows and columns."""
        if not self.exists():
            return self.spark.createDataFrame([], StructType([]))
        return self.spark.read.parquet(f"{self.folder}/v{self._versions()[-1]}")

    def replace(self, df: DataFrame, partition_by: Sequence[str] = ()) -> None:
        following = (self._versions() or [0])[-1] + 1
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{self.folder}/v{following}")

    def append(self, df: DataFrame) -> None:
        """Add rows to the current version."""
        if not self.exists():
            self.replace(df)
            return
        df.write.mode("append").parquet(f"{self.folder}/v{self._versions()[-1]}")

    def delete(self, keys: DataFrame, on: Sequence[str]) -> None:
        """Remove the rows whose ``on`` columns occur in ``keys``; nothing is rewritten when none match."""
        if not self.exists():
            return
        current = self.read()
        if not current.join(keys, list(on), "left_semi").isEmpty():
            self.replace(current.join(keys, list(on), "left_anti"))

    def reset(self) -> None:
        """Continue with an empty table of the same columns; a store without a table stays as it is."""
        if self.exists():
            self.replace(self.read().limit(0))


def cache_key(model: str, prompt: str = "prompt"):
    """Identity of a model call."""
    return F.sha2(F.concat_ws("\u0001", F.lit(model), F.col(prompt)), 256)


def missing_calls(calls: DataFrame, cached: DataFrame) -> DataFrame:
    """Calls ``(doc_id, node_id, key, ...)`` without a cached reply."""
    return calls.join(cached.select("doc_id", "node_id", "key"), ["doc_id", "node_id", "key"], "left_anti")


def pending_questions(questions: DataFrame, results: DataFrame, keys: Sequence[str], force: bool = False) -> DataFrame:
    """Questions still to answer: no result, or one with an empty output; blank questions are skipped."""
    asked = questions.filter(F.col("question").isNotNull() & (F.col("question") != ""))
    if force:
        return asked
    finished = results.filter(F.col("output").isNotNull() & (F.col("output") != "")).select(*keys)
    return asked.join(finished, list(keys), "left_anti")


def merge_results(previous: DataFrame, fresh: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Earlier results without the redone questions, plus the fresh ones."""
    return previous.join(fresh.select(*keys), list(keys), "left_anti").unionByName(fresh, allowMissingColumns=True)


def write_scores(scores: DataFrame, path: str, first: Sequence[str]) -> None:
    """Write evaluated rows as JSON with the named columns first."""
    rest = [c for c in scores.columns if c not in first]
    scores.select(*first, *rest).write.mode("overwrite").json(path)
