"""Tables kept as committed runs.

A run holds what a range of batches changed, in one folder a table.  Batches are numbered as they come
from whatever source; each source's own numbers tell which of its batches are there already.  It counts once its
commit, a row appended to the ``commits`` table, is there; until then readers don't see it, and
whoever writes it again replaces it.  Merging writes the runs of a range as one run of the whole
range: the commit of that one is the moment from which readers take it in place of its parts.

One writer at a time; readers need no lock, as they take their runs from the commits they read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession

#: Runs of one size that are merged into one.
FANOUT = 8
#: What stands before the first batch.
BEGIN = -1
COMMITS = "start bigint, upto bigint, source string, batch bigint"


@dataclass(frozen=True, order=True)
class Run:
    """The batches after ``start`` up to ``upto``."""

    start: int
    upto: int


class Runs:
    """The runs under a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _commits(self) -> list[Row]:
        """A row a batch or merge."""
        try:
            return self.spark.read.schema(COMMITS).parquet(f"{self.path}/commits").collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []

    def committed(self) -> set[Run]:
        """All runs with a commit, merged ones too."""
        return {Run(r["start"], r["upto"]) for r in self._commits()}

    def next(self, source: str, batch: int) -> Run | None:
        """The run that a source's batch is to be written as, or None if it is committed: a source's batches come in order."""
        rows = self._commits()
        if any(r["source"] == source and r["batch"] >= batch for r in rows):
            return None
        last = max((r["upto"] for r in rows), default=BEGIN)
        return Run(last, last + 1)

    def live(self) -> list[Run]:
        """The fewest committed runs that cover all batches, oldest first: of those that end alike the widest."""
        widest: dict[int, int] = {}
        for run in self.committed():
            widest[run.upto] = min(run.start, widest.get(run.upto, run.start))
        out, at = [], max(widest, default=BEGIN)
        while at != BEGIN:
            out.append(Run(widest[at], at))
            at = widest[at]
        return out[::-1]

    def folder(self, table: str, run: Run) -> str:
        return f"{self.path}/{table}/start={run.start}/upto={run.upto}"

    def write(self, run: Run, table: str, rows: DataFrame, by: list[str] | None = None, **options: str) -> None:
        """Write a table of a run that isn't committed yet; an earlier attempt's files are replaced."""
        out = rows.write.mode("overwrite").options(**options)
        (out.partitionBy(*by) if by else out).parquet(self.folder(table, run))

    def commit(self, run: Run, source: str | None = None, batch: int | None = None) -> None:
        """One row in one file, which the job's commit moves into place whole."""
        self.spark.createDataFrame([(run.start, run.upto, source, batch)], COMMITS).coalesce(1).write.mode("append").parquet(f"{self.path}/commits")

    def read(self, table: str, schema: str, runs: list[Run]) -> DataFrame:
        """A table's rows in these runs, with ``upto``, the newest batch that the row's run covers."""
        if not runs:
            return self.spark.createDataFrame([], f"{schema}, upto bigint")
        rows = self.spark.read.schema(f"{schema}, start bigint, upto bigint").option("basePath", f"{self.path}/{table}")
        return rows.parquet(*[self.folder(table, r) for r in runs]).drop("start")

    def crowded(self, fanout: int = FANOUT) -> list[Run]:
        """The newest runs if ``fanout`` of them are of one size or smaller: they should be merged.

        Sizes are powers of the fanout in batches, so that a batch is rewritten once a power.
        """
        size = lambda r: next(k for k in range(64) if r.upto - r.start < fanout ** (k + 1))
        live = self.live()
        last: list[Run] = []
        for run in reversed(live):
            if last and size(run) > max(map(size, last)):
                break
            last.insert(0, run)
        return last if len(last) >= fanout else []

    def sweep(self, tables: list[str]) -> int:
        """Delete the folders of committed runs that a wider one replaces; for when no reader is left that took them."""
        live, swept = set(self.live()), 0
        gateway = self.spark._jvm.org.apache.hadoop.fs.Path
        for run in self.committed() - live:
            for table in tables:
                path = gateway(self.folder(table, run))
                swept += path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return swept
