"""Levelled sorted runs: the log-structured store under exact dedup and line dedup.

A run is a Parquet table dealt by a hash of its key and sorted by it inside each file, with a filter of its
keys where asked for. A new run starts at level 0; once `fanout` runs share a level, one pass merges them into a
run of the next level and deletes them. Spark deals and sorts plain Parquet anew for every merge or lookup: that
costs a shuffle of the keys, and nothing else than keys and their counts is in a run.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession

from . import _common


class Run:
    """Rows of one run; probed() gives which of some keys it holds."""

    def __init__(self, path: str, rows: DataFrame, keys: list[str], filtered: bool):
        from .exact_dedup import DigestFilter

        self.path, self.rows, self.keys = path, rows, keys
        self.filter = DigestFilter(rows, keys[0], f"{path}-filter") if filtered else None

    def probed(self, keys: DataFrame) -> DataFrame:
        maybe = self.filter.maybe_in(keys, self.keys[0]) if self.filter else keys
        return maybe.join(self.rows.select(*self.keys), self.keys, "left_semi")


class LevelledRuns:
    """Runs of `keys` plus mergeable columns; `merge` maps each of these to its merging aggregate.

    A merge aggregate must be associative (max, min, sum), so that the order of merges is immaterial. What a
    caller reads of a run has to be written before the next add(), which may merge the run away.
    """

    def __init__(self, spark: SparkSession, keys: list[str], merge: dict[str, Column], fanout: int = 2, filtered: bool = False):
        self.spark, self.keys, self.merge, self.fanout, self.filtered = spark, keys, merge, fanout, filtered
        self.dir = _common.work_dir(spark)
        self.levels: list[list[Run]] = []
        self._made = 0

    def _write(self, df: DataFrame) -> Run:
        path = f"{self.dir}/run-{self._made}"
        self._made += 1
        columns = [*self.keys, *self.merge]
        rows = _common.written(df.select(columns).repartition(*self.keys).sortWithinPartitions(*self.keys), path)
        return Run(path, rows, self.keys, self.filtered)

    def add(self, rows: DataFrame) -> None:
        """Flush rows, one of each key, as a run of level 0, and compact full levels."""
        self._place(self._write(rows), 0)

    def _place(self, run: Run, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            self._place(self._write(self._merged(old)), level + 1)
            for gone in old:
                _common.dropped(self.spark, gone.path)
                _common.dropped(self.spark, f"{gone.path}-filter")

    def _merged(self, runs: list[Run]) -> DataFrame:
        every = reduce(DataFrame.unionByName, (run.rows for run in runs))
        if len(runs) == 1:
            return every
        return every.groupBy(*self.keys).agg(*(how.alias(name) for name, how in self.merge.items()))

    def live(self) -> list[Run]:
        """The runs that a lookup has to read, newest level first."""
        return [run for level in self.levels for run in level]

    def merged(self) -> DataFrame | None:
        """One row for each key over all live runs, or None before the first run."""
        return self._merged(self.live()) if self.live() else None
