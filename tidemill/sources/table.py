"""A table of points: journal, immutable sorted generations, compaction.

``write_batch`` appends to a journal of Parquet batches; they are the pending
points. ``flush`` turns them into one sorted generation. Opening a table always
sees committed generations and journal batches alike, so nothing is lost when a
writer stops. Runs that are no longer live stay for ``grace`` seconds, for readers that
began before. Every scan gives one row per timestamp, the newest write, in order.

A table that is made with ``repeats`` keeps every write as a point of its own, whatever
its timestamp; of equal timestamps a scan gives the smaller value first. The list of runs
says which kind a table is, so it stays that kind however it is opened.
"""

import time
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from tidemill.operators import lww
from tidemill.schema import POINT, POINT_BYTES, POINT_SEQ, checked
from tidemill.sources import files
from tidemill.sources.manifest import Snapshot, Store

#: Live runs at which a flush is followed by a compaction.
COMPACT_AT = 4
#: Seconds for which runs stay after they have left the list.
GRACE = 3600
#: Sorted timestamps shrink to a few bits each as second differences; doubles as zstd.
LAYOUT = {"compression": "zstd", "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false"}


class Table:
    def __init__(self, spark: SparkSession, path: str, capacity: int = 4 << 20, compact_at: int = COMPACT_AT, grace: float = GRACE, repeats: bool = False):
        self.spark, self.path, self.capacity, self.compact_at, self.grace = spark, path.rstrip("/"), capacity, compact_at, grace
        self.store = Store(spark, self.path)
        if repeats and not self.store.versions():
            self.store.commit(Snapshot(repeats=True))
        self.repeats = self.store.read().repeats
        if repeats and not self.repeats:
            raise ValueError(f"{self.path} keeps one point of a timestamp")
        self.order = ("timestamp", "value") if self.repeats else ("timestamp",)

    @classmethod
    def from_folder(cls, spark: SparkSession, folder: str, path: str, **options) -> "Table":
        """A new table at ``path`` with the points of a folder of numbered block files and a log: the
        files' points are one run, those of the log are pending. Of several values of a timestamp the log's
        last one counts, else that of the highest number; with ``repeats`` all do."""
        table = cls(spark, path, **options)
        found = [name for name in table.store.names(folder) if name.endswith(".sst")]
        if found:
            stored = files.read_block_files(spark, f"{folder.rstrip('/')}/*.sst", numbered=True)
            snapshot = table.store.read()
            run = table._store_run(table._newest(stored, "generation"), snapshot)
            table.store.commit(replace(snapshot, runs=(*snapshot.runs, (run, run)), next_id=run + 1))
        if table.store.exists(f"{folder.rstrip('/')}/{files.LOG}"):
            table.write_batch(files.read_logs(spark, f"{folder.rstrip('/')}/{files.LOG}"))
        return table

    def _newest(self, points: DataFrame, version: str) -> DataFrame:
        return points.select("timestamp", "value") if self.repeats else lww.newest(points, version)

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        return lww.joined(runs) if self.repeats else lww.merged(runs)

    # Reading

    def _run_path(self, run: int) -> str:
        return f"{self.path}/runs/{run}"

    def _journal(self, snapshot: Snapshot) -> list[str]:
        done = {str(x) for x in snapshot.consumed}
        return sorted((n for n in self.store.names(f"{self.path}/journal") if n not in done and self.store.exists(f"{self.path}/journal/{n}/_SUCCESS")), key=int)

    def pending(self, snapshot: Snapshot | None = None) -> DataFrame:
        """Points not yet flushed, newest per timestamp or all."""
        names = self._journal(snapshot or self.store.read())
        runs = [self.spark.read.schema(POINT_SEQ).parquet(f"{self.path}/journal/{n}") for n in names]
        runs = [self._newest(run, "seq") for run in runs]
        return self._merged(runs) if runs else self.spark.createDataFrame([], POINT)

    def runs(self, snapshot: Snapshot | None = None) -> list[DataFrame]:
        """Live generations, oldest first."""
        snapshot = snapshot or self.store.read()
        return [self.spark.read.schema(POINT).parquet(self._run_path(run)) for run, _ in sorted(snapshot.runs, key=lambda x: (x[1], x[0]))]

    def _all(self) -> DataFrame:
        snapshot = self.store.read()
        return self._merged([*self.runs(snapshot), self.pending(snapshot)])

    def scan_range(self, start: int, end: int) -> DataFrame:
        """Points with start <= timestamp <= end; none if start > end."""
        return lww.between(self._all(), start, end).orderBy(*self.order)

    def scan_all(self) -> DataFrame:
        return self._all().orderBy(*self.order)

    def pending_count(self) -> int:
        return self.pending().count()

    def run_count(self) -> int:
        return len(self.store.read().runs)

    # Writing

    def write_batch(self, points: DataFrame) -> None:
        """Upserts (timestamp, value, seq); a higher seq is newer. Flushes when full."""
        snapshot = self.store.read()
        taken = [int(n) for n in self.store.names(f"{self.path}/journal")]
        batch = max([snapshot.next_batch, *(n + 1 for n in taken)])
        rows = checked(points, "timestamp", "value", "seq")
        rows.write.parquet(f"{self.path}/journal/{batch}")
        if self._full(snapshot, batch):
            self.flush()

    def _fill(self, points: DataFrame) -> int:
        """Points that these writes are: distinct timestamps, or all of them."""
        return points.count() if self.repeats else lww.distinct_count(points, self.capacity, POINT_BYTES).first()["len"]

    def _full(self, snapshot: Snapshot, batch: int) -> bool:
        """Whether the pending points use up the capacity.

        A file ``fill/<batch>.<count>.<kind>`` keeps the points of a batch (``own``) or of all that
        were pending with it (``all``). Their sum is an upper bound, so all pending points are
        counted only when it reaches the capacity."""
        marks = {}
        for name in self.store.names(f"{self.path}/fill"):
            number, count, kind = name.split(".")
            marks[int(number), kind] = int(count)
        names = [int(n) for n in self._journal(snapshot)]
        own = self.spark.read.schema(POINT_SEQ).parquet(f"{self.path}/journal/{batch}")
        marks[batch, "own"] = self._fill(own)
        self.store.touch(f"{self.path}/fill/{batch}.{marks[batch, 'own']}.own")
        whole = max((n for n, kind in marks if kind == "all" and n >= names[0]), default=None)
        bound = (marks[whole, "all"] if whole else 0) + sum(marks.get((n, "own"), self.capacity) for n in names if not whole or n > whole)
        if bound * POINT_BYTES < self.capacity:
            return False
        found = self._fill(self.pending(snapshot))
        self.store.touch(f"{self.path}/fill/{batch}.{found}.all")
        return found * POINT_BYTES >= self.capacity

    def write(self, timestamp: int, value: float) -> None:
        self.write_batch(self.spark.createDataFrame([(timestamp, value, 0)], POINT_SEQ))

    def _store_run(self, points: DataFrame, snapshot: Snapshot) -> int:
        """Writes a sorted run under an id that no live run has."""
        run = snapshot.next_id
        points.repartitionByRange(*self.order).sortWithinPartitions(*self.order).write.mode("overwrite").options(**LAYOUT).parquet(self._run_path(run))
        return run

    def flush(self) -> None:
        """Pending points become a generation: all of them at once, or none."""
        snapshot = self.store.read()
        names = self._journal(snapshot)
        if not names:
            return
        run = self._store_run(self.pending(snapshot), snapshot)
        there = set(self.store.names(f"{self.path}/journal"))
        consumed = (*(n for n in snapshot.consumed if str(n) in there), *map(int, names))
        new = replace(snapshot, runs=(*snapshot.runs, (run, run)), next_id=run + 1, consumed=consumed, next_batch=max(snapshot.next_batch, *consumed) + 1)
        self.store.commit(new)
        for n in consumed:
            self.store.remove(f"{self.path}/journal/{n}")
        for name in self.store.names(f"{self.path}/fill"):
            if int(name.split(".")[0]) in consumed:
                self.store.remove(f"{self.path}/fill/{name}")
        self.settle()

    def add_run(self, points: DataFrame, query: str, batch: int) -> bool:
        """One streaming batch as a generation; False if it is already in the table. A query's batches rise."""
        snapshot = self.store.read()
        done = dict(snapshot.batches)
        if batch <= done.get(query, -1):
            return False
        run = self._store_run(self._newest(points, "seq"), snapshot)
        self.store.commit(replace(snapshot, runs=(*snapshot.runs, (run, run)), next_id=run + 1, batches=tuple((done | {query: batch}).items())))
        self.settle()
        return True

    def settle(self) -> None:
        if self.run_count() >= self.compact_at:
            self.compact()

    def compact(self) -> None:
        """All live runs become one."""
        snapshot = self.store.read()
        if len(snapshot.runs) < 2:
            return
        run = self._store_run(self._merged(self.runs(snapshot)), snapshot)
        rank = max(generation for _, generation in snapshot.runs)
        self.store.commit(replace(snapshot, runs=((run, rank),), next_id=run + 1))
        self.clean()

    def clean(self) -> None:
        """Removes the runs, and the lists, that were replaced more than ``grace`` seconds ago."""
        versions = self.store.versions()
        now = time.time()
        kept = [number for (number, _), (_, replaced) in zip(versions, [*versions[1:], (0, now)], strict=True) if now - replaced < self.grace or number == versions[-1][0]]
        live = {str(x) for number in kept for x in self.store.read(number).names()}
        newest = self.store.read().next_id
        for name in self.store.names(f"{self.path}/runs"):
            if name not in live and int(name) < newest:
                self.store.remove(f"{self.path}/runs/{name}")
        for number, _ in versions:
            if number not in kept:
                self.store.remove(f"{self.path}/manifest/{number}.json")
