"""A queue of steps for directories, as a run log that survives a restart, over Spark job groups.

Items run one after another in the driver; each item's steps share a job group, so that killing an
item cancels its Spark jobs.  The log is a folder of Parquet files that is only appended to; the state
of an item is its last row.
"""

from __future__ import annotations

import threading
import uuid
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "item string, directory string, status string, step string, error string, at timestamp"
Step = tuple[str, Callable[[SparkSession, str], None]]


#: lines that are kept of an item, and items whose lines are kept
LINES, KEPT = 2_000, 100


@dataclass
class Queue:
    spark: SparkSession
    log_path: str
    steps: list[Step]
    stopping: threading.Event = field(default_factory=threading.Event)
    lines: dict[str, deque] = field(default_factory=dict)

    def say(self, item: str, line: str) -> None:
        """Keep a line of an item's output; the oldest item's lines go beyond KEPT items."""
        if item not in self.lines and len(self.lines) >= KEPT:
            del self.lines[next(iter(self.lines))]
        self.lines.setdefault(item, deque(maxlen=LINES)).append(line)

    def registry(self, n: int = 50) -> DataFrame:
        """The last n items, the newest first."""
        return self.items().orderBy(F.col("added").desc(), "item").limit(n)

    def _log(self, item: str, directory: str, status: str, step: str = "", error: str = "") -> None:
        row = (item, directory, status, step, error, datetime.now(timezone.utc).replace(tzinfo=None))
        self.spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").parquet(self.log_path)

    def items(self) -> DataFrame:
        """The last row of every item, the oldest item first; an empty table before the first."""
        try:
            log = self.spark.read.schema(SCHEMA).parquet(self.log_path)
        except Exception as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return self.spark.createDataFrame([], SCHEMA)
        w = Window.partitionBy("item")
        last = log.withColumn("_n", F.row_number().over(w.orderBy(F.col("at").desc()))).withColumn("added", F.min("at").over(w))
        return last.where("_n = 1").drop("_n").orderBy("added")

    def add(self, directory: str) -> str | None:
        """Queue a directory unless it waits or runs already."""
        if self.items().where((F.col("directory") == directory) & F.col("status").isin("waiting", "running")).limit(1).count():
            return None
        item = uuid.uuid4().hex
        self._log(item, directory, "waiting")
        return item

    def remove(self, directory: str) -> None:
        for r in self.items().where((F.col("directory") == directory) & (F.col("status") == "waiting")).toLocalIterator():
            self._log(r["item"], directory, "removed")

    def recover(self) -> None:
        """Items that a lost driver left running wait again."""
        for r in self.items().where("status = 'running'").toLocalIterator():
            self._log(r["item"], r["directory"], "waiting")

    def stop(self) -> None:
        """Finish the running item and start no other."""
        self.stopping.set()

    def kill(self, item: str) -> None:
        self.spark.sparkContext.cancelJobGroup(item)

    def run(self) -> None:
        """All waiting items in order; a failing step fails its item and the queue goes on."""
        self.stopping.clear()
        while not self.stopping.is_set():
            waiting = self.items().where("status = 'waiting'").limit(1).collect()
            if not waiting:
                return
            item, directory = waiting[0]["item"], waiting[0]["directory"]
            self.spark.sparkContext.setJobGroup(item, f"{directory}", True)
            step = ""
            try:
                for step, work in self.steps:
                    self._log(item, directory, "running", step)
                    self.say(item, f"{step} of {directory} begins")
                    work(self.spark, directory)
                self._log(item, directory, "done")
                self.say(item, f"{directory} is done")
            except Exception as failure:
                self.say(item, f"{step} of {directory} failed: {failure}"[:2000])
                self._log(item, directory, "failed", step, str(failure)[:2000])
            finally:
                self.spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
