"""Feedback state kept up to date from a change stream."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from lectern.operators.feedback import latest_change
from lectern.session import path_exists, remove_path

COLUMNS = ["user_id", "paper_id", "action", "ts", "event_id"]


class FeedbackState:
    """The last change per (user, paper) as a base table and the batches since.

    A batch writes only its own last changes, to a folder named by its number, so its cost
    follows the batch and not the state. Every `merge_every` batches base and batches are
    merged into a new base. A batch that is run again after a failure overwrites its own
    folders with the same rows. Removed rows stay as `none`, so that a late older change
    cannot bring them back. Folders that the base before the newest holds are removed.
    """

    def __init__(self, spark: SparkSession, root: str, changes_schema, merge_every: int = 20):
        self.spark = spark
        self.root = root
        self.merge_every = merge_every
        self.schema = ", ".join(
            f"{name} {changes_schema[name].dataType.simpleString()}" for name in COLUMNS
        )

    def _folder(self, kind: str, number: int) -> str:
        return f"{self.root}/{kind}={number}"

    def _complete(self, kind: str) -> list[int]:
        """Numbers of the folders that were written to the end."""
        if not path_exists(self.spark, self.root):
            return []
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        files = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [entry.getPath().getName() for entry in files.listStatus(path)]
        numbers = [int(n.split("=")[1]) for n in names if n.startswith(f"{kind}=")]
        return sorted(
            n for n in numbers if path_exists(self.spark, f"{self._folder(kind, n)}/_SUCCESS")
        )

    def last_changes(self, upto: int | None = None) -> DataFrame:
        """State after batch `upto`, by default after all batches."""
        known = lambda n: upto is None or n <= upto
        bases = [n for n in self._complete("base") if known(n)]
        newest = bases[-1] if bases else -1
        parts = [self._folder("base", newest)] if bases else []
        parts += [
            self._folder("batch", n) for n in self._complete("batch") if n > newest and known(n)
        ]
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        tables = [self.spark.read.schema(self.schema).parquet(part) for part in parts]
        return latest_change(reduce(DataFrame.union, tables)).select(*COLUMNS)

    def apply(self, batch: DataFrame, number: int) -> None:
        changes = latest_change(batch).select(*COLUMNS)
        changes.write.mode("overwrite").parquet(self._folder("batch", number))
        if (number + 1) % self.merge_every == 0:
            merged = self.last_changes(number)
            if number not in self._complete("base"):
                merged.write.mode("overwrite").parquet(self._folder("base", number))
                self._forget(number)

    def _forget(self, newest: int) -> None:
        """Remove what the base before the newest holds already.

        That base stays, so a reader that began before the newest one was complete still has all
        its folders, and no batch that may be run again is older.
        """
        older = [n for n in self._complete("base") if n < newest]
        if older:
            for kind, upto in (("base", older[-1] - 1), ("batch", older[-1])):
                for n in self._complete(kind):
                    if n <= upto:
                        remove_path(self.spark, self._folder(kind, n))

    def current(self) -> DataFrame:
        return (
            self.last_changes()
            .where(F.col("action") != "none")
            .select("user_id", "paper_id", "action", F.col("ts").alias("created_at"))
        )


def follow_feedback(changes: DataFrame, state: FeedbackState, checkpoint: str):
    return (
        changes.writeStream.foreachBatch(state.apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
