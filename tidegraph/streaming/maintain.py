"""Components kept up by a stream of edge files. Insertion order doesn't matter, so no watermark is needed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegraph.operators.incremental import Changes, State, changes, overlaid
from tidegraph.storage import delete, saved, scratch

EDGES = T.StructType([T.StructField("src", T.LongType()), T.StructField("dst", T.LongType())])
#: Versions of changes after which a whole state is written.
COMPACT = 16
#: Bytes of files that a micro-batch takes. Each goes over the state's tables, so many small files are taken together.
BATCH_BYTES = 64 << 20
#: Tables of a version, with their keys and the rows that stay.
TABLES = {"members": (["id"], "true"), "order": (["component"], "rank is not null"), "edges": (["src", "dst"], "not gone"), "parts": (["id"], "true")}


class Maintained:
    """State by version, in a folder that all machines share: a whole state now and then, and what each micro-batch changed since.

    Version -1 is the starting graph. A version counts once the file that says so is there, which is written last. Every
    micro-batch goes on from the newest and writes changed rows only; of a key, a reader takes the newest version. After
    COMPACT versions a whole state is written, and what lies before the whole state before it is deleted, so a reader
    keeps what it has in hand. Inserting edges twice changes nothing, so a repeated micro-batch does no harm. A folder
    that holds versions is taken up.
    """

    def __init__(self, spark: SparkSession, folder: str, state: State):
        self.spark, self.folder = spark, folder.rstrip("/")
        done = self.versions()
        if done:
            self.version = done[-1]
        else:
            self.version = -1
            self._write(state, -1)

    def _hadoop(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _exists(self, path: str) -> bool:
        files, at = self._hadoop(path)
        return files.exists(at)

    def _path(self, version: int) -> str:
        return f"{self.folder}/v={version}"

    def versions(self, whole: bool = False) -> list[int]:
        """The complete versions that are there, or those of them that are whole states."""
        files, at = self._hadoop(self.folder)
        if not files.exists(at):
            return []
        names = [str(x.getPath().getName()) for x in files.listStatus(at)]  # a few times COMPACT
        numbers = sorted(int(n.removeprefix("v=")) for n in names if n.startswith("v="))
        mark = "whole" if whole else "complete"
        return [n for n in numbers if self._exists(f"{self._path(n)}/complete") and self._exists(f"{self._path(n)}/{mark}")]

    def _write(self, rows: State | Changes, version: int) -> None:
        path = self._path(version)
        delete(self.spark, f"{path}/complete")
        delete(self.spark, path)
        for name in TABLES:
            df = getattr(rows, name)
            if df is not None:
                df.write.parquet(f"{path}/{name}")
        for mark in (["whole"] if isinstance(rows, State) else []) + ["complete"]:
            files, at = self._hadoop(f"{path}/{mark}")
            files.create(at).close()

    def _state(self, version: int, newest_of: Callable[[DataFrame], DataFrame] = lambda df: df) -> State:
        """The state of a version; newest_of may save what changed since the whole state before it."""
        base = max(v for v in self.versions(whole=True) if v <= version)
        later = [v for v in self.versions() if base < v <= version]
        tables = {}
        for name, (keys, stays) in TABLES.items():
            if not self._exists(f"{self._path(base)}/{name}"):
                continue
            df = self.spark.read.parquet(f"{self._path(base)}/{name}")
            changed = None
            for v in later:
                more = self.spark.read.parquet(f"{self._path(v)}/{name}").withColumn("version", F.lit(v))
                changed = more if changed is None else changed.unionByName(more)
            if changed is not None:
                rest = [c for c in changed.columns if c not in (*keys, "version")]
                newest = changed.groupBy(*keys).agg(F.max_by(F.struct(*rest), "version").alias("row")).select(*keys, "row.*")
                df = overlaid(df, newest_of(newest), keys, stays)
            tables[name] = df
        return State(**tables)

    def state(self) -> State:
        return self._state(self.version)

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        with scratch(self.spark):  # what is saved on the way goes once the version is written
            new, _ = changes(self._state(self.version, saved), batch.select("src", "dst").filter("src <> dst"))
            self._write(new, self.version + 1)
            self.version += 1
            whole = self.versions(whole=True)
            if self.version - whole[-1] < COMPACT:
                return
            self._write(self._state(self.version, saved), self.version + 1)
            self.version += 1
        for old in self.versions():
            if old < whole[-1]:
                delete(self.spark, self._path(old))


def follow(spark: SparkSession, edges: str, folder: str, state: State, *, files_per_batch: int | None = None) -> Maintained:
    """Insert all edges (src, dst) of the Parquet files in a folder, as a stream, and return what is maintained. A micro-batch takes so many files, or as many as BATCH_BYTES hold, one at least. state: the starting graph, which counts only where the folder holds no version yet."""
    kept = Maintained(spark, f"{folder}/state", state)
    limit = ("maxBytesPerTrigger", BATCH_BYTES) if files_per_batch is None else ("maxFilesPerTrigger", files_per_batch)
    stream = spark.readStream.schema(EDGES).option(*limit).parquet(edges)
    query = stream.writeStream.foreachBatch(kept.apply).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return kept
