"""The seen store as runs: a poll reads only the id ranges that its own ids hit.

Each batch adds one run, a folder per range of ids (the first digits of the id, which
is a hash). ``FANOUT`` runs of a level are merged into one of the next level, so a
store of n batches has about FANOUT * log(n) runs. What a batch left is told by
its own commit; a batch that runs again reads the commit before it and writes
the same run and commit anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodgeflow.schema import SEEN
from lodgeflow.sources.tables import exists

FANOUT = 8
DIGITS = 2        # hexadecimal: 256 ranges
COMMIT = "batch_id long, run string, level int"


class SeenStore:
    def __init__(self, spark: SparkSession, path: str, digits: int = DIGITS, fanout: int = FANOUT):
        self.spark, self.path, self.digits, self.fanout = spark, path.rstrip("/"), digits, fanout

    def runs(self, before: int | None = None) -> list[tuple[str, int]]:
        """(run, level) of the last commit before a batch; a few rows."""
        if not exists(self.spark, f"{self.path}/commits"):
            return []
        commits = self.spark.read.schema(COMMIT).json(f"{self.path}/commits")
        if before is not None:
            commits = commits.where(F.col("batch_id") < before)
        last = commits.agg(F.max("batch_id")).first()[0]
        return [] if last is None else [(r.run, r.level) for r in commits.where(F.col("batch_id") == last).orderBy("run").collect() if r.run]

    def _range(self):
        return F.substring("listing_id", 1, self.digits)

    def _read(self, runs: list[str]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], SEEN).withColumn("id_range", self._range())
        frames = [self.spark.read.schema(f"{_ddl()}, id_range string").parquet(f"{self.path}/runs/{r}") for r in runs]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    def rows(self, before: int | None = None, near: DataFrame | None = None) -> DataFrame:
        """Store rows (SEEN), of the ranges that ``near``'s ids fall into if it is given."""
        found = self._read([r for r, _ in self.runs(before)])
        if near is not None:
            hit = [r[0] for r in near.select(self._range()).distinct().collect()]      # at most 16 ** digits
            found = found.where(F.col("id_range").isin(hit)) if hit else found.limit(0)
        return found.drop("id_range")

    def _write(self, rows: DataFrame, run: str) -> None:
        keyed = rows.select(*SEEN.fieldNames()).withColumn("id_range", self._range())
        (keyed.repartition("id_range").sortWithinPartitions("id_range", "listing_id").write.mode("overwrite").partitionBy("id_range")
         .parquet(f"{self.path}/runs/{run}"))

    def append(self, rows: DataFrame, batch_id: int) -> None:
        """Add a batch's rows, merge the runs of full levels, and commit. Doing it again changes nothing."""
        self._write(rows, f"b{batch_id}")
        live = [*self.runs(batch_id), (f"b{batch_id}", 0)]
        level = 0
        while len(full := [r for r, k in live if k == level]) >= self.fanout:
            merged = f"m{batch_id}-{level + 1}"
            self._write(self._read(full).drop("id_range"), merged)
            live = [(r, k) for r, k in live if k != level] + [(merged, level + 1)]
            level += 1
        commit = self.spark.createDataFrame([(batch_id, r, k) for r, k in live], COMMIT).coalesce(1)
        commit.write.mode("overwrite").json(f"{self.path}/commits/batch={batch_id}")

    def tidy(self) -> list[str]:
        """Delete runs and commits that neither of the last two commits names (a batch may still run again); their names."""
        batches = sorted(int(n.split("=")[1]) for n in self._names("commits"))
        kept = {r for b in batches[-2:] for r, _ in self.runs(b + 1)}
        gone = [f"runs/{r}" for r in self._names("runs") if r not in kept] + [f"commits/batch={b}" for b in batches[:-2]]
        fs, hpath = self._fs()
        for name in gone:
            fs.delete(hpath(f"{self.path}/{name}"), True)
        return gone

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        hpath = jvm.org.apache.hadoop.fs.Path
        return hpath(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), hpath

    def _names(self, folder: str) -> list[str]:
        if not exists(self.spark, f"{self.path}/{folder}"):
            return []
        fs, hpath = self._fs()
        return [s.getPath().getName() for s in fs.listStatus(hpath(f"{self.path}/{folder}")) if s.isDirectory()]


def _ddl() -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in SEEN.fields)
