"""Tables that are kept between jobs: rows in buckets by a key, written as versions of which a reader sees whole ones only.

A commit writes new files of the buckets it touches, and then one small manifest that names the files of every bucket; the
manifest's appearance under its number is the switch. A job that ends before it leaves the version before it as it was, and files that
nothing names. Files are never changed, so a reader of an older version isn't disturbed.
"""

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Versioned:
    """tables: name: (DDL, key columns). buckets holds for a new path; a stored one keeps its own number. One writer at a time: of two
    that commit the same version the second is refused."""

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, tuple[str, list[str]]], buckets: int = 64):
        self.spark, self.path, self.tables = spark, path.rstrip("/"), tables
        self.reads: list[tuple[str, list[int]]] = []
        if self.version() == 0:
            self._publish(1, {"buckets": buckets, "files": {}, "done": {}})
        self.buckets = self.manifest()["buckets"]

    def _hadoop(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        where, files = self._hadoop(path)
        return [s.getPath().getName() for s in files.listStatus(where)] if files.exists(where) else []

    def version(self) -> int:
        """The number of the newest version; 0 where there's none."""
        return max((int(n[:-5]) for n in self._names(f"{self.path}/versions") if n.endswith(".json")), default=0)

    def manifest(self) -> dict:
        where, files = self._hadoop(f"{self.path}/versions/{self.version():012}.json")
        stream = files.open(where)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, version: int, manifest: dict) -> None:
        """The manifest is whole before it gets its name, and a name is given once."""
        made, files = self._hadoop(f"{self.path}/versions/_{uuid.uuid4().hex}")
        out = files.create(made, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        name, _ = self._hadoop(f"{self.path}/versions/{version:012}.json")
        jvm = self.spark._jvm.org.apache.hadoop.fs
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm, "Options$Rename"), 0)
        jvm.FileContext.getFileContext(made.toUri() if made.toUri().getScheme() else files.getUri(), self.spark._jsc.hadoopConfiguration()).rename(made, name, none)

    def bucket(self, name: str) -> Column:
        return F.pmod(F.xxhash64(*self.tables[name][1]), F.lit(self.buckets)).cast("int")

    def touched(self, name: str, rows: DataFrame) -> list[int]:
        """The buckets of a table that rows, which have its key columns, fall into: as many numbers at most as there are buckets."""
        return sorted(r[0] for r in rows.select(self.bucket(name)).distinct().collect())

    def read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """The rows of some buckets, or of all, as the newest version has them."""
        held = self.manifest()["files"].get(name, {})
        chosen = range(self.buckets) if buckets is None else buckets
        self.reads.append((name, list(chosen)))
        paths = [f"{self.path}/{name}/{part}/bucket={b}" for b in chosen for part in held.get(str(b), [])]
        schema = self.tables[name][0]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def stage(self, name: str, rows: DataFrame) -> str:
        """Writes rows as files that no version names yet."""
        part = uuid.uuid4().hex
        columns = [c.split()[0] for c in _columns(self.tables[name][0])]
        rows.select(*columns, self.bucket(name).alias("bucket")).repartition("bucket").sortWithinPartitions("bucket", *self.tables[name][1]).write.partitionBy("bucket").parquet(f"{self.path}/{name}/{part}")
        return part

    def commit(self, replaced: dict[str, tuple[str | None, list[int]]], appended: dict[str, str] | None = None, done: tuple[str, int] | None = None) -> int:
        """A new version. replaced: the staged part that holds all rows of these buckets (None: they're empty now). appended: a staged part
        whose rows come to those of its buckets. done: writer and number of the batch that this was."""
        version = self.version()
        now = self.manifest()
        for name, (part, buckets) in replaced.items():
            files, full = now["files"].setdefault(name, {}), self._present(name, part) if part else set()
            files |= {str(b): [part] if str(b) in full else [] for b in buckets}
        for name, part in (appended or {}).items():
            files = now["files"].setdefault(name, {})
            for b in self._present(name, part):
                files[b] = [*files.get(b, []), part]
        if done:
            now["done"][done[0]] = done[1]
        self._publish(version + 1, now)
        return version + 1

    def _present(self, name: str, part: str) -> set[str]:
        return {n.partition("=")[2] for n in self._names(f"{self.path}/{name}/{part}") if n.startswith("bucket=")}

    def done(self, writer: str) -> int:
        """The number of the writer's last batch, -1 if there's none."""
        return self.manifest()["done"].get(writer, -1)

    def clear(self) -> int:
        """A new version without rows; what batches are done stays known."""
        return self.commit({name: (None, list(range(self.buckets))) for name in self.tables})


def _columns(ddl: str) -> list[str]:
    """The columns of a DDL list, whose types may have commas of their own."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(ddl):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(ddl[start:i].strip())
            start = i + 1
    return [*out, ddl[start:].strip()]
