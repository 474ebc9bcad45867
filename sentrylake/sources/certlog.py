"""A data source for landed answers of certificate logs.

spark.read.format("certificate_log").load(path) reads path/term=.../*, text files with a JSON array of certificate records on each line.
"""

import io
import json
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from sentrylake.sources.feeds import HOST

SCHEMA = "term string, certificate string, name string, bad string"
#: Files are read in ranges of so many bytes; a line belongs to the range in which it starts.
RANGE = 64 << 20
BATCH = 8192


@dataclass
class Range(InputPartition):
    path: str
    term: str
    start: int
    end: int


def _names(record: object) -> list[str]:
    own = record if isinstance(record, dict) else {}
    texts = [x for x in (own.get("name_value"), own.get("common_name")) if isinstance(x, str)]
    return list(dict.fromkeys(n.strip() for t in texts for n in t.splitlines() if n.strip()))


def rows_of(term: str, line: str) -> list[tuple[str, str | None, str | None, str | None]]:
    """A line's rows: one for each name of each record, or one that says why there are none."""
    try:
        records = json.loads(line)
    except (ValueError, RecursionError):
        return [(term, None, None, "not_json")]
    if not isinstance(records, list):
        return [(term, None, None, "not_a_list")]
    ids = [str(r["id"]) if isinstance(r, dict) and r.get("id") is not None else None for r in records]
    return [(term, i, n, None) for i, r in zip(ids, records, strict=True) for n in _names(r)]


class Reader(DataSourceReader):
    def __init__(self, uri: str, size: int):
        self.uri, self.size, self.terms = uri, size, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Conditions on the term choose folders; others go back to Spark."""
        for f in filters:
            values = (f.value,) if isinstance(f, EqualTo) else f.value if isinstance(f, In) else None
            if values is not None and f.attribute == ("term",):
                self.terms = set(values) if self.terms is None else self.terms & set(values)
            else:
                yield f

    def partitions(self) -> list[Range]:
        files, root = fs.FileSystem.from_uri(self.uri)
        found = []
        for info in files.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            folder, _, name = info.path.rpartition("/")
            label = folder.rpartition("/")[2]
            if info.type != fs.FileType.File or name.startswith(("_", ".")) or not label.startswith("term="):
                continue
            term = unquote(label[5:])
            if self.terms is None or term in self.terms:
                found += [Range(info.path, term, a, min(a + self.size, info.size)) for a in range(0, info.size, self.size)]
        return found or [Range("", "", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        names, kept = ["term", "certificate", "name", "bad"], []
        for line in self._lines(partition):
            kept += rows_of(partition.term, line)
            if len(kept) >= BATCH:
                yield self._batch(kept, names)
                kept = []
        if kept:
            yield self._batch(kept, names)

    def _batch(self, rows: list[tuple], names: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names)

    def _lines(self, part: Range) -> Iterator[str]:
        if part.start >= part.end:
            return
        files, _ = fs.FileSystem.from_uri(self.uri)
        with io.BufferedReader(files.open_input_file(part.path), 1 << 16) as f:
            at = part.start
            if at:
                f.seek(at - 1)
                at += len(f.readline()) - 1  # the rest of a line that starts before
            while at < part.end:
                raw = f.readline()
                if not raw:
                    return
                at += len(raw)
                if raw.strip():
                    yield raw.decode("utf-8", "replace")


class CertificateLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "certificate_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], int(self.options.get("range", RANGE)))


def read_log(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """(term, certificate, name, bad) of landed answers at a URI; certificates without a number have null, and lines that can't be read a
    row with the reason. A condition on term reads the folders of those terms only."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CertificateLog)
    return spark.read.format("certificate_log").option("range", size).load(path)


def hosts_by_certificate(log: DataFrame) -> DataFrame:
    """(certificate, hosts): the valid host names of each certificate, each once, by code point; other identities are no hosts. A
    certificate holds a hundred names or so."""
    host = F.regexp_replace(F.regexp_replace(F.lower(F.trim("name")), r"^\*\.", ""), r"\.+$", "")
    return log.where("certificate IS NOT NULL").select("certificate", host.alias("host")).where(F.col("host").rlike(HOST)).groupBy("certificate").agg(F.array_sort(F.collect_set("host")).alias("hosts"))
