"""WARC archives of captures, and their index as histories in one global order.

Archives are written by tasks into a shared folder, record after record, and read back by the records' own lengths. Reading gives
narrow index entries. Each task's entries are sorted where they are (a run, written as a table); sampled bounds cut every run into
ranges of the global order, so that a URL with very many captures is cut by its times; and one task merges the pieces of a range, one from
each run, by a tree of losers. Only index entries are exchanged; payloads stay in the archives.
"""

import base64
import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrylake.llm.work import ship
from sentrylake.work import drop, new_path, written

#: Bytes after which a task hands on the records it has, and how often it does so for one archive; an archive is exceeded by one
#: record at most.
HANDED_BYTES, HANDED = 8 << 20, 4
#: Entries that a range should hold, the least number of ranges, and sampled entries for each.
RANGE_ROWS, LEAST_RANGES, SAMPLED = 1 << 16, 64, 8

VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"
ENTRY = "record string, url string, captured string, record_type string, refers_to string, payload_digest string, payload_bytes long, file string, offset long, length long, url_key string"
#: What entries are in order of; file and offset part those that are alike otherwise.
ORDER = ["url_key", "captured", "record", "file", "offset"]
_PARTS = re.compile(r"^(?:[a-z][a-z0-9+.\-]*://)?(?:[^/?#]*@)?(?:www\.)?([^/?#]*)([^#]*)", re.S)
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str | None) -> str:
    """The URL in lower case with its host's labels turned round, so that a site's captures stand together; without scheme, user,
    www and fragment. Null is empty."""
    host, rest = _PARTS.match((url or "").lower()).groups()
    return ",".join(reversed(host.split("."))) + ")" + rest


def _urn(record: str | None) -> str:
    return "<urn:page>" if record is None else f"<urn:page:{quote(record, safe='')}>"


def _of_urn(urn: str | None) -> str | None:
    return None if urn in (None, "<urn:page>") else unquote(urn[len("<urn:page:") : -1])


def record(name: str | None, url: str | None, captured: str | None, digest: str, size: int, payload: bytes | None, refers: str | None) -> bytes:
    """A response, or, where there's no payload, a revisit of the record refers, without the end that parts records. Control characters and spaces of
    a URL are written percent-encoded."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}{END}".encode()
    head = [("WARC-Type", "revisit" if payload is None else "response"), ("WARC-Record-ID", _urn(name))]
    head += [(k, v) for k, v in (("WARC-Date", captured), ("WARC-Target-URI", None if url is None else _UNSAFE.sub(lambda m: quote(m[0]), url))) if v is not None]
    head += [("WARC-Payload-Digest", f"sha1:{digest}")]
    if payload is None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn(refers))]
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(http) + len(payload or b"")))]
    return VERSION + "".join(f"\r\n{k}: {v}" for k, v in head).encode("utf-8", "replace") + END.encode() + http + (payload or b"")


def records(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, block) of each record of an archive, found by the lengths that records state."""
    at, end = 0, END.encode()
    while at < len(data):
        body = data.find(end, at) + 4
        lines = data[at : body - 4].decode("utf-8").split("\r\n")
        head = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        size = int(head.get("Content-Length", -1))
        if lines[0].encode() != VERSION or body < 4 or size < 0 or data[body + size : body + size + 4] != end:
            raise ValueError(f"no whole record at {at}")
        yield at, body + size + 4 - at, head, data[body : body + size]
        at = body + size + 4


def write_archives(pages: DataFrame, path: str, captured: Column, record_id: str = "page_id", url: str = "url", payload: str = "html", least: int = 0) -> None:
    """One record for each row. Of rows whose payloads of at least so many bytes are equal, the one with the smallest id is a
    response and the others revisit it; smaller payloads are all responses.

    A null payload is an empty one. A null id is written as none, and its row is a response only where no row of its group has
    an id; rows that repeat the smallest id are responses all. Null URLs and times are left out of the record. Other columns aren't
    read. No rows, no records. Which payloads occur twice is found by their digests, pre-aggregated, in a narrow table; as
    long as Spark finds that one small, payloads aren't exchanged at all, and else by a join that it splits where a digest is hot.
    """
    ship(pages.sparkSession)
    body = F.coalesce(pages[payload].cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(pages[record_id].alias("id"), pages[url].cast("string").alias("url"), F.date_format(captured, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("captured"), body.alias("payload"))
    rows = rows.withColumns({"size": F.octet_length("payload").cast("long"), "sha1": F.sha1("payload")})
    twice = rows.where(F.col("size") >= least).groupBy("sha1").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    twice = written(twice.select("sha1", "first", F.lit(True).alias("again")), "twice")
    again = F.coalesce("again", F.lit(False)) & (F.col("size") >= least) & ~F.col("id").eqNullSafe(F.col("first"))
    told = rows.join(twice, "sha1", "left").withColumn("revisit", again)
    told = told.select(F.col("id").cast("string"), "url", "captured", "sha1", "size", F.when(~F.col("revisit"), F.col("payload")).alias("payload"), F.when(F.col("revisit"), F.col("first").cast("string")).alias("refers"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for name, link, time, sha1, n, text, refers in zip(*(batch.column(i) for i in range(7)), strict=True):
                digest = base64.b32encode(bytes.fromhex(sha1.as_py())).decode()
                held.append(record(name.as_py(), link.as_py(), time.as_py(), digest, n.as_py(), text.as_py(), refers.as_py()))
                size += len(held[-1])
                if size >= HANDED_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([END.encode().join(held)], pa.binary())], ["records"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([END.encode().join(held)], pa.binary())], ["records"])

    # the text writer puts each row's bytes down as they are, and the end of a record after them
    made = told.mapInArrow(run, "records binary").select(F.col("records").cast("string"))
    made.write.option("lineSep", END).option("maxRecordsPerFile", HANDED).text(path)
    drop(twice)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """An index entry for each record of the archives at path. Digest and size of a response are those of the payload as it is
    read; a response whose payload has another digest than it states ends the job, as a record without its whole length does."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                for offset, length, head, block in records(data.as_py()):
                    http, _, payload = block.partition(END.encode())
                    size, digest = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1]), head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if head["WARC-Type"] == "response" and (len(payload) != size or base32_sha1(payload) != digest):
                        raise ValueError(f"{name}: the payload at {offset} isn't what its record states")
                    link = head.get("WARC-Target-URI")
                    rows.append((_of_urn(head["WARC-Record-ID"]), link, head.get("WARC-Date"), head["WARC-Type"], _of_urn(head.get("WARC-Refers-To")), digest, size, name, offset, length, url_key(link)))
                columns = list(zip(*rows, strict=True)) or [[]] * 11
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, _TYPES, strict=True)], _NAMES)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path)
    return files.select(F.substring_index("path", "/", -1), "content").mapInArrow(run, ENTRY)


_NAMES = [x.split()[0] for x in ENTRY.split(", ")]
_TYPES = [pa.int64() if x.endswith(" long") else pa.string() for x in ENTRY.split(", ")]


def sorted_runs(entries: DataFrame) -> DataFrame:
    """The entries as a written table in which each task's are in order; place has the task and the row's place there."""
    held = entries.withColumns({c: F.coalesce(c, F.lit("")) for c in ORDER[:2]}).withColumn("has_record", F.col("record").isNotNull()).withColumn("record", F.coalesce("record", F.lit("")))
    return written(held.sortWithinPartitions(*ORDER).withColumn("place", F.monotonically_increasing_id()), "runs")


def losers(runs: Sequence[Sequence[tuple]]) -> Iterator[tuple[int, int]]:
    """(run, place) of all items of the sorted runs, smallest first. Each inner node of the tree keeps the loser of its match, so
    an item costs one match a level on its way up."""
    k = len(runs)
    at, heads = [0] * k, [run[0] if run else None for run in runs]

    def beats(a: int, b: int) -> bool:
        return heads[a] is not None and (heads[b] is None or heads[a] < heads[b])

    best, lost = [0] * k + list(range(k)), [0] * k
    for node in range(k - 1, 0, -1):
        a, b = best[2 * node], best[2 * node + 1]
        best[node], lost[node] = (b, a) if beats(b, a) else (a, b)
    top = best[1] if k else 0
    while k and heads[top] is not None:
        yield top, at[top]
        at[top] += 1
        heads[top] = runs[top][at[top]] if at[top] < len(runs[top]) else None
        node = (top + k) // 2
        while node:
            if beats(lost[node], top):
                lost[node], top = top, lost[node]
            node //= 2


def _keys(rows: pa.RecordBatch | pa.StructArray, field) -> list[tuple]:
    return list(zip(*(field(rows, c).to_pylist() for c in ORDER), strict=True))


def _bounds(runs: DataFrame, n: int) -> list[tuple]:
    """Keys that part all entries into ranges of about RANGE_ROWS. The driver gets one entry of RANGE_ROWS / SAMPLED."""
    ranges = max(LEAST_RANGES, -(-n // RANGE_ROWS))
    some = runs.where(F.pmod(F.xxhash64("place"), F.lit(max(1, n // (ranges * SAMPLED)))) == 0).select(*ORDER)
    keys = sorted(map(tuple, some.collect()))
    return sorted({keys[len(keys) * k // ranges] for k in range(1, ranges)}) if keys else []


def merged(runs: DataFrame) -> DataFrame:
    """All entries of sorted_runs with position, their place in the one global order of url_key, time and id (from 0), and nth,
    their place in the URL's history (from 1). Whatever the runs, equal entries get equal answers; those that agree in all three
    are in order of archive and offset.

    A range is merged in one task; a URL of very many captures covers many ranges. What the driver gets is a row for each range."""
    spark = runs.sparkSession
    bounds = spark.sparkContext.broadcast(_bounds(runs, runs.count()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column("place").to_pylist()
            keys, i, edges, where = _keys(batch, lambda b, c: b.column(c)), 0, [0], []
            while i < len(place):
                last = bisect_left(place, ((place[i] >> 33) + 1) << 33, i)  # of the run
                there = bisect_right(bounds.value, keys[i])
                j = bisect_left(keys, bounds.value[there], i, last) if there < len(bounds.value) else last
                where.append((there, place[i] >> 33, place[i]))
                edges.append(j)
                i = j
            if where:
                lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.StructArray.from_arrays(batch.columns, batch.schema.names))
                yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in zip(*where, strict=True)), lists], ["range", "run", "first", "entries"])

    kept = f"{ENTRY}, has_record boolean"
    struct = runs.schema.simpleString()
    blocks = runs.mapInArrow(cut, f"range long, run long, first long, entries array<{struct}>")

    def ordered(name: int, pieces: dict[int, list[pa.StructArray]]) -> pa.RecordBatch:
        own = {run: pa.concat_arrays(x) for run, x in pieces.items()}
        keys = [_keys(x, lambda s, c: s.field(c)) for x in own.values()]
        starts = [0]
        for x in keys:
            starts.append(starts[-1] + len(x))
        order = [starts[run] + k for run, k in losers(keys)]
        rows = pa.concat_arrays(list(own.values())).take(pa.array(order))
        nth, before, count = [], None, 0
        for key in rows.field("url_key").to_pylist():
            count = count + 1 if key == before else 1
            before = key
            nth.append(count)
        names = [*_NAMES, "has_record"]
        return pa.RecordBatch.from_arrays([*(rows.field(c) for c in names), pa.array([name] * len(order)), pa.array(range(len(order))), pa.array(nth)], [*names, "range", "at", "nth"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pieces = None, {}
        for batch in batches:
            lists = batch.column("entries")
            for k, (name, run) in enumerate(zip(batch.column("range").to_pylist(), batch.column("run").to_pylist(), strict=True)):
                if name != now and pieces:
                    yield ordered(now, pieces)
                    pieces = {}
                now = name
                pieces.setdefault(run, []).append(lists[k].values)
        if pieces:
            yield ordered(now, pieces)

    dealt = blocks.repartition("range").sortWithinPartitions("range", "run", "first")
    found = written(dealt.mapInArrow(merge, f"{kept}, range long, at long, nth long"), "histories")
    ends = [F.struct("at", "url_key").alias("x"), F.struct("at", "url_key", "nth").alias("y")]
    told = found.select("range", *ends).groupBy("range").agg(F.count("*").alias("n"), F.min("x.url_key").alias("low"), F.max("y").alias("last")).orderBy("range").collect()
    starts, start, key, count = [], 0, None, 0
    for r in told:
        carried = count if r["low"] == key else 0
        starts.append((r["range"], start, r["low"], carried))
        start += r["n"]
        key, count = r["last"]["url_key"], r["last"]["nth"] + (carried if r["last"]["url_key"] == r["low"] else 0)
    at = spark.createDataFrame(starts, "range long, start long, low string, carried long")
    whole = found.join(at, "range")
    nth = F.col("nth") + F.when(F.col("url_key") == F.col("low"), F.col("carried")).otherwise(0)
    return whole.select(F.when(F.col("has_record"), F.col("record")).alias("record"), *(c for c in _NAMES if c != "record"), nth.alias("nth"), (F.col("start") + F.col("at")).alias("position"))


def archived(pages: DataFrame, captured: Column, record_id: str = "page_id", url: str = "url", payload: str = "html", least: int = 0) -> tuple[str, DataFrame]:
    """A folder of archives of all rows, and the sorted runs of what was read back from them."""
    path = new_path(pages.sparkSession, "archives")
    write_archives(pages, path, captured, record_id, url, payload, least)
    return path, sorted_runs(read_archives(pages.sparkSession, path))
