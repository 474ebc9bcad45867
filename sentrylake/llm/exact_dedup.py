"""Exact de-duplication against a persistent digest index, bucketed and sorted by digest."""

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrylake.work import drop_path, exists, new_path, written

#: From this share of a batch's rows, and this many of them, a digest counts as hot; so there are at most 10,000 hot ones.
HOT_SHARE, HOT_ROWS = 1e-4, 1000
#: Digests that a bucket of a new index should hold, and the least number of buckets.
BUCKET_ROWS, LEAST_BUCKETS = 1 << 22, 64


def digest(text: Column) -> Column:
    """SHA-256 of the text with each run of white space as one space; null counts as empty."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "), 256)


def buckets_for(rows: int) -> int:
    return max(LEAST_BUCKETS, 1 << max(0, (rows - 1) // BUCKET_ROWS).bit_length())


class DigestIndex:
    """Digests seen so far, as a table of (digest, keep_id, group_size, batch) in buckets sorted by digest.

    The table lies at a path of a shared file system and outlives the session. New rows meet it by a sort-merge join that
    shuffles only the new side, since the index is in its buckets already; unseen digests are appended to the same buckets.
    Rows of the index are never rewritten: keep_id and group_size are those of the batch that brought the text in. One batch is
    added at a time. Adding a batch again adds only what the first attempt left out, so a job that failed may run again.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = LEAST_BUCKETS, id_type: str = "BIGINT"):
        """buckets and id_type are those of a new index. A stored one keeps its own, whatever is given: they lie beside its rows, so
        another catalogue reads the same buckets. A path that has rows but doesn't say in how many buckets is refused."""
        self.spark, self.path = spark, (path or new_path(spark, "digests")).rstrip("/")
        self.buckets, self.id_type = self._laid_out(buckets, id_type)
        self.table = f"digest_index_{hashlib.md5(self.path.encode()).hexdigest()}"
        if not spark.catalog.tableExists(self.table):
            spark.sql(f"CREATE TABLE {self.table} (digest STRING, keep_id {self.id_type}, group_size BIGINT, batch STRING) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'")

    def _laid_out(self, buckets: int, id_type: str) -> tuple[int, str]:
        layout = f"{self.path}/_layout"  # readers of the table pass over names with an underscore
        if exists(self.spark, f"{layout}/_SUCCESS"):
            held = self.spark.read.schema("buckets INT, id_type STRING").json(layout).first()
            return held["buckets"], held["id_type"]
        if exists(self.spark, f"{self.path}/_SUCCESS"):
            raise ValueError(f"{self.path} has rows, but not the number of their buckets")
        self.spark.createDataFrame([(buckets, id_type)], "buckets INT, id_type STRING").coalesce(1).write.mode("overwrite").json(layout)
        return buckets, id_type

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def met(self, groups: DataFrame, batch: str) -> DataFrame:
        """Of (digest, keep_id, group_size) of a batch: how older batches and this one settle them. known: an older batch has the
        digest, and keep_id and group_size are its own. held: an earlier attempt at this batch has added it."""
        seen = self.rows().select("digest", F.struct("keep_id", "group_size", "batch").alias("seen"))
        both = groups.hint("merge").join(seen, "digest", "left")
        known = F.col("seen").isNotNull() & (F.col("seen.batch") != batch)
        return both.select("digest", *(F.when(known, F.col(f"seen.{x}")).otherwise(F.col(x)).alias(x) for x in ("keep_id", "group_size")), F.col("group_size").alias("here"), known.alias("known"), F.col("seen").isNotNull().alias("held"))

    def append(self, fresh: DataFrame, batch: str) -> None:
        rows = fresh.select("digest", "keep_id", "group_size", F.lit(batch).alias("batch"))
        rows.repartition(self.buckets, "digest").write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.path).saveAsTable(self.table)

    def drop(self) -> None:
        """Forgets the index and deletes its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        drop_path(self.spark, self.path)


def batch_name(digests: DataFrame) -> str:
    """The name of a batch that has none: equal for equal rows, whatever their order."""
    r = digests.agg(F.count("*").alias("n"), F.sum(F.xxhash64("doc_id", "digest").cast("decimal(38,0)")).alias("h")).first()
    return f"{r['n']}-{r['h'] or 0}"


def hot_rows(groups: DataFrame, least: float) -> DataFrame:
    """The groups of at least so many rows of this batch, whatever older batches had."""
    return groups.where(F.col("here") >= least)


def deduplicate(docs: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, known.

    A text that an older batch of the index held keeps none of these rows (known is true; keep_id and group_size are the older
    batch's); of other equal texts the row with the smallest doc_id stays, and the digest joins the index. A null text counts as
    empty; rows with a null doc_id take part, and stay only where no row of the group has an id. Rows that repeat a kept doc_id
    and text are kept as well: nothing tells them apart. Ids are cast to the index's type. Other columns are not looked at. No
    rows in, no rows out.

    batch names these rows; without it they're named by what they hold. The same batch again gives the same answer, whether or
    not an earlier attempt reached the index: a batch isn't held against itself, and the answer is settled, in a written table,
    before anything is appended.

    The text is read once, into a narrow table of ids and digests. Groups are pre-aggregated before their shuffle. Digests
    that very many rows of this batch have, at most 10,000 by their definition, are joined by broadcast, all others by sort-merge.
    """
    digests = written(docs.select(F.col("doc_id").cast(index.id_type), digest(F.col("text")).alias("digest")), "docdigests")
    rows, batch = digests.count(), batch or batch_name(digests)
    groups = digests.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    settled = written(index.met(groups, batch), "settled")
    index.append(settled.where("NOT held"), batch)
    least = max(HOT_ROWS, rows * HOT_SHARE)
    hot = F.broadcast(hot_rows(settled, least).withColumn("hot", F.lit(True)))
    tagged = digests.join(hot, "digest", "left")
    rare = tagged.where("hot is null").select("digest", "doc_id").hint("merge").join(settled.where(F.col("here") < least), "digest")
    names = ["digest", "doc_id", "keep_id", "group_size", "known"]
    named = tagged.where("hot").select(*names).unionByName(rare.select(*names))
    return named.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & ~F.col("known")).alias("kept"), F.col("digest").alias("text_sha256"), "known")
