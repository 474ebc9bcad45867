"""N-gram Jaccard join by parity sketches: documents whose sets of five-word shingles have a Jaccard index of 3/4 or more.

Sketch. Each shingle flips one bit of a bit vector: one bit of one of k segments. Two sketches differ in at most as many bits
as the sets' symmetric difference, which is at most (a + b) / 7 for linked sets of a and b shingles; call that d. So at least
k - d of the k segments are equal. Segments are very wide and hence sparse: only the set bits exist, and a segment is known by
the XOR of random keys of its set bits.

Size bands. Band i holds sets of 2**i to 2**(i+1) - 1 shingles, and has k = 2**i segments (many more for small sets, where
each shingle is a segment of its own). A set that could link to one of the next band has a sketch there too.

Pigeonhole join. All segments have one global order: more set bits first, then by key. Of k - d equal segments, the first
d + 1 + l of each of the two sketches share 1 + l at least. Those are what a document emits; the join groups them by key. Keys
of more than HOT documents are hot and make no pairs. So two linked documents, of which the one has h hot keys and the other
no fewer, meet in 1 + l - h other keys or more, and pairs that meet in fewer are passed over. Pairs are lost only where both
have more than l hot keys. Such crowded documents are first compared to the least edited member of each hot group that they share several
keys with, which joins up families of near copies; those in hot groups that still span components emit all their shingles one
by one, and what is left after that, documents nearly all of whose shingles are in many others, meets other components in the
rarest of its hot keys, by the bounds of prefix filters.

Every candidate is held against the sketches in short form first: parity sketches of SKETCH_BITS bits, whose Hamming distance can't
exceed the sets' symmetric difference, so that pairs that differ in more bits than linked sets may differ in shingles go before
any text is fetched. What is left is verified on the sets themselves. Shingles are 52-bit hashes there: for two documents of a thousand
shingles the chance that any two of them collide is below one in a billion.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sentrylake.llm import tokens
from sentrylake.operators.components import components
from sentrylake.llm.work import ship
from sentrylake.work import drop, written

WIDTH = 5
#: Documents that share one key, above which the key makes no pairs.
HOT = 20
#: Bits of the short sketch that candidates are compared by.
SKETCH_BITS = 1024
#: One in so many texts, by their hash, is looked at to find the keys that most documents have; such keys, of at least this share of
#: the sampled rows (so 100,000 of them at most), are dealt in parts. Which way a key is dealt changes no result.
SAMPLED, HEAVY_SHARE, HEAVY_ROWS, PARTS = 64, 1e-5, 8, 64
#: Tasks that the rows of a hot key are dealt to where each of them needs one row of the key's own.
DEALT = 16
#: Parts that the sets of a component are dealt to, by their hash.
SPREAD = 1024
#: Hot keys that a document must share with a group's first member to be compared to it straight away.
ALIKE = 4


def _sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document (up to 4096 of them) and 52-bit hash of each distinct shingle, sorted."""
    doc, word = tokens.words(data, offsets)
    doc, shingle = tokens.shingles(doc, word, len(offsets) - 1, WIDTH)
    both = np.sort((doc.astype(np.uint64) << np.uint64(52)) | (shingle >> np.uint64(12)))
    both = both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both
    return (both >> np.uint64(52)).astype(np.int64), both & np.uint64((1 << 52) - 1)


def _set_keys(doc: np.ndarray, shingle: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and 63-bit key of each document's set."""
    n = np.bincount(doc, minlength=docs)
    total = np.zeros(len(doc) + 1, np.uint64)
    np.cumsum(tokens.mixed(shingle + np.uint64(0x51ED270B)), out=total[1:])
    ends = np.cumsum(n)
    key = tokens.mixed(total[ends] - total[ends - n] + n.astype(np.uint64))
    return n, (key >> np.uint64(1)).astype(np.int64)


def band_segments(band: np.ndarray) -> np.ndarray:
    return np.where(band < 6, 1 << 30, np.left_shift(1, np.minimum(band, 40)))


def spare(band: np.ndarray) -> np.ndarray:
    """l: keys that a document of the band emits beyond d + 1."""
    return 2 + np.left_shift(1, np.minimum(band, 40)) // 14


def _emitted(doc: np.ndarray, shingle: np.ndarray, docs: int, single: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document and key of each emitted segment; document, d and number of keys of each sketch. single: one segment for
    each shingle, and all of them."""
    n = np.bincount(doc, minlength=docs)
    if single:
        key = tokens.mixed(shingle ^ np.uint64(0x6A09E667F3BCC909))
        return doc, (key >> np.uint64(1)).astype(np.int64), np.arange(docs), (n + (4 * n) // 3) // 7, n
    own = np.where(n > 0, np.int64(np.floor(np.log2(np.maximum(n, 1)))), -1)
    own -= (n > 0) & (np.left_shift(1, np.maximum(own, 0)) > n)
    largest = 4 * n // 3
    outs = []
    for step in (0, 1):
        band = own + step
        top = np.left_shift(2, np.maximum(band, 0)) - 1
        takes = (n > 0) & (largest >= np.left_shift(1, np.maximum(band, 0)))
        d = (n + np.minimum(largest, top)) // 7
        pick = takes[doc]
        at, what = doc[pick], shingle[pick]
        k = band_segments(np.maximum(band, 0)).astype(np.uint64)[at]
        h = tokens.mixed(what + np.uint64(0x9216D5D98979FB1B) * (band[at].astype(np.uint64) + np.uint64(3)))
        segment = (h >> np.where(k <= 1 << 20, 44, 24).astype(np.uint64)) % k
        bit = tokens.mixed(h ^ (segment << np.uint64(32)))
        group = (at.astype(np.uint64) << np.uint64(40)) | segment
        order = np.argsort(group, kind="stable")
        group, bit = group[order], bit[order]
        heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
        word = np.bitwise_xor.reduceat(bit, heads) if len(heads) else np.zeros(0, np.uint64)
        bits = np.diff(np.append(heads, len(group)))
        where = (group[heads] >> np.uint64(40)).astype(np.int64)
        key = tokens.mixed(word + tokens.mixed(group[heads] & np.uint64((1 << 40) - 1)) + band[where].astype(np.uint64)) >> np.uint64(1)
        rank = np.lexsort((key, -bits, where))
        where, key = where[rank], key[rank]
        count = np.bincount(where, minlength=docs)
        nth = np.arange(len(where)) - (np.cumsum(count) - count)[where]
        l = spare(np.maximum(band, 0))
        kept = nth < (d + 1 + l)[where]
        outs.append((where[kept], key[kept].astype(np.int64), np.flatnonzero(takes), d[takes], np.minimum(count, d + 1 + l)[takes]))
    return tuple(np.concatenate(x) for x in zip(*outs, strict=True))


def _doc_sets(docs: DataFrame) -> DataFrame:
    """doc_id, mark (a hash of the text), n_shingles, set_key (null for an empty set) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in tokens.chunks(batch.column(2)):
                n, key = _set_keys(*_sets(data, offsets), j - i)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in (0, 1)), pa.array(n), pa.array(key, mask=n == 0)], ["doc_id", "mark", "n_shingles", "set_key"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("mark"), "text").mapInArrow(run, f"doc_id {kind}, mark long, n_shingles long, set_key long")


def _once(own: np.ndarray, seen: set) -> np.ndarray:
    """Which rows hold a set that this task hasn't met; so copies leave a task once."""
    fresh = np.zeros(len(own), bool)
    for i, key in enumerate(own.tolist()):
        if key not in seen:
            seen.add(key)
            fresh[i] = True
    return fresh


def _only(doc: np.ndarray, shingle: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    picked = keep[doc]
    return doc[picked], shingle[picked]


def _keys(texts: DataFrame, single: bool) -> DataFrame:
    """seg, set_key for each emitted segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            for i, j, data, offsets in tokens.chunks(batch.column(0)):
                doc, shingle = _sets(data, offsets)
                _, own = _set_keys(doc, shingle, j - i)
                doc, shingle = _only(doc, shingle, _once(own, seen))
                at, seg, *_ = _emitted(doc, shingle, j - i, single)
                yield pa.RecordBatch.from_arrays([pa.array(seg), pa.array(own[at])], ["seg", "set_key"])

    return texts.select("text").mapInArrow(run, "seg long, set_key long")


def _heavy(texts: DataFrame, single: bool) -> DataFrame:
    """seg, heavy: the keys that very many sets have, as a sample of the texts shows."""
    some = _keys(texts.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0), single).distinct().groupBy("seg").agg(F.count("*").alias("rows"))
    some = some.where(F.col("rows") >= HEAVY_ROWS)
    least = (some.agg(F.sum("rows")).first()[0] or 0) * HEAVY_SHARE
    return some.where(F.col("rows") >= least).select("seg", F.lit(True).alias("heavy"))


def _shared(texts: DataFrame, single: bool, hold: Callable) -> DataFrame:
    """seg, set_key, n (sets of the key) of all keys that two sets or more have.

    A key's rows meet in one task, but those of heavy keys are dealt by key and part of set_key. Heavy keys are hot whatever n is
    in a part, so theirs is given as above HOT: which keys are hot is free, as long as all sets agree on it."""
    heavy = F.broadcast(hold(_heavy(texts, single), "heavy"))
    keys = _keys(texts, single).join(heavy, "seg", "left").select("seg", "set_key", F.when(F.col("heavy"), 1 + F.pmod("set_key", F.lit(PARTS))).otherwise(0).cast("byte").alias("part"))
    across = Window.partitionBy("seg", "part")
    held = keys.repartition("seg", "part").withColumns({"lo": F.min("set_key").over(across), "hi": F.max("set_key").over(across)})
    met = held.where("part > 0 OR lo <> hi").select("seg", "part", "set_key").distinct().withColumn("n", F.count("*").over(across))
    return hold(met.select("seg", "set_key", F.when(F.col("part") > 0, F.col("n") + HOT).otherwise(F.col("n")).alias("n")), "shared")


def _with_key(rows: DataFrame, table: DataFrame, how: str = "inner") -> DataFrame:
    """rows joined with a table of one row for each seg, the rows of a key dealt to several tasks."""
    dealt = rows.withColumn("deal", F.pmod("set_key", F.lit(DEALT)).cast("int"))
    return dealt.join(table.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1)))), ["seg", "deal"], how).drop("deal")


#: Bits of the filter by which a scan passes over most rows that no join needs; its size is fixed.
FILTER_BITS = 1 << 24


def _room(n: Column) -> Column:
    """Hot keys that a set of n shingles may have without losing a pair: l, or what the d + 1 leave of the smallest set that
    could link to it."""
    band = F.floor(F.log2(n.cast("double")) + 1e-9)
    l = F.lit(2) + F.floor(F.pow(F.lit(2.0), band) / 14)
    return F.least(l, _single_room(F.ceil(3 * n / 4))).cast("long")


def _single_room(n: Column) -> Column:
    """The same where each shingle is a key of its own and all are emitted."""
    return n - F.floor((n + F.floor(4 * n / 3)) / 7) - 1


def _texts(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """set_key, n_shingles, text: one row for each needed set."""
    bit = F.pmod("set_key", F.lit(FILTER_BITS)) + 1
    bitmap = needed.groupBy(F.bitmap_bucket_number(bit).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
    held = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in bitmap.collect():  # 512 rows of 4 KB at most
        at = (row["at"] - 1) * 4096
        held[at : at + 4096] = np.frombuffer(bytes(row["bits"]), np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, bits = set(), shared.value
        for batch in batches:
            for i, j, data, offsets in tokens.chunks(batch.column(0)):
                doc, shingle = _sets(data, offsets)
                n, own = _set_keys(doc, shingle, j - i)
                slot = own % FILTER_BITS
                keep = (n > 0) & ((bits[slot // 8] >> (slot % 8).astype(np.uint8)) & 1 > 0)
                keep[keep] = _once(own[keep], seen)
                rows = np.flatnonzero(keep)
                yield pa.RecordBatch.from_arrays([pa.array(own[rows]), pa.array(n[rows]), _sketches(*_only(doc, shingle, keep), rows), batch.column(0).slice(i, j - i).take(pa.array(rows))], ["set_key", "n_shingles", "sketch", "text"])

    rows = docs.select("text").mapInArrow(run, "set_key long, n_shingles long, sketch binary, text string")
    return rows.join(needed, "set_key", "left_semi").groupBy("set_key").agg(F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"), F.first("text").alias("text"))


def _sketches(doc: np.ndarray, shingle: np.ndarray, rows: np.ndarray) -> pa.Array:
    """The parity sketch of each of the rows: every shingle flips one bit."""
    bit = (tokens.mixed(shingle + np.uint64(0x3C6EF372FE94F82B)) % np.uint64(SKETCH_BITS)).astype(np.int64)
    flips = np.bincount(np.searchsorted(rows, doc) * SKETCH_BITS + bit, minlength=len(rows) * SKETCH_BITS).reshape(len(rows), SKETCH_BITS)
    return pa.array([x.tobytes() for x in np.packbits((flips & 1).astype(np.uint8), axis=1)], pa.binary())


def _verified(pairs: DataFrame, texts: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """Of the pairs (a, b) of sets, those with denominator * intersection >= numerator * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for i, j, data, offsets in tokens.chunks(batch.column(2)):
                doc, shingle = _sets(data, offsets)
                other, theirs = _sets(*tokens.raw(batch.column(3).slice(i, j - i)))
                a = (doc.astype(np.uint64) << np.uint64(52)) | shingle
                b = (other.astype(np.uint64) << np.uint64(52)) | theirs
                both = np.bincount((np.intersect1d(a, b, assume_unique=True) >> np.uint64(52)).astype(np.int64), minlength=j - i)
                union = np.bincount(doc, minlength=j - i) + np.bincount(other, minlength=j - i) - both
                kept.append((denominator * both >= numerator * union) & (both > 0))
            if kept:
                yield batch.select(["a", "b"]).filter(pa.array(np.concatenate(kept)))

    def like(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in (4, 5))
                na, nb = (batch.column(c).to_numpy() for c in (2, 3))
                # linked sets have numerator / (numerator + denominator) of both sizes in common at least
                apart = (denominator - numerator) * (na + nb) // (denominator + numerator)
                yield batch.select(["a", "b"]).filter(pa.array(np.bitwise_count(one ^ two).sum(1) <= apart))

    own = texts.select("set_key", "n_shingles", "sketch")
    near = pairs.join(own.toDF("a", "na", "sa"), "a").join(own.toDF("b", "nb", "sb"), "b")
    near = near.where((F.col("na") * denominator >= F.col("nb") * numerator) & (F.col("nb") * denominator >= F.col("na") * numerator)).select("a", "b", "na", "nb", "sa", "sb").mapInArrow(like, "a long, b long")
    rows = near.join(texts.select(F.col("set_key").alias("a"), F.col("text").alias("left")), "a").join(texts.select(F.col("set_key").alias("b"), F.col("text").alias("right")), "b")
    return rows.select("a", "b", "left", "right").mapInArrow(run, "a long, b long")


def _labels(links: DataFrame, hold: Callable, before: DataFrame | None = None) -> DataFrame:
    """set_key, comp: the component of each set that has a link. before: the labels of all other links, which join the same sets as
    these do, in as many rows as there are sets, and nearly settled."""
    if before is not None:
        links = links.union(before.select(F.col("set_key").alias("a"), F.col("comp").alias("b")))
    return hold(components(links).select(F.col("node").alias("set_key"), F.col("component").alias("comp")), "labels")


def _across(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Those of rows whose key joins different components, with comp, the component of set_key."""
    named = rows.join(labels, "set_key", "left").withColumn("comp", F.coalesce("comp", "set_key"))
    # aggregated before the exchange, so that a key of very many rows is no more to a task than another
    spanning = named.groupBy("seg").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("seg")
    return _with_key(named, spanning, "left_semi")


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs of different components."""
    named = pairs.join(labels.toDF("a", "ca"), "a", "left").join(labels.toDF("b", "cb"), "b", "left")
    return named.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def _met(rows: DataFrame) -> DataFrame:
    """a, b, met: in how many of the keys each pair of sets meets."""
    left, right = rows.select("seg", F.col("set_key").alias("a")), rows.select("seg", F.col("set_key").alias("b"))
    return left.join(right, "seg").where("a < b").groupBy("a", "b").agg(F.count("*").alias("met"))


def _enough(met: DataFrame, sizes: DataFrame) -> DataFrame:
    """The pairs that meet as often as linked ones must. sizes: set_key, room, hot, n_shingles."""
    own = sizes.select("set_key", F.struct("room", "hot", "n_shingles").alias("x"))
    both = met.join(own.toDF("a", "xa"), "a").join(own.toDF("b", "xb"), "b")
    small, large = F.least("xa.n_shingles", "xb.n_shingles"), F.greatest("xa.n_shingles", "xb.n_shingles")
    return both.where((F.col("met") >= 1 + F.least("xa.room", "xb.room") - F.least("xa.hot", "xb.hot")) & (4 * small >= 3 * large)).select("a", "b")


def _crowding(shared: DataFrame, sizes: DataFrame) -> DataFrame:
    """sizes with hot, the number of hot keys of each set."""
    hot = shared.where(F.col("n") > HOT).groupBy("set_key").agg(F.count("*").alias("hot"))
    return sizes.join(hot, "set_key", "left").withColumn("hot", F.coalesce("hot", F.lit(0)))


def near_components(docs: DataFrame, numerator: int = 75, denominator: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of each row: the smallest doc_id that links reach, itself included.

    Words are lower-cased for A-Z; a text with fewer than five words is one shingle of them all; an empty or null text has no
    shingles and stays alone. Rows with a null doc_id take part; their component is named by a row that has an id, or null.
    Rows that repeat an id and a text share their set and component. Ids may be of any type that has an order. Other columns, whatever their names, aren't read. No
    rows in, no rows out. The threshold numerator / denominator must be 3/4 or more; the sketches are laid out for that.

    Equal sets are one class from the start, so exact copies make no pairs. Shuffled are keys of 16 bytes, and the texts of
    sets that share a key with another.
    """
    return _classes(docs, numerator, denominator).select("doc_id", "n_shingles", "component_id")


def _classes(docs: DataFrame, numerator: int = 75, denominator: int = 100) -> DataFrame:
    """near_components() with mark, a hash of the row's text, and first: the id and mark of the component's first row."""
    if 4 * numerator < 3 * denominator:
        raise ValueError("the sketches need a threshold of 3/4 or more")
    ship(docs.sparkSession)
    made: list[DataFrame] = []

    def hold(df: DataFrame, name: str) -> DataFrame:
        made.append(written(df, name))
        return made[-1]

    sets = written(_doc_sets(docs), "sets")
    named = _linked(docs, sets, numerator, denominator, hold)
    for table in made:
        if table is not named:
            drop(table)
    row = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "mark"))
    least = sets.where("set_key is not null").groupBy("set_key").agg(F.min(row).alias("least"))
    smallest = least.join(named, "set_key", "left").withColumn("comp", F.coalesce("comp", "set_key"))
    # a component may hold a third of all sets: its parts meet, and then its sets meet their part
    smallest = smallest.withColumn("part", F.pmod(F.xxhash64("set_key"), F.lit(SPREAD)))
    parts = smallest.groupBy("comp", "part").agg(F.min("least").alias("least"))
    whole = parts.groupBy("comp").agg(F.min("least").alias("first"))
    classes = smallest.join(parts.select("comp", "part").join(whole, "comp"), ["comp", "part"]).select("set_key", "first")
    alone = F.col("set_key").isNull()
    return sets.join(classes, "set_key", "left").select("doc_id", "mark", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"), F.when(~alone, F.col("first")).alias("first"))


def _linked(docs: DataFrame, sets: DataFrame, numerator: int, denominator: int, hold: Callable) -> DataFrame:
    """set_key, comp: the component of each set that has a link. Links are added in steps, each of which starts from the components
    of those before."""

    def check(pairs: DataFrame) -> DataFrame:
        return hold(_verified(pairs, texts, numerator, denominator), "links")

    shared = _shared(docs, False, hold)
    some = shared.select("set_key").distinct()
    n = F.col("n_shingles")
    sizes = sets.join(some, "set_key", "left_semi").groupBy("set_key").agg(F.first("n_shingles").alias("n_shingles")).withColumns({"room": _room(n), "single_room": _single_room(n)})
    sizes = hold(_crowding(shared, sizes), "sizes")
    pairs = hold(_enough(_met(shared.where(F.col("n") <= HOT)), sizes), "pairs")
    crowded = sizes.where("hot > room").select("set_key")
    families = _stars(shared.where(F.col("n") > HOT), sizes).where("a <> b").groupBy("a", "b").agg(F.count("*").alias("met"))
    families = hold(families.where(F.col("met") >= ALIKE).join(crowded.toDF("b"), "b", "left_semi").select("a", "b"), "families")
    firsts = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b").union(families).distinct()
    needed = pairs.select("a").union(pairs.select("b")).union(families.select("a")).union(crowded).distinct().toDF("set_key")
    texts = hold(_texts(docs, needed), "texts")
    # one partner of each first: that joins up most
    labels = _labels(check(firsts), hold)
    labels = _labels(check(_apart(pairs, labels)), hold, labels)
    # crowded sets in hot groups that still span components
    rest = _across(shared.where(F.col("n") > HOT).join(crowded, "set_key", "left_semi"), labels)
    crowded = hold(rest.select("set_key").distinct(), "crowded")
    if crowded.isEmpty():
        return labels
    single = _shared(texts.join(crowded, "set_key", "left_semi"), True, hold)
    sizes = hold(_crowding(single, sizes.join(crowded, "set_key", "left_semi").drop("hot", "room").withColumnRenamed("single_room", "room")), "sizes")
    labels = _labels(check(_apart(_enough(_met(single.where(F.col("n") <= HOT)), sizes), labels)), hold, labels)
    left = sizes.where("hot > room").select("set_key")
    crowd = single.where(F.col("n") > HOT).join(left, "set_key", "left_semi")
    stars = _stars(_across(crowd, labels), sizes).where("a <> b").groupBy("a", "b").agg(F.count("*").alias("met"))
    labels = _labels(check(_apart(stars.where(F.col("met") >= ALIKE).select("a", "b"), labels)), hold, labels)
    last = hold(_across(crowd, labels), "rest")
    if last.isEmpty():
        return labels
    return _labels(check(_close(last, sizes)), hold, labels)


def _stars(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """a, b for each key: the set with the largest share of hot keys, which of near copies is the least edited one, and each
    set of the key."""
    share = F.struct((F.col("hot") / F.col("n_shingles")).alias("share"), "set_key")
    first = rows.select("seg", "set_key").join(sizes.select("set_key", "hot", "n_shingles"), "set_key").groupBy("seg").agg(F.max(share).alias("x")).select("seg", F.col("x.set_key").alias("a"))
    return _with_key(rows.select("seg", "set_key"), first).select("a", F.col("set_key").alias("b"))


def _close(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Pairs of sets that may be linked, from their hot keys. Let all sets list their shingles in one order: those first that
    join no components, cold ones among them, then keys of few components, then others. Sets of n and m shingles that are
    linked have 3 (n + m) / 7 in common or more, so where the first of these is the i-th of the one and the j-th of the
    other, 4 n - 7 (i - 1) >= 3 m and 4 m - 7 (j - 1) >= 3 n. That bounds what a set emits, n // 4 + 1 at most; and what
    joins no components is done with, so sets with much of it emit little or nothing. The keys of a set meet each other
    component that these bounds allow once, not each of its members."""
    spans = rows.groupBy("seg").agg(F.count_distinct("comp").alias("comps"))
    own = Window.partitionBy("set_key")
    ranked = rows.select("seg", "set_key", "comp").join(sizes.select("set_key", F.col("n_shingles").alias("n")), "set_key").withColumn("done", F.col("n") - F.count("*").over(own))
    ranked = ranked.where("done <= n div 4").join(spans, "seg").withColumn("at", F.col("done") + F.row_number().over(own.orderBy("comps", "seg")) - 1)
    first = ranked.where("at <= n div 4").withColumn("reach", 4 * F.col("n") - 7 * F.col("at"))
    other = first.groupBy("seg", F.col("comp").alias("other")).agg(F.min("n").alias("least"), F.max("reach").alias("most"))
    meets = first.join(other, "seg").where("comp <> other AND reach >= 3 * least AND most >= 3 * n").select("set_key", "comp", "other").distinct()
    back = meets.select(F.col("set_key").alias("b"), F.col("other").alias("comp"), F.col("comp").alias("other"))
    return meets.withColumnRenamed("set_key", "a").join(back, ["comp", "other"]).where("a < b").select("a", "b")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: the one of the smallest id, and of rows that share this id the one of the smallest
    text by its hash. Rows without an id stay, and so do full repeats of a kept row. A row goes by its id and its text, so one that
    shares its id with a duplicate, but not the text, isn't lost with it."""
    found = _classes(docs).where(F.col("first").isNotNull() & F.col("doc_id").isNotNull())
    gone = found.where(F.struct("doc_id", "mark") != F.col("first")).select(F.struct("doc_id", "mark").alias("gone")).distinct()
    return docs.join(gone, F.struct(docs["doc_id"], F.xxhash64(docs["text"])) == F.col("gone"), "left_anti")
