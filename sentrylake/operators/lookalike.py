"""The most similar reference hash of each row: by multi-index hashing where little meets so, else block by block of both sides."""

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Share of all pairs that may meet in a piece. Where more would (many bits may differ, so pieces are short), comparing all pairs in
#: numpy costs less than joining those that meet.
MEET_SHARE = 0.002
#: Hashes of a block, about; and pairs of blocks that a task compares.
BLOCK, BLOCK_PAIRS = 8192, 8


def _words(hash_: Column, bits: int) -> list[Column]:
    return [F.conv(F.substring(hash_, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(bits // 32)]


def bits_apart(a: Column, b: Column, bits: int = 64) -> Column:
    """In how many bits two hex hashes differ."""
    return reduce(add, (F.bit_count(x.bitwiseXOR(y)) for x, y in zip(_words(a, bits), _words(b, bits), strict=True)))


def _bits(hash_: Column, bits: int) -> Column:
    return F.concat(*(F.lpad(F.conv(F.substring(hash_, 1 + 8 * k, 8), 16, 2), 32, "0") for k in range(bits // 32)))


def _near(piece: Column) -> Column:
    """A piece and all that differ from it in one bit."""
    at = F.sequence(F.lit(1), F.length(piece))
    flip = lambda i: F.concat(F.substr(piece, F.lit(1), i - 1), F.translate(F.substr(piece, i, F.lit(1)), "01", "10"), F.substr(piece, i + 1))
    return F.concat(F.array(piece), F.transform(at, flip))


def _numbers(hashes: list[str], bits: int) -> np.ndarray:
    """Hex hashes as rows of words: one row of the array for each word's place."""
    kind = "u8" if bits % 64 == 0 else "u4"
    return np.ascontiguousarray(np.frombuffer(bytes.fromhex("".join(hashes)), f">{kind}").astype(kind).reshape(len(hashes), -1).T)


def _nearest_of(asked: np.ndarray, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of the first nearest of refs of each of asked, and the bits that it is apart."""
    places, aparts = np.empty(asked.shape[1], np.int64), np.empty(asked.shape[1], np.int32)
    for i in range(asked.shape[1]):
        apart = np.bitwise_count(refs[0] ^ asked[0, i])
        for word in range(1, len(refs)):
            apart = np.add(apart, np.bitwise_count(refs[word] ^ asked[word, i]), dtype=np.uint16)
        places[i] = apart.argmin()
        aparts[i] = apart[places[i]]
    return places, aparts


def _packed(hashes: DataFrame, hash_: str, row: Column) -> tuple[DataFrame, int]:
    """One array of row, in order, for each of some blocks of about BLOCK hashes, and the number of blocks."""
    blocks = max(1, -(-hashes.count() // BLOCK))
    nth = F.pmod(F.xxhash64(hash_), F.lit(blocks)).cast("int")
    return hashes.groupBy(nth.alias("nth")).agg(F.array_sort(F.collect_list(row)).alias("held")), blocks


def _by_blocks(asked: DataFrame, listed: DataFrame, most: int, bits: int) -> DataFrame:
    """hash, apart, ref: the nearest in each block of listed (ref_hash, ref), one row a hash, of each of asked (hash), if near enough."""
    left, n = _packed(asked, "hash", F.col("hash"))
    right, m = _packed(listed, "ref_hash", F.struct("ref", "ref_hash"))
    left = left.select("nth", F.col("held").alias("hashes"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("other"))
    pairs = left.join(right.select(F.col("nth").alias("other"), F.col("held").alias("refs")), "other").repartition(-(-n * m // BLOCK_PAIRS), "nth", "other")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                hashes, refs = batch.column(0)[i].values, batch.column(1)[i].values
                places, aparts = _nearest_of(_numbers(hashes.to_pylist(), bits), _numbers(refs.field("ref_hash").to_pylist(), bits))
                near = np.flatnonzero(aparts <= most)
                yield pa.RecordBatch.from_arrays([hashes.take(pa.array(near)), pa.array(aparts[near]), refs.field("ref").take(pa.array(places[near]))], ["hash", "apart", "ref"])

    return pairs.select("hashes", "refs").mapInArrow(run, f"hash string, apart int, ref {listed.schema['ref'].dataType.simpleString()}")


def most_similar(rows: DataFrame, refs: DataFrame, key: str, least: float = 0.85, bits: int = 64) -> DataFrame:
    """key, ref, sim of each of rows (key, hash) whose nearest of refs (ref, ref_hash) has at least that share of equal bits; ties go to
    the smallest ref. Hashes are lower-case hex of so many bits (a multiple of 32: two hashes of a picture may be put
    together as one of 128); rows and references with null or other hashes have no match. A key that repeats has one row for each
    of its rows.

    Hashes that differ in d bits at most agree but for one bit in one of d // 2 + 1 pieces. References are listed by their pieces, and a
    hash looks up its own pieces and those one bit away; what meets is verified. Where pieces are so short that much meets by chance
    (MEET_SHARE), distinct hashes of both sides are packed into blocks instead and each pair of blocks is compared in a task: work is
    then that of all pairs, at some nanoseconds each, and memory that of two blocks. Equal hashes, however many, look up once.
    """
    most = int((1 - least) * bits + 1e-9)
    pieces = most // 2 + 1
    cuts = [bits * k // pieces for k in range(pieces + 1)]
    whole = lambda c: F.col(c).rlike(f"^[0-9a-f]{{{bits // 4}}}$")
    parts = [(str(k), F.substring("bits", a + 1, b - a)) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    listed = refs.where(whole("ref_hash")).groupBy("ref_hash").agg(F.min("ref").alias("ref"))
    asked = rows.where(whole("hash")).select("hash").distinct()
    shortest = bits // pieces
    if pieces * (1 + shortest) / 2**shortest > MEET_SHARE:
        met = _by_blocks(asked, listed, most, bits)
    else:
        listed = listed.withColumn("bits", _bits(F.col("ref_hash"), bits))
        listed = listed.select("ref_hash", "ref", F.explode(F.array(*(F.struct(F.lit(k).alias("nth"), p.alias("piece")) for k, p in parts))).alias("x")).select("ref_hash", "ref", "x.*")
        asked = asked.withColumn("bits", _bits(F.col("hash"), bits))
        asked = asked.select("hash", F.explode(F.array(*(F.struct(F.lit(k).alias("nth"), _near(p).alias("near")) for k, p in parts))).alias("x")).select("hash", "x.nth", F.explode("x.near").alias("piece"))
        met = asked.join(listed, ["nth", "piece"]).select("hash", "ref", bits_apart(F.col("hash"), F.col("ref_hash"), bits).alias("apart")).where(F.col("apart") <= most)
    best = met.groupBy("hash").agg(F.min(F.struct("apart", "ref")).alias("best"))
    return rows.select(key, "hash").join(best, "hash").select(key, F.col("best.ref").alias("ref"), (1 - F.col("best.apart") / float(bits)).alias("sim"))
