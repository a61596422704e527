"""Duplicates hidden by formatting: Bloom filters of canonical hashes keep records
that are surely single out of the shuffle."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from uuid import uuid4

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanframe.llm.common import digest16
from gleanframe.session import cut, shared_dir

#: Bits of the filter for each record, hash positions of a record, and the largest
#: filter in bytes. More records make more filters, each for a part of the hashes.
BITS_PER_RECORD, POSITIONS, MAX_FILTER_BYTES = 16, 2, 32 << 20
#: The filter travels in so many slices, merged in parallel.
SLICES = 16
#: A group of copies with more than this share of all records is joined by
#: broadcast; there can't be more such groups than its inverse.
HOT_SHARE = 1 / 1000


def canonical_hashes(records: DataFrame, key: str, text: str, canon: Callable[[str | None], str | None]) -> DataFrame:
    """``key, h``: a 16-byte hash of each record's canonical form. Records with a
    null key or without a canonical form have no row."""
    schema = "key string, h binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = [canon(t) for t in batch.column(1).to_pylist()]
            hashes = pa.array([None if f is None else digest16(f) for f in forms], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), hashes], names=["key", "h"])

    return records.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, schema).where("h IS NOT NULL")


def _positions(hashes: pa.Array, bits: int) -> np.ndarray:
    """POSITIONS bit places of each 16-byte hash, as an array (records, POSITIONS)."""
    raw = np.frombuffer(b"".join(hashes.to_pylist()), dtype="<u8").reshape(-1, 2)
    step = raw[:, 1] | np.uint64(1)
    return np.stack([(raw[:, 0] + np.uint64(k) * step) % np.uint64(bits) for k in range(POSITIONS)], axis=1)


def filter_sizes(records: int) -> tuple[int, int]:
    """How many filters, and the bits of each: a power of two, in proportion to its records."""
    filters = max(1, -(-records * BITS_PER_RECORD // (8 * MAX_FILTER_BYTES)))
    want = max(1 << 16, -(-BITS_PER_RECORD * records // filters))
    return filters, min(1 << math.ceil(math.log2(want)), MAX_FILTER_BYTES * 8)


def repeat_filter(hashes: DataFrame, bits: int) -> bytes:
    """A Bloom filter that holds every hash seen more than once.

    Each partition sets the bits of the hashes it sees once, and those of hashes it
    sees again; merging adds to the repeats whatever two partitions have both seen.
    A hash of two partitions has all its bits in both, so none is missed. What a
    partition hands on is packed and grows with the bits it has set.
    """
    part = bits // 8 // SLICES

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, again = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        some = False
        for batch in batches:
            if not batch.num_rows:
                continue
            some = True
            places = _positions(batch.column(0), bits)
            lines, counts = np.unique(places, axis=0, return_counts=True)
            hit = np.ones(len(lines), bool)
            for k in range(POSITIONS):
                hit &= (once[lines[:, k] >> np.uint64(3)] >> (lines[:, k] & np.uint64(7)).astype(np.uint8)) & 1 == 1
            for target, rows in ((again, lines[hit | (counts > 1)]), (once, lines)):
                p = rows.ravel()
                np.bitwise_or.at(target, p >> np.uint64(3), np.left_shift(np.uint8(1), (p & np.uint64(7)).astype(np.uint8)))
        if some:
            pack = zstandard.ZstdCompressor(level=1).compress
            rows = [(s, pack(once[s * part : (s + 1) * part].tobytes()), pack(again[s * part : (s + 1) * part].tobytes())) for s in range(SLICES)]
            yield pa.RecordBatch.from_pydict(
                {"slice": pa.array([r[0] for r in rows], pa.int32()), "once": pa.array([r[1] for r in rows], pa.binary()), "again": pa.array([r[2] for r in rows], pa.binary())}
            )

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, again = np.zeros(part, np.uint8), np.zeros(part, np.uint8)
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for o, a in zip(batch.column("once").to_pylist(), batch.column("again").to_pylist()):
                mine = np.frombuffer(unpack(o), np.uint8)
                again |= np.frombuffer(unpack(a), np.uint8) | (once & mine)
                once |= mine
        yield pa.RecordBatch.from_pydict({"slice": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([again.tobytes()], pa.binary())})

    slices = hashes.select("h").mapInArrow(build, "slice int, once binary, again binary").groupBy("slice").applyInArrow(merge, "slice int, bits binary").collect()
    found = {r.slice: bytes(r.bits) for r in slices}
    return b"".join(found.get(s, bytes(part)) for s in range(SLICES))


def possible_repeats(hashes: DataFrame, bloom: bytes, bits: int) -> DataFrame:
    """The rows of key, h plus ``maybe``: whether the hash may occur more than once."""
    shared = hashes.sparkSession.sparkContext.broadcast(bloom)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            if batch.num_rows:
                places = _positions(batch.column(1), bits)
                hit = (table[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8)) & 1
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hit.all(axis=1))], names=["key", "h", "maybe"])

    return hashes.select("key", "h").mapInArrow(run, "key string, h binary, maybe boolean")


def mark_repeats(base: DataFrame, total: int) -> DataFrame:
    """``key, h, maybe`` of all rows. With so many records that one filter would be too
    large to send around, the rows are first written in parts by their hashes, without a
    shuffle, and each part has a filter of its own; no row is read by more than one."""
    filters, bits = filter_sizes(total)
    if filters == 1:
        return possible_repeats(base, repeat_filter(base, bits), bits)
    folder = f"{shared_dir(base.sparkSession)}/hashes-{uuid4().hex}"
    part = F.pmod(F.conv(F.substring(F.hex("h"), 17, 8), 16, 10).cast("bigint"), F.lit(filters)).cast("int")
    base.withColumn("part", part).write.partitionBy("part").parquet(folder)
    written = base.sparkSession.read.parquet(folder)
    marked = []
    for number in range(filters):
        rows = written.where(F.col("part") == number).select("key", "h")
        marked.append(possible_repeats(rows, repeat_filter(rows, bits), bits))
    return reduce(DataFrame.unionByName, marked)


def copy_groups(hashes: DataFrame) -> DataFrame:
    """``key, keep_key, copies`` for every record of ``key, h``: the smallest key of
    its group (by bytes) and how many distinct records the group has.

    Records the filter rules out are emitted at once as groups of one. The others
    are grouped by hash, with a map-side minimum and count. Group results go back to
    the records by a join; groups larger than ``HOT_SHARE`` of all records, of which
    there are at most ``1 / HOT_SHARE``, take part by broadcast, so no task gets
    a hot group. A key that comes several times counts once.
    """
    base = cut(hashes)
    total = base.count()
    marked = mark_repeats(base, total)
    single = marked.where("NOT maybe").select("key", F.col("key").alias("keep_key"), F.lit(1).cast("bigint").alias("copies"))
    rows = cut(marked.where("maybe").select("key", "h").distinct())
    groups = rows.groupBy("h").agg(F.min("key").alias("keep_key"), F.count("*").alias("copies"))
    hot_from = max(2, math.ceil(total * HOT_SHARE))
    groups = groups.withColumn("hot", F.col("copies") >= hot_from)
    hot = F.broadcast(groups.where("hot").select(F.col("h"), F.col("keep_key").alias("hot_keep"), F.col("copies").alias("hot_copies")))
    with_hot = rows.join(hot, "h", "left")
    done = with_hot.where("hot_keep IS NOT NULL").select("key", F.col("hot_keep").alias("keep_key"), F.col("hot_copies").alias("copies"))
    rest = with_hot.where("hot_keep IS NULL").select("key", "h").join(groups.where("NOT hot").select("h", "keep_key", "copies"), "h").select("key", "keep_key", "copies")
    return single.unionByName(done).unionByName(rest)

