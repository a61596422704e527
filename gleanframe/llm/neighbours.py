"""The most similar vectors of every vector, by shifted space-filling curves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanframe.session import cut

#: Curves, the dimensions vectors are projected to for each, and bits a dimension.
#: The number of the curve and its key share one 64-bit number.
CURVES, DIMENSIONS, BITS = 7, 12, 5
#: Two vectors at most so far apart on a curve are compared.
WINDOW = 1024
#: A range of a curve holds some so many windows; what lies across its ends is a small share.
RANGE_WINDOWS = 32
#: Pairs a window hands on together; a dense one has many.
PAIRS_AT_ONCE = 65_536
#: Projections of a unit vector are standard normal; the grid spans this range.
_LOW, _HIGH, _SHIFT = -3.5, 4.5, 1.0
#: Rounding to 8 bits moves a cosine by less than this.
_ROUNDING = 0.015


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places of points on the Hilbert curve. ``cells`` holds whole coordinates below
    ``2 ** bits``, one row per point; bits times columns is at most 63.

    The usual transform between axes and the transposed index, over all points at
    once: undo the excess work from the top bit down, then Gray-encode.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for i in range(n):
            there = (x[i] & q) != 0
            swap = np.where(there, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(there, low, swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = top
    while q > 1:
        t ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(unit: np.ndarray, curve: int, seed: int = 7) -> np.ndarray:
    """Keys of unit vectors on one curve: its own random projection and shift. The
    curve's number stands in the bits above, so one order holds all curves."""
    rng = np.random.default_rng((seed, curve))
    project = rng.standard_normal((unit.shape[1], DIMENSIONS)).astype(np.float32)
    shift = rng.random(DIMENSIONS).astype(np.float32) * _SHIFT
    cells = ((unit @ project + shift - _LOW) / (_HIGH - _LOW) * (1 << BITS)).astype(np.int64)
    return (np.int64(curve) << (DIMENSIONS * BITS)) | hilbert_keys(np.clip(cells, 0, (1 << BITS) - 1), BITS)


def usable_vectors(rows: DataFrame, key: str, vec: str, width: int) -> DataFrame:
    """``key, vid, raw``: the vectors that take part, as float bytes, and the 64-bit number
    that equal vectors share (among 10^9 different ones, two have the same with a chance
    of 3 %). Null keys, null, zero, non-finite vectors and those of another width don't
    take part; -0.0 equals 0.0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1)
            values = np.asarray(flat.values.cast(pa.float32()).to_numpy(zero_copy_only=False), np.float32)
            begins = flat.offsets.to_numpy()[:-1]
            if not len(begins):
                continue
            x = values[begins[:, None] + np.arange(width)] + np.float32(0)
            good = np.isfinite(x).all(axis=1) & x.any(axis=1)
            raw = [r.tobytes() for r in x[good]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(pa.array(good)), pa.array(np.array([xxhash.xxh3_64_intdigest(r) for r in raw], np.uint64).view(np.int64)), pa.array(raw, pa.binary())], names=["key", "vid", "raw"]
            )

    whole = F.col(key).isNotNull() & (F.size(vec) == width) & F.forall(vec, lambda v: v.isNotNull())
    return rows.where(whole).select(F.col(key).cast("string").alias("k"), F.col(vec).cast("array<float>").alias("v")).mapInArrow(run, "key string, vid bigint, raw binary")


def _unit(raw: list[bytes], width: int) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float32).reshape(-1, width).astype(np.float64)
    return (x / np.sqrt((x * x).sum(axis=1, keepdims=True))).astype(np.float32)


def curve_rows(vectors: DataFrame, width: int) -> DataFrame:
    """``at, item`` of ``vid, raw`` on every curve. ``item`` is the vector's number and the
    vector in 8 bits a value: all a window needs. A vector that comes again soon is left
    out, so one that very many keys share doesn't fill a range; the rest lie side by side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                fresh = []
                for v in batch.column(0).to_pylist():
                    fresh.append(v not in seen)
                    seen.add(v)
                if len(seen) > 500_000:
                    seen.clear()
                batch = batch.filter(pa.array(fresh, pa.bool_()))
                if not batch.num_rows:
                    continue
                unit = _unit(batch.column(1).to_pylist(), width)
                small = np.rint(unit * (127 / np.abs(unit).max(axis=1, keepdims=True))).astype(np.int8)
                packed = np.hstack([batch.column(0).to_numpy().astype("<i8")[:, None].view(np.int8), small])
                column = pa.array([r.tobytes() for r in packed], pa.binary())
                for curve in range(CURVES):
                    yield pa.RecordBatch.from_arrays([pa.array(curve_keys(unit, curve)), column], names=["at", "item"])

    return vectors.mapInArrow(run, "at bigint, item binary")


def _window_pairs(items: list[bytes], block: int, width: int, most: int, floor: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j) of the proposed pairs: i among the first ``block`` items, j after
    it. On either side each item proposes its ``most`` best and all that rounding may
    have put behind them: a cosine and the one it is compared with may both be off."""
    raw = np.frombuffer(b"".join(items), np.uint8).reshape(len(items), 8 + width)
    x = raw[:, 8:].copy().view(np.int8).astype(np.float32)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    s = x[:block] @ x.T
    s[np.tril_indices(block, 0, len(items))] = -2
    least = -1.5 if floor is None else floor - _ROUNDING
    keep = s >= least
    rows, cols = keep.copy(), keep.copy()
    for chosen, score in ((rows, s), (cols.T, s.T)):
        crowded = np.nonzero(chosen.sum(axis=1) > most)[0]
        if len(crowded):
            part = score[crowded]
            chosen[crowded] &= part >= -np.partition(-part, most - 1, axis=1)[:, most - 1 : most] - 2 * _ROUNDING
    return np.nonzero(rows | cols)


_FOUND = "part int, u bigint, v bigint, curve int, head boolean, place int, item binary"
_FOUND_NAMES = ["part", "u", "v", "curve", "head", "place", "item"]


def _propose(items: list[bytes], block: int, width: int, most: int, floor: float | None) -> np.ndarray:
    """The proposed pairs of ``_window_pairs`` as numbers, the smaller first."""
    i, j = _window_pairs(items, block, width, most, floor)
    ids = np.frombuffer(b"".join(x[:8] for x in items), "<i8")
    return np.stack([np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])], axis=1)


def window_pairs(ordered: DataFrame, width: int, most: int, floor: float | None, ranges: int) -> DataFrame:
    """``u, v``: the vectors that neighbouring windows of the sorted rows propose. Rows
    stream through; a task holds two windows at a time. The last window of a range and
    the first of the next go on to meet in a task of their own, so that no pair is
    lost between ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = TaskContext.get().partitionId()
        waiting: list[bytes] = []
        curve, first, last = None, True, b""
        tail: list[bytes] = []

        def pairs_of(block: int, here: list[bytes]) -> Iterator[pa.RecordBatch]:
            both = _propose(here, block, width, most, floor)
            for at in range(0, len(both), PAIRS_AT_ONCE):
                some = both[at : at + PAIRS_AT_ONCE]
                with np.errstate(over="ignore"):
                    to = ((some[:, 0] * np.int64(31) + some[:, 1]) % np.int64(ranges)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(some[:, 0]), pa.array(some[:, 1]), *(pa.nulls(len(some), t) for t in (pa.int32(), pa.bool_(), pa.int32(), pa.binary()))], names=_FOUND_NAMES)

        def edge(to: int, curve: int, head: bool, items: list[bytes]) -> pa.RecordBatch:
            n = len(items)
            return pa.RecordBatch.from_arrays(
                [pa.array([-1 - to] * n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array([curve] * n, pa.int32()), pa.array([head] * n), pa.array(range(n), pa.int32()), pa.array(items, pa.binary())],
                names=_FOUND_NAMES,
            )

        def take(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal waiting, first, tail
            if first and waiting and (final or len(waiting) >= WINDOW):
                first = False
                if mine:
                    yield edge(mine - 1, curve, True, waiting[:WINDOW])
            while len(waiting) > (1 if final else 2 * WINDOW):
                here = waiting[: 2 * WINDOW]
                block = min(WINDOW, len(here))
                yield from pairs_of(block, here)
                tail = (tail + waiting[:block])[-WINDOW:]
                waiting = waiting[block:]
            if final:
                tail = (tail + waiting)[-WINDOW:]
                waiting = []

        for batch in batches:
            for at, item in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if at >> (DIMENSIONS * BITS) != curve:
                    yield from take(True)
                    curve, tail, last = at >> (DIMENSIONS * BITS), [], b""
                if item[:8] != last:  # a vector that several tasks have met counts once
                    waiting.append(item)
                    last = item[:8]
                    if len(waiting) > 3 * WINDOW:
                        yield from take(False)
        yield from take(True)
        if tail:
            yield edge(mine, curve, False, tail)

    def meet(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key[0].as_py() >= 0:
            found = [np.stack([b.column("u").to_numpy(), b.column("v").to_numpy()], axis=1) for b in batches]
            both = np.unique(np.concatenate(found), axis=0)
        else:
            rows = sorted((h, c, p, i) for b in batches for c, h, p, i in zip(*(b.column(k).to_pylist() for k in _FOUND_NAMES[3:])))
            tail, head = [r for r in rows if not r[0]], [r for r in rows if r[0]]
            if not tail or not head or tail[0][1] != head[0][1]:
                return
            both = _propose([r[3] for r in tail + head], len(tail), width, most, floor)
        yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["u", "v"])

    return ordered.mapInArrow(run, _FOUND).repartition(ranges, "part").groupBy("part").applyInArrow(meet, "u bigint, v bigint").distinct()


def _exact(pairs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.float32).reshape(-1, width).astype(np.float64) for k in (2, 3))
                cosine = (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.minimum(cosine, 1.0))], names=["u", "v", "cosine"])

    return pairs.select("u", "v", "raw_u", "raw_v").mapInArrow(run, "u bigint, v bigint, cosine double")


def most_similar(rows: DataFrame, key: str, vec: str, k: int = 5, width: int = 128, min_cosine: float | None = None) -> DataFrame:
    """``key_a, key_b, cosine``: the ``k`` most similar other vectors of every usable
    vector by cosine, ties to the smaller key. With ``min_cosine`` only those at
    least so similar are looked for.

    Approximate: a neighbour is found if the two lie within ``WINDOW`` places of each
    other on one of ``CURVES`` Hilbert curves, each over its own random projection
    and shift. Curves are cut into ranges of some ``RANGE_WINDOWS`` windows, whose ends
    meet, so what is found doesn't depend on the ranges (but for ranges shorter than a
    window, which only very small tables could have and those are one range).
    Proposed pairs are merged and ranked by their exact cosine.

    Repeated rows are one vector; a key with several different vectors keeps the one
    of the smallest number. Equal vectors under different keys are found exactly: they
    share a number, and of a group of any size only its ``k + 1`` smallest keys are
    ever needed. Rows that can't take part (see ``usable_vectors``) have no row.
    """
    vectors = usable_vectors(rows, key, vec, width)
    raws = vectors.groupBy("vid").agg(F.first("raw").alias("raw"))
    ranges = max(1, rows.count() * CURVES // (RANGE_WINDOWS * WINDOW))
    shuffled = curve_rows(vectors.select("vid", "raw"), width).repartitionByRange(ranges, "at", "item").sortWithinPartitions("at", "item")
    pairs = window_pairs(shuffled, width, k, min_cosine, ranges)
    left = raws.select(F.col("vid").alias("u"), F.col("raw").alias("raw_u"))
    right = raws.select(F.col("vid").alias("v"), F.col("raw").alias("raw_v"))
    scored = _exact(pairs.join(left, "u").join(right, "v"), width)
    if min_cosine is not None:
        scored = scored.where(F.col("cosine") >= min_cosine)
    scored = cut(scored)

    members = vectors.groupBy("key").agg(F.min("vid").alias("vid"))
    first = Window.partitionBy("vid").orderBy("key")
    heads = members.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1).select("vid", F.col("key").alias("other"))
    both = scored.unionByName(scored.select(F.col("v").alias("u"), F.col("u").alias("v"), "cosine"))
    near = both.join(heads.withColumnRenamed("vid", "v"), "v").select(F.col("u").alias("vid"), "other", "cosine")
    own = heads.select("vid", "other", F.lit(1.0).alias("cosine"))
    rank = Window.partitionBy("vid").orderBy(F.col("cosine").desc(), "other")
    best = near.unionByName(own).withColumn("r", F.row_number().over(rank)).where(F.col("r") <= k + 1)
    lists = best.groupBy("vid").agg(F.array_sort(F.collect_list(F.struct("r", "other", "cosine"))).alias("list"))
    met = members.join(lists, "vid").select("key", F.slice(F.filter("list", lambda x: x.getField("other") != F.col("key")), 1, k).alias("list"))
    return met.select(F.col("key").alias("key_a"), F.explode("list").alias("x")).select("key_a", F.col("x.other").alias("key_b"), F.col("x.cosine").alias("cosine"))
