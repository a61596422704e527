"""Near-duplicates with small edits: a size-aware similarity join on word shingles."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanframe.llm.common import canonical_text, digest16, words

#: Items whose shingles share one bucket or block; the numbers of both grow with the items.
ITEMS_PER_BUCKET = 8000
#: A map task packs up to so many shingles before it hands them on.
FLUSH = 2_000_000
#: Pairs made at once from one inverted list, and those counted out together.
PAIRS_AT_ONCE, COUNTED_AT_ONCE = 1_000_000, 16_384
#: What it costs to send and sort a pair of shingles, in looks at an entry of a list.
PAIR_COST = 8.0
#: Items looked at for the most frequent shingles, how many of them must have such a
#: shingle, and how many shingles that can be at most. Only the way these travel and
#: their place in the common order depend on it, the result doesn't.
HOT_SAMPLE, HOT_ITEMS, HOT_SHINGLES = 4096, 41, 1 << 16
#: A class of copies is parted when its members are joined if it has this many, and at
#: least this share of all items; there can't be more such classes than its inverse.
HOT_CLASS, HOT_SHARE, SALTS = 4096, 1 / 1000, 32
#: The bucket that stands for the most frequent shingles in a shingle's number.
_HOT_BUCKET = (1 << 24) - 1


class _WordHash(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 2_000_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def shingle_hashes(tokens: list[str], n: int, known: dict) -> np.ndarray:
    """The distinct runs of ``n`` words as sorted 40-bit numbers. In 10^12 different
    shingles two fall together about once each, which costs a needless candidate;
    inside one pair of texts it all but never happens."""
    if len(tokens) < n:
        return np.empty(0, np.uint64)
    h = np.array([known[w] for w in tokens], np.uint64)
    with np.errstate(over="ignore"):
        mixed = np.zeros(len(h) - n + 1, np.uint64)
        for k in range(n):
            mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k]
            mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(mixed >> np.uint64(24))


def _pack(x: np.ndarray, width: int) -> bytes:
    """Numbers in ``width`` bytes each."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _unpack(raw: bytes, width: int) -> np.ndarray:
    wide = np.zeros((len(raw) // width, 8), np.uint8)
    wide[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return wide.view("<u8").ravel()


def _pack_sorted(x: np.ndarray) -> bytes:
    """Numbers that mostly rise as their gaps, in as many bytes as is cheapest; the few
    gaps that don't fit stand before them with their places."""
    gaps = np.diff(x, prepend=np.uint64(0))
    _, width, far = min((w * len(gaps) + 12 * int(n), w, int(n)) for w in range(1, 7) for n in [(gaps >= np.uint64(1 << 8 * w)).sum()])
    over = np.flatnonzero(gaps >= np.uint64(1 << 8 * width))
    return bytes([width]) + np.uint32(far).tobytes() + over.astype(np.uint32).tobytes() + gaps[over].tobytes() + _pack(gaps, width)


def _unpack_sorted(raw: bytes) -> np.ndarray:
    far = int.from_bytes(raw[1:5], "little")
    gaps = _unpack(raw[5 + 12 * far :], raw[0])
    gaps[np.frombuffer(raw, np.uint32, far, 5)] = np.frombuffer(raw, np.uint64, far, 5 + 4 * far)
    return np.cumsum(gaps, dtype=np.uint64)


def _small(x: np.ndarray) -> bytes:
    """Numbers in two bytes each where they fit, else in four, with a mark."""
    fits = not len(x) or int(x.max()) < 1 << 16
    return (b"s" if fits else b"l") + x.astype(np.uint16 if fits else np.uint32).tobytes()


def _wide(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint16 if raw[:1] == b"s" else np.uint32, offset=1).astype(np.int64)


def class_id(tokens: list[str], canon: str | None) -> int:
    """Items of one class have the same words in the same order and are copies of each
    other (64 bits, as a signed number)."""
    h = xxhash.xxh3_64_intdigest(("\x00".join(tokens) + "\x01" + (canon or "")).encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def hot_shingles(items: DataFrame, text: str, n: int, rows: int) -> np.ndarray:
    """The most frequent shingles among the classes of a bounded sample of items, sorted."""
    share = min(1 << 20, -(-HOT_SAMPLE * (1 << 20) // max(rows, 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHash()
        for batch in batches:
            found = [w for w in map(words, batch.column(0).to_pylist()) if len(w) >= n]
            sets = [shingle_hashes(w, n, known).astype(np.int64) for w in found]
            yield pa.RecordBatch.from_arrays([pa.array([class_id(w, None) for w in found], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["cls", "tokens"])

    some = items.where(F.pmod(F.xxhash64(text), F.lit(1 << 20)) < share).select(F.col(text).alias("t"))
    seen = some.mapInArrow(run, "cls bigint, tokens array<bigint>").dropDuplicates(["cls"])
    counts = seen.select(F.explode("tokens").alias("token")).groupBy("token").count().where(F.col("count") >= HOT_ITEMS)
    top = counts.orderBy(F.col("count").desc(), "token").limit(HOT_SHINGLES).select("token").collect()
    return np.sort(np.array([r.token for r in top], np.uint64))


_POSTINGS = "bucket int, classes binary, more binary, tokens binary, owners binary"
_POSTINGS_NAMES = ["bucket", "classes", "more", "tokens", "owners"]


def postings(items: DataFrame, key: str, text: str, n: int, buckets: int, hot: np.ndarray) -> DataFrame:
    """One pass over the texts, packed by map task and bucket. Bucket ``b`` is a range of
    shingle hashes; ``buckets + b`` is the sizes of the classes of block ``b`` and their
    frequent shingles, which are never gathered; ``-1 - b`` is the members whose keys
    hash to ``b``. A class or member that comes again in a task is left out."""
    shared = items.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        known = _WordHash()
        sets: dict[int, np.ndarray] = {}
        members: dict[str, tuple[int, bytes]] = {}
        held = 0

        def flush() -> pa.RecordBatch:
            ids = np.fromiter(sets, np.int64, len(sets))
            sizes = np.fromiter(map(len, sets.values()), np.uint32, len(sets))
            tokens = np.concatenate(list(sets.values())) if sets else np.empty(0, np.uint64)
            owners = np.repeat(np.arange(len(sets), dtype=np.uint32), sizes)
            place = np.searchsorted(often, tokens)
            is_hot = often[np.minimum(place, len(often) - 1)] == tokens if len(often) else np.zeros(len(tokens), bool)
            rows: list[tuple] = []
            cold, own = tokens[~is_hot], owners[~is_hot]
            order = np.argsort(cold, kind="stable")
            cold, own = cold[order], own[order]
            edges = np.searchsorted(cold, [np.uint64((b << 40) // buckets) for b in range(buckets)] + [np.uint64(1 << 40)])
            for b in np.flatnonzero(np.diff(edges)):
                some = slice(edges[b], edges[b + 1])
                mine, local = np.unique(own[some], return_inverse=True)
                rows.append((b, ids[mine].tobytes(), b"", _pack_sorted(cold[some]), _small(local)))
            block = np.mod(ids, buckets)
            often_of, which = owners[is_hot], place[is_hot]
            for b in np.unique(block):
                mine = np.flatnonzero(block == b)
                some = block[often_of] == b
                rows.append((buckets + b, ids[mine].tobytes(), sizes[mine].tobytes(), _pack(which[some], 3), _small(np.searchsorted(mine, often_of[some]))))
            groups: dict[int, list[str]] = {}
            for k in members:
                groups.setdefault(-1 - xxhash.xxh3_64_intdigest(k.encode("utf-8", "surrogatepass")) % buckets, []).append(k)
            for b, keys in groups.items():
                raw = [k.encode("utf-8", "surrogatepass") for k in keys]
                cls = np.array([members[k][0] for k in keys], np.int64)
                rows.append((b, cls.tobytes(), b"".join(members[k][1] for k in keys), b"".join(raw), np.array([len(r) for r in raw], np.uint32).tobytes()))
            cols = list(zip(*rows)) or [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=_POSTINGS_NAMES)

        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = words(t)
                if len(found) < n:
                    continue
                canon = canonical_text(t)
                cls = class_id(found, canon)
                if k not in members or cls < members[k][0]:
                    members[k] = cls, digest16(canon)
                    held += 8
                if cls not in sets:
                    sets[cls] = shingle_hashes(found, n, known)
                    held += len(sets[cls])
                if held >= FLUSH:
                    yield flush()
                    sets, members, held = {}, {}, 0
        if members:
            yield flush()

    rows = items.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("k"), F.col(text).alias("t"))
    return rows.mapInArrow(run, _POSTINGS).repartition(2 * buckets, "bucket")


def class_members(packed: DataFrame) -> DataFrame:
    """``key, cls, canon``: the class of every item that has a shingle; of a key with
    several texts that of the smallest number."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key[0].as_py() >= 0:
            return
        best: dict[bytes, tuple[int, bytes]] = {}
        for batch in batches:
            for c, d, raw, sizes in zip(*(batch.column(k).to_pylist() for k in _POSTINGS_NAMES[1:])):
                ends = np.cumsum(np.frombuffer(sizes, np.uint32))
                for i, (cls, end, size) in enumerate(zip(np.frombuffer(c, np.int64).tolist(), ends.tolist(), np.frombuffer(sizes, np.uint32).tolist())):
                    k = raw[end - size : end]
                    if k not in best or cls < best[k][0]:
                        best[k] = cls, d[16 * i : 16 * i + 16]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k.decode("utf-8", "surrogatepass") for k in best], pa.string()), pa.array([c for c, _ in best.values()], pa.int64()), pa.array([d for _, d in best.values()], pa.binary())],
            names=["key", "cls", "canon"],
        )

    return packed.groupBy("bucket").applyInArrow(run, "key string, cls bigint, canon binary")


_SHARED = "block int, bucket int, classes binary, sizes binary, tokens binary, owners binary, ranks binary"
_SHARED_NAMES = ["block", "bucket", "classes", "sizes", "tokens", "owners", "ranks"]


def shared_shingles(packed: DataFrame, blocks: int) -> DataFrame:
    """Per bucket: shingles of at least two classes go back, numbered within the bucket
    and packed by block of classes, each with a byte for how frequent it is."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = key[0].as_py()
        if bucket < 0:
            return
        classes, sizes, tokens, owners = [], [], [], []
        at = 0
        for batch in batches:
            for c, s, t, o in zip(*(batch.column(k).to_pylist() for k in _POSTINGS_NAMES[1:])):
                classes.append(np.frombuffer(c, np.int64))
                sizes.append(np.frombuffer(s, np.uint32))
                tokens.append(_unpack_sorted(t) if bucket < blocks else _unpack(t, 3))
                owners.append(_wide(o) + at)
                at += len(classes[-1])
        ids, first, back = np.unique(np.concatenate(classes), return_index=True, return_inverse=True)
        tok, own = np.concatenate(tokens), back[np.concatenate(owners)]
        order = np.lexsort((own, tok))
        tok, own = tok[order], own[order]
        fresh = np.ones(len(tok), bool)  # other tasks may bring the same class again
        fresh[1:] = (tok[1:] != tok[:-1]) | (own[1:] != own[:-1])
        tok, own = tok[fresh], own[fresh]
        rows = []
        if bucket >= blocks:
            rows.append((bucket - blocks, _HOT_BUCKET, ids.tobytes(), np.concatenate(sizes)[first].tobytes(), _pack_sorted(tok), _small(own), b""))
        else:
            starts = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]]))
            df = np.diff(np.append(starts, len(tok)))
            each = np.repeat(df, df)
            many = each > 1
            rank = np.minimum(254, np.floor(12 * np.log2(each[many]))).astype(np.uint8)
            tok, own = np.repeat(np.cumsum(df > 1) - 1, df)[many], own[many]
            block, page = np.mod(ids, blocks)[own], tok >> 24
            place = page * blocks + block
            order = np.argsort(place, kind="stable")
            tok, own, rank, place = (tok & 0xFFFFFF)[order].astype(np.uint64), own[order], rank[order], place[order]
            for at in np.unique(place):  # a bucket of more shared shingles than three bytes count has several numbers
                some = slice(*np.searchsorted(place, (at, at + 1)))
                mine, local = np.unique(own[some], return_inverse=True)
                rows.append((at % blocks, bucket + at // blocks * blocks, ids[mine].tobytes(), b"", _pack_sorted(tok[some]), _small(local), rank[some].tobytes()))
        cols = list(zip(*rows)) or [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in cols[:2]] + [pa.array(c, pa.binary()) for c in cols[2:]], names=_SHARED_NAMES)

    return packed.groupBy("bucket").applyInArrow(run, _SHARED).repartition(2 * blocks, "block")


class _Sets:
    """The classes of a block that can have a partner, each with its shared shingles,
    the rarest first. ``size`` counts all its shingles; those it shares with no other
    aren't listed. A shingle's number is its bucket and its place there, 24 bits each."""

    def __init__(self, rows: Iterator[tuple], threshold: float):
        known, known_sizes, classes, tokens, ranks = [], [], [], [], []
        for bucket, c, s, t, o, r in rows:
            ids, own = np.frombuffer(c, np.int64), _wide(o)
            if bucket == _HOT_BUCKET:
                known.append(ids)
                known_sizes.append(np.frombuffer(s, np.uint32))
            classes.append(ids[own])
            tokens.append(_unpack_sorted(t) | np.uint64(bucket << 24))
            ranks.append(np.frombuffer(r, np.uint8) if r else np.full(len(own), 255, np.uint8))
        none = [np.empty(0, np.int64)]
        cls, tok, rank = (np.concatenate(x or none) for x in (classes, tokens, ranks))
        known, first = np.unique(np.concatenate(known or none), return_index=True)
        known_sizes = np.concatenate(known_sizes or none)[first].astype(np.int64)
        order = np.lexsort((tok, rank, cls))
        cls, tok, rank = cls[order], tok[order].astype(np.uint64), rank[order]
        starts = np.flatnonzero(np.concatenate([[True], cls[1:] != cls[:-1]])) if len(cls) else np.empty(0, np.int64)
        shared = np.diff(np.append(starts, len(cls)))
        size = known_sizes[np.searchsorted(known, cls[starts])]
        able = shared >= np.ceil(threshold * size - 1e-9)
        self.cls, self.size, self.starts, self.shared = cls[starts][able], size[able], starts[able], shared[able]
        self.tokens, self.ranks = tok, rank

    def of(self, at: np.ndarray) -> np.ndarray:
        """The shingles of the classes at some places, one class after another."""
        n = self.shared[at]
        return self.tokens[np.repeat(self.starts[at] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]

    def prefix(self, threshold: float, k: int) -> np.ndarray:
        """How many of a class's shared shingles, rarest first, another class as similar as
        the threshold must meet in at least ``k`` places. Shingles of no other class come
        before all others and count into the prefix."""
        need = np.ceil(threshold * self.size - 1e-9).astype(np.int64)
        return np.clip(self.shared - need + k, 0, self.shared)


def _sets_of(batches: Iterator[pa.RecordBatch], threshold: float) -> _Sets:
    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(k).to_pylist() for k in _SHARED_NAMES[1:]))

    return _Sets(rows(), threshold)


def light_bound(shared: DataFrame, threshold: float) -> DataFrame:
    """``bound``, one row: the size below which classes are light, chosen by cost.

    A light class enumerates the pairs of its prefix, a heavy one scans the inverted
    lists of its prefix, whose lengths are known (to a twelfth of a power of two). Both
    costs are summed per size step where the classes lie, and the few steps are added up.
    """

    def steps(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = _sets_of(batches, threshold)
        if not len(sets.cls):
            return
        p1, p2 = sets.prefix(threshold, 1), sets.prefix(threshold, 2)
        lists = np.concatenate([[0.0], np.cumsum(2.0 ** (sets.ranks / 12.0))])
        scan = lists[sets.starts + p1] - lists[sets.starts]
        step, at = np.unique(np.floor(4 * np.log2(sets.size)).astype(np.int32), return_inverse=True)
        least = np.full(len(step), 1 << 60)
        np.minimum.at(least, at, sets.size)
        yield pa.RecordBatch.from_arrays([pa.array(step), pa.array(least), pa.array(np.bincount(at, p2 * (p2 - 1) / 2.0)), pa.array(np.bincount(at, scan))], names=["step", "least", "light", "scans"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for batch in batches for r in batch.to_pylist()), key=lambda r: r["step"])
        best, bound = None, 3
        for k in range(len(rows) + 1):
            cost = PAIR_COST * sum(r["light"] for r in rows[:k]) + sum(r["scans"] for r in rows[k:])
            if best is None or cost < best:
                best, bound = cost, rows[k]["least"] if k < len(rows) else rows[-1]["least"] * 2 if rows else 3
        yield pa.RecordBatch.from_arrays([pa.array([max(3, int(bound))], pa.int64())], names=["bound"])

    each = shared.groupBy("block").applyInArrow(steps, "step int, least bigint, light double, scans double")
    few = each.groupBy("step").agg(F.min("least").alias("least"), F.sum("light").alias("light"), F.sum("scans").alias("scans"))
    # without any class there is no step, and an empty partition still gives the bound
    return few.repartition(1).mapInArrow(choose, "bound bigint")


_KEYS = "bucket int, keys binary, owners binary, rests binary, classes binary, sizes binary"


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        mixed = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b * np.uint64(0xC2B2AE3D27D4EB4F))
        mixed ^= mixed >> np.uint64(31)
        return (mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(25)


def candidate_keys(shared: DataFrame, bound: DataFrame, threshold: float, buckets: int) -> DataFrame:
    """Packed rows of what classes may meet on, as 40-bit numbers: pairs of prefix
    shingles of light classes, single prefix shingles for whatever a heavy class may meet.

    Heavy are the classes of ``bound`` shingles or more, and those of one or two,
    which may have to meet on a single shingle.
    """

    def pack(key, owner, rest, cls, size, heavy) -> pa.RecordBatch:
        order = np.argsort(key)
        key, owner, rest = key[order], owner[order], rest[order]
        # single shingles and pairs of them lie in the two halves of the numbers; each half is parted evenly
        half = key & np.uint64((1 << 39) - 1)
        bucket = (half * np.uint64(buckets)) >> np.uint64(39)
        order = np.argsort(bucket, kind="stable")
        key, owner, rest = key[order], owner[order], rest[order]
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        rows = []
        for b in np.flatnonzero(np.diff(edges)):
            some = slice(edges[b], edges[b + 1])
            mine, local = np.unique(owner[some], return_inverse=True)
            rows.append((b, _pack_sorted(key[some]), _small(local), _small(rest[some]), cls[mine].tobytes(), _small(2 * size[mine] + heavy[mine])))
        cols = list(zip(*rows)) or [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["bucket", "keys", "owners", "rests", "classes", "sizes"])

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line = 3

        def seen() -> Iterator[pa.RecordBatch]:
            nonlocal line
            for batch in batches:
                if batch.num_rows:
                    line = batch.column("bound")[0].as_py()
                yield batch

        sets = _sets_of(seen(), threshold)
        size = sets.size
        heavy = (size >= line) | (size <= 2)
        held: list[tuple[np.ndarray, ...]] = []
        count = 0
        p1, p2 = sets.prefix(threshold, 1), sets.prefix(threshold, 2)
        single = np.flatnonzero((heavy | (size >= threshold * line) | (size <= 4)) & (p1 > 0))
        n = p1[single]
        inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        tok = sets.tokens[np.repeat(sets.starts[single], n) + inside]
        # what can still be shared from this place on, in the common order
        held.append((_mix(tok, tok) & np.uint64((1 << 39) - 1), np.repeat(single, n), np.repeat(sets.shared[single], n) - inside))
        for at in np.flatnonzero(~heavy & (p2 > 1)):
            p, start = p2[at], sets.starts[at]
            tok = sets.tokens[start : start + p]
            i, j = np.triu_indices(p, 1)
            held.append((_mix(np.minimum(tok[i], tok[j]), np.maximum(tok[i], tok[j])) | np.uint64(1 << 39), np.full(len(i), at), sets.shared[at] - i))
            count += len(i)
            if count >= FLUSH // 2:
                yield pack(*(np.concatenate(x) for x in zip(*held)), sets.cls, size, heavy)
                held, count = [], 0
        if held:
            yield pack(*(np.concatenate(x) for x in zip(*held)), sets.cls, size, heavy)

    return shared.crossJoin(F.broadcast(bound)).groupBy("block").applyInArrow(run, _KEYS)


def _list_pairs(size: np.ndarray, starts: np.ndarray, ends: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) inside each list, i before j, of sizes that can be similar. Inside a
    list places are sorted by size, so the partners of a place are a run after it."""
    place = np.arange(len(size))
    stop = place + 1
    for a, z in zip(starts[ends - starts > 1], ends[ends - starts > 1]):
        stop[a:z] = a + np.searchsorted(size[a:z], np.floor(size[a:z] / threshold + 1e-9), side="right")
    number = stop - place - 1
    total = np.concatenate([[0], np.cumsum(number)])
    at = 0
    while at < len(size):
        upto = max(at + 1, int(np.searchsorted(total, total[at] + PAIRS_AT_ONCE, side="right")) - 1)
        some = number[at:upto]
        i = np.repeat(place[at:upto], some)
        j = i + 1 + np.arange(len(i)) - np.repeat(total[at:upto] - total[at], some)
        if len(i):
            yield i, j
        at = upto


def candidate_pairs(keys: DataFrame, threshold: float, buckets: int) -> DataFrame:
    """``u, v``: classes that meet on a key and whose sizes and places in the common
    order still allow the similarity; ``u`` has fewer shingles. A list streams out in
    bounded chunks."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: list[list[np.ndarray]] = [[] for _ in range(5)]
        for batch in batches:
            for k, o, r, c, s in zip(*(batch.column(x).to_pylist() for x in ("keys", "owners", "rests", "classes", "sizes"))):
                own, size = _wide(o), _wide(s)
                found = _unpack_sorted(k), np.frombuffer(c, np.int64)[own], (size >> 1)[own], _wide(r), (size & 1).astype(bool)[own]
                for col, x in zip(cols, found):
                    col.append(x)
        k, cls, size, rest, heavy = map(np.concatenate, cols)
        order = np.lexsort((cls, size, k))
        k, cls, size, rest, heavy = k[order], cls[order], size[order], rest[order], heavy[order]
        starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        ends = np.append(starts[1:], len(k))
        single = (k >> np.uint64(39)) == 0
        for i, j in _list_pairs(size, starts, ends, threshold):
            most = np.minimum(rest[i], rest[j])
            # a single shingle only serves pairs with a heavy class; the others meet on pairs of shingles
            good = (most >= threshold * (size[i] + size[j]) / (1 + threshold) - 1e-9) & (cls[i] != cls[j]) & (~single[i] | heavy[i] | heavy[j])
            both = np.unique(np.stack([cls[i[good]], cls[j[good]]], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["u", "v"])

    return keys.repartition(2 * buckets, "bucket").groupBy("bucket").applyInArrow(run, "u bigint, v bigint").distinct()


_SENT = "block int, ids binary, sizes binary, counts binary, tokens binary, pair_u binary, pair_v binary"


def verified_pairs(pairs: DataFrame, shared: DataFrame, threshold: float, blocks: int) -> DataFrame:
    """``u, v, shared, jaccard`` of the candidates that are as similar as asked. The pairs
    go to the block of ``u``, from where its shingles go along to that of ``v``, once for
    all pairs of two blocks; the other classes' shingles stay where they are."""
    names = [f.split()[0] for f in _SENT.split(", ")]

    def rows(table: pa.Table, columns: list[str]) -> Iterator[tuple]:
        return zip(*(table.column(c).to_pylist() for c in columns))

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows:
            sets = _Sets(rows(right, _SHARED_NAMES[1:]), threshold)
            u, v = left.column("u").to_numpy(), left.column("v").to_numpy()
            to = np.mod(v, blocks)
            order = np.lexsort((u, to))
            u, v, to = u[order], v[order], to[order]
            edges = np.searchsorted(to, np.arange(blocks + 1))
            for b in np.flatnonzero(np.diff(edges)):
                some = slice(edges[b], edges[b + 1])
                ids, which = np.unique(u[some], return_inverse=True)
                at = np.searchsorted(sets.cls, ids)
                n = sets.shared[at]
                tok = sets.of(at)
                tok = tok[np.lexsort((tok, np.repeat(np.arange(len(at)), n)))]
                out.append((b, ids.tobytes(), sets.size[at].tobytes(), _small(n), _pack_sorted(tok), _small(which), v[some].tobytes()))
        cols = list(zip(*out)) or [()] * 7
        return pa.table([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=names)

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[list[np.ndarray]] = [[np.empty(0, np.int64)] for _ in range(3)] + [[np.empty(0)]]
        sets = _Sets(rows(right, _SHARED_NAMES[1:]), threshold) if left.num_rows else None
        for ids, sizes, counts, tokens, pair_u, pair_v in rows(left, names[1:]):
            ids, sizes, n = np.frombuffer(ids, np.int64), np.frombuffer(sizes, np.int64), _wide(counts)
            tok, ends = _unpack_sorted(tokens), np.cumsum(n)
            i, v = _wide(pair_u), np.frombuffer(pair_v, np.int64)
            j = np.searchsorted(sets.cls, v)
            for a in range(0, len(i), COUNTED_AT_ONCE):
                x, y = i[a : a + COUNTED_AT_ONCE], j[a : a + COUNTED_AT_ONCE]
                # shingles by their place among all of these, so that a pair's number fits beside
                theirs = sets.of(y)
                known, place = np.unique(theirs, return_inverse=True)
                mine = tok[np.repeat(ends[x] - n[x] - np.cumsum(n[x]) + n[x], n[x]) + np.arange(int(n[x].sum()))]
                at = np.minimum(np.searchsorted(known, mine), max(len(known) - 1, 0))
                hit = known[at] == mine if len(known) else np.zeros(len(mine), bool)
                of_mine = np.repeat(np.arange(len(x)), n[x])[hit] * len(known) + at[hit]
                of_theirs = np.repeat(np.arange(len(y)), sets.shared[y]) * len(known) + place
                met = np.intersect1d(of_mine, of_theirs, assume_unique=True)
                common = np.bincount(met // max(len(known), 1), minlength=len(x)).astype(np.int64)
                union = sizes[x] + sets.size[y] - common
                good = common >= threshold * union - 1e-9
                for col, c in zip(found, (ids[x], v[a : a + COUNTED_AT_ONCE], common, common / union)):
                    col.append(c[good])
        return pa.table([pa.array(np.concatenate(c)) for c in found], names=["u", "v", "shared", "jaccard"])

    placed = pairs.withColumn("block", F.pmod("u", F.lit(blocks)).cast("int")).groupBy("block")
    sent = placed.cogroup(shared.groupBy("block")).applyInArrow(send, _SENT)
    return sent.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(count, "u bigint, v bigint, shared bigint, jaccard double")


def _links(items: DataFrame, key: str, text: str, n: int, threshold: float) -> tuple[DataFrame, DataFrame, int]:
    rows = items.count()
    buckets = max(4, rows // ITEMS_PER_BUCKET)
    packed = postings(items, key, text, n, buckets, hot_shingles(items, text, n, rows))
    shared = shared_shingles(packed, buckets)
    keys = candidate_keys(shared, light_bound(shared, threshold), threshold, buckets)
    return verified_pairs(candidate_pairs(keys, threshold, buckets), shared, threshold, buckets), class_members(packed), rows


def similar_classes(items: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Two tables: ``u, v, shared, jaccard``, all pairs of classes whose distinct runs of
    ``n`` words have at least the Jaccard similarity ``threshold``, and ``key, cls,
    canon``, the class of every item. A class is all copies of one text, so a group of m
    copies that resembles one of n is one pair here. No link is lost; shingles are
    told apart by 40 bits of their hash and classes by 64.

    Only shingles of two or more classes can be shared; buckets of hashes find them
    and their frequencies, and every class gets its own back, the rarest first. Two
    classes as similar as asked must then meet among the first of them. Small classes
    enumerate pairs of those (two common ones are certain), large ones scan inverted
    lists; the boundary is chosen by cost. Candidates are counted out exactly.

    Texts are read once. The most frequent shingles, which any text may have, go
    straight to their classes, so no bucket has to hold all classes of one.
    """
    links, members, _ = _links(items, key, text, n, threshold)
    return links, members


def near_copies(items: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, threshold: float = 0.8) -> DataFrame:
    """``key_a, key_b``: pairs of distinct items, the smaller key first, at least as
    similar as ``threshold`` and not mere copies of each other (``canonical_text``).

    Copies with the same words form one class, so only classes are compared, and
    their pairs are spread over the members afterwards; the members of a class with
    very many are joined in parts. Repeated rows are one item; null keys and texts with
    fewer than ``n`` words have no pairs, an empty table has none, other columns are ignored.
    """
    links, members, rows = _links(items, key, text, n, threshold)
    links = links.select("u", "v")
    hot_from = max(HOT_CLASS, math.ceil(rows * HOT_SHARE))
    hot = members.groupBy("cls").count().where(F.col("count") >= hot_from).select("cls")

    def salted(pairs: DataFrame, side: str) -> DataFrame:
        """A row for each part of the side's class."""
        mark = F.broadcast(hot.select(F.col("cls").alias(side), F.lit(True).alias("hot")))
        parts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        return pairs.join(mark, side, "left").withColumn("salt", F.explode(parts)).drop("hot")

    part = F.when(F.col("hot"), F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).otherwise(0)
    known = members.join(F.broadcast(hot.select("cls", F.lit(True).alias("hot"))), "cls", "left").withColumn("salt", part)
    left = known.select(F.col("cls").alias("u"), "salt", F.col("key").alias("ka"), F.col("canon").alias("ca"))
    right = known.select(F.col("cls").alias("v"), "salt", F.col("key").alias("kb"), F.col("canon").alias("cb"))
    met = salted(links, "u").join(left, ["u", "salt"]).drop("salt", "u")
    met = salted(met, "v").join(right, ["v", "salt"]).where("ca != cb")
    return met.select(F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b"))
