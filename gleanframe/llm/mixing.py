"""Mixing sources to target shares of all tokens, with soft membership."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanframe.llm.common import words
from gleanframe.llm.tokenize import ROWS_AT_ONCE, TOKENIZER_DIR
from gleanframe.session import cut

#: Labelled rows the classifier is fitted on, at most, and its hashed features.
SAMPLE, FEATURES = 8000, 2048
#: Steps of the projected gradient at most; it stops when every share is as near, or
#: when a step moves no share by more.
STEPS, NEAR, STILL = 40, 1e-4, 2e-5
#: Bins in which rounding is set right, per source.
BINS = 4096
#: Sources with targets are a handful of settings; more are refused.
MAX_SOURCES = 1000


def _features(text: str | None, width: int = FEATURES) -> np.ndarray:
    """Hashed words of a text: one plus the log of the count, scaled to length one."""
    x = np.zeros(width, np.float32)
    for w in words(text):
        x[xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) % width] += 1
    x = np.log1p(x)
    norm = float(np.sqrt((x * x).sum()))
    return x / norm if norm else x


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


class SourceModel:
    """Softmax regression of the source on hashed words; its posteriors are soft
    memberships. Without labelled rows it knows no source."""

    def __init__(self, names: list[str], weights: np.ndarray):
        self.names, self.weights = names, weights

    @classmethod
    def fit(cls, x: np.ndarray, labels: list[str], steps: int = 150, rate: float = 8.0, ridge: float = 1e-4) -> SourceModel:
        names = sorted(set(labels))
        if not names:
            return cls([], np.zeros((FEATURES + 1, 0), np.float32))
        place = {s: k for k, s in enumerate(names)}
        y = np.array([place[s] for s in labels])
        x = np.hstack([x, np.ones((len(x), 1), np.float32)])
        w = np.zeros((x.shape[1], len(names)), np.float32)
        momentum = np.zeros_like(w)
        for _ in range(steps):
            p = _softmax(x @ w)
            p[np.arange(len(y)), y] -= 1
            momentum = 0.9 * momentum + (x.T @ p / len(x) + ridge * w)
            w -= rate * 0.1 * momentum
        return cls(names, w.astype(np.float32))

    def posteriors(self, texts: list[str | None]) -> np.ndarray:
        if not texts or not self.names:
            return np.zeros((len(texts), len(self.names)))
        x = np.stack([_features(t) for t in texts])
        return _softmax(np.hstack([x, np.ones((len(x), 1), np.float32)]) @ self.weights).astype(np.float64)


def fit_source_model(documents: DataFrame, key: str, text: str, source: str) -> SourceModel:
    """Fitted on at most ``SAMPLE`` labelled rows, chosen by the hash of their key."""
    labelled = documents.where(F.col(key).isNotNull() & (F.trim(F.col(source)) != "") & (F.length(text) > 0)).select(
        F.col(source).alias("s"), F.col(text).alias("t"), F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 20)).alias("h")
    )
    total = labelled.count()
    share = min(1 << 20, -(-SAMPLE * (1 << 20) // max(total, 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [_features(t).astype(np.float16).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(raw, pa.binary())], names=["s", "h", "x"])

    rows = labelled.where(F.col("h") < share).mapInArrow(run, "s string, h bigint, x binary").limit(SAMPLE + SAMPLE // 10).collect()
    rows.sort(key=lambda r: (r.h, r.s))
    x = np.stack([np.frombuffer(r.x, np.float16) for r in rows]).astype(np.float32) if rows else np.zeros((0, FEATURES), np.float32)
    return SourceModel.fit(x, [r.s for r in rows])


def document_sizes(documents: DataFrame, key: str, text: str, source: str, model: SourceModel, path: str) -> DataFrame:
    """``key, source, tokens, posterior``: sizes in tokens of all rows, and the
    posterior (over ``model.names``) of the rows without a source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from gleanframe.llm import tokenize

        own = tokenize.encoder(path)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                texts, sources = batch.column(2).to_pylist(), batch.column(1).to_pylist()
                sizes = [len(x) // 4 for x in own.encode(texts)]
                bare = [k for k, s in enumerate(sources) if s is None]
                soft: list[list[float] | None] = [None] * len(texts)
                for k, p in zip(bare, model.posteriors([texts[k] for k in bare])):
                    soft[k] = p.tolist()
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(soft, pa.list_(pa.float64()))], names=["key", "source", "tokens", "posterior"])

    kind = documents.schema[key].dataType.simpleString()
    known = F.when(F.trim(F.col(source)) != "", F.col(source))
    return documents.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), known.alias("s"), F.col(text).alias("t")).mapInArrow(run, f"key {kind}, source string, tokens bigint, posterior array<double>")


def _members(batch: pa.RecordBatch, names: list[str], model: list[str], caps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of sizes: tokens, memberships in the targets' sources, and how often
    each row may be used at most. Without a source, that is the mean of what its sources
    allow, weighted by their posteriors (0 for one without a target), and never more than
    its likeliest source with a target allows."""
    place = {s: k for k, s in enumerate(names)}
    n = batch.num_rows
    tokens = batch.column("tokens").to_numpy().astype(np.float64)
    member, cap = np.zeros((n, len(names))), np.zeros(n)
    cols = [place.get(s, -1) for s in model]
    for k, (s, p) in enumerate(zip(batch.column("source").to_pylist(), batch.column("posterior").to_pylist())):
        if s is not None:
            at = place.get(s, -1)
            if at >= 0:
                member[k, at], cap[k] = 1.0, caps[at]
        elif p:
            for at, share in zip(cols, p):
                if at >= 0:
                    member[k, at] = share
            open_to = np.where(caps > 0, member[k], 0.0)
            if open_to.any():
                cap[k] = min(float(member[k] @ caps), caps[open_to.argmax()])
    return tokens, member, cap


def _rates(member: np.ndarray, cap: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """The rate of each row after the steps so far, each projected into [0, cap]."""
    rate = np.minimum(1.0, cap)
    for step in steps:
        rate = np.clip(rate - member @ step, 0.0, cap)
    return rate


def mix_sources(
    documents: DataFrame,
    targets: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    total_tokens: int | None = None,
    path: str = f"{TOKENIZER_DIR}/byte_bpe_50k.json",
) -> tuple[DataFrame, DataFrame]:
    """The mix and its report.

    The mix has ``<key>, source, tokens, rate, repeats`` for every row used at least
    once. The report has, for every target, ``source, target_share, aim_share,
    reached_share, documents, tokens, max_repeats``: ``aim_share`` is the target
    among the sources that have any documents, ``reached_share`` what the mix has.

    A row belongs to its source, as its share is that of its label; one without a source
    belongs to all in the shares a classifier gives them, fitted on a bounded sample of
    labelled rows. A fit that doesn't come near the shares is reported by a warning. Nonnegative
    rates minimise the squared distance of the expected tokens of each source from
    its share of the total, by projected gradient: each step sums the tokens per
    source on the executors and sends one number per source back. A rate never passes
    its source's ``max_repeats``; that of a row without a source is bounded by the mean
    over its posteriors, in which sources without a target count 0, so the likelier it
    belongs to none of the targets, the less it is used. Without ``total_tokens`` the total is the largest
    for which every share can be met. Rates become whole repeats by the hash of the
    key, set right per source so that the tokens of the rates are kept.

    Rows of sources without a target, empty and null texts and rows with a null key
    aren't used. A target with a null source or share is ignored; a null
    ``max_repeats`` is 1; a source named twice keeps its larger share and smaller
    ``max_repeats``. Empty tables give an empty mix. Repeated keys are used each.
    """
    rows = targets.where("source IS NOT NULL AND target_share IS NOT NULL AND target_share >= 0").groupBy("source").agg(F.max("target_share").alias("share"), F.min(F.coalesce("max_repeats", F.lit(1))).alias("cap")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    rows.sort(key=lambda r: r.source)
    names, share, caps = [r.source for r in rows], np.array([r.share for r in rows], float), np.array([max(0, r.cap) for r in rows], float)
    spark, count = documents.sparkSession, len(rows)
    kind = documents.schema[key].dataType.simpleString()
    mix_schema = f"`{key}` {kind}, source string, tokens bigint, rate double, repeats bigint"
    report_schema = "source string, target_share double, aim_share double, reached_share double, documents bigint, tokens bigint, max_repeats bigint"
    if not count:
        return spark.createDataFrame([], mix_schema), spark.createDataFrame([], report_schema)
    model = fit_source_model(documents, key, text, source)
    base = cut(document_sizes(documents, key, text, source, model, path))

    def sums(steps: list[np.ndarray], most: bool = False) -> np.ndarray:
        """Tokens per source at the rates so far, or at the highest rates."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = np.zeros((2, count))
            for batch in batches:
                tokens, member, cap = _members(batch, names, model.names, caps)
                found[0] += (tokens * (cap if most else _rates(member, cap, steps))) @ member
                found[1] += tokens @ member
            yield pa.RecordBatch.from_arrays([pa.array(list(range(count)), pa.int32()), pa.array(found[0]), pa.array(found[1])], names=["s", "used", "mass"])

        got = base.mapInArrow(run, "s int, used double, mass double").groupBy("s").agg(F.sum("used").alias("used"), F.sum("mass").alias("mass")).collect()
        out = np.zeros((2, count))
        for r in got:
            out[:, r.s] = r.used, r.mass
        return out

    highest, mass = sums([], most=True)
    there = (highest > 0) & (share > 0)
    aim = np.where(there, share, 0.0)
    aim = aim / aim.sum() if aim.sum() else aim
    feasible = float(np.min(highest[there] / aim[there])) if there.any() else 0.0
    total = min(float(total_tokens), feasible) if total_tokens is not None else feasible
    goal = aim * total
    steps: list[np.ndarray] = []
    for n in range(STEPS + 1):
        used, mass = sums(steps)
        off = np.abs(used - goal).max()
        # where rows are shared or at their bounds no rates may meet every goal: the least squares are reached when nothing moves
        if total == 0 or off <= NEAR * total or (n and np.abs(used - last).max() <= STILL * total):
            break
        last = used
        if n == STEPS:
            warnings.warn(f"after {STEPS} steps a source is still {off / total:.2%} of all tokens off its share", stacklevel=2)
            break
        steps.append(np.where(mass > 0, (used - goal) / np.where(mass > 0, mass, 1), 0.0))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, member, cap = _members(batch, names, model.names, caps)
            rate = _rates(member, cap, steps) if total else np.zeros(len(tokens))
            luck = np.array([xxhash.xxh3_64_intdigest(str(k)) / 2.0**64 for k in batch.column("key").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("source"), batch.column("tokens"), pa.array(rate), pa.array(np.ceil(cap)), pa.array(luck - (rate - np.floor(rate))), batch.column("posterior")], names=["key", "source", "tokens", "rate", "cap", "margin", "posterior"])

    rated = base.mapInArrow(place, f"key {kind}, source string, tokens bigint, rate double, cap double, margin double, posterior array<double>").where("tokens > 0 AND rate > 0")
    # a row is rounded up where its margin lies below its source's line; the line is set where the tokens come out right
    edge = F.floor(F.col("margin") * (BINS // 2)).cast("int")
    bins = (
        rated.groupBy("source", edge.alias("bin"))
        .agg(F.sum(F.when(F.col("rate") < F.col("cap"), F.col("tokens")).otherwise(0)).alias("tokens"), F.sum((F.col("rate") - F.floor("rate")) * F.col("tokens")).alias("due"))
        .collect()
    )
    lines: dict[str | None, int] = {}
    for s in {r.source for r in bins}:
        own = sorted((r for r in bins if r.source == s), key=lambda r: r.bin)
        due, so_far, line = sum(r.due for r in own), 0.0, own[0].bin
        for r in own:
            if so_far + r.tokens / 2 > due:
                break
            so_far, line = so_far + r.tokens, r.bin + 1
        lines[s] = line
    limits = spark.createDataFrame([(s, line) for s, line in lines.items()], "of string, line int")
    ruled = rated.join(F.broadcast(limits), F.col("source").eqNullSafe(F.col("of")))
    up = ((edge < F.col("line")) & (F.col("rate") < F.col("cap"))).cast("bigint")
    mix = ruled.select(F.col("key").alias(key), "source", "tokens", "rate", (F.floor("rate") + up).alias("repeats")).where("repeats > 0")

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((2, count))
        for batch in batches:
            tokens, member, _ = _members(batch, names, model.names, caps)
            times = batch.column("repeats").to_numpy()
            found[0] += (tokens * times) @ member
            found[1] += (member > 0.5).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(found[0]), pa.array(found[1])], names=["source", "tokens", "documents"])

    every = ruled.withColumn("repeats", F.floor("rate") + up).where("repeats > 0").select("source", "tokens", "repeats", "posterior")
    got = every.mapInArrow(reached, "source string, tokens double, documents double").groupBy("source").agg(F.sum("tokens").alias("tokens"), F.sum("documents").alias("documents"))
    wanted = spark.createDataFrame([(n, float(s), float(a), int(c)) for n, s, a, c in zip(names, share, aim, caps)], "source string, target_share double, aim_share double, max_repeats bigint")
    every_token = mix.agg(F.sum(F.col("tokens") * F.col("repeats")).alias("every_token"))
    report = wanted.join(got, "source", "left").join(F.broadcast(every_token)).select(
        "source", "target_share", "aim_share", F.coalesce(F.col("tokens") / F.col("every_token"), F.lit(0.0)).alias("reached_share"),
        F.coalesce(F.col("documents"), F.lit(0)).cast("bigint").alias("documents"), F.coalesce(F.round("tokens"), F.lit(0)).cast("bigint").alias("tokens"), "max_repeats",
    )
    return mix, report
