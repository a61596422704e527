"""Vectors as arrays of double: Column helpers, and the hashing encoder."""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-12


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(a: Column) -> Column:
    """Length one; a zero vector stays zero. The norm is bound once, not per element."""
    length = F.array(F.greatest(norm(a), F.lit(EPS)))
    return F.get(F.transform(length, lambda n: F.transform(a, lambda x: x / n)), F.lit(0))


def blend(a: Column, b: Column, weight: Column | float) -> Column:
    """``(1 - weight) * a + weight * b``, made length one."""
    w = F.lit(weight) if isinstance(weight, (int, float)) else weight
    return l2_normalize(F.zip_with(a, b, lambda x, y: (1 - w) * x + w * y))


def add_scaled(a: Column, b: Column, weight: float) -> Column:
    """``a + weight * b``, made length one."""
    return l2_normalize(F.zip_with(a, b, lambda x, y: x + F.lit(float(weight)) * y))


def doubles(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("array<double>")


def max_pool(rows: DataFrame, keys: list[str], vec: str = "vec") -> DataFrame:
    """Element-wise maximum of the vectors of a key, made length one. A sum of maxima
    combines on the map side; the vector is put together once per key."""
    spread = rows.select(*keys, F.posexplode(vec).alias("i", "x")).groupBy(*keys, "i").agg(F.max("x").alias("x"))
    return _gather(spread, keys)


def weighted_sum(rows: DataFrame, keys: list[str], weight: str, vec: str = "vec") -> DataFrame:
    """Sum of weight times vector over the rows of a key, made length one."""
    spread = rows.select(*keys, F.col(weight).alias("w"), F.posexplode(vec).alias("i", "x")).groupBy(*keys, "i").agg(F.sum(F.col("w") * F.col("x")).alias("x"))
    return _gather(spread, keys)


def _gather(spread: DataFrame, keys: list[str]) -> DataFrame:
    whole = spread.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("vec"))
    return whole.select(*keys, l2_normalize(F.col("vec")).alias("vec"))


_TOKEN = re.compile(r"[A-Za-z_][A-Za-z0-9_]*|\d+|[^\sA-Za-z0-9_]")


def tokens_of(text: str | None) -> list[str]:
    """The tokens of ``functions.text.tokenize`` for use inside a worker."""
    out: list[str] = []
    for t in _TOKEN.findall((text or "").lower()):
        out.append(t)
        if "_" in t:
            out.extend(p for p in t.split("_") if p and p != t)
    return out


def _blake(feature: str) -> int:
    return int.from_bytes(hashlib.blake2b(feature.encode("utf-8", "replace"), digest_size=8).digest(), "big")


def _md5(feature: str) -> int:
    return int.from_bytes(hashlib.md5(feature.encode("utf-8", "replace")).digest()[:8], "big")


HASHES: dict[str, Callable[[str], int]] = {"blake2b": _blake, "md5": _md5}


class _Features:
    """The features of each raw token met so far, as numbers, with their places and signs.
    A token with underscores also brings those of its parts."""

    def __init__(self, dim: int, hash_name: str, char_ngrams: bool = True):
        self.dim, self.hash, self.grams = dim, HASHES[hash_name], char_ngrams
        self.forget()

    def forget(self) -> None:
        self.tokens: dict[str, int] = {}
        self.features: dict[str, int] = {}
        self.parts, self.begin = array("i"), array("q", [0])  # each token's features, one after the other
        self.place, self.sign = array("q"), array("d")

    def feature(self, name: str) -> int:
        n = self.features.get(name)
        if n is None:
            n = self.features[name] = len(self.place)
            h = self.hash(name)
            self.place.append(h % self.dim)
            self.sign.append(1.0 if h >> 63 else -1.0)
        return n

    def token(self, raw: str) -> int:
        found = []
        for token in (raw, *(p for p in raw.split("_") if p and p != raw)):
            found.append(self.feature(token))
            if self.grams and len(token) >= 3:
                padded = f"#{token}#"
                found += [self.feature("$" + padded[i : i + 3]) for i in range(len(padded) - 2)]
        n = self.tokens[raw] = len(self.tokens)
        self.parts.extend(found)
        self.begin.append(len(self.parts))
        return n

    def vectors(self, texts: list[str | None]) -> np.ndarray:
        """Signed sums of ``1 + ln(count)`` over the features of each text, as rows."""
        x = np.zeros((len(texts), self.dim))
        for at in range(0, len(texts), _TEXTS):
            if len(self.place) > 300_000:
                self.forget()
            some = texts[at : at + _TEXTS]
            x[at : at + len(some)] = self._some(some)
        return x

    def _some(self, texts: list[str | None]) -> np.ndarray:
        known, rows = self.tokens, []
        for t in texts:
            found = _TOKEN.findall((t or "").lower())
            rows.append(np.fromiter([known[w] if w in known else self.token(w) for w in found], np.int64, len(found)))
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        if not sizes.sum():
            return np.zeros((len(texts), self.dim))
        pairs, n = np.unique(np.repeat(np.arange(len(rows)), sizes) << 40 | np.concatenate(rows), return_counts=True)
        row, token = pairs >> 40, pairs & (1 << 40) - 1
        begin, flat = np.array(self.begin), np.array(self.parts)
        many = begin[token + 1] - begin[token]
        place = np.repeat(begin[token] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
        held = np.repeat(row, many) << 40 | flat[place]
        order = np.argsort(held)
        held = held[order]
        first = np.flatnonzero(np.append(True, held[1:] != held[:-1]))
        counts = np.add.reduceat(np.repeat(n, many)[order], first)
        row, feature = held[first] >> 40, held[first] & (1 << 40) - 1
        at, sign = np.array(self.place)[feature], np.array(self.sign)[feature]
        return np.bincount(row * self.dim + at, sign * (1.0 + np.log(counts)), len(texts) * self.dim).reshape(-1, self.dim)


#: Texts whose features are counted together.
_TEXTS = 64
_KNOWN: dict[tuple, _Features] = {}


def features_of(dim: int, hash_name: str, char_ngrams: bool) -> _Features:
    """The features a worker has met, kept from task to task."""
    own = dim, hash_name, char_ngrams
    return _KNOWN.setdefault(own, _Features(*own))


class HashingBackend:
    """Encodes texts by feature hashing; needs no model. One pass over the rows without
    a shuffle: a text's features never leave its worker."""

    def __init__(self, dim: int = 1024, normalize: bool = True, char_ngrams: bool = True, hash_name: str = "blake2b"):
        if dim <= 0:
            raise ValueError("dim must be positive")
        self.dim, self.normalize, self.char_ngrams, self.hash_name = int(dim), normalize, char_ngrams, hash_name

    def embed(self, df: DataFrame, keys: list[str], text: str, is_query: bool = False) -> DataFrame:
        """``<keys>, vec`` of every row. Null texts give zero vectors."""
        dim, normalize, grams, name = self.dim, self.normalize, self.char_ngrams, self.hash_name

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            features = features_of(dim, name, grams)
            for whole in batches:
                for at in range(0, whole.num_rows, 1024):
                    batch = whole.slice(at, 1024)
                    x = features.vectors(batch.column(batch.num_columns - 1).to_pylist())
                    if normalize:
                        x /= np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), EPS)
                    offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * dim)
                    yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], names=[*keys, "vec"])

        schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + ", vec array<double>"
        return df.select(*keys, F.col(text).alias("_text")).mapInArrow(run, schema)


    def embed_pooled(self, df: DataFrame, keys: list[str], pieces: str) -> DataFrame:
        """``<keys>, vec``: the element-wise maximum over the unit vectors of a row's
        pieces, made length one; the pieces never leave their row."""
        dim, grams, name = self.dim, self.char_ngrams, self.hash_name

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            features = features_of(dim, name, grams)
            for whole in batches:
                for at in range(0, whole.num_rows, 256):
                    batch = whole.slice(at, 256)
                    x = np.zeros((batch.num_rows, dim))
                    for row, parts in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                        if parts:
                            own = features.vectors(parts)
                            x[row] = (own / np.maximum(np.sqrt((own * own).sum(axis=1, keepdims=True)), EPS)).max(axis=0)
                    x /= np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), EPS)
                    offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * dim)
                    yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], names=[*keys, "vec"])

        schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + ", vec array<double>"
        return df.select(*keys, F.col(pieces).alias("_pieces")).mapInArrow(run, schema)


class ModelBackend:
    """A sentence encoder, loaded once per worker; its library must be installed."""

    def __init__(self, model_name: str, normalize: bool = True, batch_size: int = 32, device: str = "cpu", max_seq_length: int | None = 256, query_prompt: str | None = None, passage_prompt: str | None = None, trust_remote_code: bool = False, loader: Callable | None = None):
        self.settings = dict(model_name=model_name, device=device, max_seq_length=max_seq_length, trust_remote_code=trust_remote_code)
        self.normalize, self.batch_size, self.query_prompt, self.passage_prompt = normalize, batch_size, query_prompt, passage_prompt
        self.loader = loader or _load_model
        self.dim = int(self.loader(**self.settings).get_sentence_embedding_dimension())

    def embed(self, df: DataFrame, keys: list[str], text: str, is_query: bool = False) -> DataFrame:
        prompt = (self.query_prompt if is_query else self.passage_prompt) or ""
        loader, settings, size, normalize = self.loader, self.settings, self.batch_size, self.normalize

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = loader(**settings)
            for batch in batches:
                texts = [prompt + (t or "") for t in batch.column(batch.num_columns - 1).to_pylist()]
                x = np.asarray(model.encode(texts, batch_size=size, show_progress_bar=False, convert_to_numpy=True), np.float64)
                if normalize and len(x):
                    x /= np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), EPS)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(list(x), pa.list_(pa.float64()))], names=[*keys, "vec"])

        schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + ", vec array<double>"
        return df.select(*keys, F.col(text).alias("_text")).mapInArrow(run, schema)


def _load_model(model_name: str, device: str, max_seq_length: int | None, trust_remote_code: bool):
    from sentence_transformers import SentenceTransformer

    model = SentenceTransformer(model_name, device=device, trust_remote_code=trust_remote_code)
    if max_seq_length is not None:
        model.max_seq_length = max_seq_length
    return model


def build_backend(config, strict: bool = False):
    """The backend a config asks for. A model that can't be loaded is replaced by
    hashing with a warning, or, if ``strict``, raises."""
    if config.kind == "hashing":
        return HashingBackend(config.hashing_dim, config.normalize)
    try:
        return ModelBackend(config.model_name, config.normalize, config.batch_size, config.device, config.max_seq_length, config.query_prompt, config.passage_prompt, config.trust_remote_code)
    except Exception as e:
        if strict:
            raise RuntimeError(f"can't load the model {config.model_name!r}") from e
        import warnings

        warnings.warn(f"can't load the model {config.model_name!r} ({e}); texts are encoded by hashing", stacklevel=2)
        return HashingBackend(config.hashing_dim, config.normalize)
