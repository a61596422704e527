"""Encoding with a public byte-level BPE tokenizer by recursive SQL in each partition."""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public vocabularies lie on every machine.
TOKENIZER_DIR = "/opt/tokenizers"
#: Distinct words a worker remembers before it begins anew.
MAX_WORDS = 400_000
#: Bytes of words contracted by one query, and of the longest word worth remembering.
BYTES_AT_ONCE, KNOWN_BYTES = 200_000, 4096
#: A stretch of more bytes than this within which merges may reach anywhere is contracted
#: pair by pair instead, as the query would look at all of it in each of its many rounds.
LONG_BYTES = 512
#: Rows split and encoded together.
ROWS_AT_ONCE = 2048

# The next two patterns are fixed values of the vocabulary's pre-tokenizer.
_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    r"| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
_ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[a-zA-Z]+| ?[0-9]+| ?[^\sa-zA-Z0-9]+|\s+(?!\S)|\s+"

#: Token-position rows join the merge table; in every word the pair of least rank is
#: contracted, leftmost first and wherever it occurs without overlap (a merge only
#: makes pairs of a higher rank, so this is the same as one contraction at a time),
#: until no pair of the word is in the table. A word's last step is its encoding.
_ENCODE_SQL = """
WITH RECURSIVE step(word, pos, tok, round) AS (
  SELECT word, pos, tok, 0 FROM start
  UNION ALL
  SELECT word, pos, CASE WHEN take THEN merged ELSE tok END, round + 1
  FROM (
    SELECT *, coalesce(lag(take) OVER (PARTITION BY word ORDER BY pos), false) AS gone
    FROM (
      SELECT *, hit AND (row_number() OVER (PARTITION BY word, island, hit ORDER BY pos)) % 2 = 1 AS take
      FROM (
        SELECT *, row_number() OVER (PARTITION BY word ORDER BY pos) - row_number() OVER (PARTITION BY word, hit ORDER BY pos) AS island
        FROM (
          SELECT *, rank IS NOT NULL AND rank = least_rank AS hit
          FROM (
            SELECT s.word, s.pos, s.tok, s.round, m.rank, m.merged, min(m.rank) OVER (PARTITION BY s.word) AS least_rank
            FROM (SELECT *, lead(tok) OVER (PARTITION BY word ORDER BY pos) AS next_tok FROM step) s
            LEFT JOIN merges m ON m.a = s.tok AND m.b = s.next_tok
          ) WHERE least_rank IS NOT NULL
        )
      )
    )
  ) WHERE NOT gone
),
last AS (SELECT word, max(round) AS round FROM step GROUP BY word)
SELECT word, list(tok ORDER BY pos) AS ids FROM step JOIN last USING (word, round) GROUP BY word ORDER BY word
"""

_DECODE_SQL = """
SELECT doc, string_agg(hex(bytes), '' ORDER BY pos) AS hexed
FROM coded JOIN vocabulary USING (id) GROUP BY doc
"""


def _byte_signs() -> dict[str, int]:
    """The printable sign that stands for each byte in the vocabulary file."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    signs = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return signs | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """One worker's DuckDB with the merge table, and the words it has met."""

    def __init__(self, path: str):
        import duckdb
        import regex

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        signs = _byte_signs()
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        merges = pa.table(
            {
                "a": pa.array([vocab[a] for a, _ in pairs], pa.int32()),
                "b": pa.array([vocab[b] for _, b in pairs], pa.int32()),
                "rank": pa.array(range(len(pairs)), pa.int32()),
                "merged": pa.array([vocab[a + b] for a, b in pairs], pa.int32()),
            }
        )
        self.con.register("merges_in", merges)
        self.con.execute("CREATE TABLE merges AS SELECT * FROM merges_in")
        self.con.unregister("merges_in")
        by_byte = {b: vocab[s] for s, b in signs.items()}
        self.byte_ids = np.array([by_byte[b] for b in range(256)], np.int32)
        self.vocabulary = (vocab, signs)
        ids = [(vocab[a], vocab[b]) for a, b in pairs]
        self.merges = {pair: (rank, vocab[a + b]) for rank, (pair, (a, b)) in enumerate(zip(ids, pairs))}
        # bytes that stand side by side in no token: no merge ever reaches across them
        self.joined = np.zeros((256, 256), bool)
        for word in vocab:
            raw = [signs[c] for c in word if c in signs]
            self.joined[raw[:-1], raw[1:]] = True
        self.wide, self.ascii = regex.compile(_PATTERN), re.compile(_ASCII_PATTERN, re.ASCII)
        self.known: dict[str, bytes] = {}  # ids as packed 32-bit numbers

    def pieces(self, text: str) -> list[str]:
        # the two patterns only part ways beyond ASCII
        return (self.ascii if text.isascii() else self.wide).findall(text)

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """The packed ids of words. A word is cut where no merge can cross, which leaves
        its ids as they are, and its pieces go through the recursive query."""
        pieces: dict[bytes, bytes] = {}
        cut_words = []
        for w in words:
            raw = w.encode("utf-8", "replace")
            own = [raw]
            if len(raw) > LONG_BYTES:
                x = np.frombuffer(raw, np.uint8)
                ends = np.flatnonzero(~self.joined[x[:-1], x[1:]]) + 1
                own = [raw[a:z] for a, z in zip([0, *ends.tolist()], [*ends.tolist(), len(raw)])]
            cut_words.append(own)
            pieces.update(dict.fromkeys(own, b""))
        short = [p for p in pieces if len(p) <= LONG_BYTES]
        at = 0
        while at < len(short):
            size, begin = 0, at
            while at < len(short) and (size == 0 or size + len(short[at]) <= BYTES_AT_ONCE):
                size, at = size + len(short[at]), at + 1
            self._contract(short[begin:at], pieces)
        for p in pieces:
            if len(p) > LONG_BYTES:
                pieces[p] = self._contract_long(p)
        return {w: b"".join(map(pieces.__getitem__, own)) for w, own in zip(words, cut_words)}

    def _contract(self, raw: list[bytes], into: dict[bytes, bytes]) -> None:
        """Pieces of words by the recursive query."""
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        start = pa.table(
            {
                "word": np.repeat(np.arange(len(raw), dtype=np.int32), sizes),
                "pos": (np.arange(total) - np.repeat(ends - sizes, sizes)).astype(np.int32),
                "tok": self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)],
            }
        )
        self.con.register("start", start)
        try:
            got = self.con.execute(_ENCODE_SQL).fetchall()
        finally:
            self.con.unregister("start")
        for word, ids in got:
            into[raw[word]] = array("i", ids).tobytes()

    def _contract_long(self, raw: bytes) -> bytes:
        """The same for one long piece, the leftmost pair of least rank at a time: a heap
        of the pairs that stand side by side, in time little more than linear."""
        toks = self.byte_ids[np.frombuffer(raw, np.uint8)].tolist()
        n = len(toks)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merges = self.merges
        heap = [(merges[p][0], i, p) for i, p in enumerate(zip(toks, toks[1:])) if p in merges]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if toks[i] is None or j >= n or (toks[i], toks[j]) != pair:
                continue
            toks[i], toks[j] = merges[pair][1], None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for x, y in ((before[i], i), (i, k)):
                if x >= 0 and y < n and (p := (toks[x], toks[y])) in merges:
                    heapq.heappush(heap, (merges[p][0], x, p))
        return array("i", [t for t in toks if t is not None]).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The packed ids of each text."""
        if len(self.known) > MAX_WORDS:
            self.known.clear()
        split = [self.pieces(t) if t else [] for t in texts]
        fresh = set()
        for pieces in split:
            fresh.update(pieces)
        fresh = sorted(fresh.difference(self.known))
        new = self.learn(fresh)
        self.known.update((w, ids) for w, ids in new.items() if len(w) <= KNOWN_BYTES)
        known = self.known if len(new) == 0 else self.known | {w: ids for w, ids in new.items() if len(w) > KNOWN_BYTES}
        return [b"".join(map(known.__getitem__, pieces)) for pieces in split]

    def decode(self, docs: list[list[int] | None]) -> list[str]:
        """The texts of lists of ids, by one ordered aggregation."""
        if not self.con.execute("SELECT count(*) FROM duckdb_tables() WHERE table_name = 'vocabulary'").fetchall()[0][0]:
            vocab, signs = self.vocabulary
            known = [(i, bytes(signs[s] for s in word)) for word, i in vocab.items() if all(s in signs for s in word)]
            self.con.register("v", pa.table({"id": pa.array([i for i, _ in known], pa.int32()), "bytes": pa.array([b for _, b in known], pa.binary())}))
            self.con.execute("CREATE TABLE vocabulary AS SELECT * FROM v")
            self.con.unregister("v")
        sizes = np.fromiter((len(ids or ()) for ids in docs), np.int64, len(docs))
        flat = np.fromiter((i for ids in docs for i in ids or ()), np.int32, int(sizes.sum()))
        place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.con.register("coded", pa.table({"doc": np.repeat(np.arange(len(docs), dtype=np.int32), sizes), "pos": place.astype(np.int32), "id": flat}))
        got = dict(self.con.execute(_DECODE_SQL).fetchall())
        self.con.unregister("coded")
        return [bytes.fromhex(got.get(d, "")).decode("utf-8", "replace") for d in range(len(docs))]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file, made once."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode_texts(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str = f"{TOKENIZER_DIR}/byte_bpe_50k.json") -> DataFrame:
    """``<key>, ids``: the token ids of every row's text, without special tokens, whose
    strings in a text are ordinary text. Null and empty texts get an empty list; a
    null key stays null; repeated rows are encoded each; a text of any length is
    encoded whole. Unpaired surrogates, which UTF-8 can't hold, encode as ``?``.

    One pass, no shuffle. Each worker splits its rows' texts into words, sends the
    words it hasn't met through the recursive query of its own DuckDB, and puts
    texts together from the encoded words.
    """
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from gleanframe.llm import tokenize

        own = tokenize.encoder(path)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                ids = own.encode(batch.column(1).to_pylist())
                sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
                flat = np.frombuffer(b"".join(ids), np.int32)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[key, "ids"])

    return documents.select(F.col(key), F.col(text).alias("_t")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode_ids(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", path: str = f"{TOKENIZER_DIR}/byte_bpe_50k.json") -> DataFrame:
    """``<key>, text``: the texts back from lists of ids; null lists give empty texts,
    ids outside the vocabulary are left out."""
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from gleanframe.llm import tokenize

        own = tokenize.encoder(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.decode(batch.column(1).to_pylist()), pa.string())], names=[key, "text"])

    return encoded.select(F.col(key), F.col(ids).alias("_i")).mapInArrow(run, f"`{key}` {kind}, text string")
