"""Splitting oversized items at natural boundaries by recursive bisection."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LINE_END = re.compile(r"\r\n|\n|\r")
#: Natural places inside a line, the strongest first.
_INSIDE = (re.compile(r"[.!?;。！？]\s+|[。！？]"), re.compile(r"\s+"), re.compile(r"[,)\]}、，]"))

#: A table of limits is a handful of settings; more rows than this are refused.
MAX_CONFIGS = 1000


def _boundaries(text: str, limit: int) -> tuple[list[int], list[int]]:
    """Where lines end (the cut comes after the line end), and those of them that
    end a paragraph. Where a line only fits without its line end, the place before
    the line end counts too."""
    lines, paragraphs = [], []
    start = 0
    for m in _LINE_END.finditer(text):
        a, b = m.span()
        if b - start > limit and a > start:
            lines.append(a)
        if a == start and lines:
            paragraphs.append(b)
        lines.append(b)
        start = b
    return lines, paragraphs


def _nearest(places: list[int], lo: int, hi: int, middle: int) -> int | None:
    """The place strictly between lo and hi that is nearest to the middle."""
    a, b = bisect_right(places, lo), bisect_left(places, hi)
    if a >= b:
        return None
    k = bisect_left(places, middle, a, b)
    near = [places[j] for j in (k - 1, k) if a <= j < b]
    return min(near, key=lambda p: (abs(p - middle), p))


def _inside(text: str, lo: int, hi: int) -> int:
    """A cut within a line: after a sentence, a blank or a closing sign in the
    middle half, else at the midpoint itself (but never between CR and LF)."""
    middle, quarter = (lo + hi) // 2, (hi - lo) // 4
    a, b = max(lo + 1, lo + quarter), min(hi - 1, hi - quarter)
    for pattern in _INSIDE:
        found = [m.end() for m in pattern.finditer(text, a, b)]
        found = [p for p in found if lo < p < hi]
        if found:
            return min(found, key=lambda p: (abs(p - middle), p))
    if text[middle - 1 : middle + 1] == "\r\n" and middle - 1 > lo:
        middle -= 1
    return middle


def plan_pieces(text: str, max_chars: int, chunk_overlap: int) -> list[tuple[int, int, int, str]]:
    """``(start, body, end, cut)`` of each piece: the body runs from ``body`` to
    ``end``, the overlap from ``start`` to ``body``; ``cut`` tells how the piece was
    parted from the one before: ``start``, ``line_end`` or ``inside_line``."""
    overlap = min(max(chunk_overlap, 0), max_chars // 2)
    lines, paragraphs = _boundaries(text, max_chars)
    bodies: list[tuple[int, int, str]] = []
    todo = [(0, len(text), "start")]
    while todo:
        lo, hi, kind = todo.pop()
        if hi - lo <= max_chars - overlap:
            bodies.append((lo, hi, kind))
            continue
        middle, quarter = (lo + hi) // 2, (hi - lo) // 4
        at = _nearest(paragraphs, lo + quarter, hi - quarter, middle)
        if at is None:
            at = _nearest(lines, lo, hi, middle)
        how = "line_end"
        if at is None:
            if hi - lo <= max_chars:  # one whole line: it keeps a shorter overlap instead of a cut
                bodies.append((lo, hi, kind))
                continue
            at, how = _inside(text, lo, hi), "inside_line"
        todo.append((at, hi, how))
        todo.append((lo, at, kind))
    pieces = []
    before = 0
    for k, (lo, hi, kind) in enumerate(bodies):
        start = lo
        if k and overlap:
            start = max(before, lo - min(overlap, max_chars - (hi - lo)))
            at = bisect_left(lines, start)
            if start < lo and at < len(lines) and lines[at] < lo:
                start = lines[at]  # from a line's beginning, if there is one in reach
            elif start < lo and text[start - 1 : start + 1] == "\r\n":
                start += 1
        pieces.append((start, lo, hi, kind))
        before = lo
    return pieces


def split_oversized(
    items: DataFrame,
    configs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    with_text: bool = True,
) -> DataFrame:
    """Pieces of every item that is longer than a config's ``max_chars``.

    Output: ``config_id, <key>, piece_no, start, body_start, end, cut`` and, with
    ``with_text``, ``piece``. Offsets count Unicode characters. Pieces follow each
    other without a gap: bodies joined give back the text. No piece is longer than
    ``max_chars``; each begins with up to ``chunk_overlap`` characters of the one
    before (less where a whole line needs the room, and where a line begins within
    reach). An overlap of more than half the limit counts as half of it.

    The text is cut at the strongest boundary near its midpoint: a blank line in the
    middle half, else the line end nearest to the midpoint, and only a line that is
    itself too long is cut inside, at a sentence, a blank or a closing sign where
    there is one. Halves that are still too long are cut again.

    A config with null or non-positive ``max_chars`` has no limit and gives no rows;
    a null overlap is 0. Null and empty texts and items that fit give no rows. A row
    with a null key is cut like any other. Repeated rows give repeated pieces: drop
    them before, or aggregate after. Configs are settings: up to ``MAX_CONFIGS``
    distinct rows are read by the driver, more raise an error.

    One pass over the items, without a shuffle; short texts never reach Python.
    """
    limits = (
        configs.where("max_chars > 0 AND config_id IS NOT NULL")
        .select(
            F.col("config_id").cast("bigint").alias("c"),
            F.col("max_chars").cast("bigint").alias("m"),
            F.coalesce(F.col("chunk_overlap"), F.lit(0)).cast("bigint").alias("o"),
        )
        .distinct()
        .limit(MAX_CONFIGS + 1)
        .collect()
    )
    if len(limits) > MAX_CONFIGS:
        raise ValueError(f"more than {MAX_CONFIGS} configs")
    rules = sorted((r.c, r.m, r.o) for r in limits)
    key_type = items.schema[key].dataType.simpleString()
    schema = f"config_id bigint, `{key}` {key_type}, piece_no bigint, start bigint, body_start bigint, end bigint, cut string"
    schema += ", piece string" if with_text else ""
    shortest = min((m for _, m, _ in rules), default=None)
    source = items.select(F.col(key).alias("k"), F.col(text).alias("t"))
    source = source.where(F.lit(False)) if shortest is None else source.where(F.length("t") > shortest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            take: list[int] = []
            cols: list[list] = [[] for _ in range(6)]
            pieces: list[str] = []
            for row, t in enumerate(texts):
                n = len(t)
                for c, m, o in rules:
                    if n <= m:
                        continue
                    for no, (start, body, end, cut) in enumerate(plan_pieces(t, m, o)):
                        take.append(row)
                        for col, v in zip(cols, (c, no, start, body, end, cut)):
                            col.append(v)
                        if with_text:
                            pieces.append(t[start:end])
            out = [
                pa.array(cols[0], pa.int64()),
                keys.take(pa.array(take, pa.int64())),
                *(pa.array(col, pa.int64()) for col in cols[1:5]),
                pa.array(cols[5], pa.string()),
            ]
            names = ["config_id", key, "piece_no", "start", "body_start", "end", "cut"]
            if with_text:
                out.append(pa.array(pieces, pa.string()))
                names.append("piece")
            yield pa.RecordBatch.from_arrays(out, names=names)

    return source.mapInArrow(run, schema)


def oversized_cuts(pieces: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per config and item from its pieces: ``inside_line`` if any piece had
    to be parted inside a line, else ``line_end``."""
    return pieces.groupBy("config_id", key).agg(
        F.when(F.max(F.col("cut") == "inside_line"), "inside_line").otherwise("line_end").alias("cut")
    )
