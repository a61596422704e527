"""Pieces the operators of this subpackage share."""

from __future__ import annotations

import hashlib
import json
import re

#: A word or term: a longest run of Unicode letters and digits.
WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """The words of a text in order, lower-cased. Null has none."""
    return [w.lower() for w in WORD.findall(text)] if text else []


def squeeze(text: str) -> str:
    """Letters and digits only, lower-cased."""
    return "".join(WORD.findall(text)).lower()


class _Number(str):
    """A number as it is written."""


def _shape(value) -> str:
    """A canonical string of a parsed JSON value: names sorted, lists in order,
    every name and value squeezed."""
    if isinstance(value, _Object):
        return "{" + ",".join(sorted(f"{squeeze(k)}:{_shape(v)}" for k, v in value.pairs)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_shape, value)) + "]"
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    return squeeze(value)


class _Object:
    __slots__ = ("pairs",)

    def __init__(self, pairs):
        self.pairs = pairs


_DECODER = json.JSONDecoder(object_pairs_hook=_Object, parse_float=_Number, parse_int=_Number, parse_constant=_Number)


def parse_object(text: str):
    """The text as a JSON object with its pairs in order, or None."""
    body = text.strip().lstrip("﻿").strip()
    if not body.startswith("{") or not body.endswith("}"):
        return None
    try:
        value = _DECODER.decode(body)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, _Object) else None


def canonical_text(text: str | None) -> str | None:
    """What two items must share to be copies of each other; None: no letters or
    digits, never a copy. A JSON object is compared by its fields, any other text
    by its sequence of letters and digits."""
    if not text:
        return None
    plain = squeeze(text)
    if not plain:
        return None
    value = parse_object(text)
    if value is not None:
        try:
            return "o" + _shape(value)
        except RecursionError:
            pass
    return "t" + plain


_PART = re.compile(r"[;|\r\n]+")
_SIGN = re.compile(r"[=:]")


def canonical_fields(body: str | None) -> str | None:
    """The same for a flat record: a JSON object, or name/value pairs with ``=`` or
    ``:`` parted by ``;``, ``|`` or line ends. A body of neither form is compared
    as a text."""
    if not body:
        return None
    plain = squeeze(body)
    if not plain:
        return None
    value = parse_object(body)
    if value is not None:
        try:
            return "f" + ",".join(sorted(f"{squeeze(k)}:{_shape(v)}" for k, v in value.pairs))
        except RecursionError:
            return "t" + plain
    parts = [p for p in _PART.split(body) if p.strip()]
    pairs = [_SIGN.split(p, maxsplit=1) for p in parts]
    if pairs and all(len(p) == 2 for p in pairs):
        return "f" + ",".join(sorted(f"{squeeze(k)}:{squeeze(v)}" for k, v in pairs))
    return "t" + plain


def digest16(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
