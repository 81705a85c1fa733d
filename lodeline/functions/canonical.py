"""Canonical forms of values that several writers spell differently."""

from __future__ import annotations

import hashlib
import json
import unicodedata
from decimal import Decimal, InvalidOperation

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _number(text: str):
    try:
        value = Decimal(text)
    except InvalidOperation:
        return text
    if value.is_zero():
        return 0
    sign, digits, exponent = value.as_tuple()  # exact: normalize() would round long numbers
    body = "".join(map(str, digits)).lstrip("0")
    exponent += len(body) - len(body.rstrip("0"))
    body = body.rstrip("0")
    # plain integers of ordinary length print as such; all else keeps a mantissa and an exponent
    if 0 <= exponent <= 18:
        return int(("-" if sign else "") + body + "0" * exponent)
    return {"\u0000n": f"{'-' if sign else ''}{body}e{exponent}"}


def canonical_json(text: str | None) -> str | None:
    """The same text for every spelling of one JSON value: members sorted, no spaces, equal numbers equal.

    Text that is no JSON stands for itself (with a mark, so that it equals no JSON value); null stays null.
    """
    if text is None:
        return None
    try:
        value = json.loads(text, parse_float=_number, parse_int=_big, parse_constant=lambda c: {"\u0000c": c})
        return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True)
    except (ValueError, RecursionError):
        return "\u0000" + text


def _big(text: str):
    return int(text) if len(text) < 19 else _number(text)


@F.arrow_udf(T.BinaryType())
def json_digest(texts: pa.Array) -> pa.Array:
    """First 16 bytes of the SHA-256 of the canonical JSON; null for null."""
    sha = hashlib.sha256
    out = [None if t is None else sha(canonical_json(t).encode("utf-8", "surrogatepass")).digest()[:16] for t in texts.to_pylist()]
    return pa.array(out, type=pa.binary())


def _normal(texts: pa.Array, form: str) -> pa.Array:
    # Arrow's own utf8_normalize leaves characters decomposed under NFC, so Python's tables are used, and only where needed
    if pc.all(pc.string_is_ascii(texts)).as_py() in (True, None):
        return texts
    return pa.array([t if t is None or t.isascii() else unicodedata.normalize(form, t) for t in texts.to_pylist()], type=pa.string())


@F.arrow_udf(T.StringType())
def nfc(texts: pa.Array) -> pa.Array:
    """Unicode normalisation form C."""
    return _normal(texts, "NFC")


@F.arrow_udf(T.StringType())
def nfkc(texts: pa.Array) -> pa.Array:
    """Unicode normalisation form KC."""
    return _normal(texts, "NFKC")


def repository_path(raw: Column) -> Column:
    """A path as one writer would spell it: ``/`` as separator, no ``./`` in front, composed characters."""
    slashed = F.translate(raw, "\\", "/")
    return nfc(F.regexp_replace(slashed, r"^(?:\./+)+", ""))


def full_ref(raw: Column) -> Column:
    """The full form of a ref name; a short one is the branch of that name."""
    return F.when(raw.startswith("refs/"), raw).otherwise(F.concat(F.lit("refs/heads/"), raw))
