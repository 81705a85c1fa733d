"""Stable identities and content hashes as Catalyst expressions; everything else joins on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def encode_parts(*parts: Column) -> Column:
    """Length-prefixed concatenation, so that no two lists of parts share an encoding."""
    return F.concat(*[x for p in parts for x in (F.octet_length(p).cast("string"), F.lit(":"), p)])


def canonical_key(kind: Column, system: Column, scope: Column, source_id: Column) -> Column:
    return encode_parts(kind, system, F.coalesce(scope, F.lit("")), source_id)


def canonical_id(key: Column) -> Column:
    """A version-8 UUID from the SHA-256 of a key."""
    h = F.sha2(key, 256)
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-8"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12)
    )


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def relationship_key(from_id: Column, type_: Column, to_id: Column, valid_from: Column) -> Column:
    return encode_parts(F.lit("relationship"), from_id, type_, to_id, valid_from)


def evidence_key(subject: Column, field: Column, statement: Column, method: Column, producer: Column, version: Column, system: Column, source_id: Column, locator: Column) -> Column:
    blank = F.lit("")
    return encode_parts(F.lit("evidence"), subject, F.coalesce(field, blank), F.coalesce(statement, blank), method, producer, version, system, F.coalesce(source_id, blank), F.coalesce(locator, blank))


def code_symbol_id(repository: Column, path: Column, qualified_name: Column, overload: Column) -> Column:
    """Identity of a declaration in a file; ``overload`` counts from 0 among equal names."""
    name = F.concat(qualified_name, F.when(overload > 0, F.concat(F.lit("#"), overload.cast("string"))).otherwise(""))
    return canonical_id(canonical_key(F.lit("code_symbol"), F.lit("code"), F.concat_ws(":", repository, path), name))


def git_content_hash(oid: Column) -> Column:
    return F.concat(F.lit("git-blob:"), F.lower(oid))
