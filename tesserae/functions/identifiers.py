"""Entity ids, prefixes, patterns and predicates as column expressions (operators P1 to P7, S9, S10)."""

from __future__ import annotations

import base64
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

PARTS, MAX_ID_BYTES, MAX_SEGMENT_BYTES, MAX_PREDICATE_BYTES = 6, 256, 64, 194
SEGMENT = "[A-Za-z0-9][A-Za-z0-9_-]*"
KEBAB = "[a-z][a-z0-9]*(-[a-z0-9]+)*"


def entity_id_reason(c: Column) -> Column:
    """Null for a valid entity id; else the first rule that it breaks."""
    parts = F.split(c, r"\.")
    return (
        F.when(c.isNull() | (c == ""), "empty")
        .when(F.octet_length(c) > MAX_ID_BYTES, "bytes")
        .when(F.size(parts) != PARTS, "arity")
        .when(F.exists(parts, lambda p: p == ""), "empty_segment")
        .when(F.exists(parts, lambda p: ~p.rlike("^[A-Za-z0-9]")), "first_byte")
        .when(F.exists(parts, lambda p: ~p.rlike(f"^{SEGMENT}$")), "alphabet")
    )


def valid_entity_id(c: Column) -> Column:
    # Written out, and with quantifiers that give nothing back, as edges are tested row by row.
    return F.coalesce(c.rlike("^" + r"\.".join([f"{SEGMENT}+"] * PARTS) + "$") & (F.octet_length(c) <= MAX_ID_BYTES), F.lit(False))


def predicate_reason(c: Column) -> Column:
    """Null for a valid predicate (three lower-kebab segments); else the first rule that it breaks."""
    parts = F.split(c, r"\.")
    return (
        F.when(c.isNull() | (c == ""), "empty")
        .when(F.octet_length(c) > MAX_PREDICATE_BYTES, "length")
        .when(F.size(parts) != 3, "arity")
        .when(F.exists(parts, lambda p: p == ""), "segment_empty")
        .when(F.exists(parts, lambda p: F.octet_length(p) > MAX_SEGMENT_BYTES), "segment_length")
        .when(F.exists(parts, lambda p: ~p.rlike(f"^{KEBAB}$")), "segment_grammar")
    )


def valid_prefix(text: str) -> bool:
    return bool(re.fullmatch(rf"{SEGMENT}(\.{SEGMENT}){{0,{PARTS - 1}}}", text)) and len(text.encode()) <= MAX_ID_BYTES


def valid_pattern(text: str) -> bool:
    return bool(re.fullmatch(rf"(\*|{SEGMENT})(\.(\*|{SEGMENT})){{{PARTS - 1}}}", text))


def under_prefix(c: Column, prefix: str) -> Column:
    """Whether an id is the prefix or lies below it; the bound is a dot, so `docs` isn't under `doc`."""
    return (c == prefix) | c.startswith(f"{prefix}.")


def in_scope(c: Column, prefixes: list[str] | None) -> Column:
    """Under any of the prefixes. No prefix, or an empty one, means all; a malformed one means none."""
    wanted = [p for p in prefixes or [] if p]
    if len(wanted) < len(prefixes or []) or not wanted:
        return F.lit(True)
    if not all(map(valid_prefix, wanted)):
        return F.lit(False)
    return reduce(lambda a, b: a | b, (under_prefix(c, p) for p in wanted))


def matches_pattern(c: Column, pattern: str) -> Column:
    """Segment by segment; `*` stands for any one segment."""
    if not valid_pattern(pattern):
        return F.lit(False)
    parts = F.split(c, r"\.")
    fixed = [parts[i] == p for i, p in enumerate(pattern.split(".")) if p != "*"]
    return reduce(lambda a, b: a & b, fixed, F.size(parts) == PARTS)


def subject_regex(pattern: str) -> str:
    """A dotted subject pattern, `*` for one token and a last `>` for one or more, as a regular expression."""
    tokens = pattern.split(".")
    body = [r"[^.]+" if t == "*" else r".+" if t == ">" and i == len(tokens) - 1 else re.escape(t) for i, t in enumerate(tokens)]
    return "^" + r"\.".join(body) + "$"


def level_prefix(c: Column, segments: int) -> Column:
    return F.substring_index(c, ".", segments)


def is_sibling(a: Column, b: Column) -> Column:
    """Same type, another instance."""
    return valid_entity_id(a) & valid_entity_id(b) & (level_prefix(a, 5) == level_prefix(b, 5)) & (a != b)


def is_relationship(kind: Column, text: Column, datatype: Column) -> Column:
    """A statement is an edge if its object is a string shaped like an entity id and no other datatype is declared."""
    return (kind == "string") & F.coalesce(datatype, F.lit("")).isin("", "@id") & valid_entity_id(text)


def number_text(x: Column) -> Column:
    """A number without an exponent and without a trailing `.0`."""
    plain = x.cast("string")
    wide = F.regexp_replace(F.regexp_replace(x.cast("decimal(38,18)").cast("string"), "0+$", ""), r"\.$", "")
    return F.when((x == F.floor(x)) & (F.abs(x) < 9e15), x.cast("long").cast("string")).when(plain.contains("E"), wide).otherwise(plain)


def encode_cursor(last_key: str) -> str:
    return base64.urlsafe_b64encode(last_key.encode()).decode().rstrip("=")


def decode_cursor(cursor: str) -> str:
    return base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)).decode()
