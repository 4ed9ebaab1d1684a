"""Content-derived identities as native expressions: length-prefixed fields, domain hashes and stable ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The namespace of hashed identities. A store that must share ids with another system sets its own.
NAMESPACE = "factloom"


def field(value: Column) -> Column:
    """``<bytes>:<value>``: a text field that no other split of the same bytes can imitate."""
    text = value.cast("string")
    return F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)


def fields(*values: Column) -> Column:
    return F.concat(*[field(v) for v in values])


def field_list(values: Column) -> Column:
    """The fields of an array of strings, in its order."""
    return F.array_join(F.transform(values, field), "")


def binary_field(value: Column) -> Column:
    """An 8-byte big-endian length and the bytes."""
    raw = value.cast("binary")
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(raw).cast("long")), 16, "0")), raw)


def stable_id(kind: str, content: Column) -> Column:
    """``<kind>:sha256:<64 hex digits>`` of the content."""
    return F.concat(F.lit(f"{kind}:sha256:"), F.sha2(content.cast("binary"), 256))


def is_stable_id(value: Column, kind: str) -> Column:
    return F.coalesce(value.rlike(f"^{kind}:sha256:[0-9a-f]{{64}}\\z"), F.lit(False))


def domain_hash(domain: str, content: Column) -> Column:
    """SHA-256 of the domain, a zero byte and the content, as hex."""
    return F.sha2(F.concat(F.lit(domain.encode() + b"\0"), content.cast("binary")), 256)


def set_hash(values: Column, prefix: str) -> Column:
    """SHA-256 of the sorted, length-prefixed fields of an array."""
    return F.sha2(F.concat(field(F.lit(prefix)), field_list(F.array_sort(values))), 256)


def base_fact_id(relation: Column, columns: Column, epistemic: Column, summary: Column, anchor: Column, provenance: Column) -> Column:
    head = fields(F.lit(f"{NAMESPACE}.fact.base.v1"), relation)
    return stable_id("fact", F.concat(head, field_list(columns), fields(epistemic, summary, anchor, provenance)))


def derived_fact_id(relation: Column, columns: Column, epistemic: Column, rule: Column, inputs: Column) -> Column:
    head = fields(F.lit(f"{NAMESPACE}.fact.derived.v1"), relation)
    return stable_id("fact", F.concat(head, field_list(columns), fields(epistemic, rule), field_list(F.array_sort(inputs))))


def key_of(*values: Column) -> Column:
    """Values joined by the unit separator."""
    return F.concat_ws("\x1f", *values)


def digest_bytes(text: Column) -> Column:
    """The 32 bytes of 64 hex digits of either case; null for anything else."""
    return F.when(text.rlike(r"^[0-9a-fA-F]{64}\z"), F.unhex(text))


def digest_text(raw: Column) -> Column:
    return F.lower(F.hex(raw))


def parse_id(value: Column) -> Column:
    """kind and digest of a stable id; both null for anything else."""
    form = r"^([a-z]+):sha256:([0-9a-f]{64})\z"
    part = lambda i: F.when(value.rlike(form), F.regexp_extract(value, form, i))
    return F.struct(part(1).alias("kind"), part(2).alias("digest"))


def strict_integer(text: Column) -> Column:
    """The value of a decimal without spaces, plus sign, leading zeros or overflow; null for anything else."""
    return F.when(text.rlike(r"^(0|-?[1-9][0-9]*)\z"), text.try_cast("long"))


def sorted_joined(values: Column, separator: str) -> Column:
    """The distinct values of an array in order, joined."""
    return F.array_join(F.array_sort(F.array_distinct(values)), separator)
