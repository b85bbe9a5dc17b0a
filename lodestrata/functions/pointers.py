"""Pointer documents: the small JSON that stands in for an object and names its blob."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.schemas import POINTER

FIELDS = POINTER.fieldNames()
PARSED = T.StructType([T.StructField("pointer", POINTER), T.StructField("error", T.StringType())])


def pointer_error(blob_bucket: Column, blob_key: Column, digest: Column, size: Column) -> Column:
    """The first rule that a pointer breaks, or null."""
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    return (
        F.when(blank(blob_bucket), "blob_bucket is empty")
        .when(blank(blob_key), "blob_key is empty")
        .when(blank(digest), "hash is empty")
        .when(F.coalesce(size, F.lit(0)) < 0, "size is negative")
    )


def render_pointer(blob_bucket: Column, blob_key: Column, digest: Column, size: Column, content_type: Column | None = None) -> Column:
    """Compact JSON in declared order, content_type left out if empty; null for an invalid pointer."""
    kind = F.nullif(content_type, F.lit("")) if content_type is not None else F.lit(None).cast("string")
    body = F.to_json(F.struct(blob_bucket.alias("blob_bucket"), blob_key.alias("blob_key"), digest.alias("hash"), size.cast("long").alias("size"), kind.alias("content_type")))
    return F.when(pointer_error(blob_bucket, blob_key, digest, size).isNull(), body)


def dump_pointer(pointer: dict) -> str:
    """The same document outside a plan, for the action stage."""
    error = error_of(pointer)
    if error:
        raise ValueError(error)
    body = {k: pointer[k] for k in FIELDS if k != "content_type" or pointer.get(k)}
    return json.dumps(body, separators=(",", ":"), ensure_ascii=False)


def error_of(pointer: dict) -> str | None:
    for name in ("blob_bucket", "blob_key", "hash"):
        if not pointer.get(name):
            return f"{name} is empty"
    return "size is negative" if pointer.get("size", 0) < 0 else None


def load_pointer(body: str | bytes | None) -> dict:
    """Strict reading: an object with known fields of the right types, valid as a pointer.

    Names are case-sensitive; what follows the first document is not read.
    """
    try:
        text = body.decode() if isinstance(body, bytes) else body or ""
        found, _ = json.JSONDecoder().raw_decode(text.lstrip())
    except (ValueError, UnicodeDecodeError):
        raise ValueError("not a JSON document") from None
    if not isinstance(found, dict):
        raise ValueError("not a JSON object")
    for name, value in found.items():
        if name not in FIELDS:
            raise ValueError(f"unknown field {name!r}")
        if value is not None and (type(value) is not int if name == "size" else not isinstance(value, str)):
            raise ValueError(f"wrong type of {name!r}")
    out = {f.name: found.get(f.name) if found.get(f.name) is not None else (0 if f.name == "size" else "") for f in POINTER}
    if not -(1 << 63) <= out["size"] < 1 << 63:
        raise ValueError("wrong type of 'size'")
    if error := error_of(out):
        raise ValueError(error)
    return out


def parse_pointer(body: Column) -> Column:
    """struct(pointer, error): the strict reading, JVM-side.

    from_json alone is lenient, so the document's own fields are held against the allowed ones and
    each value's JSON type against the declared one.
    """
    text = body.cast("string")
    keys = F.json_object_keys(text)
    raw = F.from_json(text, T.MapType(T.StringType(), T.StringType()), {"mode": "PERMISSIVE"})
    value = F.from_json(text, POINTER)
    # to_json(variant) shows each value as it stands: strings keep their quotes
    variant = F.try_parse_json(text)
    kind = lambda name: F.schema_of_variant(F.try_variant_get(variant, f"$.{name}", "variant"))
    wrong = [F.when(kind(f.name).isNotNull() & ~kind(f.name).isin("VOID", "BIGINT" if f.name == "size" else "STRING"), f"wrong type of '{f.name}'") for f in POINTER]
    unknown = F.element_at(F.array_sort(F.array_except(keys, F.array(*map(F.lit, FIELDS)))), 1)
    filled = F.struct(*[F.coalesce(value[f.name], F.lit(0).cast("long") if f.name == "size" else F.lit("")).alias(f.name) for f in POINTER])
    known = F.size(F.array_except(keys, F.array(*map(F.lit, FIELDS)))) == 0
    error = (
        F.when(variant.isNull(), "not a JSON document")
        .when(keys.isNull() | raw.isNull(), "not a JSON object")
        .when(~known, F.concat(F.lit("unknown field '"), F.when(~known, unknown), F.lit("'")))
        .otherwise(F.coalesce(*wrong, pointer_error(filled["blob_bucket"], filled["blob_key"], filled["hash"], filled["size"])))
    )
    return F.struct(F.when(error.isNull(), filled).alias("pointer"), error.alias("error"))
