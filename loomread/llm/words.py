"""Helpers that several operators share: word splitting and Arrow columns."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: bytes.translate table that lowers A-Z only.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def lowered_words(text: str | bytes | None) -> list[bytes]:
    """Runs of bytes other than space and \\x09-\\x0D of the text with A-Z lowered; none for null."""
    if text is None:
        return []
    return (text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass")).translate(LOWER).split()


def with_columns(batch: pa.RecordBatch, drop: set[str], new: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    """The batch's columns (by position, so that clashing names do no harm) but ``drop``, then ``new`` ones, as ``schema``."""
    kept = [c for c, n in zip(batch.columns, batch.schema.names) if n not in drop]
    kept += [pa.array(v, schema.field(i + len(kept)).type) for i, v in enumerate(new.values())]
    return pa.RecordBatch.from_arrays([c if c.type == f.type else c.cast(f.type) for c, f in zip(kept, schema)], schema=schema)


def extended(schema: T.StructType, new: str, drop: set[str] = frozenset()) -> tuple[T.StructType, pa.Schema]:
    """``schema`` without ``drop`` and the names of ``new`` (a DDL string), then the fields of ``new``; also as Arrow."""
    add = T.StructType.fromDDL(new)
    full = T.StructType([f for f in schema.fields if f.name not in drop | set(add.names)] + add.fields)
    return full, to_arrow_schema(full)
