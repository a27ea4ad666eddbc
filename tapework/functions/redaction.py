"""Removing keys that mustn't leave from columns of any type: structs, arrays, maps, VARIANT values, and JSON inside text.

What the schema shows is rebuilt without those keys by Spark's own functions. Texts go to Python in Arrow batches, each column with the
type it has, all columns together and a few MB at a time; only texts that may name such a key are looked into there.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from json.encoder import encode_basestring

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import slices

# Keys that never leave, at any depth; so does every key that ends in _path.
SENSITIVE_KEYS = {"api_key", "authorization", "volc_access_token", "access_token", "current_video", "render_source_video"}
ENDING = "_path"
_NAMES = "|".join(sorted(SENSITIVE_KEYS))
#: A text without such a name, plain or with escapes, has nothing to remove.
_MAY_NAME = f"(?i){_NAMES}|{ENDING}|\\\\u"
#: Broken JSON that still shows such a key.
_SHOWS_KEY = re.compile(rf'"(?:{_NAMES}|[^"\\]*{ENDING})\\*"\s*:', re.IGNORECASE)


def allowed(name: str) -> bool:
    """Whether values under this key may leave."""
    name = name.lower()
    return name not in SENSITIVE_KEYS and not name.endswith(ENDING)


class _Number(str):
    """A number as it is written."""


def _refuse(name: str) -> None:
    raise ValueError(name)


_DECODER = json.JSONDecoder(object_pairs_hook=tuple, parse_float=_Number, parse_int=_Number, parse_constant=_refuse)


def _write(value: object, removed: list[bool]) -> str:
    """The value as JSON without the keys that mustn't leave; removed gets an entry for each that is left out, also from JSON inside strings."""
    if isinstance(value, tuple):  # the pairs of an object
        kept = [(k, v) for k, v in value if allowed(k)]
        if len(kept) < len(value):
            removed.append(True)
        return "{" + ",".join([f"{encode_basestring(k)}:{_write(v, removed)}" for k, v in kept]) + "}"
    if isinstance(value, list):
        return "[" + ",".join([_write(v, removed) for v in value]) + "]"
    if isinstance(value, _Number):
        return str(value)
    if isinstance(value, str):
        clean = clean_text(value) if '"' in value else value  # without quotes there is no key in it
        if clean != value:
            removed.append(True)
        return "null" if clean is None else encode_basestring(clean)
    return "null" if value is None else "true" if value else "false"


def clean_text(text: str) -> str | None:
    """The text; JSON without the keys that mustn't leave, at every depth and also in JSON inside its strings.

    Text that has nothing to remove stays as it is, JSON or not. Text that isn't readable JSON but shows such a key is dropped (None); so
    is JSON nested too deep to be read.
    """
    if text.lstrip()[:1] not in ("{", "[", '"'):
        return None if _SHOWS_KEY.search(text) else text
    try:
        removed: list[bool] = []
        clean = _write(_DECODER.decode(text.strip().removeprefix("﻿")), removed)
        return clean if removed else text
    except (ValueError, RecursionError):
        return None if _SHOWS_KEY.search(text) else text


def _clean_strings(texts: pa.Array) -> pa.Array:
    suspect = pc.fill_null(pc.match_substring_regex(texts, _MAY_NAME), False)
    if not pc.any(suspect).as_py():
        return texts
    cleaned = pa.array([None if t is None else clean_text(t) for t in texts.filter(suspect).to_pylist()], texts.type)
    return pc.replace_with_mask(texts, suspect, cleaned)


def clean_array(values: pa.Array) -> pa.Array:
    """An Arrow array of any type with all texts in it cleaned."""
    kind = values.type
    if pa.types.is_string(kind) or pa.types.is_large_string(kind):
        return _clean_strings(values)
    if pa.types.is_struct(kind):
        return pa.StructArray.from_arrays([clean_array(c) for c in values.flatten()], fields=list(kind), mask=values.is_null())
    if pa.types.is_list(kind) or pa.types.is_map(kind):
        listed = values if pa.types.is_list(kind) else values.cast(pa.list_(pa.struct([pa.field("key", kind.key_type, False), pa.field("value", kind.item_type)])))
        sizes = pc.list_value_length(listed)
        ends = np.concatenate([[0], np.cumsum(pc.fill_null(sizes, 0).to_numpy())])
        offsets = pa.array(ends, pa.int32(), mask=np.append(sizes.is_null().to_numpy(zero_copy_only=False), False))
        inner = listed.flatten()
        if pa.types.is_list(kind):
            return pa.ListArray.from_arrays(offsets, clean_array(inner), kind)
        return pa.MapArray.from_arrays(offsets, inner.field("key"), clean_array(inner.field("value")), kind)
    return values


def _holds(kind: T.DataType, wanted: type) -> bool:
    if isinstance(kind, T.StructType):
        return any(_holds(f.dataType, wanted) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _holds(kind.elementType, wanted)
    if isinstance(kind, T.MapType):
        return _holds(kind.valueType, wanted)
    return isinstance(kind, wanted)


def _walk(value: Column, kind: T.DataType, leaf) -> Column:
    """The value rebuilt: keys that mustn't leave are left out, and leaf(value, type) is put for what holds nothing further."""
    if isinstance(kind, T.StructType):
        kept = F.struct(*[_walk(value[f.name], f.dataType, leaf).alias(f.name) for f in kind.fields if allowed(f.name)])
        return F.when(value.isNotNull(), kept)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _walk(x, kind.elementType, leaf))
    if isinstance(kind, T.MapType):
        name = lambda k: F.lower(k.cast("string"))
        safe = F.map_filter(value, lambda k, _: ~name(k).isin(*SENSITIVE_KEYS) & ~name(k).endswith(ENDING))
        return F.transform_values(safe, lambda _, v: _walk(v, kind.valueType, leaf))
    return leaf(value, kind)


def _shape(kind: T.DataType, text: bool) -> T.DataType:
    """The type without the keys that mustn't leave, and with text in the place of VARIANT where that is asked for."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _shape(f.dataType, text)) for f in kind.fields if allowed(f.name)])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_shape(kind.elementType, text))
    if isinstance(kind, T.MapType):
        return T.MapType(kind.keyType, _shape(kind.valueType, text))
    return T.StringType() if text and isinstance(kind, T.VariantType) else kind


def _cleaned(value: Column, kind: T.DataType) -> Column:
    """A column of this type without the keys that mustn't leave; in the place of VARIANT values it has their cleaned JSON."""
    as_text = lambda v, k: F.to_json(v) if isinstance(k, T.VariantType) else v

    @F.arrow_udf(_shape(kind, text=True))
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for values in batches:
            yield pa.concat_arrays([clean_array(some) for some in slices(values)])

    return clean.asNondeterministic()(_walk(value, kind, as_text))


def redacted_columns(df: DataFrame, columns: list[tuple[Column, T.DataType]]) -> tuple[DataFrame, list[Column]]:
    """A table of df's rows, and the columns in it that are these without the keys that mustn't leave. A VARIANT is cleaned as its JSON and read again.

    All that holds texts goes to Python together, so that a task has one Python worker, however many columns there are.
    """
    read = {k: kind for k, (_, kind) in enumerate(columns) if _holds(kind, (T.StringType, T.VariantType))}
    given = [value.alias(f"g{k}") for k, (value, _) in enumerate(columns)]
    if read:
        together = T.StructType([T.StructField(f"c{k}", kind) for k, kind in read.items()])
        given.append(_cleaned(F.struct(*[columns[k][0].alias(f"c{k}") for k in read]), together).alias("clean"))
    out = []
    for k, (_, kind) in enumerate(columns):
        value = F.col(f"clean.c{k}") if k in read else _walk(F.col(f"g{k}"), kind, lambda v, _: v)
        out.append(_walk_back(value, _shape(kind, text=False)) if _holds(kind, T.VariantType) else value)
    return df.select(*given), out


def _walk_back(value: Column, kind: T.DataType) -> Column:
    # Most parts of a record are empty, and reading JSON costs much for each text, however short.
    empty = lambda v, text, other: F.when(v == text, F.parse_json(F.lit(text))).otherwise(other)
    return _walk(value, kind, lambda v, k: empty(v, "[]", empty(v, "{}", F.try_parse_json(v))) if isinstance(k, T.VariantType) else v)
