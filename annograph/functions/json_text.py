"""JSON texts to VARIANT, whatever their size.

Texts are read as Python's json module reads them: NaN and Infinity are numbers, strings have any length, of a repeated key
the last value counts, and anything behind the document makes it unreadable. A text whose VARIANT would exceed Spark's
128 MB comes in parts: a walk along the text finds where the elements of its large arrays begin and end, and hands the
arrays on as texts of some thousand elements each, which the same JSON reader turns into the same values.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

#: Arrays that may be long; the rest of a document has to fit one VARIANT.
LONG_ARRAYS = ("points", "edges", "shapes")
#: No shorter text makes a VARIANT of 128 MB: a value takes at most eight times its text.
SPLIT_BYTES = 16 << 20
CHUNK = 4096

_OPTIONS = {"allowNonNumericNumbers": "true", "allowSingleQuotes": "false", "maxStringLen": "2147483647", "maxNumLen": "4300"}
PARTS = StructType([StructField("head", StringType()), *[StructField(name, ArrayType(StringType())) for name in LONG_ARRAYS]])


def document(raw: Column) -> Column:
    """The text as VARIANT, null where it is not one JSON value or too large for a VARIANT.

    The text is read as the first of two elements, since the reader stops at the end of a value and would not see what
    stands behind it. The second is the hash of the text, which no text holds of itself.
    """
    mark = F.xxhash64(raw)
    pair = F.from_json(F.concat(F.lit("["), raw, F.lit(","), mark.cast("string"), F.lit("]")), "variant", _OPTIONS)
    whole = (F.try_variant_get(pair, "$[1]", "bigint") == mark) & F.try_variant_get(pair, "$[2]", "variant").isNull()
    return F.when(whole, F.try_variant_get(pair, "$[0]", "variant"))


def _skip(text: str, at: int) -> int:
    while text[at : at + 1] in (" ", "\t", "\n", "\r"):
        at += 1
    return at


def _expect(text: str, at: int, mark: str) -> int:
    if text[at : at + 1] != mark:
        raise ValueError(f"{mark} expected at {at}")
    return _skip(text, at + 1)


def split(text: str) -> dict | None:
    """`PARTS` of an object's text: the object with its long arrays emptied, and their elements in texts of `CHUNK`; None if
    it is no JSON object. Elements are read one at a time and dropped, so the walk holds one element besides the texts.
    """
    read = json.JSONDecoder().raw_decode

    def elements(at: int) -> tuple[list[str], int]:
        chunks, start, n = [], at, 0
        while text[at : at + 1] != "]":
            if n:
                end, at = at, _expect(text, at, ",")
                if n % CHUNK == 0:
                    chunks.append(f"[{text[start:end]}]")
                    start = at
            at = _skip(text, read(text, at)[1])
            n += 1
        return [*chunks, f"[{text[start:at]}]"] if n else [], _skip(text, at + 1)

    values: dict[str, str] = {}
    arrays: dict[str, list[str]] = {}
    try:
        at = _expect(text, _skip(text, 0), "{")
        while text[at : at + 1] != "}":
            if values:
                at = _expect(text, at, ",")
            key, at = read(text, at)
            if not isinstance(key, str):
                raise ValueError("key expected")
            at = _expect(text, _skip(text, at), ":")
            arrays.pop(key, None)
            if key in LONG_ARRAYS and text[at : at + 1] == "[":
                arrays[key], at = elements(_skip(text, at + 1))
                values[key] = "[]"
            else:
                end = read(text, at)[1]
                values[key], at = text[at:end], _skip(text, end)
        if _skip(text, at + 1) != len(text):
            return None
    except (ValueError, RecursionError):
        return None
    head = ",".join(f"{json.dumps(k)}:{v}" for k, v in values.items())
    return {"head": f"{{{head}}}", **{name: arrays.get(name) for name in LONG_ARRAYS}}


@F.arrow_udf(PARTS)
def _split_texts(texts: pa.Array) -> pa.Array:
    lists = pa.list_(pa.string())
    kind = pa.struct([("head", pa.string()), *[(name, lists) for name in LONG_ARRAYS]])
    return pa.array([split(t.as_py()) if t.is_valid else None for t in texts], kind)


def long_parts(raw: Column, doc: Column) -> Column:
    """`PARTS` of the texts that `document` could not take because of their size, null for all others."""
    return _split_texts(F.when(doc.isNull() & (F.octet_length(raw) > SPLIT_BYTES), raw))


def long_array(parts: Column, name: str) -> Column:
    """The elements of a long array as array<variant>, null where the document has no parts or no such array."""
    return F.flatten(F.transform(parts[name], lambda text: F.try_variant_get(F.from_json(text, "variant", _OPTIONS), "$", "array<variant>")))
