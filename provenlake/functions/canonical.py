"""Canonical JSON of typed values: keys in order, no spaces, non-ASCII as it is, numbers as Python writes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from . import text as T

#: The short escapes of JSON; other control characters become \\u00xx.
SHORT = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\f": "\\f", "\b": "\\b"}


def quoted(value: Column) -> Column:
    """A text as a JSON string."""
    out = value
    for char, escape in SHORT.items():  # the backslash is the first
        out = F.replace(out, F.lit(char), F.lit(escape))
    rare = out
    for code in range(0x20):
        if chr(code) not in SHORT:
            rare = F.replace(rare, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    return F.concat(F.lit('"'), F.when(value.rlike(r"[\x00-\x07\x0b\x0e-\x1f]"), rare).otherwise(out), F.lit('"'))


def float_text(value: Column) -> Column:
    """A double as Python's repr has it: an exponent below 10^-4 and from 10^16 on."""
    told = value.cast("string")
    minus = F.when(F.startswith(told, F.lit("-")), F.lit("-")).otherwise(F.lit(""))
    parts = F.split(F.ltrim(told, F.lit("-")), "E")
    mantissa, power = F.regexp_replace(parts[0], r"\.0$", ""), F.get(parts, F.lit(1)).cast("int")
    digits = F.replace(mantissa, F.lit("."), F.lit(""))
    whole = F.rpad(digits, F.greatest(power + 1, F.char_length(digits)), "0")
    tail = F.substring(whole, power + 2, F.char_length(whole))
    plain = F.concat(F.left(whole, power + 1), F.lit("."), F.when(tail == "", F.lit("0")).otherwise(tail))
    signed = F.concat(F.when(power < 0, F.lit("e-")).otherwise(F.lit("e+")), F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.char_length(F.abs(power).cast("string"))), "0"))
    written = F.when(power >= 16, F.concat(mantissa, signed)).when(power >= 0, plain).when(power == -4, F.concat(F.lit("0.000"), digits)).otherwise(F.concat(mantissa, signed))
    return F.when(told.contains("E"), F.concat(minus, written)).otherwise(told)


def json_text(value: Column, kind: S.DataType) -> Column:
    """value, of the type kind, as canonical JSON; nulls are written.  The keys of structs and maps
    stand in the order of their code points, so their order in the input changes nothing.  Dates are
    ISO texts; a type that JSON has no form for raises TypeError."""
    if isinstance(kind, S.StructType):
        parts = [F.concat(F.lit(f"{'' if k == 0 else ','}"), quoted(F.lit(f.name)), F.lit(":"), json_text(value[f.name], f.dataType)) for k, f in enumerate(sorted(kind.fields, key=lambda f: f.name))]
        out = F.when(value.isNotNull(), F.concat(F.lit("{"), *parts, F.lit("}")))
    elif isinstance(kind, S.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: json_text(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, S.MapType) and isinstance(kind.keyType, S.StringType):
        keys = F.array_sort(F.map_keys(value))
        pairs = F.transform(keys, lambda k: F.concat(quoted(k), F.lit(":"), json_text(F.element_at(value, k), kind.valueType)))
        out = F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))
    elif isinstance(kind, S.StringType):
        out = quoted(value)
    elif isinstance(kind, (S.FloatType, S.DoubleType)):
        out = float_text(value.cast("double"))
    elif isinstance(kind, (S.BooleanType, S.IntegralType)):
        out = value.cast("string")
    elif isinstance(kind, S.DateType):
        out = quoted(value.cast("string"))
    elif isinstance(kind, S.NullType):
        return F.lit("null")
    else:
        raise TypeError(f"no JSON form of {kind.simpleString()}")
    return F.coalesce(out, F.lit("null"))


def with_canonical(rows: DataFrame, columns: list[str], name: str = "canonical") -> DataFrame:
    """rows with the canonical JSON object of some columns, and its hash `<name>_hash`."""
    kind = S.StructType([rows.schema[c] for c in columns])
    return rows.withColumn(name, json_text(F.struct(*columns), kind)).withColumn(f"{name}_hash", T.text_hash(F.col(name)))
