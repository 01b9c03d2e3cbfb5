"""The five scalar kinds of the data model, plus a timestamp extension for Parquet inputs."""

from __future__ import annotations

from pyspark.sql import types as T

I32, I64, F32, F64, STRING, TS = "I32", "I64", "F32", "F64", "String", "TS"
LITERAL_TAGS = (I32, I64, F32, F64, STRING, TS)

SPARK_TYPES: dict[str, T.DataType] = {
    I32: T.IntegerType(),
    I64: T.LongType(),
    F32: T.FloatType(),
    F64: T.DoubleType(),
    STRING: T.StringType(),
    TS: T.TimestampNTZType(),
}

# Type words of schema files, and type names of catalog files.
SCHEMA_WORDS = {"I32": I32, "I64": I64, "FLOAT32": F32, "FLOAT64": F64, "STRING": STRING}
CATALOG_NAMES = {"Int32": I32, "Int64": I64, "Float32": F32, "Float64": F64, "String": STRING}

FLOATING = frozenset((F32, F64))
NUMERIC = frozenset((I32, I64, F32, F64))


def tag_of(kind: T.DataType) -> str | None:
    """The tag of a Spark type, or None for types outside the data model."""
    if isinstance(kind, T.TimestampType):
        return TS
    return next((tag for tag, t in SPARK_TYPES.items() if type(t) is type(kind)), None)


def parse_schema_word(word: str) -> str:
    try:
        return SCHEMA_WORDS[word.strip().upper()]
    except KeyError:
        raise ValueError(f"unknown column type {word!r}") from None


def catalog_name(tag: str) -> str:
    return next(name for name, t in CATALOG_NAMES.items() if t == tag)
