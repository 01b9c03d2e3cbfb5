"""Text form of results: each value followed by ``|``, one row a line.

Floats print as the shortest decimal that reads back, never with an exponent and always with a
fraction. Strings are raw.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrel.functions.types import F32, F64, tag_of


def format_float(x: float, single: bool = False) -> str:
    if math.isnan(x):
        return "NaN.0"
    if math.isinf(x):
        return "inf.0" if x > 0 else "-inf.0"
    text = format(Decimal(str(np.float32(x)) if single else repr(float(x))), "f")
    return text if "." in text else f"{text}.0"


def to_row_text(df: DataFrame) -> DataFrame:
    """One column ``value`` with a line per row, in the frame's order. Null prints as nothing."""
    tags = [tag_of(f.dataType) for f in df.schema]
    if not tags:
        raise ValueError("a row without columns has no text")

    ids = df.toDF(*[f"c{n}" for n in range(len(tags))])
    floats = [n for n, tag in enumerate(tags) if tag in (F32, F64)]
    if not floats:
        parts = [x for n in range(len(tags)) for x in (F.coalesce(F.col(f"c{n}").cast("string"), F.lit("")), F.lit("|"))]
        return ids.select(F.concat(*parts).alias("value"))

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            columns = []
            for n, tag in enumerate(tags):
                values = batch.iloc[:, n]
                columns.append(values if n not in floats else ["" if gone else format_float(v, tag == F32) for v, gone in zip(values, batch[f"n{n}"], strict=True)])
            yield pd.DataFrame({"value": ["".join(f"{v}|" for v in row) for row in zip(*columns, strict=True)]})

    # Only floats need more than a cast; a null goes as a mark beside them, since pandas takes it for NaN.
    sent = [F.col(f"c{n}") if n in floats else F.coalesce(F.col(f"c{n}").cast("string"), F.lit("")).alias(f"c{n}") for n in range(len(tags))]
    return ids.select(*sent, *[F.col(f"c{n}").isNull().alias(f"n{n}") for n in floats]).mapInPandas(lines, "value string")


def protocol_lines(df: DataFrame) -> Iterator[str]:
    """The lines that a validator reads: a header, the rows one partition at a time, an end mark."""
    yield "validate"
    for row in to_row_text(df).toLocalIterator():
        yield row.value
    yield "!"
