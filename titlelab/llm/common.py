"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts are taken through numpy in slices of about this many characters, whatever the batch size.
SLICE_CHARS = 2_000_000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def split_number(key: str, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``; null for a null key."""
    return F.crc32(F.col(key).cast("string")) % parts


def is_part(key: str, parts: int, part: int) -> Column:
    """Whether a row is in the part; a null key is in none."""
    return F.coalesce(split_number(key, parts) == part, F.lit(False))


def hash_share(key: str, rows: int, bound: int) -> Column:
    """Keeps a share of keys, chosen by hash, so that about ``bound`` of ``rows`` rows stay."""
    if rows <= bound:
        return F.lit(True)
    return F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 30)) < int(bound / rows * (1 << 30))


def map_columns(
    df: DataFrame,
    inputs: list[str],
    outputs: str,
    start: Callable[[], Callable[..., list]],
    keep: list[str] | None = None,
) -> DataFrame:
    """Add columns computed from Arrow batches.

    ``start`` runs once in each task and returns a function from the input arrays to one list
    (or array) for each output column. ``keep`` names the input columns that stay, all by
    default. An input column that bears the name of an output is replaced by it.
    """
    made = T.StructType.fromDDL(outputs)
    names = [c for c in (df.columns if keep is None else keep) if c not in made.names]
    read = list(dict.fromkeys([*names, *inputs]))
    schema = T.StructType([df.schema[c] for c in names] + made.fields)
    types = [_arrow_type(f.dataType) for f in made.fields]
    labels = [*names, *made.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = None
        for batch in batches:
            compute = compute or start()
            new = compute(*[batch.column(read.index(c)) for c in inputs])
            yield pa.RecordBatch.from_arrays(
                [batch.column(read.index(c)) for c in names]
                + [x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(new, types)],
                names=labels,
            )

    return df.select(*read).mapInArrow(run, schema)


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def slices(texts: list[str], most: int = SLICE_CHARS) -> Iterator[slice]:
    """Consecutive slices of about ``most`` characters each; a longer text is a slice of its own."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > most:
            yield slice(first, i)
            first, size = i, 0
        size += len(text)
    if texts:
        yield slice(first, len(texts))


def code_points(text: str):
    """The code points of a text as an array; half surrogates count as themselves."""
    import numpy as np

    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
