"""Reading catalogue, post and titles tables; writing titles, mappings and artefacts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAIN_TITLES_SCHEMA = "main_id bigint, main_name string, title string"
SUB_TITLES_SCHEMA = "main_id bigint, main_name string, sub_id bigint, sub_name string, title string"
MAPPING_SCHEMA = "main_id bigint, main_name string"

# Texts a titles file uses for "missing".
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


@dataclass
class JdbcSource:
    """Connection options from the caller, and how to split each table's read.

    ``splits`` maps a table to ``(column, lower, upper, partitions)``. A table without an
    entry would be read through one connection by one task; that is refused unless the
    table is named in ``single``.
    """

    options: dict[str, str]
    splits: dict[str, tuple[str, int, int, int]] = field(default_factory=dict)
    single: tuple[str, ...] = ()

    def read_options(self, table: str) -> dict[str, str]:
        if table not in self.splits and table not in self.single:
            raise ValueError(f"{table} has no split; name it in single to read it through one connection")
        chosen = {**self.options, "dbtable": table}
        if table in self.splits:
            column, lower, upper, partitions = self.splits[table]
            chosen |= {
                "partitionColumn": column,
                "lowerBound": str(lower),
                "upperBound": str(upper),
                "numPartitions": str(partitions),
            }
        return chosen


def read_table(spark: SparkSession, name: str, source: str | JdbcSource) -> DataFrame:
    """A table by name from a folder of parquet tables or from a database."""
    if isinstance(source, JdbcSource):
        return spark.read.format("jdbc").options(**source.read_options(name)).load()
    return spark.read.parquet(f"{source.rstrip('/')}/{name}.parquet")


def read_titles(
    spark: SparkSession, path: str, schema: str = SUB_TITLES_SCHEMA, multi_line: bool = False
) -> DataFrame:
    """Titles CSV with a header. Types are given, never inferred.

    Large files are split. With ``multi_line`` a quoted title may contain line breaks, and
    each file is one task.
    """
    reader = spark.read.schema(schema).option("header", True).option("encoding", "UTF-8")
    return reader.option("multiLine", multi_line).option("escape", '"').csv(path)


def write_titles(df: DataFrame, path: str) -> None:
    """Titles CSV with a header, one file per partition."""
    writer = df.write.option("header", True).option("escape", '"').mode("overwrite")
    keep_blanks = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    writer.options(**keep_blanks).csv(path)


def null_tokens(
    df: DataFrame, cols: Sequence[str], tokens: Sequence[str] = NULL_TOKENS
) -> DataFrame:
    """Turn the given texts into nulls."""
    return df.withColumns({c: F.when(~F.col(c).isin(*tokens), F.col(c)) for c in cols})


def write_mapping(df: DataFrame, path: str, id_col: str = "main_id", name: str = "main_name") -> None:
    write_titles(df.select(id_col, name).distinct(), path)


def read_mapping(spark: SparkSession, path: str, schema: str = MAPPING_SCHEMA) -> DataFrame:
    return read_titles(spark, path, schema)
