"""Saving and loading fitted tables and Spark ML models."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from titlelab.operators.centroids import TitleModel


def save_tables(folder: str, **tables: DataFrame) -> None:
    """Write each table as parquet under its name."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}")


def load_tables(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder.rstrip('/')}/{name}") for name in names}


def save_title_model(folder: str, model: TitleModel) -> None:
    save_tables(folder, idf=model.idf, main=model.main, sub=model.sub)


def load_title_model(spark: SparkSession, folder: str) -> TitleModel:
    return TitleModel(**load_tables(spark, folder, "idf", "main", "sub"))


def save_pipeline(folder: str, model: PipelineModel) -> None:
    model.write().overwrite().save(folder)


def load_pipeline(folder: str) -> PipelineModel:
    return PipelineModel.load(folder)
