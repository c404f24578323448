"""Parquet tables that keep datasets, experiments, studies and fitted models."""

from __future__ import annotations

import base64
import importlib
import io
import pickle
import sys

from pyspark import cloudpickle
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.util import MLReadable, MLWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DATASETS = (
    "id string, user_id string, filename string, file_path string, file_size long, rows_count long, "
    "columns_count int, metadata map<string,string>, created_at timestamp"
)
EXPERIMENTS = (
    "id string, session_id string, run_id string, status string, "
    "results struct<model:string,problem_type:string,metrics:map<string,double>>, "
    "created_at timestamp, completed_at timestamp"
)


def dataset_row(df: DataFrame, dataset_id: str, user_id: str, filename: str, file_path: str, file_size: int) -> DataFrame:
    """Registry row of a table; metadata holds the type and missing count of each column."""
    missing = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count(F.when(F.col(f"`{c}`").isNull(), 1)).alias(f"m{i}") for i, c in enumerate(df.columns)],
    )
    pairs = []
    for i, (c, t) in enumerate(df.dtypes):
        pairs += [F.lit(f"type.{c}"), F.lit(t), F.lit(f"missing.{c}"), F.col(f"m{i}").cast("string")]
    return missing.select(
        F.lit(dataset_id).alias("id"),
        F.lit(user_id).alias("user_id"),
        F.lit(filename).alias("filename"),
        F.lit(file_path).alias("file_path"),
        F.lit(file_size).cast("long").alias("file_size"),
        F.col("_rows").alias("rows_count"),
        F.lit(len(df.columns)).alias("columns_count"),
        F.create_map(*pairs).alias("metadata"),
        F.current_timestamp().alias("created_at"),
    )


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def experiment_row(
    spark: SparkSession, experiment_id: str, session_id: str, run_id: str, model: str, problem_type: str, metrics: dict[str, float]
) -> DataFrame:
    values = [(experiment_id, session_id, run_id, "completed", (model, problem_type, metrics))]
    head = "id string, session_id string, run_id string, status string, "
    kind = "results struct<model:string,problem_type:string,metrics:map<string,double>>"
    now = F.current_timestamp()
    return spark.createDataFrame(values, head + kind).withColumns({"created_at": now, "completed_at": now})


def read_experiments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EXPERIMENTS).parquet(path)


def save_study(trials: DataFrame, path: str) -> None:
    trials.write.mode("overwrite").parquet(path)


def load_study(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


# ---- fitted objects ------------------------------------------------------------------


class _Writer(cloudpickle.CloudPickler):
    """Pickles an object; its tables and MLlib models are written beside it and named in their place."""

    def __init__(self, out, path: str):
        super().__init__(out)
        self.path, self.parts = path, {}

    def persistent_id(self, part):
        if isinstance(part, DataFrame):
            kind, write = "table", lambda at: part.write.mode("overwrite").parquet(at)
        elif isinstance(part, Transformer) and isinstance(part, MLWritable):
            kind, write = "model", lambda at: part.write().overwrite().save(at)
        else:
            return None
        if id(part) not in self.parts:
            name = f"{kind}-{len(self.parts)}"
            write(f"{self.path}/{name}")
            self.parts[id(part)] = (kind, name, type(part).__module__, type(part).__qualname__, part)
        return self.parts[id(part)][:4]


class _Reader(pickle.Unpickler):
    def __init__(self, raw, spark: SparkSession, path: str):
        super().__init__(raw)
        self.spark, self.path, self.parts = spark, path, {}

    def persistent_load(self, pid):
        kind, name, module, cls = pid
        if name not in self.parts:
            at = f"{self.path}/{name}"
            if kind == "table":
                self.parts[name] = self.spark.read.parquet(at)
            else:
                found: type[MLReadable] = getattr(importlib.import_module(module), cls)
                self.parts[name] = found.load(at)
        return self.parts[name]


def save_fitted(spark: SparkSession, fitted, path: str) -> None:
    """Any fitted object of the library (preprocessor, scaler, encoder, model,
    ensemble, study): tables as parquet, MLlib models in their own format, the
    rest as one small pickled row.  Load only what you trust, as with any pickle."""
    package = sys.modules[__name__.split(".")[0]]
    raw = io.BytesIO()
    # classes of the library are named, not copied, so that newer code can read older files
    cloudpickle.unregister_pickle_by_value(package)
    try:
        _Writer(raw, path).dump(fitted)
    finally:
        cloudpickle.register_pickle_by_value(package)
    state = base64.b64encode(raw.getvalue()).decode()
    spark.createDataFrame([(state,)], "state string").write.mode("overwrite").parquet(f"{path}/state")


def load_fitted(spark: SparkSession, path: str):
    state = spark.read.parquet(f"{path}/state").first()["state"]  # one row
    return _Reader(io.BytesIO(base64.b64decode(state)), spark, path).load()
