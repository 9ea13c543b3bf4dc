"""Save and load trained models as MLlib pipelines with a metadata row beside them."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

from vistrata.operators.models import NeighbourModel, TrainedModel
from vistrata.operators.trees import NODES, GrownModel

_FIELDS = ("model_name", "problem_type", "target", "feature_cols", "classes", "numeric_target",
           "scaled", "train_samples", "test_samples", "metrics", "cv_scores",
           "feature_importance")


def save_model(model: TrainedModel, spark: SparkSession, path: str) -> None:
    """Write ``path/pipeline`` (or ``neighbours``, or ``trees``) and ``path/metadata``."""
    metadata = {name: getattr(model, name) for name in _FIELDS}
    if isinstance(model.fitted, NeighbourModel):
        model.fitted.table.write.mode("overwrite").parquet(f"{path}/neighbours")
        metadata["neighbours"] = {
            name: getattr(model.fitted, name) for name in ("inputs", "classes", "k", "scaling")
        }
    elif isinstance(model.fitted, GrownModel):
        nodes = spark.createDataFrame(model.fitted.nodes(), NODES)
        nodes.write.mode("overwrite").parquet(f"{path}/trees")
        metadata["trees"] = {
            name: getattr(model.fitted, name)
            for name in ("inputs", "classes", "start", "step", "outputs")
        }
    else:
        model.fitted.write().overwrite().save(f"{path}/pipeline")
    document = spark.createDataFrame([(json.dumps(metadata),)], "document string")
    document.coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def load_model(spark: SparkSession, path: str) -> TrainedModel:
    metadata = json.loads(spark.read.text(f"{path}/metadata").first()[0])
    neighbours = metadata.pop("neighbours", None)
    grown = metadata.pop("trees", None)
    if grown is not None:
        nodes = spark.read.parquet(f"{path}/trees").toPandas()
        fitted = GrownModel(trees=GrownModel.trees_of(nodes), **grown)
    elif neighbours is not None:
        neighbours["scaling"] = neighbours["scaling"] and [tuple(s) for s in neighbours["scaling"]]
        fitted = NeighbourModel(spark.read.parquet(f"{path}/neighbours"), **neighbours)
    else:
        fitted = PipelineModel.load(f"{path}/pipeline")
    metadata["feature_importance"] = [tuple(p) for p in metadata["feature_importance"]]
    return TrainedModel(fitted=fitted, **metadata)
