"""Stored models, and the publication that says which model and snapshots score now.

A model lies in ``<folder>/<name>/<version>``; its ``config`` is written last, so a model that was not
stored whole cannot be loaded. Publications are appended, never rewritten: the latest one is in force.
"""

from __future__ import annotations

import json
import time
from collections.abc import Mapping
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.classification import GBTClassificationModel, LogisticRegressionModel
from pyspark.ml.feature import StandardScalerModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators.derive import FeatureContract, Thresholds
from ledgerlens.operators.forest import TREE_KINDS
from ledgerlens.operators.models import ISOLATION_KINDS, IsolationForest, RiskModel

_STAGES = {c.__name__: c for c in (StandardScalerModel, LogisticRegressionModel, GBTClassificationModel)}
_ARRAYS = "tree int, name string, kind string, data binary"
_PUBLISHED = ("sequence long, model_name string, model_version string, medium double, high double, "
              "tables map<string,string>")


def model_path(folder: str, name: str, version: str) -> str:
    return f"{folder}/{name}/{version}"


def save_model(spark: SparkSession, model: RiskModel, folder: str, version: str) -> str:
    """Store a model; an existing version is an error. Returns its path."""
    path = model_path(folder, model.name, version)
    if model.categories is not None:
        model.categories.write.parquet(f"{path}/categories")
    for i, stage in enumerate(model.stages):
        stage.save(f"{path}/stage-{i}")
    trees, kinds = (model.trees, TREE_KINDS) if model.trees is not None else (
        (model.forest.trees, ISOLATION_KINDS) if model.forest else (None, {}))
    if trees is not None:
        arrays = F.array(*[F.struct(F.lit(c).alias("name"), F.lit(np.dtype(kind).str).alias("kind"), F.col(c).alias("data"))
                           for c, kind in kinds.items()])
        trees.select("tree", F.explode(arrays).alias("_a")).select("tree", "_a.*").write.parquet(f"{path}/trees")
    config = {
        "name": model.name, "version": version, "contract": model.contract.to_dict(),
        "categories": model.categories is not None, "stages": [type(s).__name__ for s in model.stages],
        "trees": model.trees is not None, "linear": model.linear,
        "forest": [model.forest.sample_size, model.forest.low, model.forest.high] if model.forest else None}
    spark.createDataFrame([(json.dumps(config),)], "value string").coalesce(1).write.text(f"{path}/config")
    return path


def load_model(spark: SparkSession, folder: str, name: str, version: str) -> RiskModel:
    """The stored model; it gives the scores it gave when it was saved."""
    path = model_path(folder, name, version)
    config = json.loads(spark.read.text(f"{path}/config").first()["value"])
    unknown = [s for s in config["stages"] if s not in _STAGES]
    if unknown:
        raise ValueError(f"unknown stages {unknown}")
    trees = None
    if config["trees"] or config["forest"]:
        kinds = TREE_KINDS if config["trees"] else ISOLATION_KINDS
        known = [(c, np.dtype(kind).str) for c, kind in kinds.items()]
        stored = spark.read.schema(_ARRAYS).parquet(f"{path}/trees")
        if others := [r for r in stored.select("name", "kind").distinct().collect() if tuple(r) not in known]:
            raise ValueError(f"unknown arrays {others}")
        trees = stored.groupBy("tree").agg(*[F.max(F.when(F.col("name") == c, F.col("data"))).alias(c) for c in kinds])
    size, low, high = config["forest"] or (0, 0.0, 1.0)
    return RiskModel(
        config["name"], FeatureContract.from_dict(config["contract"]),
        spark.read.parquet(f"{path}/categories") if config["categories"] else None,
        tuple(_STAGES[s].load(f"{path}/stage-{i}") for i, s in enumerate(config["stages"])),
        forest=IsolationForest(trees, size, low, high) if config["forest"] else None,
        trees=trees if config["trees"] else None,
        linear=(tuple(config["linear"][0]), config["linear"][1]) if config["linear"] else None)


@dataclass(frozen=True)
class Publication:
    """What scores now: a model version, its thresholds, and paths of the dimension snapshots.

    ``tables`` has the profiles' paths by kind (user, device, ip, merchant) and, as ``entities``,
    the path of the graph features.
    """

    model_name: str
    model_version: str
    thresholds: Thresholds = Thresholds()
    tables: Mapping[str, str] = field(default_factory=dict)


def publish(spark: SparkSession, folder: str, what: Publication) -> None:
    """Put ``what`` in force for every batch that begins from now on."""
    row = (time.time_ns(), what.model_name, what.model_version, what.thresholds.medium,
           what.thresholds.high, dict(what.tables))
    spark.createDataFrame([row], _PUBLISHED).coalesce(1).write.mode("append").json(f"{folder}/published")


def published(spark: SparkSession, folder: str) -> Publication:
    """The latest publication; it is an error if there is none."""
    row = (spark.read.schema(_PUBLISHED).json(f"{folder}/published")
           .orderBy(F.desc("sequence"), F.desc("model_version")).first())
    if row is None:
        raise ValueError(f"nothing published in {folder}")
    return Publication(row["model_name"], row["model_version"], Thresholds(row["medium"], row["high"]),
                       row["tables"] or {})


def snapshots(spark: SparkSession, what: Publication) -> tuple[dict[str, DataFrame], DataFrame | None]:
    """(profiles by kind, graph features or None) that the publication names."""
    tables = {kind: spark.read.parquet(path) for kind, path in what.tables.items()}
    return {k: t for k, t in tables.items() if k != "entities"}, tables.get("entities")
