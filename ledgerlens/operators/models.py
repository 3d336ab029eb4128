"""Training tables, encoders and classifiers on Spark ML."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.operators.aggregates import numeric_medians
from ledgerlens.operators.derive import FeatureContract, labelled_only
from ledgerlens.operators.evaluate import class_weight
from ledgerlens.operators.forest import TREE_KINDS, TreeSettings, forest_total, grow_forest, hashed, in_turn, packed_trees, tree_groups, unit
from ledgerlens.operators.graph import feature_names, neighbor_mean, node_features
from ledgerlens.operators.ordering import exact_quantiles, running_position
from ledgerlens.operators.sampling import stratified_holdout
from ledgerlens.session import cut, drop, settings, settled

# Columns that are never features.
CONTROL_COLUMNS = frozenset((
    "is_fraud", "row_id", "transaction_id", "timestamp", "event_type", "split", "payer_id",
    "payee_id", "merchant_id", "device_id", "ip_id", "user_id",
))
LEAKAGE_COLUMNS = frozenset((
    "label_quality", "fraud_type", "risk_level", "rule_score", "fraud_txn_count",
    "observed_fraud_rate", "is_black_user", "risk_history_score", "fraud_txn_count_device",
    "observed_fraud_rate_device", "device_risk_score", "fraud_txn_count_ip",
    "observed_fraud_rate_ip", "ip_risk_score", "fraud_txn_count_merchant",
    "observed_fraud_rate_merchant", "merchant_risk_score", "is_high_risk_merchant",
))
INJECTION_COLUMNS = frozenset((
    "is_injected", "fraud_group_id", "injection_scenario", "scenario_step", "injection_evidence",
))
RING_ID_SUFFIX = "_fraud_group_mining_id"


def feature_columns(df: DataFrame, compat: bool = False) -> tuple[list[str], list[str]]:
    """(features, the categorical ones among them) by schema; ``compat`` keeps injection columns."""
    dropped = CONTROL_COLUMNS | LEAKAGE_COLUMNS | (frozenset() if compat else INJECTION_COLUMNS)
    kept = [f for f in df.schema.fields
            if f.name not in dropped and not f.name.endswith(RING_ID_SUFFIX)
            and "first_seen_time" not in f.name and "last_seen_time" not in f.name]
    text = [f.name for f in kept if isinstance(f.dataType, T.StringType)]
    return [f.name for f in kept], text


def select_features(df: DataFrame, compat: bool = False) -> FeatureContract:
    """The feature contract of a training table: columns, categories, medians as fills."""
    rows = labelled_only(df)
    names, text = feature_columns(rows, compat)
    numbers = [n for n in names if n not in text]
    fills = {}
    if numbers:
        # One row per column of the table.
        fills = {r["column"]: r["median"] for r in numeric_medians(rows, numbers).collect()}
    return FeatureContract(tuple(names), tuple(text), fills)


def fit_categories(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, code): categories in sorted order, codes 0 .. k-1, missing its own."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"),
                               F.coalesce(F.col(c).cast("string"), F.lit("__missing__")).alias("value"))
                      for c in columns])
    values = df.select(F.explode(pairs).alias("_p")).select("_p.*").distinct()
    return running_position(values, ["value"], ["column"], out="code")


FEW_CODES = 50_000  # categories of a column that are broadcast, some 5 MB


def ordinal_encode(df: DataFrame, categories: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace each categorical column by its code; an unknown value becomes -1.

    The codes of a column of at most ``FEW_CODES`` values are broadcast: a shuffle by such a column
    would bring the rows of a frequent value to one task.
    """
    # One row per column.
    sizes = {r["column"]: r["count"] for r in categories.groupBy("column").count().collect()}
    out = df
    for c in columns:
        codes = categories.where(F.col("column") == c).select(
            F.col("value").alias("_value"), F.col("code").cast("double").alias("_code"))
        if sizes.get(c, 0) <= FEW_CODES:
            codes = F.broadcast(codes)
        value = F.coalesce(F.col(c).cast("string"), F.lit("__missing__"))
        out = (out.join(codes, value == F.col("_value"), "left")
               .withColumn(c, F.coalesce("_code", F.lit(-1.0))).drop("_value", "_code"))
    return out


@dataclass(frozen=True)
class RiskModel:
    """A fitted classifier with what is needed to apply it to raw feature columns."""

    name: str
    contract: FeatureContract
    categories: DataFrame | None
    stages: tuple[Model, ...]
    forest: IsolationForest | None = None
    trees: DataFrame | None = None  # packed, as those of the isolation forest
    linear: tuple[tuple[float, ...], float] | None = None


def _vectors(df: DataFrame, contract: FeatureContract, categories: DataFrame | None) -> DataFrame:
    """Contract columns filled and encoded, assembled into ``features``; the rest is kept."""
    from ledgerlens.functions.scalar import number_or

    filled = {}
    for name in contract.feature_columns:
        present = F.col(f"`{name}`") if name in df.columns else F.lit(None)
        filled[f"_f_{name}"] = (
            F.coalesce(present.cast("string"), F.lit(contract.categorical_fill_value))
            if name in contract.categorical_columns
            else number_or(present, contract.numeric_fill_values.get(name, 0.0)))
    out = df.withColumns(filled)
    text = [f"_f_{c}" for c in contract.categorical_columns]
    if categories is not None and text:
        renamed = categories.withColumn("column", F.concat(F.lit("_f_"), F.col("column")))
        out = ordinal_encode(out, renamed, text)
    names = [f"_f_{c}" for c in contract.feature_columns]
    return VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep").transform(
        out).drop(*names)


def _prepare(train: DataFrame, contract: FeatureContract):
    rows = labelled_only(train)
    categories = None
    if contract.categorical_columns:
        categories = cut(fit_categories(rows, contract.categorical_columns), "categories")
    scale = class_weight(rows).scalar()
    weighted = rows.withColumns({
        "label": F.col("is_fraud").cast("double"),
        "weight": F.when(F.col("is_fraud") == 1, scale).otherwise(F.lit(1.0))})
    return _vectors(weighted, contract, categories), categories


TASK_ROWS = 100_000  # vectors that one task holds, some 100 MB of the widest tables


def dealt(rows: DataFrame, like: DataFrame) -> DataFrame:
    """``rows`` dealt evenly over tasks of at most ``TASK_ROWS`` rows and at least one task per core.

    Files hold far more rows than vectors of the same size, so a task that reads a file would hold
    many times its size in vectors. ``like`` has as many rows and is cheaper to count.
    """
    tasks = max(-(-like.count() // TASK_ROWS), rows.sparkSession.sparkContext.defaultParallelism)
    return rows.repartition(tasks)


@contextmanager
def read_as_dealt(spark) -> Iterator[None]:
    """Inside the block a task reads one file, so a table that was written as ``dealt`` is read so."""
    with settings(spark, {"spark.sql.files.openCostInBytes": spark.conf.get("spark.sql.files.maxPartitionBytes")}):
        yield


def fit_logistic(train: DataFrame, contract: FeatureContract, max_iter: int = 300,
                 reg: float = 1e-4) -> RiskModel:
    """Scaled logistic regression with balanced classes."""
    rows, categories = _prepare(train, contract)
    rows = cut(dealt(rows.select("features", "label", "weight"), labelled_only(train)), "vectors")
    with read_as_dealt(train.sparkSession):
        scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True).fit(rows)
        model = LogisticRegression(featuresCol="scaled", weightCol="weight", maxIter=max_iter,
                                   regParam=reg).fit(scaler.transform(rows))
    drop(rows)
    return RiskModel("logistic", contract, categories, (scaler, model))


# Boosted-tree presets. Leaf-wise growth and thousands of rounds have no Spark ML counterpart:
# depth and rounds are bounded, and the validation rows stop the rounds early.
GBT_PRESETS = {
    "leafwise": {"maxDepth": 6, "maxIter": 60, "stepSize": 0.1, "subsamplingRate": 0.8},
    "depthwise": {"maxDepth": 7, "maxIter": 50, "stepSize": 0.1, "subsamplingRate": 0.8},
    "histogram": {"maxDepth": 5, "maxIter": 40, "stepSize": 0.1, "subsamplingRate": 1.0},
}


def fit_gbt(train: DataFrame, valid: DataFrame, contract: FeatureContract,
            preset: str = "leafwise", seed: int = 20260511, **changes) -> RiskModel:
    """Boosted trees; ``valid`` rows decide when to stop."""
    both = (train.withColumn("_held", F.lit(False))
            .unionByName(valid.withColumn("_held", F.lit(True)), allowMissingColumns=True))
    rows, categories = _prepare(both, contract)
    preset_values = {**GBT_PRESETS[preset], **changes}
    rows = cut(dealt(rows.select("features", "label", "weight", "_held"), labelled_only(both)), "vectors")
    with read_as_dealt(train.sparkSession):
        model = GBTClassifier(featuresCol="features", weightCol="weight", seed=seed,
                              validationIndicatorCol="_held", validationTol=1e-4, **preset_values).fit(rows)
    drop(rows)
    return RiskModel(f"gbt_{preset}", contract, categories, (model,))


def fit_trees(train: DataFrame, contract: FeatureContract, key: str = "transaction_id",
              settings: TreeSettings = TreeSettings()) -> RiskModel:
    """Extremely randomised trees; both classes weigh the same within the sample of each tree."""
    rows, categories = _prepare(train, contract)
    trees = settled(train.sparkSession, lambda: packed_trees(grow_forest(
        cut(rows.select(key, "features", "label"), "forest_rows"), key, settings)), "trees")
    return RiskModel("trees", contract, categories, (), trees=trees)


# ---------------------------------------------------------------- isolation forest
@dataclass(frozen=True)
class IsolationForest:
    """Packed trees, a row each, with the risk range that is scaled to 0-1."""

    trees: DataFrame
    sample_size: int
    low: float = 0.0
    high: float = 1.0


ISOLATION_KINDS = {"feature": np.int32, "threshold": np.float64, "left": np.int32, "right": np.int32, "depth": np.float64}
_GROWN = "tree int, size int, " + ", ".join(f"{c} binary" for c in ISOLATION_KINDS)
PICKED_BYTES = 512 << 20  # rows of trees that are shuffled at a time


def _path_rest(n: np.ndarray | float):
    """Expected extra depth of an unsplit leaf with ``n`` rows."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 3.0)
    deep = 2.0 * (np.log(safe - 1.0) + np.euler_gamma) - 2.0 * (safe - 1.0) / safe
    return np.where(n > 2, deep, np.where(n == 2, 1.0, 0.0))


def grow_tree(x: np.ndarray, seed: int) -> dict:
    """One isolation tree over the rows of ``x``, a level at a time; nodes are numbered by level."""
    rng = np.random.default_rng(seed)
    limit = int(np.ceil(np.log2(max(len(x), 2))))
    nodes: dict[str, list] = {k: [] for k in ISOLATION_KINDS}
    sizes, level, below_here = np.array([len(x)]), 0, 1
    while len(sizes):  # rows lie node by node, none of them empty
        starts = np.cumsum(sizes) - sizes
        low, high = np.minimum.reduceat(x, starts), np.maximum.reduceat(x, starts)
        movable = high > low
        inner = (sizes >= 2) & movable.any(axis=1) & (level < limit)
        each = np.arange(len(sizes))
        feature = np.argmax(np.where(movable, rng.random(movable.shape), -1.0), axis=1)
        least, most = low[each, feature].astype(float), high[each, feature].astype(float)
        with np.errstate(invalid="ignore", over="ignore"):
            threshold = np.fmin(least + rng.random(len(sizes)) * (most - least), most)
        threshold = np.where(threshold > least, threshold, most)  # the draw was the least value itself
        child = below_here + 2 * (np.cumsum(inner) - 1)
        for name, value in (("feature", np.where(inner, feature, -1)), ("threshold", np.where(inner, threshold, 0.0)),
                            ("left", np.where(inner, child, -1)), ("right", np.where(inner, child + 1, -1)),
                            ("depth", np.where(inner, 0.0, level + _path_rest(sizes)))):
            nodes[name].append(value)
        node = np.repeat(each, sizes)
        rows = np.flatnonzero(inner[node])
        node = node[rows]
        side = 2 * (np.cumsum(inner) - 1)[node] + (x[rows, feature[node]] >= threshold[node])
        x = x[rows[np.argsort(side, kind="stable")]]
        sizes = np.bincount(side, minlength=2 * int(inner.sum()))
        below_here += len(sizes)
        level += 1
    return {name: np.concatenate(parts).astype(ISOLATION_KINDS[name]) for name, parts in nodes.items()}


def _path_steps(tree: dict) -> tuple[np.ndarray, ...]:
    """Arrays that take rows one step on, and the number of steps; rows in a leaf stay there."""
    feature, threshold, left, right, depth = (np.asarray(tree[k]) for k in ISOLATION_KINDS)
    inner = feature >= 0
    child = np.where(inner, [right, left], np.arange(len(feature))).T.ravel()
    steps, reached = 0, np.zeros(1, dtype=np.int64)
    while inner[reached].any():
        reached = reached[inner[reached]]
        reached, steps = np.r_[left[reached], right[reached]], steps + 1
    return np.where(inner, feature, 0), threshold, child, depth, steps


def _walked(feature, threshold, child, depth, steps, x: np.ndarray) -> np.ndarray:
    flat = np.ascontiguousarray(x).ravel()
    line, at = np.arange(len(x)) * x.shape[1], np.zeros(len(x), dtype=np.int64)
    for _ in range(steps):
        below = flat.take(line + feature.take(at)) < threshold.take(at)
        at = child.take(2 * at + below)
    return depth[at]


def path_lengths(tree: dict, x: np.ndarray) -> np.ndarray:
    return _walked(*_path_steps(tree), x)


SCORE_ROWS = 2048  # rows whose vectors stay in the cache of a core while they walk


def path_total(trees: Sequence[dict], x: np.ndarray) -> np.ndarray:
    """Sum of the path lengths of each row."""
    total = np.zeros(len(x))
    for tree in trees:
        steps = _path_steps(tree)
        for i in range(0, len(x), SCORE_ROWS):
            total[i:i + SCORE_ROWS] += _walked(*steps, x[i:i + SCORE_ROWS])
    return total


def _add_isolation_risk(vectors: DataFrame, forest: IsolationForest, out: str) -> DataFrame:
    groups, trees = tree_groups(forest.trees, ISOLATION_KINDS)
    scale = float(_path_rest(forest.sample_size)) or 1.0

    @F.pandas_udf("double")
    def risk(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in _held(batches):
            total = sum(path_total(some, x) for some in in_turn(groups))
            yield pd.Series(np.power(2.0, -(total / max(trees, 1)) / scale))

    return vectors.withColumn(out, risk(vector_to_array("features", "float32")))


SCORE_BATCH = 65_536  # rows that pass the trees together


def _held(batches: Iterator[pd.Series]) -> Iterator[np.ndarray]:
    """The vectors of several batches at a time."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= SCORE_BATCH:
            yield np.stack([x for b in held for x in b])
            held, n = [], 0
    if n:
        yield np.stack([x for b in held for x in b])


def _add_tree_risk(vectors: DataFrame, model: RiskModel, out: str) -> DataFrame:
    groups, trees = tree_groups(model.trees, TREE_KINDS)

    @F.pandas_udf("double")
    def risk(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in _held(batches):
            yield pd.Series(sum(forest_total(some, x) for some in in_turn(groups)) / max(trees, 1))

    return vectors.withColumn(out, risk(vector_to_array("features")))


def isolation_trees(rows: DataFrame, n: int, width: int, trees: Sequence[int], sample: int, seed: int) -> DataFrame:
    """Packed isolation trees (tree, size and ``ISOLATION_KINDS``) over the ``n`` rows (key, x).

    A tree takes each row with chance ``sample / n``, by hash of (tree, key): all of them if there
    are no more. Trees draw independently, so a row may be in many.
    """
    rate = min(1.0, sample / max(n, 1))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column("key").to_numpy()
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            for tree in trees:
                some = unit(hashed(seed, tree, key)) < rate
                if some.any():
                    yield pa.record_batch([pa.array([tree], pa.int32()), pa.array([x[some].tobytes()], pa.binary())],
                                          names=["tree", "x"])

    def grown(tree: int, parts: list[bytes]) -> pa.RecordBatch:
        x = np.frombuffer(b"".join(parts), np.float32).reshape(-1, width)
        arrays = grow_tree(x, seed + tree)
        return pa.record_batch(
            [pa.array([tree], pa.int32()), pa.array([len(x)], pa.int32()), *(pa.array([a.tobytes()], pa.binary()) for a in arrays.values())],
            names=["tree", "size", *arrays])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = -1, []
        for batch in batches:
            for tree, part in zip(batch.column("tree").to_pylist(), batch.column("x").to_pylist()):
                if held and tree != number:
                    yield grown(number, held)
                    held = []
                number = tree
                held.append(part)
        if held:
            yield grown(number, held)

    return (rows.mapInArrow(pick, "tree int, x binary").repartition(len(trees), "tree").sortWithinPartitions("tree")
            .mapInArrow(build, _GROWN))


def fit_isolation(train: DataFrame, contract: FeatureContract, key: str = "transaction_id",
                  trees: int = 240, sample: int = 100_000, seed: int = 20260511) -> RiskModel:
    """Isolation forest on normal rows; risk is scaled by its 1 % and 99 % quantiles over all rows.

    A tree is grown by one task over about ``sample`` normal rows, or all of them if there are fewer.
    Trees are grown some at a time, as many as take ``PICKED_BYTES`` together.
    """
    if sample < 2:
        raise ValueError("sample must be 2 or more")
    spark = train.sparkSession
    rows, categories = _prepare(train, contract)
    x = vector_to_array("features", "float32")
    vectors = cut(dealt(rows.select(key, "is_fraud", "features"), labelled_only(train)).select(
        F.xxhash64(key, x).alias("key"), "is_fraud", "features"), "vectors")
    normal = vectors.where(F.col("is_fraud") == 0)
    n = normal.count()
    if n == 0:
        normal, n = vectors, vectors.count()
    normal = normal.select("key", x.alias("x"))
    width = max(1, normal.select(F.coalesce(F.max(F.size("x")), F.lit(0))).first()[0])
    together = max(1, PICKED_BYTES // (4 * width * max(1, min(sample, n))))
    packed = reduce(DataFrame.unionByName, [
        settled(spark, lambda: isolation_trees(normal, n, width, range(low, min(low + together, trees)), sample, seed), "isolation")
        for low in range(0, trees, together)])
    size = round(packed.agg(F.avg("size")).first()[0] or 0)
    forest = IsolationForest(packed, size)
    risks = _add_isolation_risk(vectors, forest, "_risk").select("_risk")
    edge = exact_quantiles(risks, "_risk", {"low": 0.01, "high": 0.99}).first()
    drop(vectors)
    low, high = float(edge["low"]), float(edge["high"])
    if high <= low:
        high = low + 1.0
    return RiskModel("isolation", contract, categories, (), IsolationForest(packed, size, low, high))


def linear_model(contract: FeatureContract, weights: Mapping[str, float], intercept: float,
                 categories: DataFrame | None = None, name: str = "linear") -> RiskModel:
    """A logistic model with given weights of the contract's columns; a column without one counts 0."""
    unknown = set(weights) - set(contract.feature_columns)
    if unknown:
        raise ValueError(f"not in the contract: {sorted(unknown)}")
    line = tuple(float(weights.get(c, 0.0)) for c in contract.feature_columns)
    return RiskModel(name, contract, categories, (), linear=(line, float(intercept)))


def score_batch(model: RiskModel, df: DataFrame, out: str = "risk_score") -> DataFrame:
    """``df`` with the model's fraud probability."""
    vectors = _vectors(df, model.contract, model.categories)
    if model.forest is not None:
        scored = _add_isolation_risk(vectors, model.forest, "_risk")
        low, high = model.forest.low, model.forest.high
        risk = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("_risk") - low) / (high - low)))
        return scored.withColumn(out, risk).select(*df.columns, out)
    if model.linear is not None:
        x = vector_to_array("features")
        weights, intercept = model.linear
        total = sum((F.get(x, F.lit(i)) * F.lit(w) for i, w in enumerate(weights)), F.lit(intercept))
        return vectors.withColumn(out, 1 / (1 + F.exp(-total))).select(*df.columns, out)
    if model.trees is not None:
        return _add_tree_risk(vectors, model, out).select(*df.columns, out)
    for stage in model.stages:
        vectors = stage.transform(vectors)
    return vectors.withColumn(out, F.get(vector_to_array("probability"), F.lit(1))).select(
        *df.columns, out)


def node_risk_model(edges: DataFrame, seed: int = 42) -> DataFrame:
    """Risk of every node from two neighbourhood means and a weighted linear classifier.

    A simplified graph convolution: features are propagated twice, only the classifier learns.
    Output: node_id, node_label, part, node_risk_score.
    """
    names = feature_names()
    nodes = cut(node_features(edges), "nodes")
    one = cut(neighbor_mean(nodes, edges, names), "hop")
    first = [f"nbr_{c}" for c in names]
    two = cut(neighbor_mean(one, edges, first, prefix="hop2_"), "hop2")
    columns = [*names, *first, *[f"hop2_{c}" for c in first]]
    parted = cut(stratified_holdout(two, "node_label", "node_id", seed), "parted")
    scale = class_weight(parted.where(F.col("part") == "train"), "node_label").scalar()
    rows = VectorAssembler(inputCols=columns, outputCol="features").transform(parted).withColumns({
        "label": F.col("node_label").cast("double"),
        "weight": F.when(F.col("node_label") == 1, scale).otherwise(F.lit(1.0))})
    model = LogisticRegression(weightCol="weight", maxIter=100, regParam=1e-4).fit(
        rows.where(F.col("part") == "train").select("features", "label", "weight"))
    return model.transform(rows).select(
        "node_id", "node_label", "part",
        F.get(vector_to_array("probability"), F.lit(1)).alias("node_risk_score"))
