"""Splits, caps, samples, pages and top-k selections."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.hashing import stable_hash
from ledgerlens.functions.scalar import _c, number_or
from ledgerlens.operators.ordering import running_position, running_totals

_HASH_BITS = 60
_HISTOGRAM_BITS = 12


def dense_row_id(df: DataFrame, order=("timestamp", "transaction_id")) -> DataFrame:
    """0-based ``row_id`` in time order."""
    return running_position(df.drop("row_id"), order, out="row_id")


def time_splits(df: DataFrame, train: float = 0.70, valid: float = 0.85) -> DataFrame:
    """Labelled rows by position in time into train, valid and test; the others stay apart."""
    base = df.drop("split")
    labelled = F.col("is_fraud").isin(0, 1)
    placed = running_position(base.where(labelled), ("timestamp", "transaction_id"),
                              out="_at", total="_n")
    cut_train, cut_valid = (F.floor(F.col("_n") * F.lit(share)) for share in (train, valid))
    split = (F.when(F.col("_at") < cut_train, "train").when(F.col("_at") < cut_valid, "valid")
             .otherwise("test"))
    rest = base.where(~F.coalesce(labelled, F.lit(False)))
    return (placed.select(*base.columns, split.alias("split"))
            .unionByName(rest.withColumn("split", F.lit("unlabeled"))))


def order_log(df: DataFrame, train: float = 0.70, valid: float = 0.85) -> DataFrame:
    """``dense_row_id`` and ``time_splits`` from a single sort of the log."""
    labelled = F.coalesce(F.col("is_fraud").isin(0, 1), F.lit(False))
    marked = df.drop("row_id", "split").withColumn("_labelled", labelled.cast("bigint"))
    placed = running_totals(marked, ("timestamp", "transaction_id"),
                            {"row_id": None, "_at": "_labelled"}, whole={"_n": "_at"})
    cut_train, cut_valid = (F.floor(F.col("_n") * F.lit(share)) for share in (train, valid))
    split = (F.when(F.col("_labelled") == 0, "unlabeled").when(F.col("_at") < cut_train, "train")
             .when(F.col("_at") < cut_valid, "valid").otherwise("test"))
    return placed.withColumn("split", split).drop("_labelled", "_at", "_n")


def hash_sample(df: DataFrame, quotas: Mapping[str, int], key: Column | str, seed: int,
                stratum: Column | None = None) -> DataFrame:
    """The ``quotas[stratum]`` rows with the smallest salted hash of ``key`` in each stratum.

    A histogram of the hash (4,096 bins) tells which bins are taken whole; only the bin at the
    edge is ordered, so the population is not sorted.
    """
    stratum = F.lit("all") if stratum is None else stratum
    marked = df.withColumns({
        "_stratum": stratum, "_hash": stable_hash(key, f"sample:{seed}"),
    }).withColumn("_bin", F.shiftright("_hash", _HASH_BITS - _HISTOGRAM_BITS))
    quota = F.lit(0)
    for name, n in quotas.items():
        quota = F.when(F.col("_stratum") == name, F.lit(int(n))).otherwise(quota)
    earlier = (Window.partitionBy("_stratum").orderBy("_bin")
               .rowsBetween(Window.unboundedPreceding, -1))
    bins = (marked.groupBy("_stratum", "_bin").agg(F.count(F.lit(1)).alias("_size"))
            .withColumn("_before", F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
            .withColumn("_left", quota - F.col("_before")).where(F.col("_left") > 0)
            .select("_stratum", "_bin", "_left", (F.col("_left") < F.col("_size")).alias("_edge")))
    # At most 4,096 bins per stratum.
    chosen = marked.join(F.broadcast(bins), ["_stratum", "_bin"], "inner")
    edge = running_position(chosen.where(F.col("_edge")), ["_hash", _c(key)], ["_stratum"],
                            out="_at")
    return (chosen.where(~F.col("_edge")).select(*df.columns)
            .unionByName(edge.where(F.col("_at") < F.col("_left")).select(*df.columns)))


def stratum_of_label(label: Column | str = "is_fraud") -> Column:
    return F.when(_c(label) == 1, "fraud").when(_c(label) == 0, "normal").otherwise("unlabeled")


def cap_quotas(fraud: int, normal: int, unlabeled: int, cap: int) -> dict[str, int]:
    """Rows per stratum: at most a quarter fraud and a tenth unlabelled, the rest normal.

    What normal rows cannot fill is filled from unlabelled rows only.
    """
    take_fraud = min(fraud, max(1, int(cap * 0.25)))
    least_unlabeled = min(unlabeled, int(cap * 0.10))
    take_normal = min(normal, max(0, cap - take_fraud - least_unlabeled))
    short = cap - take_fraud - take_normal
    return {"fraud": take_fraud, "normal": take_normal,
            "unlabeled": min(unlabeled, max(least_unlabeled, short))}


def stratified_cap(df: DataFrame, cap: int | None, seed: int,
                   key: str = "transaction_id") -> DataFrame:
    """At most ``cap`` rows, a feature the caller must ask for: None keeps every row.

    A table that already has ``cap`` rows or fewer stays as it is; the shares of ``cap_quotas``
    hold only where rows must go.
    """
    if cap is None:
        return df
    stratum = stratum_of_label()
    sizes = df.agg(*[F.count_if(stratum == s).alias(s) for s in ("fraud", "normal", "unlabeled")])
    n = sizes.first().asDict()
    if sum(n.values()) <= cap:
        return df
    return hash_sample(df, cap_quotas(cap=cap, **n), key, seed, stratum)


def edge_cap(df: DataFrame, cap: int | None, seed: int, key: Column | str) -> DataFrame:
    """At most ``cap`` rows, chosen by hash."""
    return df if cap is None else hash_sample(df, {"all": cap}, key, seed)


def edge_key(columns=("src_id", "dst_id", "edge_type", "timestamp")) -> Column:
    return F.concat_ws("|", *[F.col(c).cast("string") for c in columns])


def sample_graph_balanced(edges: DataFrame, max_edges: int, max_nodes: int, seed: int,
                          key: Column | None = None) -> DataFrame:
    """Labelled edges with a bounded fraud share, inside the first ``max_nodes`` nodes seen."""
    key = edge_key() if key is None else key
    labelled = edges.where(F.col("label").isin(0, 1)).withColumn("_key", key)
    positives = labelled.where(F.col("label") == 1).count()
    take = min(positives, max_edges // 5)
    sampled = hash_sample(labelled, {"1": take, "0": max_edges - take}, "_key", seed,
                          F.col("label").cast("string"))
    placed = running_position(sampled, [stable_hash("_key", f"order:{seed}"), "_key"], out="_at")
    ends = placed.select(F.explode(F.array(
        F.struct(F.col("src_id").alias("node"), (F.col("_at") * 2).alias("seen")),
        F.struct(F.col("dst_id").alias("node"), (F.col("_at") * 2 + 1).alias("seen")),
    )).alias("_e")).select("_e.*")
    first = ends.groupBy("node").agg(F.min("seen").alias("seen"))
    kept = running_position(first, ["seen"], out="_order").where(F.col("_order") < max_nodes)
    src, dst = (kept.select(F.col("node").alias(n)) for n in ("_src", "_dst"))
    return (placed.join(src, F.col("src_id") == F.col("_src"), "left_semi")
            .join(dst, F.col("dst_id") == F.col("_dst"), "left_semi").select(*edges.columns))


def stratified_holdout(df: DataFrame, label: str, key: str, seed: int,
                       test: float = 0.25, valid: float = 0.20) -> DataFrame:
    """``part`` = test for a share of each label by hash order, valid for a share of the rest."""
    placed = running_position(df, [stable_hash(key, f"holdout:{seed}"), key], [label],
                              out="_at", total="_n")
    n_test = F.floor(F.col("_n") * F.lit(test))
    n_valid = F.floor((F.col("_n") - n_test) * F.lit(valid))
    part = (F.when(F.col("_at") < n_test, "test").when(F.col("_at") < n_test + n_valid, "valid")
            .otherwise("train"))
    return placed.withColumn("part", part).drop("_at", "_n")


def sort_time_id(df: DataFrame) -> DataFrame:
    return df.orderBy("timestamp", "transaction_id")


def top_groups(rings: DataFrame, limit: int = 20) -> DataFrame:
    if not 1 <= limit <= 200:
        raise ValueError("limit must be between 1 and 200")
    return rings.orderBy(F.desc("graph_mining_group_risk_score"), "fraud_group_mining_id").limit(limit)


def top_risk_entities(profile: DataFrame, score: str, key: str, k: int) -> DataFrame:
    """The ``k`` riskiest entities."""
    return profile.orderBy(F.desc(score), key).limit(k)


# ---------------------------------------------------------------- paging of user profiles
SORTABLE = (
    "risk_history_score", "observed_fraud_rate", "txn_count", "total_amount",
    "common_device_count", "common_ip_count", "user_id",
)
PAGE_COLUMNS = (
    "user_id", "txn_count", "total_amount", "observed_fraud_rate", "risk_history_score",
    "common_device_count", "common_ip_count", "home_country", "source_hint", "is_black_user",
)
PATTERN_COLUMNS = (
    "source_hint", "txn_count", "observed_fraud_rate", "risk_history_score",
    "common_device_count", "common_ip_count",
)


def _band(value: Column, edges: tuple[float, float, float]) -> Column:
    low, mid, high = edges
    return F.when(value <= low, 0).when(value <= mid, 1).when(value <= high, 2).otherwise(3)


def diverse_order(profile: DataFrame, out: str = "diverse_rank") -> DataFrame:
    """Round-robin order over (source, risk band, activity band) cells, as a 0-based rank."""
    risk, activity = number_or("risk_history_score"), number_or("txn_count")
    banded = profile.withColumns({
        "_risk": _band(risk, (0.2, 0.5, 0.8)),
        "_activity": _band(activity, (1, 5, 20)),
        "_source": F.coalesce(F.col("source_hint"), F.lit("unknown")),
    })
    rounds = running_position(
        banded, [F.desc_nulls_last("risk_history_score"), F.desc_nulls_last("txn_count"), "user_id"],
        ["_source", "_risk", "_activity"], out="_round")
    ranked = running_position(
        rounds, ["_round", F.desc("_risk"), F.desc("_activity"), "_source",
                 F.desc_nulls_last("risk_history_score"), "user_id"], out=out)
    return ranked.select(*profile.columns, out)


def page_users(profile: DataFrame, query: str = "", sort: str = "diverse",
               direction: str = "desc", offset: int = 0, limit: int = 50) -> DataFrame:
    """One page of user profiles; an unknown sort column means the diverse order."""
    if not 1 <= limit <= 200:
        raise ValueError("limit must be between 1 and 200")
    if offset < 0:
        raise ValueError("offset must be non-negative")
    by_column = sort in SORTABLE and sort in profile.columns
    rows = profile if by_column else diverse_order(profile)
    text = query.strip().lower()
    if text:
        rows = rows.where(F.lower("user_id").contains(F.lit(text)))
    if by_column:
        first = F.asc_nulls_last(sort) if direction.lower() == "asc" else F.desc_nulls_last(sort)
        rows = rows.orderBy(first, "user_id")
    else:
        rows = rows.orderBy("diverse_rank")
    return (rows.offset(offset).limit(limit)
            .select(*[c for c in PAGE_COLUMNS if c in profile.columns]))


def page_diversity(page: DataFrame) -> DataFrame:
    pattern = [F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in PATTERN_COLUMNS
               if c in page.columns]
    return page.agg(
        F.countDistinct("source_hint").alias("page_sources"),
        F.countDistinct(F.concat_ws("|", *pattern)).alias("page_profile_patterns"),
    )
