"""Queries of evaluation, models, feedback and data quality (survey sections 2.11 and 2.12)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators import aggregates as A
from ledgerlens.operators import derive as D
from ledgerlens.operators import evaluate as E
from ledgerlens.operators import feedback as B
from ledgerlens.operators import graph as G
from ledgerlens.operators import models as L
from ledgerlens.operators import profiles as P
from ledgerlens.operators import quality as Q
from ledgerlens.operators import windows as W
from ledgerlens.operators.joins import attach_graph_features, enrich_profiles
from ledgerlens.plans.queries_rings import WITH_EDGES
from ledgerlens.plans.registry import WITH_D, WITH_TX, d, query, rounded, tx
from ledgerlens.session import cut, scratch_path, settled, stepwise

_S = WITH_TX + """, s AS (SELECT transaction_id, source, split, k, u, is_fraud AS label,
    round(risk_score * 50) / 50 * (1 - (k % 3) * 0.1) AS score FROM tx WHERE is_fraud IN (0, 1)),
n AS (SELECT count(*) AS n, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS neg
    FROM s)"""


def scored(spark, sf) -> DataFrame:
    """Labelled rows with a coarse score, so that scores tie and classes overlap."""
    score = F.round(F.col("risk_score") * 50) / 50 * (1 - (F.col("k") % 3) * F.lit(0.1))
    return D.labelled_only(tx(spark, sf)).withColumn("risk_score", score)


@query("average_precision", _S + """, g AS (SELECT score, count(*) AS c, count(*) FILTER (label = 1)
    AS pc FROM s GROUP BY score),
r AS (SELECT pc, sum(pc) OVER (ORDER BY score DESC) / sum(c) OVER (ORDER BY score DESC) AS prec FROM g)
SELECT round(sum(pc * prec) / (SELECT p FROM n), 9) AS average_precision FROM r""")
def _ap(spark, sf):
    return rounded(E.average_precision(scored(spark, sf)), "average_precision", digits=9)


@query("roc_auc", _S + """, r AS (SELECT label, rank() OVER (ORDER BY score)
    + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM s)
SELECT round((sum(rk) FILTER (label = 1) - max(p) * (max(p) + 1) / 2.0) / (max(p) * max(neg)), 9)
    AS roc_auc FROM r, n""")
def _roc(spark, sf):
    return rounded(E.roc_auc(scored(spark, sf)), "roc_auc", digits=9)


@query("recall_at_top_k", _S + """, r AS (SELECT label, row_number() OVER (
    ORDER BY score DESC, transaction_id) AS place FROM s)
SELECT round(count(*) FILTER (label = 1 AND place <= greatest(1, floor(n * 0.05::DOUBLE)))
    / max(p), 9) AS recall_at_top_k FROM r, n""")
def _recall(spark, sf):
    return rounded(E.recall_at_top_k(scored(spark, sf), 0.05), "recall_at_top_k", digits=9)


_CONF = """round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
    round(coalesce(tp / nullif(p, 0), 0), 6) AS recall,
    round(coalesce(2 * tp / nullif(tp + fp + p, 0), 0), 6) AS f1,
    round(coalesce(fp / nullif(neg, 0), 0), 6) AS false_positive_rate"""
_RATES = ("precision", "recall", "f1", "false_positive_rate")


@query("confusion_metrics", _S + f""", t AS (SELECT unnest([0.3, 0.5, 0.8, 2.0])::DOUBLE AS threshold),
c AS (SELECT threshold, count(*) FILTER (label = 1 AND score >= threshold) AS tp,
    count(*) FILTER (label = 0 AND score >= threshold) AS fp FROM s, t GROUP BY threshold)
SELECT threshold, {_CONF}, tp + fp AS predicted_positive FROM c, n""")
def _confusion(spark, sf):
    return rounded(E.confusion_metrics(scored(spark, sf), (0.3, 0.5, 0.8, 2.0)), *_RATES)


_REPORTS = _S + f""", t AS (SELECT i * ((0.99::DOUBLE - 0.01::DOUBLE) / 98) + 0.01::DOUBLE AS threshold
    FROM range(99) AS x(i)),
c AS (SELECT threshold, count(*) FILTER (label = 1 AND score >= threshold) AS tp,
    count(*) FILTER (label = 0 AND score >= threshold) AS fp FROM s, t GROUP BY threshold),
rep AS (SELECT threshold, {_CONF}, tp + fp AS predicted_positive,
    coalesce(tp / nullif(tp + fp, 0), 0) AS pr, coalesce(tp / nullif(p, 0), 0) AS rc,
    coalesce(2 * tp / nullif(tp + fp + p, 0), 0) AS ff FROM c, n)"""
_NAMED = ", picked AS (" + " UNION ALL ".join(
    f"(SELECT '{name}' AS name, threshold, precision, recall, f1, false_positive_rate, "
    f"predicted_positive FROM rep WHERE {where} ORDER BY {value} DESC, threshold LIMIT 1)"
    for name, value, where in (
        ("best_f1", "ff", "TRUE"), ("precision_at_least_0_95", "rc", "pr >= 0.95"),
        ("recall_at_least_0_90", "pr", "rc >= 0.90"))) + f""" UNION ALL
    SELECT CASE threshold WHEN 0.5 THEN 'default_medium' ELSE 'default_high' END, threshold, {_CONF},
        tp + fp FROM (SELECT threshold, count(*) FILTER (label = 1 AND score >= threshold) AS tp,
            count(*) FILTER (label = 0 AND score >= threshold) AS fp
            FROM s, (SELECT unnest([0.5, 0.8])::DOUBLE AS threshold) AS z GROUP BY threshold) AS y, n)"""


@query("threshold_reports", _REPORTS + """
SELECT round(threshold, 6) AS threshold, precision, recall, f1, false_positive_rate,
    predicted_positive FROM rep""")
def _reports(spark, sf):
    return rounded(E.threshold_reports(scored(spark, sf)), "threshold", *_RATES)


@query("calibrate_thresholds", _REPORTS + _NAMED + """
SELECT name, round(threshold, 6) AS threshold, precision, recall, f1, false_positive_rate,
    predicted_positive FROM picked""")
def _calibrate(spark, sf):
    return rounded(E.calibrate_thresholds(scored(spark, sf)), "threshold", *_RATES)


@query("effective_thresholds", _REPORTS + _NAMED + """, h AS (SELECT
    coalesce(max(threshold) FILTER (name = 'precision_at_least_0_95'), 0.8) AS high,
    coalesce(max(threshold) FILTER (name = 'recall_at_least_0_90'), 0.5) AS medium FROM picked)
SELECT round(high, 6) AS high, round(CASE WHEN medium >= high THEN 0.5 ELSE medium END, 6) AS medium
FROM h""")
def _effective(spark, sf):
    row = E.calibration_row(E.calibrate_thresholds(scored(spark, sf)))
    return rounded(D.effective_thresholds(row), "high", "medium")


@query("threshold_sandbox", _S + f""", c AS (SELECT count(*) FILTER (label = 1 AND score >= 0.6) AS tp,
    count(*) FILTER (label = 0 AND score >= 0.6) AS fp, count(*) FILTER (score < 0.2) AS pass_rows,
    count(*) FILTER (score >= 0.2 AND score < 0.6) AS review_rows FROM s)
SELECT 0.2::DOUBLE AS medium, 0.6::DOUBLE AS high, n AS rows, p AS fraud_rows, neg AS normal_rows,
    pass_rows, review_rows, tp + fp AS reject_rows, {_CONF}, tp AS true_positive,
    fp AS false_positive, p - tp AS missed_fraud, round(review_rows / n, 6) AS review_rate,
    round((tp + fp) / n, 6) AS reject_rate, round((review_rows + tp + fp) / n, 6)
    AS intervention_rate FROM c, n""")
def _sandbox(spark, sf):
    return rounded(E.threshold_sandbox(scored(spark, sf), 0.2, 0.6), *_RATES, "review_rate",
                   "reject_rate", "intervention_rate")


@query("metrics_row", _S + """, g AS (SELECT score, count(*) AS c, count(*) FILTER (label = 1) AS pc
    FROM s GROUP BY score),
r AS (SELECT pc, sum(pc) OVER (ORDER BY score DESC) / sum(c) OVER (ORDER BY score DESC) AS prec FROM g),
c AS (SELECT count(*) FILTER (label = 1 AND score >= 0.8) AS tp, count(*) FILTER (label = 0 AND
    score >= 0.8) AS fp FROM s)
SELECT 'demo' AS model_name, n AS test_rows, round((SELECT sum(pc * prec) FROM r) / p, 9) AS pr_auc,
    round(2 * tp / (tp + fp + p), 9) AS f1, round(fp / neg, 9) AS false_positive_rate_at_threshold
FROM n, c""")
def _metrics(spark, sf):
    row = E.metrics_row(scored(spark, sf), "demo", "events", 10, 5)
    return rounded(row.select("model_name", "test_rows", "pr_auc", "f1",
                              "false_positive_rate_at_threshold"),
                   "pr_auc", "f1", "false_positive_rate_at_threshold", digits=9)


@query("scorecard", _S + "SELECT label AS is_fraud, round(score, 4) AS risk_score FROM s")
def _scorecard(spark, sf):
    return rounded(E.scorecard(scored(spark, sf)), "risk_score", digits=4)


@query("class_weight", _S + "SELECT round(neg / p, 9) AS scale_pos_weight FROM n")
def _weight(spark, sf):
    return rounded(E.class_weight(scored(spark, sf)), "scale_pos_weight", digits=9)


_BOARD = WITH_TX + """, b AS (SELECT source AS model_name, source AS model_dir, split AS dataset,
    round(avg(risk_score), 9) AS pr_auc, round(avg(k) / 100, 9) AS f1,
    round(count(*) FILTER (is_fraud = 1) / count(*), 9) AS false_positive_rate_at_threshold,
    count(*) AS feedback_rows FROM tx GROUP BY source, split)"""


def _board(spark, sf) -> DataFrame:
    return tx(spark, sf).groupBy(
        F.col("source").alias("model_name"), F.col("source").alias("model_dir"),
        F.col("split").alias("dataset")).agg(
        F.round(F.avg("risk_score"), 9).alias("pr_auc"), F.round(F.avg("k") / 100, 9).alias("f1"),
        F.round(F.count_if(F.col("is_fraud") == 1) / F.count(F.lit(1)), 9)
        .alias("false_positive_rate_at_threshold"), F.count(F.lit(1)).alias("feedback_rows"))


@query("leaderboard_upsert", _BOARD + """
SELECT model_name, dataset, pr_auc, f1 FROM b WHERE NOT (dataset = 'test' AND model_name IN
    (SELECT model_name FROM b WHERE dataset = 'valid'))
UNION ALL SELECT model_name, 'test', pr_auc, f1 FROM b WHERE dataset = 'valid'""")
def _leaderboard(spark, sf):
    board = _board(spark, sf)
    entry = board.where(F.col("dataset") == "valid").withColumn("dataset", F.lit("test"))
    return E.leaderboard_upsert(board, entry).select("model_name", "dataset", "pr_auc", "f1")


@query("release_gate", _BOARD + """
SELECT c.model_name, c.pr_auc >= o.pr_auc AS pr_auc_ok, c.f1 >= o.f1 AS f1_ok,
    c.false_positive_rate_at_threshold <= o.false_positive_rate_at_threshold + 0.01 AS fpr_ok,
    c.feedback_rows > 100 AS feedback_ok, c.pr_auc >= o.pr_auc AND c.f1 >= o.f1
    AND c.false_positive_rate_at_threshold <= o.false_positive_rate_at_threshold + 0.01
    AND c.feedback_rows > 100 AS may_release
FROM b AS c JOIN b AS o ON c.model_name = o.model_name AND c.dataset = 'valid' AND o.dataset = 'train'""")
def _gate(spark, sf):
    board = _board(spark, sf)
    return E.release_gate(board.where(F.col("dataset") == "valid"),
                          board.where(F.col("dataset") == "train"))


@query("model_catalog", _BOARD + """
SELECT model_name AS name, pr_auc, f1, model_name = 'saml_d' AS loaded FROM b WHERE dataset = 'train'""")
def _catalog(spark, sf):
    board = cut(_board(spark, sf).where(F.col("dataset") == "train"), "board")
    root = scratch_path(spark, "models")
    for name in ("paysim", "banksim", "ieee_cis", "creditcard", "saml_d"):
        board.where(F.col("model_name") == name).coalesce(1).write.json(f"{root}/{name}/latest")
    return E.model_catalog(spark, f"{root}/*/latest/*.json", "saml_d").select(
        "name", "pr_auc", "f1", "loaded")


# ---------------------------------------------------------------- features and models
@query("select_features", WITH_TX + """
SELECT 'amount' AS feature, FALSE AS categorical, round(quantile_cont(amount, 0.5), 6) AS fill FROM tx
    WHERE is_fraud IN (0, 1)
UNION ALL SELECT 'k', FALSE, quantile_cont(k, 0.5) FROM tx WHERE is_fraud IN (0, 1)
UNION ALL SELECT 'source', TRUE, NULL UNION ALL SELECT 'txn_type', TRUE, NULL""")
def _select(spark, sf):
    base = tx(spark, sf).select("transaction_id", "is_fraud", "timestamp", "payer_id", "source",
                                "txn_type", "amount", "k", "is_injected", "fraud_group_id")
    contract = L.select_features(base)
    rows = [(c, c in contract.categorical_columns, contract.numeric_fill_values.get(c))
            for c in contract.feature_columns]
    return rounded(spark.createDataFrame(rows, "feature string, categorical boolean, fill double"), "fill")


@query("ordinal_encode", WITH_TX + """, c AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (
    SELECT DISTINCT coalesce(txn_type, '__missing__') AS v FROM tx WHERE split = 'train'
        AND txn_type IS DISTINCT FROM 'debit') AS q)
SELECT transaction_id, CAST(coalesce(code, -1) AS DOUBLE) AS txn_type
FROM tx LEFT JOIN c ON coalesce(txn_type, '__missing__') = v""")
def _encode(spark, sf):
    base = tx(spark, sf)
    train = base.where((F.col("split") == "train") & ~F.col("txn_type").eqNullSafe("debit"))
    codes = L.fit_categories(train, ["txn_type"])
    return L.ordinal_encode(base.select("transaction_id", "txn_type"), codes, ["txn_type"])


def training_table(spark, sf) -> DataFrame:
    """Transactions with windows, graph degrees and profiles, written once."""
    def build() -> DataFrame:
        base = d(spark, sf)
        step = stepwise(base)
        wide = W.window_features(base.select(
            "transaction_id", "timestamp", "source", "amount", "txn_type", "payer_id", "payee_id",
            "merchant_id", "device_id", "ip_id", "is_fraud", "split"), step=step)
        degrees = cut(A.entity_degree(G.tx_edges(base)), "degrees")
        wide = attach_graph_features(wide, degrees, step=step)
        return enrich_profiles(wide, P.all_profiles(base), step)

    return settled(spark, build, "training")


def _fit(spark, sf, fit, least_auc: float) -> DataFrame:
    def build() -> DataFrame:
        table = training_table(spark, sf)
        train, valid, test = (table.where(F.col("split") == s) for s in ("train", "valid", "test"))
        contract = L.select_features(train)
        model = fit(train, valid, contract)
        return L.score_batch(model, D.labelled_only(test)).select("transaction_id", "is_fraud", "risk_score")

    return judged(settled(spark, build, "scored"), least_auc)


def judged(scores: DataFrame, least_auc: float, key: str = "transaction_id", label: str = "is_fraud",
           score: str = "risk_score") -> DataFrame:
    """Scored rows with what must hold: scores lie in [0, 1], those of fraud are higher on average, and
    the area under the ROC curve reaches ``least_auc``. Rows of one label only have no area to reach."""
    scores = cut(scores, "scores")
    mean = lambda value: F.avg(F.when(F.col(label) == value, F.col(score)))
    apart = scores.agg(F.coalesce(mean(1) > mean(0), F.lit(True)).alias("apart")).scalar()
    area = E.roc_auc(scores, label, score)
    both = scores.agg((F.countDistinct(label) == 2).alias("both")).scalar()
    return scores.select(key, F.col(label).cast("int").alias(label), F.col(score).between(0, 1).alias("in_range"),
                         apart.alias("fraud_scores_higher"), F.lit(least_auc).alias("least_auc"),
                         (~both | (area.scalar() >= least_auc)).alias("auc_reached"))


def judged_sql(least_auc: float) -> str:
    return WITH_D + f"""
SELECT transaction_id, CAST(is_fraud AS INT) AS is_fraud, TRUE AS in_range, TRUE AS fraud_scores_higher,
    CAST({least_auc} AS DOUBLE) AS least_auc, TRUE AS auc_reached
FROM d WHERE split = 'test' AND is_fraud IN (0, 1)"""


@query("fit_logistic", judged_sql(0.95))
def _logistic(spark, sf):
    return _fit(spark, sf, lambda train, valid, c: L.fit_logistic(train, c), 0.95)


@query("fit_gbt", judged_sql(0.95))
def _gbt(spark, sf):
    return _fit(spark, sf, L.fit_gbt, 0.95)


@query("fit_trees", judged_sql(0.95))
def _trees(spark, sf):
    return _fit(spark, sf, lambda train, valid, c: L.fit_trees(train, c), 0.95)


@query("fit_isolation", judged_sql(0.65))
def _isolation(spark, sf):
    return _fit(spark, sf, lambda train, valid, c: L.fit_isolation(train, c), 0.65)


@query("score_batch", WITH_D + """
SELECT transaction_id, TRUE AS in_range, TRUE AS level_follows, TRUE AS decision_follows FROM d""")
def _score_batch(spark, sf):
    """All rows scored by a model fitted on the train split, with decisions that follow from the score."""
    base = d(spark, sf).select("transaction_id", "amount", "txn_type", "source", "is_fraud", "split",
                               "payer_country")
    train = base.where(F.col("split") == "train")
    model = L.fit_logistic(train, L.select_features(train))
    level, action = D.risk_decision("risk_score")
    score = F.col("risk_score")
    by_score = lambda high, middle, low: F.when(score >= 0.8, high).when(score >= 0.5, middle).otherwise(low)
    return L.score_batch(model, base).select(
        "transaction_id", score.between(0, 1).alias("in_range"),
        (level == by_score("high", "medium", "low")).alias("level_follows"),
        (action == by_score("reject", "review", "pass")).alias("decision_follows"))


@query("node_risk_model", WITH_EDGES + """
SELECT node_id, CAST(max(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS INT) AS node_label, TRUE AS in_range,
    TRUE AS fraud_scores_higher, CAST(0.6 AS DOUBLE) AS least_auc, TRUE AS auc_reached
FROM (SELECT src_id AS node_id, label FROM edges UNION ALL SELECT dst_id, label FROM edges) AS e
GROUP BY node_id""")
def _node_model(spark, sf):
    scored = L.node_risk_model(cut(G.tx_edges(d(spark, sf)), "edges"))
    return judged(scored, 0.6, "node_id", "node_label", "node_risk_score")


# ---------------------------------------------------------------- feedback
_FB = WITH_TX + """, fb AS (SELECT CASE WHEN k % 5 = 0 THEN 'new:' || event_id ELSE transaction_id END
    AS transaction_id, r AS seq, CASE WHEN k % 8 = 7 THEN 7 ELSE (k + r) % 2 END AS reviewed_is_fraud
    FROM tx, (SELECT unnest([1, 2, 3]) AS r) AS x WHERE k % 6 = 0)"""


def _reviews(spark, sf) -> DataFrame:
    return (tx(spark, sf).where(F.col("k") % 6 == 0)
            .withColumn("seq", F.explode(F.array(*map(F.lit, (1, 2, 3)))))
            .select(F.when(F.col("k") % 5 == 0, F.concat(F.lit("new:"), F.col("event_id").cast("string")))
                    .otherwise(F.col("transaction_id")).alias("transaction_id"), "seq",
                    F.when(F.col("k") % 8 == 7, 7).otherwise((F.col("k") + F.col("seq")) % 2)
                    .alias("reviewed_is_fraud")))


@query("feedback_normalize", _FB + """
SELECT transaction_id, seq, CAST(reviewed_is_fraud AS TINYINT) AS is_fraud FROM fb
WHERE reviewed_is_fraud IN (0, 1)""")
def _fb_normal(spark, sf):
    return B.feedback_normalize(_reviews(spark, sf)).select("transaction_id", "seq", "is_fraud")


@query("anti_known_feedback", _FB + """
SELECT transaction_id, seq FROM fb WHERE transaction_id NOT IN (SELECT transaction_id FROM tx)""")
def _fb_anti(spark, sf):
    return B.anti_known_feedback(_reviews(spark, sf), tx(spark, sf)).select("transaction_id", "seq")


@query("feedback_apply", _FB + """, last AS (SELECT transaction_id, reviewed_is_fraud AS lab FROM fb
    WHERE reviewed_is_fraud IN (0, 1) QUALIFY row_number() OVER (PARTITION BY transaction_id
    ORDER BY seq DESC) = 1)
SELECT t.transaction_id, t.amount, CAST(coalesce(lab, is_fraud) AS TINYINT) AS is_fraud, split
    FROM tx AS t LEFT JOIN last USING (transaction_id)
UNION ALL SELECT transaction_id, NULL, CAST(reviewed_is_fraud AS TINYINT), 'train' FROM fb
    WHERE reviewed_is_fraud IN (0, 1) AND transaction_id NOT IN (SELECT transaction_id FROM tx)""")
def _fb_apply(spark, sf):
    base = tx(spark, sf).select("transaction_id", "amount", "is_fraud", "split")
    return B.feedback_apply(base, _reviews(spark, sf), ["seq"])


@query("feedback_retrain", _FB + """, last AS (SELECT transaction_id, reviewed_is_fraud AS lab FROM fb
    WHERE reviewed_is_fraud IN (0, 1) QUALIFY row_number() OVER (PARTITION BY transaction_id
    ORDER BY seq DESC) = 1),
a AS (SELECT coalesce(lab, greatest(coalesce(is_fraud, -1), -1)) AS lab, split FROM tx LEFT JOIN last USING (transaction_id)
    UNION ALL SELECT reviewed_is_fraud, 'train' FROM fb
    WHERE reviewed_is_fraud IN (0, 1) AND transaction_id NOT IN (SELECT transaction_id FROM tx))
SELECT 'candidate' AS model_name, count(*) FILTER (split = 'train') AS train_rows,
    count(*) FILTER (split = 'valid') AS valid_rows, count(*) FILTER (split = 'test') AS test_rows,
    (SELECT count(*) FROM fb WHERE reviewed_is_fraud IN (0, 1)) AS feedback_rows, 3 AS feature_count
FROM a WHERE lab IN (0, 1)""")
def _retrain(spark, sf):
    """A candidate model on the relabelled train split, scored on the test split."""
    base = d(spark, sf).select("transaction_id", "amount", "txn_type", "source", "is_fraud", "split")
    reviews = cut(_reviews(spark, sf), "reviews")
    table = cut(B.feedback_apply(base, reviews, ["seq"]), "relabelled")
    train = table.where(F.col("split") == "train")
    contract = L.select_features(train)
    model = L.fit_logistic(train, contract)
    scores = L.score_batch(model, D.labelled_only(table.where(F.col("split") == "test")))
    used = D.labelled_only(table).groupBy("split").count().collect()  # one row per split
    rows = {r["split"]: r["count"] for r in used}
    return E.metrics_row(
        cut(scores, "scores"), "candidate", "events", rows.get("train", 0), rows.get("valid", 0),
        feedback_rows=B.feedback_normalize(reviews).count(), feature_count=len(contract.feature_columns),
        with_window_features=False, with_graph_features=False, key="transaction_id").select(
        "model_name", "train_rows", "valid_rows", "test_rows", "feedback_rows", "feature_count")


# ---------------------------------------------------------------- data quality
def _log(spark, sf) -> DataFrame:
    return D.risk_fields(D.calendar_fields(d(spark, sf))).withColumns(
        {"channel": F.lit("web"), "payment_method": D.payment_method("txn_type")})


@query("dq_transactions", WITH_TX + """
SELECT 'transaction_required_columns' AS name, TRUE AS ok, '' AS detail
UNION ALL SELECT 'transaction_id_unique', count(*) = count(DISTINCT transaction_id),
    CAST(count(*) - count(DISTINCT transaction_id) AS VARCHAR) FROM tx
UNION ALL SELECT 'manifest_transaction_count', count(*) = 9999, CAST(count(*) AS VARCHAR) FROM tx
UNION ALL SELECT 'timestamp_not_null', count(*) FILTER (timestamp IS NULL) = 0,
    CAST(count(*) FILTER (timestamp IS NULL) AS VARCHAR) FROM tx
UNION ALL SELECT 'is_fraud_values', TRUE, '0'
UNION ALL SELECT 'amount_non_negative', count(*) FILTER (amount < 0) = 0,
    CAST(count(*) FILTER (amount < 0) AS VARCHAR) FROM tx
UNION ALL SELECT 'transaction_sources_present', count(DISTINCT source) >= 6,
    CAST(count(DISTINCT source) AS VARCHAR) FROM tx""")
def _dq_tx(spark, sf):
    return Q.dq_transactions(_log(spark, sf), expected_rows=9999)


@query("dq_splits", WITH_TX + """
SELECT 'split_column:' || p AS name, p <> 'valid' OR (SELECT count(*) FROM tx WHERE split = 'valid'
    AND k % 50 = 0) = 0 AS ok, CASE WHEN p = 'valid' THEN (SELECT CAST(count(*) AS VARCHAR) FROM tx
    WHERE split = 'valid' AND k % 50 = 0) ELSE '0' END AS detail
    FROM (SELECT unnest(['train', 'valid', 'test', 'unlabeled']) AS p) AS q
UNION ALL SELECT 'split_total_matches_transaction_log', TRUE, CAST(count(*) AS VARCHAR) FROM tx
UNION ALL SELECT 'labeled_time_order', TRUE, '' UNION ALL SELECT 'unlabeled_labels', TRUE, '0'""")
def _dq_splits(spark, sf):
    log = tx(spark, sf)
    bad = (F.col("split") == "valid") & (F.col("k") % 50 == 0)
    parts = log.select("transaction_id", "timestamp", "is_fraud", F.col("split").alias("part"),
                       F.when(bad, "test").otherwise(F.col("split")).alias("split"))
    return Q.dq_splits(parts, log)


@query("dq_profiles", WITH_D + """
SELECT 'payer_profile_coverage' AS name, TRUE AS ok, '0' AS detail
UNION ALL SELECT 'merchant_profile_coverage', TRUE, '0'
UNION ALL SELECT 'device_profile_coverage', count(*) = 0, CAST(count(*) AS VARCHAR) FROM d
    WHERE device_id IS NOT NULL AND device_id NOT IN (SELECT device_id FROM d WHERE split = 'test'
    AND device_id IS NOT NULL AND k % 9 = 0)
UNION ALL SELECT 'ip_profile_coverage', TRUE, '0'""")
def _dq_profiles(spark, sf):
    base = d(spark, sf)
    profiles = P.all_profiles(base)
    few = base.where((F.col("split") == "test") & (F.col("k") % 9 == 0))
    profiles["device"] = few.where(F.col("device_id").isNotNull()).select("device_id").distinct()
    return Q.dq_profiles(base, profiles)


@query("dq_graph", WITH_D + """
SELECT 'graph_edge_required_columns' AS name, TRUE AS ok, '' AS detail
UNION ALL SELECT 'graph_node_id_unique', TRUE, '0'
UNION ALL SELECT 'graph_edge_types_present', TRUE, '5'
UNION ALL SELECT 'graph_edge_src_coverage', TRUE, '0'
UNION ALL SELECT 'graph_edge_dst_coverage', count(*) = 0, CAST(count(*) AS VARCHAR) FROM d
    WHERE merchant_id IS NOT NULL AND merchant_id NOT IN (SELECT payer_id FROM d)""")
def _dq_graph(spark, sf):
    from ledgerlens.plans.dataset import build_graph

    nodes, edges = build_graph(d(spark, sf))
    return Q.dq_graph(nodes.where(F.col("node_type") != "merchant"), edges)


@query("dq_stream", WITH_TX + """
SELECT 'transaction_stream_jsonl_sample' AS name, count(*) FILTER (k % 20 = 3 OR k % 20 = 4) = 0 AS ok,
    CAST(count(*) FILTER (k % 20 = 3 OR k % 20 = 4) AS VARCHAR) AS detail FROM tx""")
def _dq_stream(spark, sf):
    keys = F.struct("transaction_id", "source", "payer_id", "payee_id", "amount", "txn_type",
                    F.lit("low").alias("risk_level"))
    line = (F.when(F.col("k") % 20 == 3, "{broken").when(F.col("k") % 20 == 4, '{"source": "x"}')
            .otherwise(F.to_json(keys, {"ignoreNullFields": "false"})))
    return Q.dq_stream(tx(spark, sf).select(line.alias("value")))


@query("dq_manifest_counts", WITH_TX + """
SELECT 'manifest_count:transaction_log' AS name, TRUE AS ok, CAST(count(*) AS VARCHAR) AS detail FROM tx
UNION ALL SELECT 'manifest_count:payers', FALSE, CAST(count(DISTINCT payer_id) AS VARCHAR) FROM tx""")
def _dq_manifest(spark, sf):
    base = tx(spark, sf)
    payers = base.select("payer_id").distinct()
    manifest = base.agg(F.explode(F.array(
        F.struct(F.lit("transaction_log").alias("table"), F.count(F.lit(1)).alias("rows")),
        F.struct(F.lit("payers").alias("table"), F.lit(-1).cast("bigint").alias("rows")))).alias("_m")
    ).select("_m.*")
    return Q.dq_manifest_counts({"transaction_log": base, "payers": payers}, manifest)


@query("dq_report", WITH_TX + """
SELECT FALSE AS ok, CAST(7 AS BIGINT) AS checks, CAST(2 AS BIGINT) AS failed,
    'manifest_transaction_count,transaction_sources_present' AS failed_checks
FROM (SELECT count(*) AS n FROM tx) AS q WHERE n <> 9999""")
def _dq_report(spark, sf):
    return Q.dq_report([Q.dq_transactions(_log(spark, sf), expected_rows=9999)])
