"""Public payment datasets as CSV, read into the core transaction schema or into graph tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens import schema as S
from ledgerlens.functions.scalar import add_micros, add_seconds, round_half_even
from ledgerlens.operators.joins import alert_account_flag, node_timestamp_lookup

# Columns of each file, in file order.
PAYSIM = ("step int, type string, amount double, nameOrig string, oldbalanceOrg double, "
          "newbalanceOrig double, nameDest string, oldbalanceDest double, newbalanceDest double, "
          "isFraud int, isFlaggedFraud int")
BANKSIM = ("step int, customer string, age string, gender string, zipcodeOri string, "
           "merchant string, zipMerchant string, category string, amount double, fraud int")
CREDITCARD = "Time double, " + ", ".join(f"V{i} double" for i in range(1, 29)) + ", Amount double, Class int"
SAML = ("Time string, Date string, Sender_account string, Receiver_account string, Amount double, "
        "Payment_currency string, Received_currency string, Sender_bank_location string, "
        "Receiver_bank_location string, Payment_type string, Is_laundering int, "
        "Laundering_type string")
AML_TX = ("TXN_ID string, ACCOUNT_ID string, COUNTER_PARTY_ACCOUNT_NUM string, "
          "TXN_SOURCE_TYPE_CODE string, TXN_AMOUNT_ORIG double, start int, end int")
AML_CASH = ("TXN_ID string, ACCOUNT_ID string, BRANCH_ID string, TXN_SOURCE_TYPE_CODE string, "
            "TXN_AMOUNT_ORIG double, RUN_DATE int")
CARD_NETWORK = "Source string, Target string, Weight double, typeTrans string, fraud int"

# Payment types of the laundering dataset.
SAML_TYPES = {
    "Cash Deposit": "cash_in",
    "Cash Withdrawal": "cash_out",
    "Cross-border": "cross_border_transfer",
    "Make Payment": "payment",
    "Pay by Cash": "cash_payment",
    "Pay by Cheque": "cheque",
    "Online Purchase": "online_payment",
    "Local Transfer": "transfer",
    "Mobile Top-Up": "topup",
}
# Text columns of the e-commerce dataset; its other columns are numbers.
IEEE_TEXT = frozenset((
    "ProductCD", "card4", "card6", "P_emaildomain", "R_emaildomain", "DeviceType", "DeviceInfo",
    *[f"M{i}" for i in range(1, 10)],
    *[f"id_{i}" for i in (12, 15, 16, 23, 27, 28, 29, 30, 31, 33, 34, 35, 36, 37, 38)],
))


def read_csv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """A CSV file by column name, whatever the order of the header."""
    raw = spark.read.option("header", header).option("enforceSchema", not header)
    if not header:
        return raw.schema(schema).csv(path)
    text = raw.csv(path)
    wanted = spark.createDataFrame([], schema).schema
    return text.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in wanted
                         if f.name in text.columns])


def numbered(df: DataFrame, out: str = "row_no") -> DataFrame:
    """0-based row number in file order, without sorting or passing rows through Python.

    Rows of one file block stay together and in order in a scan task; a table with one row per
    block gives what lies before each block.
    """
    marked = df.select("*", F.input_file_name().alias("_file"),
                       F.input_file_block_start().alias("_block"),
                       F.monotonically_increasing_id().alias("_slot"))
    earlier = (Window.orderBy("_bfile", "_bstart")
               .rowsBetween(Window.unboundedPreceding, -1))
    blocks = (marked.groupBy(F.col("_file").alias("_bfile"), F.col("_block").alias("_bstart"))
              .agg(F.count(F.lit(1)).alias("_n"), F.min("_slot").alias("_first"))
              .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))))
    on = [F.col("_file") == F.col("_bfile"), F.col("_block") == F.col("_bstart")]
    return (marked.join(blocks, on)
            .withColumn(out, F.col("_before") + F.col("_slot") - F.col("_first"))
            .select(*df.columns, out))


def _core(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    types = {f.name: f.dataType for f in S.CORE_SCHEMA}
    return df.select(*[columns[c].cast(types[c]).alias(c) for c in S.CORE_COLUMNS])


def _id(prefix: str, value: Column | str) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.concat(F.lit(prefix), value.cast("string"))


def _after(hours: Column | None = None, days: Column | None = None,
           seconds: Column | None = None) -> Column:
    start = F.lit(S.WINDOW_START)
    if seconds is not None:
        return add_micros(start, F.round(seconds * 1_000_000).cast("bigint"))
    whole = hours * 3600 if hours is not None else days * 86400
    return add_seconds(start, whole.cast("bigint"))


def _none() -> Column:
    return F.lit(None).cast("string")


# ---------------------------------------------------------------- mobile money
def paysim_raw(spark: SparkSession, path: str) -> DataFrame:
    return numbered(read_csv(spark, path, PAYSIM))


def src_paysim(raw: DataFrame) -> DataFrame:
    return _core(raw, {
        "transaction_id": _id("paysim:", "row_no"), "source": F.lit("paysim"),
        "timestamp": _after(hours=F.col("step")), "amount": F.col("amount"),
        "currency": F.lit("USD"), "txn_type": F.lower("type"),
        "payer_id": _id("paysim_u:", "nameOrig"), "payee_id": _id("paysim_u:", "nameDest"),
        "merchant_id": F.when(F.col("nameDest").startswith("M"), _id("paysim_m:", "nameDest")),
        "merchant_category": _none(), "payer_country": F.lit("SG"), "payee_country": F.lit("SG"),
        "is_fraud": F.col("isFraud"),
        "fraud_subtype": F.when(F.col("isFlaggedFraud") == 1, "rule_flagged"),
    })


def src_paysim_balances(raw: DataFrame) -> DataFrame:
    f = lambda c, name: F.col(c).cast("float").alias(name)
    return raw.select(
        _id("paysim:", "row_no").alias("transaction_id"),
        f("oldbalanceOrg", "payer_old_balance"), f("newbalanceOrig", "payer_new_balance"),
        f("oldbalanceDest", "payee_old_balance"), f("newbalanceDest", "payee_new_balance"))


# ---------------------------------------------------------------- bank payments
def unquote(column: str) -> Column:
    return F.btrim(F.col(column), F.lit("'"))


def banksim_raw(spark: SparkSession, path: str) -> DataFrame:
    return numbered(read_csv(spark, path, BANKSIM))


def src_banksim(raw: DataFrame) -> DataFrame:
    merchant = _id("banksim_m:", unquote("merchant"))
    return _core(raw, {
        "transaction_id": _id("banksim:", "row_no"), "source": F.lit("banksim"),
        "timestamp": _after(days=F.col("step")), "amount": F.col("amount"),
        "currency": F.lit("USD"), "txn_type": F.lit("card_payment"),
        "payer_id": _id("banksim_u:", unquote("customer")), "payee_id": merchant,
        "merchant_id": merchant, "merchant_category": unquote("category"),
        "payer_country": F.lit("ES"), "payee_country": F.lit("ES"),
        "is_fraud": F.col("fraud"), "fraud_subtype": _none(),
    })


def src_banksim_features(raw: DataFrame) -> DataFrame:
    return raw.select(
        _id("banksim:", "row_no").alias("transaction_id"), unquote("age").alias("user_age_bucket"),
        unquote("gender").alias("user_gender"), unquote("zipcodeOri").alias("user_zipcode"),
        unquote("zipMerchant").alias("merchant_zipcode"))


def src_card_network(spark: SparkSession, path: str) -> DataFrame:
    """Weighted payer to merchant edges."""
    raw = read_csv(spark, path, CARD_NETWORK)
    return raw.select(
        _id("banksim_u:", unquote("Source")).alias("src_id"),
        _id("banksim_m:", unquote("Target")).alias("dst_id"), F.lit("user").alias("src_type"),
        F.lit("merchant").alias("dst_type"), F.lit("banksim_payment_network").alias("edge_type"),
        F.col("Weight").alias("weight"),
        F.lit(S.WINDOW_START).cast("timestamp_ntz").alias("timestamp"),
        F.lit("banksim_net").alias("source"), F.col("fraud").cast("tinyint").alias("label"))


# ---------------------------------------------------------------- card payments
def creditcard_raw(spark: SparkSession, path: str) -> DataFrame:
    return numbered(read_csv(spark, path, CREDITCARD))


def src_creditcard(raw: DataFrame) -> DataFrame:
    return _core(raw, {
        "transaction_id": _id("cc:", "row_no"), "source": F.lit("creditcard"),
        "timestamp": _after(seconds=F.col("Time")), "amount": F.col("Amount"),
        "currency": F.lit("EUR"), "txn_type": F.lit("card_payment"),
        "payer_id": _id("cc_u:", "row_no"), "payee_id": F.lit("cc_unknown"),
        "merchant_id": _none(), "merchant_category": _none(), "payer_country": F.lit("EU"),
        "payee_country": F.lit("EU"), "is_fraud": F.col("Class"), "fraud_subtype": _none(),
    })


def src_creditcard_pca(raw: DataFrame) -> DataFrame:
    return raw.select(_id("cc:", "row_no").alias("transaction_id"),
                      *[F.col(f"V{i}").cast("float").alias(f"V{i}") for i in range(1, 29)])


# ---------------------------------------------------------------- laundering
def saml_raw(spark: SparkSession, path: str) -> DataFrame:
    return numbered(read_csv(spark, path, SAML))


def src_saml_d(raw: DataFrame) -> DataFrame:
    names = F.create_map(*[F.lit(x) for pair in SAML_TYPES.items() for x in pair])
    kind = F.col("Payment_type")
    return _core(raw, {
        "transaction_id": _id("saml:", "row_no"), "source": F.lit("saml_d"),
        "timestamp": F.concat_ws(" ", "Date", "Time").try_cast("timestamp_ntz"),
        "amount": F.col("Amount"), "currency": F.col("Payment_currency"),
        "txn_type": F.coalesce(F.try_element_at(names, kind),
                               F.replace(F.lower(kind), F.lit(" "), F.lit("_"))),
        "payer_id": _id("saml_a:", "Sender_account"), "payee_id": _id("saml_a:", "Receiver_account"),
        "merchant_id": _none(), "merchant_category": _none(),
        "payer_country": F.col("Sender_bank_location"),
        "payee_country": F.col("Receiver_bank_location"), "is_fraud": F.col("Is_laundering"),
        "fraud_subtype": F.when(F.col("Is_laundering") == 1, F.col("Laundering_type")),
    })


def src_aml_accounts(spark: SparkSession, tx_path: str, cash_path: str,
                     alerts_path: str | None = None) -> DataFrame:
    """Transfers and cash movements; fraud where an account is in the alert set."""
    if alerts_path:
        alerts = read_csv(spark, alerts_path, "ACCOUNT_ID string")
    else:
        alerts = spark.createDataFrame([], "ACCOUNT_ID string")
    tx = alert_account_flag(read_csv(spark, tx_path, AML_TX), alerts,
                            ["ACCOUNT_ID", "COUNTER_PARTY_ACCOUNT_NUM"], "ACCOUNT_ID")
    cash = alert_account_flag(read_csv(spark, cash_path, AML_CASH), alerts, ["ACCOUNT_ID"],
                              "ACCOUNT_ID")
    common = {
        "source": F.lit("amlsim_sample"), "amount": F.col("TXN_AMOUNT_ORIG"),
        "currency": F.lit("USD"), "txn_type": F.lower("TXN_SOURCE_TYPE_CODE"),
        "payer_id": _id("amlsim_a:", "ACCOUNT_ID"), "payer_country": F.lit("US"),
        "payee_country": F.lit("US"), "is_fraud": F.col("is_alert"),
        "fraud_subtype": F.when(F.col("is_alert") == 1, "cycle"),
    }
    branch = _id("amlsim_branch:", "BRANCH_ID")
    transfers = _core(tx, {
        **common, "transaction_id": _id("amlsim_tx:", "TXN_ID"),
        "timestamp": _after(days=F.col("start")),
        "payee_id": _id("amlsim_a:", "COUNTER_PARTY_ACCOUNT_NUM"), "merchant_id": _none(),
        "merchant_category": F.lit("aml_transfer")})
    deposits = _core(cash, {
        **common, "transaction_id": _id("amlsim_cash:", "TXN_ID"),
        "timestamp": _after(days=F.col("RUN_DATE")), "payee_id": branch, "merchant_id": branch,
        "merchant_category": F.lit("cash_service")})
    return transfers.unionByName(deposits)


# ---------------------------------------------------------------- e-commerce
def _whole(column: str) -> Column:
    return F.col(column).try_cast("double").cast("bigint").cast("string")


def _ieee_part(raw: DataFrame, labelled: bool) -> DataFrame:
    label = F.col("isFraud").try_cast("int") if labelled else F.lit(-1)
    return _core(raw, {
        "transaction_id": _id("ieee:", "TransactionID"), "source": F.lit("ieee_cis"),
        "timestamp": _after(seconds=F.col("TransactionDT").try_cast("double")),
        "amount": F.col("TransactionAmt").try_cast("double"), "currency": F.lit("USD"),
        "txn_type": F.col("ProductCD"),
        "payer_id": _id("ieee_card:", F.coalesce(_whole("card1"), F.lit("<NA>"))),
        "payee_id": F.coalesce(_id("ieee_addr:", _whole("addr1")), F.lit("ieee_unknown")),
        "merchant_id": _none(), "merchant_category": F.col("ProductCD"),
        "payer_country": _whole("addr2"), "payee_country": _none(), "is_fraud": label,
        "fraud_subtype": _none(),
    })


def ieee_raw(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path)


def src_ieee_cis(train: DataFrame, test: DataFrame) -> DataFrame:
    return _ieee_part(train, True).unionByName(_ieee_part(test, False))


def src_ieee_features(parts: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(transactions, identity) pairs joined and stacked; numbers as FLOAT."""
    out = None
    for transactions, identity in parts:
        both = transactions.join(identity, "TransactionID", "left")
        part = both.select(
            _id("ieee:", "TransactionID").alias("transaction_id"),
            *[F.col(c) if c in IEEE_TEXT else F.col(c).try_cast("float").alias(c)
              for c in both.columns if c != "TransactionID"])
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


# ---------------------------------------------------------------- graphs
def src_crypto_graph(spark: SparkSession, classes_path: str, edges_path: str,
                     features_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes with class and time step; edges with the time of their source node."""
    classes = read_csv(spark, classes_path, "txId string, class string")
    if features_path:
        steps = read_csv(spark, features_path, "txId string, time_step int", header=False)
        classes = classes.join(steps, "txId", "left")
    else:
        classes = classes.withColumn("time_step", F.lit(None).cast("int"))
    label = F.when(F.col("class") == "1", 1).when(F.col("class") == "2", 0).otherwise(-1)
    nodes = classes.select(
        _id("elliptic_tx:", "txId").alias("node_id"), F.lit("crypto_transaction").alias("node_type"),
        F.lit("elliptic").alias("source"), label.cast("tinyint").alias("label"),
        F.col("class").alias("raw_label"), F.col("time_step").cast("smallint").alias("time_step"),
        _after(days=F.coalesce("time_step", F.lit(0))).alias("timestamp"))
    kind = F.lit("crypto_transaction")
    raw = read_csv(spark, edges_path, "txId1 string, txId2 string").select(
        _id("elliptic_tx:", "txId1").alias("src_id"), _id("elliptic_tx:", "txId2").alias("dst_id"),
        kind.alias("src_type"), kind.alias("dst_type"),
        F.lit("elliptic_money_flow").alias("edge_type"), F.lit(1.0).alias("weight"),
        F.lit("elliptic").alias("source"), F.lit(-1).cast("tinyint").alias("label"))
    return nodes, node_timestamp_lookup(raw, nodes).select(*S.EDGE_COLUMNS)


def src_user_relation_graph(edges: DataFrame, users: DataFrame, feature_cap: int | None = None,
                            ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and node features of a social relation graph.

    ``edges``: src, dst, edge_type, edge_timestamp; ``users``: node, y, x (array of numbers).
    Edge times are stretched onto the window.
    """
    span = edges.agg(F.min("edge_timestamp").alias("lo"), F.max("edge_timestamp").alias("hi"))
    lo, hi = span.select("lo").scalar(), span.select("hi").scalar()
    share = (F.col("edge_timestamp") - lo) / F.greatest(hi - lo, F.lit(1))
    seconds = round_half_even(share * S.WINDOW_SECONDS, 0).cast("bigint")
    out_edges = edges.select(
        _id("dgraph_u:", "src").alias("src_id"), _id("dgraph_u:", "dst").alias("dst_id"),
        F.lit("user").alias("src_type"), F.lit("user").alias("dst_type"),
        F.lit("dgraph_relation").alias("edge_type"), F.lit(1.0).alias("weight"),
        add_seconds(F.lit(S.WINDOW_START), seconds).alias("timestamp"),
        F.lit("dgraphfin").alias("source"), F.lit(-1).cast("tinyint").alias("label"),
        F.col("edge_type").cast("smallint").alias("edge_subtype"))
    used = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    known = users.join(used, "node", "left_semi")
    label = F.when(F.col("y") == 1, 1).when(F.col("y") == 0, 0).otherwise(-1)
    nodes = known.select(
        _id("dgraph_u:", "node").alias("node_id"), F.lit("user").alias("node_type"),
        F.lit("dgraphfin").alias("source"), label.cast("tinyint").alias("label"),
        F.col("y").cast("string").alias("raw_label"), F.lit(None).cast("smallint").alias("time_step"),
        F.lit(None).cast("timestamp_ntz").alias("timestamp"))
    capped = known if feature_cap is None else known.orderBy("node").limit(feature_cap)
    features = capped.select(_id("dgraph_u:", "node").alias("node_id"), F.col("x").alias("features"))
    return nodes, out_edges, features
