"""Fraud rings: components of payers that share risky resources or pay each other.

Transactions are reduced to (payer, resource) and (payer) totals before any join, so an entity
that holds a third of the rows is a handful of rows by the time rings are put together.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens import schema as S
from ledgerlens.functions.scalar import first_reasons
from ledgerlens.operators.components import connected_components
from ledgerlens.operators.derive import entity_type_from_prefix, group_risk_level
from ledgerlens.operators.ordering import exact_quantiles, running_position, top_per_group
from ledgerlens.session import cut

# Kind, column, fewest sharing payers, fewest fraud rows; in order of precedence.
RESOURCE_KINDS = (
    ("device", "device_id", 2, 1),
    ("ip", "ip_id", 3, 1),
    ("merchant", "merchant_id", 4, 2),
    ("payee", "payee_id", 3, 2),
)
SWEEP = (0.35, 0.55, 0.65, 0.75)


def _per_kind(kind: Column, position: int) -> Column:
    out = F.lit(None).cast("int")
    for spec in RESOURCE_KINDS:
        out = F.when(kind == spec[0], F.lit(spec[position])).otherwise(out)
    return out


def resource_touches(tx: DataFrame) -> DataFrame:
    """One row per transaction and resource it uses."""
    uses = F.array(*[F.struct(F.lit(i).alias("kind_order"), F.lit(kind).alias("entity_type"),
                              F.col(column).cast("string").alias("entity_id"))
                     for i, (kind, column, _, _) in enumerate(RESOURCE_KINDS)])
    return (tx.where(F.col("payer_id").isNotNull())
            .select("payer_id", "transaction_id", "amount", "is_fraud", "is_injected",
                    "injection_scenario", F.explode(uses).alias("_u"))
            .select("*", "_u.*").drop("_u").where(F.col("entity_id").isNotNull()))


def payer_resource_pairs(tx: DataFrame) -> DataFrame:
    return resource_touches(tx).groupBy("kind_order", "entity_type", "entity_id", "payer_id").agg(
        F.count("transaction_id").alias("txn_count"), F.sum("amount").alias("amount_sum"),
        F.sum("is_fraud").alias("fraud_seed_count"), F.sum("is_injected").alias("injected_count"))


def resource_stats(tx: DataFrame, max_users: int | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """Totals of every resource with enough payers for its kind; with ``max_users``, not too many.

    ``pairs`` passes in ``payer_resource_pairs(tx)`` where it is already written.
    """
    key = ["kind_order", "entity_type", "entity_id"]
    pairs = payer_resource_pairs(tx) if pairs is None else pairs
    totals = pairs.groupBy(*key).agg(
        F.count(F.lit(1)).alias("shared_user_count"),
        *[F.sum(c).alias(c) for c in ("txn_count", "amount_sum", "fraud_seed_count",
                                      "injected_count")])
    scenarios = (resource_touches(tx.where(F.col("injection_scenario").isNotNull()))
                 .select(*key, "injection_scenario").distinct()
                 .groupBy(*key).agg(F.count(F.lit(1)).alias("scenario_count")))
    users = F.col("shared_user_count")
    kept = totals.where(users >= _per_kind(F.col("entity_type"), 2))
    if max_users is not None:
        kept = kept.where(users <= max_users)
    rows = F.greatest(F.col("txn_count"), F.lit(1))
    return kept.join(scenarios, key, "left").select(
        *key, "shared_user_count", "txn_count", "amount_sum", "fraud_seed_count", "injected_count",
        F.coalesce("scenario_count", F.lit(0)).alias("scenario_count"),
        (F.col("fraud_seed_count") / rows).alias("fraud_seed_ratio"),
        (F.col("injected_count") / rows).alias("injected_ratio"),
        F.concat(F.lit("shared_"), F.col("entity_type")).alias("evidence_kind"))


def resource_risk(stats: DataFrame) -> DataFrame:
    """Risk of each resource, scaled by the 90 % quantiles of its kind."""
    stats = cut(stats, "resources")
    measures = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value"))
                         for m in ("amount_sum", "txn_count")])
    long = stats.select("entity_type", F.explode(measures).alias("_m")).select("entity_type", "_m.*")
    q90 = exact_quantiles(long, "value", {"q": 0.9}, ["entity_type", "measure"])
    of = lambda m: F.max(F.when(F.col("measure") == m, F.col("q")))
    scales = F.broadcast(q90.groupBy("entity_type").agg(  # one row per kind: four at most
        of("amount_sum").alias("_amount_q90"), of("txn_count").alias("_txn_q90")))
    cap = lambda value: F.least(F.lit(1.0), value)
    score = (F.lit(0.38) * cap(F.col("fraud_seed_ratio"))
             + F.lit(0.26) * cap(F.log1p(F.col("shared_user_count").cast("double")) / F.log(F.lit(40.0)))
             + F.lit(0.18) * cap(F.col("amount_sum") / F.greatest(F.col("_amount_q90"), F.lit(1.0)))
             + F.lit(0.10) * cap(F.col("txn_count") / F.col("_txn_q90"))
             + F.lit(0.08) * cap(F.col("scenario_count") / F.lit(3.0)))
    return (stats.join(scales, "entity_type").withColumn("resource_risk_score", cap(score))
            .select(*stats.columns, "resource_risk_score"))


def candidate_resources(tx: DataFrame, max_users: int | None = None,
                        pairs: DataFrame | None = None) -> DataFrame:
    """Resources with enough fraud, or risky and busy enough."""
    kind = F.col("entity_type")
    risky = (F.col("resource_risk_score") >= 0.45) & (
        F.col("txn_count") >= _per_kind(kind, 2) * 2)
    column = F.lit(None).cast("string")
    for spec in RESOURCE_KINDS:
        column = F.when(kind == spec[0], F.lit(spec[1])).otherwise(column)
    return (resource_risk(resource_stats(tx, max_users, pairs))
            .where((F.col("fraud_seed_count") >= _per_kind(kind, 3)) | risky)
            .withColumn("resource_col", column))


def chain_rows(tx: DataFrame) -> DataFrame:
    """(payer, payee, first row) of payments to a payer that are fraud or large."""
    large = exact_quantiles(tx, "amount", {"q": 0.95}).select("q").scalar()
    strong = (F.col("is_fraud") == 1) | (F.col("amount") >= large)
    pairs = (tx.where(F.col("payer_id").isNotNull() & F.col("payee_id").isNotNull() & strong)
             .groupBy("payer_id", "payee_id")
             .agg(F.min(F.struct("timestamp", "transaction_id")).alias("first_row")))
    payers = (tx.where(F.col("payer_id").isNotNull())
              .select(F.col("payer_id").alias("_p")).distinct())
    return pairs.join(payers, F.col("payee_id") == F.col("_p"), "left_semi")


def resource_edges(pairs: DataFrame, candidates: DataFrame) -> DataFrame:
    ids = candidates.select("entity_type", "entity_id")
    return (pairs.join(ids, ["entity_type", "entity_id"], "left_semi")
            .select(F.col("payer_id").alias("src"), F.col("entity_id").alias("dst")))


def ring_edges(tx: DataFrame, candidates: DataFrame) -> DataFrame:
    """Payer-resource edges over candidates, and payer-payer edges of chains."""
    chains = chain_rows(tx).select(F.col("payer_id").alias("src"), F.col("payee_id").alias("dst"))
    return resource_edges(payer_resource_pairs(tx), candidates).unionByName(chains).distinct()


def distinct_payers(tx: DataFrame) -> DataFrame:
    return tx.where(F.col("payer_id").isNotNull()).select("payer_id").distinct()


def ring_members(labels: DataFrame, payers: DataFrame) -> DataFrame:
    """Members of components with at least two payers, with ``is_user``."""
    known = payers.select(F.col("payer_id").alias("_p"), F.lit(True).alias("_known"))
    marked = (labels.join(known, F.col("node") == F.col("_p"), "left")
              .select("component", F.col("node").alias("entity_id"),
                      F.coalesce("_known", F.lit(False)).alias("is_user")))
    big = (marked.where("is_user").groupBy("component").agg(F.count(F.lit(1)).alias("_n"))
           .where(F.col("_n") >= 2).select("component"))
    return marked.join(big, "component", "left_semi")


def unique_evidence(candidates: DataFrame) -> DataFrame:
    """One evidence row per resource id; an id of two kinds keeps its last kind's figures at its
    first kind's place."""
    row = F.struct(*candidates.columns)
    return (candidates.groupBy("entity_id")
            .agg(F.max_by(row, F.col("kind_order")).alias("_r"), F.min("kind_order").alias("_first"))
            .select("_r.*", F.col("_first").alias("place_kind")))


def ring_risk(users: Column, entities: Column, fraud: Column, rows: Column, devices: Column,
              ips: Column, evidence: Column, scenarios: Column) -> Column:
    d = lambda c: c.cast("double")
    cap = lambda c: F.least(F.lit(1.0), c)
    return cap(
        F.lit(0.40) * (d(fraud) / F.greatest(d(rows), F.lit(1.0)))
        + F.lit(0.20) * cap(F.log1p(d(users)) / F.log(F.lit(30.0)))
        + F.lit(0.17) * cap(F.log1p(d(evidence)) / F.log(F.lit(20.0)))
        + F.lit(0.13) * cap((d(devices) + d(ips)) / F.greatest(d(users), F.lit(1.0)))
        + F.lit(0.06) * cap(d(scenarios) / F.lit(3.0))
        + F.lit(0.04) * cap(d(entities) / F.greatest(d(users) * 2, F.lit(1.0))))


def payer_totals(tx: DataFrame) -> DataFrame:
    return tx.where(F.col("payer_id").isNotNull()).groupBy("payer_id").agg(
        F.count(F.lit(1)).alias("txn_count"), F.sum("amount").alias("amount_sum"),
        F.sum("is_fraud").alias("fraud_seed_count"), F.sum("is_injected").alias("injected_txn_count"))


def _named_counts(tx: DataFrame, users: DataFrame, column: str) -> DataFrame:
    """(component, name, rows) of a label carried by the transactions of a ring's payers."""
    counted = (tx.where(F.col(column).isNotNull() & F.col("payer_id").isNotNull())
               .groupBy("payer_id", F.col(column).alias("name")).agg(F.count(F.lit(1)).alias("n")))
    return (counted.join(users, counted.payer_id == users.entity_id)
            .groupBy("component", "name").agg(F.sum("n").alias("n")))


def top_k_scenarios(counts: DataFrame, group: str = "component", k: int = 5) -> DataFrame:
    """The ``k`` most frequent names per group as a map; ties by name."""
    top = top_per_group(counts, [group], [F.desc("n"), "name"], k)
    entries = F.array_sort(F.collect_list(F.struct("place", "name", "n")))
    pairs = F.transform(entries, lambda e: F.struct(e["name"].alias("key"), e["n"].alias("value")))
    return top.groupBy(group).agg(F.map_from_entries(pairs).alias("top_scenarios"),
                                  F.transform(entries, lambda e: e["name"]).alias("scenario_names"))


def dominant_group(counts: DataFrame, group: str = "component") -> DataFrame:
    """Most frequent injected group per ring and its share; ties by name."""
    return counts.groupBy(group).agg(
        F.min_by("name", F.struct((-F.col("n")).alias("n"), F.col("name"))).alias("dominant_injected_group"),
        (F.max("n") / F.sum("n")).alias("dominant_injected_share"),
        F.count(F.lit(1)).alias("injected_group_count"))


def _first_sorted(members: DataFrame, condition: Column, k: int, out: str) -> DataFrame:
    top = top_per_group(members.where(condition), ["component"], ["entity_id"], k)
    return top.groupBy("component").agg(F.array_sort(F.collect_list("entity_id")).alias(out))


def sample_members(members: DataFrame, k: int = 12) -> DataFrame:
    """First ``k`` users and first ``k`` other members of each ring, in sorted order."""
    users = _first_sorted(members, F.col("is_user"), k, "sample_users")
    others = _first_sorted(members, ~F.col("is_user"), k, "sample_resources")
    empty = F.array().cast("array<string>")
    return users.join(others, "component", "full_outer").select(
        "component", F.coalesce("sample_users", empty).alias("sample_users"),
        F.coalesce("sample_resources", empty).alias("sample_resources"))


def ring_features(tx: DataFrame, members: DataFrame, evidence: DataFrame) -> DataFrame:
    """Figures of every ring: two aggregations, over members and over payments, joined."""
    kind = entity_type_from_prefix("entity_id")
    shape = members.groupBy("component").agg(
        F.count(F.lit(1)).alias("entity_count"), F.count_if("is_user").alias("user_count"),
        *[F.count_if(kind == k).alias(f"shared_{k}_count")
          for k in ("device", "ip", "merchant", "payee")])
    users = members.where("is_user").select("component", "entity_id")
    totals = payer_totals(tx)
    money = (totals.join(users, totals.payer_id == users.entity_id).groupBy("component")
             .agg(*[F.sum(c).alias(c) for c in ("txn_count", "amount_sum", "fraud_seed_count",
                                                "injected_txn_count")]))
    proof = (evidence.select("entity_id").join(members.select("component", "entity_id"), "entity_id")
             .groupBy("component").agg(F.count(F.lit(1)).alias("evidence_count")))
    scenarios = _named_counts(tx, users, "injection_scenario")
    scenario_n = scenarios.groupBy("component").agg(F.count(F.lit(1)).alias("scenario_count"))
    top = top_k_scenarios(scenarios)
    dominant = dominant_group(_named_counts(tx, users, "fraud_group_id"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    out = shape.join(money, "component")
    for part in (proof, scenario_n, top, dominant):
        out = out.join(part, "component", "left")
    out = out.select(
        "component", "entity_count", "user_count",
        (F.col("entity_count") - F.col("user_count")).alias("resource_count"),
        "txn_count", "amount_sum", "fraud_seed_count",
        (F.col("fraud_seed_count") / F.greatest("txn_count", F.lit(1))).alias("fraud_seed_ratio"),
        "injected_txn_count", zero("injected_group_count"), "dominant_injected_group",
        F.coalesce("dominant_injected_share", F.lit(0.0)).alias("dominant_injected_share"),
        zero("scenario_count"), "top_scenarios", "scenario_names", "shared_device_count",
        "shared_ip_count", "shared_merchant_count", "shared_payee_count", zero("evidence_count"))
    risk = ring_risk(*[F.col(c) for c in (
        "user_count", "entity_count", "fraud_seed_count", "txn_count", "shared_device_count",
        "shared_ip_count", "evidence_count", "scenario_count")])
    return out.withColumn("graph_mining_group_risk_score", risk)


def number_rings(rings: DataFrame, members: DataFrame, evidence: DataFrame, chains: DataFrame,
                 min_risk: float = 0.35) -> DataFrame:
    """Drop weak rings without evidence; number the rest GM_000001 ... in discovery order.

    Rings with resources come first, by their first resource (kind, then id); then rings known
    only from chains, by their first chain payment.
    """
    kept = rings.where((F.col("graph_mining_group_risk_score") >= min_risk)
                       | (F.col("evidence_count") > 0))
    of_member = members.select("component", "entity_id")
    by_resource = (evidence.select("entity_id", "place_kind").join(of_member, "entity_id")
                   .groupBy("component").agg(F.min(F.struct("place_kind", "entity_id")).alias("_r")))
    by_chain = (chains.join(of_member, F.col("payer_id") == F.col("entity_id"))
                .groupBy("component").agg(F.min("first_row").alias("_c")))
    ordered = kept.join(by_resource, "component", "left").join(by_chain, "component", "left")
    placed = running_position(
        ordered, [F.col("_r").isNull(), F.col("_r.place_kind"), F.col("_r.entity_id"),
                  F.col("_c.timestamp"), F.col("_c.transaction_id"), "component"], out="_at")
    number = (F.col("_at") + 1).cast("string")
    padded = F.when(F.length(number) < 6, F.lpad(number, 6, "0")).otherwise(number)
    return (placed.withColumn("fraud_group_mining_id", F.concat(F.lit("GM_"), padded))
            .drop("_r", "_c", "_at"))


@dataclass(frozen=True)
class RingTables:
    """What mining produces; every field is a written table."""

    candidates: DataFrame
    members: DataFrame
    rings: DataFrame
    evidence: DataFrame


def mine_rings(tx: DataFrame, max_users: int | None = None, min_risk: float = 0.35) -> RingTables:
    """Candidates, components and numbered rings of a transaction table."""
    pairs = cut(payer_resource_pairs(tx), "pairs")
    candidates = cut(candidate_resources(tx, max_users, pairs), "candidates")
    chains = cut(chain_rows(tx), "chains")
    edges = resource_edges(pairs, candidates).unionByName(
        chains.select(F.col("payer_id").alias("src"), F.col("payee_id").alias("dst")))
    labels = connected_components(edges)
    members = cut(ring_members(labels, distinct_payers(tx)), "members")
    evidence = unique_evidence(candidates)
    rings = number_rings(ring_features(tx, members, evidence), members, evidence, chains, min_risk)
    return RingTables(candidates, members, cut(rings, "rings"), ring_evidence(evidence, members))


def ring_evidence(evidence: DataFrame, members: DataFrame) -> DataFrame:
    """Evidence rows with the component they belong to."""
    return evidence.join(members.select("component", "entity_id"), "entity_id")


def entity_ring_risk(tables: RingTables) -> DataFrame:
    """Ring features of every member."""
    r = tables.rings
    features = r.select(
        "component", "fraud_group_mining_id", "graph_mining_group_risk_score",
        *[F.col(c).alias(f"graph_mining_{new}") for c, new in (
            ("entity_count", "group_entity_count"), ("user_count", "group_user_count"),
            ("resource_count", "group_resource_count"), ("fraud_seed_count", "fraud_seed_count"),
            ("fraud_seed_ratio", "fraud_seed_ratio"),
            ("shared_device_count", "shared_device_count"), ("shared_ip_count", "shared_ip_count"),
            ("shared_merchant_count", "shared_merchant_count"),
            ("shared_payee_count", "shared_payee_count"), ("evidence_count", "evidence_count"),
            ("scenario_count", "scenario_count"))])
    return (tables.members.select("component", "entity_id").join(features, "component")
            .select("entity_id", *S.RING_FEATURE_COLUMNS))


EVIDENCE_FIELDS = ("entity_id", "entity_type", "evidence_kind", "shared_user_count", "txn_count",
                   "fraud_seed_count", "resource_risk_score")


def top_evidence(evidence: DataFrame, k: int = 20) -> DataFrame:
    """First ``k`` evidence rows per ring, in discovery order, as an array."""
    top = top_per_group(evidence, ["component"], ["place_kind", "entity_id"], k)
    rows = F.array_sort(F.collect_list(F.struct("place", F.struct(*EVIDENCE_FIELDS).alias("row"))))
    return top.groupBy("component").agg(
        F.transform(rows, lambda e: e["row"]).alias("evidence"))


def evidence_kinds(evidence: DataFrame) -> DataFrame:
    """Evidence rows of each kind per ring, over all of them."""
    return evidence.groupBy("component").agg(*[
        F.count_if(F.col("evidence_kind") == f"shared_{kind}").alias(f"{kind}_evidence")
        for kind, *_ in RESOURCE_KINDS])


def ring_explain(rings: DataFrame) -> DataFrame:
    """Explanation codes, evidence summary and text of rings.

    ``rings`` carries the listed ``evidence`` and the counts of ``evidence_kinds``.
    """
    ev = F.coalesce(F.col("evidence"), F.array().cast(rings.schema["evidence"].dataType))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    score = F.coalesce(F.col("graph_mining_group_risk_score"), F.lit(0.0))
    names = F.coalesce(F.map_keys("top_scenarios"), F.array().cast("array<string>"))
    kinds = {kind: n(f"{kind}_evidence") for kind, *_ in RESOURCE_KINDS}
    rules = [
        ("high_confidence_ring", score >= 0.75),
        ("shared_device_ring", (n("shared_device_count") >= 2) | (kinds["device"] >= 2)),
        ("shared_ip_cluster", (n("shared_ip_count") >= 2) | (kinds["ip"] >= 2)),
        ("merchant_cashout_cluster", (n("shared_merchant_count") >= 1) | (kinds["merchant"] >= 1)),
        ("shared_payee_chain", (n("shared_payee_count") >= 1) | (kinds["payee"] >= 1)),
        ("fraud_seed_propagation", n("fraud_seed_count") >= 3),
        ("multi_scenario_campaign", n("scenario_count") >= 2),
        ("fund_transfer_chain", F.exists(
            names, lambda x: x.contains("money_laundering") | x.contains("mule"))),
    ]
    held = first_reasons(rules)
    codes = F.when(F.size(held) == 0, F.array(F.lit("weak_graph_signal"))).otherwise(held)
    counted = F.filter(F.array(*[
        F.struct(F.lit(f"shared_{k}").alias("key"), v.alias("value")) for k, v in kinds.items()]),
        lambda e: e["value"] > 0)
    ranked = F.transform(ev, lambda e, i: F.struct((-e["resource_risk_score"]).alias("r"),
                                                   i.alias("i"), e.alias("e")))
    strongest = F.transform(F.slice(F.array_sort(ranked), 1, 5), lambda s: s["e"])
    text = F.format_string(  # fixed value: the explanation sentence
        "团伙风险分 %.3f，覆盖 %d 个用户、%d 个共享资源，包含 %d 条历史欺诈种子；主要证据为 %s。",
        score, n("user_count"), n("resource_count"), n("fraud_seed_count"),
        F.array_join(F.slice(codes, 1, 4), ", "))
    return rings.withColumns({
        "risk_level": group_risk_level(score), "explanation_codes": codes,
        "explanation_text": text,
        "evidence_by_kind": F.map_from_entries(counted), "top_resources": strongest,
    })


def ring_subgraph(rings: DataFrame) -> DataFrame:
    """Nodes and edges to draw a ring: centre, risk, ten users and twelve resources at most."""
    ring = F.col("fraud_group_mining_id")
    score = F.coalesce(F.col("graph_mining_group_risk_score"), F.lit(0.0))
    risk_id = F.concat(ring, F.lit(":risk"))
    none_d, none_l = F.lit(None).cast("double"), F.lit(None).cast("bigint")

    def node(id_, label, kind, role, risk=none_d, users=none_l):
        return F.struct(id_.alias("id"), label.alias("label"), kind.alias("type"),
                        F.lit(role).alias("role"), risk.alias("risk_score"),
                        users.alias("shared_user_count"))

    def edge(source, target, label, weight=none_d):
        return F.struct(source.alias("source"), target.alias("target"), label.alias("label"),
                        weight.alias("weight"))

    users, resources = F.slice("sample_users", 1, 10), F.slice("sample_resources", 1, 12)

    def proof(r):
        found = F.filter(F.col("evidence"), lambda e: e["entity_id"] == r)
        return F.try_element_at(found, F.lit(-1))

    def kind_of(r):
        guess = (F.when(r.startswith("IP_"), "ip").when(r.startswith("D_"), "device")
                 .otherwise("resource"))
        return F.coalesce(proof(r)["entity_type"], guess)

    def risk_of(r):
        return F.coalesce(proof(r)["resource_risk_score"], F.lit(0.0))

    nodes = F.concat(
        F.array(node(ring, ring, F.lit("fraud_group"), "center", score),
                node(risk_id, group_risk_level(score), F.lit("risk"), "risk", score)),
        F.transform(users, lambda u: node(u, u, F.lit("user"), "member")),
        F.transform(resources, lambda r: node(
            r, r, kind_of(r), "shared_resource", risk_of(r),
            F.coalesce(proof(r)["shared_user_count"], F.lit(0)).cast("bigint"))))
    edges = F.concat(
        F.array(edge(ring, risk_id, F.lit("risk_score"))),
        F.transform(users, lambda u: edge(u, ring, F.lit("member"))),
        F.transform(resources, lambda r: edge(
            ring, r, F.coalesce(proof(r)["evidence_kind"], F.lit("shared_resource")), risk_of(r))))
    return rings.withColumns({"nodes": nodes, "edges": edges})


def ring_detail(tables: RingTables) -> DataFrame:
    """Rings with evidence, members, explanation and subgraph."""
    full = (tables.rings.join(top_evidence(tables.evidence), "component", "left")
            .join(evidence_kinds(tables.evidence), "component", "left")
            .join(sample_members(tables.members), "component", "left"))
    empty = F.array().cast(full.schema["evidence"].dataType)
    full = full.withColumn("evidence", F.coalesce("evidence", empty))
    return ring_subgraph(ring_explain(full))


def ring_lookup(details: DataFrame, ring_id: str) -> DataFrame:
    return details.where(F.col("fraud_group_mining_id") == ring_id)


def entity_lookup(entity_risk: DataFrame, entity_id: str) -> DataFrame:
    return entity_risk.where(F.col("entity_id") == entity_id)


def ring_sweep(tx: DataFrame, entity_risk: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Recall, precision and purity against injected labels at each ring-risk threshold.

    Payments are counted per (payer, label) first; the thresholds multiply those counts only.
    """
    counted = tx.groupBy("payer_id", (F.col("is_injected") == 1).alias("injected"),
                         "fraud_group_id").agg(F.count(F.lit(1)).alias("n"))
    rings = entity_risk.select(F.col("entity_id").alias("_e"), "fraud_group_mining_id",
                               "graph_mining_group_risk_score")
    steps = F.array(*[F.lit(float(t)) for t in thresholds])
    rows = (counted.join(rings, F.col("payer_id") == F.col("_e"), "left")
            .withColumn("threshold", F.explode(steps))
            .withColumn("hit", F.coalesce(
                F.col("graph_mining_group_risk_score") >= F.col("threshold"), F.lit(False))))
    injected, hit = F.coalesce("injected", F.lit(False)), F.col("hit")
    n = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))
    main = rows.groupBy("threshold").agg(
        n(injected).alias("injected_rows"), n(injected & hit).alias("detected_injected_rows"),
        n(hit).alias("flagged_rows"))
    groups = (rows.where(injected & F.col("fraud_group_id").isNotNull())
              .groupBy("threshold", "fraud_group_id").agg(F.max("hit").alias("found"))
              .groupBy("threshold").agg(F.count(F.lit(1)).alias("injected_group_count"),
                                        F.count_if("found").alias("detected_injected_group_count")))
    purity = (rows.where(hit & F.col("fraud_group_id").isNotNull())
              .groupBy("threshold", "fraud_group_mining_id", "fraud_group_id").agg(F.sum("n").alias("n"))
              .groupBy("threshold", "fraud_group_mining_id").agg((F.max("n") / F.sum("n")).alias("p"))
              .groupBy("threshold").agg(F.avg("p").alias("average_detected_group_purity")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    share = lambda a, b: F.coalesce(F.col(a), F.lit(0)) / F.greatest(
        F.coalesce(F.col(b), F.lit(0)), F.lit(1))
    return (main.join(groups, "threshold", "left").join(purity, "threshold", "left").select(
        "threshold", "injected_rows", "detected_injected_rows",
        share("detected_injected_rows", "injected_rows").alias("injected_row_recall"),
        zero("injected_group_count"), zero("detected_injected_group_count"),
        share("detected_injected_group_count", "injected_group_count").alias("injected_group_recall"),
        "flagged_rows", F.col("detected_injected_rows").alias("flagged_injected_rows"),
        share("detected_injected_rows", "flagged_rows").alias("flagged_row_precision_vs_injection"),
        F.coalesce("average_detected_group_purity", F.lit(0.0)).alias("average_detected_group_purity")))


def ring_evaluate(tx: DataFrame, entity_risk: DataFrame) -> DataFrame:
    """Evaluation over all detected rings."""
    return ring_sweep(tx, entity_risk, [float("-inf")]).drop("threshold")


def ring_threshold_sweep(tx: DataFrame, entity_risk: DataFrame,
                         thresholds: Sequence[float] = SWEEP) -> DataFrame:
    return ring_sweep(tx, entity_risk, thresholds)


def ring_summary(tx: DataFrame, tables: RingTables, dataset: str = "dataset",
                 mining_splits: Sequence[str] = ("train",),
                 evaluation_splits: Sequence[str] = ("train", "valid", "test"),
                 max_users: int | None = None, min_risk: float = 0.35) -> DataFrame:
    """One row: evaluation, sweep, high-confidence block, counts and parameters."""
    entities = entity_ring_risk(tables)
    # The sweep has one row per threshold; min() stands for "no threshold".
    steps = ring_sweep(tx, entities, [float("-inf"), *SWEEP])
    fields = [c for c in steps.columns if c != "threshold"]
    block = F.struct(*fields)
    whole = F.max(F.when(F.col("threshold") == F.lit(float("-inf")), block))
    high = F.max(F.when(F.col("threshold") == 0.65, block))
    sweep = F.array_sort(F.collect_list(F.when(F.col("threshold") > 0, F.struct("threshold", *fields))))
    count = lambda df: df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (steps.agg(whole.alias("_w"), high.alias("high_confidence"),
                      sweep.alias("threshold_breakdown"))
            .select("_w.*", "threshold_breakdown", "high_confidence",
                    F.lit(0.65).alias("recommended_high_confidence_threshold"),
                    F.lit(dataset).alias("dataset"),
                    F.array(*map(F.lit, mining_splits)).alias("mining_splits"),
                    F.array(*map(F.lit, evaluation_splits)).alias("evaluation_splits"),
                    count(tables.candidates).alias("candidate_resource_count"),
                    count(tables.rings).alias("detected_group_count"),
                    count(entities).alias("detected_entity_count"),
                    F.lit(min_risk).alias("min_group_risk_score"),
                    F.lit(max_users).cast("int").alias("max_users_per_resource")))
