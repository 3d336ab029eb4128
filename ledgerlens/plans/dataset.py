"""From core transactions to the unified log, its splits, profiles and graph."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ledgerlens import schema as S
from ledgerlens.operators import graph as G
from ledgerlens.operators.derive import common_fields, project_log_columns, risk_fields
from ledgerlens.operators.merge import union_sources, union_widen
from ledgerlens.operators.profiles import all_profiles
from ledgerlens.operators.sampling import dense_row_id, order_log, stratified_cap
from ledgerlens.session import cut
from ledgerlens.sources import tables


def build_log(parts: Sequence[DataFrame], caps: dict[str, int | None] | None = None,
              seed: int = 20260511, assign_ids: bool = True) -> DataFrame:
    """The unified transaction log from core tables of one source each."""
    caps = caps or {}
    capped = []
    for i, part in enumerate(parts):
        name = part.select("source").first()
        cap = caps.get(name.source) if name else None
        capped.append(stratified_cap(part, cap, seed + i * 10))
    log = common_fields(union_sources(capped), assign_ids)
    return project_log_columns(order_log(risk_fields(log)))


def augment(log: DataFrame, injected: DataFrame) -> DataFrame:
    """The log with injected rows, renumbered in time order."""
    return dense_row_id(union_widen(log, injected))


def build_graph(log: DataFrame, extra_edges: Sequence[DataFrame] = (),
                extra_nodes: Sequence[DataFrame] = ()) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the log and further graph sources."""
    edges = cut(G.graph_union([G.tx_edges(log), *extra_edges]), "edges")
    nodes = G.graph_nodes([G.entity_nodes(log), G.endpoint_nodes(edges), *extra_nodes])
    return nodes, edges


def write_dataset(log: DataFrame, folder: str, stream_limit: int | None = None,
                  extra_edges: Sequence[DataFrame] = (), extra_nodes: Sequence[DataFrame] = ()) -> None:
    """All output tables of a dataset under ``folder``; the stream holds the first ``stream_limit`` events, or all."""
    tables.sink_splits(log, f"{folder}/transaction_log")
    log = log.sparkSession.read.parquet(f"{folder}/transaction_log")
    for kind, profile in all_profiles(log).items():
        tables.sink_parquet(profile, f"{folder}/{kind}_profile")
    nodes, edges = build_graph(log, extra_edges, extra_nodes)
    tables.sink_parquet(edges, f"{folder}/graph_edges")
    tables.sink_parquet(nodes, f"{folder}/graph_nodes")
    augmented = all(c in log.columns for c in S.AUGMENTED_COLUMNS)
    rows = (tables.event_stream_rows_mixed(log, stream_limit) if augmented
            else tables.event_stream_rows(log, stream_limit))
    tables.sink_event_stream(rows, f"{folder}/transaction_stream")
