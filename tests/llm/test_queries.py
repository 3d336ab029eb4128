"""Text queries against their SQL on the small tables, and their columns."""

import oracle
import pytest

from ledgerlens.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"

COLUMNS = {
    "op1": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"},
    "op2": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
    "op3": {"doc_id", "held_out", "score", "predicted"},
    "op4": {"doc_id", "keep_id", "group_size", "kept", "text_sha256"},
    "op6": {"doc_id", "start", "n_tokens", "ids_crc32"},
    "op7": {"doc_id", "n_words", "n_removed", "kept_sha256"},
    "op8": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
    "op9": {"doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"},
    "op10": {"doc_id", "fingerprint", "component_id"},
    "op11": {"doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"},
    "op13": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"},
    "op12": {"lang", "rank", "phrase", "a", "l", "r", "n", "score"},
}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    assert oracle.differences(got, oracle.connect(FOLDER).execute(SQL[name]).df()) == ""


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns_and_one_row_per_document(spark, name):
    out = QUERIES[name](spark, FOLDER)
    assert COLUMNS.get(name.split("_")[0], set()) <= set(out.columns)
    if name.startswith("op12"):  # a report by language
        return
    ids = {r.doc_id for r in out.select("doc_id").collect()}
    assert ids == {r.doc_id for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id").collect()}
