"""Benchmark hits against a plain scan."""

import hashlib
import random
import re

import pytest

from ledgerlens.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in t or ""))


def brute(docs, items, size=10):
    out = {}
    for key, text in docs:
        w = words(text)
        hit, found = set(), set()
        for item, t in items:
            v = words(t)
            n = min(size, len(v))
            for i in range(len(v) - n + 1 if n else 0):
                for j in range(len(w) - n + 1):
                    if w[j:j + n] == v[i:i + n]:
                        hit |= set(range(j, j + n))
                        found.add(str(item))
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[key] = (len(w), len(hit), len(found), sha, bool(hit))
    return out


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(2)
    pick = lambda n: [rng.choice("alpha beta gamma délta eps zeta eta théta 42 x1".split()) for _ in range(n)]
    items = [(i, " ".join(pick(rng.randrange(12, 25)))) for i in range(12)] + [(90, "Short item!"), (91, ""), (92, None), (93, "--"),
             (94, items_repeat := "same words for two items in this one benchmark table here"), (95, items_repeat)]
    docs = [(1, None), (2, ""), (3, "a short, ITEM; here"), (4, items_repeat.upper() + " tail"), (5, "short" * 900)]
    for i in range(40):
        text = pick(rng.randrange(1, 90))
        if i % 3 == 0:
            part = words(items[i % 12][1])
            at = rng.randrange(len(text))
            text[at:at] = part[:rng.randrange(8, len(part) + 1)]
        docs.append((10 + i, rng.choice([" ", ", ", "\n"]).join(text)))
    return docs, items


@pytest.mark.parametrize("slice_size", [1_000_000, 40])
def test_report_equals_brute_force(spark, tables, monkeypatch, slice_size):
    docs, items = tables
    monkeypatch.setattr(decontaminate, "SLICE", slice_size)
    df = spark.createDataFrame([(*r, 1, 1) for r in docs], "doc_id long, text string, _runs int, item_id int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in decontaminate.report(df, bench).collect()}
    assert got == brute(docs, items)


@pytest.mark.parametrize("slice_size", [1_000_000, 50])
def test_a_preamble_of_many_items_is_broadcast_once(spark, monkeypatch, slice_size):
    monkeypatch.setattr(decontaminate, "SLICE", slice_size)
    held = []
    built = decontaminate._Slice.__init__

    def watched(self, rows):
        held.append(len(rows))
        built(self, rows)

    monkeypatch.setattr(decontaminate._Slice, "__init__", watched)
    shared = " ".join(f"shared{i}" for i in range(14))
    items = [(i, f"{shared} own{i} " + " ".join(f"w{i}x{k}" for k in range(3))) for i in range(30)]
    docs = [(1, shared), (2, "before " + shared + " after"), (3, items[7][1]), (4, "nothing of it"), (5, shared), (None, shared), (6, "x " * 30_000 + shared)]
    bench = spark.createDataFrame(items + items[:4], "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in decontaminate.report(df, bench).collect()}
    assert got == brute(docs, items)
    assert sum(held) == 5 + 30 * 4 and max(held) <= slice_size  # windows of the preamble once, four per item


def test_items_without_an_id_hit_but_are_not_listed(spark):
    bench = spark.createDataFrame([(None, "one two three"), (1, "one two three"), (None, "four five")], "item_id long, text string")
    df = spark.createDataFrame([(1, "see one two three"), (2, "four five")], "doc_id long, text string")
    rows = {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in decontaminate.report(df, bench).collect()}
    assert rows == {1: (3, 1, True), 2: (2, 0, True)}
    listed = {r.doc_id: r._items for r in decontaminate.find_hits(df, bench).collect()}
    assert listed == {1: ["1"], 2: []}


def test_removal(spark, tables):
    docs, items = tables
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    expected = brute(docs, items)
    rows = {r.doc_id: r.text for r in decontaminate.remove_contaminated(df, bench).collect()}
    assert rows == {d: t for d, t in docs if not expected[d][4]}
    spans = {r.doc_id: r.text for r in decontaminate.remove_contaminated(df, bench, spans=True).collect()}
    for d, t in docs:
        if expected[d][4]:
            assert len(words(spans[d])) == expected[d][0] - expected[d][1]
        else:
            assert spans[d] == t


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.report(docs, none).first().contaminated is False
    assert decontaminate.report(docs.limit(0), none).count() == 0


@pytest.mark.parametrize("spans", [False, True])
def test_removal_keeps_columns_with_clashing_names(spark, tables, spans):
    docs, items = tables
    bench = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, _runs int")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    plain = {r.doc_id: r.text for r in decontaminate.remove_contaminated(df, bench, spans=spans).collect()}
    clash = df.selectExpr("doc_id", "7 AS _runs", "'x' AS _ITEMS", "text", "doc_id AS _n_words", "1 AS item_id", "2 AS _all")
    out = decontaminate.remove_contaminated(clash, bench, spans=spans)
    assert out.columns == clash.columns
    rows = out.collect()
    assert {r.doc_id: r.text for r in rows} == plain
    assert all((r._runs, r._ITEMS, r._n_words, r._all) == (7, "x", r.doc_id, 2) for r in rows)
