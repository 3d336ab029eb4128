"""SimHash by Golay keys against brute force."""

import random

import numpy as np
import pytest
import xxhash

from ledgerlens.llm import golay, simhash


def brute_print(text, k=4):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hashed = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))


def brute_groups(rows, radius=4):
    prints = [brute_print(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                parent[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[root(i)] = min(low.get(root(i), d), d)
    return {(d, f"{p:016x}", low[root(i)]) for i, ((d, _), p) in enumerate(zip(rows, prints))}


def test_golay_names_meet_within_two_bits():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 23, 4000).astype(np.int64)
    distance = np.bitwise_count(a ^ (golay.decode(a) << 11))
    assert golay.names(a).shape == (4000, 6) and distance.max() >= 0
    for bits in (0, 1, 2):
        b = a.copy()
        for row in range(len(b)):
            for bit in rng.choice(23, bits, replace=False):
                b[row] ^= 1 << int(bit)
        shared = [bool((set(x) & set(y)) - {-1}) for x, y in zip(golay.names(a).tolist(), golay.names(b).tolist())]
        assert all(shared)


@pytest.mark.parametrize("bits", [1, 2, 3, 4])
def test_exact_keys_meet_up_to_four_bits(bits):
    rng = np.random.default_rng(bits)
    a = rng.integers(0, 2**63, 3000).astype(np.uint64)
    b = a.copy()
    for row in range(len(b)):
        for bit in rng.choice(64, bits, replace=False):
            b[row] ^= np.uint64(1 << int(bit))
    ka, kb = simhash.exact_keys(a[:, None]), simhash.exact_keys(b[:, None])
    assert all((set(x) & set(y)) - {-1} for x, y in zip(ka.tolist(), kb.tolist()))


def sample():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "one"), (4, "ONE"), (5, "a b c"), (6, "ÄÖ x y z"), (7, "äö x y z")]
    for i in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(200, 700))]
        rows.append((100 + 10 * i, " ".join(words)))
        for copy in range(rng.randrange(4)):
            changed = list(words)
            for _ in range(copy):
                changed[rng.randrange(len(changed))] = rng.choice(vocabulary)
            rows.append((101 + 10 * i + copy, ("\n" if copy else " ").join(changed)))
    rows.append((9000, " ".join(rng.choice(vocabulary) for _ in range(40_000))))
    return rows


def test_components_equal_brute_force(spark):
    rows = sample()
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, fingerprint string, component_id int")
    got = {tuple(r) for r in simhash.near_duplicates(df).select("doc_id", "fingerprint", "component_id").collect()}
    assert got == brute_groups(rows)


def test_large_buckets_lose_no_link(spark, monkeypatch):
    rng = np.random.default_rng(2)
    centre = int(rng.integers(0, 2**63))
    prints = {centre}
    while len(prints) < 150:
        value = centre
        for bit in rng.choice(24, rng.integers(1, 4), replace=False):
            value ^= 1 << int(bit)
        prints.add(value)
    signed = [int(np.uint64(p).view(np.int64)) for p in prints]
    monkeypatch.setattr(simhash, "BUCKET", 20)
    edges = simhash.links(spark.createDataFrame([(p,) for p in signed], "p0 long"), 4, True).collect()
    around = {p: {p} for p in signed}
    for a, b in edges:
        assert (a ^ b).bit_count() <= 4 or ((a ^ b) & (2**64 - 1)).bit_count() <= 4
        joined = around[a] | around[b]
        for p in joined:
            around[p] = joined
    assert len({frozenset(v) for v in around.values()}) == 1


def test_keep_one_of_each_group(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(900)]
    base = [" ".join(rng.choice(words) for _ in range(400)) for _ in range(30)]
    rows = [(i, t, None) for i, t in enumerate(base)]
    for i, t in enumerate(base[:15]):
        edited = t.split()
        for _ in range(2):
            edited[rng.randrange(400)] = "new"
        rows.append((100 + i, " ".join(edited), None))
    rows += [rows[3], rows[3], (None, "lone text that nobody else has " * 9, None), (None, None, None), (200, "", None)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, _row_a string"))
    got = sorted((r.doc_id if r.doc_id is not None else -1) for r in kept.collect())
    assert got == sorted([*range(30), -1, 200]) and kept.columns == ["doc_id", "text", "_row_a"]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_values_between_large_buckets_do_not_pass_the_driver(spark):
    """Each fingerprint makes 2,081 values, which the planner does not know: it must not broadcast them."""
    prints = [(i * 7919 % 4096) << 40 for i in range(300)]
    far = spark.createDataFrame([(p,) for p in prints], "p0 bigint").repartition(3)
    links = simhash._far_links(far)
    assert "Broadcast" not in links._jdf.queryExecution().executedPlan().toString()
    parent = {p: p for p in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links.collect():
        assert a < b and (a ^ b).bit_count() <= 4
        parent[root(a)] = root(b)
    groups = {p: root(p) for p in prints}
    assert len(set(groups.values())) < len(prints)
    for a in prints:
        for b in prints:
            assert (a ^ b).bit_count() > 4 or groups[a] == groups[b]
