"""A hierarchical Pitman-Yor language model of word pairs.

Teh, "A hierarchical Bayesian language model based on Pitman-Yor processes" (2006). Each preceding
word is a restaurant whose dishes are the words that follow it; all of them share one parent, the
root, whose customers are their tables; the root's parent is uniform over the known words and one
unknown. Customers are seated by Gibbs sampling, all customers of a dish in a restaurant in one
draw given the rest (see :class:`Law`), and predictive probabilities are averaged over samples.

Restaurants live in hashed buckets, frequent ones split into parts by dish, so no bucket depends
on one word. As in approximate distributed Gibbs sampling for hierarchical models (Asuncion,
Smyth and Welling 2008), buckets sample side by side, each with its own copy of the parent
estimated from its own tables; the true root is then seated from the tables of all buckets. All
counts are exact: every word of every learning document is one customer.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import chunks as C
from ledgerlens.llm.tables import cut
from ledgerlens.llm.words import mix

DISCOUNT, STRENGTH = 0.75, 1.0  # of the context restaurants
ROOT_DISCOUNT, ROOT_STRENGTH = 0.6, 10.0
BURN, SAMPLES = 4, 3  # sweeps before, sweeps averaged
EXACT = 256  # customers up to which a dish's tables are drawn from a table of all chances
NODES, STEPS, SHARES = 48, 4, 4  # of an integral, of a walk in a sweep, of the dishes reseated at a time
SLICE, WALKERS = 1 << 19, 1 << 13  # chances, and dishes with many customers, held at a time
_PART = np.uint64(0x9FB21C651E98DF25)
_SHORT = np.uint64(24)  # dishes go by the upper 40 bits of their hash inside a restaurant


class Law:
    """Chances of the number of tables at which the customers of a dish sit.

    By the Chinese restaurant process with discount d, the sizes of a dish's tables are independent
    draws from Sibuya's law (generating function 1 - (1 - z)^d), given that they add up to its
    customers, and t tables have the weight (r)_t / t! p^t of a negative binomial law: p is the
    parent's chance of the dish, r d the strength plus d times the other dishes' tables. So a dish
    is reseated as a whole by drawing t, with no array of its customers.
    """

    def __init__(self, discount: float):
        self.discount = d = discount
        chance = np.zeros((EXACT + 1, EXACT + 1))  # of t Sibuya draws to add up to c
        chance[0, 0] = 1
        t = np.arange(EXACT + 1)
        for c in range(EXACT):
            chance[c + 1] = np.maximum(c - d * t, 0) * chance[c]
            chance[c + 1, 1:] += d * t[1:] * chance[c, :-1]
            chance[c + 1] /= c + 1
        with np.errstate(divide="ignore"):
            self.table = np.log(chance)

    def _slope(self, s: np.ndarray) -> np.ndarray:
        """Mean of a Sibuya draw tilted by exp(-s)."""
        up = -np.expm1(-s)
        return self.discount * np.exp(-s) * up ** (self.discount - 1) / -np.expm1(self.discount * np.log(up))

    def _root(self, size: int, above) -> np.ndarray:
        """The tilt of each of ``size`` dishes beyond which ``above`` of it is true, by bisection."""
        low, high = np.full(size, np.log(1e-40)), np.full(size, np.log(30.0))
        for _ in range(50):
            middle = (low + high) / 2
            up = above(np.exp(middle))
            low, high = np.where(up, low, middle), np.where(up, middle, high)
        return np.exp((low + high) / 2)

    def log_chance(self, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Log of the chance that t Sibuya draws add up to c, for more than ``EXACT`` customers.

        Cauchy's integral over a parabola through the saddle point that bends around the branch cut;
        over the vertical line where nearly all tables have one customer.
        """
        d = self.discount
        c, t = c.astype(float), t.astype(float)
        saddle = self._root(len(c), lambda s: self._slope(s) < c / t)
        vertex = np.maximum(saddle, 3 / c)
        step = vertex * 1e-4
        mean, low, high = (self._slope(x) for x in (vertex, vertex - step, vertex + step))
        spread = t * np.maximum(low - high, 0) / (2 * step)
        width = 7 / np.sqrt(np.maximum(2 * vertex**2 * spread + vertex * (c - t * mean), 1e-300))
        line = 2 * vertex * width > 3
        angle = np.linspace(0, 1, NODES + 1)[:, None] * np.where(line, np.pi, width)
        turn = 1 + 1j * angle
        s = np.where(line, vertex + 1j * angle, vertex * turn * turn)
        power = t * np.log1p(-np.exp(d * np.log(-np.expm1(-s)))) + c * s
        peak = power[0].real
        value = (np.exp(power - peak) * np.where(line, 1, 2 * vertex * turn)).real
        value[[0, -1]] /= 2
        with np.errstate(divide="ignore", invalid="ignore"):
            total = np.log(np.maximum(value.sum(0), 0) * np.where(line, np.pi, width) / (NODES * np.pi)) + peak
        return np.where(t == c, c * np.log(d), total)

    def _weight(self, c: np.ndarray, t: np.ndarray, r: np.ndarray, p: np.ndarray) -> np.ndarray:
        return self.log_chance(c, t) + _log_gamma(r + t) - _log_gamma(t + 1.0) + t * np.log(p)

    def draw(self, c: np.ndarray, r: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """Tables of dishes with up to ``EXACT`` customers, drawn from all chances."""
        out = np.empty(len(c), dtype=np.int64)
        ends = np.cumsum(c)
        cuts = np.searchsorted(ends, np.arange(0, int(ends[-1]) if len(ends) else 0, SLICE), side="left")
        for low, high in zip(cuts, [*cuts[1:], len(c)]):
            if low == high:
                continue
            count = c[low:high]
            first = np.cumsum(count) - count
            owner = np.repeat(np.arange(high - low), count)
            i = np.arange(len(owner)) - first[owner]
            grown = np.cumsum(np.log((r[low:high][owner] + i) * p[low:high][owner] / (i + 1)))
            grown -= np.concatenate(([0.0], grown))[first][owner]
            grown += self.table[count[owner], i + 1]
            grown -= np.maximum.reduceat(grown, first)[owner]
            mass = np.concatenate(([0.0], np.cumsum(np.exp(grown))))
            last = first + count
            aim = mass[first] + rng.random(len(count)) * (mass[last] - mass[first])
            spot = np.clip(np.searchsorted(mass, aim, side="right") - 1, first, last - 1)
            out[low:high] = spot - first + 1
        return out

    def guess(self, c: np.ndarray, r: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearly the likeliest number of tables, where one more changes no chance, and the spread there."""
        tables = lambda s: c / self._slope(s)
        gain = lambda s: (np.log(-np.expm1(self.discount * np.log(-np.expm1(-s))))
                          + np.log(p * (1 + r / tables(s))))
        tilt = self._root(len(c), lambda s: gain(s) < 0)
        few, many = tables(tilt * 1.02), tables(tilt / 1.02)
        fall = (gain(tilt * 1.02) - gain(tilt / 1.02)) / np.abs(few - many)
        return np.clip(np.rint(tables(tilt)), 1, c).astype(np.int64), 1 / np.sqrt(np.maximum(np.abs(fall), 1e-18))

    def walk(self, c: np.ndarray, t: np.ndarray, r: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """Tables of dishes with more customers: a few steps by Metropolis' rule, about a spread wide."""
        for low in range(0, len(c), WALKERS):
            part = slice(low, low + WALKERS)
            own, now = (c[part], r[part], p[part]), t[part].copy()
            weight = self._weight(own[0], now, *own[1:])
            wide = np.minimum(2 * self.guess(*own)[1], own[0]) + 0.5  # does not depend on where the walk is
            for _ in range(STEPS):
                to = now + np.rint(rng.normal(size=len(now)) * wide).astype(np.int64)
                legal = (to >= 1) & (to <= own[0])
                other = self._weight(own[0], np.where(legal, to, now), *own[1:])
                with np.errstate(divide="ignore", invalid="ignore"):
                    go = legal & (np.log(rng.random(len(now))) < other - weight)
                now, weight = np.where(go, to, now), np.where(go, other, weight)
            t[part] = now
        return t


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for positive numbers."""
    small = x < 8
    y = np.where(small, x + 8, x)
    series = (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    back = np.where(small, x, 1.0)
    product = back.copy()
    for i in range(1, 8):
        product *= back + i
    return np.where(small, series - np.log(product), series)


class Seating:
    """Tables of many dishes at once; ``law(dishes, tables)`` gives their r and p, see :class:`Law`.

    Kept per dish is its number of tables alone, whatever its customers. A sweep reseats all
    customers of all dishes, a random share of the dishes at a time, given the tables of the rest.
    """

    def __init__(self, customers: np.ndarray, discount: float, law, rng: np.random.Generator):
        self.customers, self.given, self.rng = customers, law, rng
        self.law = _law(discount)
        self.tables = np.minimum(customers, 1)
        self.many = np.flatnonzero(customers > 1)
        self.opened = False

    def sweep(self) -> None:
        for dish in np.array_split(self.rng.permutation(self.many), SHARES):
            large = self.customers[dish] > EXACT
            few, more = dish[~large], dish[large]
            r, p = self.given(dish, self.tables)
            drawn = self.law.draw(self.customers[few], r[~large], p[~large], self.rng)
            if len(more):
                own = self.customers[more], r[large], p[large]
                start = self.tables[more] if self.opened else self.law.guess(*own)[0]
                self.tables[more] = self.law.walk(own[0], start, *own[1:], self.rng)
            self.tables[few] = drawn
        self.opened = True


@functools.cache
def _law(discount: float) -> Law:
    return Law(discount)


def _sampled(seating: Seating) -> np.ndarray:
    """Tables of each dish, summed over ``SAMPLES`` sweeps."""
    total = np.zeros(len(seating.customers), dtype=np.int64)
    for at in range(BURN + SAMPLES):
        seating.sweep()
        if at >= BURN:
            total += seating.tables
    return total


def seat_contexts(customers: np.ndarray, context: np.ndarray, parts: np.ndarray, dish: np.ndarray,
                  rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Summed and last table counts of the types of one bucket.

    ``parts`` says into how many parts each context is split; the others are taken to be alike.
    """
    dishes = int(dish.max()) + 1 if len(dish) else 0

    def law(chosen: np.ndarray, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        of_dish = np.bincount(dish, weights=tables, minlength=dishes)
        known = of_dish > 0
        parent = (of_dish - ROOT_DISCOUNT * known + (ROOT_STRENGTH + ROOT_DISCOUNT * known.sum()) / (dishes + 1)) / (
            ROOT_STRENGTH + of_dish.sum())
        of_context = np.bincount(context, weights=tables, minlength=len(parts)) * parts
        return STRENGTH / DISCOUNT + of_context[context[chosen]] - tables[chosen], parent[dish[chosen]]

    seating = Seating(customers, DISCOUNT, law, rng)
    total = _sampled(seating)
    return total, seating.tables


def seat_root(customers: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Summed table counts of root dishes in one bucket; buckets are taken to be alike."""
    def law(chosen: np.ndarray, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        others = ROOT_STRENGTH / ROOT_DISCOUNT + tables.sum() - tables[chosen]
        return others, np.full(len(chosen), 1 / (len(tables) + 1))

    return _sampled(Seating(customers, ROOT_DISCOUNT, law, rng))


class _Pairs:
    """Distinct (preceding word, word) pairs of a chunk, in the order in which they are sent.

    The word before a document's first is its end token. ``piece`` numbers (context, part).
    """

    def __init__(self, chunk: C.Chunk, hot: dict[int, int], buckets: int):
        hashes = chunk.hashes
        size = len(hashes)
        before = np.concatenate(([0], chunk.tokens[:-1]))
        keys, which = np.unique(before * size + chunk.tokens, return_inverse=True)
        train = np.repeat(chunk.marks, np.diff(chunk.first))
        count = np.bincount(which, weights=train, minlength=len(keys)).astype(np.int64)
        context, word = keys // size, keys % size
        parts = np.ones(size, dtype=np.int64)
        for i in np.flatnonzero(np.isin(hashes, np.array(list(hot), dtype=np.uint64))).tolist():
            parts[i] = hot[int(hashes[i])]
        part = (mix(hashes[word] * _PART) % parts[context].astype(np.uint64)).astype(np.int64)
        used = np.unique(context)
        piece_context = np.repeat(used, parts[used])
        piece_part = np.arange(len(piece_context)) - np.repeat(np.cumsum(parts[used]) - parts[used], parts[used])
        name = mix(hashes[piece_context] + piece_part.astype(np.uint64) * _PART)
        first_piece = np.zeros(size, dtype=np.int64)
        first_piece[used] = np.cumsum(parts[used]) - parts[used]
        order = np.argsort(name, kind="stable")
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        self.name, self.piece_context, self.parts = name[order], piece_context[order], parts[piece_context][order]
        piece = rank[first_piece[context] + part]
        short = hashes >> _SHORT
        sent = np.lexsort((short[word], piece))
        self.piece, self.short, self.count = piece[sent], short[word][sent], count[sent]
        self.word, self.context = word[sent], context[sent]
        back = np.empty(len(sent), dtype=np.int64)
        back[sent] = np.arange(len(sent))
        self.of_token = back[which]
        self.sizes = np.bincount(self.piece, minlength=len(self.name))
        self.shift = np.uint64(64 - (buckets.bit_length() - 1))
        self.buckets = buckets

    def by_bucket(self) -> Iterator[tuple[int, slice, slice]]:
        owner = (self.name >> self.shift).astype(np.int64) if self.buckets > 1 else np.zeros(len(self.name), np.int64)
        ends = np.concatenate(([0], np.cumsum(self.sizes)))
        for bucket, part in C.split_sorted(owner, self.buckets):
            yield bucket, part, slice(int(ends[part.start]), int(ends[part.stop]))


def _pair_messages(pairs: _Pairs) -> Iterator[tuple[int, bytes]]:
    for bucket, pieces, types in pairs.by_bucket():
        short = pairs.short[types]
        yield bucket, C.pack(
            C.gaps(pairs.name[pieces]), pairs.parts[pieces], pairs.sizes[pieces],
            (short >> np.uint64(8)).astype(np.uint32), (short & np.uint64(255)).astype(np.uint8), pairs.count[types])


def _seat_bucket(bucket: int, numbers: list[int], payloads: list[bytes]) -> Iterator[tuple[int, bytes]]:
    parts = [C.unpack(p) for p in payloads]
    names, splits, owners, shorts, counts = [], [], [], [], []
    for name, split, size, upper, lower, count in parts:
        name = C.ungaps(name)
        names.append(name)
        splits.append(split.astype(np.int64))
        owners.append(np.repeat(name, size.astype(np.int64)))
        shorts.append(upper.astype(np.uint64) << np.uint64(8) | lower.astype(np.uint64))
        counts.append(count.astype(np.int64))
    piece_name, first, piece = np.unique(np.concatenate(names), return_index=True, return_inverse=True)
    split = np.concatenate(splits)[first]
    owner, short = np.concatenate(owners), np.concatenate(shorts)
    _, spot, kind = np.unique(mix(owner + short * _PART), return_index=True, return_inverse=True)
    customers = np.bincount(kind, weights=np.concatenate(counts), minlength=len(spot)).astype(np.int64)
    context = np.searchsorted(piece_name, owner[spot])
    dishes, dish = np.unique(short[spot], return_inverse=True)
    tables, last = seat_contexts(customers, context, split, dish, np.random.default_rng(bucket))
    of_piece = np.bincount(context, weights=customers, minlength=len(piece_name)).astype(np.int64)
    tables_of_piece = np.bincount(context, weights=tables, minlength=len(piece_name)).astype(np.int64)
    piece_ends = np.cumsum([len(n) for n in names])[:-1]
    type_ends = np.cumsum([len(o) for o in owners])[:-1]
    for number, own, own_piece in zip(numbers, np.split(kind, type_ends), np.split(piece, piece_ends)):
        yield number, C.pack(customers[own], tables[own], of_piece[own_piece], tables_of_piece[own_piece])
    yield -1 - bucket, C.pack(C.gaps(dishes), np.bincount(dish, weights=last, minlength=len(dishes)).astype(np.int64))


def _send_words(chunk: C.Chunk, buckets: int) -> tuple[np.ndarray, Iterator[tuple[int, slice, bytes]]]:
    """The order in which a chunk sends its words, and the messages."""
    hashes = chunk.hashes
    train = np.repeat(chunk.marks, np.diff(chunk.first))
    count = np.bincount(chunk.tokens, weights=train, minlength=len(hashes)).astype(np.int64)
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]

    def parts():
        for bucket, part in C.split_sorted(_word_bucket(ordered, buckets), buckets):
            yield bucket, part, C.pack(C.gaps(ordered[part]), count[order[part]])

    return order, parts()


def _word_bucket(hashes: np.ndarray, buckets: int, bits: int = 64) -> np.ndarray:
    if buckets == 1:
        return np.zeros(len(hashes), dtype=np.int64)
    return (hashes >> np.uint64(bits - (buckets.bit_length() - 1))).astype(np.int64)


def _count_words(bucket: int, numbers: list[int], payloads: list[bytes]) -> Iterator[tuple[int, bytes]]:
    own = [(n, C.ungaps(a), b.astype(np.int64)) for n, (a, b) in ((n, C.unpack(p)) for n, p in zip(numbers, payloads))]
    asked = [x for x in own if x[0] >= 0]
    given = [x for x in own if x[0] < 0]
    join = lambda arrays, dtype: np.concatenate(arrays) if arrays else np.zeros(0, dtype)
    words, which = np.unique(join([h for _, h, _ in asked], np.uint64), return_inverse=True)
    count = np.bincount(which, weights=join([c for _, _, c in asked], np.int64), minlength=len(words)).astype(np.int64)
    dishes, of_given = np.unique(join([h for _, h, _ in given], np.uint64), return_inverse=True)
    customers = np.bincount(of_given, weights=join([t for _, _, t in given], np.int64), minlength=len(dishes)).astype(np.int64)
    tables = seat_root(customers, np.random.default_rng(bucket)) if len(dishes) else customers
    short = words >> _SHORT
    at = np.minimum(np.searchsorted(dishes, short), max(len(dishes) - 1, 0))
    known = dishes[at] == short if len(dishes) else np.zeros(len(words), dtype=bool)
    root = np.where(known, customers[at], 0) if len(dishes) else np.zeros(len(words), np.int64)
    seated = np.where(known, tables[at], 0) if len(dishes) else np.zeros(len(words), np.int64)
    for (number, _, _), mine in zip(asked, np.split(which, np.cumsum([len(h) for _, h, _ in asked])[:-1])):
        yield number, C.pack(count[mine], root[mine], seated[mine])
    yield -1, np.array([count.sum(), (count > 0).sum(), customers.sum(), tables.sum()], dtype="<i8").tobytes()


def _hot_contexts(chunks: DataFrame, total: int, buckets: int) -> dict[int, int]:
    """Parts of each word that precedes more than half a bucket's share of all words."""
    if buckets == 1:
        return {}

    def often(chunk: C.Chunk, _) -> Iterator[pa.RecordBatch]:
        count = np.bincount(chunk.tokens, minlength=len(chunk.ends))
        some = np.flatnonzero(count > len(chunk.tokens) / (2 * buckets))  # a global share is some chunk's share too
        yield pa.record_batch([pa.array(chunk.hashes[some].view(np.int64)), pa.array(count[some])], names=["h", "n"])

    found = C.chunk_map(chunks, True, often, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).where(
        F.col("n") > total / (2 * buckets)).collect()  # fewer than twice the buckets
    return {int(np.int64(r["h"]).view(np.uint64)): 1 + int(r["n"] * 2 * buckets // total) for r in found}


def score_texts(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``.

    Learns from the rows that are not ``held_out`` (a null flag counts as held out). Scores are log10
    probabilities; a text's tokens are its words in lower case (A-Z) and one end. Null and empty
    texts are one end. Ids must be whole numbers; null and repeated ids are rows like others. With
    nothing to learn from, the model is uniform over one unknown word, and all scores are 0. Texts of
    any length are read whole; a pair of words takes one count however often it occurs. Other
    columns of ``docs`` are not read, so their names cannot clash.
    """
    chunks = C.write_chunks(docs, id_col, text, lower=True, end=True, mark=~held_out)
    total = C.word_count(chunks, True)
    buckets = C.bucket_count(total)
    word_buckets = C.bucket_count(total // 4)
    hot = _hot_contexts(chunks, total, buckets)

    def ask_pairs(chunk: C.Chunk, _) -> Iterator[pa.RecordBatch]:
        yield C.messages(chunk.number, _pair_messages(_Pairs(chunk, hot, buckets)))

    seated = cut(C.answered(C.chunk_map(chunks, True, ask_pairs, C.MESSAGE), _seat_bucket), "restaurants")

    def ask_words(chunk: C.Chunk, _) -> Iterator[pa.RecordBatch]:
        yield C.messages(chunk.number, ((b, payload) for b, _, payload in _send_words(chunk, word_buckets)[1]))

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, raw in zip(batch.column("chunk").to_pylist(), batch.column("answer").to_pylist()):
                steps, count = C.unpack(raw)
                dishes = C.ungaps(steps)
                yield C.messages(number, ((bucket, C.pack(C.gaps(dishes[part]), count[part])) for bucket, part in
                                          C.split_sorted(_word_bucket(dishes, word_buckets, 40), word_buckets)))

    sent = seated.where("chunk < 0").select("chunk", "answer").mapInArrow(tables, C.MESSAGE)
    counted = cut(C.answered(C.chunk_map(chunks, True, ask_words, C.MESSAGE).unionByName(sent), _count_words), "words")
    sums = np.zeros(4, dtype=np.int64)
    for r in counted.where("chunk < 0").select("answer").collect():  # one row per bucket
        sums += np.frombuffer(r["answer"], "<i8")
    tokens, distinct, customers, root_tables = sums.tolist()
    names = [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def finish(chunk: C.Chunk, row: dict) -> Iterator[pa.RecordBatch]:
        order, parts = _send_words(chunk, word_buckets)
        count, root, seats = (np.zeros(len(order), dtype=np.int64) for _ in range(3))
        for bucket, part, _ in parts:
            for out, values in zip((count, root, seats), C.unpack(row["words"][bucket])):
                out[order[part]] = values
        parent = (root - ROOT_DISCOUNT * seats / SAMPLES + (ROOT_STRENGTH + ROOT_DISCOUNT * root_tables / SAMPLES)
                  / (distinct + 1)) / (ROOT_STRENGTH + customers)
        pairs = _Pairs(chunk, hot, buckets)
        own, own_tables = (np.zeros(len(pairs.word), dtype=np.int64) for _ in range(2))
        whole, whole_tables = (np.zeros(len(order), dtype=np.int64) for _ in range(2))
        for bucket, pieces, types in pairs.by_bucket():
            of_type, t_type, of_piece, t_piece = C.unpack(row["pairs"][bucket])
            own[types], own_tables[types] = of_type, t_type
            np.add.at(whole, pairs.piece_context[pieces], of_piece.astype(np.int64))
            np.add.at(whole_tables, pairs.piece_context[pieces], t_piece.astype(np.int64))
        all_tables = whole_tables[pairs.context] / SAMPLES
        chance = (own - DISCOUNT * own_tables / SAMPLES + (STRENGTH + DISCOUNT * all_tables) * parent[pairs.word]) / (
            STRENGTH + whole[pairs.context])
        begin = chunk.first[:-1]  # every document has its end token, so no sum is over nothing
        add = lambda values: np.add.reduceat(values, begin)
        base = np.log10((count + 1) / (tokens + distinct + 1))
        yield pa.record_batch([
            pa.array(chunk.ids, mask=chunk.ids == C.NO_ID), pa.array(~chunk.marks), pa.array(np.diff(chunk.first)),
            pa.array(add((count > 0)[chunk.tokens].astype(np.int64))), pa.array(np.full(len(begin), tokens)),
            pa.array(add(base[chunk.tokens])), pa.array(add(np.log10(chance)[pairs.of_token]))], names=names)

    return C.chunk_map(C.with_answers(chunks, pairs=seated, words=counted), True, finish,
                       f"`{id_col}` bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
                       "base_score double, score double")
