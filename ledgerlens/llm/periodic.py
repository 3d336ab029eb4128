"""Periodic runs of words inside one document, by seeds on diagonals.

A run of period q and length L is a stretch in which words q apart are equal; on the diagonal of
lag q it is a row of L - q matches. Asking for ``min_words`` words and ``min_repeats`` periods
guarantees max(min_words - q, (min_repeats - 1) * q) matches, so a k-gram of that many words occurs
twice in the run, q apart. k-grams are indexed per class of lags: one k for the short lags, then
k = 2^j for lags in (2^(j-1), 2^j].

Because k is never shorter than the lag, two occurrences closer than q inside the run would give
the whole run a smaller period. So each occurrence is paired with its next one only: the pairs are
fewer than the words, however often a k-gram comes back, and a pair's lag is the smallest period of
the run it lies in. Pairs are extended along their diagonal in order of place; a table of the
furthest covered place per lag skips those that an earlier extension has passed.

Everything happens inside a document, so nothing is shuffled; a task holds some 4 MB of texts, or
one text if that is longer, as arrays of eight bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.tables import arrow_map, slices
from ledgerlens.llm.words import SPACED, covered, mix, text_bytes, window_starts, words_of

MIN_WORDS, MIN_REPEATS = 24, 3
_PAIR = np.uint64(0xC2B2AE3D27D4EB4F)


def overlap(min_words: int, min_repeats: int) -> int:
    """The k of the short lags: the largest power of two that every run holds as matches."""
    least = min(max(min_words - q, (min_repeats - 1) * q) for q in range(1, min_words + 1))
    return 1 << (least.bit_length() - 1)


def _doubled(grams: np.ndarray, width: int) -> np.ndarray:
    """Hashes of twice as many words from each place; not linear in the words' hashes."""
    n = max(0, len(grams) - width)
    return mix(grams[:n] * _PAIR + grams[width:width + n])


def _recurring(grams: np.ndarray, place: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ``place``, those whose gram comes again in the same row, ordered by gram and place, and
    for each the distance to its next occurrence (0: the last)."""
    key = grams[place] + mix(row[place].astype(np.uint64) + _PAIR)
    order = np.argsort(key)
    same = np.zeros(len(order) + 1, dtype=bool)
    same[1:-1] = key[order][1:] == key[order][:-1]
    some = order[same[1:] | same[:-1]]
    some = some[np.lexsort((place[some], key[some]))]
    spot, key = place[some], key[some]
    step = np.zeros(len(spot), dtype=np.int64)
    step[:-1] = np.where((key[1:] == key[:-1]) & (row[spot[1:]] == row[spot[:-1]]), np.diff(spot), 0)
    return spot, step


def _matching(words: np.ndarray, a: int, b: int, room: int, step: int) -> int:
    """How many entries agree from ``a`` and ``b`` on, in direction ``step``, at most ``room``."""
    done, block = 0, 64
    while done < room:
        n = min(block, room - done)
        x, y = a + step * done, b + step * done
        differ = np.flatnonzero(words[x:x + n] != words[y:y + n] if step > 0 else
                                words[x - n + 1:x + 1][::-1] != words[y - n + 1:y + 1][::-1])
        if len(differ):
            return done + int(differ[0])
        done, block = done + n, block * 2
    return done


def _extend(words: np.ndarray, first: np.ndarray, row: np.ndarray, place: np.ndarray, lag: np.ndarray,
            min_words: int, min_repeats: int) -> Iterator[tuple[int, int, int, int]]:
    """(row, start, length, period) of the runs around the pairs (place, place + lag)."""
    order = np.lexsort((place, lag, row[place]))
    place, lag = place[order], lag[order]
    owner = row[place]
    heads = np.flatnonzero(np.diff(owner, prepend=-1) | np.diff(lag, prepend=-1))
    for at, end in zip(heads.tolist(), np.append(heads[1:], len(place)).tolist()):
        r, q = int(owner[at]), int(lag[at])
        low, high, furthest = int(first[r]), int(first[r + 1]), -1
        while at < end:
            i = int(place[at])
            start = i - _matching(words, i - 1, i + q - 1, i - max(low, furthest), -1)
            stop = i + q + _matching(words, i, i + q, high - i - q, 1)
            if stop - start >= max(min_words, min_repeats * q):
                yield r, start - low, stop - start, q
            furthest = stop - q  # matches on this diagonal are settled up to here
            at += int(np.searchsorted(place[at:end], furthest))


def runs_of(words: np.ndarray, first: np.ndarray, min_words: int = MIN_WORDS,
            min_repeats: int = MIN_REPEATS) -> np.ndarray:
    """Rows (row, start, length, period), ordered so, of all rows of hashed words."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    grams, width, k = words, 1, overlap(min_words, min_repeats)
    while width < k:
        grams, width = _doubled(grams, width), 2 * width
    place = window_starts(first, k)
    found, low = [], 0
    while len(place):
        place, step = _recurring(grams, place, row)
        pair = (step > low) & (step <= k)
        found += _extend(words, first, row, place[pair], step[pair], min_words, min_repeats)
        low, k = k, 2 * k
        grams = _doubled(grams, low)
        room = first[row[place] + 1]  # a longer lag needs a longer gram, and a text that holds the run
        place = np.sort(place[(place + k <= room) & (room - first[row[place]] >= min_repeats * (low + 1))])
    found = np.array(found, dtype=np.int64).reshape(-1, 4)
    return found[np.lexsort((found[:, 3], found[:, 1], found[:, 0]))]


def find_runs(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS,
              min_repeats: int = MIN_REPEATS) -> DataFrame:
    """(id, n_words, runs, collapsed) for every row of ``docs``.

    ``runs`` holds (start, length, period) of every maximal stretch with smallest period ``period``
    and at least max(min_words, min_repeats * period) words, by start, then period; words are
    counted from 0 and parted by ASCII white space. ``collapsed`` is the text without the words that
    some run holds after its first period, joined by single spaces. ``min_repeats`` is 3 or more.

    Null, empty and short texts have no runs and collapse to their words ("" for null). Rows are
    judged one by one, so repeated rows and ids, also null ones, give equal results. Very long texts
    are read whole. Other columns are not read. Words are told apart by 64-bit hashes.
    """
    if min_repeats < 3:
        raise ValueError("min_repeats must be 3 or more")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(iter([batch]), "text"):
                yield _judged(part, min_words, min_repeats)

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")), run,
                     f"id {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, "
                     "collapsed string").withColumnRenamed("id", id_col)


def _judged(part: pa.RecordBatch, min_words: int, min_repeats: int) -> pa.RecordBatch:
    words = words_of(part.column("text"), SPACED)
    found = runs_of(words.hash, words.first, min_words, min_repeats)
    owner = found[:, 0]
    gone = covered(len(words.start), words.first[owner] + found[:, 1] + found[:, 3], found[:, 2] - found[:, 3])
    data, bounds = text_bytes(part.column("text"))
    raw, collapsed = data.tobytes(), []
    hit = np.zeros(len(part), dtype=bool)
    hit[owner] = True
    for r, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        here = raw[a:b].split()
        if hit[r]:
            here = compress(here, (~gone[words.first[r]:words.first[r + 1]]).tolist())
        collapsed.append(b" ".join(here))
    spans = pa.StructArray.from_arrays([pa.array(found[:, c]) for c in (1, 2, 3)], ["start", "length", "period"])
    runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(part) + 1)), pa.int32()), spans)
    return pa.record_batch([part.column("id"), pa.array(np.diff(words.first)), runs,
                            pa.array(collapsed, pa.binary()).cast(pa.string())],
                           names=["id", "n_words", "runs", "collapsed"])


def repeat_tails(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with a periodic tail in every tenth text, chosen and shaped by the crc32 of its id.

    With h the crc32 of the decimal id and g = h div 10, texts with h % 10 = 0 are cut into their n
    words; from word a = g % n on, word i becomes word a + (i - a) % p, p = 1 + (n - a) div
    (3 + g % 8). Other texts, null texts and rows with a null id stay as they are.
    """
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    g = ((h - h % 10) / 10).cast("bigint")

    def tail(words: Column) -> Column:
        n = F.greatest(F.size(words).cast("bigint"), F.lit(1))
        a = g % n
        parts = 3 + g % 8
        period = 1 + ((n - a - (n - a) % parts) / parts).cast("bigint")
        return F.array_join(F.transform(words, lambda w, i: F.when(i < a, w).otherwise(
            F.get(words, (a + (i - a) % period).cast("int")))), " ")

    words = F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    changed = F.get(F.transform(F.array(words), tail), F.lit(0))
    return docs.withColumn(text, F.when((h % 10 == 0) & F.col(text).isNotNull(), changed).otherwise(F.col(text)))


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``find_runs``: counts, the run of greatest length/period, and checksums.

    Ratios are compared exactly; ties go to the smallest start, then the smallest period. A text
    without runs has null ``start``, ``length``, ``period`` and ``exponent_milli``.
    """
    def order(a: Column, b: Column) -> Column:
        left, right = a["length"] * b["period"], b["length"] * a["period"]
        return (F.when(left > right, -1).when(left < right, 1).when(a["start"] < b["start"], -1)
                .when(a["start"] > b["start"], 1).when(a["period"] < b["period"], -1).otherwise(1))

    best = F.get(F.array_sort("runs", order), F.lit(0))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    rows = found.withColumn("best", F.when(F.size("runs") > 0, best))
    thousandths = F.col("best.length") * 1000
    return rows.select(
        id_col, F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        ((thousandths - thousandths % F.col("best.period")) / F.col("best.period")).cast("bigint").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
