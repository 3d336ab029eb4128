"""One query per operator over the given tables, with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import blocknames, decontaminate, linededup, packing, periodic, phrases, pitmanyor, sharding, simhash, substrings, suffixgroups, tokenfile, toxicity
from ledgerlens.llm.tables import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = sql
        return build
    return register


@query("op1_best_fit_packing")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(documents(spark, folder), public_tokenizers.path("byte_bpe_50k.json"))


@query("op2_sharding")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shuffle_to_shards(documents(spark, folder))


@query("op3_toxicity")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.classify(documents(spark, folder), documents(spark, folder, "labels"))


@query("op4_exact_dedup", """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return blocknames.exact_duplicates(documents(spark, folder))


@query("op5_line_dedup", """
WITH lines AS (SELECT doc_id, source, trim(u.line) AS line
               FROM documents, unnest(string_split(text, chr(10))) AS u(line)),
spread AS (SELECT line FROM lines WHERE length(line) > 0 GROUP BY line HAVING count(DISTINCT source) >= 10),
hit AS (SELECT doc_id FROM lines GROUP BY doc_id
        HAVING count(*) FILTER (line IN (SELECT line FROM spread)) > 0
           AND count(*) FILTER (length(line) > 0 AND line NOT IN (SELECT line FROM spread)) > 0),
bad AS (SELECT list(line) AS lines FROM spread),
cut AS (SELECT doc_id, string_split(text, chr(10)) AS all_lines,
               CASE WHEN doc_id IN (SELECT doc_id FROM hit)
                    THEN list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(bad.lines, trim(x)))
                    ELSE string_split(text, chr(10)) END AS kept
        FROM documents, bad)
SELECT doc_id, coalesce(len(all_lines), 0) AS n_lines,
       coalesce(len(all_lines) - len(kept), 0) AS n_removed, array_to_string(kept, chr(10)) AS text FROM cut""")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "source", "text")
    return linededup.remove_spread_lines(docs, counts=True).select("doc_id", "n_lines", "n_removed", "text")


@query("op6_token_files")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    manifest = tokenfile.write_token_files(documents(spark, folder), public_tokenizers.path("word_bpe_49k.json"), 1)
    return tokenfile.read_token_files(manifest)


@query("op7_substring_dedup")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.remove_repeats(documents(spark, folder))


@query("op8_pitman_yor")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return pitmanyor.score_texts(documents(spark, folder), held_out)


@query("op9_decontamination")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.report(documents(spark, folder), documents(spark, folder, "benchmark"))


@query("op10_simhash_neardup")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, folder))


@query("op11_periodic_runs")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return periodic.digests(periodic.find_runs(periodic.repeat_tails(documents(spark, folder))))


@query("op12_phrase_collocations", """
WITH texts AS (
    SELECT doc_id, row_number() OVER () AS row_no, coalesce(lang, 'und') AS lang,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
    FROM documents),
pieces AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM texts),
lists AS (SELECT lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda x: x <> '') AS words FROM pieces),
sizes AS (SELECT lang, words, len(words) AS size FROM lists WHERE len(words) > 0),
totals AS (SELECT lang, sum(size)::BIGINT AS n FROM sizes GROUP BY lang),
starts AS (SELECT lang, words, size, k, unnest(range(1, size - k + 2)) AS i
           FROM sizes, (VALUES (1), (2), (3), (4)) AS lengths(k) WHERE size >= k),
counts AS (SELECT lang, k, array_to_string(list_slice(words, i, i + k - 1), ' ') AS phrase, count(*) AS f
           FROM starts GROUP BY ALL HAVING count(*) >= 30),
parts AS (SELECT lang, phrase, k, f, string_split(phrase, ' ') AS words FROM counts WHERE k > 1),
cuts AS (SELECT p.lang, p.phrase, p.f AS a, j, x.f AS l, y.f AS r,
                (2000000::HUGEINT * p.f // (x.f::HUGEINT + y.f))::BIGINT AS score
         FROM (SELECT *, unnest(range(1, k)) AS j FROM parts) p
         JOIN counts x ON x.lang = p.lang AND x.phrase = array_to_string(list_slice(p.words, 1, j), ' ')
         JOIN counts y ON y.lang = p.lang AND y.phrase = array_to_string(list_slice(p.words, j + 1, p.k), ' ')),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
spots AS (SELECT lang, words, f, k, m, unnest(range(1, k - m + 2)) AS i
          FROM parts, (VALUES (2), (3)) AS inner_lengths(m) WHERE m < k),
longer AS (SELECT lang, array_to_string(list_slice(words, i, i + m - 1), ' ') AS phrase, max(f) AS best
           FROM spots GROUP BY ALL),
ranked AS (SELECT c.lang, row_number() OVER (PARTITION BY c.lang ORDER BY c.score DESC, c.a DESC, c.phrase) AS rank,
                  c.phrase, c.a, c.l, c.r, c.score
           FROM lowest c LEFT JOIN longer g ON g.lang = c.lang AND g.phrase = c.phrase
           WHERE g.best IS NULL OR 100::HUGEINT * g.best < 80::HUGEINT * c.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000""")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(*phrases.frequent_phrases(documents(spark, folder)))


@query("op13_suffix_dedup")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    found = suffixgroups.remove_repeats(documents(spark, folder))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda total, span: total + span["length"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"),
                        F.sha2("kept", 256).alias("kept_sha256"))
