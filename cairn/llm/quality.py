"""Quality rules as a short-circuit cascade: the order of the rules follows cost and selectivity.

All expressions are DataFrame functions. A rule is an expression that is true for a document to
reject. Cost and rejection share of each rule are measured on a bounded sample; rules with the most
rejections per second come first, and a document leaves at the first rule that rejects it, so that
the dear rules see only what the cheap ones have left. The order never changes which documents stay.

Edge cases: a null or blank text has no words and is rejected as too short. A null ``doc_id`` is
carried through. Repeated rows are judged one by one. An empty table gives an empty table. Columns
of the input with any name stay as they are.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import fresh, let, words
from cairn.sources.scratch import cut_lineage

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Rows on which the order of the rules is estimated; the verdicts cover every row.
SAMPLE_ROWS = 2000


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Column


def word_chars(tokens: Column) -> Column:
    return F.length(F.array_join(tokens, "")).cast("long")


def symbol_count(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(
        F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")
    )
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def repeated_words(tokens: Column) -> Column:
    """Words inside windows of five words that are found twice or more in the text.

    Windows are compared by a 64-bit hash of their word hashes. Texts without a repeated window end
    after one hash set; the others sort their windows.
    """
    hashes = F.transform(tokens, lambda w: F.xxhash64(w))

    def windows(h: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(h) - WINDOW)
        return F.transform(at, lambda i: F.xxhash64(*[h[i + k] for k in range(WINDOW)]))

    def starts(by_hash: Column) -> Column:
        last = F.size(by_hash) - 1
        again = F.filter(
            by_hash,
            lambda x, j: ((j > 0) & (by_hash[F.greatest(j - 1, F.lit(0))].x == x.x))
            | ((j < last) & (by_hash[F.least(j + 1, last)].x == x.x)),
        )
        return F.sort_array(F.transform(again, lambda x: x.i))

    def covered(at: Column) -> Column:
        last = F.size(at) - 1
        width = F.transform(
            at,
            lambda p, j: F.when(j == last, F.lit(WINDOW)).otherwise(
                F.least(F.lit(WINDOW), at[F.least(j + 1, last)] - p)
            ),
        )
        return F.aggregate(width, F.lit(0), lambda s, x: s + x)

    def repeats(g: Column) -> Column:
        by_hash = F.sort_array(
            F.transform(g, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
        )
        found = let(by_hash, lambda s: let(starts(s), covered))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(found)

    counted = let(hashes, lambda h: let(windows(h), repeats))
    return F.when(F.size(tokens) < WINDOW, F.lit(0)).otherwise(counted).cast("long")


def default_rules(text: Column, tokens: Column) -> list[Rule]:
    """Base rules first, then symbol, line, letter and word-length rules."""
    n = F.size(tokens)
    lines = F.size(
        F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    )
    lettered = F.size(F.filter(tokens, lambda w: w.rlike(r"\p{L}")))
    letters = word_chars(tokens)
    return [
        Rule("few_words", n < 10),
        Rule("repeated_words", 100 * repeated_words(tokens) > 20 * n),
        Rule("symbols", 10 * symbol_count(text) > 2 * n),
        Rule("duplicate_lines", 100 * duplicate_lines(text) > 30 * lines),
        Rule("few_letters", 100 * lettered < 70 * n),
        Rule("word_length", (letters < 2 * n) | (letters > 20 * n)),
    ]


def order_rules(sample: DataFrame, rules: list[Rule]) -> list[Rule]:
    """Rules by rejections per second on the sample, most first; ties by name."""

    def seconds(column: Column) -> tuple[float, int]:
        began = time.perf_counter()
        n = sample.agg(F.count_if(column)).first()[0]
        return time.perf_counter() - began, n

    seconds(F.lit(True))  # compile and warm the scan
    base, total = seconds(F.lit(True))
    if not total:
        return list(rules)
    measured = {}
    for rule in rules:
        took, rejected = seconds(F.coalesce(rule.rejects, F.lit(False)))
        measured[rule.name] = (rejected / total) / max(took - base, 1e-3)
    return sorted(rules, key=lambda r: (-measured[r.name], r.name))


def cascade(rules: list[Rule]) -> Column:
    """Name of the first rule that rejects, null if none does. Later rules aren't evaluated."""
    verdict = F.when(F.lit(False), F.lit(""))
    for rule in rules:
        verdict = verdict.when(rule.rejects, F.lit(rule.name))
    return verdict


def draw(df: DataFrame, text: str, rows: int) -> DataFrame:
    """About ``rows`` texts, drawn alike from all partitions, as a written table."""
    share = min(1.0, rows / max(1, df.count()))
    return cut_lineage(df.select(text).sample(share, seed=13).repartition(8))


def judge(
    df: DataFrame, text: str = "text", verdict: str = "rejected_by", sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """``df`` with ``verdict``: the rule that rejects the row, null for rows to keep.

    Which rule is named depends on the measured order; whether one is named doesn't.
    """
    tokens = fresh(df)
    sample = draw(df, text, sample_rows).withColumn(tokens, words(F.col(text)))
    names = [r.name for r in order_rules(sample, default_rules(F.col(text), F.col(tokens)))]

    def rejected(found: Column) -> Column:
        rules = {r.name: r for r in default_rules(F.col(text), found)}
        return cascade([rules[n] for n in names])

    # Bound once inside the expression: a filter pushed below a column of words would split for each use.
    return df.withColumn(verdict, let(words(F.col(text)), rejected))


def keep(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows that no rule rejects, with the columns of ``df``."""
    verdict = fresh(df)
    return judge(df, text, verdict).filter(F.col(verdict).isNull()).drop(verdict)


def quality_report(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts, base verdict and cascade verdict per document.

    The counts are part of the result, so the base rules read them; the other rules run as a cascade
    over what the base rules keep.
    """
    docs = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn(
        "tokens", words(F.col("text"))
    )
    rules = default_rules(F.col("text"), F.col("tokens"))
    sample = draw(docs, "text", SAMPLE_ROWS).withColumn("tokens", words(F.col("text")))
    base = {"few_words", "repeated_words"}
    ordered = [r for r in order_rules(sample, rules) if r.name not in base]
    counted = docs.select(
        "doc_id",
        "text",
        "tokens",
        F.size("tokens").cast("long").alias("n_words"),
        word_chars(F.col("tokens")).alias("word_chars"),
        symbol_count(F.col("text")).alias("n_symbols"),
        duplicate_lines(F.col("text")).alias("n_dup_lines"),
        repeated_words(F.col("tokens")).alias("n_repeat_words"),
    ).withColumn(
        "base_failed",
        (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
    )
    verdict = F.when(F.col("base_failed"), F.lit("base")).otherwise(cascade(ordered))
    return counted.withColumn("kept", verdict.isNull()).drop("text", "tokens")


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP1_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
l AS (SELECT r, unnest(list_filter(string_split(text, chr(10)),
             lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) AS line FROM docs),
dl AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM l GROUP BY r),
g AS (SELECT r, i, list_slice(w, i, i + 4) AS g
      FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM docs WHERE len(w) >= 5)),
d AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1),
p AS (SELECT r, sum(least(5, coalesce(nxt - i, 5))) AS n
      FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM d) GROUP BY r),
s AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_dup, 0) AS n_dup_lines, CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words,
         coalesce(n_lines, 0) AS n_lines,
         len(list_filter(w, lambda x: regexp_matches(x, '\p{L}'))) AS lettered
  FROM docs LEFT JOIN dl USING (r) LEFT JOIN p USING (r)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > 2 * n_words OR 100 * n_dup_lines > 30 * n_lines
            OR 100 * lettered < 70 * n_words OR word_chars < 2 * n_words
            OR word_chars > 20 * n_words) AS kept
FROM f
"""
