"""Quality rules: a table of thresholds compiled into one projection, without user functions.

A rule names a measure, the least and the largest value that a document may have. Measures are ratios over the whole
text; ``compile_rules`` turns the table into one boolean column, so rules can be changed without touching the plan.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from surveykit.llm.registry import query, table
from surveykit.llm.words import IN_WORD, full_text, let, words

WINDOW = 5

# Common function words of English, German, French and Spanish.
STOP_WORDS = (
    "the be to of and that have with is was in it for on as are by at from this or an a "
    "der die das und ist in den von zu mit sich des auf für ein eine nicht im dem "
    "le la les de des et un une est que qui dans pour par sur en du "
    "el los las y en del se por con una para al"
).split()


class Rule(NamedTuple):
    measure: str
    least: float | None
    most: float | None
    #: a ratio over a handful of words says little: the rule holds for texts of this many words
    from_words: int = 0


RULES = (
    Rule("n_words", 10, None),
    Rule("mean_word_chars", 1.5, 20.0),
    Rule("symbols_per_word", None, 0.25),
    Rule("stop_word_ratio", 0.02, None, 20),
    Rule("dup_line_ratio", None, 0.7),
)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the counts that the rules use; ``_words`` and ``_lines`` hold the split text for the next projection."""
    body = full_text(text)
    held = docs.withColumns(
        {
            "_words": words(body),
            "_lines": F.filter(F.split(body, "\n"), lambda line: line.rlike(IN_WORD)),
            "n_symbols": (F.char_length(body) - F.char_length(F.translate(body, "#*$%&|<>", ""))).cast("long"),
        }
    )
    return held.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.char_length(F.array_join("_words", "")).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": let(_window_hashes(F.col("_words")), _repeat_words).cast("long"),
            "n_stop_words": F.size(F.filter("_words", lambda w: F.lower(w).isin(sorted(set(STOP_WORDS))))).cast("long"),
        }
    ).drop("_words", "_lines")


def _window_hashes(split: Column) -> Column:
    """A 64-bit hash of each window of five words; two different windows of one text sharing one is a 2**-64 event."""
    return let(
        split,
        lambda w: F.when(
            F.size(w) >= WINDOW,
            F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW)))),
        ).otherwise(F.array().cast("array<bigint>")),
    )


def _repeat_words(hashes: Column) -> Column:
    """Words inside windows that occur twice or more. Only texts that repeat a window pay for the sorting."""

    def twice(ordered: Column) -> Column:
        return F.filter(ordered, lambda e, k: (F.get(ordered, k - 1)["h"] == e["h"]) | (F.get(ordered, k + 1)["h"] == e["h"]))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - x, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    places = let(ordered, lambda o: F.sort_array(F.transform(twice(o), lambda e: e["i"])))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(places, covered))


def measures() -> dict[str, Column]:
    n, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    return {
        "n_words": F.col("n_words"),
        "mean_word_chars": F.col("word_chars") / n,
        "symbols_per_word": F.col("n_symbols") / n,
        "stop_word_ratio": F.col("n_stop_words") / n,
        "dup_line_ratio": F.col("n_dup_lines") / lines,
        "repeat_word_ratio": F.col("n_repeat_words") / n,
    }


def compile_rules(rules: Sequence[Rule]) -> Column:
    known, verdict = measures(), F.lit(True)
    for rule in rules:
        short = F.col("n_words") < rule.from_words
        if rule.least is not None:
            verdict = verdict & (short | (known[rule.measure] >= F.lit(rule.least)))
        if rule.most is not None:
            verdict = verdict & (short | (known[rule.measure] <= F.lit(rule.most)))
    return verdict


def quality_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """Each row with its counts, ``base_failed`` and ``kept``.

    A null or empty text has no words, fails the base and isn't kept. Repeated rows are judged alike, one by one. A
    column of ``docs`` that has the name of a count is replaced by the count.
    """
    counted = measured(docs, text)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return counted.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & compile_rules(rules))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def keep_good(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows that pass, with the columns they came with."""
    held = docs.select(F.struct("*").alias("_row"), F.col("text"))
    return quality_rules(held, rules).where("kept").select("_row.*")


def _rules_sql() -> str:
    ratio = {
        "n_words": "n_words",
        "mean_word_chars": "word_chars::DOUBLE / greatest(n_words, 1)",
        "symbols_per_word": "n_symbols::DOUBLE / greatest(n_words, 1)",
        "stop_word_ratio": "n_stop_words::DOUBLE / greatest(n_words, 1)",
        "dup_line_ratio": "n_dup_lines::DOUBLE / greatest(n_lines, 1)",
    }
    tests = [f"(n_words < {r.from_words} OR {ratio[r.measure]} >= {r.least})" for r in RULES if r.least is not None]
    tests += [f"(n_words < {r.from_words} OR {ratio[r.measure]} <= {r.most})" for r in RULES if r.most is not None]
    return " AND ".join(tests)


_STOPS = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
COUNTED_SQL = f"""
  base AS (
    SELECT doc_id, coalesce(text, '') AS t,
           regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
    FROM documents),
  places AS (
    SELECT doc_id, i, array_to_string(w[i + 1:i + 5], ' ') AS win
    FROM (SELECT doc_id, w, unnest(range(len(w) - 4)) AS i FROM base WHERE len(w) >= 5)),
  again AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM places),
  covered AS (
    SELECT doc_id, count(DISTINCT p) AS n
    FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM again WHERE c > 1) GROUP BY doc_id),
  counted AS (
    SELECT b.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
           (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
           len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
           coalesce(c.n, 0)::BIGINT AS n_repeat_words,
           len(list_filter(w, lambda x: lower(x) IN ({_STOPS})))::BIGINT AS n_stop_words
    FROM base b LEFT JOIN covered c ON b.doc_id = c.doc_id),
  judged AS (
    SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted),
  verdict AS (SELECT *, NOT base_failed AND {_rules_sql()} AS kept FROM judged)
"""


@query(
    "op8_quality_rules",
    f"WITH {COUNTED_SQL} SELECT doc_id, {', '.join(COUNTS)}, base_failed, kept FROM verdict",
)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return quality_rules(docs).select("doc_id", *COUNTS, "base_failed", "kept")
