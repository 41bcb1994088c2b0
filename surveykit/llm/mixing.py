"""Mixing sources to target weights: repetition rates per source, whole copies and one hash-seeded Bernoulli copy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from surveykit.llm.registry import query, table
from surveykit.llm.words import full_text, words

WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
MOST_TIMES = 2
SEEDS = 16


def sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("size", F.size(words(full_text())).cast("long"))


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, percent: int = SHARE_PERCENT, times: int = MOST_TIMES) -> DataFrame:
    """``(source, source_size)`` to ``target``: a share by weight that stops at ``times`` the source's size.

    What the stopped sources leave is shared again by weight. That ends where the sources with the least room per
    weight are stopped and the rest has one level of words per weight, so one ordered pass finds it. Windows without a
    partition see one row per source here, never documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_room = Window.orderBy(F.col("room") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    after = by_room.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    at = (F.row_number().over(by_name) - 1) % len(weights)
    weighed = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), at + 1).cast("long")).withColumn("room", F.col("source_size") * times)
    whole = Window.partitionBy()
    levelled = weighed.withColumn(
        "level",
        (F.sum("source_size").over(whole) * percent / 100 - F.coalesce(F.sum("room").over(before), F.lit(0))) / F.sum("weight").over(after),
    ).withColumn("stopped", F.col("room") / F.col("weight") <= F.col("level"))
    first = F.min(F.when(~F.col("stopped"), F.struct(F.col("room") / F.col("weight"), F.col("source").isNull(), F.col("source"), F.col("level")))).over(whole)
    return levelled.withColumn("level", first["level"]).select(
        "source", "source_size", F.when(F.col("stopped"), F.col("room").cast("double")).otherwise(F.col("weight") * F.col("level")).alias("target")
    )


def draw(seed: int, key: str = "doc_id") -> Column:
    """A number in [0, 1) with 32 bits, the same on each run and in any engine that has md5."""
    text = F.md5(F.concat_ws(":", F.lit(str(seed // 4)), F.coalesce(F.col(key).cast("string"), F.lit("")).cast("string")))
    part = F.substring(text, 8 * (seed % 4) + 1, 8)
    return F.conv(part, 16, 10).cast("double") / F.lit(4294967296.0)


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, percent: int = SHARE_PERCENT, times: int = MOST_TIMES, seeds: int = SEEDS) -> DataFrame:
    """Each row with ``size``, ``source_size``, ``target`` and ``copies``.

    ``copies`` is floor(rate) and one more where the row's draw is below the fraction; rate is target / source_size.
    A source uses the one of ``seeds`` seeds whose draws bring it nearest to its target, the smallest on ties; that is
    one sum per seed and source. A null text has size 0, a null source is a source, a source without words has target
    0 and no copies, repeated rows are drawn alike, and an empty table gives no rows. Columns of ``docs`` with the names of
    the added ones are replaced.
    """
    seen = sized(docs.drop("source_size", "target", "copies"))
    sizes = seen.groupBy("source").agg(F.sum("size").alias("source_size"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = source_targets(sizes, weights, percent, times).withColumn("whole", F.floor(rate)).withColumn("part", rate - F.floor(rate))
    targets = targets.withColumnRenamed("source", "_source")
    same = F.col("d.source").eqNullSafe(F.col("t._source"))
    hashed = seen.select("size", "doc_id", "source").alias("d").join(targets.alias("t"), same).select("t.*", F.col("d.size").alias("_size"), "d.doc_id")
    sums = [F.sum(F.when(draw(s) < F.col("part"), F.col("_size")).otherwise(0)).alias(f"s{s}") for s in range(seeds)]
    tried = hashed.groupBy("_source", "source_size", "target", "whole", "part").agg(*sums)
    off = [F.struct(F.abs(F.col("whole") * F.col("source_size") + F.col(f"s{s}") - F.col("target")).alias("off"), F.lit(s).alias("seed")) for s in range(seeds)]
    chosen = tried.select("_source", "source_size", "target", F.struct("whole", "part", (F.least(*off) if seeds > 1 else off[0])["seed"].alias("seed")).alias("_plan"))
    drawn = F.coalesce(*(F.when(F.col("_plan.seed") == s, draw(s)) for s in range(seeds)))
    joined = seen.alias("d").join(chosen.alias("t"), same).select("d.*", "t.source_size", "t.target", "t._plan")
    return joined.withColumn("copies", (F.col("_plan.whole") + (drawn < F.col("_plan.part")).cast("long")).cast("long")).drop("_plan")


def emit(docs: DataFrame) -> DataFrame:
    """The mix itself: every row as often as it is taken, with the columns it came with."""
    held = docs.select(F.struct("*").alias("_row"), "doc_id", "source", "text")
    return mix(held).select("_row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("_row.*")


def mix_sql(source: str = "documents") -> str:
    draws = ",\n".join(
        f"('0x' || substr(md5('{s // 4}:' || coalesce(doc_id::VARCHAR, '')), {8 * (s % 4) + 1}, 8))::BIGINT::DOUBLE / 4294967296.0 AS u{s}" for s in range(SEEDS)
    )
    sums = ", ".join(f"sum(CASE WHEN u{s} < part THEN size ELSE 0 END) AS s{s}" for s in range(SEEDS))
    offs = ", ".join(f"{{'off': abs(whole * source_size + s{s} - target), 'seed': {s}}}" for s in range(SEEDS))
    used = " ".join(f"WHEN {s} THEN u{s}" for s in range(SEEDS))
    return f"""
  sized AS (SELECT *, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM {source}),
  sources AS (
    SELECT source, sum(size)::BIGINT AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
           WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM sized GROUP BY source),
  levelled AS (
    SELECT *, 2 * source_size AS room,
           ((sum(source_size) OVER ())::DOUBLE * 150 / 100
            - coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
           / (sum(weight) OVER (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
    FROM sources),
  stopped AS (SELECT *, room / weight <= level AS stop FROM levelled),
  targets AS (
    SELECT source, source_size,
           CASE WHEN stop THEN room::DOUBLE
                ELSE weight * (SELECT arg_min(level, (room / weight, source IS NULL, source)) FROM stopped WHERE NOT stop) END AS target
    FROM stopped),
  rates AS (
    SELECT *, floor(rate) AS whole, rate - floor(rate) AS part
    FROM (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM targets)),
  drawn AS (
    SELECT s.*, r.source_size, r.target, r.whole, r.part, {draws}
    FROM sized s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source),
  tried AS (SELECT source, source_size, target, whole, {sums} FROM drawn GROUP BY ALL),
  chosen AS (SELECT source, list_min([{offs}]).seed AS seed FROM tried),
  taken AS (
    SELECT d.*, (whole + CASE WHEN CASE c.seed {used} END < part THEN 1 ELSE 0 END)::BIGINT AS copies
    FROM drawn d JOIN chosen c ON d.source IS NOT DISTINCT FROM c.source)
"""


@query("op3_mix_sources", f"WITH {mix_sql()} SELECT doc_id, size, source_size, target, copies * size AS taken FROM taken")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
