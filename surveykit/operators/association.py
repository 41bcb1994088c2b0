"""Online association of sightings with tracks: nearest median first, exact over any number of tasks.

The rule is sequential, but a sighting only meets tracks near it. The plane is cut into tiles, and a tile decides its own
sightings. All tiles are folded side by side, first as if nothing lay beyond their borders. Then tracks that reach into a
tile from outside hand it their members with what was decided about them, and tiles whose visitors have changed are
folded again, until none has. Then every decision was taken on the tracks as they were: the first one in time that
differed from the plain loop would have had all earlier ones right, so the loop ends with the plain loop's result. Rounds
follow the longest chain of decisions across borders, not the number of rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from surveykit.functions.geometry import is_finite
from surveykit.session import discard, settle

# fixed values: association radii by object size (m)
SMALL_LABELS = ["cup", "bottle", "book", "mouse", "remote", "cell phone", "keyboard", "vase", "clock", "scissors", "bowl", "wine glass"]
BIG_LABELS = ["couch", "bed", "refrigerator", "dining table", "table", "tv", "desk", "toilet", "door"]
RADIUS_SMALL, RADIUS_BIG, RADIUS_DEFAULT = 0.35, 0.9, 0.5
#: side of a tile in radii; tiles are centred, so a small map around the origin is one tile
TILE = 24.0
ROWS = 8192
_ORDER = ["stamp_ns", "seq", "copy"]
_FOUND = ["found_ns", "found_seq", "found_copy"]


def radius_of(label: Column) -> Column:
    return (
        F.when(label.isin(*SMALL_LABELS), RADIUS_SMALL).when(label.isin(*BIG_LABELS), RADIUS_BIG).otherwise(RADIUS_DEFAULT)
    )


class Middle:
    """Running median: the lower half in one heap, the upper half in another."""

    __slots__ = ("low", "high")

    def __init__(self) -> None:
        self.low: list[float] = []
        self.high: list[float] = []

    def add(self, v: float) -> None:
        heapq.heappush(self.high, -heapq.heappushpop(self.low, -v))
        if len(self.high) > len(self.low):
            heapq.heappush(self.low, -heapq.heappop(self.high))

    def value(self) -> float:
        return -self.low[0] if len(self.low) > len(self.high) else (-self.low[0] + self.high[0]) / 2.0


class Field:
    """Tracks of one tile, found through cells of the radius that their medians lie in."""

    def __init__(self, radius: float) -> None:
        self.radius = radius
        self.size = radius * (1 + 1e-9)
        self.tracks: dict[tuple, list] = {}
        self.cells: dict[tuple[int, int], set[tuple]] = {}

    def _cell(self, x: float, y: float) -> tuple[int, int]:
        return math.floor(x / self.size), math.floor(y / self.size)

    def nearest(self, x: float, y: float) -> tuple | None:
        """The track with the nearest median within the radius, the oldest of equally near ones."""
        gx, gy = self._cell(x, y)
        best = (math.inf, ())
        for a in (-1, 0, 1):
            for b in (-1, 0, 1):
                for name in self.cells.get((gx + a, gy + b), ()):
                    xs, ys, _, _ = self.tracks[name]
                    best = min(best, (math.hypot(xs.value() - x, ys.value() - y), name))
        return best[1] if best[0] <= self.radius else None

    def add(self, name: tuple, x: float, y: float, stamp: int) -> None:
        track = self.tracks.setdefault(name, [Middle(), Middle(), None, None])
        track[0].add(x)
        track[1].add(y)
        track[2] = stamp
        cell = self._cell(track[0].value(), track[1].value())
        if cell != track[3]:
            self.cells.get(track[3], set()).discard(name)
            self.cells.setdefault(cell, set()).add(name)
            track[3] = cell

    def observe(self, name: tuple, x: float, y: float, stamp: int) -> tuple | None:
        """The track that the sighting ``name`` joins or opens; null when that track already has the stamp."""
        if not (math.isfinite(x) and math.isfinite(y)):
            return name
        near = self.nearest(x, y)
        if near is not None and self.tracks[near][2] == stamp:
            return None
        self.add(near or name, x, y, stamp)
        return near or name


def _decide(rows: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Decisions of each tile's own rows; visitors' decisions are given."""
    group = [*keys, "gx", "gy"]
    width, columns = len(group), [*group, *_ORDER, "x", "y", "rad", "own", *_FOUND]
    rest = [n for n in names if n not in columns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, field = None, None
        for pdf in batches:
            got = []
            for row in pdf[columns].itertuples(index=False, name=None):
                if row[:width] != current:
                    current, field = row[:width], Field(row[width + 5])
                name, (x, y, _, own) = tuple(map(int, row[width : width + 3])), row[width + 3 : width + 7]
                if own:
                    got.append(field.observe(name, x, y, name[0]) or (None, None, None))
                else:
                    given = tuple(map(int, row[width + 7 :]))
                    field.add(given, x, y, name[0])
                    got.append(given)
            pdf[_FOUND] = pd.DataFrame(got, index=pdf.index, dtype="Int64")
            yield pdf.loc[pdf["own"], list(names)]

    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    ordered = rows.select(*columns, *rest).repartition(*group).sortWithinPartitions(*group, *_ORDER)
    return ordered.mapInPandas(run, ", ".join(f"`{n}` {types[n]}" for n in names))


def associate(observations: DataFrame, keys: Sequence[str] = ("run_id", "label"), tile: float = TILE) -> DataFrame:
    """Track of each sighting (``keys, stamp_ns, seq, cid, x, y``); sightings of a stamp that their track has are dropped.

    Sightings count in the order of (stamp, seq) per key; rows that repeat both are ordered by place. A sighting joins the
    track whose coordinate-wise median is nearest, within its label's radius, the oldest of equally near ones, or opens
    one. A track is named by the sighting that opened it: ``track`` is its seq, ``part`` its stamp as text (with a number
    if rows repeat). A sighting without a finite place is a track of its own.
    """
    keys = list(keys)
    tiles = [*keys, "gx", "gy"]
    x, y, size = F.col("x"), F.col("y"), F.col("rad") * tile
    copy = F.row_number().over(W.partitionBy(*keys, "stamp_ns", "seq").orderBy("x", "y", "cid"))
    at = lambda c: F.when(is_finite(x) & is_finite(y), F.floor(c / size + 0.5)).otherwise(0)
    rows = observations.select(*keys, F.col("stamp_ns").cast("bigint").alias("stamp_ns"), F.col("seq").cast("bigint").alias("seq"), "cid", x.cast("double").alias("x"), y.cast("double").alias("y"), radius_of(F.col("label")).alias("rad"))
    rows = rows.withColumn("copy", copy.cast("bigint")).withColumns({"gx": at(x), "gy": at(y)})
    nothing = {c: F.lit(None).cast("bigint") for c in _FOUND}
    names = [*tiles, *_ORDER, "cid", "x", "y", "rad", *_FOUND]
    own = F.lit(True).alias("own")
    decided = settle(_decide(rows.withColumns(nothing).select("*", own), keys, names))
    used = None
    while True:
        members = decided.where(F.col("found_ns").isNotNull() & is_finite(x) & is_finite(y))
        boxes = members.groupBy(*keys, *_FOUND).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.max("rad").alias("rad"))
        span = lambda a, b: F.sequence(F.floor((F.col(a) - F.col("rad")) / size + 0.5), F.floor((F.col(b) + F.col("rad")) / size + 0.5))
        boxes = boxes.withColumns({"cols": span("x0", "x1"), "rows": span("y0", "y1")}).where("size(cols) > 1 OR size(rows) > 1")
        reach = boxes.select(*keys, *_FOUND, F.explode("cols").alias("tx"), "rows").withColumn("ty", F.explode("rows")).drop("rows")
        visits = members.join(reach, [*keys, *_FOUND]).where("tx <> gx OR ty <> gy").drop("gx", "gy").withColumnsRenamed({"tx": "gx", "ty": "gy"})
        visits = settle(visits.join(decided.select(*tiles).distinct(), tiles, "left_semi").select(*names))
        mark = F.struct(F.count("*").alias("n"), F.sum(F.xxhash64(*_ORDER, *_FOUND).cast("decimal(38,0)")).alias("h"))
        now = visits.groupBy(*tiles).agg(mark.alias("now"))
        marks = settle(now.withColumn("before", F.lit(None).cast("struct<n:bigint,h:decimal(38,0)>")) if used is None else now.join(used.select(*tiles, F.col("now").alias("before")), tiles, "full"))
        todo = marks.where(~F.col("now").eqNullSafe(F.col("before"))).select(*tiles)
        if todo.isEmpty():
            break
        again = decided.join(todo, tiles, "left_semi").select(*names, own)
        fresh = _decide(again.unionByName(visits.join(todo, tiles, "left_semi").select(*names, F.lit(False).alias("own"))), keys, names)
        before, decided = decided, settle(decided.join(todo, tiles, "left_anti").unionByName(fresh))
        for old in (before, visits, *([used] if used is not None else [])):
            discard(old)
        used = marks
    part = F.concat(F.col("found_ns").cast("string"), F.when(F.col("found_copy") > 1, F.concat(F.lit("."), F.col("found_copy").cast("string"))).otherwise(""))
    return decided.where("found_ns IS NOT NULL").select(*keys, part.alias("part"), "stamp_ns", "seq", "cid", "x", "y", F.col("found_seq").alias("track"))
