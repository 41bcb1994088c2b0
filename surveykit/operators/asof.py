"""Joins on time stamps: exact, nearest, latest, interpolated, interval and one-to-one.

Nearest and as-of joins merge both sides into one ordered stream and look along it with the bucketed
scan, so cost is linear and no pair is built that the result does not hold.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from surveykit.functions.geometry import slerp_weights, turn_between, unit_quat
from surveykit.operators.folding import fold
from surveykit.operators.ordered import Step, Timeline, scan

_SIDE = "_side"


def _merge(left: DataFrame, right: DataFrame, keys: Sequence[str], stamp: str, seq: str, carry: Sequence[str]) -> DataFrame:
    """One stream of both sides; the right side sorts first among equal stamps."""
    payload = F.struct(F.col(stamp).alias("stamp"), *[F.col(c) for c in carry])
    r = right.select(*keys, F.col(stamp), F.lit(0).alias(_SIDE), F.col(seq).alias("_seq"), payload.alias("_r"))
    kept = F.struct(*[F.col(c) for c in left.columns])
    l = left.select(*keys, F.col(stamp), F.lit(1).alias(_SIDE), F.col(seq).alias("_seq"), kept.alias("_row"))
    return r.unionByName(l, allowMissingColumns=True)


def neighbours(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    carry: Sequence[str],
    width: int,
    stamp: str = "stamp_ns",
    left_seq: str = "seq",
    right_seq: str | None = None,
) -> DataFrame:
    """Left rows plus structs ``before`` (stamp <= mine) and ``after`` (stamp > mine) of the right side."""
    right = right if right_seq is None else right.withColumn(left_seq, F.col(right_seq))
    merged = _merge(left, right, keys, stamp, left_seq, carry)
    line = Timeline(tuple(keys), (stamp, _SIDE, "_seq"), width)
    seen = scan(merged, line, [Step("before", "last", F.col("_r")), Step("after", "next", F.col("_r"))])
    return seen.where(F.col(_SIDE) == 1).select("_row.*", "before", "after")


def nearest(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    carry: Sequence[str],
    tolerance: int,
    width: int,
    tie: str = "before",
    stamp: str = "stamp_ns",
    left_seq: str = "seq",
    right_seq: str | None = None,
) -> DataFrame:
    """Nearest right row within an inclusive tolerance as struct ``match`` (null when none).

    ``tie`` names the side that wins at equal distance.
    """
    both = neighbours(left, right, keys, carry, width, stamp, left_seq, right_seq)
    t = F.col(stamp)
    gap_b, gap_a = t - F.col("before.stamp"), F.col("after.stamp") - t
    take_after = (gap_a < gap_b) if tie == "before" else (gap_a <= gap_b)
    pick = F.when(
        F.col("before").isNull() | F.coalesce(take_after, F.lit(False)), F.col("after")
    ).otherwise(F.col("before"))
    gap = F.abs(t - pick["stamp"])
    return both.withColumn("match", F.when(gap <= tolerance, pick)).drop("before", "after")


def latest(left: DataFrame, right: DataFrame, keys: Sequence[str], carry: Sequence[str], max_age: int, width: int, stamp: str = "stamp_ns", left_seq: str = "seq", right_seq: str | None = None) -> DataFrame:
    """Newest right row at or before the left stamp, if not older than ``max_age``."""
    both = neighbours(left, right, keys, carry, width, stamp, left_seq, right_seq)
    fresh = F.col(stamp) - F.col("before.stamp") <= max_age
    return both.withColumn("match", F.when(fresh, F.col("before"))).drop("before", "after")


def mutual_nearest(
    left: DataFrame, right: DataFrame, keys: Sequence[str], slop: int, width: int
) -> DataFrame:
    """Pairs that are each other's nearest within ``slop``; output carries the left stamp."""
    a = nearest(left, right, keys, ["seq"], slop, width).where("match is not null")
    b = nearest(right, left, keys, ["seq"], slop, width).where("match is not null")
    fwd = a.select(*keys, F.col("seq").alias("left_seq"), "stamp_ns", F.col("match.seq").alias("right_seq"), F.col("match.stamp").alias("right_stamp_ns"))
    back = b.select(*keys, F.col("seq").alias("right_seq"), F.col("match.seq").alias("left_seq"))
    return fwd.join(back, [*keys, "left_seq", "right_seq"], "left_semi")


def _pair_oldest(gate: int):
    """Oldest-first pairing: a waiting message leaves when it is older than the gate."""

    def step(rows: list[tuple], state: list[float]) -> tuple[list[tuple], list[float]]:
        side = int(state[0]) if state else 0
        waiting = [int(s) for s in state[1:]]
        out, head = [], 0
        for t, which, _ in rows:
            while head < len(waiting) and t - waiting[head] > gate:
                head += 1
            if head < len(waiting) and which != side:
                mate = waiting[head]
                head += 1
                left, right = (t, mate) if which == 0 else (mate, t)
                out.append((left, right, abs(right - left)))
                continue
            if head >= len(waiting):
                waiting, head, side = [], 0, which
            waiting.append(t)
        rest = waiting[head:]
        return out, [float(side), *map(float, rest)] if rest else []

    return step


def gate_one_to_one(stamps: DataFrame, keys: Sequence[str], gate: int, width: int) -> DataFrame:
    """Monotonic one-to-one pairs of ``side`` 0 (left) and 1 (right) within a hard inclusive gate.

    Both queues are served oldest first, which is what two pointers over the sorted stamps do. The
    only memory is the waiting messages younger than the gate, so buckets are folded in parallel.
    Stamps travel relative to the smallest stamp of the run to stay exact as doubles.
    """
    keys = list(keys)
    base = stamps.groupBy(*keys).agg(F.min("stamp_ns").alias("_t0"))
    rel = stamps.join(base, keys).withColumn("stamp_ns", F.col("stamp_ns") - F.col("_t0"))
    line = Timeline(tuple(keys), ("stamp_ns", "side", "seq"), width)
    pairs = fold(rel, line, _pair_oldest(gate), ["left_ns bigint", "right_ns bigint", "abs_dt_ns bigint"])
    return pairs.join(base, keys).select(
        *keys,
        (F.col("left_ns") + F.col("_t0")).alias("left_ns"),
        (F.col("right_ns") + F.col("_t0")).alias("right_ns"),
        "abs_dt_ns",
    )


#: the streams of a synchronised set, by their number
SIDES4 = ("left", "right", "left_info", "right_info")


def span_sets(rows: Iterable[tuple[int, int, int]], held: list[list[tuple[int, int]]], slop: int) -> list[tuple]:
    """Sets that ``rows`` (stamp, side, seq, in order) complete; ``held`` are the waiting messages by side, changed here.

    A message makes a set with the newest waiting message of each other side, which is the set of smallest span that
    holds it, if that span is at most ``slop``. Messages of a set are used up; others wait.
    """
    sets = []
    for t, side, seq in rows:
        others = [held[k][-1] if held[k] else None for k in range(len(held)) if k != side]
        if all(o is not None and t - o[0] <= slop for o in others):
            used = [(t, seq) if k == side else held[k].pop() for k in range(len(held))]
            stamps = [u[0] for u in used]
            sets.append((used[0][0], *[u[1] for u in used], max(stamps) - min(stamps)))
            continue
        held[side].append((t, seq))
        if t - held[side][0][0] > slop:  # the oldest ones meet nobody any more
            held[side][:] = [h for h in held[side] if t - h[0] <= slop]
    return sets


def approx_sync(messages: DataFrame, keys: Sequence[str], slop: int, width: int) -> DataFrame:
    """Synchronised sets of four streams (``side`` 0 to 3: left, right and their infos): ``stamp_ns`` of the left
    message, the four ``seq``, and ``span_ns``, at most ``slop``.

    Messages count in the order of (stamp, side, seq), each is used once, and the message that completes a set decides
    it, see ``span_sets``. Its memory reaches ``slop`` back, so buckets are folded in parallel.
    """
    keys = list(keys)
    base = messages.groupBy(*keys).agg(F.min("stamp_ns").alias("_t0"))
    rel = messages.select(*keys, "stamp_ns", F.col("side").cast("int").alias("side"), "seq").join(base, keys).withColumn("stamp_ns", F.col("stamp_ns") - F.col("_t0"))

    def step(rows: list[tuple], state: list[float]) -> tuple[list[tuple], list[float]]:
        held: list[list[tuple[int, int]]] = [[] for _ in SIDES4]
        for at in range(0, len(state), 3):
            held[int(state[at])].append((int(state[at + 1]), int(state[at + 2])))
        sets = span_sets(rows, held, slop)
        newest = rows[-1][0] if rows else 0
        return sets, [float(v) for k, h in enumerate(held) for t, q in h if newest - t <= slop for v in (k, t, q)]

    line = Timeline(tuple(keys), ("stamp_ns", "side", "seq"), width)
    out = fold(rel, line, step, ["stamp_ns bigint", *[f"{s}_seq bigint" for s in SIDES4], "span_ns bigint"])
    return out.join(base, keys).select(*keys, (F.col("stamp_ns") + F.col("_t0")).alias("stamp_ns"), *[f"{s}_seq" for s in SIDES4], "span_ns")


def _sampler(step_ns: int):
    """Take a row when its time has come, then wait for one step."""

    def step(rows: list[tuple], state: list[float]) -> tuple[list[tuple], list[float]]:
        ready = state[0] if state else 0.0
        out = []
        for t, _, _, left, right in rows:
            if t >= ready:
                out.append((t, left, right))
                ready = float(t + step_ns)
        return out, [ready]

    return step


def latest_pair(stamps: DataFrame, keys: Sequence[str], tolerance: int, step_ns: int, width: int) -> DataFrame:
    """Newest left and newest right at each message if close enough, at most one sample per step."""
    keys = list(keys)
    line = Timeline(tuple(keys), ("stamp_ns", "side", "seq"), width)
    t = F.col("stamp_ns")
    base = stamps.groupBy(*keys).agg(F.min("stamp_ns").alias("_t0"))
    seen = scan(
        stamps.join(base, keys).withColumn("stamp_ns", t - F.col("_t0")),
        line,
        [
            Step("left_ns", "last", F.when(F.col("side") == 0, t)),
            Step("right_ns", "last", F.when(F.col("side") == 1, t)),
        ],
    ).where(F.abs(F.col("left_ns") - F.col("right_ns")) <= tolerance)
    out = fold(seen, line, _sampler(step_ns), ["stamp_ns bigint", "left_ns bigint", "right_ns bigint"], ["left_ns", "right_ns"])
    return out.join(base, keys).select(
        *keys, *[(F.col(c) + F.col("_t0")).alias(c) for c in ("stamp_ns", "left_ns", "right_ns")]
    )


TRANSFORM = ["tx", "ty", "tz", "qx", "qy", "qz", "qw"]


def tf_asof(
    stamps: DataFrame,
    tf: DataFrame,
    keys: Sequence[str],
    slip: int,
    width: int,
    left_seq: str = "seq",
    right_seq: str | None = None,
) -> DataFrame:
    """Transform at each stamp: interpolated inside the chain, newest edge within ``slip`` beyond it.

    ``tf_class`` is ``exact``, ``latest`` (bounded slip), ``stale`` (beyond the slip), ``startup``
    (no transform received yet) or ``missing`` (the run has none).
    """
    both = neighbours(stamps, tf, keys, TRANSFORM, width, left_seq=left_seq, right_seq=right_seq)
    t = F.col("stamp_ns")
    b, a = F.col("before"), F.col("after")
    inside = b.isNotNull() & (a.isNotNull() | (b["stamp"] == t))
    share = F.when(b["stamp"] == t, 0.0).otherwise(F.try_divide((t - b["stamp"]).cast("double"), (a["stamp"] - b["stamp"]).cast("double")))
    hold = b.isNotNull() & a.isNull() & (t - b["stamp"] <= slip)
    klass = (
        F.when(inside, "exact")
        .when(hold, "latest")
        .when(b.isNotNull(), "stale")
        .when(a.isNotNull(), "startup")
        .otherwise("missing")
    )
    usable = inside | hold
    keep = [c for c in both.columns if c not in ("before", "after")]
    end = {c: F.coalesce(a[c], b[c]) for c in TRANSFORM}
    flat = both.select(
        *keep,
        klass.alias("tf_class"),
        usable.alias("_use"),
        F.when(inside & a.isNotNull(), share).otherwise(0.0).alias("_t"),
        *[b[c].alias(f"_a_{c}") for c in TRANSFORM],
        *[F.when(inside, end[c]).otherwise(b[c]).alias(f"_b_{c}") for c in TRANSFORM],
    )
    # staged columns: each value is computed once instead of being inlined into the next
    q0 = [F.col(f"_a_{c}") for c in TRANSFORM[3:]]
    q1 = [F.col(f"_b_{c}") for c in TRANSFORM[3:]]
    theta, sign = turn_between(q0, q1)
    turn = flat.withColumns({"_theta": theta, "_sign": sign})
    k0, k1 = slerp_weights(F.col("_theta"), F.col("_t"))
    turn = turn.withColumns({"_k0": k0, "_k1": k1})
    mixed = {f"_q_{c}": x * F.col("_k0") + y * F.col("_k1") * F.col("_sign") for c, x, y in zip(TRANSFORM[3:], q0, q1)}
    turn = turn.withColumns(mixed)
    unit = unit_quat(*[F.col(f"_q_{c}") for c in TRANSFORM[3:]])
    shift = [F.col(f"_a_{c}") + (F.col(f"_b_{c}") - F.col(f"_a_{c}")) * F.col("_t") for c in TRANSFORM[:3]]
    return turn.select(
        *keep, "tf_class", *[F.when(F.col("_use"), v).alias(c) for c, v in zip(TRANSFORM, [*shift, *unit])]
    )
