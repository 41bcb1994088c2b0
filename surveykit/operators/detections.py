"""From raw proposals to accepted detection boxes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from surveykit.functions.boxes import box_iou, clip_box, orient_back, side, warp_box_back
from surveykit.functions.text import canonical_label
from surveykit.operators.components import connected_components
from surveykit.operators.spatial import home_cell, listed, overlap_pairs, probe_cells
from surveykit.session import discard, settle

FRAME = ("run_id", "stamp_ns")


def piecewise(t: Column, segments: Sequence[tuple[float, float]]) -> Column:
    """Value of the last segment that has started; null before the first."""
    out = F.lit(None).cast("double")
    for start, value in sorted(segments):
        out = F.when(t >= start, F.lit(float(value))).otherwise(out)
    return out


def seeded_cap(df: DataFrame, keys: Sequence[str], ident: Sequence[str], limit: int, seed: int) -> DataFrame:
    """At most ``limit`` rows per key, the first in the order of the MD5 of seed and identity, ``seed|a|b``.

    A first cut runs per salt, so a hot key is thinned in parallel, and the exact cut sees 64 x ``limit`` rows at most.
    """
    salted = df.withColumn("_h", F.md5(F.concat_ws("|", F.lit(seed), *ident))).withColumn("_s", F.pmod(F.xxhash64("_h"), F.lit(64)))
    order = [F.col("_h"), *[F.col(c) for c in ident]]
    first = salted.withColumn("_r", F.row_number().over(W.partitionBy(*keys, "_s").orderBy(*order))).where(F.col("_r") <= limit)
    last = first.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= limit)
    return last.drop("_h", "_s", "_r")


# ---------------------------------------------------------------- suppression


def nms(boxes: DataFrame, keys: Sequence[str] = FRAME, iou: float = 0.50) -> DataFrame:
    """Greedy same-label suppression; a box stays when its overlap with every kept box is <= ``iou``.

    A box that ranks first among everything it could overlap is final. Final boxes remove what they
    suppress, and the rest goes to the next round. Nothing is paired but boxes with winners, and no
    row or task holds a frame.
    """
    keys = [*keys, "label"]
    rank = F.struct((-F.col("score")).alias("o"), F.col("seq").alias("q"))
    flat = boxes.where((F.col("sx") <= 0) | (F.col("sy") <= 0))
    cell = [*keys, "_g"]
    left = settle(boxes.where((F.col("sx") > 0) & (F.col("sy") > 0)))
    kept = flat
    while not left.isEmpty():
        probes = left.select(*keys, "seq", "cx", "cy", "sx", "sy", rank.alias("_rank"), F.explode(probe_cells(iou)).alias("_g"))
        homes = left.withColumn("_g", home_cell()).withColumn("_rank", rank)
        tops = homes.groupBy(*cell).agg(F.min("_rank").alias("_top"))
        best = listed(probes).join(tops, cell).groupBy(*keys, "seq").agg(F.min("_top").alias("_top"))
        won = settle(homes.join(best, [*keys, "seq"]).where(F.col("_rank") == F.col("_top")).drop("_top", "_rank"))
        lead = won.select(*cell, *[F.col(c).alias(f"w_{c}") for c in ("cx", "cy", "sx", "sy")])
        over = box_iou(side(), side("w_")) > iou
        gone = listed(probes).join(lead, cell).where(over).select(*keys, "seq").distinct()
        gone = gone.unionByName(won.select(*keys, "seq")).distinct()
        kept = kept.unionByName(won.drop("_g").select(*kept.columns))
        before, left = left, settle(left.join(gone, [*keys, "seq"], "left_anti"))
        discard(before)
    return kept.select(*boxes.columns)


def ambiguity(boxes: DataFrame, keys: Sequence[str] = FRAME, iou: float = 0.80, margin: float = 0.10) -> DataFrame:
    """Add ``verdict``: kept or rejected, for boxes that compete as one proposal under several labels.

    Boxes that overlap across labels form groups. With a public and a distractor label in the group the
    best public box wins unless the distractor leads by ``margin``. Otherwise the best label must lead
    the second by ``margin``, or the whole group is rejected. Equal scores go to the smaller label.
    """
    keys = list(keys)
    edges = overlap_pairs(boxes, keys, iou, cross_label=True)
    groups = connected_components(edges, keys).select(*keys, F.col("id").alias("seq"), "root")
    member = boxes.select(*keys, "seq", "label", "score").join(groups, [*keys, "seq"])
    per_label = member.groupBy(*keys, "root", "label").agg(
        F.min(F.struct((-F.col("score")).alias("o"), F.col("seq"))).alias("b")
    )
    entry = F.struct(F.col("b.o").alias("o"), F.col("label"), F.col("b.seq").alias("seq"))
    hidden = F.startswith(F.col("label"), F.lit("_"))
    # one entry per label, and the label table is a fixed short list
    best = per_label.groupBy(*keys, "root").agg(
        F.array_sort(F.collect_list(entry)).alias("all"),
        F.min(F.when(~hidden, entry)).alias("pub"),
        F.min(F.when(hidden, entry)).alias("dis"),
    )
    first, second = F.element_at("all", 1), F.try_element_at("all", F.lit(2))
    duel = F.when((-F.col("dis.o")) - (-F.col("pub.o")) >= margin, F.col("dis.seq")).otherwise(F.col("pub.seq"))
    clear = F.when((-first["o"]) - (-second["o"]) >= margin, first["seq"])
    winner = F.when(F.col("pub").isNotNull() & F.col("dis").isNotNull(), duel).otherwise(clear)
    settled = best.select(*keys, "root", winner.alias("_w"))
    fate = groups.join(settled, [*keys, "root"]).select(
        *keys, "seq", F.when(F.col("seq") == F.col("_w"), "kept").otherwise("rejected").alias("verdict")
    )
    return boxes.join(fate, [*keys, "seq"], "left").withColumn("verdict", F.coalesce("verdict", F.lit("kept")))


# ---------------------------------------------------------------- gates


def detection_reason(score_min: float, exclude: Sequence[str], structure: Sequence[str], min_structure_h: float) -> Column:
    """Why a box is not eligible, else ``ok``."""
    label = F.col("label")
    low = F.lit(min_structure_h > 0) & label.isin(*structure) & (F.col("sy") < min_structure_h)
    return (
        F.when(F.col("score") < score_min, "score")
        .when(label.isin(*exclude) | (label == "BACKGROUND"), "excluded")
        .when(low, "bbox_h")
        .otherwise("ok")
    )


def door_shape_ok(min_h: float, min_aspect: float) -> Column:
    """Doors must be tall enough; the aspect counts only for boxes that touch no border."""
    x1, x2 = F.col("cx") - F.col("sx") / 2, F.col("cx") + F.col("sx") / 2
    y1, y2 = F.col("cy") - F.col("sy") / 2, F.col("cy") + F.col("sy") / 2
    touches = (x1 <= 1.0) | (y1 <= 1.0) | (x2 >= F.col("w") - 1.0) | (y2 >= F.col("h") - 1.0)
    short = F.lit(min_h > 0) & (F.col("sy") < min_h)
    thin = F.lit(min_aspect > 0) & ~touches & (F.col("sy") < F.col("sx") * min_aspect)
    return (F.col("label") != "door") | ~(short | thin)


def drop_distractors(boxes: DataFrame, out_labels: Sequence[str], emit: bool) -> DataFrame:
    """Remove distractor labels, or publish them without the underscore (never ``_wall``)."""
    hidden = F.startswith(F.col("label"), F.lit("_"))
    keep = ~hidden | (F.lit(emit) & (F.col("label") != "_wall"))
    named = boxes.where(keep).withColumn("label", F.regexp_replace("label", "^_", ""))
    index = F.array_position(F.array(*[F.lit(x) for x in out_labels]), F.col("label")) - 1
    return named.withColumn("cls", index.cast("int"))


def blur_gate(frames: DataFrame, dets: str, minimum: float) -> DataFrame:
    """Frames below the sharpness floor stay, without boxes, and are marked."""
    blurred = F.col("sharpness") < minimum
    return frames.withColumn("skipped_blur", blurred).withColumn(
        dets, F.when(blurred, F.slice(dets, 1, 0)).otherwise(F.col(dets))
    )


def row_violation(classes: Sequence[str] | None = None) -> Column:
    """First broken rule of a stored detection row, or null."""
    from surveykit.functions.geometry import is_finite

    nums = ["score", "cx", "cy", "sx", "sy"]
    finite = F.lit(True)
    for n in nums:
        finite = finite & is_finite(F.col(n))
    eps = 1e-6  # fixed value: border slack in pixels
    outside = (
        (F.col("cx") - F.col("sx") / 2 < -eps)
        | (F.col("cy") - F.col("sy") / 2 < -eps)
        | (F.col("cx") + F.col("sx") / 2 > F.col("w") + eps)
        | (F.col("cy") + F.col("sy") / 2 > F.col("h") + eps)
    )
    out = (
        F.when(~finite, "nonfinite")
        .when((F.col("score") < 0) | (F.col("score") > 1) | (F.col("sx") <= 0) | (F.col("sy") <= 0), "score_or_size")
        .when(outside, "outside_image")
    )
    if classes is not None:
        names = F.array(*[F.lit(c) for c in classes])
        out = out.when((F.col("cls") < 0) | (F.col("cls") >= len(classes)) | F.col("cls").isNull(), "class_id")
        out = out.when(F.try_element_at(names, F.col("cls") + 1) != F.col("label"), "class_label")
    return out


def class_counts(boxes: DataFrame, runs: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Boxes per class of the table, with zero rows, and whether the run has every class."""
    want = runs.select("run_id").distinct().select(
        "run_id", F.explode(F.array(*[F.lit(c) for c in classes])).alias("label")
    )
    got = boxes.groupBy("run_id", "label").agg(F.count("*").alias("n"))
    full = want.join(got, ["run_id", "label"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    per_run = W.partitionBy("run_id")  # one row per class of a fixed table
    return full.withColumn("complete", F.min("n").over(per_run) > 0)


def reject_ledger(rows: DataFrame, keys: Sequence[str], reason: str, reasons: Sequence[str]) -> DataFrame:
    """One column per reason with its count, plus the total; columns are fixed, so no pivot scan."""
    return rows.groupBy(*keys).agg(
        *[F.count_if(F.col(reason) == x).alias(x) for x in reasons], F.count("*").alias("total")
    )


# ---------------------------------------------------------------- the chain


def postprocess(
    proposals: DataFrame,
    table: Sequence[tuple[str, Sequence[str]]],
    pitch: Sequence[tuple[float, float]] = (),
    orient: str = "none",
    emit_distractors: bool = False,
    door_min_h: float = 0.0,
    door_min_aspect: float = 0.0,
) -> DataFrame:
    """Proposals (text_label, score, x1..y2, w, h, intrinsics) to accepted boxes with class ids."""
    p = proposals.withColumn("label", canonical_label(F.col("text_label"), table)).where("label is not null")
    corners = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    if pitch:
        deg = piecewise(F.col("t_rel"), pitch)
        back = warp_box_back(*corners, F.col("fx"), F.col("fy"), F.col("cx0"), F.col("cy0"), deg)
        corners = [F.when(deg.isNull() | (deg == 0), c).otherwise(b) for c, b in zip(corners, back)]
    corners = orient_back(*corners, F.col("w"), F.col("h"), F.lit(orient))
    cut = clip_box(*corners, F.col("w"), F.col("h"))
    boxes = p.select(
        *FRAME, "seq", "label", F.round("score", 4).alias("score"), "w", "h", *[c.alias(n) for n, c in cut.items()]
    ).where("keep").drop("keep")
    clear = ambiguity(nms(boxes)).where("verdict = 'kept'").drop("verdict")
    hidden = [name for name, _ in table if name.startswith("_")]
    public = [name for name, _ in table if not name.startswith("_")]
    out_labels = public + [n[1:] for n in hidden if emit_distractors and n != "_wall"]
    named = drop_distractors(clear, out_labels, emit_distractors)
    return named.where(door_shape_ok(door_min_h, door_min_aspect))
