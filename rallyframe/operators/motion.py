"""Speeds, directions, swing phases and player identity. The definitions are this library's own."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rallyframe.operators.chunks import by_frame, frame_order, with_before
from rallyframe.operators.trajectory import in_order, step, with_point_before
from rallyframe.params import DEFAULT, Params

BY_FRAME = ["video_id", "frame_num"]


def ball_speed(points: DataFrame, videos: DataFrame) -> DataFrame:
    """Pixels a frame and a second between neighbouring points of the track; null for the first, and without fps."""
    dx, dy = F.col("x") - F.col("before.x"), F.col("y") - F.col("before.y")
    gap = F.col("frame_num") - F.col("before.frame_num")
    rows = with_point_before(points).select(*BY_FRAME, (F.sqrt((dx * dx + dy * dy).cast("double")) / gap).alias("px_per_frame"))
    fps = videos.select("video_id", F.when(F.col("fps") > 0, F.col("fps")).alias("fps"))
    return rows.join(fps, "video_id", "left").select(*BY_FRAME, "px_per_frame", (F.col("px_per_frame") * F.col("fps")).alias("px_per_second"))


def racket_motion(found: DataFrame) -> DataFrame:
    """Velocity and acceleration, a frame, of the racket's centre between frames where it was found."""
    rows = found.select(*BY_FRAME, ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"))
    rows = with_before(rows, F.struct("frame_num", "x", "y"), "b")
    gap = F.col("frame_num") - F.col("b.frame_num")
    rows = rows.select(*BY_FRAME, gap.alias("gap"), *[((F.col(c) - F.col(f"b.{c}")) / gap).alias(f"v{c}") for c in ("x", "y")])
    rows = with_before(rows, F.struct("vx", "vy"), "b")
    return rows.select(*BY_FRAME, "vx", "vy", *[((F.col(f"v{c}") - F.col(f"b.v{c}")) / F.col("gap")).alias(f"a{c}") for c in ("x", "y")])


def ball_direction(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """``incoming``, ``outgoing`` or ``level`` by the change of the ball's distance from the centre of the player's box."""
    centre = boxes.select(*BY_FRAME, ((F.col("x1") + F.col("x2")) / 2).alias("cx"), ((F.col("y1") + F.col("y2")) / 2).alias("cy"))
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    rows = points.join(centre, BY_FRAME).select(*BY_FRAME, F.sqrt(dx * dx + dy * dy).alias("distance"))
    rows = with_before(rows, F.struct("distance"), "b")
    change = F.col("distance") - F.col("b.distance")
    return rows.select(*BY_FRAME, "distance", F.when(change < 0, "incoming").when(change > 0, "outgoing").when(change == 0, "level").alias("direction"))


def swing_phase(states: DataFrame, follow: int = 5) -> DataFrame:
    """Phase of each frame from the racket's state: impact; follow-through up to ``follow`` frames after one; forward swing
    while the ball is near; preparation with a racket otherwise; idle without."""
    w = frame_order(states).rangeBetween(-follow, -1)
    after = F.max(F.when(F.col("state") == "IMPACT ZONE", F.col("frame_num"))).over(w).isNotNull()
    phase = F.when(F.col("state") == "IMPACT ZONE", "impact").when(after, "follow_through").when(F.col("state") == "APPROACHING BALL", "forward_swing").when(F.col("state").isNotNull(), "preparation").otherwise("idle")
    return states.select(*by_frame(states), phase.alias("phase"))


def every_nth(frames: DataFrame, n: int) -> DataFrame:
    return frames.filter(F.col("frame_num") % n == 0)


def wrist_path(poses: DataFrame, p: Params = DEFAULT, span: int = 10) -> DataFrame:
    """Length and net shift of the dominant wrist's path over the last ``span`` rows with a visible wrist."""
    side = "right" if p.dominant_hand == "right" else "left"
    rows = poses.select(*BY_FRAME, F.col(f"{side}_wrist_x").alias("x"), F.col(f"{side}_wrist_y").alias("y")).filter("x is not null")
    rows = rows.withColumn("step", step())
    w = in_order().rowsBetween(-(span - 1), 0)
    inner = in_order().rowsBetween(-(span - 2), 0)
    dx, dy = F.col("x") - F.first("x").over(w), F.col("y") - F.first("y").over(w)
    return rows.select(*BY_FRAME, F.coalesce(F.sum("step").over(inner), F.lit(0.0)).alias("path"), F.sqrt((dx * dx + dy * dy).cast("double")).alias("shift"))


def box_pairs(boxes: DataFrame) -> DataFrame:
    """(video_id, frame_num, person_idx, previous_idx, iou): each box with each box of the frame before that it overlaps, and their intersection over union."""
    before = boxes.select("video_id", (F.col("frame_num") + 1).alias("frame_num"), F.col("person_idx").alias("previous_idx"), *[F.col(c).alias(f"p{c}") for c in ("x1", "y1", "x2", "y2")])
    side = lambda a: F.greatest(F.lit(0), F.least(f"{a}2", f"p{a}2") - F.greatest(f"{a}1", f"p{a}1"))
    area = lambda q: (F.col(f"{q}x2") - F.col(f"{q}x1")) * (F.col(f"{q}y2") - F.col(f"{q}y1"))
    both = side("x") * side("y")
    return boxes.join(before, BY_FRAME).withColumn("iou", both / (area("") + area("p") - both)).filter("iou > 0").select(*BY_FRAME, "person_idx", "previous_idx", "iou")


def box_overlaps(boxes: DataFrame) -> DataFrame:
    """Best match of each person box with the boxes of the frame before; equal ones: the lower index."""
    best = F.max(F.struct("iou", (-F.col("previous_idx")).alias("low"))).alias("b")
    return box_pairs(boxes).groupBy(*BY_FRAME, "person_idx").agg(best).select(*BY_FRAME, "person_idx", (-F.col("b.low")).alias("previous_idx"), "b.iou")


def least_cost(cost: list[list[int]]) -> list[int]:
    """The column of each row in the matching of least cost; at least as many columns as rows. Shortest augmenting paths with potentials, cubic."""
    n, m = len(cost), len(cost[0])
    far = 1 + 2 * sum(max(map(abs, row)) for row in cost)
    u, v, row_of = [0] * (n + 1), [0] * (m + 1), [0] * (m + 1)
    for row in range(1, n + 1):
        row_of[0], at = row, 0
        reach, came, done = [far] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while row_of[at]:
            done[at], i = True, row_of[at]
            for j in range(1, m + 1):
                if not done[j] and (d := cost[i - 1][j - 1] - u[i] - v[j]) < reach[j]:
                    reach[j], came[j] = d, at
            step, nearest = min((reach[j], j) for j in range(1, m + 1) if not done[j])
            for j in range(m + 1):
                if done[j]:
                    u[row_of[j]] += step
                    v[j] -= step
                else:
                    reach[j] -= step
            at = nearest
        while at:
            row_of[at], at = row_of[came[at]], came[at]
    out = [0] * n
    for j in range(1, m + 1):
        if row_of[j]:
            out[row_of[j] - 1] = j - 1
    return out


def best_assignment(weight: dict[tuple[int, int], int]) -> dict[int, int]:
    """Pairs of a bipartite graph, each side used once, of greatest total weight.

    Of equal ones that where the lowest left one has the lowest right one (being alone comes last), then the next left one, and so on.
    """
    left, right = sorted({a for a, _ in weight}), sorted({b for _, b in weight})
    n, m = len(left), len(right)
    base = m + 1
    cost = [[-weight.get((a, b), 0) * base**n + (j if (a, b) in weight else m) * base ** (n - 1 - i) for j, b in enumerate([*right, *[None] * n])] for i, a in enumerate(left)]
    chosen = {left[i]: right[j] for i, j in enumerate(least_cost(cost)) if j < m}
    return {a: b for a, b in chosen.items() if (a, b) in weight}


def box_links(boxes: DataFrame, least: float = 0.3) -> DataFrame:
    """(video_id, frame_num, person_idx, previous_idx, iou): boxes linked with those of the frame before so that their overlaps of ``least`` or more add up to the most."""
    pairs = box_pairs(boxes).filter(F.col("iou") >= least)
    per = pairs.groupBy(*BY_FRAME).agg(F.collect_list(F.struct("person_idx", "previous_idx", "iou")).alias("pairs"))  # bounded by a frame's people
    kind = dict(boxes.dtypes)["person_idx"]

    def assign(batches):
        for b in batches:
            rows = []
            for v, f, each in zip(*(b[c].to_pylist() for c in (*BY_FRAME, "pairs")), strict=True):
                iou = {(x["person_idx"], x["previous_idx"]): x["iou"] for x in each}
                rows += [(v, f, a, q, iou[a, q]) for a, q in best_assignment({k: int(x * 10**9) for k, x in iou.items()}).items()]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            types = (pa.int64(), pa.int32(), b["pairs"].type.value_type.field("person_idx").type, b["pairs"].type.value_type.field("person_idx").type, pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[*BY_FRAME, "person_idx", "previous_idx", "iou"])

    return per.mapInArrow(assign, f"video_id long, frame_num int, person_idx {kind}, previous_idx {kind}, iou double")


def player_ids(boxes: DataFrame, least: float = 0.3) -> DataFrame:
    """Chains of linked boxes (``box_links``) get one player_id.

    Windows number the boxes that start a chain, in order of frame and index. The numbers then go along the chains
    in segments that start where no box is linked with the frame before, dealt out apart from each other.
    """
    links = box_links(boxes, least)
    rows = boxes.select(*BY_FRAME, "person_idx").join(links, [*BY_FRAME, "person_idx"], "left").withColumn("starts", F.col("previous_idx").isNull())
    order = in_order().orderBy("frame_num", "person_idx").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("new_id", F.when(F.col("starts"), F.sum(F.col("starts").cast("int")).over(order) - 1))
    linked = F.max(~F.col("starts")).over(Window.partitionBy(*BY_FRAME))
    rows = rows.withColumn("linked", linked).withColumn("segment", F.sum((~F.col("linked")).cast("int")).over(in_order()))
    dealt = rows.select(*BY_FRAME, "person_idx", "previous_idx", "new_id", "segment").repartition("video_id", "segment").sortWithinPartitions("video_id", "segment", "frame_num")

    def follow(batches):
        last, ids, at = {}, {}, None
        for b in batches:
            got = []
            for v, f, person, previous, new in zip(*(b[c].to_pylist() for c in (*BY_FRAME, "person_idx", "previous_idx", "new_id")), strict=True):
                if (v, f) != at:
                    last, ids, at = ids, {}, (v, f)
                got.append(last[previous] if new is None else new)
                ids[person] = got[-1]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in (*BY_FRAME, "person_idx")), pa.array(got, pa.int32())], names=[*BY_FRAME, "person_idx", "player_id"])

    return dealt.mapInArrow(follow, "video_id long, frame_num int, person_idx int, player_id int")
