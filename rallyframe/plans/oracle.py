"""DuckDB SQL for the queries of ``catalogue``: a chain of common tables and one select for each query."""

from __future__ import annotations

import re

from rallyframe.sources.schemas import KEYPOINT_NAMES

EVENTS = """ev AS (SELECT user_id AS v, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS f,
  event_id AS e, ts, event_type AS kind FROM events)"""
#: The longer videos, from lines.
LINES = """ev AS (SELECT v, f, e, TIMESTAMP '1970-01-01' + to_seconds(f) AS ts, (['view', 'click', 'purchase', 'signup', 'error'])[e % 5 + 1] AS kind
  FROM (SELECT l_suppkey AS v, l_orderkey * 7 + l_linenumber AS e, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 7 + l_linenumber) - 1 AS INTEGER) AS f FROM lineitem))"""
HEAD = """
ev AS (SELECT user_id AS v, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS f,
  event_id AS e, ts, event_type AS kind FROM events),
frames AS (SELECT v AS video_id, f AS frame_num, ts AS processed_at FROM ev),
videos AS (SELECT v AS video_id, '/videos/court' || (v % 7) || '/match_' || v ||
    (['.mp4', '.MP4', '.avi', '.txt', '.mkv'])[v % 5 + 1] AS path,
  1920 AS width, 1080 AS height, CAST(25 + v % 6 AS DOUBLE) AS fps, CAST(count(*) AS INTEGER) AS total_frames FROM ev GROUP BY v),
raw AS (SELECT v AS video_id, f AS frame_num, d.k AS det_idx, CAST(d.x AS INTEGER) AS x, CAST(d.y AS INTEGER) AS y, CAST(2 + (e + d.k) % 16 AS INTEGER) AS radius
  FROM (SELECT v, f, e, unnest([
    CASE WHEN kind NOT IN ('error', 'signup') THEN {'k': 0, 'x': 660 + (f * 17 + v * 5) % 740, 'y': 420 + (f * 11) % 540} END,
    CASE WHEN kind <> 'signup' THEN {'k': 1, 'x': 900 + v % 50 + e % 3, 'y': 600 + e % 2} END,
    CASE WHEN e % 3 = 0 THEN {'k': 2, 'x': 500 + (e * 37) % 1100, 'y': 300 + (e * 53) % 800} END]) AS d
    FROM ev WHERE f % 40 NOT BETWEEN 30 AND 37) WHERE d IS NOT NULL),
kp AS (SELECT v AS video_id, f AS frame_num, CAST(p AS INTEGER) AS person_idx, CAST(i AS INTEGER) AS kp_idx,
  900 + (e * (7 + 2 * i) + i * 31 + p * 137) % 200 AS x, 450 + i * 20 + (e * (3 + i) + p * 9) % 60 AS y,
  CAST(55 + (e * (2 * i + 3) + 7 * i + p * 41) % 100 AS DOUBLE) / CAST(154 AS DOUBLE) AS conf
  FROM (SELECT v, f, e, p, unnest(range(17)) AS i FROM (SELECT v, f, e, unnest(range(CASE WHEN e % 5 = 0 THEN 2 ELSE 1 END)) AS p FROM ev) WHERE p = 1 OR e % 11 <> 0)),
gate AS (SELECT video_id, frame_num, person_idx, kp_idx, conf,
  CASE WHEN conf IS NULL OR conf > 0.5 THEN CAST(x AS INTEGER) END AS x, CASE WHEN conf IS NULL OR conf > 0.5 THEN CAST(y AS INTEGER) END AS y FROM kp),
poses AS (SELECT video_id, frame_num, person_idx, @PIVOT FROM gate GROUP BY ALL),
pose AS (SELECT * FROM poses QUALIFY person_idx = min(person_idx) OVER (PARTITION BY video_id, frame_num)),
gate1 AS (SELECT * FROM gate QUALIFY person_idx = min(person_idx) OVER (PARTITION BY video_id, frame_num)),
inb AS (SELECT * FROM raw WHERE radius BETWEEN 3 AND 15 AND x BETWEEN 650 AND 1420 AND y BETWEEN 410 AND 980),
mov AS (SELECT video_id, frame_num, det_idx, x, y FROM inb b WHERE NOT EXISTS (SELECT 1 FROM inb q WHERE q.video_id = b.video_id
  AND q.frame_num = b.frame_num - 1 AND sqrt(CAST((q.x - b.x) * (q.x - b.x) + (q.y - b.y) * (q.y - b.y) AS DOUBLE)) < 8)),
first AS (SELECT video_id, frame_num, x, y FROM mov QUALIFY row_number() OVER (PARTITION BY video_id, frame_num ORDER BY det_idx) = 1),
rk AS (SELECT v AS video_id, f AS frame_num, CAST(r AS INTEGER) AS racket_idx, 38 AS class_id, CAST((e * 17 + r * 29) % 100 AS DOUBLE) / CAST(100 AS DOUBLE) AS conf,
  CAST(880 + (e * 19 + r * 83) % 200 AS INTEGER) AS x1, CAST(580 + (e * 23 + r * 41) % 150 AS INTEGER) AS y1,
  CAST(880 + (e * 19 + r * 83) % 200 + 30 + e % 50 AS INTEGER) AS x2, CAST(580 + (e * 23 + r * 41) % 150 + 40 + e % 60 AS INTEGER) AS y2
  FROM (SELECT v, f, e, unnest(range(e % 3)) AS r FROM ev WHERE e % 3 > 0 AND e % 7 <> 0) WHERE (e * 17 + r * 29) % 100 >= 40),
hand AS (SELECT video_id, frame_num, 0 AS h, left_wrist_x AS hx, left_wrist_y AS hy FROM pose UNION ALL
  SELECT video_id, frame_num, 1, right_wrist_x, right_wrist_y FROM pose),
near AS (SELECT rk.*, h, sqrt(power((x1 + x2) / 2.0 - hx, 2) + power((y1 + y2) / 2.0 - hy, 2)) AS dist FROM rk JOIN hand USING (video_id, frame_num) WHERE hx IS NOT NULL),
assoc AS (SELECT video_id, frame_num, x1, y1, x2, y2, conf AS confidence FROM near WHERE dist < (x2 - x1 + y2 - y1) * 0.75
  QUALIFY row_number() OVER (PARTITION BY video_id, frame_num ORDER BY dist, racket_idx, h) = 1),
carry AS (SELECT f.video_id, f.frame_num, a.frame_num IS NOT DISTINCT FROM f.frame_num AS found, a.x1, a.y1, a.x2, a.y2, a.confidence, a.frame_num AS last_seen_frame
  FROM frames f LEFT JOIN assoc a ON a.video_id = f.video_id AND a.frame_num BETWEEN f.frame_num - 5 AND f.frame_num
  QUALIFY row_number() OVER (PARTITION BY f.video_id, f.frame_num ORDER BY a.frame_num DESC) = 1),
rb AS (SELECT carry.*, b.x AS bx, b.y AS yb, greatest(x2 - x1, y2 - y1) / 2.0 + 10 AS r, (y1 + y2) / 2.0 AS cy,
  sqrt(power((x1 + x2) / 2.0 - b.x, 2) + power((y1 + y2) / 2.0 - b.y, 2)) AS dist FROM carry LEFT JOIN first b USING (video_id, frame_num)),
event AS (SELECT *, CASE WHEN x1 IS NULL THEN NULL
  WHEN bx IS NOT NULL AND dist < r AND cy > 432 AND cy < 756 AND yb > 432 AND yb < 756 THEN 'IMPACT ZONE'
  WHEN bx IS NOT NULL AND dist < 5 * r THEN 'APPROACHING BALL' WHEN bx IS NOT NULL THEN 'IDLE / OTHER'
  WHEN found THEN 'associated_to_player' END AS ev FROM rb),
state AS (SELECT c.video_id, c.frame_num, c.x1, c.y1, c.x2, c.y2, c.confidence, c.last_seen_frame,
  CASE WHEN c.x1 IS NOT NULL THEN e.ev END AS state FROM event c LEFT JOIN event e
  ON e.video_id = c.video_id AND e.frame_num BETWEEN c.frame_num - 5 AND c.frame_num AND e.ev IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY c.video_id, c.frame_num ORDER BY e.frame_num DESC) = 1),
ids AS (SELECT DISTINCT unnest([21, 37, 62, 87, -1, 99999]) AS frame_id),
times AS (SELECT ts, CASE ts WHEN '00:00:01' THEN 1 WHEN '00:02' THEN 2 WHEN '2' THEN 2 WHEN '' THEN 0 WHEN '16:04:13' THEN 57853 END AS seconds
  FROM (SELECT unnest(['00:00:01', '00:02', '2', '', '1:2:3:4', '16:04:13']) AS ts)),
named AS (SELECT *, regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^.]*$', '') AS video_name, total_frames / fps AS duration FROM videos),
byid AS (SELECT n.video_id, video_name, frame_num, 'id' AS source, CAST(frame_id AS VARCHAR) AS requested,
  video_name || '_frame_' || printf('%04d', frame_num) || '.png' AS file_name FROM named n CROSS JOIN ids JOIN frames f ON f.video_id = n.video_id AND f.frame_num = frame_id),
bytime AS (SELECT n.video_id, video_name, frame_num, 'time' AS source, ts AS requested,
  video_name || '_time_' || replace(ts, ':', '_') || '_frame_' || printf('%04d', frame_num) || '.png' AS file_name
  FROM named n CROSS JOIN times JOIN frames f ON f.video_id = n.video_id AND f.frame_num = CAST(floor(seconds * fps) AS INTEGER) WHERE seconds <= duration),
step AS (SELECT *, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy, frame_num - lag(frame_num) OVER w AS gap FROM first WINDOW w AS (PARTITION BY video_id ORDER BY frame_num)),
sd AS (SELECT *, sqrt(CAST(dx * dx + dy * dy AS DOUBLE)) AS d FROM step),
ch AS (SELECT *, CAST((row_number() OVER (PARTITION BY video_id ORDER BY frame_num) - 1) // 40 AS INTEGER) AS c FROM first),
cs AS (SELECT *, count(*) OVER (PARTITION BY video_id, c) AS n, CAST(row_number() OVER (PARTITION BY video_id, c ORDER BY frame_num) - 1 AS INTEGER) AS p,
  sqrt(CAST(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2) AS DOUBLE)) AS d FROM ch WINDOW w AS (PARTITION BY video_id, c ORDER BY frame_num)),
ob AS (SELECT *, coalesce(n >= 3 AND d > avg(d) OVER q + 3 * stddev_pop(d) OVER q, false) AS bad FROM cs WINDOW q AS (PARTITION BY video_id, c)),
box AS (SELECT video_id, frame_num, greatest(0, min(x) - 20) AS x1, greatest(0, min(y) - 20) AS y1, least(1920, max(x) + 20) AS x2, least(1080, max(y) + 20) AS y2
  FROM gate1 WHERE kp_idx >= 5 AND x IS NOT NULL GROUP BY ALL),
dir AS (SELECT video_id, frame_num, sqrt(power(x - (x1 + x2) / 2.0, 2) + power(y - (y1 + y2) / 2.0, 2)) AS distance FROM first JOIN box USING (video_id, frame_num))
""".replace("@PIVOT", ", ".join(f"max(CASE WHEN kp_idx = {i} THEN {c} END) AS {n}_{c}" for i, n in enumerate(KEYPOINT_NAMES) for c in "xy"))


def between(ux: str, uy: str, vx: str, vy: str, zero: str = "0.0") -> str:
    norm = f"(sqrt(CAST(({ux}) * ({ux}) + ({uy}) * ({uy}) AS DOUBLE)) * sqrt(CAST(({vx}) * ({vx}) + ({vy}) * ({vy}) AS DOUBLE)))"
    return f"CASE WHEN {norm} = 0 THEN {zero} WHEN {norm} > 0 THEN degrees(acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, CAST(({ux}) * ({vx}) + ({uy}) * ({vy}) AS DOUBLE) / {norm})))) END"


def angle(a: str, b: str, c: str) -> str:
    return between(f"{a}_x - {b}_x", f"{a}_y - {b}_y", f"{c}_x - {b}_x", f"{c}_y - {b}_y")


def r4(x: str, name: str) -> str:
    return f"round({x}, 4) AS {name}"


SHOULDERS = ("right_shoulder_x - left_shoulder_x", "right_shoulder_y - left_shoulder_y")
HIPS = ("right_hip_x - left_hip_x", "right_hip_y - left_hip_y")
ARMS = {s: angle(f"{s}_shoulder", f"{s}_elbow", f"{s}_wrist") for s in ("left", "right")}
KNEES = {s: angle(f"{s}_hip", f"{s}_knee", f"{s}_ankle") for s in ("left", "right")}
LABEL = """CASE WHEN left_wrist_x IS NULL OR right_wrist_x IS NULL OR left_shoulder_x IS NULL OR right_shoulder_x IS NULL OR left_elbow_x IS NULL OR right_elbow_x IS NULL
  THEN 'Incomplete Pose' WHEN sqrt(power(left_wrist_x - right_wrist_x, 2) + power(left_wrist_y - right_wrist_y, 2)) < 50
  AND left_wrist_x + right_wrist_x < left_shoulder_x + right_shoulder_x THEN 'Two-Handed Backhand'
  WHEN right_wrist_x < right_shoulder_x THEN 'Backhand' ELSE 'Forehand' END"""
METRICS = {
    "shoulder_turn": between(*SHOULDERS, "0", "1"),
    "non_dominant_arm_extension": ARMS["left"],
    "arm_extension": ARMS["right"],
    "stance_width": "sqrt(power(left_ankle_x - right_ankle_x, 2) + power(left_ankle_y - right_ankle_y, 2))",
    "left_knee_angle": KNEES["left"],
    "right_knee_angle": KNEES["right"],
    "hip_shoulder_separation": between(*HIPS, *SHOULDERS),
}
WORDS = {
    "contact_point_position": "CASE WHEN b.x IS NULL OR right_wrist_x IS NULL THEN NULL WHEN abs(b.x - right_wrist_x) < 50 THEN 'Front' WHEN b.x < right_wrist_x THEN 'Side' ELSE 'Late' END",
    "contact_height": "CASE WHEN b.x IS NULL OR right_wrist_x IS NULL THEN NULL WHEN b.y > right_wrist_y + 50 THEN 'Low' WHEN abs(b.y - right_wrist_y) <= 50 THEN 'Mid' ELSE 'High' END",
    "stance_type": "CASE WHEN left_ankle_x + right_ankle_x + left_hip_x + right_hip_x IS NULL THEN NULL WHEN abs((left_hip_x + right_hip_x) / 2.0 - (left_ankle_x + right_ankle_x) / 2.0) > 30 THEN 'Open' ELSE 'Neutral' END",
}
NUMBERS = ", ".join(r4(x, n) for n, x in METRICS.items())
TEXTS = ", ".join(f"{x} AS {n}" for n, x in WORDS.items())
POSE_BALL = "pose p LEFT JOIN first b ON b.video_id = p.video_id AND b.frame_num = p.frame_num"
FITS = {5: [[31, 9, -3, -5, 3], [9, 13, 12, 6, -5], [-3, 12, 17, 12, -3], [-5, 6, 12, 13, 9], [3, -5, -3, 9, 31]],
        7: [[32, 15, 3, -4, -6, -3, 5], [15, 12, 9, 6, 3, 0, -3], [3, 9, 12, 12, 9, 3, -6], [-4, 6, 12, 14, 12, 6, -4], [-6, 3, 9, 12, 12, 9, 3], [-3, 0, 3, 6, 9, 12, 15], [5, -3, -6, -4, 3, 15, 32]]}


def fitted(c: str) -> str:
    one = lambda w, d: f"list_dot_product(CAST(({FITS[w]})[p - s{w} + 1] AS DOUBLE[]), CAST(l{c}[s{w} + 1 : s{w} + {w}] AS DOUBLE[])) / {d}"
    return f"round(CASE WHEN n >= 9 THEN {one(7, 42)} WHEN n >= 7 THEN {one(5, 35)} ELSE CAST({c} AS DOUBLE) END, 4) AS {c}"


LONG = [("preparation", "shoulder_turn"), ("preparation", "non_dominant_arm_extension"), ("swing_motion", "contact_point_position"), ("swing_motion", "contact_height"), ("swing_motion", "arm_extension"), ("footwork", "stance_width"), ("footwork", "stance_type"), ("footwork", "left_knee_angle"), ("footwork", "right_knee_angle"), ("power_indicators", "hip_shoulder_separation")]
ASSEMBLED = f"""SELECT f.video_id, f.frame_num, coalesce({LABEL.replace("CASE WHEN", "CASE WHEN p.video_id IS NULL THEN 'No Swing' WHEN", 1)}, 'No Swing') AS swing_type, {NUMBERS}, {TEXTS},
  b.x AS ball_x, b.y AS ball_y, s.x1 AS racket_x1, s.y1 AS racket_y1, s.x2 AS racket_x2, s.y2 AS racket_y2, s.state
  FROM frames f LEFT JOIN pose p ON p.video_id = f.video_id AND p.frame_num = f.frame_num LEFT JOIN first b0 ON b0.video_id = f.video_id AND b0.frame_num = f.frame_num
  LEFT JOIN first b ON b.video_id = f.video_id AND b.frame_num = f.frame_num AND p.video_id IS NOT NULL
  JOIN state s ON s.video_id = f.video_id AND s.frame_num = f.frame_num""".replace("b.x AS ball_x, b.y AS ball_y", "b0.x AS ball_x, b0.y AS ball_y")


BALL = "STRUCT(i INTEGER, x INTEGER, y INTEGER)"


def apart(a: str, b: str) -> str:
    return f"sqrt(CAST(({a}.x - {b}.x) * ({a}.x - {b}.x) + ({a}.y - {b}.y) * ({a}.y - {b}.y) AS DOUBLE))"


#: Nearest free ball of a candidate, under half the match distance; the earlier one of equal ones.
TAKEN = f"list_sort(list_transform(list_filter(acc.free, lambda b: {apart('b', 'e.c')} < 12.5), lambda b: {{'d': {apart('b', 'e.c')}, 'i': b.i, 'x': b.x, 'y': b.y}}))[1]"
NEAREST = f"list_sort(list_transform(possible, lambda b, k: {{'d': {apart('b', 'last')}, 'k': k}}))[1]"
#: The tracker as one row a frame after another. With the shipped parameters no ball can stand still long enough to be fixed, so candidates are last frame's unmatched balls.
TRACK = f"""
mb AS (SELECT f.video_id, f.frame_num, coalesce(list({{'i': m.det_idx, 'x': m.x, 'y': m.y}} ORDER BY m.det_idx) FILTER (m.x IS NOT NULL), [])::{BALL}[] AS balls
  FROM frames f LEFT JOIN mov m ON m.video_id = f.video_id AND m.frame_num = f.frame_num GROUP BY ALL),
walk AS (
  SELECT video_id, -1 AS frame_num, []::{BALL}[] AS cands, NULL::{BALL} AS last, 0 AS lost, NULL::{BALL} AS ball FROM videos
  UNION ALL
  SELECT video_id, frame_num, r.free, CASE WHEN ball IS NOT NULL THEN ball WHEN lost + 1 > 5 THEN NULL ELSE last END, CASE WHEN ball IS NULL THEN lost + 1 ELSE 0 END, ball
  FROM (SELECT *, CASE WHEN len(possible) > 1 AND last IS NOT NULL AND {NEAREST}.d < 25 THEN possible[{NEAREST}.k] ELSE possible[1] END AS ball
    FROM (SELECT *, list_concat(r.got, r.free) AS possible
      FROM (SELECT w.video_id, m.frame_num, w.last, w.lost,
          list_reduce(list_transform(w.cands, lambda c: {{'c': c, 'free': []::{BALL}[], 'got': []::{BALL}[]}}),
            lambda acc, e: {{'c': e.c, 'free': list_filter(acc.free, lambda b: {TAKEN} IS NULL OR b.i <> {TAKEN}.i),
              'got': CASE WHEN {TAKEN} IS NULL THEN acc.got ELSE list_append(acc.got, {{'i': {TAKEN}.i, 'x': {TAKEN}.x, 'y': {TAKEN}.y}}) END}},
            {{'c': NULL::{BALL}, 'free': m.balls, 'got': []::{BALL}[]}}) AS r
        FROM walk w JOIN mb m ON m.video_id = w.video_id AND m.frame_num = w.frame_num + 1)))),
act AS (SELECT video_id, CAST(frame_num AS INTEGER) AS frame_num, ball.x AS x, ball.y AS y FROM walk WHERE ball IS NOT NULL)"""


#: Racket states by the tracked ball in place of the first moving one.
TRACKED_STATE = ", ".join(f"t{x.strip()}" for x in (HEAD[HEAD.index("rb AS ") : HEAD.index("event AS ")], HEAD[HEAD.index("event AS ") : HEAD.index("state AS ")], HEAD[HEAD.index("state AS ") : HEAD.index("ids AS ")])).replace("),, ", "), ").rstrip().rstrip(",")
TRACKED_STATE = TRACKED_STATE.replace("JOIN first b", "JOIN act b").replace("FROM rb", "FROM trb").replace("FROM event c", "FROM tevent c").replace("JOIN event e", "JOIN tevent e").replace(",,", ",")
TRACKED = f"WITH {TRACKED_STATE} " + ASSEMBLED.replace("JOIN first b", "JOIN act b").replace("JOIN state s", "JOIN tstate s")

PAIRS = """people AS (SELECT video_id, frame_num, person_idx, greatest(0, min(x) - 20) AS x1, greatest(0, min(y) - 20) AS y1, least(1920, max(x) + 20) AS x2, least(1080, max(y) + 20) AS y2
        FROM gate WHERE kp_idx >= 5 AND x IS NOT NULL GROUP BY ALL),
      inner_area AS (SELECT b.video_id, b.frame_num, b.person_idx, q.person_idx AS previous_idx, (b.x2 - b.x1) * (b.y2 - b.y1) AS ab, (q.x2 - q.x1) * (q.y2 - q.y1) AS aq,
        greatest(0, least(b.x2, q.x2) - greatest(b.x1, q.x1)) * greatest(0, least(b.y2, q.y2) - greatest(b.y1, q.y1)) AS n FROM people b JOIN people q ON q.video_id = b.video_id AND q.frame_num = b.frame_num - 1),
      pr AS (SELECT *, n / CAST(ab + aq - n AS DOUBLE) AS iou FROM inner_area WHERE n > 0)"""

SELECT = {
    "pose_gate": "SELECT video_id, frame_num, person_idx, kp_idx, x, y, round(conf, 4) AS conf FROM gate",
    "pose_wide": "SELECT * FROM poses",
    "primary_person": "SELECT video_id, frame_num, min(person_idx) AS person_idx FROM pose GROUP BY ALL",
    "swing_label": f"SELECT f.video_id, f.frame_num, CASE WHEN p.video_id IS NULL THEN 'No Swing' ELSE {LABEL} END AS swing_type FROM frames f LEFT JOIN pose p ON p.video_id = f.video_id AND p.frame_num = f.frame_num",
    "elbow_angles": f"SELECT video_id, frame_num, {r4(ARMS['left'], 'left_elbow_angle')}, {r4(ARMS['right'], 'right_elbow_angle')} FROM pose",
    "torso_angle": f"""SELECT video_id, frame_num, {r4(between(*SHOULDERS, "0", "1", "NULL"), 'torso_angle')}, CAST((left_shoulder_x + right_shoulder_x) // 2 AS INTEGER) AS anchor_x,
      CAST((left_shoulder_y + right_shoulder_y) // 2 - 20 AS INTEGER) AS anchor_y FROM pose WHERE left_shoulder_x IS NOT NULL AND right_shoulder_x IS NOT NULL""",
    "swing_metrics": f"SELECT p.video_id, p.frame_num, {LABEL} AS swing_type, {NUMBERS}, {TEXTS} FROM {POSE_BALL}",
    "metrics_long": f"WITH m AS (SELECT p.video_id, p.frame_num, {', '.join(f'{x} AS {n}' for n, x in METRICS.items())}, {TEXTS} FROM {POSE_BALL}) "
    + " UNION ALL ".join(f"SELECT video_id, frame_num, '{c}' AS category, '{m.replace('_', ' ').title()}' AS metric, {m if m in WORDS else f'''printf('%.1f', {m})'''} AS value FROM m WHERE {m} IS NOT NULL" for c, m in LONG),
    "player_box": "SELECT * FROM box",
    "ball_rescale": "SELECT video_id, frame_num, det_idx, CAST(x % 640 * 3 AS INTEGER) AS x, CAST(y % 360 * 3 AS INTEGER) AS y, CAST(radius * 3 AS INTEGER) AS radius FROM raw",
    "ball_in_bounds": "SELECT * FROM inb",
    "ball_moving": "SELECT * FROM mov",
    "first_ball": "SELECT video_id, frame_num, x, y FROM raw QUALIFY row_number() OVER (PARTITION BY video_id, frame_num ORDER BY det_idx) = 1",
    "racket_filter": "SELECT video_id, frame_num, racket_idx, class_id, round(conf, 4) AS conf, x1, y1, x2, y2 FROM rk",
    "racket_assoc": "SELECT video_id, frame_num, x1, y1, x2, y2, round(confidence, 4) AS confidence FROM assoc",
    "racket_carry": "SELECT video_id, frame_num, found, x1, y1, x2, y2, round(confidence, 4) AS confidence, last_seen_frame FROM carry",
    "racket_state": "SELECT video_id, frame_num, x1, y1, x2, y2, round(confidence, 4) AS confidence, last_seen_frame, state FROM state",
    "lost_counter": """SELECT f.video_id, f.frame_num, f.frame_num - coalesce(max(m.frame_num), -1) AS lost_frames, f.frame_num - coalesce(max(m.frame_num), -1) > 5 AS is_lost
      FROM frames f LEFT JOIN first m ON m.video_id = f.video_id AND m.frame_num <= f.frame_num GROUP BY f.video_id, f.frame_num""",
    "track_segments": "SELECT video_id, frame_num, CAST(sum(CASE WHEN gap > 6 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY frame_num) AS INTEGER) AS segment_id FROM step",
    "active_ball": "SELECT * FROM act",
    "live_tracking": "SELECT f.video_id, f.frame_num, a.x, a.y, false AS late FROM frames f LEFT JOIN act a ON a.video_id = f.video_id AND a.frame_num = f.frame_num",
    "tracked_frames": TRACKED,
    "step_distance": "SELECT video_id, frame_num, round(d, 4) AS step FROM sd",
    "step_statistics": "SELECT video_id, count(d) AS n_steps, round(avg(d), 4) AS mean_step, round(stddev_pop(d), 4) AS std_step FROM sd GROUP BY video_id",
    "outlier_replace": """SELECT video_id, frame_num, last_value(CASE WHEN NOT bad THEN x END IGNORE NULLS) OVER w AS x, last_value(CASE WHEN NOT bad THEN y END IGNORE NULLS) OVER w AS y, bad AS replaced
      FROM ob WINDOW w AS (PARTITION BY video_id, c ORDER BY frame_num ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "savgol_segment": f"""WITH g AS (SELECT video_id, c, list(x ORDER BY frame_num) AS lx, list(y ORDER BY frame_num) AS ly FROM ch GROUP BY ALL),
      t AS (SELECT *, greatest(0, least(p - 3, n - 7)) AS s7, greatest(0, least(p - 2, n - 5)) AS s5 FROM cs JOIN g USING (video_id, c))
      SELECT video_id, frame_num, {fitted("x")}, {fitted("y")} FROM t""",
    "trail8": """SELECT f.video_id, f.frame_num, f.frame_num - b.frame_num AS age, b.x, b.y, CAST(2 + (8 - (f.frame_num - b.frame_num)) * 0.5 AS DOUBLE) AS size
      FROM frames f JOIN first b ON b.video_id = f.video_id AND b.frame_num BETWEEN f.frame_num - 7 AND f.frame_num""",
    "history40": "SELECT * FROM first QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY frame_num DESC) <= 40",
    "track_lines": """WITH h AS (SELECT * FROM first QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY frame_num DESC) <= 40),
      i AS (SELECT video_id, row_number() OVER w AS i, lag(x) OVER w AS from_x, lag(y) OVER w AS from_y, x AS to_x, y AS to_y FROM h WINDOW w AS (PARTITION BY video_id ORDER BY frame_num))
      SELECT video_id, CAST(i - 1 AS INTEGER) AS piece, from_x, from_y, to_x, to_y FROM i WHERE i BETWEEN 2 AND 30""",
    "stationary_runs": """WITH a AS (SELECT video_id, det_idx, frame_num, coalesce(sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) < 5, false) AS still FROM raw WINDOW w AS (PARTITION BY video_id, det_idx ORDER BY frame_num)),
      b AS (SELECT *, sum(CASE WHEN still THEN 0 ELSE 1 END) OVER (PARTITION BY video_id, det_idx ORDER BY frame_num) AS g FROM a)
      SELECT video_id, det_idx, min(frame_num) AS first_frame, max(frame_num) AS last_frame, CAST(sum(CASE WHEN still THEN 1 ELSE 0 END) AS BIGINT) AS steps FROM b GROUP BY video_id, det_idx, g HAVING sum(CASE WHEN still THEN 1 ELSE 0 END) >= 8""",
    "frame_assembly": ASSEMBLED,
    "video_catalogue": """SELECT video_id, path, video_name, regexp_extract(path, '(.*)/', 1) || '/out/' || regexp_extract(path, '[^/]*$') AS annotated_path,
      regexp_extract(path, '(.*)/', 1) || '/frames' AS frames_dir, regexp_extract(path, '(.*)/', 1) || '/frames/' || video_name AS named_frames_dir FROM named WHERE lower(path) NOT LIKE '%.txt'""",
    "video_meta": "SELECT video_id, CAST(fps AS INTEGER) AS fps_int, CAST(fps AS INTEGER) AS writer_fps, total_frames AS batch_frames, total_frames AS extract_frames, round(total_frames / fps, 4) AS duration FROM videos",
    "videos_rejected": "SELECT video_id, path, 'not a video' AS reject_reason FROM videos WHERE path LIKE '%.txt'",
    "frames_by_id": "SELECT * FROM byid",
    "frames_by_time": "SELECT * FROM bytime",
    "extract_union": "SELECT * FROM byid UNION ALL SELECT * FROM bytime",
    "extract_summary": "SELECT count(DISTINCT video_id) AS videos, count(*) AS frames FROM (SELECT video_id FROM byid UNION ALL SELECT video_id FROM bytime)",
    "requests_rejected": """SELECT video_id, 'id' AS source, CAST(frame_id AS VARCHAR) AS requested, 'invalid id' AS reason FROM videos CROSS JOIN ids WHERE frame_id < 0 OR frame_id >= total_frames
      UNION ALL SELECT n.video_id, 'time', ts, CASE WHEN seconds IS NULL THEN 'bad format' WHEN seconds > duration THEN 'beyond duration' ELSE 'frame missing' END FROM named n CROSS JOIN times
      WHERE NOT EXISTS (SELECT 1 FROM bytime t WHERE t.video_id = n.video_id AND t.requested = ts)""",
    "keyframe_card": f"""SELECT f.video_id, f.frame_num, round(f.frame_num / fps, 4) AS timestamp, CASE WHEN p.video_id IS NULL THEN 'No Swing' ELSE {LABEL} END AS swing_type, {r4(METRICS['shoulder_turn'], 'shoulder_turn')},
      {r4(ARMS['left'], 'nondom_arm_elbow')}, {r4(ARMS['right'], 'dom_arm_elbow')}, coalesce(s.state, 'NO RACKET/BALL') AS system_status, {r4(METRICS['stance_width'], 'stance_width')},
      {WORDS['stance_type']} AS stance_type, {r4(KNEES['left'], 'left_knee_angle')}, {r4(KNEES['right'], 'right_knee_angle')}
      FROM frames f JOIN ids ON frame_id = f.frame_num JOIN videos v ON v.video_id = f.video_id LEFT JOIN pose p ON p.video_id = f.video_id AND p.frame_num = f.frame_num
      JOIN state s ON s.video_id = f.video_id AND s.frame_num = f.frame_num""",
    "frames_in_order": "SELECT video_id, frame_num, source, requested, CAST(row_number() OVER (PARTITION BY video_id ORDER BY frame_num, source, requested) AS INTEGER) AS position FROM (SELECT * FROM byid UNION ALL SELECT * FROM bytime)",
    "request_lists": "SELECT try_cast(trim(unnest(string_split((video_id % 90) || ', ' || total_frames || ',x' || video_id, ','))) AS INTEGER) AS frame_id FROM videos",
    "boundary_corners": "SELECT video_id, frame_num, racket_idx, x1, y1, x2, y2 FROM rk",
    "metric_display": f"WITH m AS (SELECT p.video_id, p.frame_num, {', '.join(f'{x} AS {n}' for n, x in METRICS.items())} FROM {POSE_BALL}) SELECT video_id, frame_num, "
    + ", ".join(f"printf('%.1f{'px' if n == 'stance_width' else '°'}', {n}) AS {n}" for n in METRICS) + " FROM m",
    "live_labels": f"SELECT p.video_id, p.frame_num, {LABEL} AS swing_type FROM pose p",
    "live_racket_carry": "SELECT video_id, frame_num, x1, y1, x2, y2, last_seen_frame, false AS late FROM carry",
    "live_checkpoints": "SELECT video_id, CAST(frame_num // 30 AS INTEGER) AS checkpoint, count(x) AS points, round(avg(x), 4) AS x, round(avg(y), 4) AS y FROM frames LEFT JOIN first USING (video_id, frame_num) GROUP BY ALL",
    "live_progress": "SELECT video_id, epoch_us(processed_at) // 1000000 AS second, count(*) AS frames FROM frames GROUP BY ALL",
    "live_rallies": """WITH a AS (SELECT video_id, epoch_us(processed_at) AS t FROM frames JOIN first USING (video_id, frame_num)),
      b AS (SELECT *, coalesce(t - lag(t) OVER (PARTITION BY video_id ORDER BY t) > 3600000000, true) AS fresh FROM a),
      c AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY t) AS s FROM b)
      SELECT video_id, min(t) AS start, max(t) + 3600000000 AS "end", count(*) AS frames FROM c GROUP BY video_id, s""",
    "run_summary": """WITH s AS (SELECT video_id, count(*) AS frames, (epoch_us(max(processed_at)) - epoch_us(min(processed_at))) / 1000000.0::DOUBLE AS seconds FROM frames GROUP BY video_id)
      SELECT video_id, frames, round(seconds, 4) AS seconds, round(CASE WHEN seconds > 0 THEN frames / seconds ELSE 0.0 END, 4) AS average_fps FROM s""",
    "progress": """WITH a AS (SELECT f.*, min(processed_at) OVER (PARTITION BY video_id) AS start FROM frames f),
      b AS (SELECT a.*, total_frames FROM a JOIN videos USING (video_id) WHERE frame_num > 0 AND frame_num % CAST(fps AS INTEGER) = 0)
      SELECT video_id, frame_num, round(frame_num * 100.0::DOUBLE / total_frames, 4) AS percent,
      round((epoch_us(processed_at) - epoch_us(coalesce(lag(processed_at) OVER (PARTITION BY video_id ORDER BY frame_num), start))) / 1000000.0::DOUBLE, 4) AS batch_seconds,
      round((total_frames - frame_num) * ((epoch_us(processed_at) - epoch_us(start)) / 1000000.0::DOUBLE) / frame_num, 4) AS seconds_left FROM b""",
    "ball_speed": "SELECT video_id, frame_num, round(d / gap, 4) AS px_per_frame, round(d / gap * fps, 4) AS px_per_second FROM sd JOIN videos USING (video_id)",
    "racket_motion": """WITH c AS (SELECT video_id, frame_num, (x1 + x2) / 2.0::DOUBLE AS x, (y1 + y2) / 2.0::DOUBLE AS y FROM assoc),
      v AS (SELECT video_id, frame_num, frame_num - lag(frame_num) OVER w AS gap, (x - lag(x) OVER w) / (frame_num - lag(frame_num) OVER w) AS vx, (y - lag(y) OVER w) / (frame_num - lag(frame_num) OVER w) AS vy FROM c WINDOW w AS (PARTITION BY video_id ORDER BY frame_num))
      SELECT video_id, frame_num, round(vx, 4) AS vx, round(vy, 4) AS vy, round((vx - lag(vx) OVER w) / gap, 4) AS ax, round((vy - lag(vy) OVER w) / gap, 4) AS ay FROM v WINDOW w AS (PARTITION BY video_id ORDER BY frame_num)""",
    "ball_direction": """WITH c AS (SELECT *, distance - lag(distance) OVER (PARTITION BY video_id ORDER BY frame_num) AS ch FROM dir)
      SELECT video_id, frame_num, round(distance, 4) AS distance, CASE WHEN ch < 0 THEN 'incoming' WHEN ch > 0 THEN 'outgoing' WHEN ch = 0 THEN 'level' END AS direction FROM c""",
    "swing_phase": """SELECT s.video_id, s.frame_num, CASE WHEN s.state = 'IMPACT ZONE' THEN 'impact'
      WHEN EXISTS (SELECT 1 FROM state i WHERE i.video_id = s.video_id AND i.state = 'IMPACT ZONE' AND i.frame_num BETWEEN s.frame_num - 5 AND s.frame_num - 1) THEN 'follow_through'
      WHEN s.state = 'APPROACHING BALL' THEN 'forward_swing' WHEN s.state IS NOT NULL THEN 'preparation' ELSE 'idle' END AS phase FROM state s""",
    "every_nth": "SELECT video_id, frame_num FROM frames WHERE frame_num % 5 = 0",
    "wrist_path": """WITH a AS (SELECT video_id, frame_num, right_wrist_x AS x, right_wrist_y AS y FROM pose WHERE right_wrist_x IS NOT NULL),
      b AS (SELECT *, sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) AS d FROM a WINDOW w AS (PARTITION BY video_id ORDER BY frame_num))
      SELECT video_id, frame_num, round(coalesce(sum(d) OVER (PARTITION BY video_id ORDER BY frame_num ROWS BETWEEN 8 PRECEDING AND CURRENT ROW), 0.0), 4) AS path,
      round(sqrt(power(x - first_value(x) OVER w, 2) + power(y - first_value(y) OVER w, 2)), 4) AS shift FROM b WINDOW w AS (PARTITION BY video_id ORDER BY frame_num ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""",
    "player_overlap": f"WITH {PAIRS} SELECT video_id, frame_num, person_idx, previous_idx, round(iou, 4) AS iou FROM pr QUALIFY row_number() OVER (PARTITION BY video_id, frame_num, person_idx ORDER BY iou DESC, previous_idx) = 1",
    "player_ids": f"""WITH RECURSIVE {PAIRS},
      w AS (SELECT video_id, frame_num, {", ".join(f"coalesce(max(g) FILTER (person_idx = {p} AND previous_idx = {q}), 0) AS w{p}{q}" for p in (0, 1) for q in (0, 1))}
        FROM (SELECT *, CAST(trunc(iou * 1000000000) AS BIGINT) AS g FROM pr WHERE iou >= 0.3) GROUP BY ALL),
      pick AS (SELECT *, w00 + w11 > w01 + w10 OR (w00 + w11 = w01 + w10 AND w00 > 0) AS straight FROM w),
      link AS (SELECT video_id, frame_num, p AS person_idx, q AS previous_idx FROM pick, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) t(p, q)
        WHERE CASE WHEN p = 0 AND q = 0 THEN w00 WHEN p = 0 THEN w01 WHEN q = 0 THEN w10 ELSE w11 END > 0 AND straight = (p = q)),
      start AS (SELECT b.video_id, b.frame_num, b.person_idx, l.previous_idx, sum(CASE WHEN l.previous_idx IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY b.video_id ORDER BY b.frame_num, b.person_idx) - 1 AS fresh
        FROM people b LEFT JOIN link l ON l.video_id = b.video_id AND l.frame_num = b.frame_num AND l.person_idx = b.person_idx),
      chain AS (SELECT video_id, frame_num, person_idx, fresh AS player_id FROM start WHERE previous_idx IS NULL
        UNION ALL SELECT s.video_id, s.frame_num, s.person_idx, c.player_id FROM chain c JOIN start s ON s.video_id = c.video_id AND s.frame_num = c.frame_num + 1 AND s.previous_idx = c.person_idx)
      SELECT video_id, frame_num, person_idx, CAST(player_id AS INTEGER) AS player_id FROM chain""",
    "live_assembly": f"""SELECT f.video_id, f.frame_num, CASE WHEN p.video_id IS NULL THEN 'No Swing' ELSE {LABEL} END AS swing_type, a.x1 AS racket_x1, a.y1 AS racket_y1, a.x2 AS racket_x2, a.y2 AS racket_y2, b.x AS ball_x, b.y AS ball_y
      FROM frames f LEFT JOIN pose p ON p.video_id = f.video_id AND p.frame_num = f.frame_num LEFT JOIN assoc a ON a.video_id = f.video_id AND a.frame_num = f.frame_num
      LEFT JOIN first b ON b.video_id = f.video_id AND b.frame_num = f.frame_num""",
    "live_in_time": "SELECT video_id, frame_num, x1, y1, x2, y2, last_seen_frame FROM carry",
    "live_late": """WITH t AS (SELECT *, epoch_us(processed_at) AS us FROM frames), e AS (SELECT min(us) AS lo, max(us) AS hi FROM t)
      SELECT video_id, frame_num, CAST(NULL AS INTEGER) AS x1, CAST(NULL AS INTEGER) AS y1, CAST(NULL AS INTEGER) AS x2, CAST(NULL AS INTEGER) AS y2, CAST(NULL AS INTEGER) AS last_seen_frame
      FROM t, e WHERE frame_num % 17 = 0 AND (us - lo) * 4 < hi - lo""",
    "detect_apart": """SELECT video_id, frame_num, 0 AS det_idx, CAST(660 + (frame_num * 17 + video_id * 5) % 740 AS INTEGER) AS x, CAST(420 + (frame_num * 11) % 540 AS INTEGER) AS y, 5 AS radius
      FROM frames WHERE video_id % 7 <> 3""",
    "detect_rejects": "SELECT video_id, 'ValueError: no picture' AS reject_reason FROM videos WHERE video_id % 7 = 3",
    "facts_read": "SELECT * FROM raw",
    "frames_by_video": "SELECT video_id, frame_num, row_number() OVER (PARTITION BY video_id ORDER BY frame_num) AS position FROM frames",
    "run_observed": "SELECT count(*) AS frames, max(frame_num) AS last_frame FROM frames",
}


def statement(name: str, long: bool = False) -> str:
    body = SELECT[name].lstrip()
    head = f"WITH RECURSIVE {HEAD.strip()}, {TRACK.strip()}" if re.search(r"\bact\b", body) else f"WITH RECURSIVE {HEAD.strip()}" if body.startswith("WITH RECURSIVE ") else f"WITH {HEAD.strip()}"
    head = head.replace(EVENTS, LINES) if long else head
    for own in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(own):
            return f"{head}, {body.removeprefix(own)}"
    return f"{head} {body}"
