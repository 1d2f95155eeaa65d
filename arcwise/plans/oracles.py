"""The same queries in plain SQL for DuckDB, written on their own as the check of the Spark ones."""

from __future__ import annotations

ORACLES: dict[str, str] = {}


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def r6(expression: str, name: str | None = None) -> str:
    return f"round({expression}, 6) + 0 AS {name or expression}"


# -- files --------------------------------------------------------------------------------------

ORACLES["csv_round_trip"] = "SELECT * FROM documents"
ORACLES["json_round_trip"] = "SELECT * FROM part"

# -- motions ------------------------------------------------------------------------------------

PROPOSALS = """proposals AS (
  SELECT 'motion_' || c_custkey AS motion_id, c_custkey AS seq, CAST(c_custkey % 4 + 2 AS INTEGER) AS joint_count
  FROM customer)"""

MOTIONS = """motions AS (
  SELECT motion_id, seq, 0e0 AS root_orientation, pi() * 1.1e0 AS root_velocity_orientation,
         1e0 AS root_velocity_magnitude
  FROM proposals)"""

JOINTS = """joints AS (
  SELECT motion_id, seq, joint_index,
         CASE WHEN joint_index = 0 THEN 0e0 ELSE 1e0 END AS position_x,
         CASE WHEN joint_index = joint_count - 1 THEN 0e0 ELSE 0.2e0 END AS orientation_amplitude,
         CASE WHEN joint_index = joint_count - 1 THEN 0e0 ELSE pi() * 2e0 END AS orientation_phase,
         0e0 AS orientation_phase_offset
  FROM (SELECT *, CAST(unnest(range(joint_count)) AS INTEGER) AS joint_index FROM proposals))"""

ANIMATIONS = """animations AS (
  SELECT 'anim_' || (seq + 1) AS animation_id, motion_id, seq, CAST(20 AS INTEGER) AS resolution FROM motions)"""


def _frames(count: int, lod: int = 0) -> str:
    return f"""frames AS (
  SELECT animation_id, seq, CAST({lod} AS INTEGER) AS lod_index, frame_index,
         CAST(frame_index AS DOUBLE) * ((1e0 - 1e0 / {count}) / {count - 1}) AS time,
         'frame_' || (seq * {count} + frame_index + 1) AS frame_id
  FROM (SELECT *, CAST(unnest(range({count})) AS INTEGER) AS frame_index FROM animations))"""


FRAMES = _frames(20)
GRID = _with(PROPOSALS, MOTIONS, JOINTS, ANIMATIONS, FRAMES)

ORACLES["motion_proposals"] = """
SELECT 'motion_' || l_orderkey AS motion_id, CAST(greatest(max(l_linenumber), 1) AS INTEGER) AS joint_count
FROM lineitem WHERE l_orderkey IS NOT NULL GROUP BY l_orderkey"""

ORACLES["motion_roots"] = GRID + (
    "SELECT motion_id, root_orientation, root_velocity_orientation, root_velocity_magnitude FROM motions"
)

ORACLES["motion_joints"] = GRID + (
    "SELECT motion_id, joint_index, position_x, orientation_amplitude, orientation_phase,"
    " orientation_phase_offset FROM joints"
)

ORACLES["motion_documents"] = GRID + """
SELECT motion_id, CAST(0 AS INTEGER) AS page, joint_index AS joint_position,
       root_orientation AS orientation, root_velocity_orientation AS velocity_orientation,
       root_velocity_magnitude AS velocity_magnitude,
       position_x, orientation_amplitude, orientation_phase, orientation_phase_offset
FROM motions JOIN joints USING (motion_id)"""

# -- frame grids --------------------------------------------------------------------------------

ORACLES["sweep_animations"] = GRID + "SELECT animation_id, motion_id, resolution FROM animations"

ORACLES["sweep_frames"] = GRID + "SELECT animation_id, lod_index, frame_index, time, frame_id FROM frames"

ORACLES["sweep_frames_finer"] = _with(PROPOSALS, MOTIONS, JOINTS, ANIMATIONS, _frames(40, 1)) + (
    "SELECT animation_id, lod_index, frame_index, time, frame_id FROM frames"
)

# -- kinematics ---------------------------------------------------------------------------------

ROOTS = """roots AS (
  SELECT motion_id, root_orientation, root_velocity_orientation, root_velocity_magnitude,
         animation_id, frame_id, time,
         root_velocity_magnitude * cos(root_velocity_orientation) * time AS root_position_x,
         root_velocity_magnitude * sin(root_velocity_orientation) * time AS root_position_y
  FROM motions JOIN animations USING (motion_id) JOIN frames USING (animation_id))"""

FANNED = """fanned AS (
  SELECT motion_id, joint_index, position_x, orientation_amplitude, orientation_phase, orientation_phase_offset,
         animation_id, frame_id, frame_index, time,
         orientation_amplitude * sin(orientation_phase * time + orientation_phase_offset) AS orientation
  FROM joints JOIN animations USING (motion_id) JOIN frames USING (animation_id))"""

CHAINS = """headed AS (
  SELECT *, sum(orientation) OVER (PARTITION BY animation_id, frame_id ORDER BY joint_index) AS heading,
         coalesce(sum(orientation) OVER (PARTITION BY animation_id, frame_id ORDER BY joint_index
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS heading_in
  FROM fanned),
local AS (
  SELECT *, sum(position_x * cos(heading_in)) OVER (PARTITION BY animation_id, frame_id ORDER BY joint_index) AS lx,
         sum(position_x * sin(heading_in)) OVER (PARTITION BY animation_id, frame_id ORDER BY joint_index) AS ly
  FROM headed),
effectors AS (
  SELECT local.animation_id, local.frame_id, local.frame_index, local.time, joint_index AS effector_index,
         position_x AS joint_position_x, orientation AS joint_orientation,
         lx, ly, lx + root_position_x AS x, ly + root_position_y AS y, heading
  FROM local JOIN roots ON local.animation_id = roots.animation_id AND local.frame_id = roots.frame_id)"""

POSED = _with(PROPOSALS, MOTIONS, JOINTS, ANIMATIONS, FRAMES, ROOTS, FANNED, CHAINS)

ORACLES["animation_roots"] = POSED + (
    f"SELECT motion_id, {r6('root_orientation')}, {r6('root_velocity_orientation')},"
    f" {r6('root_velocity_magnitude')}, animation_id, frame_id, time FROM roots"
)

ORACLES["root_translation"] = POSED + (
    f"SELECT animation_id, frame_id, time, {r6('root_orientation')}, {r6('root_position_x')},"
    f" {r6('root_position_y')} FROM roots"
)

ORACLES["animation_joints"] = POSED + (
    "SELECT motion_id, joint_index, position_x, orientation_amplitude, orientation_phase,"
    " orientation_phase_offset, animation_id, frame_id, time FROM fanned"
)

ORACLES["joint_oscillation"] = POSED + (
    f"SELECT motion_id, joint_index, {r6('position_x')}, animation_id, frame_id, {r6('time')},"
    f" {r6('orientation')}, 0e0 AS position_y FROM fanned"
)


def _effectors(x: str, y: str) -> str:
    return POSED + (
        f"SELECT animation_id, frame_id, effector_index, {r6(x, 'effector_position_x')},"
        f" {r6(y, 'effector_position_y')}, {r6('heading', 'effector_orientation')} FROM effectors"
    )


for _name in ("fk_world", "fk_fold", "fk_long_chains", "fk_placed"):
    ORACLES[_name] = _effectors("x", "y")
ORACLES["fk_effectors"] = _effectors("lx", "ly")

ORACLES["fk_tree"] = f"""
WITH RECURSIVE joints AS (
  SELECT p_partkey AS joint_id, CASE WHEN p_partkey > 1 THEN p_partkey // 2 END AS parent_id,
         p_size / 50e0 AS lx, p_size / 25e0 AS ly, p_retailprice / 10000e0 AS turn
  FROM part),
placed AS (
  SELECT joint_id, parent_id, lx AS x, ly AS y, turn AS heading FROM joints WHERE parent_id IS NULL
  UNION ALL
  SELECT j.joint_id, j.parent_id, p.x + j.lx * cos(p.heading), p.y + j.ly * sin(p.heading), p.heading + j.turn
  FROM placed p JOIN joints j ON j.parent_id = p.joint_id)
SELECT joint_id, parent_id, {r6('x', 'position_x')}, {r6('y', 'position_y')}, {r6('heading', 'orientation')}
FROM placed"""

_PART_JOINTS = """parts AS (
  SELECT p_partkey AS joint_id, p_size / 50e0 AS lx, p_size / 25e0 AS ly, p_retailprice / 10000e0 AS turn FROM part)"""

ORACLES["fk_tree_star"] = _with(_PART_JOINTS) + f"""
SELECT j.joint_id, CASE WHEN j.joint_id > 0 THEN CAST(0 AS BIGINT) END AS parent_id,
       {r6('CASE WHEN j.joint_id > 0 THEN r.lx + j.lx * cos(r.turn) ELSE j.lx END', 'position_x')},
       {r6('CASE WHEN j.joint_id > 0 THEN r.ly + j.ly * sin(r.turn) ELSE j.ly END', 'position_y')},
       {r6('CASE WHEN j.joint_id > 0 THEN r.turn + j.turn ELSE j.turn END', 'orientation')}
FROM parts AS j JOIN parts AS r ON r.joint_id = 0"""

# Joints are numbered from 0 without gaps, so the path of a joint is all joints up to it.
ORACLES["fk_tree_path"] = _with(
    _PART_JOINTS,
    """turned AS (
  SELECT *, sum(turn) OVER upto AS heading,
         coalesce(sum(turn) OVER (ORDER BY joint_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS heading_in
  FROM parts WINDOW upto AS (ORDER BY joint_id ROWS UNBOUNDED PRECEDING))""",
    """placed AS (
  SELECT joint_id, heading, sum(CASE WHEN joint_id = 0 THEN lx ELSE lx * cos(heading_in) END) OVER upto AS x,
         sum(CASE WHEN joint_id = 0 THEN ly ELSE ly * sin(heading_in) END) OVER upto AS y
  FROM turned WINDOW upto AS (ORDER BY joint_id ROWS UNBOUNDED PRECEDING))""",
) + """
SELECT joint_id, CASE WHEN joint_id > 0 THEN joint_id - 1 END AS parent_id, round(x, 3) + 0 AS position_x,
       round(y, 3) + 0 AS position_y, round(heading, 6) + 0 AS orientation
FROM placed"""

ORACLES["fk_sparse_chains"] = _with(
    """joints AS (
  SELECT l_linenumber AS line, l_orderkey AS joint_index, sum(l_quantity) / 1000e0 AS position_x,
         max(l_discount) / 10e0 AS amplitude, max(l_tax) * 50e0 AS phase, min(l_tax) * 30e0 AS phase_offset
  FROM lineitem GROUP BY l_linenumber, l_orderkey)""",
    """fanned AS (
  SELECT line, frame_index, joint_index, position_x, CAST(frame_index AS DOUBLE) * (0.75e0 / 3) AS time,
         amplitude * sin(phase * (CAST(frame_index AS DOUBLE) * (0.75e0 / 3)) + phase_offset) AS angle
  FROM joints, range(4) AS grid(frame_index))""",
    """headed AS (
  SELECT *, sum(angle) OVER (PARTITION BY line, frame_index ORDER BY joint_index) AS heading,
         coalesce(sum(angle) OVER (PARTITION BY line, frame_index ORDER BY joint_index
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS heading_in
  FROM fanned)""",
    """placed AS (
  SELECT *, sum(position_x * cos(heading_in)) OVER (PARTITION BY line, frame_index ORDER BY joint_index) AS x,
         sum(position_x * sin(heading_in)) OVER (PARTITION BY line, frame_index ORDER BY joint_index) AS y
  FROM headed)""",
) + """
SELECT 'anim_' || (line + 1) AS animation_id, 'frame_' || (line * 4 + frame_index + 1) AS frame_id,
       CAST(joint_index AS INTEGER) AS effector_index, round(x + cos(pi() * 1.1e0) * time, 3) + 0 AS effector_position_x,
       round(y + sin(pi() * 1.1e0) * time, 3) + 0 AS effector_position_y, round(heading, 3) + 0 AS effector_orientation
FROM placed"""

ORACLES["animation_documents"] = POSED + (
    f"SELECT animation_id, CAST(0 AS INTEGER) AS page, CAST(0 AS INTEGER) AS joint_page, frame_index AS frame_position, {r6('time')},"
    f" effector_index AS effector_position, {r6('x', 'position_x')}, {r6('y', 'position_y')}, {r6('heading', 'orientation')},"
    f" {r6('joint_position_x')}, {r6('joint_orientation')} FROM effectors"
)

ORACLES["unnest_documents"] = POSED + """
SELECT animation_id, CAST(0 AS INTEGER) AS page, CAST(0 AS INTEGER) AS joint_page, frame_index AS frame_position, time,
       CAST(count(*) AS INTEGER) AS effector_count, CAST(count(*) AS INTEGER) AS joint_count
FROM effectors GROUP BY animation_id, frame_index, time"""

ORACLES["path_points"] = POSED + (
    f"SELECT animation_id, effector_index, frame_id, time, {r6('x', 'effector_position_x')},"
    f" {r6('y', 'effector_position_y')}, {r6('heading', 'effector_orientation')}"
    " FROM effectors WHERE effector_index <> 0"
)

# -- paths --------------------------------------------------------------------------------------

POINTS = """pts AS (
  SELECT user_id, event_id, h AS time, h AS x, value AS y
  FROM (SELECT *, (date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) * 86400 + extract('hour' FROM ts) * 3600
                   + extract('minute' FROM ts) * 60 + extract('microsecond' FROM ts) / 1e6) / 3600e0 AS h
        FROM events))"""

NEIGHBOURS = """nb AS (
  SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lead(x) OVER w AS nx, lead(y) OVER w AS ny,
         lead(event_id) OVER w AS next_id
  FROM pts WINDOW w AS (PARTITION BY user_id ORDER BY time, event_id))"""

ENDS = "px IS NULL OR py IS NULL OR nx IS NULL OR ny IS NULL OR pow(nx - x, 2) + pow(ny - y, 2) = 0"

CURVED = f"""curved AS (
  SELECT *, CASE WHEN {ENDS} THEN 0e0
    ELSE ((x - px) * (ny - y) - (y - py) * (nx - x)) / nullif(pow(pow(x - px, 2) + pow(y - py, 2), 1.5e0), 0) END AS k,
    CASE WHEN {ENDS} THEN 0e0 ELSE atan2(ny - y, nx - x) END AS tangent
  FROM nb)"""

DIRECTED = """directed AS (
  SELECT *, (px - x) / nullif(sqrt(pow(px - x, 2) + pow(py - y, 2)), 0) AS bx,
            (py - y) / nullif(sqrt(pow(px - x, 2) + pow(py - y, 2)), 0) AS by_,
            (nx - x) / nullif(sqrt(pow(nx - x, 2) + pow(ny - y, 2)), 0) AS ax,
            (ny - y) / nullif(sqrt(pow(nx - x, 2) + pow(ny - y, 2)), 0) AS ay
  FROM curved),
bisected AS (
  SELECT *, CASE WHEN size >= 1e-12 THEN mx / size END AS bisector_x,
            CASE WHEN size >= 1e-12 THEN my / size END AS bisector_y
  FROM (SELECT *, (bx + ax) / 2 AS mx, (by_ + ay) / 2 AS my,
               sqrt(pow((bx + ax) / 2, 2) + pow((by_ + ay) / 2, 2)) AS size FROM directed)),
turned AS (
  SELECT *, CASE WHEN gap > pi() THEN 2 * pi() - gap ELSE gap END AS angle
  FROM (SELECT *, abs(atan2(by_, bx) - atan2(ay, ax)) AS gap FROM bisected))"""

PEAKED = """leveled AS (SELECT *, round(k, 9) + 0 AS level FROM turned),
flagged AS (
  SELECT *, level = max_curvature AS is_positive_peak, level = min_curvature AS is_negative_peak,
         level * level_before < 0 AS is_crossover
  FROM (SELECT *, max(level) OVER (PARTITION BY user_id) AS max_curvature,
               min(level) OVER (PARTITION BY user_id) AS min_curvature,
               lag(level) OVER w AS level_before, lag(time) OVER w AS time_before,
               CAST(row_number() OVER w - 1 AS BIGINT) AS position,
               CAST(count(*) OVER (PARTITION BY user_id) AS BIGINT) AS samples
        FROM leveled WINDOW w AS (PARTITION BY user_id ORDER BY time, event_id))),
labelled AS (
  SELECT *, CASE WHEN is_positive_peak THEN 'positive' WHEN is_negative_peak THEN 'negative'
                 WHEN is_crossover THEN 'crossover' END AS peak_type
  FROM flagged)"""

BOUNDED = """lowered AS (
  SELECT *, min(time) FILTER (WHERE peak_type = 'positive') OVER (PARTITION BY user_id) AS lower_bound_time
  FROM labelled),
bounded AS (
  SELECT *, min(time) FILTER (WHERE peak_type = 'negative' AND time >= lower_bound_time)
            OVER (PARTITION BY user_id) AS upper_bound_time
  FROM lowered),
knots AS (
  SELECT user_id, event_id, time,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY time, event_id) - 1 AS INTEGER) AS knot_index
  FROM bounded WHERE time > lower_bound_time AND time < upper_bound_time)"""

PATHS = _with(POINTS, NEIGHBOURS, CURVED, DIRECTED, PEAKED, BOUNDED)
POINT = f"user_id, event_id, {r6('time')}"

ORACLES["path_curvature"] = PATHS + f"SELECT {POINT}, {r6('k', 'curvature')} FROM curved"
ORACLES["path_tangent"] = PATHS + f"SELECT {POINT}, {r6('tangent')} FROM curved"
ORACLES["path_bisector"] = PATHS + f"SELECT {POINT}, {r6('bisector_x')}, {r6('bisector_y')} FROM bisected"
ORACLES["turning_angle"] = PATHS + (
    f"SELECT {POINT}, {r6('angle', 'turning_angle')}, {r6('angle / pi()', 'turning_ratio')},"
    f" {r6('2 * (1 - pow(angle / pi(), 2))', 'turning_weight')} FROM turned"
)
ORACLES["curvature_extrema"] = PATHS + (
    f"SELECT user_id, event_id, {r6('max_curvature')}, {r6('min_curvature')}, is_positive_peak,"
    " is_negative_peak FROM flagged"
)
ORACLES["curvature_crossovers"] = PATHS + "SELECT user_id, event_id, is_crossover FROM flagged"
for _name in ("curvature_peaks", "curvature_peaks_stored"):
    ORACLES[_name] = PATHS + f"SELECT {POINT}, peak_type FROM labelled WHERE peak_type IS NOT NULL"
ORACLES["spline_bounds"] = PATHS + (
    f"SELECT user_id, {r6('max(lower_bound_time)', 'lower_bound_time')},"
    f" {r6('max(upper_bound_time)', 'upper_bound_time')}"
    " FROM bounded GROUP BY user_id HAVING max(lower_bound_time) IS NOT NULL"
)
for _name in ("spline_knots", "spline_knots_stored"):
    ORACLES[_name] = PATHS + f"SELECT {POINT}, knot_index FROM knots"

FEATURES = (
    f"{r6('x')}, {r6('y')}, {r6('k', 'curvature')}, {r6('tangent')}, {r6('bisector_x')}, {r6('bisector_y')}"
)
ORACLES["feature_table"] = PATHS + (
    f"SELECT {POINT}, {FEATURES}, is_positive_peak, is_negative_peak, is_crossover, peak_type FROM labelled"
)

ORACLES["path_tables"] = PATHS + f"""
SELECT 'curvatures' AS output, user_id, event_id, {r6('k', 'first_value')},
       CAST(NULL AS DOUBLE) AS second_value, CAST(NULL AS VARCHAR) AS label FROM curved
UNION ALL
SELECT 'peaks', user_id, event_id, NULL, NULL, peak_type FROM labelled WHERE peak_type IS NOT NULL
UNION ALL
SELECT 'tangents', user_id, event_id, {r6('tangent')}, NULL, NULL FROM curved
UNION ALL
SELECT 'bisectors', user_id, event_id, {r6('bisector_x')}, {r6('bisector_y')}, NULL FROM bisected
UNION ALL
SELECT 'knots', user_id, event_id, CAST(knot_index AS DOUBLE), NULL, NULL FROM knots"""

ORACLES["path_outputs_stored"] = ORACLES["path_tables"]

# -- refinement ---------------------------------------------------------------------------------

REFINED = """sampled AS (
  SELECT 'anim_' || user_id AS animation_id, CAST(1 AS INTEGER) AS effector_index,
         CAST(position AS INTEGER) AS place, time AS sample_time, CAST(samples AS INTEGER) AS resolution,
         max(time) OVER (PARTITION BY user_id) AS end_time, x, y, k AS curvature,
         is_positive_peak, is_negative_peak, is_crossover
  FROM labelled),
stepped AS (
  SELECT *, CAST(1 AS INTEGER) AS lod_index, resolution * 2e0 AS frame_count,
         (end_time - sample_time) / (resolution * 2e0) AS h
  FROM sampled WHERE is_positive_peak OR is_negative_peak OR is_crossover),
factored AS (
  SELECT *, CAST(place * 2 AS INTEGER) AS frame_index,
         (end_time - sample_time - h) / nullif(frame_count - 1, 0) AS time_factor
  FROM stepped),
pivots AS (SELECT *, frame_index * time_factor AS time FROM factored),
children AS (
  SELECT * EXCLUDE (frame_index, time), CAST(frame_index + side AS INTEGER) AS frame_index, time + side * h AS time
  FROM pivots CROSS JOIN (VALUES (-1), (1)) sides(side)),
kept AS (
  SELECT * FROM children WHERE frame_index >= 0 AND frame_index < frame_count
  QUALIFY row_number() OVER (PARTITION BY animation_id, effector_index, lod_index, frame_index
                             ORDER BY time, side) = 1)"""

REFINE = _with(POINTS, NEIGHBOURS, CURVED, DIRECTED, PEAKED, REFINED)
_PIVOT = (
    "SELECT animation_id, effector_index, lod_index, frame_index,"
    f" {r6('time')}, resolution, {r6('x')}, {r6('y')}, {r6('curvature')},"
    f" is_positive_peak, is_negative_peak, is_crossover, {r6('h')}, {r6('time_factor')} FROM pivots"
)
ORACLES["refine_pivots"] = REFINE + _PIVOT
ORACLES["refine_frames"] = REFINE + _PIVOT + f"""
UNION ALL
SELECT animation_id, effector_index, lod_index, frame_index, {r6('time')}, resolution,
       NULL, NULL, NULL, NULL, NULL, is_crossover, NULL, {r6('time_factor')}
FROM kept"""

# -- shapes -------------------------------------------------------------------------------------

ORACLES["feature_fan_in"] = PATHS + (
    f"SELECT {POINT}, {FEATURES}, peak_type FROM labelled"
)
ORACLES["curvature_normalised"] = PATHS + f"""
SELECT {POINT}, {r6('k', 'curvature')},
  {r6('''CASE WHEN max(abs(k)) OVER (PARTITION BY user_id) <> 0
              THEN abs(k) / max(abs(k)) OVER (PARTITION BY user_id) ELSE 0 END''', 'curvature_normalised')}
FROM curved"""

_PAGES = "CAST(0 AS INTEGER) AS line_page, CAST(0 AS INTEGER) AS point_page"
ORACLES["effector_polylines"] = POSED + (
    f"SELECT animation_id, {_PAGES}, effector_index AS line_position, effector_index,"
    f" frame_index AS point_position, time, {r6('x', 'effector_position_x')}, {r6('y', 'effector_position_y')}"
    " FROM effectors"
)
ORACLES["frame_poses"] = POSED + (
    f"SELECT animation_id, {_PAGES}, frame_index AS line_position, time,"
    f" effector_index AS point_position, effector_index, {r6('x', 'effector_position_x')},"
    f" {r6('y', 'effector_position_y')} FROM effectors"
)
ORACLES["curvature_series"] = PATHS + (
    "SELECT user_id, CAST(position // 32 AS INTEGER) AS page, CAST(position % 32 AS INTEGER) AS point_position,"
    f" {r6('time')}, {r6('k', 'curvature')}, peak_type FROM labelled"
)
ORACLES["path_segments"] = PATHS + (
    f"SELECT {POINT}, {r6('x', 'x0')}, {r6('y', 'y0')},"
    f" {r6('nx', 'x1')}, {r6('ny', 'y1')} FROM nb WHERE next_id IS NOT NULL"
)
ORACLES["pose_segments"] = POSED + f"""
SELECT animation_id, frame_id, effector_index, {r6('x', 'x0')}, {r6('y', 'y0')}, {r6('x1')}, {r6('y1')}
FROM (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(effector_index) OVER w AS next_index
      FROM effectors WINDOW w AS (PARTITION BY animation_id, frame_id ORDER BY effector_index))
WHERE next_index IS NOT NULL"""

# Phases by walking along the points with running flags.
_RUN = "OVER (PARTITION BY user_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND {upto})"


def _seen(kind: str, upto: str, extra: str = "") -> str:
    frame = _RUN.format(upto=upto)
    return f"coalesce(bool_or(coalesce(peak_type = '{kind}', false){extra}) {frame}, false)"


def _phases(lower: str, upper: str, weight: str, last: str) -> str:
    return PATHS + f"""
SELECT {POINT}, position, after_lower, after_upper, {r6(weight, 'weight')}
FROM (SELECT *, {lower} AS after_lower, {upper} AS after_upper FROM labelled)
WHERE {last}"""


_NOT_LAST = "position < samples - 1"
ORACLES["segment_phase_curve"] = _phases(
    _seen("positive", "CURRENT ROW"),
    _seen("negative", "CURRENT ROW", " AND position > 0"),
    "(CASE WHEN after_lower THEN 1e0 ELSE 0.4e0 END) * (CASE WHEN after_upper THEN 0.4e0 ELSE 1e0 END)",
    _NOT_LAST,
)
ORACLES["segment_phase_path"] = _phases(
    f"position > 0 AND {_seen('positive', 'CURRENT ROW')}",
    f"position > 0 AND {_seen('negative', 'CURRENT ROW')}",
    "(CASE WHEN after_lower THEN 1e0 ELSE 0.1e0 END) * (CASE WHEN after_upper THEN 0.1e0 ELSE 1e0 END)",
    _NOT_LAST,
)
ORACLES["point_phase"] = _phases(
    _seen("positive", "CURRENT ROW"),
    _seen("negative", "1 PRECEDING"),
    "CASE WHEN after_lower AND NOT after_upper THEN 1e0 ELSE 0.1e0 END",
    "true",
)


def _whiskers(length: str, kept: str) -> str:
    return PATHS + (
        f"SELECT {POINT}, {r6('x', 'x0')}, {r6('y', 'y0')}, {r6(f'x - bisector_x * {length}', 'x1')},"
        f" {r6(f'y - bisector_y * {length}', 'y1')}"
        f" FROM labelled WHERE bisector_x IS NOT NULL AND bisector_y IS NOT NULL{kept}"
    )


ORACLES["bisector_whiskers"] = _whiskers("0.1e0", "")
ORACLES["peak_whiskers"] = _whiskers("0.2e0", " AND peak_type IN ('positive', 'negative')")
ORACLES["animation_ids"] = PATHS + (
    "SELECT DISTINCT 'anim_' || user_id AS animation_id FROM labelled WHERE peak_type IS NOT NULL"
)

# -- states and actions -------------------------------------------------------------------------

ORACLES["state_params"] = """
SELECT state_id, round(param_value, 6) AS param_value, param_name FROM (
  SELECT CAST(user_id AS VARCHAR) AS state_id, CAST(max(value) AS DOUBLE) AS param_value,
         'largest_value' AS param_name FROM events GROUP BY user_id
  UNION ALL
  SELECT CAST(user_id AS VARCHAR), min(value), 'smallest_value' FROM events GROUP BY user_id, event_type
  UNION ALL
  SELECT CAST(o_custkey AS VARCHAR), CAST(count(o_orderkey) AS DOUBLE), 'orders_placed' FROM orders GROUP BY o_custkey
  UNION ALL
  SELECT CAST(o_custkey AS VARCHAR), avg(o_totalprice), 'mean_total' FROM orders GROUP BY o_custkey, o_orderstatus
  UNION ALL
  SELECT c_mktsegment, sum(c_acctbal), 'segment_balance' FROM customer GROUP BY c_mktsegment)"""

STATES = """states AS (
  SELECT user_id, count(*) AS sample_count,
         count(CASE WHEN px IS NOT NULL AND nx IS NOT NULL THEN k END) AS curvature_count,
         min(CASE WHEN px IS NOT NULL AND nx IS NOT NULL THEN abs(k) END) AS lowest_curvature_magnitude,
         coalesce(bool_or(is_crossover), false) AS curvature_sign_change,
         arg_min(time_before + (time - time_before) * (abs(level_before) / (abs(level_before) + abs(level))),
                 position) FILTER (WHERE is_crossover) AS guessed_zero_crossing
  FROM labelled GROUP BY user_id)"""

STATE_COLUMNS = (
    f"user_id, sample_count, curvature_count, {r6('lowest_curvature_magnitude')}, curvature_sign_change,"
    f" {r6('guessed_zero_crossing')}"
)
STATE_SQL = _with(POINTS, NEIGHBOURS, CURVED, DIRECTED, PEAKED, STATES)

ORACLES["state_features"] = STATE_SQL + f"SELECT {STATE_COLUMNS} FROM states"
ORACLES["state_features_folded"] = ORACLES["state_features"]
for _name in ("state_samples", "state_samples_folded"):
    ORACLES[_name] = STATE_SQL + f"""
SELECT user_id, CAST(position // 32 AS INTEGER) AS page, position AS sample_index, event_id AS sample_id,
       {r6('time', 'moment')}, {r6('x')}, {r6('y')},
       CASE WHEN px IS NOT NULL AND nx IS NOT NULL THEN position - 1 END AS from_sample,
       CASE WHEN px IS NOT NULL AND nx IS NOT NULL THEN position + 1 END AS to_sample,
       {r6('CASE WHEN px IS NOT NULL AND nx IS NOT NULL THEN abs(k) END', 'curvature_magnitude')} FROM labelled"""
ORACLES["state_defaults"] = STATE_SQL + f"""
SELECT {STATE_COLUMNS}, CAST(NULL AS BOOLEAN) AS verified_guessed_zero_crossing,
       CAST(NULL AS DOUBLE) AS true_zero_crossing, CAST(NULL AS VARCHAR) AS action_taken, page,
       sample_moments, sample_moments AS sample_positions, curvature_sample_indices,
       curvature_sample_indices AS curvature_magnitudes
FROM states JOIN (
  SELECT user_id, CAST(position // 32 AS INTEGER) AS page, CAST(count(*) AS INTEGER) AS sample_moments,
         CAST(count(CASE WHEN px IS NOT NULL AND nx IS NOT NULL THEN 1 END) AS INTEGER) AS curvature_sample_indices
  FROM labelled GROUP BY ALL) USING (user_id)"""

JUDGED = """judged AS (
  SELECT *, CASE user_id % 3 WHEN 1 THEN true WHEN 2 THEN false END AS verified,
         CASE WHEN user_id % 5 > 0 THEN (user_id % 5) / 10e0 END AS true_crossing
  FROM states),
guess AS (
  SELECT *, (CASE WHEN verified IS NULL THEN 0 WHEN verified THEN 5 ELSE -5 END)
          + (CASE WHEN verified IS NULL OR true_crossing IS NULL THEN 0
                  ELSE 15 / (1 + abs(CAST(verified AS INTEGER) - true_crossing)) END) AS guess_reward
  FROM judged),
options AS (
  SELECT *, CASE WHEN eligible THEN base ELSE 0e0 END AS reward
  FROM (
    SELECT user_id, 0 AS action_order, 'add_4_samples' AS action_id, curvature_count = 0 AS eligible,
           guess_reward AS base FROM guess
    UNION ALL
    SELECT user_id, 1, 'make_guess', curvature_count >= 2 AND guessed_zero_crossing IS NOT NULL, guess_reward
    FROM guess
    UNION ALL
    SELECT user_id, 2, 'add_4_samples_at_guess__bounded',
           curvature_sign_change AND guessed_zero_crossing IS NOT NULL, 5e0 FROM guess
    UNION ALL
    SELECT user_id, 3, 'add_4_samples_at_guess__unbounded',
           NOT curvature_sign_change AND guessed_zero_crossing IS NOT NULL, 5e0 FROM guess)),
scored AS (
  SELECT *, reward * (1 - 0.2e0) * 0.95e0 AS score,
         CAST(trunc(reward * (1 - 0.2e0) * 0.95e0) AS INTEGER) AS priority
  FROM options)"""

ACTION_SQL = _with(POINTS, NEIGHBOURS, CURVED, DIRECTED, PEAKED, STATES, JUDGED)
ORACLES["action_eligibility"] = ACTION_SQL + "SELECT user_id, action_id, eligible FROM scored"
ORACLES["action_scores"] = ACTION_SQL + (
    f"SELECT user_id, action_id, {r6('reward')}, {r6('score')}, priority FROM scored"
)
ORACLES["action_ranking"] = ACTION_SQL + """
SELECT user_id, action_id, priority,
       CAST(row_number() OVER (PARTITION BY user_id ORDER BY priority DESC, action_order) AS INTEGER) AS rank,
       CAST(sum(priority) OVER (PARTITION BY user_id) AS INTEGER) AS total_priority
FROM scored"""

# -- validation ---------------------------------------------------------------------------------


def _unique(table: str, *columns: str) -> str:
    key = ", ".join(columns)
    return (
        f"SELECT '{table}', 'unique({','.join(columns)})', count(*),"
        f" count(*) - (SELECT count(*) FROM (SELECT DISTINCT {key} FROM {table})) FROM {table}"
    )


def _references(child: str, columns: list[str], parent: str, parent_columns: list[str]) -> str:
    match = " AND ".join(f"p.{there} = c.{here}" for here, there in zip(columns, parent_columns))
    whole = " AND ".join(f"c.{here} IS NOT NULL" for here in columns)
    return (
        f"SELECT '{child}', 'references({','.join(columns)}->{parent})', count(*),"
        f" count(*) FILTER (WHERE {whole} AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE {match})) FROM {child} c"
    )


def _contiguous(table: str, key: str, column: str) -> str:
    return (
        f"SELECT '{table}', 'contiguous({column})', CAST(coalesce(sum(n), 0) AS BIGINT),"
        f" count(*) FILTER (WHERE low <> 0 OR high <> places - 1 OR n <> places)"
        f" FROM (SELECT count(*) AS n, count(DISTINCT {column}) AS places, min({column}) AS low,"
        f" max({column}) AS high FROM {table} GROUP BY {key})"
    )


ORACLES["validate_tables"] = PATHS + (
    "SELECT table_name, rule, n_rows, n_violations, n_violations = 0 AS passed FROM (\n"
    + "\nUNION ALL\n".join(
        [
            "SELECT 'events' AS table_name, 'not_null(user_id)' AS rule, count(*) AS n_rows,"
            " count(*) FILTER (WHERE user_id IS NULL) AS n_violations FROM events",
            "SELECT 'events', 'between(value)', count(*),"
            " count(*) FILTER (WHERE value < 0 OR value > 200) FROM events",
            "SELECT 'events', 'one_of(event_type)', count(*), count(*) FILTER"
            " (WHERE event_type NOT IN ('click', 'view', 'purchase', 'error')) FROM events",
            _unique("events", "user_id", "ts"),
            _unique("lineitem", "l_orderkey", "l_linenumber"),
            _references("lineitem", ["l_orderkey"], "orders", ["o_orderkey"]),
            _references("orders", ["o_custkey"], "customer", ["c_custkey"]),
            _references("supplier", ["s_nationkey"], "nation", ["n_nationkey"]),
            _contiguous("part", "()", "p_partkey"),
            _contiguous("conversations", "conv_id", "turn"),
            "SELECT 'knots', 'not_null(knot_index)', count(*),"
            " count(*) FILTER (WHERE knot_index IS NULL) FROM knots",
            _contiguous("knots", "user_id", "knot_index"),
            _references("knots", ["user_id", "event_id"], "events", ["user_id", "event_id"]),
        ]
    )
    + ")"
)

ORACLES["validate_damaged"] = """
WITH broken AS (
  SELECT count(*) AS n, count(*) FILTER (WHERE o_orderkey % 7 = 3) AS keys,
         count(*) FILTER (WHERE o_orderkey % 11 = 5) AS prices, count(*) FILTER (WHERE o_orderkey % 13 = 1) AS dates
  FROM orders)
SELECT 'orders' AS table_name, rule, n AS n_rows, n_violations, n_violations = 0 AS passed FROM (
  SELECT 'whole_rows' AS rule, n, 0 AS n_violations FROM broken
  UNION ALL SELECT 'cells(o_orderkey)', n, keys FROM broken
  UNION ALL SELECT 'cells(o_custkey)', n, 0 FROM broken
  UNION ALL SELECT 'cells(o_orderstatus)', n, 0 FROM broken
  UNION ALL SELECT 'cells(o_totalprice)', n, prices FROM broken
  UNION ALL SELECT 'cells(o_orderdate)', n, dates FROM broken
  UNION ALL SELECT 'cells(o_orderpriority)', n, 0 FROM broken)"""

_GENERATED = {
    "motions": ("motions", ["motion_id"]),
    "motion_joints": ("joints", ["motion_id", "joint_index"]),
    "animations": ("animations", ["animation_id"]),
    "animation_frames": ("frames", ["animation_id", "frame_id"]),
    "animation_effectors": ("effectors", ["animation_id", "frame_id", "effector_index"]),
}
_DECLARED_FIELDS = {"motions": 4, "motion_joints": 6, "animations": 3, "animation_frames": 5, "animation_effectors": 6}


def _named(sql: str, child: str, parent: str | None = None) -> str:
    """The rule's SQL over the common tables, under the names of the generated ones."""
    sql = sql.replace(f"'{_GENERATED[child][0]}'", f"'{child}'", 1)
    return sql.replace(f"->{_GENERATED[parent][0]})", f"->{parent})", 1) if parent else sql


def _generated_rules() -> list[str]:
    parts = []
    for name, (source, key) in _GENERATED.items():
        fields = _DECLARED_FIELDS[name]
        parts.append(f"SELECT '{name}' AS table_name, 'schema' AS rule, {fields} AS n_rows, 0 AS n_violations")
        parts.append(_named(_unique(source, *key), name))
        parts += [
            f"SELECT '{name}', 'not_null({column})', count(*), count(*) FILTER (WHERE {column} IS NULL) FROM {source}"
            for column in key
        ]
    for child, columns, parent in (
        ("motion_joints", ["motion_id"], "motions"),
        ("animations", ["motion_id"], "motions"),
        ("animation_frames", ["animation_id"], "animations"),
        ("animation_effectors", ["animation_id", "frame_id"], "animation_frames"),
    ):
        parts.append(_named(_references(_GENERATED[child][0], columns, _GENERATED[parent][0], columns), child, parent))
    parts.append(_named(_contiguous("joints", "motion_id", "joint_index"), "motion_joints"))
    parts.append(_named(_contiguous("frames", "animation_id, lod_index", "frame_index"), "animation_frames"))
    parts.append(
        "SELECT 'animation_frames', 'between(time)', count(*), count(*) FILTER (WHERE time < 0 OR time > 1) FROM frames"
    )
    return parts


ORACLES["validate_generated"] = POSED + (
    "SELECT table_name, rule, n_rows, n_violations, n_violations = 0 AS passed FROM (\n"
    + "\nUNION ALL\n".join(_generated_rules())
    + ")"
)
