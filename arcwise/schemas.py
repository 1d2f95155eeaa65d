"""Explicit schemas of the stored tables; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _D = T.StringType(), T.IntegerType(), T.DoubleType()


def _table(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


MOTION_PROPOSALS = _table(("motion_id", _S), ("joint_count", _I))

MOTIONS = _table(
    ("motion_id", _S),
    ("root_orientation", _D),
    ("root_velocity_orientation", _D),
    ("root_velocity_magnitude", _D),
)

_WAVE = (("orientation_amplitude", _D), ("orientation_phase", _D), ("orientation_phase_offset", _D))

MOTION_JOINTS = _table(("motion_id", _S), ("joint_index", _I), ("position_x", _D), *_WAVE)

ANIMATIONS = _table(("animation_id", _S), ("motion_id", _S), ("resolution", _I))

ANIMATION_FRAMES = _table(
    ("animation_id", _S), ("lod_index", _I), ("frame_index", _I), ("time", _D), ("frame_id", _S)
)

ANIMATION_JOINTS = _table(
    ("motion_id", _S),
    ("joint_index", _I),
    ("position_x", _D),
    *_WAVE,
    ("animation_id", _S),
    ("frame_id", _S),
    ("time", _D),
)

ANIMATION_EFFECTORS = _table(
    ("animation_id", _S),
    ("frame_id", _S),
    ("effector_index", _I),
    ("effector_position_x", _D),
    ("effector_position_y", _D),
    ("effector_orientation", _D),
)

_PATH_KEY = (("animation_id", _S), ("effector_index", _I), ("frame_id", _S))

PATH_CURVATURES = _table(*_PATH_KEY, ("curvature", _D))
PATH_CURVATURE_PEAKS = _table(*_PATH_KEY, ("peak_type", _S))
PATH_TANGENTS = _table(*_PATH_KEY, ("tangent", _D))
PATH_BISECTORS = _table(*_PATH_KEY, ("bisector_x", _D), ("bisector_y", _D))
SPLINE_KNOTS = _table(*_PATH_KEY, ("knot_index", _I))

REFINED_FRAMES = _table(
    ("animation_id", _S),
    ("effector_index", _I),
    ("lod_index", _I),
    ("frame_index", _I),
    ("time", _D),
    ("resolution", _I),
    ("x", _D),
    ("y", _D),
    ("curvature", _D),
    ("is_positive_peak", T.BooleanType()),
    ("is_negative_peak", T.BooleanType()),
    ("is_crossover", T.BooleanType()),
    ("time_factor", _D),
    ("h", _D),
)

STATE_PARAMS = _table(("state_id", _S), ("param_value", _D), ("param_name", _S))

MOTION_DOCUMENTS = _table(
    (
        "motions",
        T.ArrayType(
            _table(
                ("id", _S),
                ("root", _table(("orientation", _D), ("velocity_orientation", _D), ("velocity_magnitude", _D))),
                ("joints", T.ArrayType(_table(("position_x", _D), *_WAVE))),
            )
        ),
    )
)

ANIMATION_DOCUMENTS = _table(
    (
        "animations",
        T.ArrayType(
            _table(
                ("id", _S),
                (
                    "frames",
                    T.ArrayType(
                        _table(
                            ("time", _D),
                            (
                                "effectors",
                                T.ArrayType(
                                    _table(("position_x", _D), ("position_y", _D), ("orientation", _D))
                                ),
                            ),
                            ("joints", T.ArrayType(_table(("position_x", _D), ("orientation", _D)))),
                        )
                    ),
                ),
            )
        ),
    )
)
