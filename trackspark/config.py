"""Constants and tuning values. Fixed values that results depend on are stated here once."""

from __future__ import annotations

from dataclasses import dataclass

FLAG_INTERPOLATED, FLAG_BOUNCE, FLAG_HIT = 1, 2, 4
REQUIRED_FIELDS = ("t", "x", "y", "r", "conf", "ring", "flags")
OPTIONAL_DEFAULTS = {"sl": 0.0, "sa": 0.0}
DEFAULT_RING = "#f5f5f5"
#: Tolerances on times: of intervals and of the overlay's lookup, of the preview's lookup.
EPS, EPS_PREVIEW = 1e-6, 1e-9
#: A probe is interpolated over at most so many frames, and matched to a row within so many.
INTERP_FRAMES, NEAREST_FRAMES = 2.5, 0.5
BLACK, WHITE, MAGENTA = "#101010", "#f5f5f5", "#ff00ff"
RADIUS_MIN, RADIUS_MAX = 0.0012, 0.0065


@dataclass(frozen=True)
class TrackParams:
    """Tracker settings; lengths are fractions of the frame width, times are frames."""

    min_score: float = 0.15
    max_speed: float = 0.07  # per frame at 25 frames a second
    link_gap: int = 4
    max_gap: int = 8
    static_radius: float = 0.0035
    static_min_frames: int = 4
    static_min_span: int = 12
    static_min_visits: int = 3
    min_tracklet: int = 3
    fit_tol: float = 0.0045
    min_piece_dets: int = 3
    piece_inner_gap: int = 3
    min_conf: float = 0.35
