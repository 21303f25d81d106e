"""From candidate points to smooth pieces of flight: the order-dependent part, one group for each shot.

A group holds the candidates of one shot. Long shots may be cut beforehand wherever no candidate stands for longer than
every look-back (see split_spans), which changes nothing and bounds the groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import TrackParams
from .folds import changes

PIECE = "piece int, fa int, fb int, n int, rms double, cx array<double>, cy array<double>, frames array<int>, xs array<double>, ys array<double>, scores array<double>, outliers int"


@dataclass
class Chain:
    """Detections that one motion may have made, in order of frames."""

    frames: list[int] = field(default_factory=list)
    points: list[np.ndarray] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)

    def add(self, frame: int, point: np.ndarray, score: float) -> Chain:
        self.frames.append(frame)
        self.points.append(point)
        self.scores.append(score)
        return self

    def motion(self) -> np.ndarray | None:
        """Pixels a frame over the last step; unknown for a single point."""
        return None if len(self.frames) < 2 else (self.points[-1] - self.points[-2]) / (self.frames[-1] - self.frames[-2])


@dataclass
class Walk:
    """A walk over frames in order that links candidates to chains; it may stop after any frame and go on later.

    A candidate may follow a chain within reach of its last point and near its predicted one. All such pairs of a frame are
    taken greedily by distance over tolerance less 0.3 times the score; candidates left over begin chains. A chain ends
    after link_gap frames without a point; ended ones come before open ones, as selection breaks ties by this order.
    """

    width: float
    fps: float
    p: TrackParams
    ended: list[Chain] = field(default_factory=list)
    open: list[Chain] = field(default_factory=list)

    def chains(self) -> list[Chain]:
        return self.ended + self.open

    def step(self, frame: int, points: np.ndarray, scores: np.ndarray) -> None:
        reach = self.p.max_speed * self.width * 25.0 / self.fps
        self.ended += [c for c in self.open if frame - c.frames[-1] > self.p.link_gap]
        self.open = [c for c in self.open if frame - c.frames[-1] <= self.p.link_gap]
        offers = []
        for k, c in enumerate(self.open):
            ahead, v = frame - c.frames[-1], c.motion()
            expected = c.points[-1] if v is None else c.points[-1] + v * ahead
            tolerance = reach * ahead if v is None else 0.012 * self.width + 0.5 * float(np.hypot(*v)) * ahead
            near = np.hypot(*(points - c.points[-1]).T) <= reach * ahead
            miss = np.hypot(*(points - expected).T)
            offers += [(miss[j] / max(tolerance, 1e-6) - 0.3 * scores[j], k, j) for j in np.flatnonzero(near & (miss <= tolerance)).tolist()]
        busy: set[int] = set()
        taken: set[int] = set()
        for _, k, j in sorted(offers):
            if k not in busy and j not in taken:
                busy.add(k)
                taken.add(j)
                self.open[k].add(frame, points[j], float(scores[j]))
        self.open += [Chain().add(frame, points[j], float(scores[j])) for j in range(len(points)) if j not in taken]


def link(by_frame: dict[int, tuple[np.ndarray, np.ndarray]], width: float, fps: float, p: TrackParams) -> list[Chain]:
    """Chains from a walk over the frames; by_frame has points and scores of the candidates that are strong enough."""
    walk = Walk(width, fps, p)
    for frame in sorted(by_frame):
        walk.step(frame, *by_frame[frame])
    return walk.chains()


def select(chains: list[Chain], width: float, p: TrackParams) -> dict[int, tuple[np.ndarray, float]]:
    """One detection a frame: long chains first, then by total score; a chain gives what others have left it."""
    chosen: dict[int, tuple[np.ndarray, float]] = {}
    moving = [c for c in chains if len(c.frames) < 6 or np.ptp(np.array(c.points), axis=0).sum() >= 0.004 * width]
    for c in sorted(moving, key=lambda c: (len(c.frames) < p.min_tracklet, -sum(c.scores))):
        free = [k for k, f in enumerate(c.frames) if f not in chosen]
        if len(c.frames) < p.min_tracklet:
            free = [k for k in free if c.scores[k] >= 0.5]
        elif len(free) < 2:
            continue
        chosen |= {c.frames[k]: (c.points[k], c.scores[k]) for k in free}
    return chosen


def _fit(frames: np.ndarray, xy: np.ndarray, degree: int = 2) -> np.ndarray:
    """Coefficients (constant first, x and y as columns) of least squares in frames since the first, padded to a quadratic."""
    t = (frames - frames[0]).astype(float)
    degree = min(degree, len(frames) - 1)
    c = np.linalg.lstsq(np.vander(t, degree + 1, increasing=True), xy, rcond=None)[0]
    return np.vstack([c, np.zeros((2 - degree, 2))])


@lru_cache(maxsize=65536)
def _weights(t: tuple[int, ...]) -> np.ndarray:
    """The weights with which values at times t give the value at 0 of their line, or from four on of their quadratic, by least squares."""
    return np.linalg.pinv(np.vander(np.array(t, float), 2 if len(t) < 4 else 3, increasing=True))[0]


def _residuals(c: np.ndarray, frames: np.ndarray, xy: np.ndarray) -> np.ndarray:
    t = (frames - frames[0]).astype(float)
    return np.hypot(*(np.vander(t, 3, increasing=True) @ c - xy).T)


def inliers(frames: np.ndarray, xy: np.ndarray, scores: np.ndarray, width: float, fps: float, p: TrackParams) -> np.ndarray:
    """Which detections short polynomials through their neighbours before or after predict.

    The worst is taken out and all are judged again until none is beyond its tolerance. A pair of sure detections within two
    frames at a possible speed vouches for each other.
    """
    live = list(range(len(frames)))
    reach = p.max_speed * width * 25.0 / fps

    def from_side(i: int, side: list[int]) -> float:
        t = frames[side] - frames[i]
        at = _weights(tuple(t.tolist())) @ xy[side]
        pace = np.hypot(*(xy[side[-1]] - xy[side[0]])) / max(1, frames[side[-1]] - frames[side[0]])
        return float(np.hypot(*(at - xy[i]))) / ((0.008 * width + 0.35 * pace * min(abs(t[0]), abs(t[-1]))) * (1 + 0.6 * scores[i]))

    def judge(at: int) -> float:
        i = live[at]
        before = [j for j in live[max(0, at - 4) : at] if frames[i] - frames[j] <= p.max_gap]
        after = [j for j in live[at + 1 : at + 5] if frames[j] - frames[i] <= p.max_gap]
        trials = [before[-k:] for k in (2, 3, 4) if len(before) >= k] + [after[:k] for k in (2, 3, 4) if len(after) >= k]
        best = min((from_side(i, s) for s in trials), default=10.0)
        if best > 1:
            for j in before[-1:] + after[:1]:
                apart = abs(int(frames[j] - frames[i]))
                if apart <= 2 and np.hypot(*(xy[j] - xy[i])) <= reach * apart and scores[i] + scores[j] >= 1.35:
                    return 0.9
        return best

    errors = [judge(k) for k in range(len(live))]
    while live:
        worst = int(np.argmax(errors))
        if errors[worst] <= 1:
            break
        del live[worst], errors[worst]
        for k in range(max(0, worst - 4), min(len(live), worst + 4)):  # nobody looks further than four
            errors[k] = judge(k)
    keep = np.zeros(len(frames), bool)
    keep[live] = True
    return keep


def segment(frames: np.ndarray, xy: np.ndarray, tol: float, max_gap: int) -> tuple[list[list[int]], set[int]]:
    """Pieces (places of detections) that one quadratic fits within tol, grown from left to right, and lone outliers in them.

    A detection that does not fit is skipped if the next one or two would. Where a piece ends without a gap, the next begins at
    its last detection, unless the piece is too short to share it.
    """
    n, pieces, lone, begin = len(frames), [], set(), 0
    joins = lambda a, b: b < n and frames[b] - frames[a] <= max_gap + 1
    fits = lambda m: len(m) <= 3 or _residuals(_fit(frames[m], xy[m]), frames[m], xy[m]).max() <= tol
    strictly = lambda m: _residuals(_fit(frames[m], xy[m]), frames[m], xy[m]).max() <= tol
    while begin < n:
        own, j = [begin], begin + 1
        while joins(own[-1], j):
            if fits([*own, j]):
                own.append(j)
                j += 1
            elif joins(own[-1], j + 1) and strictly([*own, j + 1]) and (not joins(j + 1, j + 2) or strictly([*own, j + 1, j + 2])):
                lone.add(j)
                own.append(j + 1)
                j += 2
            else:
                break
        pieces.append(own)
        if j >= n:
            break
        begin = own[-1] if joins(own[-1], j) and len(own) >= 3 else j
    return pieces, lone


def pieces_of(by_frame: dict[int, tuple[np.ndarray, np.ndarray]], width: float, fps: float, p: TrackParams) -> tuple[list[dict], int]:
    """The fitted pieces of one shot, and how many detections were taken out."""
    return fitted(link(by_frame, width, fps, p), width, fps, p)


def fitted(chains: list[Chain], width: float, fps: float, p: TrackParams) -> tuple[list[dict], int]:
    """The pieces that the chains of a whole span give, as rows of PIECE, and how many detections were taken out."""
    chosen = select(chains, width, p)
    frames = np.array(sorted(chosen), int)
    if not len(frames):
        return [], 0
    xy, scores = np.array([chosen[f][0] for f in frames]), np.array([chosen[f][1] for f in frames])
    keep = inliers(frames, xy, scores, width, fps, p)
    out = int((~keep).sum())
    frames, xy, scores = frames[keep], xy[keep], scores[keep]
    if not len(frames):
        return [], out
    tol = p.fit_tol * width
    found, lone = segment(frames, xy, tol, p.piece_inner_gap)
    out += len(lone)
    rows = []
    for number, own in enumerate(found):
        m = np.array([k for k in own if k not in lone])
        pair = len(m) == 2 and scores[m].sum() >= 1.2 and frames[m[1]] - frames[m[0]] <= 2
        if len(m) < p.min_piece_dets and not pair:
            continue
        c = _fit(frames[m], xy[m])
        far = _residuals(c, frames[m], xy[m]) > 1.5 * tol
        if far.any() and (~far).sum() >= p.min_piece_dets:
            out += int(far.sum())
            lone |= set(m[far].tolist())
            m = m[~far]
            c = _fit(frames[m], xy[m])
        rms = float(np.sqrt(np.mean(_residuals(c, frames[m], xy[m]) ** 2)))
        rms = max(rms, 0.5 * tol) if len(m) < p.min_piece_dets else rms
        rows.append({"piece": number, "fa": int(frames[m[0]]), "fb": int(frames[m[-1]]), "n": len(m), "rms": rms, "cx": c[:, 0].tolist(), "cy": c[:, 1].tolist(), "frames": frames[m].tolist(), "xs": xy[m, 0].tolist(), "ys": xy[m, 1].tolist(), "scores": scores[m].tolist()})
    return rows, out


def quiet_frames(p: TrackParams) -> int:
    """Frames without a candidate across which no step of the tracker sees."""
    return max(p.link_gap, p.max_gap, p.piece_inner_gap + 1) + 1


def split_spans(candidates: DataFrame, keys: list[str], p: TrackParams) -> DataFrame:
    """candidates with `span`, a number that grows wherever no step of the tracker can see across."""
    quiet = quiet_frames(p)
    w = Window.partitionBy(*keys).orderBy("frame")
    new = F.coalesce((F.col("frame") - F.lag("frame").over(w) > quiet).cast("int"), F.lit(0))
    return candidates.withColumn("_q", new).withColumn("span", F.sum("_q").over(w.rangeBetween(Window.unboundedPreceding, 0))).drop("_q")


def fit_pieces(candidates: DataFrame, keys: list[str], width: float, fps: float, p: TrackParams = TrackParams()) -> DataFrame:
    """candidates (keys, frame, cand_idx, x, y, score) -> keys, span and PIECE, one row for each piece."""
    spans = split_spans(candidates.where(F.col("score") >= p.min_score).select(*keys, "frame", "cand_idx", "x", "y", "score"), keys, p)
    names = [c.split()[0] for c in PIECE.split(", ")]

    group = [*keys, "span"]

    def pieces(pdf: pd.DataFrame, a: int, b: int) -> list[tuple]:
        """The pieces of one span, rows a to b in order of frames."""
        frames, xy, scores = pdf["frame"].to_numpy()[a:b], pdf[["x", "y"]].to_numpy(float)[a:b], pdf["score"].to_numpy(float)[a:b]
        at = np.flatnonzero(np.r_[True, frames[1:] != frames[:-1], True]).tolist()
        by_frame = {int(frames[i]): (xy[i:j], scores[i:j]) for i, j in zip(at, at[1:], strict=False)}
        rows, out = pieces_of(by_frame, width, fps, p)
        head = tuple(pdf[c].iloc[a] for c in group)
        return [(*head, *(r | {"outliers": out if k == 0 else 0}).values()) for k, r in enumerate(rows)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None  # a span may go on in the next batch
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            new = np.flatnonzero(np.r_[True, changes(pdf, group)]).tolist() if len(pdf) else [0]
            rest = pdf.iloc[new[-1] :].reset_index(drop=True)
            yield pd.DataFrame([r for a, b in zip(new, new[1:], strict=False) for r in pieces(pdf, a, b)], columns=[*group, *names])
        if rest is not None and len(rest):
            yield pd.DataFrame(pieces(rest, 0, len(rest)), columns=[*group, *names])

    head = ", ".join(f"{c} {spans.schema[c].dataType.simpleString()}" for c in group)
    ordered = spans.repartition(*group).sortWithinPartitions(*group, "frame", "cand_idx")
    return ordered.mapInPandas(run, f"{head}, {PIECE}")
