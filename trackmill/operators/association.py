"""Which detection of a frame continues which track: costs, gates, vetoes and assignment in three phases.

These are the inside of the tracker's step, on arrays of one frame: a video's frames depend on each other and are a
state, its videos are what Spark distributes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Costs of a pair that is ruled out by a gate or veto, and of one that can't be for its distance.
VETO, NEVER = 1e6, 1e9


@dataclass(frozen=True)
class Rules:
    """Fixed values of the association; distances in pixels."""

    reach: float = 100.0  # the most a cost or a distance may be
    grown: int = 10  # matches in a row that establish a track
    young_gate: float = 1.0  # reach of tracks that aren't established, as a multiple
    body: float = 20.0
    speed_gate: float = 2.0  # reach of established tracks a frame, in body lengths
    respawn: float | None = None  # least distance of a new track to others; 0.8 reach if None
    greedy: bool = False
    mahalanobis: bool = False
    place: float = 1.0
    turn: float = 0.0
    area: float = 0.0
    aspect: float = 0.0
    tag_bonus: float = 20.0
    tag_penalty: float = 50.0
    class_bonus: float = 20.0
    class_penalty: float = 50.0
    motion_gate: float = 1.4
    area_ratio: float = 2.5
    aspect_change: float = 0.8
    pose_apart: float = 0.5
    pose_seen: float = 0.5


@dataclass
class Tracks:
    """What is known of n tracks: predicted place and heading, and what they last looked like. Absent features are None or NaN, tags and classes below 0."""

    at: np.ndarray  # (n, 3)
    inverse: np.ndarray | None = None  # (n, 2, 2) inverse covariances of the place
    area: np.ndarray | None = None
    aspect: np.ndarray | None = None
    spread: np.ndarray | None = None  # uncertainty of the place
    stride: np.ndarray | None = None  # mean step
    tag: np.ndarray | None = None
    classes: np.ndarray | None = None  # (n, phases)
    pose: np.ndarray | None = None  # (n, keypoints, 2), NaN where unseen


@dataclass
class Seen:
    """m detections of a frame, in the same features; directed tells headings from axes, visible is the share of keypoints seen."""

    at: np.ndarray
    directed: np.ndarray | None = None
    area: np.ndarray | None = None
    aspect: np.ndarray | None = None
    tag: np.ndarray | None = None
    classes: np.ndarray | None = None
    pose: np.ndarray | None = None
    visible: np.ndarray | None = None


def distances(tracks: Tracks, seen: Seen, mahalanobis: bool = False) -> np.ndarray:
    """(n, m) distances of places, in pixels or in standard deviations of what each track expects."""
    apart = seen.at[None, :, :2] - tracks.at[:, None, :2]
    return np.sqrt(np.einsum("nmi,nij,nmj->nm", apart, tracks.inverse, apart) if mahalanobis else (apart**2).sum(axis=2))


def turns(tracks: Tracks, seen: Seen) -> np.ndarray:
    """(n, m) angles between headings, at most a right angle where a detection has only an axis."""
    turn = np.abs((seen.at[None, :, 2] - tracks.at[:, None, 2] + np.pi) % (2 * np.pi) - np.pi)
    axis = np.ones(len(seen.at), bool) if seen.directed is None else ~seen.directed.astype(bool)
    return np.where(axis[None, :], np.minimum(turn, np.pi - turn), turn)


def _changes(one: np.ndarray | None, two: np.ndarray | None) -> np.ndarray | float:
    """Differences of a feature that both sides have; nothing is held against one that is absent."""
    return 0.0 if one is None or two is None else np.nan_to_num(np.abs(two[None, :] - one[:, None]))


def motion_gates(tracks: Tracks, rules: Rules) -> np.ndarray:
    """How far each track's detection may lie: wider for one whose place is uncertain or that moves in long steps."""
    none = np.zeros(len(tracks.at))
    spread, stride = (none if x is None else x for x in (tracks.spread, tracks.stride))
    body = max(1.0, rules.body)
    return rules.reach * rules.motion_gate * (1 + 0.5 * np.minimum(2, spread / body**2) + 0.35 * np.minimum(2, stride / body))


def candidates(tracks: Tracks, seen: Seen, rules: Rules) -> np.ndarray:
    """(n, m) whether a pair passes the gates of place, area and aspect."""
    near = distances(tracks, seen, rules.mahalanobis) <= motion_gates(tracks, rules)[:, None]
    if tracks.area is not None and seen.area is not None:
        one, two = np.maximum(tracks.area, 1e-6)[:, None], np.maximum(seen.area, 1e-6)[None, :]
        near &= ~(np.maximum(one, two) / np.minimum(one, two) > rules.area_ratio)
    return near & ~(_changes(tracks.aspect, seen.aspect) > rules.aspect_change)


def pose_distances(one: np.ndarray, two: np.ndarray, least: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(n, m) mean distances of the keypoints that both poses show, NaN where fewer than ``least`` are; and how many are."""
    apart = np.sqrt(((one[:, None] - two[None, :]) ** 2).sum(axis=3))
    shared = np.isfinite(apart).sum(axis=2)
    total = np.where(np.isfinite(apart), apart, 0).sum(axis=2)
    return np.where(shared >= least, total / np.maximum(shared, 1), np.nan), shared


def identity(tracks: Tracks, seen: Seen, rules: Rules) -> np.ndarray | float:
    """(n, m) what known identities add to a cost: a bonus where they agree, a penalty where not, shared among the factors there are."""
    factors = []
    if tracks.tag is not None and seen.tag is not None and (tracks.tag >= 0).any() and (seen.tag >= 0).any():
        factors.append((tracks.tag, seen.tag, rules.tag_bonus, rules.tag_penalty))
    if tracks.classes is not None and seen.classes is not None:
        factors += [(tracks.classes[:, k], seen.classes[:, k], rules.class_bonus, rules.class_penalty) for k in range(seen.classes.shape[1])]
    total = 0.0
    for one, two, bonus, penalty in factors:
        known = (one >= 0)[:, None] & (two >= 0)[None, :]
        total = total + np.where(known, np.where(one[:, None] == two[None, :], -bonus, penalty), 0.0) / len(factors)
    return total


def costs(tracks: Tracks, seen: Seen, rules: Rules) -> np.ndarray:
    """(n, m) costs. Pairs out of reach, and with poses those that fail the gates or whose poses don't fit, cost VETO or about that."""
    posed = tracks.pose is not None and seen.pose is not None
    place = distances(tracks, seen, rules.mahalanobis)
    cull = max(rules.reach, motion_gates(tracks, rules).max(initial=0)) if posed else rules.reach
    cost = rules.place * place + rules.turn * turns(tracks, seen) + rules.area * _changes(tracks.area, seen.area) + rules.aspect * _changes(tracks.aspect, seen.aspect)
    cost = np.where(place > cull, VETO, cost) + identity(tracks, seen, rules)
    if not posed:
        return cost
    allowed = candidates(tracks, seen, rules)
    if allowed.any():
        cost = np.where(allowed, cost, VETO)
    apart, shared = pose_distances(tracks.pose, seen.pose)
    visible = np.clip(np.zeros(len(seen.at)) if seen.visible is None else seen.visible, 0, 1)[None, :]
    unsure = (shared > 0) & ((shared <= 3) | (visible < min(1.0, rules.pose_seen + 0.15)))
    limit = rules.pose_apart * np.where(unsure, 1.2, 1.0)
    return np.where(allowed & (visible >= rules.pose_seen) & (apart > limit), VETO, cost)


def assign_in_phases(cost: np.ndarray, tracks: Tracks, seen: Seen, lost: np.ndarray, matched: np.ndarray, started: np.ndarray, rules: Rules, solve) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(continued, begun): (slot, detection) pairs of tracks that go on, and of slots in which a track begins.

    Established tracks are assigned together, by ``solve`` (the least total) or greedily, and pairs out of bounds are let go.
    Then each young track, the longest matched first, takes the cheapest detection that is left, or none if that is
    out of its bounds. What is left and far from all tracks that aren't lost begins a track in the nearest lost slot within
    reach, or in one that was never used.
    """
    raw = distances(tracks, seen)
    old = (matched >= rules.grown) & ~lost
    gate = np.where(matched < rules.grown, rules.reach * max(1.0, rules.young_gate), rules.reach)
    cost = np.where(raw >= gate[:, None], NEVER, cost)
    ids, fits = np.flatnonzero(old), (cost < rules.reach) & (raw < rules.speed_gate * rules.body)
    if rules.greedy:
        pairs = []
        for i, j in sorted(((i, j) for i in ids.tolist() for j in np.flatnonzero(fits[i]).tolist()), key=lambda p: (cost[p], p)):
            if all(i != a and j != b for a, b in pairs):
                pairs.append((i, j))
    else:
        pairs = [(int(ids[i]), j) for i, j in solve(cost[ids]) if fits[ids[i], j]] if len(ids) and len(seen.at) else []
    free = np.ones(len(seen.at), bool)
    free[[j for _, j in pairs]] = False
    young = np.flatnonzero(~old & ~lost)
    for i in young[np.argsort(-matched[young], kind="stable")].tolist():
        if not free.any():
            break
        j = int(np.where(free, cost[i], np.inf).argmin())
        if cost[i, j] < rules.reach and raw[i, j] < gate[i]:
            pairs.append((i, j))
            free[j] = False
    begun, open_slots = [], lost.copy()
    least = 0.8 * rules.reach if rules.respawn is None else rules.respawn
    for j in np.flatnonzero(free).tolist():
        if (raw[~lost, j] < least).any():
            continue
        near = np.where(open_slots & started & (raw[:, j] < rules.reach), raw[:, j], np.inf)
        unused = np.flatnonzero(open_slots & ~started)
        i = int(near.argmin()) if len(near) and np.isfinite(near).any() else int(unused[0]) if len(unused) else None
        if i is not None:
            begun.append((i, j))
            open_slots[i] = False
    return pairs, begun


def confidence(cost: np.ndarray, rules: Rules) -> np.ndarray:
    """Of a pair's cost: 1 for none, a half at half the reach."""
    return 1 / (1 + cost / (0.5 * rules.reach))
