"""The whole loop of several animals: seeding, prediction, assignment, contacts, and identities by looks after them."""

from __future__ import annotations

import itertools
import math
from bisect import bisect_left, insort
from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vivarium.operators.animals import APART, LEAST_SPREAD, LOOK_FRAMES, LOOKS_NEEDED, Motion, distances, placed
from vivarium.operators.assignment import matched
from vivarium.operators.walks import along_sessions
from vivarium.operators.zones import zone_flags, zone_table

TRACKS = "frame long, animal int, x double, y double, status string, corrections int"


def middle_of(ordered: list[float]) -> float:
    half = len(ordered) // 2
    return ordered[half] if len(ordered) % 2 else (ordered[half - 1] + ordered[half]) / 2


class Looks:
    """The last looks of each animal, from frames in which the animals are clearly apart, as they came and in order."""

    def __init__(self, animals: int):
        self.seen = [deque() for _ in range(animals)]
        self.ordered: list[list[float]] = [[] for _ in range(animals)]

    def add(self, looks: list[float]) -> None:
        for kept, ordered, look in zip(self.seen, self.ordered, looks):
            if math.isfinite(look):
                if len(kept) == LOOK_FRAMES:
                    del ordered[bisect_left(ordered, kept.popleft())]
                kept.append(look)
                insort(ordered, look)

    def model(self) -> tuple[list[float], list[float]] | None:
        """Medians and spreads; none before every animal has looks enough, or while two animals look alike."""
        if any(len(kept) < LOOKS_NEEDED for kept in self.seen):
            return None
        middle = [middle_of(ordered) for ordered in self.ordered]
        spread = [max(LEAST_SPREAD, 1.4826 * middle_of(sorted([abs(v - m) for v in ordered]))) for ordered, m in zip(self.ordered, middle)]
        for a, b in itertools.combinations(range(len(middle)), 2):
            if abs(middle[a] - middle[b]) < APART * math.sqrt((spread[a] * spread[a] + spread[b] * spread[b]) / 2):
                return None
        return middle, spread

    def order(self, looks: list[float]) -> list[int] | None:
        """For each animal the place in `looks` of its own look."""
        model = self.model() if all(map(math.isfinite, looks)) else None
        if model is None:
            return None
        off = [[(look - m) / s for look in looks] for m, s in zip(*model)]
        return matched([[v * v for v in row] for row in off])[1]


class Crew:
    """A session's animals, frame by frame."""

    def __init__(self, animals: int, apart: float):
        self.animals, self.apart = animals, apart
        self.motion: Motion | None = None
        self.held: list[tuple[float, float]] | None = None  # places before all animals were seen at once
        self.looks, self.unclear, self.corrections = Looks(animals), 0, 0

    def step(self, frame: int, spots: list[dict] | None) -> list[tuple]:
        known = placed(spots)
        seen = [(float(s["x"]), float(s["y"])) for s in known]
        looks = [math.nan if s.get("look") is None else float(s["look"]) for s in known]
        status = "lost" if not known else "partial" if len(known) < self.animals else "ok"
        places = self.seeded(seen) if self.motion is None else self.followed(seen, looks)
        return [(frame, a, x, y, status, self.corrections) for a, (x, y) in enumerate(places)]

    def end(self) -> list[tuple]:
        return []

    def seeded(self, seen: list[tuple[float, float]]) -> list[tuple]:
        n = self.animals
        if not seen:
            return [(None, None)] * n if self.held is None else self.held
        if self.held is not None:
            places = list(self.held)
            for a, w in zip(*matched(distances(places, seen))):
                places[a] = seen[w]
        elif len(seen) < n:
            places = seen + seen[:1] * (n - len(seen))
        else:
            places = sorted(seen, key=lambda s: s[0])[:n]
        self.held = places
        if len(seen) >= n:
            self.motion = Motion(places)
        return places

    def followed(self, seen: list[tuple[float, float]], looks: list[float]) -> list[tuple[float, float]]:
        expected = self.motion.predict()
        who, which = matched(distances(expected, seen)) if seen else ([], [])
        self.motion.update(who, [seen[w] for w in which])
        if len(who) == self.animals and self.clear():
            own = [looks[w] for w in which]
            order = self.looks.order(own) if self.unclear else None
            if order is not None and order != list(range(self.animals)):
                self.motion.reorder(order)
                own = [own[a] for a in order]
                self.corrections += 1
            self.looks.add(own)
            self.unclear = 0
        else:
            self.unclear += 1
        return self.motion.at

    def clear(self) -> bool:
        """Each two animals are farther apart than the sum of their bodies."""
        return all(math.hypot(x - u, y - v) > self.apart for (x, y), (u, v) in itertools.combinations(self.motion.at, 2))


def track_animals(detections: DataFrame, animals: int, apart: float) -> DataFrame:
    """(session, frame, animal, x, y, status, corrections) from (session, frame, spots: array<struct<x, y[, look]>>).

    The first frame with a spot for every animal names them from left to right; then each frame's spots go to the predicted
    places at the least summed distance. A place is that of the animal's filter: led by its spot, or coasting without one. status
    is that of the frame: ok, partial with fewer spots than animals, lost without any. Before all animals were seen at once,
    animals keep the places they had, if any. A frame is clear when all animals have a spot and are over `apart` from each other;
    the first clear frame after others is matched by looks, if all animals' looks are known and differ clearly, and
    corrections counts the frames so far that this named otherwise. Looks are learned in clear frames. Spots without a place are left out; a null look is unknown.
    """
    return along_sessions(detections, ["frame", "spots"], lambda: Crew(animals, apart), TRACKS)


def known_tracks(tracks: DataFrame) -> DataFrame:
    """Tracks with places of lost frames unknown and status in the words of a single animal's."""
    lost = (F.col("status") == "lost") | F.col("x").isNull() | F.col("y").isNull()
    place = {c: F.when(~lost, F.col(c)) for c in ("x", "y")}
    return tracks.withColumns(place | {"status": F.when(lost, "Lost").otherwise("Tracked")})


def animal_zones(tracks: DataFrame, zones: DataFrame, min_frames: int, fps: float) -> DataFrame:
    """The zone table of every animal, one below the other: session, animal, zone and the columns of `zone_table`."""
    each = known_tracks(tracks).withColumn("session", F.struct("session", "animal"))
    found = zone_table(zone_flags(each.select("session", "frame", "time_s", "x", "y", "status"), zones), min_frames, fps)
    return found.select("session.session", "session.animal", *found.columns[1:])
