"""Adaptive search for parameters: a tree-structured Parzen sampler, and pruning by the median of earlier trials."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from statistics import median


@dataclass(frozen=True)
class Span:
    """Numbers from ``low`` to ``high``, even in their logarithm if ``log``, whole if ``whole``."""

    low: float
    high: float
    log: bool = False
    whole: bool = False

    def unit(self, value: float) -> float:
        """The value's place between 0 and 1."""
        a, b, v = (math.log(x) if self.log else x for x in (self.low, self.high, value))
        return (v - a) / (b - a)

    def value(self, unit: float) -> float:
        a, b = (math.log(x) if self.log else x for x in (self.low, self.high))
        v = a + (b - a) * min(1.0, max(0.0, unit))
        v = math.exp(v) if self.log else v
        return min(int(self.high), max(int(self.low), round(v))) if self.whole else min(self.high, max(self.low, v))


#: Parameters by name: a span of numbers, or choices.
Space = dict[str, Span | tuple]


@dataclass
class Trial:
    """Parameters, the scores of the folds that were run, and whether it was stopped before the last."""

    params: dict
    scores: list[float] = field(default_factory=list)
    pruned: bool = False

    @property
    def score(self) -> float:
        return sum(self.scores) / len(self.scores) if self.scores else -math.inf


class Sampler:
    """Draws parameters: at random at first, then where good trials lie densely and others don't.

    Trials are parted into the best tenth and the rest.  Each part gives each
    parameter a density: a mixture of normal bumps at its trials' values and a
    broad prior.  Of some candidates from the good density the one with the
    largest ratio of the two is taken, each parameter by itself.
    """

    #: Trials at random at first; candidates of each draw; share and number of good trials at most.
    STARTUP, CANDIDATES, GOOD_SHARE, MOST_GOOD = 10, 24, 0.1, 25

    def __init__(self, space: Space, seed: int = 42):
        self.space, self.rng = space, random.Random(seed)

    def draw(self, trials: list[Trial]) -> dict:
        whole = [t for t in trials if t.scores]
        if len(whole) < self.STARTUP:
            return {k: self.rng.choice(s) if isinstance(s, tuple) else s.value(self.rng.random()) for k, s in self.space.items()}
        # trials that got further come first among pruned ones
        ranked = sorted(whole, key=lambda t: (t.pruned, -t.score))
        n = min(self.MOST_GOOD, max(1, math.ceil(self.GOOD_SHARE * len(ranked))))
        return {k: self._of(s, [t.params[k] for t in ranked[:n]], [t.params[k] for t in ranked[n:]]) for k, s in self.space.items()}

    def _of(self, space: Span | tuple, good: list, rest: list):
        if isinstance(space, tuple):
            weight = lambda values, c: (values.count(c) + 1) / (len(values) + len(space))
            drawn = self.rng.choices(space, [weight(good, c) for c in space], k=self.CANDIDATES)
            return max(drawn, key=lambda c: weight(good, c) / weight(rest, c))
        a, b = ([space.unit(v) for v in values] for values in (good, rest))
        drawn = [self._near(a) for _ in range(self.CANDIDATES)]
        return space.value(max(drawn, key=lambda u: math.log(self._density(a, u)) - math.log(self._density(b, u))))

    @staticmethod
    def _widths(centres: list[float]) -> list[tuple[float, float]]:
        """Bumps: each as wide as the larger gap to its neighbours, within limits; the prior is one over the whole span."""
        points = sorted(centres)
        least = 1 / min(100, 1 + len(points) ** 2)
        padded = [0.0, *points, 1.0]
        return [(c, min(1.0, max(c - padded[i], padded[i + 2] - c, least))) for i, c in enumerate(points)] + [(0.5, 1.0)]

    def _near(self, centres: list[float]) -> float:
        centre, width = self.rng.choice(self._widths(centres))
        while True:
            u = self.rng.gauss(centre, width)
            if 0 <= u <= 1:
                return u

    def _density(self, centres: list[float], u: float) -> float:
        below = lambda x: 0.5 * (1 + math.erf(x / math.sqrt(2)))
        bumps = self._widths(centres)
        inside = ((c, w, below((1 - c) / w) - below(-c / w)) for c, w in bumps)
        return sum(math.exp(-0.5 * ((u - c) / w) ** 2) / (w * math.sqrt(2 * math.pi) * mass) for c, w, mass in inside) / len(bumps) + 1e-12


def search(space: Space, folds: Callable[[dict], Iterable[float]], trials: int, seed: int = 42, sampler: Sampler | None = None, spared: int = 5) -> list[Trial]:
    """Trials in the order in which they were run.

    ``folds`` gives the scores (more is better) of parameters fold by fold; a
    trial ends early when the mean of its folds so far is below the median of the
    means that earlier whole trials had there (the first ``spared`` trials never
    do).  With the same seed the trials are the same.
    """
    sampler, done = sampler or Sampler(space, seed), []
    for _ in range(trials):
        trial = Trial(sampler.draw(done))
        steps = iter(folds(trial.params))
        for score in steps:
            trial.scores.append(score)
            n = len(trial.scores)
            before = [sum(t.scores[:n]) / n for t in done if not t.pruned and len(t.scores) > n]
            if len(done) >= spared and before and trial.score < median(before):
                trial.pruned = True
                break
        done.append(trial)
    return done


def best(trials: list[Trial]) -> Trial:
    """The whole trial of the highest score, the first of equals."""
    return max((t for t in trials if not t.pruned), key=lambda t: t.score)
