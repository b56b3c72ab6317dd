"""Synthetic point families, in units of their spread, with labels (-1: noise or bridge).

A family is a table of parts; one builder draws them in the order of the table.
"""

from __future__ import annotations

from functools import partial

import numpy as np

# The published families. A part is (shape, place, spread, number of points, label);
# the order of parts is the order in which random numbers are drawn.
TURNS = (0.2, 4.0 * np.pi)  # of an arm: its angle, which is its radius too
PARTS = {
    "spiral": (("arm", 1.0, 0.45, 600, 0), ("arm", -1.0, 0.45, 600, 1)),
    "varying_density": (("cloud", (-2.0, 0.0), (0.18, 0.18), 500, 0), ("cloud", (1.2, 0.0), (0.65, 0.65), 900, 1), ("cloud", (0.0, 2.0), (0.32, 0.75), 500, 2)),
    "touching": (("cloud", (-0.55, 0.0), (0.42, 0.18), 700, 0), ("cloud", (0.55, 0.0), (0.42, 0.18), 700, 1), ("cloud", (0.0, 0.0), (0.05, 0.05), 40, -1)),
    "chain_noise": (("cloud", (-2.0, 0.0), 0.22, 500, 0), ("cloud", (2.0, 0.0), 0.22, 500, 1), ("bridge", (-1.45, 1.45), 0.035, 80, -1)),
}


def in_spreads(points: np.ndarray) -> np.ndarray:
    """Points about their mean, each coordinate by its spread; one without a spread stays 0."""
    off = points - points.mean(axis=0)
    spread = np.sqrt((off * off).mean(axis=0))
    return np.divide(off, spread, out=np.zeros_like(off), where=spread >= 1e-12)


def _draw(rng: np.random.Generator, shape: str, place, spread, n: int) -> np.ndarray:
    if shape == "arm":  # the second arm is the first one turned by half a circle
        angle = np.linspace(*TURNS, n)
        curve = place * angle * np.exp(1j * angle)
        return np.stack([curve.real, curve.imag], axis=1) + rng.normal(0, spread, size=(n, 2))
    if shape == "bridge":  # evenly along the first axis
        return np.stack([np.linspace(*place, n), rng.normal(0, spread, size=n)], axis=1)
    return rng.normal(place, spread, size=(n, 2))


def family(name: str, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    drawn = [_draw(rng, *part[:4]) for part in PARTS[name]]
    return in_spreads(np.concatenate(drawn)), np.repeat([float(part[4]) for part in PARTS[name]], [part[3] for part in PARTS[name]])


FAMILIES = {name: partial(family, name) for name in PARTS}


def moons(seed: int, n: int = 1200, noise: float = 0.07):
    """Two half circles that reach into each other."""
    rng = np.random.default_rng(seed)
    t = np.linspace(0, np.pi, n // 2)
    p = np.vstack([np.c_[np.cos(t), np.sin(t)], np.c_[1 - np.cos(t), 0.5 - np.sin(t)]])
    return in_spreads(p + rng.normal(0, noise, p.shape)), np.repeat([0.0, 1.0], n // 2)


def circles(seed: int, n: int = 1200, noise: float = 0.04, factor: float = 0.42):
    """A circle within a circle."""
    rng = np.random.default_rng(seed)
    t = np.linspace(0, 2 * np.pi, n // 2, endpoint=False)
    ring = np.c_[np.cos(t), np.sin(t)]
    p = np.vstack([ring, factor * ring])
    return in_spreads(p + rng.normal(0, noise, p.shape)), np.repeat([0.0, 1.0], n // 2)


def anisotropic(seed: int, n: int = 1500):
    """Three sheared clouds."""
    centres = ((-6.0, -4.0), (0.0, 3.0), (6.0, -2.0))
    rng = np.random.default_rng(seed)
    p = np.concatenate([_draw(rng, "cloud", c, 1.0, n // 3) for c in centres])
    return in_spreads(p @ np.array([[0.6, -0.6], [-0.4, 0.8]])), np.repeat([0.0, 1.0, 2.0], n // 3)


def uniform_noise(seed: int, n: int = 1200, extra: int = 250):
    """Four clouds among evenly spread points."""
    rng = np.random.default_rng(seed)
    p = [_draw(rng, "cloud", (x, y), 0.5, n // 4) for x in (-4, 4) for y in (-4, 4)]
    return in_spreads(np.concatenate([*p, rng.uniform(-7, 7, (extra, 2))])), np.concatenate([np.repeat(np.arange(4.0), n // 4), np.full(extra, -1.0)])


MORE_FAMILIES = {"moons": moons, "circles": circles, "anisotropic": anisotropic, "uniform_noise": uniform_noise}


def resized(p: np.ndarray, n: int, seed: int) -> np.ndarray:
    """``n`` rows: fewer are drawn without replacement, more with, moved by a hundredth of the spread."""
    rng = np.random.default_rng(seed)
    if n <= len(p):
        return p[rng.choice(len(p), n, replace=False)]
    return p[rng.choice(len(p), n)] + rng.normal(0, 0.01, (n, p.shape[1])) * p.std(axis=0)
