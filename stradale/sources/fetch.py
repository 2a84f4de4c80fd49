"""Driver-side fetching of ways from a network service: capped exponential backoff, paced.

The service itself is given as a function; no service is contacted by this package.
"""

from __future__ import annotations

import time
from collections.abc import Callable


class NoWays(Exception):
    """A service's answer that a place has no ways: a result, not a failure."""


def fetch(ask: Callable[[], list], attempts: int = 5, first: float = 1.0, most: float = 60.0, pace: float = 0.0, sleep=time.sleep) -> list:
    """ask() with retries; no ways give an empty list at once; the last failure is raised."""
    wait = first
    for k in range(attempts):
        try:
            out = ask()
            sleep(pace)
            return out
        except NoWays:
            return []
        except Exception:
            if k == attempts - 1:
                raise
            sleep(min(wait, most))
            wait *= 2
    return []


def warp(image, out_shape: tuple[int, int], to_source):
    """Bilinear resampling: `to_source(rows, cols)` gives source coordinates; outside is 0."""
    import numpy as np

    r, c = np.indices(out_shape)
    y, x = to_source(r.astype(float), c.astype(float))
    h, w = image.shape[:2]
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    out = np.zeros((*out_shape, *image.shape[2:]), float)
    for dy in (0, 1):
        for dx in (0, 1):
            yy, xx = y0 + dy, x0 + dx
            ok = (yy >= 0) & (yy < h) & (xx >= 0) & (xx < w)
            part = (1 - np.abs(y - yy)) * (1 - np.abs(x - xx)) * ok
            v = image[np.clip(yy, 0, h - 1), np.clip(xx, 0, w - 1)]
            out += part.reshape(part.shape + (1,) * (v.ndim - 2)) * v
    return out
