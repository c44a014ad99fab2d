"""Cycle indicators: the dominant period, and the phase of a series by a Hilbert transform of fixed taps.

The transform is a filter of four taps about the row three before, which turns every period by a quarter and, with a gain that depends on
the period, keeps its size.  The period comes first: of a wave with w radians a row, the sum of the rows on both
sides of a row is 2 cos(w) times the row, so a window's regression without a constant gives w.  The gain
at that w then scales the turned series, so the phase of a pure wave is exact.
"""

from __future__ import annotations

import math

from ..functions.expr import Expr, angle, arc_cosine, delay, lit, sine, ts_sum, where

TAPS = (0.0962, 0.5769)  # fixed values: of the rows 0 and 2 before; with the other sign of 6 and 4


def turned(x: Expr) -> Expr:
    """A quarter turn of the rows up to six before, about the row three before."""
    return x * TAPS[0] + delay(x, 2) * TAPS[1] - delay(x, 4) * TAPS[1] - delay(x, 6) * TAPS[0]


def smooth(x: Expr) -> Expr:
    return (x * 4.0 + delay(x, 1) * 3.0 + delay(x, 2) * 2.0 + delay(x, 3)) / 10.0


def detrended(x: Expr) -> Expr:
    """The smoothed series turned once: without its level."""
    return turned(smooth(x))


def radians(d: Expr, n: int) -> Expr:
    """Radians a row of the wave in ``d``, from the last n rows; null where the rows fit no wave."""
    mid = delay(d, 1)
    both = d + delay(d, 2)
    return arc_cosine(ts_sum(both * mid, n, n) / ts_sum(mid * mid, n, n) / 2.0)


def cycle(x: Expr, n: int = 16) -> dict[str, Expr]:
    """period, in_phase and quadrature of the detrended series three rows before, phase and its sine now, and an eighth of a turn ahead."""
    d = detrended(x)
    w = radians(d, n)
    gain = (sine(w) * TAPS[1] + sine(w * 3.0) * TAPS[0]) * 2.0
    i, q = delay(d, 3), turned(d) / gain * -1.0  # the turned series runs ahead
    phase = angle(q, i) + w * 3.0
    # Within half a turn on either side.
    phase = where(phase > math.pi, phase - 2 * math.pi, phase)
    ahead = sine(phase + math.pi / 4)
    return {"period": where(w > 0, lit(2 * math.pi) / w, None), "in_phase": i, "quadrature": q, "phase": phase, "wave": sine(phase), "lead_wave": ahead, "turning": where((sine(phase) > ahead) & (delay(sine(phase), 1) <= delay(ahead, 1)), 1.0, 0.0)}
