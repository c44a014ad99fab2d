"""The query of cycle indicators, over days on which a supplier traded."""

from __future__ import annotations

from .plans.cycles import cycle
from .queries import c, expressions

_cycle = cycle(c)
expressions("cycles", {"period": _cycle["period"], "in_phase": _cycle["in_phase"] / 1000.0, "phase": _cycle["phase"], "wave": _cycle["wave"], "turning": _cycle["turning"]}, 3, days=True)
