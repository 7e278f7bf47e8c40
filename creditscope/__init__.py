"""creditscope: revolving-credit portfolio analytics as Spark DataFrame jobs.

Layers
  sources/    binding of the test tables, raw CSV readers, sinks
  functions/  column expressions (parsing, banding, exact rounding)
  operators/  generic DataFrame operators (latest row per key, distributed
              NTILE, shares of total, transitions, deterministic sampling)
  plans/      the named analyses: cleaning, current state, KPIs, root cause,
              trends, models, decision layer
"""

from creditscope.config import PortfolioConfig

__all__ = ["PortfolioConfig"]
