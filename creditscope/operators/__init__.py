"""Generic DataFrame operators used by the analyses."""

from creditscope.operators.aggregate import share_of_total
from creditscope.operators.joins import keep_referenced, orphans
from creditscope.operators.ranking import exact_medians, global_rank, ntile_distributed
from creditscope.operators.sampling import deterministic_sample
from creditscope.operators.window import keep_first, latest_per_key, next_value, trim_after_event

__all__ = ["deterministic_sample", "exact_medians", "global_rank", "keep_first", "keep_referenced",
           "latest_per_key", "next_value", "ntile_distributed", "orphans", "share_of_total", "trim_after_event"]
