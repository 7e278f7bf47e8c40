"""Column expressions: all JVM-side, no Python UDF."""

from creditscope.functions.exprs import (band, clip, fill_blank_text, half_up, null_outside,
                                         null_tokens_to_null, parse_date, parse_money,
                                         parse_number, rate, ratio_half_up, round_half_even,
                                         round_half_up, share, title_case)

__all__ = ["band", "clip", "fill_blank_text", "half_up", "null_outside", "null_tokens_to_null",
           "parse_date", "parse_money", "parse_number", "rate", "ratio_half_up",
           "round_half_even", "round_half_up", "share", "title_case"]
