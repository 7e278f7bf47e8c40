"""Named analyses: each is DataFrame(s) -> DataFrame."""
