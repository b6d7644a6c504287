"""DataFrame-in, DataFrame-out operators. None of them collects rows."""
