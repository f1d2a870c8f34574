"""Column-level helpers: PostgreSQL semantics, labels, time-of-day."""

from binsight.functions.pg import (  # noqa: F401
    as_ts, blank_sentinel, decode_flag, num_text, pg_concat, seconds_between,
    similar_to, similar_to_regex, time_of_day, tod, truncated_ratio, weekday_label,
)
