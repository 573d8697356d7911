"""Column expressions: text, dates, numbers and classification."""

from turnout.functions.classify import (
    activity_source,
    attempt_bucket,
    module_of_path,
    segment_case,
    sql_kind,
    valid_email,
)
from turnout.functions.dates import (
    business_date,
    business_hour,
    completed_years,
    display_timestamp,
    nullify_sentinel,
    parse_date_text,
    parse_timestamp_text,
)
from turnout.functions.numbers import float_from_text, int_from_text, ratio
from turnout.functions.text import (
    coalesce_label,
    compact_number,
    initcap_words,
    normalise_email,
    normalise_header,
    normalise_key,
    not_blank,
    scope_key,
    score_text,
    session_display,
    split_trailing_years,
    strip_all,
)

__all__ = [
    "activity_source", "attempt_bucket", "business_date", "business_hour", "coalesce_label",
    "compact_number", "completed_years", "display_timestamp", "float_from_text", "initcap_words",
    "int_from_text", "module_of_path", "normalise_email", "normalise_header", "normalise_key",
    "not_blank", "nullify_sentinel", "parse_date_text", "parse_timestamp_text", "ratio",
    "scope_key", "score_text", "segment_case", "session_display", "split_trailing_years",
    "sql_kind", "strip_all", "valid_email",
]
