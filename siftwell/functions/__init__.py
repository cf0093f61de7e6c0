from siftwell.functions.dates import moment_literal, parse_clean_date, parse_date, whole_days
from siftwell.functions.numbers import has_fraction, number_text, parse_number, parse_number_lenient, short_decimal
from siftwell.functions.states import STATE_CODES, state_code, state_code_of_normalized
from siftwell.functions.text import normalize_text, quoted, strip, value_key

__all__ = [
    "STATE_CODES",
    "has_fraction",
    "moment_literal",
    "normalize_text",
    "number_text",
    "parse_clean_date",
    "parse_date",
    "parse_number",
    "parse_number_lenient",
    "quoted",
    "short_decimal",
    "state_code",
    "state_code_of_normalized",
    "strip",
    "value_key",
    "whole_days",
]
