"""US state names and codes to the two-letter code."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwell.functions.text import normalize_text

# The fifty states and their postal codes.
STATE_CODES = {
    "alabama": "AL", "alaska": "AK", "arizona": "AZ", "arkansas": "AR", "california": "CA",
    "colorado": "CO", "connecticut": "CT", "delaware": "DE", "florida": "FL", "georgia": "GA",
    "hawaii": "HI", "idaho": "ID", "illinois": "IL", "indiana": "IN", "iowa": "IA",
    "kansas": "KS", "kentucky": "KY", "louisiana": "LA", "maine": "ME", "maryland": "MD",
    "massachusetts": "MA", "michigan": "MI", "minnesota": "MN", "mississippi": "MS", "missouri": "MO",
    "montana": "MT", "nebraska": "NE", "nevada": "NV", "new hampshire": "NH", "new jersey": "NJ",
    "new mexico": "NM", "new york": "NY", "north carolina": "NC", "north dakota": "ND", "ohio": "OH",
    "oklahoma": "OK", "oregon": "OR", "pennsylvania": "PA", "rhode island": "RI", "south carolina": "SC",
    "south dakota": "SD", "tennessee": "TN", "texas": "TX", "utah": "UT", "vermont": "VT",
    "virginia": "VA", "washington": "WA", "west virginia": "WV", "wisconsin": "WI", "wyoming": "WY",
}

_LOOKUP = {**STATE_CODES, **{code.lower(): code for code in STATE_CODES.values()}}


_TABLE = "map({})".format(", ".join(f"'{text}', '{code}'" for text, code in _LOOKUP.items()))
_LONGEST = max(map(len, _LOOKUP))


def state_code_of_normalized(norm: Column) -> Column:
    """Code for text that is already stripped and lower-cased; null for anything else."""
    return F.when(F.length(norm) <= _LONGEST, F.try_element_at(F.expr(_TABLE), norm))


def state_code(c: Column) -> Column:
    norm = normalize_text(c)
    # The set test is hashed and rejects most text before the map is walked.
    return F.when(norm.isin(*_LOOKUP), state_code_of_normalized(norm))
