"""Mixed-format text to timestamp.

Each accepted notation is rewritten to ISO order and cast, so a value costs one shape test per
notation until the first that fits and free text never reaches a date parser.
"""

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwell.functions.text import strip

_LONGEST = 64
_CLOCK = r"([T ]\d{1,2}:\d{2}.*)?"
_MONTHS = "JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC"
_MONTH_NAME = (
    r"(JAN(?:UARY)?|FEB(?:RUARY)?|MAR(?:CH)?|APR(?:IL)?|MAY|JUNE?|JULY?|AUG(?:UST)?"
    r"|SEP(?:T(?:EMBER)?)?|OCT(?:OBER)?|NOV(?:EMBER)?|DEC(?:EMBER)?)"
)

ISO = r"^\d{4}-\d{1,2}-\d{1,2}" + _CLOCK + "$"
SLASHED_YEAR_FIRST = r"^(\d{4})[/.](\d{1,2})[/.](\d{1,2})" + _CLOCK + "$"
SLASHED_YEAR_LAST = r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})" + _CLOCK + "$"
YEAR_MONTH = r"^(\d{4})[-/](\d{1,2})$"
SLASHED_SHORT_YEAR = r"^(\d{1,2})/(\d{1,2})/(\d{2})" + _CLOCK + "$"
COMPACT = r"^(\d{4})(\d{2})(\d{2})$"
COMPACT_CLOCK = r"^(\d{4})(\d{2})(\d{2})[T ](\d{2}):?(\d{2}):?(\d{2})$"
DAY_MONTH_NAME = r"^(\d{1,2})[ -]" + _MONTH_NAME + r",?[ -](\d{4}|\d{2})" + _CLOCK + "$"
MONTH_NAME_DAY = r"^" + _MONTH_NAME + r" (\d{1,2}),? (\d{4})" + _CLOCK + "$"

WEEKDAY = r"^(?:MON|TUES?|WED(?:NES)?|THU(?:RS)?|FRI|SAT(?:UR)?|SUN)(?:DAY)?,? +"
# What may follow a clock: half of the day, and the distance from universal time.
HALF = r"^(.*?)(\d{1,2})(:\d{2}(?::\d{2})?) ?([AP])M$"
OFFSET = r"^(.*:\d{2}(?:\.\d+)?) ?(?:(Z|UTC|GMT)|([+-])(\d{2}):?(\d{2}))$"


def _moment(text: Column) -> Column:
    return text.try_cast("timestamp_ntz")


def _rewritten(text: Column, shape: str, order: str) -> Column:
    return _moment(F.regexp_replace(text, shape, order))


def _named_month(text: Column, shape: str, month: int, day: int, year: int, clock: int) -> Column:
    name = F.regexp_extract(text, shape, month)
    number = ((F.position(F.substring(name, 1, 3), F.lit(_MONTHS)) + 2) / 3).cast("int").cast("string")
    date = F.concat_ws("-", _full_year(F.regexp_extract(text, shape, year)), number, F.regexp_extract(text, shape, day))
    return _moment(F.concat(date, F.regexp_extract(text, shape, clock)))


def _full_year(year: Column) -> Column:
    """Two digits from 69 on are in the 1900s."""
    century = F.when(year.cast("int") < 69, "20").otherwise("19")
    return F.when(F.length(year) == 2, F.concat(century, year)).otherwise(year)


def _short_year(text: Column) -> Column:
    year = _full_year(F.regexp_extract(text, SLASHED_SHORT_YEAR, 3))
    return _moment(F.concat(year, F.regexp_replace(text, SLASHED_SHORT_YEAR, "-$1-$2$4")))


def parse_date(c: Column) -> Column:
    """Timestamp written in the text, month first where the order is open, null otherwise."""
    return parse_clean_date(F.upper(strip(c)))


def parse_clean_date(text: Column) -> Column:
    """parse_date of text that is already stripped and in upper case."""
    # No accepted notation is longer than this or lacks two digits in a row. All notations together are more code than
    # Spark compiles at once; bound to a variable, the text is also evaluated once.
    likely = (F.length(text) <= _LONGEST) & text.rlike(r"\d\d")
    return F.when(likely, F.element_at(F.transform(F.array(text), _dated), 1))


def _dated(text: Column) -> Column:
    """The moment as it is noted without what may follow a clock, moved by what does."""
    text = F.regexp_replace(text, WEEKDAY, "")
    offset, half = text.rlike(OFFSET), text.rlike(HALF)
    clock = F.concat(*[F.regexp_extract(text, HALF, i) for i in (1, 2, 3)])
    plain = F.when(offset, F.regexp_extract(text, OFFSET, 1)).when(half, clock).otherwise(text)
    # A clock of twelve hours, and the way back to universal time.
    hour, late = F.regexp_extract(text, HALF, 2).try_cast("int"), F.regexp_extract(text, HALF, 4) == "P"
    hours = F.when(half & late & (hour < 12), 12).when(half & ~late & (hour == 12), -12).otherwise(0)
    minutes = F.regexp_extract(text, OFFSET, 4).try_cast("int") * 60 + F.regexp_extract(text, OFFSET, 5).try_cast("int")
    ahead = F.when(F.regexp_extract(text, OFFSET, 3) == "-", -minutes).otherwise(minutes)
    back = F.when(offset, F.coalesce(-ahead, F.lit(0))).otherwise(0)
    noted = F.element_at(F.transform(F.array(plain), _noted), 1)
    return noted + F.make_dt_interval(F.lit(0), hours, back)


def _noted(text: Column) -> Column:
    return (
        F.when(text.rlike(ISO), _moment(text))
        .when(
            text.rlike(SLASHED_YEAR_LAST),
            F.coalesce(
                _rewritten(text, SLASHED_YEAR_LAST, "$3-$1-$2$4"),
                _rewritten(text, SLASHED_YEAR_LAST, "$3-$2-$1$4"),
            ),
        )
        .when(text.rlike(SLASHED_YEAR_FIRST), _rewritten(text, SLASHED_YEAR_FIRST, "$1-$2-$3$4"))
        .when(text.rlike(SLASHED_SHORT_YEAR), _short_year(text))
        .when(text.rlike(COMPACT), _rewritten(text, COMPACT, "$1-$2-$3"))
        .when(text.rlike(COMPACT_CLOCK), _rewritten(text, COMPACT_CLOCK, "$1-$2-$3 $4:$5:$6"))
        .when(text.rlike(YEAR_MONTH), _rewritten(text, YEAR_MONTH, "$1-$2-01"))
        .when(text.rlike(DAY_MONTH_NAME), _named_month(text, DAY_MONTH_NAME, 2, 1, 3, 4))
        .when(text.rlike(MONTH_NAME_DAY), _named_month(text, MONTH_NAME_DAY, 1, 2, 3, 4))
    )


def moment_literal(moment: datetime) -> Column:
    """A timestamp without zone, whatever the zones of driver and session."""
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def whole_days(start: Column, end: Column) -> Column:
    """Completed days between two timestamps without zone, not calendar boundaries crossed."""
    return F.extract(F.lit("DAY"), end - start)
