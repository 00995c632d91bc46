"""Column expressions as Spark SQL text.

Every function takes and gives text for ``expr``, ``selectExpr`` or ``where``, so they nest freely and
a wide CASE reaches the planner in one call. Column arguments are names or expressions; labels and
codes are Python values.
"""

from .nulls import lacks_code, lacks_prefix, lacks_text, member, strict_if
from .numbers import percentage, round_to, to_int
from .recode import band, first_match, label_map, recode, repair_text
from .text import literal, literals, paste, period_text

__all__ = [
    "band",
    "first_match",
    "label_map",
    "lacks_code",
    "lacks_prefix",
    "lacks_text",
    "literal",
    "literals",
    "member",
    "paste",
    "percentage",
    "period_text",
    "recode",
    "repair_text",
    "round_to",
    "strict_if",
    "to_int",
]
