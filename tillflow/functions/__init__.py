"""Column helpers.  All of them are built-in expressions; there are no Python UDFs."""

from tillflow.functions.amounts import as_cents, from_cents, share_cents
from tillflow.functions.people import age_group, gender_label
from tillflow.functions.times import day_between, on_days, open_range, parse_day
from tillflow.functions.topics import ods_topic

__all__ = [
    "age_group", "as_cents", "day_between", "from_cents", "gender_label",
    "ods_topic", "on_days", "open_range", "parse_day", "share_cents",
]
