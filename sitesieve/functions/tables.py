"""Small constant tables inside an expression."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def table(fields: str, rows: Iterable[Sequence]) -> Column:
    """``array<struct<ord, ..>>`` of the given rows; ``ord`` counts them from 0.

    The text form is folded into one literal when the query is planned, so a long rule table costs the plan no more than
    a short one.
    """
    names = [field.split(":")[0].strip() for field in fields.split(",")]
    records = [{"ord": i, **dict(zip(names, row, strict=True))} for i, row in enumerate(rows)]
    return F.from_json(F.lit(json.dumps(records)), f"array<struct<ord:int,{fields}>>")
