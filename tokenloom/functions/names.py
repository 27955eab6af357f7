"""Names of data sets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def short_name(col: Column) -> Column:
    """The part after the last slash; an empty name stays empty."""
    return F.element_at(F.split(col, "/"), -1)


def path_safe_name(col: Column) -> Column:
    """The name with ``/`` written as ``__``."""
    return F.replace(col, F.lit("/"), F.lit("__"))
