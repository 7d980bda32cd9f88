"""Column functions for input file names and time texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def route(file_name: Column) -> dict[str, Column]:
    """What a graph file holds, by its name ``path_1_<element>_<partition>.json``.

    Only the name counts, not the folder it lies in.
    """
    parts = F.split(file_name, "_")
    last = F.element_at(parts, -1)
    partition = F.element_at(F.split(last, r"\."), 1)
    return {
        "kind": F.when(file_name.contains("person"), F.lit("nodes")).otherwise(F.lit("edges")),
        "map_key": F.concat_ws("_", F.element_at(parts, 1), F.element_at(parts, 2), partition),
        "partition": partition,
        "prop_type": F.when(file_name.contains("static"), F.lit("static")).otherwise(F.lit("dynamic")),
        "element_key": F.array_join(F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 3, F.lit(0))), "_"),
    }


def normalize_time(text: Column) -> Column:
    """``2001-10-05T00:00:00Z`` as ``2001-10-05 00:00:00``."""
    return F.trim(F.regexp_replace(F.replace(text, F.lit("T"), F.lit(" ")), r"Z$", ""))
