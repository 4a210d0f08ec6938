"""Names for an operator's own columns."""

from __future__ import annotations

from pyspark.sql import DataFrame


def unused(stem: str, *frames: DataFrame) -> str:
    """stem, with underscores until no frame has it, in whatever case."""
    taken = {c.lower() for df in frames for c in df.columns}
    while stem.lower() in taken:
        stem = f"_{stem}"
    return stem
