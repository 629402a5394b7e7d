"""Reading scorer replies: JSON arrays, possibly wrapped in a code fence and prose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feltgrid import domain
from feltgrid.functions.text import as_column, strip

SCORE_ITEM = "struct<id: bigint, " + ", ".join(f"{e}: double" for e in domain.EMOTIONS) + ">"


def parse_score_reply(raw: Column | str, expected: Column | int) -> Column:
    """``array<struct>`` of scores, null unless the reply holds exactly ``expected`` items."""
    text = strip(as_column(raw))
    text = F.regexp_replace(text, r"^```(?:json)?\s*", "")
    text = F.regexp_replace(text, r"\s*```$", "")
    body = F.nullif(F.regexp_extract(text, r"(?s)(\[.*\])", 1), F.lit(""))
    items = F.from_json(body, f"array<{SCORE_ITEM}>")
    expected = F.lit(expected) if isinstance(expected, int) else expected
    return F.when(F.size(items) == expected, items)
