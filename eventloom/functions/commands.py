"""Command lines: tokens that change from run to run become placeholders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# A token is a quoted text, whatever stands in it, or a run without white space and quotes; a token, or
# the whole of a quoted one, that has one of the forms becomes its mark.
TOKEN = r"""(?U)"(?:[^"\\]++|\\.)*+"|'(?:[^'\\]++|\\.)*+'|[^\s"']+"""
UUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
HEX = r"0[xX][0-9a-fA-F]{8,}"
DECIMAL = r"[0-9]{8,}"
PLACEHOLDERS = ((UUID, "<UUID>"), (HEX, "<HEX>"), (DECIMAL, "<NUMBER>"))
MISSING, KEPT, NORMALIZED = "insufficient_or_missing_command", "fallback_preserved", "normalized_v1"


def quotes_pair(x: Column) -> Column:
    """Both kinds of quotes come in even numbers."""
    return (F.regexp_count(x, F.lit('"')) % 2 == 0) & (F.regexp_count(x, F.lit("'")) % 2 == 0)


def _replaced(token: Column) -> Column:
    out = token
    for pattern, mark in reversed(PLACEHOLDERS):
        for quote in ("", "'", '"'):
            out = F.when(token.rlike(rf"\A{quote}{pattern}{quote}\z"), quote + mark + quote).otherwise(out)
    return out


def normalized(raw: Column) -> Column:
    """Whole tokens only, bare or quoted; the text between tokens stays. Unpaired quotes leave the line as it is."""
    x = strip(F.coalesce(raw, F.lit("")))
    between, tokens = F.split(x, TOKEN, -1), F.regexp_extract_all(x, F.lit(TOKEN), F.lit(0))
    out = F.array_join(F.zip_with(between, tokens, lambda gap, token: F.concat(gap, F.coalesce(_replaced(token), F.lit("")))), "")
    return F.when(quotes_pair(x) & x.rlike(TOKEN), out).otherwise(x)


def status(raw: Column) -> Column:
    x = strip(F.coalesce(raw, F.lit("")))
    return F.when(x == "", MISSING).when(quotes_pair(x) & x.rlike(TOKEN), NORMALIZED).otherwise(KEPT)
