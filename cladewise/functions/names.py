"""Spelling of names: one form per name, computed inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings (after normalisation) that mean "there is no name".
NO_NAME = ("", "na")


def spelled(col: Column | str) -> Column:
    """The normal form of a name, or null where there is none.

    Outer white space (space, tab, CR, LF) is removed, inner runs become one underscore, letters are lower-cased.
    Null, empty, blank and ``na`` give null. The regular expression runs only for names that hold white space.
    """
    col = F.col(col) if isinstance(col, str) else col
    flat = F.trim(F.translate(col, "\t\r\n", "   "))
    joined = F.lower(F.when(F.instr(flat, " ") > 0, F.regexp_replace(flat, " +", "_")).otherwise(flat))
    return F.when(~joined.isin(*NO_NAME), joined)


def spelled_sql(col: str) -> str:
    """The same normal form as DuckDB SQL."""
    ws = "[ \\t\\r\\n]+"
    inner = f"lower(regexp_replace(regexp_replace({col}, '^{ws}|{ws}$', '', 'g'), '{ws}', '_', 'g'))"
    return f"CASE WHEN {inner} NOT IN ('', 'na') THEN {inner} END"
