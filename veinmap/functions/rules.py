"""Business rules as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Markers of a disabled job, names of the one-row table, loader debris, the form of an object name and its longest.
DISABLED = ("Y", "YES", "TRUE", "1", "X", "D", "DEL", "DELETED", "DISABLED", "INACTIVE", "OFF")
ONE_ROW_TABLE = ("DUAL", "SYS.DUAL", "PUBLIC.DUAL")
CARRIAGE = "_x000D_|\r"
IDENTIFIER = r"^[A-Z][A-Z0-9_$#]*(\.[A-Z][A-Z0-9_$#]*)?(@[A-Z0-9_$#.]+)?$"
NAME_LIMIT = 261


def filled(c: Column) -> Column:
    """Empty strings as null."""
    return F.when(c != "", c)


def clean_cell(c: Column) -> Column:
    """A cell without carriage returns and outer blanks; whole floats as integers; empty as null."""
    t = F.trim(F.regexp_replace(c.cast("string"), CARRIAGE, ""))
    return filled(F.regexp_replace(t, r"^(-?[0-9]+)\.0+$", "$1"))


def is_disabled(flag: Column) -> Column:
    return F.when(F.upper(F.trim(flag)).isin(*DISABLED), "Y").otherwise("N")


def norm(name: Column, owner: str | None = None) -> Column:
    """Object name without quotes and extra blanks, in upper case, without the own owner."""
    t = F.regexp_replace(F.upper(F.trim(F.replace(name, F.lit('"'), F.lit("")))), r"\s+", " ")
    if owner:
        own = f"{owner.upper()}."
        t = F.when(F.startswith(t, F.lit(own)), F.substring(t, len(own) + 1, 1 << 20)).otherwise(t)
    return filled(F.substring(t, 1, NAME_LIMIT))


def is_label(name: Column) -> Column:
    """No object but a caption: null, or ``SQL : ...``."""
    return name.isNull() | name.rlike(r"(?i)^\s*SQL\s*:")


def is_one_row(name: Column) -> Column:
    return F.coalesce(name.isin(*ONE_ROW_TABLE), F.lit(False))


def owner_of(name: Column, owner: str | None = None) -> Column:
    return F.when(F.contains(name, F.lit(".")), F.substring_index(name, ".", 1)).otherwise(F.lit(owner))


def name_of(name: Column) -> Column:
    return F.when(F.contains(name, F.lit(".")), F.regexp_replace(name, r"^[^.]*\.", "")).otherwise(name)


def clean_sql(sql: Column) -> Column:
    """Statement without carriage returns, outer blanks and, unless it is a block, the last semicolons."""
    t = F.regexp_replace(F.regexp_replace(sql, CARRIAGE, ""), r"^\s+|\s+$", "")
    t = F.when(t.rlike(r"(?i)^(BEGIN|DECLARE)"), t).otherwise(F.regexp_replace(t, r";\s*$", ""))
    return filled(t)


def load_action(unique_col: Column) -> Column:
    return F.when(F.upper(unique_col) == "APPEND", "LOAD_APPEND").when(unique_col.isNotNull(), "LOAD_KEYED").otherwise("LOAD_REPLACE")


def load_key(unique_col: Column) -> Column:
    return F.when(F.upper(unique_col) != "APPEND", unique_col)


def sql_action(statement: Column, reads: Column) -> Column:
    same = [("UPDATE", "UPDATE"), ("DELETE", "DELETE"), ("MERGE", "MERGE"), ("TRUNCATE", "TRUNCATE"), ("PLSQL", "PLSQL_CALL"), ("CREATE_TABLE", "CREATE_TABLE_AS"), ("SELECT", "SELECT")]
    out = F.when(statement == "INSERT", F.when(reads, "INSERT_SELECT").otherwise("INSERT_VALUES"))
    for s, action in same:
        out = out.when(statement == s, action)
    return out.otherwise("UNKNOWN")


def node_class(ins: Column, outs: Column) -> Column:
    return F.when((ins == 0) & (outs == 0), "ISOLATED").when(ins == 0, "ROOT").when(outs == 0, "TERMINAL").otherwise("INTERMEDIATE")


def transform_rank(c: Column) -> Column:
    out = F.when(c == "WINDOW", 6)
    for name, rank in (("AGGREGATE", 5), ("CASE", 4), ("CALCULATED", 3), ("RENAME", 2), ("DIRECT", 1)):
        out = out.when(c == name, rank)
    return out.otherwise(0)
