"""Text rules: normalising SQL text, quoting names, key predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that counts as white space, as a class for regular expressions.
_SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def strip_text(expression: str, ends: str = "both") -> str:
    """SQL that drops white space of any kind from both ends of a text, or from the ``right`` one."""
    left = f"^{_SPACE}+|" if ends == "both" else ""
    return rf"regexp_replace({expression}, r'{left}{_SPACE}+\z', '')"


def normalize_sql_text(expression: str) -> str:
    """SQL that folds away differences of spacing, letter case and trailing semicolons; NULL becomes ''."""
    # Most texts hold single blanks only, which a cheap test tells; the others have white space folded.
    folded = (
        rf"CASE WHEN contains({expression}, '  ') OR rlike({expression}, r'[^ -~]') "
        rf"THEN regexp_replace({expression}, r'{_SPACE}+', ' ') ELSE {expression} END"
    )
    return f"coalesce(lower(trim(trim(TRAILING ';' FROM trim({folded})))), '')"


def normalize_sql(column: str) -> Column:
    """As :func:`normalize_sql_text`, for a column given by name or as a SQL expression."""
    return F.expr(normalize_sql_text(column))


def quote_ident(name: Column, engine: str = "postgresql") -> Column:
    """Quote an identifier the way the engine writes it, doubling the closing quote."""
    opening, closing = {"mysql": ("`", "`"), "sqlserver": ("[", "]")}.get(engine, ('"', '"'))
    doubled = F.replace(name, F.lit(closing), F.lit(closing * 2))
    return F.concat(F.lit(opening), doubled, F.lit(closing))


def quote_ident_sql(expression: str) -> str:
    """SQL that puts an identifier in double quotes."""
    return f"concat('\"', replace({expression}, '\"', '\"\"'), '\"')"


def quote_name(name: str, engine: str = "postgresql") -> str:
    """As :func:`quote_ident`, for names known while building the plan."""
    opening, closing = {"mysql": ("`", "`"), "sqlserver": ("[", "]")}.get(engine, ('"', '"'))
    return opening + name.replace(closing, closing * 2) + closing


def qualify(schema: Column, name: Column, engine: str = "postgresql") -> Column:
    return F.concat(quote_ident(schema, engine), F.lit("."), quote_ident(name, engine))


def qualify_name(schema: str, name: str, engine: str = "postgresql") -> str:
    return f"{quote_name(schema, engine)}.{quote_name(name, engine)}"


def sql_literal(text: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))


def sql_string(value: str) -> str:
    """A Python string as a literal inside a Spark SQL expression."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def constraint_text(definition: Column) -> Column:
    """Constraint text with two spellings of casts folded, spaces dropped, lower case."""
    folded = F.replace(definition, F.lit("::character varying::text"), F.lit("::character varying"))
    folded = F.replace(folded, F.lit("::text[]"), F.lit(""))
    return F.lower(F.replace(folded, F.lit(" "), F.lit("")))


def strip_end(text: Column, chars: str = ";") -> Column:
    return F.regexp_replace(text, rf"[{chars}]+\z", "")


def any_null(columns) -> Column:
    return reduce(lambda a, b: a | b, [_col(c).isNull() for c in columns])


def all_present(columns) -> Column:
    return reduce(lambda a, b: a & b, [_col(c).isNotNull() for c in columns])


def _col(column) -> Column:
    return column if isinstance(column, Column) else F.col(f"`{column}`")
