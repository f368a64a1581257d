"""Rows that fail to parse: text columns, rules into error arrays, split by empty arrays.

Everything is a column expression, so a load is one scan without a shuffle,
and filters and column pruning reach it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MARK = "\x01"


def quoted_parts(line: Column) -> Column:
    """What stands between the double quotes of a line; at even places outside of them."""
    return F.split(line, '"', -1)


def sound_quoting(parts: Column, n: Column) -> Column:
    """Whether each field is free of double quotes, or wholly enclosed in them with inner ones doubled.

    Each part outside must be empty (a doubled quote) or touch its quotes with commas. n: number of parts.
    """

    def fine(x: Column, i: Column) -> Column:
        opens = (i == n - 1) | x.endswith(",")
        closes = (i == 0) | x.startswith(",")
        return (i % 2 == 1) | (x == "") | (opens & closes)

    return (n == 1) | ((n % 2 == 1) & F.forall(F.transform(parts, fine), lambda ok: ok))


def csv_fields(line: Column, parts: Column, n: Column) -> Column:
    """Fields of a line with sound quoting as an array of text."""
    hide = lambda x: F.replace(F.replace(x, F.lit(_MARK), F.lit(_MARK + "a")), F.lit(","), F.lit(_MARK + "b"))
    show = lambda x: F.replace(F.replace(x, F.lit(_MARK + "b"), F.lit(",")), F.lit(_MARK + "a"), F.lit(_MARK))
    hidden = F.concat_ws('"', F.transform(parts, lambda x, i: F.when(i % 2 == 1, hide(x)).otherwise(x)))

    def bare(x: Column) -> Column:
        inner = F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))
        return F.when(x.startswith('"'), show(inner)).otherwise(x)

    return F.when(n == 1, F.split(line, ",", -1)).otherwise(F.transform(F.split(hidden, ",", -1), bare))


def trimmed(c: Column) -> Column:
    """Without blanks and tabs at either end."""
    return F.regexp_replace(c, r"^[ \t]+|[ \t]+\z", "")


def balanced(c: Column, left: str = "(", right: str = ")") -> Column:
    """Whether the brackets close in order."""
    only = F.regexp_replace(c, f"[^\\{left}\\{right}]", "")
    step = lambda depth, x: F.when(depth < 0, depth).when(x == left, depth + 1).when(x == right, depth - 1).otherwise(depth)
    return F.aggregate(F.split(only, ""), F.lit(0), step) == 0


def flat_brackets(c: Column) -> Column:
    """Whether square brackets close and none stands in another."""
    return F.replace(F.regexp_replace(c, r"[^\[\]]", ""), F.lit("[]"), F.lit("")) == ""


def even_digits(c: Column) -> Column:
    """Whether each digit outside square brackets occurs an even number of times."""
    digits = F.regexp_replace(F.regexp_replace(c, r"\[[^\]]*\]", ""), "[^0-9]", "")
    # equal digits side by side; nothing is left when they pair off
    return F.regexp_replace(F.array_join(F.array_sort(F.split(digits, "")), ""), r"(\d)\1", "") == ""


def plain_number(c: Column) -> Column:
    return c.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)\z")


def structure_rules(c: Column) -> dict[str, Column]:
    """What a structure field must satisfy, by the reason given when it doesn't."""
    return {
        "SMILES is empty": c != "",
        "SMILES has a foreign character": c.rlike(r"^[A-Za-z0-9()\[\]=#+\-@/\\.%:*]*\z"),
        "SMILES has unbalanced round brackets": balanced(c),
        "SMILES has open or nested square brackets": flat_brackets(c),
        "SMILES has an unclosed ring": even_digits(c),
    }


def number_rules(name: str, c: Column, low: float, high: float, optional: bool = False) -> dict[str, Column]:
    none = (c == "") if optional else F.lit(False)
    number = plain_number(c)
    return {
        f"{name} isn't a number": none | number,
        f"{name} is out of range": none | ~number | c.try_cast("double").between(low, high),
    }


def _computed(df: DataFrame, keep: Sequence[str], **columns: Column) -> DataFrame:
    """Columns evaluated once a row: a generator of one row, which later filters aren't pushed through."""
    made = F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return df.select(*[F.col(f"`{c}`") for c in keep], made)


def with_errors(df: DataFrame, line_col: str, names: Sequence[str], trim: Sequence[str], rules: Mapping[str, Column]) -> DataFrame:
    """df plus one text column for each name and ``errors``, the reasons why the line isn't valid.

    One trailing carriage return is dropped. A null line has the single reason
    "no line"; a line whose quoting or number of fields is wrong has that
    reason only, and null fields. Columns of df that share a name with a field
    are replaced. Rules are columns over the fields and must hold.
    """
    line = F.col(line_col)
    line = F.when(line.endswith("\r"), F.substring(line, F.lit(1), F.length(line) - 1)).otherwise(line)
    own = [c for c in df.columns if c not in {*names, "errors"}]
    df = _computed(df, own, __line=line)
    df = _computed(df, [*own, "__line"], __parts=quoted_parts(F.col("__line")))
    n = F.size("__parts")
    df = _computed(df, [*own, "__line", "__parts"], __sound=sound_quoting(F.col("__parts"), n))
    df = _computed(df, [*own, "__line", "__sound"], __fields=F.when(F.col("__sound"), csv_fields(F.col("__line"), F.col("__parts"), n)))
    whole = F.coalesce(F.col("__sound") & (F.size("__fields") == len(names)), F.lit(False))
    values = {}
    for i, name in enumerate(names):
        v = F.when(whole, F.col("__fields")[i])
        values[name] = trimmed(v) if name in trim else v
    df = _computed(df, [*own, "__line", "__sound"], __whole=whole, **values)
    checks = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(reason)) for reason, ok in rules.items()]))
    errors = (
        F.when(F.col("__line").isNull(), F.array(F.lit("no line")))
        .when(~F.coalesce(F.col("__sound"), F.lit(False)), F.array(F.lit("broken quoting")))
        .when(~F.col("__whole"), F.array(F.lit(f"not {len(names)} fields")))
        .otherwise(checks)
    )
    return _computed(df, [*own, *names], errors=errors)


LOGP_FIELDS = ("DATABASE_ID", "NAME", "SMILES_n", "SMILES", "logPN", "logPI")


def logp_lines(raw: DataFrame) -> DataFrame:
    """Lines of raw (raw_id, line_no, raw_line), headers left out, with their fields as text and ``errors``."""
    rules = structure_rules(F.col("SMILES")) | number_rules("logPN", F.col("logPN"), -10, 15) | number_rules("logPI", F.col("logPI"), -10, 15, optional=True)
    data = raw.where(F.col("line_no").isNull() | (F.col("line_no") != 1)).select("raw_id", "line_no", "raw_line")
    return with_errors(data, "raw_line", LOGP_FIELDS, ("SMILES", "logPN", "logPI"), rules)


def loaded(lines: DataFrame) -> DataFrame:
    """Valid lines as typed rows."""
    typed = [F.col(c).try_cast("double").alias(c) if c in ("logPN", "logPI") else F.col(c) for c in LOGP_FIELDS]
    return lines.where(F.size("errors") == 0).select("raw_id", *typed)


def rejected(lines: DataFrame) -> DataFrame:
    """Other lines as they came, with the reasons."""
    return lines.where(F.size("errors") > 0).select("raw_id", "line_no", "raw_line", "errors")
