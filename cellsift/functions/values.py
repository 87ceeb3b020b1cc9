"""Values, keys and distances as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellsift.plans.constraints import INT, STRING

# The white space that Python's str.strip removes, as a regular expression's class.
BLANKS = r"[\t-\r\x1C-\x20\x85\xA0  -     　]"


def strip(value: Column) -> Column:
    """Without white space, in Unicode's sense, at either end."""
    return F.regexp_replace(value, f"^{BLANKS}+|{BLANKS}+$", "")


def squeezed(value: Column) -> Column:
    """Without any U+0020; what edit distance looks at."""
    return F.replace(value.cast("string"), F.lit(" "), F.lit(""))


def whole(value: Column, strict: bool = True) -> Column:
    """A number's whole part, towards zero; not a number: an error, or null unless strict."""
    number = value.cast("double") if strict else value.try_cast("double")
    return number.cast("bigint")


def key(value: Column, kind: str, strict: bool = True) -> Column:
    """Equal keys mean distance 0."""
    return squeezed(value) if kind == STRING else whole(value, strict)


def matchable(df: DataFrame, attr: str) -> Column:
    """Whether a value can be within any distance: it isn't null, and as a string it has no white space at its ends."""
    c = F.col(attr)
    return c.isNotNull() & (c == strip(c)) if isinstance(df.schema[attr].dataType, T.StringType) else c.isNotNull()


def distance(a: Column, b: Column, kind: str) -> Column:
    """Of keys: edit distance over code points, or the absolute difference."""
    return F.levenshtein(a, b) if kind == STRING else F.abs(a - b)


def close(a: Column, b: Column, kind: str, threshold: float) -> Column:
    """Whether keys are within a distance; false, not null, for null keys."""
    if threshold < 0:
        return F.lit(False)
    if threshold < 1:
        return F.coalesce(a == b, F.lit(False))
    if kind == STRING:
        return F.coalesce(F.levenshtein(a, b, int(threshold)) >= 0, F.lit(False))
    return F.coalesce(F.abs(a - b) <= threshold, F.lit(False))


def kinds_of(df: DataFrame) -> dict[str, str]:
    """A distance kind for each column by its type: whole numbers INT, all else STRING."""
    return {f.name: INT if isinstance(f.dataType, T.IntegralType) else STRING for f in df.schema.fields}
