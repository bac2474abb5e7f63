"""Built-in XSD types as column predicates and casts. Text that doesn't fit is a false predicate, never an exception."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Types that a schema can name with the prefix xs:, and the sign variants that only code names.
BUILTINS = ("string", "double", "int", "integer", "boolean", "positiveInteger", "nonNegativeInteger", "negativeInteger", "nonPositiveInteger", "ID", "IDREF", "base64Binary")

SPARK_TYPES: dict[str, T.DataType] = {
    "string": T.StringType(), "ID": T.StringType(), "IDREF": T.StringType(), "base64Binary": T.StringType(), "double": T.DoubleType(), "int": T.LongType(), "boolean": T.BooleanType(),
    **{t: T.DecimalType(38, 0) for t in ("integer", "positiveInteger", "nonNegativeInteger", "negativeInteger", "nonPositiveInteger")},
}


def integer(x: Column) -> Column:
    """The whole number in a text, or null; a text with a fraction or an exponent isn't one."""
    x = F.trim(x)
    return F.when(x.rlike(r"^[+-]?[0-9]+$"), x.try_cast("decimal(38,0)"))


def boolean(x: Column) -> Column:
    """true, True, 1 and false, False, 0; null for anything else (a cast would also take yes)."""
    return F.when(x.isin("true", "True", "1"), F.lit(True)).when(x.isin("false", "False", "0"), F.lit(False))


def double(x: Column) -> Column:
    return F.trim(x).try_cast("double")


def base64(x: Column) -> Column:
    return F.try_to_binary(x, F.lit("base64"))


def valid(x: Column, builtin: str) -> Column:
    """True, false, or null for a null text."""
    if builtin in ("string", "ID", "IDREF"):
        ok: Column = F.lit(True)
    elif builtin == "double":
        ok = double(x).isNotNull()
    elif builtin == "boolean":
        ok = boolean(x).isNotNull()
    elif builtin == "base64Binary":
        ok = base64(x).isNotNull()
    else:
        n = integer(x)
        ok = {"int": n.isNotNull(), "integer": n.isNotNull(), "positiveInteger": n > 0, "nonNegativeInteger": n >= 0, "negativeInteger": n < 0, "nonPositiveInteger": n <= 0}[builtin]
    return F.when(x.isNotNull(), F.coalesce(ok, F.lit(False)))


def typed(x: Column, builtin: str) -> Column:
    """The text as a value of its Spark type; null where it isn't valid."""
    value = {"double": double, "boolean": boolean}.get(builtin)
    if value is None:
        value = integer if SPARK_TYPES[builtin] == T.DecimalType(38, 0) or builtin == "int" else (lambda c: c)
    return F.when(valid(x, builtin), value(x).cast(SPARK_TYPES[builtin]))


def list_valid(x: Column, item: str) -> Column:
    """Every item of a white-space separated list is valid; an empty list is."""
    return F.forall(list_items(x), lambda i: valid(i, item))


def list_items(x: Column) -> Column:
    return F.filter(F.split(F.trim(x), r"\s+"), lambda i: i != "")


def enumeration(x: Column, values: list[str]) -> Column:
    return x.isin(*values)


def pattern(x: Column, patterns: list[str]) -> Column:
    """The whole text matches one of the patterns."""
    return x.rlike("^(?:" + "|".join(f"(?:{p})" for p in patterns) + ")$")


def length(x: Column, n: int) -> Column:
    return F.length(x) == n


def bounds(x: Column, low: float | None = None, high: float | None = None, above: float | None = None, below: float | None = None) -> Column:
    """minInclusive, maxInclusive, minExclusive, maxExclusive; a text that is no number fails."""
    x = x.try_cast("double") if not isinstance(x, (int, float)) else F.lit(x)
    ok = F.lit(True)
    for limit, test in ((low, x.__ge__), (high, x.__le__), (above, x.__gt__), (below, x.__lt__)):
        if limit is not None:
            ok = ok & test(F.lit(float(limit)))
    return F.coalesce(ok & x.isNotNull(), F.lit(False))
