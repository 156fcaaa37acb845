"""Scalar column functions, all built from Spark SQL functions so they
run in the JVM (mostly code-generated; no Python UDF anywhere).

Number text follows the analysed application exactly where Spark allows:
``format_number`` rounds the double's exact binary value half-to-even, which is
what Python's ``f"{x:,.2f}"`` does, so it is the base of every fixed-decimal
text here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .words import CURRENCY_WORDS, FILE_TYPES, UNKNOWN_FILE_TYPE

NBSP = "\u00a0"

# Grammar of Python's float() after strip: digits may hold single underscores;
# inf / infinity / nan in any case.
PY_FLOAT_RE = (r"^[+-]?(((\d(_?\d)*)(\.(\d(_?\d)*)?)?|\.\d(_?\d)*)([eE][+-]?\d(_?\d)*)?"
               r"|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])$")
# Grammar accepted when a whole column is converted: plain decimal or exponent
# notation (no underscores, no Spark-only suffixes such as 1d / 1f).
DECIMAL_RE = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
# Blank at both ends (Python's strip)
EDGE_BLANKS_RE = r"^\s+|\s+$"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip_blanks(col: Column | str) -> Column:
    return F.regexp_replace(_c(col), EDGE_BLANKS_RE, "")


def number_text_core(col: Column | str) -> Column:
    """drop ``$ , %`` and blanks at both ends."""
    return strip_blanks(F.regexp_replace(_c(col), r"[$,%]", ""))


def parses_as_python_float(col: Column | str) -> Column:
    """True where Python's float() would accept the F1-cleaned text."""
    core = number_text_core(col)
    return core.rlike(PY_FLOAT_RE) & (core != "")


def to_number(col: Column | str) -> Column:
    """cleaned text → double; unparsable, NaN and infinities → null."""
    core = number_text_core(col)
    val = F.when(core.rlike(DECIMAL_RE), core.try_cast("double"))
    return F.when(F.isnan(val) | (F.abs(val) == float("inf")), F.lit(None).cast("double")).otherwise(val)


def lenient_number(col: Column | str) -> Column:
    """keep only ``0-9 . -`` and parse; text without any of them gives 0,
    a leftover that is not one number (``2024-01-05``) gives null.
    Numeric input passes through when finite."""
    c = _c(col)
    kept = F.regexp_replace(c.cast("string"), r"[^0-9.\-]", "")
    parsed = (F.when(kept == "", F.lit(0.0))
              .when(kept.rlike(r"^-?(\d+\.?\d*|\.\d+)$"), kept.try_cast("double")))
    return parsed


def lenient_number_of_number(col: Column | str) -> Column:
    c = _c(col).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def contains_any(col: Column | str, words: Sequence[str]) -> Column:
    """true when the text holds any of ``words`` (plain substring)."""
    c = _c(col)
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def currency_name(col: Column | str) -> Column:
    """lower-case, runs of blanks → ``_``, contains a currency word."""
    norm = F.regexp_replace(F.lower(_c(col)), r"\s+", "_")
    return F.coalesce(contains_any(norm, CURRENCY_WORDS), F.lit(False))


def is_currency_name(name: str) -> bool:
    """F3 for a name known on the driver (a column name)."""
    import re
    norm = re.sub(r"\s+", "_", name.lower())
    return any(w in norm for w in CURRENCY_WORDS)


def fixed(col: Column | str, digits: int, groups: bool = False) -> Column:
    """Python ``f"{x:.{d}f}"`` (``groups`` adds ``,`` like ``:,.{d}f``)."""
    txt = F.format_number(_c(col).cast("double"), digits)
    return txt if groups else F.regexp_replace(txt, ",", "")


def py_round(col: Column | str, digits: int) -> Column:
    """Python ``round(x, d)`` for a double (exact binary value, ties to even)."""
    c = _c(col).cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), c).otherwise(fixed(c, digits).cast("double"))


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once (an expression that is used
    often would otherwise be copied to each place)."""
    return F.transform(F.array(value), use)[0]


def _parts(s: Column) -> Column:
    """struct(sign, d: significant digits, e: decimal exponent) of a number's text."""
    def cut(x):
        shown = F.rtrim(x["bare"], F.lit("0"))
        lead = F.length(x["digits"]) - F.length(x["bare"])
        return F.struct(x["sign"].alias("sign"), F.when(shown == "", F.lit("0")).otherwise(shown).alias("d"),
                        F.when(shown == "", F.lit(0)).otherwise(x["whole"] - 1 - lead + x["power"]).alias("e"))

    upper = F.upper(s)
    mantissa = F.translate(F.substring_index(upper, "E", 1), "-", "")
    digits = F.translate(mantissa, ".", "")
    raw = F.struct(
        F.when(s.startswith("-"), F.lit("-")).otherwise(F.lit("")).alias("sign"),
        digits.alias("digits"), F.ltrim(digits, F.lit("0")).alias("bare"),
        F.length(F.substring_index(mantissa, ".", 1)).alias("whole"),
        F.when(upper.contains("E"), F.substring_index(upper, "E", -1).try_cast("int")).otherwise(F.lit(0)).alias("power"))
    return _let(raw, cut)


def _scientific(c: Column) -> Column:
    """The parts of a finite double's shortest text. Older Java versions print
    some doubles with too many digits: fewer are taken where they read back as
    the same double."""
    def reads_back(text):
        return _let(text, lambda f: F.when(f.try_cast("double") == c, f))

    def shortest(x):
        n = F.length(x["d"])
        fewer = (F.when(n == 2, reads_back(F.format_string("%.0e", c)))
                 .when(n >= 16, F.coalesce(reads_back(F.format_string("%.14e", c)),
                                           F.when(n > 16, reads_back(F.format_string("%.15e", c))),
                                           F.when(n > 17, reads_back(F.format_string("%.16e", c))))))
        return _let(fewer, lambda f: F.when(f.isNotNull(), _parts(f)).otherwise(x))

    return _let(_parts(c.cast("string")), shortest)


def _double_text(c: Column, low: int, high: int, whole_tail: str, power_digits: int) -> Column:
    """Plain digits for decimal exponents in ``low .. high - 1`` (which holds
    -3 .. 14), else scientific with at least ``power_digits`` digits in the power.

    Whole numbers below 1e15, and texts of at most 15 digits (no two of those
    are the same double, so none is shorter), are taken as they are; only
    the rest has its digits looked at."""
    text, size = c.cast("string"), F.abs(c)
    whole = (c == F.floor(c)) & (size < 1e15) & (size >= 1)
    short = (size >= 1e-3) & (size < 1e7) & (F.length(text) <= 16) & ~text.endswith("0")
    return (F.when(whole, F.concat(c.cast("bigint").cast("string"), F.lit(whole_tail)))
            .when(short, text).otherwise(_any_double_text(c, low, high, whole_tail, power_digits)))


def _any_double_text(c: Column, low: int, high: int, whole_tail: str, power_digits: int) -> Column:
    def shown(x):
        d, e, n = x["d"], x["e"], F.length(x["d"])
        plain = (F.when(e < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), d))
                 .when(n <= e + 1, F.concat(d, F.repeat(F.lit("0"), e + 1 - n), F.lit(whole_tail)))
                 .otherwise(F.concat(d.substr(F.lit(1), e + 1), F.lit("."), d.substr(e + 2, n))))
        head = F.when(n > 1, F.concat(F.substring(d, 1, 1), F.lit("."), d.substr(F.lit(2), n))).otherwise(d)
        power = F.abs(e).cast("string")
        power = F.when(F.length(power) < power_digits, F.lpad(power, power_digits, "0")).otherwise(power)
        scientific = F.concat(head, F.lit("e"), F.when(e < 0, F.lit("-")).otherwise(F.lit("+")), power)
        return F.concat(x["sign"], F.when((e >= low) & (e < high), plain).otherwise(scientific))

    return _let(_scientific(c), shown)


def py_repr(col: Column | str) -> Column:
    """Python ``str(float)``: the shortest digits, at least one decimal
    (``15000.0``, ``0.30000000000000004``), scientific below 1e-4 and from 1e16."""
    c = _c(col).cast("double")
    return (F.when(c.isNull(), F.lit("None"))
            .when(F.isnan(c), F.lit("nan"))
            .when(c == float("inf"), F.lit("inf"))
            .when(c == float("-inf"), F.lit("-inf"))
            .otherwise(_double_text(c, -4, 16, ".0", 2)))


def py_text_repr(col: Column | str) -> Column:
    """Python ``repr(str)``: single quotes, or double ones around a text that
    holds only single ones; null → ``None``."""
    c = _c(col)
    t = c
    for raw, shown in (("\\", "\\\\"), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        t = F.replace(t, F.lit(raw), F.lit(shown))
    double = t.contains("'") & ~t.contains('"')
    return (F.when(c.isNull(), F.lit("None"))
            .when(double, F.concat(F.lit('"'), t, F.lit('"')))
            .otherwise(F.concat(F.lit("'"), F.replace(t, F.lit("'"), F.lit("\\'")), F.lit("'"))))


def json_text(col: Column | str, dtype) -> Column:
    """A cell as Python's ``json.dumps(v, default=str, ensure_ascii=False)`` prints it."""
    c = _c(col)
    kind = dtype.typeName()
    if kind in ("double", "float"):
        shown = F.when(F.isnan(c), F.lit("NaN")).when(F.abs(c) == float("inf"), F.when(c > 0, F.lit("Infinity"))
                                                      .otherwise(F.lit("-Infinity"))).otherwise(py_repr(c))
    elif kind in ("long", "integer", "short", "byte", "boolean"):
        shown = c.cast("string")
    elif kind in ("date", "timestamp", "timestamp_ntz"):
        shown = F.concat(F.lit('"'), py_datetime_text(c, is_date=kind == "date"), F.lit('"'))
    else:
        quoted = F.to_json(F.array(c.cast("string")))
        shown = F.substring(quoted, F.lit(2), F.length(quoted) - 2)
    return F.coalesce(F.when(c.isNotNull(), shown), F.lit("null"))


def py_value_text(value: Column | str, is_int: Column) -> Column:
    """Python ``str(v)`` of a value that was an int (``is_int``) or a float."""
    v = _c(value).cast("double")
    return F.when(is_int & v.isNotNull(), v.cast("bigint").cast("string")).otherwise(py_repr(v))


def py_datetime_text(col: Column | str, is_date: bool = False) -> Column:
    """Python ``str()`` of a date / datetime: seconds always, microseconds
    only when not zero; null → ``None``."""
    c = _c(col)
    if is_date:
        return F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit("None"))
    micro = F.date_format(c, "SSSSSS")
    base = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return F.coalesce(F.when(micro == "000000", base).otherwise(F.concat(base, F.lit("."), micro)), F.lit("None"))


def js_number_text(col: Column | str) -> Column:
    """JavaScript ``String(x)`` of a double: integral values without ``.0``,
    scientific below 1e-6 and from 1e21; null stays null."""
    c = _c(col).cast("double")
    return (F.when(F.isnan(c), F.lit("NaN")).when(c == float("inf"), F.lit("Infinity"))
            .when(c == float("-inf"), F.lit("-Infinity")).when(c == 0, F.lit("0"))
            .otherwise(_double_text(c, -6, 21, "", 1)))


def _id_groups(whole: Column) -> Column:
    """Indonesian digit groups: ``1.234.568``."""
    return F.translate(F.format_number(F.abs(whole), 0), ",", ".")


def number_id(col: Column | str) -> Column:
    """Indonesian number text with no decimals, ties away from zero."""
    r = F.round(_c(col).cast("double"), 0)
    return F.when(r < 0, F.concat(F.lit("-"), _id_groups(r))).otherwise(_id_groups(r))


def rupiah(col: Column | str) -> Column:
    """Rupiah text ``Rp 1.234.568`` (non-breaking blank), ties away from zero."""
    r = F.round(_c(col).cast("double"), 0)
    body = F.concat(F.lit("Rp" + NBSP), _id_groups(r))
    return F.when(r < 0, F.concat(F.lit("-"), body)).otherwise(body)


def table_cell_text(value: Column | str, field_name: str | None = None, numeric_input: bool = False) -> Column:
    """cell text — no number → the text itself; money column → Rupiah;
    else Indonesian number text."""
    v = _c(value)
    num = lenient_number_of_number(v) if numeric_input else lenient_number(v)
    raw = F.coalesce(v.cast("string"), F.lit(""))
    money = field_name is not None and is_currency_name(field_name)
    shown = rupiah(num) if money else number_id(num)
    return F.when(num.isNull(), raw).otherwise(shown)


def kpi_text(value: Column | str, kind: Column | str) -> Column:
    """KPI value text by KPI type."""
    v, k = _c(value), _c(kind)
    return (F.when(k == "currency", rupiah(v))
            .when(k == "percentage", F.concat(number_id(v), F.lit("%")))
            .when(k.isin("count", "number"), number_id(v))
            .otherwise(js_number_text(v)))


def short_hash(col: Column | str) -> Column:
    """first 16 hex digits of SHA-256."""
    return F.substring(F.sha2(_c(col), 256), 1, 16)


def file_suffix(col: Column | str) -> Column:
    return F.lower(F.regexp_extract(_c(col), r"(\.[^./\\]*)$", 1))


def file_type(col: Column | str) -> Column:
    """F8: upload type label by lower-cased suffix."""
    suf = file_suffix(col)
    out = None
    for ext, label in FILE_TYPES:
        out = F.when(suf == ext, label) if out is None else out.when(suf == ext, label)
    return out.otherwise(UNKNOWN_FILE_TYPE)


def allowed_file(col: Column | str) -> Column:
    return file_suffix(col).isin([ext for ext, _ in FILE_TYPES])


def underscores_to_blanks(col: Column | str) -> Column:
    return F.regexp_replace(_c(col), "_", " ")
