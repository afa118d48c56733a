"""Column expressions over single cells: missing tokens, numbers, dates, types, casing, masks.

Everything here is a pure ``Column -> Column`` function made of built-in expressions, so it stays
inside generated code and works on batch and streaming frames alike.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Tokens and patterns that decide how a cell is read. -----------------------------
NULL_TOKENS = ("", "null", "none", "nan", "n/a", "na", "-")
TRUE_TOKENS = ("true", "yes", "1", "y", "t")
FALSE_TOKENS = ("false", "no", "0", "n", "f")
BOOLEAN_SET = ("true", "false", "1", "0", "yes", "no", "t", "f")

RX_EDGE_SPACE = r"(?U)^\s+|\s+$"
RX_WHITESPACE_ISSUE = r"^\s+|\s+$|\s{2,}"
RX_NUMBER_JUNK = r"[$€£₹¥,\s]"
RX_NUMBER_JUNK_PERCENT = r"[$€£₹¥,%\s]"
RX_NUMBER = r"^[+-]?(\d{1,200}(\.\d*)?|\.\d+)([eE](\+?\d{1,2}|-\d{1,3}))?$"
RX_NULL_WORD = r"(?i)^(null|none|nan|n/a|-)$"
RX_BOOLEAN = r"(?i)^(true|false|yes|no)$"
RX_EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
RX_URL = r"(?i)^(https?://)?([\da-z.-]+)\.([a-z.]{2,6})([/\w .-]*)/?$"
RX_PHONE = r"^(\+?\d{1,3}[-.\s]?)?(\(?\d{3}\)?[-.\s]?)?\d{3}[-.\s]?\d{4}$"
RX_CURRENCY = r"^[$€£₹¥]\s?-?\d+([,.]\d+)*(\.\d+)?$|^-?\d+([,.]\d+)*(\.\d+)?\s?[$€£₹¥]$"
RX_PERCENT = r"^-?\d+(\.\d+)?%$"
RX_INTEGER = r"^-?\d{1,3}(,\d{3})*$|^-?\d+$"
RX_FLOAT = r"^-?\d+(\.\d+)$|^-?\d{1,3}(,\d{3})*\.\d+$"
RX_DIGITS = r"^\d+$"
RX_DATE_YMD = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})([T ].*)?$"
RX_DATE_MDY = r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})$"
RX_DATE_MDY_SHORT = r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{2})$"
RX_DATE_MONTH_NAME = r"^([A-Za-z]{3,9})\s(\d{1,2}),?\s(\d{4})$"
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

PII_NAMES_SERVER = ("name", "email", "phone", "ssn", "card", "address", "password", "user", "customer")
PII_NAMES_SHORT = ("name", "email", "phone", "ssn", "card", "user")
PII_NAMES_BROWSER = ("name", "email", "phone", "ssn", "card", "address", "mobile", "contact", "user", "student")
RX_PHONE_CELL = r"^\+?\d[\d\s\-()]{6,}$"
# -----------------------------------------------------------------------------------------------


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c) -> Column:
    return _col(c).cast("string")


def trim_ws(c) -> Column:
    """Strip every kind of Unicode white space at both ends."""
    return F.regexp_replace(text(c), RX_EDGE_SPACE, "")


def squeeze_ws(c) -> Column:
    """Strip the ends, fold inner runs of white space to one blank, read nan/None as missing."""
    folded = F.regexp_replace(trim_ws(c), r"(?U)\s+", " ")
    return F.when(~F.lower(folded).isin("nan", "none"), folded)


def is_missing(c, tokens=NULL_TOKENS) -> Column:
    return _col(c).isNull() | F.lower(trim_ws(c)).isin(*tokens)


def blank_missing(c, tokens=NULL_TOKENS) -> Column:
    """The cell, or null when it holds a missing-value token."""
    return F.when(~is_missing(c, tokens), _col(c))


def parse_numeric(c, scale_percent: bool = True) -> Column:
    """Number in a cell after dropping currency signs, separators and blanks; ``5%`` is 0.05."""
    cell = text(c)
    bare = F.regexp_replace(cell, RX_NUMBER_JUNK_PERCENT, "")
    number = F.when(bare.rlike(RX_NUMBER), bare.try_cast("double"))
    if not scale_percent:
        return number
    ends_percent = F.regexp_replace(cell, RX_NUMBER_JUNK, "").endswith("%")
    return number / F.when(ends_percent, 100.0).otherwise(1.0)


def to_numeric_strip(c) -> Column:
    return parse_numeric(c, scale_percent=False)


def finite_or_null(c) -> Column:
    """NaN and infinities become null."""
    x = _col(c)
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def _date_of(cell: Column) -> Column:
    year_short = F.regexp_extract(cell, RX_DATE_MDY_SHORT, 3).try_cast("int")
    century = F.when(year_short < 50, F.lit("20")).otherwise(F.lit("19"))
    numbers = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS, start=1) for x in (m, str(i))])
    month = F.try_element_at(numbers, F.lower(F.substring(F.regexp_extract(cell, RX_DATE_MONTH_NAME, 1), 1, 3)))
    iso = (
        F.when(cell.rlike(RX_DATE_YMD), F.regexp_replace(cell, RX_DATE_YMD, "$1-$2-$3"))
        .when(cell.rlike(RX_DATE_MDY), F.regexp_replace(cell, RX_DATE_MDY, "$3-$1-$2"))
        .when(
            cell.rlike(RX_DATE_MDY_SHORT),
            F.concat(century, F.regexp_replace(cell, RX_DATE_MDY_SHORT, "$3-$1-$2")),
        )
        .when(
            cell.rlike(RX_DATE_MONTH_NAME),
            F.concat_ws(
                "-",
                F.regexp_extract(cell, RX_DATE_MONTH_NAME, 3),
                F.coalesce(month, F.lit("?")),
                F.regexp_extract(cell, RX_DATE_MONTH_NAME, 2),
            ),
        )
    )
    return iso.try_cast("date")


def _long_enough(cell: Column) -> Column:
    return (F.length(cell) >= 6) & ~cell.rlike(RX_DIGITS)


def parse_date(c) -> Column:
    """Calendar date of an ISO, month-first or month-name cell; null when it is none of these."""
    return _date_of(trim_ws(c))


def is_valid_date(c) -> Column:
    cell = trim_ws(c)
    return F.coalesce(_long_enough(cell) & _date_of(cell).isNotNull(), F.lit(False))


def iso_date(c) -> Column:
    """``yyyy-MM-dd`` when the cell is a date, otherwise the cell unchanged."""
    cell = trim_ws(c)
    return F.coalesce(F.when(_long_enough(cell), F.date_format(_date_of(cell), "yyyy-MM-dd")), text(c))


def infer_value_type(c) -> Column:
    """Kind of a text cell; the first matching rule wins."""
    cell = trim_ws(c)
    return (
        F.when(cell.isNull() | (cell == "") | cell.rlike(RX_NULL_WORD), "null")
        .when(cell.rlike(RX_BOOLEAN), "boolean")
        .when(cell.rlike(RX_EMAIL), "email")
        .when(cell.rlike(RX_URL), "url")
        .when(cell.rlike(RX_PHONE), "phone")
        .when(cell.rlike(RX_CURRENCY), "currency")
        .when(cell.rlike(RX_PERCENT), "percentage")
        .when(cell.rlike(RX_INTEGER), "integer")
        .when(cell.rlike(RX_FLOAT), "float")
        .when(_long_enough(cell) & _date_of(cell).isNotNull(), "date")
        .otherwise("string")
    )


def title_case(c, style: str = "letters") -> Column:
    """``letters`` restarts a word after every non-letter, ``word`` only after blanks."""
    if style == "word":
        return F.initcap(text(c))
    runs = F.regexp_extract_all(text(c), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def flag_of(c) -> Column:
    """1/0 of a yes/no cell; other text counts as 1, missing stays missing."""
    cell = F.lower(trim_ws(c))
    return F.when(cell.isNull() | (cell == ""), None).when(cell.isin(*FALSE_TOKENS), 0).otherwise(1)


def floor_mod(a, b) -> Column:
    """Remainder with the sign of the divisor; null for a zero divisor."""
    x, y = _col(a).cast("double"), _col(b).cast("double")
    return x - y * F.floor(F.try_divide(x, y))


def cast_value(c, kind: str) -> Column:
    """One cell to a named target type; unreadable numbers and dates become null."""
    simple = {
        "numeric": lambda: parse_numeric(c),
        "float": lambda: parse_numeric(c),
        "integer": lambda: F.round(parse_numeric(c)).cast("bigint"),
        "date": lambda: F.date_format(parse_date(c), "yyyy-MM-dd"),
        "boolean": lambda: flag_of(c),
        "binary": lambda: flag_of(c),
        "uppercase": lambda: F.upper(trim_ws(c)),
        "lowercase": lambda: F.lower(trim_ws(c)),
        "titlecase": lambda: title_case(trim_ws(c), "word"),
    }
    for name in ("text", "string", "id", "target", "categorical", "category"):
        simple[name] = lambda: trim_ws(c)
    return simple[kind.lower()]()


def mask_server(c) -> Column:
    """E-mail keeps two letters and the domain, digit runs keep the ends, the rest is hashed."""
    cell = trim_ws(c)
    parts = F.split(cell, "@")
    return (
        F.when(cell.contains("@"), F.concat(F.substring(parts[0], 1, 2), F.lit("***@"), parts[1]))
        .when(cell.rlike(r"\d{3,}"), F.concat(F.substring(cell, 1, 2), F.lit("****"), F.right(cell, F.lit(2))))
        .otherwise(F.concat(F.lit("Anon_"), F.substring(F.sha2(cell, 256), 1, 8)))
    )


def mask_browser(c) -> Column:
    cell = text(c)
    parts = F.split(cell, "@")
    head = F.when(F.length(parts[0]) > 2, F.concat(F.substring(parts[0], 1, 2), F.lit("***"))).otherwise("***")
    domain = F.when(parts[1] == "", "domain.com").otherwise(parts[1])
    stars = F.repeat(F.lit("*"), F.least(F.lit(6), F.length(cell) - 4))
    return (
        F.when(cell.isNull() | (cell == ""), cell)
        .when(cell.contains("@"), F.concat(head, F.lit("@"), domain))
        .when(cell.rlike(RX_PHONE_CELL), F.concat(F.substring(cell, 1, 3), F.lit("****"), F.right(cell, F.lit(2))))
        .when(F.length(cell) > 4, F.concat(F.substring(cell, 1, 2), stars, F.right(cell, F.lit(2))))
        .otherwise("***")
    )


def mask_short(c) -> Column:
    cell = text(c)
    return F.when(cell.contains("@"), "***@***.com").otherwise(F.substring(F.sha2(cell, 256), 1, 8))


def redact_email_cell(c) -> Column:
    cell = text(c)
    return F.when(cell.contains("@"), "[EMAIL]").otherwise(cell)
