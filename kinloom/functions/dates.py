"""Uncertain genealogical dates as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinloom.functions.text import WS, let, lookup, pad_left, trim

# Month abbreviations of the file format and of the society form.
MONTHS = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]
SOCIETY_MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]

# Calendar escapes that are not the default calendar.
CALENDARS = {
    "JULIAN": "julian",
    "HEBREW": "hebrew",
    "FRENCH R": "french republican",
    "ROMAN": "roman",
    "UNKNOWN": "unknown",
}

# One-date qualifiers.
QUALIFIERS = {
    "ABT": "about",
    "BEF": "before",
    "AFT": "after",
    "EST": "estimated",
    "CAL": "calculated",
}

MISSING_SORT_KEY = 9007199254740991

DATE_TYPE = (
    "struct<raw:string,qualifier:string,year:int,month:int,day:int,iso:string,"
    "range_end:struct<year:int,month:int,day:int>,calendar:string>"
)

_ESCAPE = f"^@#D([^@]*)@{WS}*"
_BC = f"(?i){WS}*\\b(B\\.?{WS}*C\\.?)$"
_BET = f"(?i)^BET\\b\\.?{WS}+(.*?){WS}+AND{WS}+(.*)$"
_FROM_TO = f"(?i)^FROM\\b{WS}+(.*?){WS}+TO{WS}+(.*)$"
_FROM = f"(?i)^FROM\\b{WS}+(.*)$"
_TO = f"(?i)^TO\\b{WS}+(.*)$"
# Most dates are "[[day] month] year"; these skip the token fold.
_COMMON = (
    f"(?i)^(?:(?:(0?[1-9]|[12][0-9]|3[01]){WS}+)?({'|'.join(MONTHS)}){WS}+)?([0-9]{{3,9}})$"
)
_KEYWORD = "(?i)^(BET|FROM|TO|ABT|BEF|AFT|EST|CAL)\\b"


def _qualified(keyword: str) -> str:
    return f"(?i)^{keyword}\\b\\.?{WS}+(.*)$"


def _int(col: Column) -> Column:
    return col.try_cast("int")


def _double_year(token: Column) -> Column:
    """``1745/46`` -> 1746, ``1699/00`` -> 1700; null when not a double year."""
    pattern = "^(\\d{3,})/(\\d{1,4})$"
    first = _int(F.regexp_extract(token, pattern, 1))
    second_text = F.regexp_extract(token, pattern, 2)
    second = _int(second_text)
    grafted = F.floor(first / 100).cast("int") * 100 + second
    rolled = F.when(grafted > first, grafted).otherwise(grafted + 100)
    return F.when(
        token.rlike(pattern), F.when(F.length(second_text) <= 2, rolled).otherwise(second)
    )


def date_parts(token: Column) -> Column:
    """Year, month and day named by one date token."""

    def fold(acc: Column, tok: Column) -> Column:
        month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.upper(tok)).cast("int")
        digits = tok.rlike("^[0-9]+$")
        value = F.when(digits, _int(tok))
        as_day = (F.length(tok) <= 2) & acc["day"].isNull() & F.coalesce(value, F.lit(0)).between(1, 31)
        year = F.when(F.instr(tok, "/") > 0, _double_year(tok)).when(digits & ~as_day, value)
        return F.struct(
            F.coalesce(year, acc["year"]).cast("int").alias("year"),
            F.when(month > 0, month).otherwise(acc["month"]).cast("int").alias("month"),
            F.when(as_day, value).otherwise(acc["day"]).cast("int").alias("day"),
        )

    def finish(acc: Column, is_bc: Column) -> Column:
        day = F.when(acc["year"].isNotNull() | acc["month"].isNotNull(), acc["day"])
        year = F.when(is_bc, -acc["year"]).otherwise(acc["year"])
        return F.struct(year.alias("year"), acc["month"].alias("month"), day.alias("day"))

    def run(text: Column, is_bc: Column) -> Column:
        working = F.when(is_bc, trim(F.regexp_replace(text, _BC, ""))).otherwise(text)
        tokens = F.filter(F.split(working, f"{WS}+"), lambda t: t != "")
        empty = F.struct(
            *[F.lit(None).cast("int").alias(n) for n in ("year", "month", "day")]
        )
        return let(F.aggregate(tokens, empty, fold), lambda acc: finish(acc, is_bc))

    def common_form(text: Column) -> Column:
        month = F.array_position(
            F.array(*[F.lit(m) for m in MONTHS]), F.upper(F.regexp_extract(text, _COMMON, 2))
        )
        day = F.regexp_extract(text, _COMMON, 1)
        return F.struct(
            F.regexp_extract(text, _COMMON, 3).cast("int").alias("year"),
            F.when(month > 0, month).cast("int").alias("month"),
            F.when(day != "", day).cast("int").alias("day"),
        )

    return let(
        trim(token),
        lambda text: F.when(text.rlike(_COMMON), common_form(text)).otherwise(
            let(text.rlike(_BC), lambda is_bc: run(text, is_bc))
        ),
    )


def _usable(parts: Column) -> Column:
    return F.coalesce(parts["year"], parts["month"], parts["day"]).isNotNull()


def parse_date(raw: Column) -> Column:
    """Normalise one DATE value; never fails and keeps ``raw`` untouched."""
    none = F.lit(None).cast("string")

    def kind_of(w: Column, word: Column) -> Column:
        kind = F.when(w == "", "none").when(word == "", "exact")
        kind = kind.when((word == "BET") & w.rlike(_BET), "bet")
        kind = kind.when((word == "FROM") & w.rlike(_FROM_TO), "span")
        kind = kind.when((word == "FROM") & w.rlike(_FROM), "from")
        kind = kind.when((word == "TO") & w.rlike(_TO), "to")
        for keyword, name in QUALIFIERS.items():
            kind = kind.when((word == keyword) & w.rlike(_qualified(keyword)), name)
        return kind.otherwise("exact")

    def pieces(w: Column, kind: Column) -> Column:
        first = F.when(kind == "exact", w).when(kind == "bet", F.regexp_extract(w, _BET, 1))
        first = first.when(kind == "span", F.regexp_extract(w, _FROM_TO, 1))
        first = first.when(kind == "from", F.regexp_extract(w, _FROM, 1)).when(kind == "to", none)
        for keyword, name in QUALIFIERS.items():
            first = first.when(kind == name, F.regexp_extract(w, _qualified(keyword), 1))
        second = F.when(kind == "bet", F.regexp_extract(w, _BET, 2))
        second = second.when(kind == "span", F.regexp_extract(w, _FROM_TO, 2))
        second = second.when(kind == "to", F.regexp_extract(w, _TO, 1))
        return F.struct(
            kind.alias("kind"), first.otherwise(none).alias("first"), second.otherwise(none).alias("second")
        )

    def split_form(text: Column) -> Column:
        return let(
            text,
            lambda w: let(
                kind_of(w, F.upper(F.regexp_extract(w, _KEYWORD, 1))), lambda kind: pieces(w, kind)
            ),
        )

    def assemble(form: Column, a: Column, b: Column, calendar: Column) -> Column:
        kind = form["kind"]
        ranged = kind.isin("bet", "span", "from", "to")
        good = F.when(ranged, _usable(a) | _usable(b)).otherwise(_usable(a))
        good = F.coalesce(good, F.lit(False)) & (kind != "none")
        qualifier = F.when(~good, "unknown").when(ranged, "range").otherwise(kind)
        full = (
            (qualifier == "exact") & calendar.isNull() & (a["year"] > 0)
            & a["month"].isNotNull() & a["day"].isNotNull()
        )
        iso = F.concat_ws(
            "-", pad_left(a["year"], 4), pad_left(a["month"], 2), pad_left(a["day"], 2)
        )
        return F.struct(
            raw.alias("raw"),
            qualifier.alias("qualifier"),
            F.when(good, a["year"]).alias("year"),
            F.when(good, a["month"]).alias("month"),
            F.when(good, a["day"]).alias("day"),
            F.when(full, iso).alias("iso"),
            F.when(good & ranged & _usable(b), b).alias("range_end"),
            calendar.alias("calendar"),
        )

    def run(trimmed: Column) -> Column:
        name = F.upper(trim(F.regexp_extract(trimmed, _ESCAPE, 1)))
        escaped = F.startswith(trimmed, F.lit("@#D"))
        calendar = F.when(escaped, lookup(CALENDARS, name))
        plain = F.when(escaped, trim(F.regexp_replace(trimmed, _ESCAPE, ""))).otherwise(trimmed)
        return let(
            split_form(plain),
            lambda form: let(
                F.struct(
                    F.when(form["first"].isNotNull(), date_parts(form["first"])).alias("a"),
                    F.when(form["second"].isNotNull(), date_parts(form["second"])).alias("b"),
                ),
                lambda ab: assemble(form, ab["a"], ab["b"], calendar),
            ),
        )

    return F.when(raw.isNotNull(), let(trim(raw), run))


def society_date(year: Column, month: Column, day: Column) -> Column:
    """``04 Jul 1776``, ``Jul 1776``, ``1776``, ``44 BC`` or an empty string."""
    label = F.when(year < 0, F.concat(F.abs(year).cast("string"), F.lit(" BC")))
    label = label.otherwise(year.cast("string"))
    known_month = month.between(1, 12)
    month_name = F.when(
        known_month,
        F.try_element_at(F.array(*[F.lit(m) for m in SOCIETY_MONTHS]), month.cast("int")),
    )
    day_text = F.when(known_month & day.between(1, 31), F.lpad(day.cast("string"), 2, "0"))
    return F.when(year.isNull(), "").otherwise(F.concat_ws(" ", day_text, month_name, label))


def sort_key(year: Column, month: Column, day: Column) -> Column:
    """Chronological key; undated events sort last."""
    key = year.cast("bigint") * 10000 + F.coalesce(month, F.lit(0)) * 100 + F.coalesce(day, F.lit(0))
    return F.coalesce(key, F.lit(MISSING_SORT_KEY).cast("bigint"))


def life_span(birth_year: Column, death_year: Column) -> Column:
    birth, death = birth_year.cast("string"), death_year.cast("string")
    return (
        F.when(birth.isNotNull() & death.isNotNull(), F.concat(birth, F.lit("–"), death))
        .when(birth.isNotNull(), F.concat(F.lit("b. "), birth))
        .when(death.isNotNull(), F.concat(F.lit("d. "), death))
        .otherwise("")
    )
