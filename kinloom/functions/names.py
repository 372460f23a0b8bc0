"""Personal names and sex codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinloom.functions.text import blank_to_null, join_present, let, squash, trim

NAME_TYPE = "struct<raw:string,given:string,surname:string,full:string,is_primary:boolean>"


def parse_name(raw: Column, is_primary: Column) -> Column:
    """Split ``Given /Surname/ suffix``; a missing closing slash is tolerated."""
    slash = F.instr(raw, "/")
    before = F.when(slash > 0, F.substring_index(raw, "/", 1)).otherwise(raw)
    tail = F.when(slash > 0, F.substr(raw, slash + 1)).otherwise(F.lit(""))
    close = F.instr(tail, "/")
    inside = F.when(close > 0, F.substring_index(tail, "/", 1)).otherwise(tail)
    after = F.when(close > 0, F.substr(tail, close + 1)).otherwise(F.lit(""))
    pieces = F.struct(
        squash(before).alias("given"), squash(inside).alias("surname"), squash(after).alias("suffix")
    )
    return let(
        pieces,
        lambda p: F.struct(
            raw.alias("raw"),
            blank_to_null(p["given"]).alias("given"),
            blank_to_null(p["surname"]).alias("surname"),
            join_present(" ", p["given"], p["surname"], p["suffix"]).alias("full"),
            is_primary.alias("is_primary"),
        ),
    )


def parse_names(raws: Column) -> Column:
    """Parse a list of NAME values; the first one is primary."""
    return F.transform(raws, lambda raw, i: parse_name(raw, i == 0))


def parse_sex(raw: Column) -> Column:
    code = F.upper(trim(raw))
    return F.when(code == "M", "male").when(code == "F", "female").otherwise("unknown")


def _first(names: Column) -> Column:
    return F.try_element_at(names, F.lit(1))


def display_name(names: Column, fallback: Column | None = None) -> Column:
    """Full form of the primary name, its raw form, else the fallback text."""
    name = _first(names)
    other = F.lit("(unnamed)") if fallback is None else fallback
    return F.coalesce(blank_to_null(name["full"]), blank_to_null(name["raw"]), other)


def trimmed_name(names: Column, fallback: Column | None = None) -> Column:
    other = F.lit("(unnamed)") if fallback is None else fallback
    return F.coalesce(blank_to_null(trim(display_name(names, other))), other)


def name_matches(names: Column, query: Column) -> Column:
    """Case-insensitive substring test over every form of every name."""
    needle = F.lower(trim(query))

    def hit(n: Column) -> Column:
        forms = [F.coalesce(n[f], F.lit("")) for f in ("full", "given", "surname", "raw")]
        out = F.lit(False)
        for form in forms:
            out = out | F.contains(F.lower(form), needle)
        return out

    return (needle != "") & F.exists(names, hit)
