"""Pre-filled search links from a person's facts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinloom.functions.text import blank_to_null, trim

# Addresses of the public search forms and their limits.
ANCESTRY_URL = "https://www.ancestry.com/search/?"
FAMILYSEARCH_URL = "https://www.familysearch.org/en/search/record/results?"
DAR_URL = "https://services.dar.org/Public/DAR_Research/search/?Tab_ID=1"
MAX_CHILDREN = 8
YEAR_SLACK = 2


def form_encode(col: Column) -> Column:
    """application/x-www-form-urlencoded."""
    return F.url_encode(col)


def plus_encode(col: Column) -> Column:
    """URI component encoding with ``+`` for spaces (leaves ``! ~ ' ( )`` as they are)."""
    out = F.url_encode(trim(col))
    for code, char in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def packed_name(name: Column) -> Column:
    """``given_surname`` of a struct<given, surname, full>."""
    given = blank_to_null(plus_encode(F.coalesce(name["given"], F.lit(""))))
    surname = blank_to_null(plus_encode(F.coalesce(name["surname"], F.lit(""))))
    both = blank_to_null(F.concat_ws("_", given, surname))
    return F.coalesce(both, plus_encode(F.coalesce(name["full"], F.lit(""))))


def _packed_event(year: Column, parts: Column) -> Column:
    place = F.when(F.size(parts) > 0, F.array_join(F.transform(parts, plus_encode), "-"))
    return blank_to_null(F.concat_ws("_", year.cast("string"), blank_to_null(place)))


def _param(key: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{key}="), value))


def ancestry_url(facts: Column) -> Column:
    """Link from a struct with self, birth/death year and parts, father, mother, spouse, children."""
    children = F.transform(
        F.slice(facts["children"], 1, MAX_CHILDREN),
        lambda c, i: F.concat(
            F.when(i == 0, "child=").otherwise(F.concat(F.lit("child"), (i + 1).cast("string"), F.lit("="))),
            packed_name(c),
        ),
    )
    spouse = facts["spouse"]
    gender = F.when(facts["sex"] == "male", "gender=m").when(facts["sex"] == "female", "gender=f")
    query = F.concat_ws(
        "&",
        _param("name", blank_to_null(packed_name(facts["self"]))),
        _param("birth", _packed_event(facts["birth_year"], facts["birth_parts"])),
        _param("death", _packed_event(facts["death_year"], facts["death_parts"])),
        F.when(facts["father"].isNotNull(), F.concat(F.lit("father="), packed_name(facts["father"]))),
        F.when(facts["mother"].isNotNull(), F.concat(F.lit("mother="), packed_name(facts["mother"]))),
        F.when(spouse.isNotNull(), F.concat(F.lit("spouse="), packed_name(spouse))),
        children, gender, F.lit("searchMode=advanced"),
    )
    return F.concat(F.lit(ANCESTRY_URL), query)


def familysearch_url(facts: Column) -> Column:
    window = lambda key, year: F.when(
        year.isNotNull(),
        F.concat_ws(
            "&",
            F.concat(F.lit(f"{key}.from="), (year - YEAR_SLACK).cast("string")),
            F.concat(F.lit(f"{key}.to="), (year + YEAR_SLACK).cast("string")),
        ),
    )
    text = lambda key, col: _param(key, form_encode(blank_to_null(col)))
    query = F.concat_ws(
        "&",
        text("q.givenName", facts["self"]["given"]), text("q.surname", facts["self"]["surname"]),
        text("q.birthLikePlace", facts["birth_raw"]), window("q.birthLikeDate", facts["birth_year"]),
        text("q.deathLikePlace", facts["death_raw"]), window("q.deathLikeDate", facts["death_year"]),
    )
    return F.concat(F.lit(FAMILYSEARCH_URL), query)


def dar_url() -> Column:
    return F.lit(DAR_URL)
