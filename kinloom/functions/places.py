"""Free-text places: normal form, region, society form and query ladder."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinloom.functions.text import WS, blank_to_null, let, lookup, squash, trim

# State names and postal codes.
STATES = {
    "AL": "Alabama", "AK": "Alaska", "AZ": "Arizona", "AR": "Arkansas", "CA": "California",
    "CO": "Colorado", "CT": "Connecticut", "DE": "Delaware", "FL": "Florida", "GA": "Georgia",
    "HI": "Hawaii", "ID": "Idaho", "IL": "Illinois", "IN": "Indiana", "IA": "Iowa",
    "KS": "Kansas", "KY": "Kentucky", "LA": "Louisiana", "ME": "Maine", "MD": "Maryland",
    "MA": "Massachusetts", "MI": "Michigan", "MN": "Minnesota", "MS": "Mississippi",
    "MO": "Missouri", "MT": "Montana", "NE": "Nebraska", "NV": "Nevada",
    "NH": "New Hampshire", "NJ": "New Jersey", "NM": "New Mexico", "NY": "New York",
    "NC": "North Carolina", "ND": "North Dakota", "OH": "Ohio", "OK": "Oklahoma",
    "OR": "Oregon", "PA": "Pennsylvania", "RI": "Rhode Island", "SC": "South Carolina",
    "SD": "South Dakota", "TN": "Tennessee", "TX": "Texas", "UT": "Utah", "VT": "Vermont",
    "VA": "Virginia", "WA": "Washington", "WV": "West Virginia", "WI": "Wisconsin",
    "WY": "Wyoming", "DC": "District of Columbia",
}

# Country words dropped when they end a place.
COUNTRY_WORDS = [
    "united states", "usa", "us", "u.s.", "u.s.a.", "united states of america", "england",
    "scotland", "ireland", "wales", "uk", "u.k.", "united kingdom", "canada",
]

# Country spellings and word abbreviations expanded in queries.
COUNTRY_ALIASES = {
    "usa": "United States", "us": "United States", "u.s.": "United States",
    "u.s.a.": "United States", "united states of america": "United States",
    "uk": "United Kingdom", "u.k.": "United Kingdom", "england": "England",
}
WORD_EXPANSIONS = {
    "co": "County", "cnty": "County", "twp": "Township", "ft": "Fort", "mt": "Mount",
    "par": "Parish",
}


def split_place(raw: Column) -> Column:
    return F.filter(F.transform(F.split(raw, ","), squash), lambda p: p != "")


def place_key(parts: Column) -> Column:
    return F.lower(F.array_join(parts, ", "))


def parse_place(raw: Column) -> Column:
    """``struct<raw, normalized, parts>``; parts run from most to least specific."""
    return F.when(
        raw.isNotNull(),
        let(
            split_place(raw),
            lambda p: F.struct(
                raw.alias("raw"), place_key(p).alias("normalized"), p.alias("parts")
            ),
        ),
    )


def region_of(parts: Column, raw: Column) -> Column:
    """Last part, or the one before it when the last one is a country word."""

    def pick(clean: Column) -> Column:
        last = F.try_element_at(clean, F.lit(-1))
        is_country = F.lower(last).isin(COUNTRY_WORDS) & (F.size(clean) >= 2)
        return F.when(is_country, F.try_element_at(clean, F.lit(-2))).otherwise(last)

    from_raw = F.filter(F.transform(F.split(raw, ","), trim), lambda p: p != "")
    chosen = F.when(F.size(parts) > 0, F.filter(parts, lambda p: p != "")).otherwise(from_raw)
    return let(chosen, pick)


def state_code(segment: Column) -> Column:
    """Two-letter code for a state name or code, else null."""
    by_name = {name.lower(): code for code, name in STATES.items()}

    def pick(text: Column) -> Column:
        code = F.upper(text)
        return F.coalesce(
            lookup(by_name, F.lower(text)), F.when(code.isin(list(STATES)), code)
        )

    return let(trim(segment), pick)


def _without_county(segment: Column) -> Column:
    plain = F.regexp_replace(segment, f"(?i){WS}*\\bcounty\\b{WS}*$", "")
    return trim(F.regexp_replace(plain, f"(?i){WS}*\\bco\\.?{WS}*$", ""))


def _names_county(segment: Column) -> Column:
    return segment.rlike(f"(?i)\\bcounty\\b{WS}*$") | segment.rlike(f"(?i)\\bco\\.?{WS}*$")


def society_place(raw: Column) -> Column:
    """``City/County/ST`` with empty slots kept; empty text for an empty place."""

    def layout(segs: Column, at: Column) -> Column:
        here = F.element_at(segs, at)
        state = F.coalesce(state_code(here), here)
        before = F.try_element_at(segs, at - 1)
        lone = at == 2
        county = F.when(at == 1, "").when(lone & ~_names_county(before), "")
        county = county.otherwise(_without_county(before))
        city = F.when(at == 1, "").when(lone & _names_county(before), "").when(lone, before)
        city = city.otherwise(trim(F.array_join(F.slice(segs, 1, F.greatest(at - 2, F.lit(0))), ", ")))
        return F.concat_ws("/", city, county, state)

    def run(segs: Column) -> Column:
        found = F.array_position(F.transform(segs, lambda s: state_code(s).isNotNull()), True)
        at = F.when(found > 0, found.cast("int")).otherwise(F.least(F.lit(3), F.size(segs)))
        empty = (F.size(segs) == 1) & (F.element_at(segs, 1) == "")
        return F.when(empty, "").otherwise(let(at, lambda i: layout(segs, i)))

    return F.when(raw.isNull(), "").otherwise(
        let(F.transform(F.split(raw, ","), trim), run)
    )


def _clean_part(part: Column) -> Column:
    """``struct<text, expanded>`` for one place part."""

    def expand_word(word: Column) -> Column:
        key = F.lower(F.regexp_replace(word, "\\.+$", ""))
        return F.coalesce(lookup(WORD_EXPANSIONS, key), word)

    def run(text: Column) -> Column:
        whole = F.coalesce(
            lookup(COUNTRY_ALIASES, F.lower(text)),
            F.when(text.rlike("^[A-Za-z]{2}$"), lookup(STATES, F.upper(text))),
        )
        words = F.array_join(F.transform(F.split(text, f"{WS}+"), expand_word), " ")
        return let(
            F.coalesce(whole, words),
            lambda out: F.struct(
                out.alias("text"), (whole.isNotNull() | (out != text)).alias("expanded")
            ),
        )

    return let(trim(part), run)


def query_ladder(parts: Column, raw: Column) -> Column:
    """Lookup texts from most to least precise, the raw text last, no repeats."""

    def keep(acc: Column, token: Column) -> Column:
        prev = F.try_element_at(acc, F.lit(-1))
        echo = (
            (F.lower(prev["text"]) == F.lower(token["text"]))
            & (prev["expanded"] | token["expanded"])
        )
        return F.when(F.coalesce(echo, F.lit(False)), acc).otherwise(F.concat(acc, F.array(token)))

    def suffixes(texts: Column) -> Column:
        steps = F.when(F.size(texts) > 0, F.sequence(F.lit(1), F.size(texts)))
        steps = steps.otherwise(F.array().cast("array<int>"))
        return F.transform(
            steps, lambda i: F.array_join(F.slice(texts, i, F.size(texts)), ", ")
        )

    def first_spellings(cands: Column) -> Column:
        lowered = F.transform(cands, F.lower)
        return F.filter(cands, lambda c, i: (c != "") & (F.array_position(lowered, F.lower(c)) == i + 1))

    source = F.when(F.size(parts) > 0, parts).otherwise(F.split(raw, ","))
    tokens = F.filter(F.transform(source, _clean_part), lambda t: t["text"] != "")
    empty = F.array().cast("array<struct<text:string,expanded:boolean>>")
    kept = F.transform(F.aggregate(tokens, empty, keep), lambda t: t["text"])
    ladder = let(kept, suffixes)
    return let(F.concat(ladder, F.array(trim(raw))), first_spellings)


def place_head(parts: Column, raw: Column) -> Column:
    """Most specific part of a place."""
    return F.coalesce(blank_to_null(F.try_element_at(parts, F.lit(1))), raw)
