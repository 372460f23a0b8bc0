"""Standard war, branch, rank and unit of a free-text military event."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinloom.functions.text import blank_to_null, first_rule, squash

# War windows (inclusive years), in era order.
WARS = [
    ("revolution", "American Revolution", 1775, 1783),
    ("war1812", "War of 1812", 1812, 1815),
    ("mexican", "Mexican–American War", 1846, 1848),
    ("civil", "Civil War", 1861, 1865),
    ("spanish", "Spanish–American War", 1898, 1898),
    ("wwi", "World War I", 1917, 1918),
    ("wwii", "World War II", 1941, 1945),
    ("korea", "Korean War", 1950, 1953),
    ("vietnam", "Vietnam War", 1961, 1975),
]

# Ordered patterns, the first that matches wins.
BRANCH_RULES = [
    (r"\bcontinental army\b", "Continental Army"),
    (r"\bair force\b|\barmy air\b", "Air Force"),
    (r"\bcoast guard\b", "Coast Guard"),
    (r"\bmarine(?:s| corps)?\b", "Marine Corps"),
    (r"\bconfederate\b|\bc\.?s\.?a\.?\b", "Confederate"),
    (r"\bunion army\b|\bunion\b", "Union"),
    (r"\bnav(?:y|al)\b", "Navy"),
    (r"\bmilitia\b", "Militia"),
    (r"\barmy\b", "Army"),
]
RANK_RULES = [
    (r"\bbrigadier general\b|\bbrig\.? gen\.?\b", "Brigadier General"),
    (r"\bgeneral\b|\bgen\.?\b", "General"),
    (r"\bcolonel\b|\bcol\.?\b", "Colonel"),
    (r"\bmajor\b|\bmaj\.?\b", "Major"),
    (r"\bcaptain\b|\bcapt?\.?\b|\bcpt\.?\b", "Captain"),
    (r"\blieutenant\b|\b(?:1st |2nd )?lt\.?\b", "Lieutenant"),
    (r"\bsergeant\b|\bsgt\.?\b", "Sergeant"),
    (r"\bcorporal\b|\bcpl\.?\b", "Corporal"),
    (r"\bprivate\b|\bpvt\.?\b", "Private"),
    (r"\bensign\b", "Ensign"),
    (r"\badmiral\b", "Admiral"),
    (r"\bseaman\b", "Seaman"),
]
WAR_RULES = [
    (r"\brevolution(?:ary)?\b", "American Revolution"),
    (r"\bwar of 1812\b", "War of 1812"),
    (r"\bmexican[- ]american\b|\bmexican war\b", "Mexican–American War"),
    (r"\bcivil war\b", "Civil War"),
    (r"\bspanish[- ]american\b", "Spanish–American War"),
    (r"\bworld war (?:i|1)\b|\bww[i1]\b|\bgreat war\b", "World War I"),
    (r"\bworld war (?:ii|2)\b|\bww(?:ii|2)\b", "World War II"),
    (r"\bkorean? war\b|\bkorea\b", "Korean War"),
    (r"\bvietnam\b", "Vietnam War"),
]
UNIT_PATTERN = (
    r"(?i)\b(\d+(?:st|nd|rd|th)?\s+(?:[A-Za-z.][\w.]*\s+)*?"
    r"(?:Infantry|Cavalry|Artillery|Regiment|Volunteers|Militia|Dragoons|Brigade|Battalion|Division))\b"
)


def war_of_year(year: Column) -> Column:
    """Name of the war whose window holds the year; windows do not overlap."""
    out = None
    for _, name, start, end in WARS:
        hit = year.between(start, end)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def war_order(name: Column) -> Column:
    """Era position of a war name, for ordered lists."""
    return F.array_position(F.array(*[F.lit(w[1]) for w in WARS]), name)


def standard_service(description: Column, year: Column) -> Column:
    text = F.coalesce(description, F.lit(""))
    return F.struct(
        F.coalesce(war_of_year(year), first_rule(text, WAR_RULES)).alias("war"),
        first_rule(text, BRANCH_RULES).alias("branch"),
        first_rule(text, RANK_RULES).alias("rank"),
        blank_to_null(squash(F.regexp_extract(text, UNIT_PATTERN, 1))).alias("unit"),
    )
