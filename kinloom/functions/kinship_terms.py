"""Ordinals and kinship terms from generation distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ordinal words 0..20 and count words 0..10.
ORDINAL_WORDS = [
    "zeroth", "first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth",
    "ninth", "tenth", "eleventh", "twelfth", "thirteenth", "fourteenth", "fifteenth",
    "sixteenth", "seventeenth", "eighteenth", "nineteenth", "twentieth",
]
COUNT_WORDS = [
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten",
]


def _word(words: list[str], n: Column) -> Column:
    arr = F.array(*[F.lit(w) for w in words])
    return F.when((n >= 0) & (n < len(words)), F.try_element_at(arr, (n + 1).cast("int")))


def ordinal(n: Column) -> Column:
    """1st, 2nd, 3rd, 4th, 11th, 21st, ..."""
    tens, unit = F.abs(n) % 100, F.abs(n) % 10
    suffix = (
        F.when(tens.between(11, 13), "th")
        .when(unit == 1, "st").when(unit == 2, "nd").when(unit == 3, "rd").otherwise("th")
    )
    return F.concat(n.cast("string"), suffix)


def ordinal_word(n: Column) -> Column:
    return F.coalesce(_word(ORDINAL_WORDS, n), ordinal(n))


def removal_word(n: Column) -> Column:
    many = F.concat(F.coalesce(_word(COUNT_WORDS, n), n.cast("string")), F.lit(" times"))
    return F.when(n == 1, "once").when(n == 2, "twice").otherwise(many)


def great_prefix(greats: Column) -> Column:
    return (
        F.when(greats <= 0, "").when(greats == 1, "great-")
        .otherwise(F.concat(ordinal(greats), F.lit(" great-")))
    )


def by_sex(sex: Column, male: str, female: str, neutral: str) -> Column:
    return F.when(sex == "male", male).when(sex == "female", female).otherwise(neutral)


def _lineal(g: Column, root: Column) -> Column:
    return (
        F.when(g <= 1, root).when(g == 2, F.concat(F.lit("grand"), root))
        .otherwise(F.concat(great_prefix(g - 2), F.lit("grand"), root))
    )


def ancestor_term(g: Column, sex: Column) -> Column:
    return _lineal(g, by_sex(sex, "father", "mother", "parent"))


def descendant_term(g: Column, sex: Column) -> Column:
    return _lineal(g, by_sex(sex, "son", "daughter", "child"))


def collateral_term(a: Column, b: Column, sex: Column) -> Column:
    """Term for someone ``b`` below the shared ancestor, seen from ``a`` below it."""
    low, high = F.least(a, b), F.greatest(a, b)
    cousin = F.concat(ordinal_word(low - 1), F.lit(" cousin"))
    removed = F.concat(cousin, F.lit(" "), removal_word(high - low), F.lit(" removed"))
    uncle = F.concat(great_prefix(a - 2), by_sex(sex, "uncle", "aunt", "aunt or uncle"))
    nephew = F.concat(great_prefix(b - 2), by_sex(sex, "nephew", "niece", "niece or nephew"))
    return (
        F.when((a == 1) & (b == 1), by_sex(sex, "brother", "sister", "sibling"))
        .when((low == 1) & (b < a), uncle)
        .when(low == 1, nephew)
        .when(a == b, cousin)
        .otherwise(removed)
    )


UNRELATED = "no traceable relationship within this tree"
