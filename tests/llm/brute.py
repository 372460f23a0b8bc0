"""Plain versions of the operators, one document at a time."""

from __future__ import annotations

import hashlib
import re

KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def sound(kind: str, value: str) -> bool:
    digits = re.sub(r"[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 10 <= len(digits) <= 15


def base_spans(text: str | None) -> list[tuple[int, int, str]]:
    found = [(m.start(), KINDS.index(k), m.end(), k) for k in KINDS for m in re.finditer(BASE[k], text or "") if sound(k, m[0])]
    return [(s, e, k) for s, _, e, k in sorted(found)]


def base_sha(text: str | None) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in base_spans(text)).encode()).hexdigest()


def words(text: str | None) -> list[str]:
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return [w for w in re.split(r"[\x20\x09-\x0D]+", lower) if w]


def shingles(text: str | None, n: int) -> set[tuple[str, ...]]:
    w = words(text)
    if len(w) < n:
        return {tuple(w)} if w else set()
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}


def components(docs: list[tuple[int, str | None]], n: int, percent: int) -> dict[int, int]:
    """Smallest id reachable, by comparing every pair."""
    sets = [(i, shingles(t, n)) for i, t in docs]
    parent = {i: i for i, _ in docs}

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, x) in enumerate(sets):
        for b, y in sets[k + 1:]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {i: root(i) for i, _ in docs}


def contamination(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], least: float) -> set[tuple[int, int]]:
    """(document, item) with an item-sized window that is similar enough, every window compared."""
    from collections import Counter

    def words5(text: str | None) -> list[str]:
        return re.findall(r"\w+", (text or "").lower())

    def count(w: list[str]) -> Counter:
        return Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))

    out = set()
    for item, it in items:
        size, want = len(words5(it)), count(words5(it))
        if size < 5 or item is None:
            continue
        for doc, text in docs:
            w = words5(text)
            for s in range(max(1, len(w) - size + 1)):
                have = count(w[s:s + size])
                both = sum((have & want).values())
                if both >= least * sum((have | want).values()) and both:
                    out.add((doc, item))
    return out
