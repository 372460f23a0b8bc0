"""Token counts by rank-synchronous merging of ragged arrays.

Documents are cut into pre-tokens as the vocabulary's library does it. All
pre-tokens of a batch that are not known yet lie in one flat symbol array; each
round finds, for every sequence at once, the pair of lowest rank, merges all its
occurrences and drops the sequences that are finished. A document's count is
the sum of what survives of its pre-tokens.

The vocabulary's settings this module supports: NFC, white space folded, lower
case; pieces by one pattern; byte-level symbols with a word-end mark. Any other
file is refused.

Merging every occurrence of the lowest pair at once equals merging one by one
as long as a merge only uses symbols made by earlier merges, which is checked
when the vocabulary is loaded.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.llm.common import with_fields

VOCABULARY = "word_bpe_49k.json"
KNOWN_WORDS = 400_000  # pre-tokens a worker remembers before it starts afresh
NONE = np.int64(1) << 40


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(other)) for b in range(256)]


class Merger:
    """The merge table of a vocabulary file, and the merging of batches of pre-tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, mark = spec["model"], spec["model"]["end_of_word_suffix"] or ""
        steps = [n["type"] for n in spec["normalizer"]["normalizers"]]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        if steps != ["NFC", "Replace", "Lowercase"] or not split["invert"] or level["use_regex"] or level["add_prefix_space"]:
            raise ValueError(f"{path}: its normaliser or pre-tokeniser is not supported")
        self.pieces = regex.compile(split["pattern"]["Regex"])
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        ids = model["vocab"]
        letters = byte_letters()
        self.inner = np.array([ids[c] for c in letters], dtype=np.int64)
        self.last = np.array([ids[c + mark] for c in letters], dtype=np.int64)
        self.size = max(ids.values()) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([ids[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([ids[b] for _, b in pairs], dtype=np.int64)
        made = np.array([ids[a + b] for a, b in pairs], dtype=np.int64)
        rank = np.arange(len(pairs), dtype=np.int64)
        last_made = np.full(self.size, -1, dtype=np.int64)
        np.maximum.at(last_made, made, rank)
        if (last_made[left] >= rank).any() or (last_made[right] >= rank).any():
            raise ValueError(f"{path}: a merge uses a symbol that a later merge makes")
        key = left * self.size + right
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.made = key[order], rank[order], made[order]

    def symbols(self, words: list[bytes]) -> np.ndarray:
        """How many symbols each non-empty byte string ends up with."""
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        out = size.copy()
        if not len(words):
            return out
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        sym = self.inner[raw]
        end = np.cumsum(size) - 1
        sym[end] = self.last[raw[end]]
        word = np.repeat(np.arange(len(words)), size)
        while len(sym):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            rank = np.full(len(sym), NONE)
            key = sym[:-1] * self.size + sym[1:]
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            hit = (self.key[at] == key) & (word[1:] == word[:-1])
            rank[:-1][hit] = self.rank[at[hit]]
            best = np.minimum.reduceat(rank, first)
            length = np.diff(np.r_[first, len(sym)])
            out[word[first]] = length
            low = np.repeat(best, length)
            pair = np.flatnonzero((rank == low) & (low < NONE))
            if not len(pair):
                break
            # in a run such as "a a a" the pairs overlap: every second one counts
            run = np.flatnonzero(np.r_[True, np.diff(pair) > 1])
            nth = np.arange(len(pair)) - np.repeat(run, np.diff(np.r_[run, len(pair)]))
            pair = pair[nth % 2 == 0]
            sym[pair] = self.made[at[pair]]
            stays = low < NONE
            stays[pair + 1] = False
            sym, word = sym[stays], word[stays]
        return out

    def segments(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens of a text, and the number of special tokens in it."""
        if self.special is None:
            parts = [text]
        else:
            parts = self.special.split(text)
        found: list[str] = []
        for part in parts:
            # single letters are lowered on their own, so a final sigma is like any other
            part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            found += self.pieces.findall(part)
        return found, len(parts) - 1


@lru_cache(maxsize=4)
def merger(path: str) -> Merger:
    return Merger(path)


def n_tokens(text: Column, path: str) -> Column:
    """Token count of a text column; null counts as empty."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model, known = merger(path), {}
        for batch in batches:
            out = np.zeros(len(batch), dtype=np.int64)
            for low in range(0, len(batch), 256):
                split = [model.segments(t) if t else ([], 0) for t in batch.iloc[low:low + 256]]
                if len(known) > KNOWN_WORDS:
                    known = {}
                new = list(set().union(*(s[0] for s in split)) - known.keys())
                known.update(zip(new, model.symbols([w.encode() for w in new]).tolist(), strict=True))
                out[low:low + len(split)] = [sum(map(known.__getitem__, words)) + extra for words, extra in split]
            yield pd.Series(out)

    return count(text)


def count_tokens(docs: DataFrame, text: str = "text", vocabulary: str | None = None, limit: int = 2048) -> DataFrame:
    """``docs`` plus n_bytes, n_tokens and over_limit (more than ``limit`` tokens).

    Null and empty texts have 0 bytes and 0 tokens. Rows are kept as they are,
    repeated ones too; columns that already have one of the new names give way.
    ``vocabulary`` is the path of the file on the executors.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    tokens = n_tokens(F.col(text), path)
    found = F.struct(F.coalesce(F.octet_length(text), F.lit(0)).alias("n_bytes"), tokens.alias("n_tokens"))
    out = with_fields(docs, found, {"n_bytes": "long", "n_tokens": "long"})
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
