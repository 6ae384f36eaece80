"""Romanisation of scripts whose consonants carry a vowel, compiled to one expression.

A text is brought to one spelling (joined letters and two-part vowel signs as
single letters, no joiners), cut into clusters by longest match, and every
cluster is looked up: its first letter and what follows each pick a value out
of a table that is indexed by code point. No letter is ever a row, and a text
is passed over once, whatever the size of the tables.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

JOINERS = "‌‍"


@dataclass(frozen=True)
class Script:
    """Tables of one Unicode block; ``inherent`` is what a bare consonant carries.

    ``joined`` maps spellings with a joiner to one letter, ``composed`` two
    signs to one. Letters of the block that no table has stay as they are.
    """

    first: int
    last: int
    consonants: Mapping[str, str]
    signs: Mapping[str, str]
    others: Mapping[str, str]
    virama: str
    inherent: str = "a"
    joined: Mapping[str, str] = field(default_factory=dict)
    composed: Mapping[str, str] = field(default_factory=dict)

    @property
    def letters(self) -> str:
        """The block as a character class without brackets."""
        return f"{chr(self.first)}-{chr(self.last)}"

    def table(self, *parts: Mapping[str, str]) -> Column:
        """Values by code point; letters without one stand for themselves."""
        known = {k: v for part in parts for k, v in part.items()}
        return F.array(*[F.lit(known.get(chr(c), chr(c))) for c in range(self.first, self.last + 1)])


def one_spelling(c: Column, script: Script) -> Column:
    """Joined letters as one letter each, then no joiner behind a letter, then signs composed."""
    for spelled, letter in script.joined.items():
        c = F.replace(c, F.lit(spelled), F.lit(letter))
    c = F.regexp_replace(c, f"(?<=[{script.letters}])[{JOINERS}]+", "")
    for spelled, sign in script.composed.items():
        c = F.replace(c, F.lit(spelled), F.lit(sign))
    return c


def clusters(c: Column, script: Script) -> Column:
    """Array of a consonant with its sign or virama, single letters, and runs outside the block."""
    consonants, after = "".join(script.consonants), "".join(script.signs) + script.virama
    pattern = f"[{consonants}][{after}]?|[{script.letters}]|[^{script.letters}]+"
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def romanize(c: Column, script: Script) -> Column:
    """Romanised copy of a text; null stays null, text without a letter of the block stays as it is."""
    silent = {script.virama: ""}
    carried = {k: v + script.inherent for k, v in script.consonants.items()}
    alone = script.table(carried, script.signs, script.others, silent)
    stem, tail = script.table(script.consonants), script.table(script.signs, silent)

    def at(table: Column, letter: Column) -> Column:
        return F.get(table, F.ascii(letter) - script.first)

    def value(x: Column) -> Column:
        own = F.ascii(x).between(script.first, script.last)
        pair = F.concat(at(stem, x), at(tail, F.substring(x, 2, 1)))
        return F.when(~own, x).when(F.length(x) == 2, pair).otherwise(at(alone, x))

    text = F.array_join(F.transform(clusters(one_spelling(c, script), script), value), "")
    return F.when(F.rlike(c, F.lit(f"[{script.letters}]")), text).otherwise(c)
