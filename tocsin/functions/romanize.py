"""Romanised copies of text, by string replacement inside the JVM."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from tocsin.functions.transducer import Script, romanize

# --- fixed values: Malayalam to ITRANS ------------------------------------
MALAYALAM_CONSONANTS = {
    "ക": "k", "ഖ": "kh", "ഗ": "g", "ഘ": "gh", "ങ": "~N",
    "ച": "ch", "ഛ": "Ch", "ജ": "j", "ഝ": "jh", "ഞ": "~n",
    "ട": "T", "ഠ": "Th", "ഡ": "D", "ഢ": "Dh", "ണ": "N",
    "ത": "t", "ഥ": "th", "ദ": "d", "ധ": "dh", "ന": "n",
    "പ": "p", "ഫ": "ph", "ബ": "b", "ഭ": "bh", "മ": "m",
    "യ": "y", "ര": "r", "ല": "l", "വ": "v", "ശ": "sh",
    "ഷ": "Sh", "സ": "s", "ഹ": "h", "ള": "L", "ഴ": "zh", "റ": "R",
}
MALAYALAM_VOWELS = {
    "അ": "a", "ആ": "A", "ഇ": "i", "ഈ": "I", "ഉ": "u", "ഊ": "U", "ഋ": "RRi",
    "എ": "e", "ഏ": "e", "ഐ": "ai", "ഒ": "o", "ഓ": "o", "ഔ": "au",
}
MALAYALAM_SIGNS = {
    "ാ": "A", "ി": "i", "ീ": "I", "ു": "u", "ൂ": "U", "ൃ": "RRi",
    "െ": "e", "േ": "e", "ൈ": "ai", "ൊ": "o", "ോ": "o", "ൌ": "au", "ൗ": "au",
}
MALAYALAM_OTHERS = {
    "ം": "M", "ഃ": "H",
    "ൺ": "N", "ൻ": "n", "ർ": "r", "ൽ": "l", "ൾ": "L", "ൿ": "k",
    "൦": "0", "൧": "1", "൨": "2", "൩": "3", "൪": "4",
    "൫": "5", "൬": "6", "൭": "7", "൮": "8", "൯": "9",
}
VIRAMA = "്"
MALAYALAM_JOINED = {  # a consonant, the virama and a zero-width joiner
    "ണ്\u200d": "ൺ", "ന്\u200d": "ൻ", "ര്\u200d": "ർ",
    "ല്\u200d": "ൽ", "ള്\u200d": "ൾ", "ക്\u200d": "ൿ",
}
MALAYALAM_COMPOSED = {"െ" + "ാ": "ൊ", "േ" + "ാ": "ോ", "െ" + "ൗ": "ൌ"}

# --- fixed values: accented Latin letters to ASCII ------------------------
LATIN_ACCENTS = {
    "à": "a", "á": "a", "â": "a", "ä": "a", "ç": "c", "è": "e", "é": "e",
    "ê": "e", "ë": "e", "í": "i", "î": "i", "ï": "i", "ñ": "n", "ó": "o",
    "ô": "o", "ö": "o", "ù": "u", "ú": "u", "û": "u", "ü": "u",
    "À": "A", "Á": "A", "Â": "A", "Ä": "A", "Ç": "C", "È": "E", "É": "E",
    "Ê": "E", "Ë": "E", "Í": "I", "Î": "I", "Ï": "I", "Ñ": "N", "Ó": "O",
    "Ô": "O", "Ö": "O", "Ù": "U", "Ú": "U", "Û": "U", "Ü": "U",
    "ß": "ss",
}


MALAYALAM = Script(
    first=0x0D00,
    last=0x0D7F,
    consonants=MALAYALAM_CONSONANTS,
    signs=MALAYALAM_SIGNS,
    others=MALAYALAM_VOWELS | MALAYALAM_OTHERS,
    virama=VIRAMA,
    joined=MALAYALAM_JOINED,
    composed=MALAYALAM_COMPOSED,
)


def map_characters(c: Column, mapping: Mapping[str, str]) -> Column:
    """Replace characters: one-to-one in a single pass, longer ones each in turn."""
    single = {k: v for k, v in mapping.items() if len(v) == 1}
    for k, v in mapping.items():
        if len(v) != 1:
            c = F.replace(c, F.lit(k), F.lit(v))
    return F.translate(c, "".join(single), "".join(single.values()))


def romanize_latin(c: Column, mapping: Mapping[str, str] = LATIN_ACCENTS) -> Column:
    return map_characters(c, mapping)


def romanize_malayalam(c: Column) -> Column:
    """ITRANS copy of Malayalam text; text without Malayalam is returned as it is."""
    return romanize(c, MALAYALAM)
