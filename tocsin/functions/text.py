"""Text expressions. All run inside the JVM; there is no UDF here.

Character classes are written out because Java's ``\\w`` and ``\\s`` cover
ASCII only. Word characters are letters, numbers and underscore; combining
marks are left out unless ``keep_marks`` is set.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tocsin.constants import BAD_PREFIXES, FINGERPRINT_WORDS, MAX_WORDS, MIN_WORDS, RESPONSE_LABELS

WORD = r"\p{L}\p{N}_"
SPACE = r"\x09-\x0d\x1c-\x20\x85\p{Z}"
SOLID = f"[^{SPACE}]+"
URL = rf"(?:http|www\.){SOLID}"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def word_class(keep_marks: bool = False) -> str:
    return WORD + r"\p{M}" if keep_marks else WORD


def clean_text(c: str | Column, keep_marks: bool = False) -> Column:
    """Strip links, the retweet marker, mentions, markup and odd characters.

    The steps are fused into three regular-expression passes, because each
    pass copies the whole text: links together with a leading ``RT`` (which
    counts only at the very start, also when a link is glued to it), mentions
    together with hash signs in front of a word, and finally every run of
    unwanted characters and spaces into one space. Entities are plain string
    replacements; angle brackets would be dropped by the last pass anyway.
    """
    word = word_class(keep_marks)
    text = F.coalesce(_col(c), F.lit(""))
    text = F.regexp_replace(text, rf"^RT(?:{URL})?[{SPACE}]+|{URL}", "")
    text = F.regexp_replace(text, rf"[@#](?:(?<=@)[{word}]+|(?<=#)(?=[{word}]))", "")
    for entity, plain in (("&amp;", "and"), ("&lt;", " "), ("&gt;", " ")):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    text = F.regexp_replace(text, rf"[^{word}.,!?'-]++", " ")
    return F.lower(F.trim(text))


def strip_space(c: str | Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(_col(c), rf"^[{SPACE}]+|[{SPACE}]+$", "")


def word_count(c: str | Column) -> Column:
    """Number of white-space separated words."""
    return F.regexp_count(_col(c), F.lit(SOLID)).cast("int")


def clean_word_count(c: str | Column) -> Column:
    """Word count of text that :func:`clean_text` has already normalised."""
    c = _col(c)
    blanks = F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    return F.when(c == "", 0).otherwise(blanks + 1).cast("int")


def strip_list_markers(c: str | Column) -> Column:
    """Remove a bullet, then a number, then surrounding quotes."""
    text = strip_space(c)
    text = F.regexp_replace(text, rf"^[-•*][{SPACE}]+", "")
    text = F.regexp_replace(text, rf"^[{SPACE}]*\p{{Nd}}+[.)][{SPACE}]+", "")
    text = F.regexp_replace(text, "^[\"']+|[\"']+$", "")
    return strip_space(text)


def is_good_row(c: str | Column, min_words: int = MIN_WORDS, max_words: int = MAX_WORDS) -> Column:
    """Quality test for a generated row: length, opening, numbering."""
    text = _col(c)
    openings = "|".join(f"\\Q{p}\\E" for p in BAD_PREFIXES)
    numbered = rf"^[{SPACE}]*\p{{Nd}}+[.)][{SPACE}]"
    unnumbered = F.regexp_replace(text, f"{numbered}+", "")
    return (
        word_count(text).between(min_words, max_words)
        & ~F.rlike(text, F.lit(f"(?i)^[{SPACE}]*(?:{openings})"))
        & F.when(F.rlike(text, F.lit(numbered)), word_count(unnumbered) >= min_words).otherwise(True)
    )


def fingerprint(c: str | Column, n_words: int = FINGERPRINT_WORDS) -> Column:
    """First words in lower case; rows that share them are near-duplicates."""
    words = F.split(strip_space(c), f"[{SPACE}]+", n_words + 1)
    return F.lower(F.array_join(F.slice(words, 1, n_words), " "))


def match_label(c: str | Column, labels: list[str] = RESPONSE_LABELS) -> Column:
    """Class named by a free-text answer.

    An exact match wins, else the first class in list order that the answer
    contains in any case, else ``UNMATCHED``. ``ERROR`` marks a failed call
    and is passed on.
    """
    answer = strip_space(c)
    lower = F.lower(answer)
    found = F.when(_col(c) == "ERROR", F.lit("ERROR")).when(answer.isin(labels), answer)
    for label in labels:
        found = found.when(F.contains(lower, F.lit(label.lower())), F.lit(label))
    return found.otherwise("UNMATCHED")


def excerpt(c: str | Column, n: int, ascii_only: bool = False) -> Column:
    """First ``n`` characters, optionally with ``?`` for each non-ASCII one."""
    text = F.substring(_col(c), 1, n)
    return F.regexp_replace(text, r"[^\x00-\x7F]", "?") if ascii_only else text


def tokens(c: str | Column, keep_marks: bool = False) -> Column:
    """Lower-case word runs of at least two characters."""
    pattern = rf"[{word_class(keep_marks)}]{{2,}}"
    return F.regexp_extract_all(F.lower(F.coalesce(_col(c), F.lit(""))), F.lit(pattern), F.lit(0))


def ngrams(words: Column, lo: int = 1, hi: int = 2) -> Column:
    """All n-grams of an array of words, joined by a blank."""
    grams, parts = words, []
    for n in range(1, hi + 1):
        if n > 1:
            following = F.greatest(F.size(words) - (n - 1), F.lit(0))
            grams = F.zip_with(
                F.slice(grams, F.lit(1), following),
                F.slice(words, F.lit(n), following),
                lambda a, b: F.concat_ws(" ", a, b),
            )
        if n >= lo:
            parts.append(grams)
    return F.concat(*parts)
