"""URL policy: host and path rules, then a listed-host test by a cascade of Bloom filters.

DataFrame functions only.

The cascade stores a set of listed keys so that every key of a *known
universe* is answered exactly. Level 1 is a Bloom filter of the listed keys.
Some other keys of the universe pass it by chance; level 2 is a filter of
those. Listed keys that pass level 2 by chance go into level 3, and so on,
until a level lets nothing through by chance. A key is listed if the first
level that rejects it is an even one. Each level is a fraction of the one
before, so the whole is a few bits per listed key, whatever the length of the
keys, and testing a row is a few byte look-ups instead of a join.

Filters travel with the plan, so those of one cascade stay below a bound. A
larger universe is dealt into slices by a hash of the key, each with a cascade
of its own; the rows are written once by slice, and every slice is judged from
its own folder. The driver holds the filters of one slice at a time.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from math import ceil, exp

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tocsin.session import materialize

BITS_PER_KEY = 8
PROBES = 4
MAX_LEVELS = 40
MAX_FILTER_BYTES = 32 << 20  # all levels of a cascade together, as they travel with the plan
MARGIN = 1.25  # between the expected and the largest size of a slice's cascade
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; empty without one or for null."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with all its subdomains and every path that starts with ``path``."""

    verdict: str
    host: str
    path: str = ""

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        own = (host == self.host) | F.endswith(host, F.lit("." + self.host))
        return own & F.startswith(path, F.lit(self.path))


def match_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else null.

    For a policy of hand-written rules: one test per rule and row. Ties go to
    the longer host, then to the text in order.
    """
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    ordered = sorted(rules, key=lambda r: (-len(r.text), -len(r.host), r.text))
    for rule in reversed(ordered):
        fits = rule.fits(host, path)
        text = F.when(fits, F.lit(rule.text)).otherwise(text)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return text, verdict


@dataclass(frozen=True)
class Level:
    bits: int
    data: bytes


def _positions(key: Column, level: int, bits: int) -> list[Column]:
    """Bit positions of a key: double hashing from two hashes with the level as salt."""
    a, b = F.xxhash64(key, F.lit(level)), F.xxhash64(F.lit(level), key)
    n = F.lit(bits).cast("long")
    return [F.pmod(F.pmod(a, n) + F.lit(i).cast("long") * F.pmod(b, n), n) for i in range(PROBES)]


def _passes(key: Column, level: int, stored: Level) -> Column:
    """Whether all bits of a key are set. One byte is cut out of the filter for each."""
    data, hit = F.lit(bytearray(stored.data)), F.lit(True)
    for at in _positions(key, level, stored.bits):
        cell = F.substring(data, F.floor(at / 8).cast("int") + 1, 1)
        value = F.conv(F.hex(cell), 16, 10).cast("int")
        hit = hit & (F.getbit(value, (at % 8).cast("int")) == 1)
    return hit


def _build_level(keys: DataFrame, level: int, count: int) -> Level:
    """Filter of all ``keys``: tasks set bits, words are merged by OR, the driver joins them.

    What reaches the driver is the filter, ``BITS_PER_KEY`` bits per key.
    """
    bits = max(64, -(-count * BITS_PER_KEY // 64) * 64)
    at = F.explode(F.array(*_positions(F.col("key"), level, bits))).alias("at")
    words = (
        keys.select(at)
        .groupBy(F.floor(F.col("at") / 32).cast("long").alias("word"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 32).cast("int"))).alias("value"))
    )
    data = bytearray(bits // 8)
    for row in words.toLocalIterator():
        data[row.word * 4 : row.word * 4 + 4] = row.value.to_bytes(4, "little")
    return Level(bits, bytes(data))


def universe_keys(universe: DataFrame, key: str, listed: str) -> DataFrame:
    """(key, listed): every key of ``universe`` once, written.

    ``universe`` has a key column (any of the corpus, repeats and nulls
    allowed; a null is no key) and a boolean saying whether that key is
    listed. A key is listed if any of its rows says so.
    """
    return materialize(
        universe.filter(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("key"))
        .agg(F.coalesce(F.bool_or(F.col(listed)), F.lit(False)).alias("listed")),
        "url-keys",
    )


def slices_needed(listed: int, others: int) -> int:
    """Slices that keep each cascade below :data:`MAX_FILTER_BYTES`.

    Every second level holds what passes the level before by chance, a fixed
    share of the listed keys or of the others.
    """
    chance = (1 - exp(-PROBES / BITS_PER_KEY)) ** PROBES
    keys = (listed + chance * others) / (1 - chance)
    return max(1, ceil(MARGIN * keys * BITS_PER_KEY / 8 / MAX_FILTER_BYTES)) if listed else 1


def slice_of(key: Column, slices: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("slice"), key), F.lit(slices)).cast("int")


def cascade(keys: DataFrame) -> list[Level]:
    """Cascade that answers exactly for every row of ``keys`` (key, listed), each there once.

    No listed key gives an empty cascade, which lists nothing.
    """
    levels: list[Level] = []
    stored, others = keys.filter("listed"), keys.filter("NOT listed")
    for level in range(MAX_LEVELS):
        count = stored.count()
        if not count:
            return levels
        levels.append(_build_level(stored, level, count))
        stored, others = others.filter(_passes(F.col("key"), level, levels[-1])), stored
    raise RuntimeError("the cascade does not end")


def build_cascade(universe: DataFrame, key: str, listed: str) -> list[Level]:
    """One cascade over all keys of ``universe``, as :func:`universe_keys` takes it."""
    return cascade(universe_keys(universe, key, listed))


def is_listed(key: Column, levels: Sequence[Level]) -> Column:
    """Exact membership for keys of the universe the cascade was built over; null is not listed."""
    answer = F.lit(bool(len(levels) % 2))  # passed every level: in the set that the last one stores
    for level in range(len(levels) - 1, -1, -1):
        rejected = F.lit(level % 2 == 1)
        answer = F.when(_passes(key, level, levels[level]), answer).otherwise(rejected)
    return F.coalesce(F.when(key.isNotNull(), answer), F.lit(False))


def with_listed(df: DataFrame, key: str, keys: DataFrame, name: str) -> DataFrame:
    """Add ``name``: whether the row's key is listed in ``keys`` (key, listed), which holds every key of ``df``."""
    sizes = keys.agg(F.count_if("listed").alias("yes"), F.count_if(~F.col("listed")).alias("no")).first()
    slices = slices_needed(sizes.yes, sizes.no)
    if slices == 1:
        return df.withColumn(name, is_listed(F.col(key), cascade(keys)))
    rows = df.select(F.struct(*[c for c in df.columns if c != name]).alias("row"), F.col(key).alias("sought"))
    dealt = materialize(rows.withColumn("slice", slice_of(F.col("sought"), slices)), "by-slice", "slice")
    dealt_keys = materialize(keys.withColumn("slice", slice_of(F.col("key"), slices)), "keys-by-slice", "slice")
    parts = []
    for n in range(slices):
        levels = cascade(dealt_keys.filter(F.col("slice") == n).select("key", "listed"))
        own = dealt.filter(F.col("slice") == n).select("row.*", is_listed(F.col("sought"), levels).alias(name))
        parts.append(materialize(own, "judged"))
    return reduce(DataFrame.unionByName, parts)


def judge(pages: DataFrame, rules: Sequence[Rule], url: str = "url") -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to every page.

    The longest fitting rule decides. Where none fits, the host's record does:
    a host with any page that a rule blocks is listed, and its other pages are
    blocked as well; all others are allowed. A null url, or one without
    ``://``, has an empty host and path; columns of the four names are
    replaced, as is ``_listed``. Repeated rows are judged alike. An empty table
    stays empty.
    """
    host, path = host_of(F.col(url)), path_of(F.col(url))
    split = pages.withColumns({"host": host, "path": path})
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    ruled = split.withColumns({"rule": rule, "verdict": verdict})
    universe = ruled.select("host", (F.col("verdict") == "block").alias("listed"))
    known = with_listed(ruled, "host", universe_keys(universe, "host", "listed"), "_listed")
    own = F.when(F.col("_listed"), F.lit("block")).otherwise(F.lit("allow"))
    return known.withColumn("verdict", F.coalesce("verdict", own)).drop("_listed")
