"""Column functions: guarded ratios, keyword predicates, calendar helpers."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLIT = "\x01"
#: Hangul syllables follow a rule: 19 leading, 21 vowel and 28 trailing letters, the first of which is none.
_HANGUL, _LEADING, _VOWELS, _TRAILING = (0xAC00, 0xD7A3), 0x1100, 0x1161, 0x11A8


def _class(codes: Sequence[int]) -> str:
    """A pattern for any of ascending code points beyond U+009F, as ranges. A class is tried range by range, so
    ranges are found by halving, and plain characters are left at once."""
    ranges: list[list[int]] = []
    for code in codes:
        if ranges and ranges[-1][1] == code - 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])

    def halved(some: list[list[int]]) -> str:
        if len(some) <= 8:
            return "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" if a < b else rf"\x{{{a:x}}}" for a, b in some) + "]"
        half = len(some) // 2
        return rf"(?:(?=[\x{{a0}}-\x{{{some[half - 1][1]:x}}}]){halved(some[:half])}|(?![\x{{0}}-\x{{{some[half - 1][1]:x}}}]){halved(some[half:])})"

    return r"(?![\x{0}-\x{9f}])" + halved(ranges)


@functools.cache
def _folding() -> tuple[str, str, str, str, str]:
    """What compatibility decomposition without combining marks makes of each character, from the Unicode
    tables of Python: characters that become one other, with those that go at the end, and what they become;
    characters that become several, split-joined results, and a pattern for them and Hangul syllables."""
    found, plain, several, longer, gone = [], [], [], [], []
    for code in range(0xA0, 0x110000):
        if 0xD800 <= code < 0xE000 or _HANGUL[0] <= code <= _HANGUL[1]:
            continue
        own = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if not own:
            gone.append(chr(code))
        elif len(own) > 1:
            several.append(code), longer.append(own)
        elif own != chr(code):
            found.append(chr(code)), plain.append(own)
    spread = _class(sorted([*several, *range(_HANGUL[0], _HANGUL[1] + 1)]))
    return "".join(found + gone), "".join(plain), "".join(map(chr, several)), _SPLIT.join(longer), spread


def _decomposed(letter: Column) -> Column:
    """The several characters that one stands for."""
    _, _, several, longer, _ = _folding()
    code = F.ascii(letter) - _HANGUL[0]
    letters = lambda first, n: F.lit("".join(chr(first + i) for i in range(n)))
    pick = lambda text, at: F.substr(text, F.floor(at).cast("int") + 1, F.lit(1))
    trailing = F.when(code % 28 == 0, "").otherwise(pick(letters(_TRAILING, 27), code % 28 - 1))
    syllable = F.concat(pick(letters(_LEADING, 19), code / (21 * 28)), pick(letters(_VOWELS, 21), code % (21 * 28) / 28), trailing)
    looked_up = F.element_at(F.split(F.lit(longer), _SPLIT), F.position(letter, F.lit(several)))
    return F.when(code.between(0, _HANGUL[1] - _HANGUL[0]), syllable).otherwise(looked_up)


def fold_accents(c: Column) -> Column:
    """The text in compatibility decomposition without combining marks: letters without their accents,
    ligatures, fractions and syllables as the characters that they are made of. Plain ASCII is not touched, and
    only texts that hold a character of several are taken apart, before each of those."""
    found, plain, _, _, spread = _folding()
    first = lambda x: F.concat(_decomposed(F.substr(x, F.lit(1), F.lit(1))), F.substr(x, F.lit(2)))
    apart = lambda one: F.transform(F.split(one, f"(?={spread})"), lambda x: F.when(x.rlike(f"^{spread}"), first(x)).otherwise(x))
    whole = let(F.translate(c, found, plain), lambda one: F.when(one.rlike(spread), F.array_join(apart(one), "")).otherwise(one))
    return F.when(c.rlike(r"[^\x00-\x7F]"), whole).otherwise(c)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def contains_any(c: Column, keywords: Sequence[str]) -> Column:
    """Whether the accent-free lower-cased text has any keyword; null and empty: false."""

    def search(folded: Column) -> Column:
        found = F.lit(False)
        for k in keywords:
            found = found | F.contains(folded, F.lit(k))
        return found

    return F.coalesce(let(F.lower(fold_accents(c)), search), F.lit(False))


def keyword_score(c: Column, stems: Sequence[str]) -> Column:
    """How many stems occur in the accent-free lower-cased text."""
    return let(F.lower(fold_accents(F.coalesce(c, F.lit("")))), lambda folded: sum((F.contains(folded, F.lit(s)).cast("int") for s in stems), F.lit(0)))


def size_ratio(a: Column, b: Column) -> Column:
    return F.try_divide(F.least(a, b).cast("double"), F.greatest(a, b))


def ratio(a: Column, b: Column) -> Column:
    """``a / b`` of doubles by the floating-point standard: by 0 it is infinite, 0 by 0 not a number; null if either is."""
    return F.when(b == 0, a * F.pow(b, F.lit(-1.0))).otherwise(a / b)


def nearest(c: Column, digits: int) -> Column:
    """A double rounded as DuckDB does: its product with a power of ten goes to the nearest whole number, half away
    from 0. ``F.round`` rounds the shortest decimal text instead, so that ties such as 9.73 / 6.4 - 1 go elsewhere."""
    scale = F.lit(10.0**digits)
    return F.when(F.abs(c) < 1e300, F.round(c * scale, 0) / scale).otherwise(c)


def degenerate_score(score: Column) -> Column:
    return (score >= 0.999) | (score <= 0.001)


def guarded_ratio(a: Column, b: Column, least: float = 0.01) -> Column:
    """``a / b`` where ``|b| > least``, else null."""
    return F.when(F.abs(b) > least, a / b)


def quarter_end(d: Column) -> Column:
    """Whether a date is a standard end of one of the first three quarters."""
    return F.date_format(d, "MM-dd").isin("03-31", "06-30", "09-30")


def period_label(d: Column) -> Column:
    return F.concat(F.year(d).cast("string"), F.lit("Q"), F.quarter(d).cast("string"))


def entry_month(d: Column) -> Column:
    """End of the month after the one of ``d``, also for the first of a month."""
    return F.last_day(F.add_months(F.trunc(d, "MM"), 1))


def bucket_by(c: Column, groups: dict[str, Sequence[str]], default: str = "Other") -> Column:
    """The first group, in the order given, one of whose keywords is in the text."""
    out = None
    for name, keywords in groups.items():
        out = F.when(contains_any(c, keywords), name) if out is None else out.when(contains_any(c, keywords), name)
    return F.lit(default) if out is None else out.otherwise(default)


def name_matches(c: Column, patterns: Sequence[str]) -> Column:
    """Whether any pattern is found in the text, in any case; null: false."""
    return F.coalesce(c.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)), F.lit(False))


def both_reliable(before: Column, after: Column, reliable: str = "font_heading") -> Column:
    """Whether both sides of a pair were found in the reliable way; null: false."""
    return F.coalesce((before == reliable) & (after == reliable), F.lit(False))


def verified(flag: Column) -> Column:
    """A stored flag, null as false."""
    return F.coalesce(flag.cast("boolean"), F.lit(False))


def quarter_order(label: Column) -> Column:
    """A number by which ``YYYYQn`` labels follow each other without gaps: 2020Q4 and 2021Q1 are neighbours."""
    return F.substring(label, 1, 4).cast("int") * 4 + F.substring(label, 6, 1).cast("int") - 1


def latest_period(tag: Column, has: str = "LTIMO", lacks: str = "PEN") -> Column:
    """Whether a tag marks the current period, whatever became of its accents."""
    return F.coalesce(F.contains(tag, F.lit(has)) & ~F.contains(tag, F.lit(lacks)), F.lit(False))


def log_at_least(c: Column, least: float = 1.0) -> Column:
    """Logarithm of a value raised to ``least``; null stays null."""
    return F.when(c.isNotNull(), F.log(F.greatest(c, F.lit(least))))


def log_if_positive(c: Column) -> Column:
    return F.when(c > 0, F.log(c))
