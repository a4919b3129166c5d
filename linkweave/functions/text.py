"""Text expressions: Column in, Column out, all on the JVM.

Null counts as an empty text unless a function says otherwise. Regular expressions are Unicode
aware, so words and digits of any script count.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# ASCII punctuation, by its four ranges.
PUNCTUATION = r"[!-/:-@\[-`{-~]"

# Legal forms of companies. The second list goes without the French ones.
LEGAL_FORMS = r"LLC|INC|CORP(?:ORATION)?|LTD|LIMITED|PVT|PRIVATE|LLP|PLC|LP|CO|COMPANY|SAS|SARL|SASU|EURL|SA|SCI"
LEGAL_FORMS_SHORT = r"LLC|INC|CORP(?:ORATION)?|LTD|LIMITED|PVT|PRIVATE|LLP|PLC|LP|CO|COMPANY"

# Scripts with their Unicode blocks, in the order in which they are looked for.
SCRIPTS = (
    ("Deva", r"[\u0900-\u097F]"),
    ("Beng", r"[\u0980-\u09FF]"),
    ("Guru", r"[\u0A00-\u0A7F]"),
    ("Gujr", r"[\u0A80-\u0AFF]"),
    ("Taml", r"[\u0B80-\u0BFF]"),
    ("Knda", r"[\u0C80-\u0CFF]"),
    ("Mlym", r"[\u0D00-\u0D7F]"),
    ("Thai", r"[\u0E00-\u0E7F]"),
    ("Cyrl", r"[\u0400-\u04FF]"),
    ("Arab", r"[\u0600-\u06FF]"),
    ("Grek", r"[\u0370-\u03FF]"),
    ("Hani", r"[\u4E00-\u9FFF]"),
    ("Jpan", r"[\u3040-\u30FF]"),
    ("Kore", r"[\uAC00-\uD7AF]"),
)
INDIC = r"[\u0900-\u0D7F]"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _tidy(c: Column) -> Column:
    """Single spaces, none outside."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def norm(c: Column) -> Column:
    """Upper case, ASCII punctuation deleted, single spaces."""
    return _tidy(F.regexp_replace(F.upper(_text(c)), PUNCTUATION, ""))


def norm_space(c: Column) -> Column:
    """Upper case, a space for each ASCII punctuation mark, single spaces."""
    return _tidy(F.regexp_replace(F.upper(_text(c)), PUNCTUATION, " "))


def norm_ascii(c: Column) -> Column:
    """Upper case, a space for all but ASCII letters, digits and spaces; other scripts are lost."""
    return _tidy(F.upper(F.regexp_replace(_text(c), r"[^A-Za-z0-9 ]", " ")))


def strip_suffix(c: Column) -> Column:
    """A normalized name without legal forms."""
    return _tidy(F.regexp_replace(_text(c), rf"(?iU)\b({LEGAL_FORMS})\b", ""))


def strip_suffix_short(c: Column) -> Column:
    """The same with the shorter list, a space in a form's place."""
    return _tidy(F.regexp_replace(_text(c), rf"(?U)\b({LEGAL_FORMS_SHORT})\b", " "))


def _folded(ch: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFD", ch) if not unicodedata.combining(x))


@cache
def _folding() -> tuple[str, str, str, dict[str, str]]:
    """Code points that become one other (from, to), those that vanish, and those that become several;
    Hangul syllables are left to arithmetic."""
    single, to, gone, several = [], [], [], {}
    for i in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= i < 0xE000 or 0xAC00 <= i < 0xD7A4:
            continue
        ch = chr(i)
        folded = _folded(ch)
        if folded == ch:
            continue
        if len(folded) == 1:
            single.append(ch)
            to.append(folded)
        elif not folded:
            gone.append(ch)
        else:
            several[ch] = folded
    return "".join(single), "".join(to), "".join(gone), several


def _class(chars: str) -> str:
    return "".join(rf"\x{{{ord(ch):X}}}" for ch in chars)


def _jamo(ch: Column) -> Column:
    """A Hangul syllable's letters."""
    at = F.ascii(ch) - 0xAC00

    def letter(first: int, n: int, index: Column) -> Column:
        return F.get(F.split(F.lit(" ".join(chr(first + k) for k in range(n))), " "), index.cast("int"))

    tail = at % 28
    return F.concat(letter(0x1100, 19, F.floor(at / 588)), letter(0x1161, 21, F.floor(at % 588 / 28)), F.when(tail > 0, letter(0x11A8, 27, tail - 1)).otherwise(""))


def fold(c: Column) -> Column:
    """Canonical decomposition without combining marks, whatever the script; null stays null.

    Code points that become one other, or none, are translated. Only texts with one that becomes
    several, or with Hangul, are taken apart first.
    """
    single, to, gone, several = _folding()
    # literals, as the first str_to_map of a JVM makes 3.4 GB of garbage in the driver, whose heap then grows
    pairs = F.create_map(*[F.lit(x) for pair in several.items() for x in pair])

    def apart(ch: Column) -> Column:
        return F.when(ch.between("\uac00", "\ud7a3") & (F.octet_length(ch) == 3), _jamo(ch)).otherwise(F.coalesce(F.try_element_at(pairs, ch), ch))

    taken = F.array_join(F.transform(F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0)), apart), "")
    whole = F.when(c.rlike(rf"[\x{{AC00}}-\x{{D7A3}}{_class(''.join(several))}]"), taken).otherwise(c)
    return F.translate(whole, single + gone, to)


def words(c: Column) -> Column:
    """Runs of word characters, repeats included; null gives none."""
    return F.regexp_extract_all(_text(c), F.lit(r"(?U)\w+"), F.lit(0))


def numbers(c: Column, least: int = 2) -> Column:
    """Runs of at least `least` digits of any script, repeats included."""
    return F.regexp_extract_all(_text(c), F.lit(rf"(?U)\d{{{least},}}"), F.lit(0))


def split_words(c: Column) -> Column:
    """Distinct space-separated tokens of a normalized text; an empty one has none."""
    return F.array_except(F.array_distinct(F.split(_text(c), " ")), F.array(F.lit("")))


@cache
def latin_named() -> str:
    """A class of the code points from 0x80 whose Unicode name starts with LATIN."""
    spans: list[list[int]] = []
    for i in range(0x80, 0x30000):
        if unicodedata.name(chr(i), "").startswith("LATIN"):
            if spans and spans[-1][1] == i - 1:
                spans[-1][1] = i
            else:
                spans.append([i, i])
    return "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in spans)


def script_class(c: Column) -> Column:
    """0: ASCII only; 1: all else has a LATIN name; 2: otherwise."""
    t = _text(c)
    return F.when(~t.rlike(r"[^\x00-\x7F]"), 0).when(t.rlike(rf"[^\x00-\x7F{latin_named()}]"), 2).otherwise(1)


def script(c: Column) -> Column:
    """The first of SCRIPTS that occurs, else Latn if an ASCII letter does, else None."""
    t = _text(c)
    out = F.when(F.lit(False), "")
    for name, block in SCRIPTS:
        out = out.when(t.rlike(block), name)
    return out.when(t.rlike("[A-Za-z]"), "Latn").otherwise("None")


def is_indic(c: Column) -> Column:
    return _text(c).rlike(INDIC)


def is_devanagari(c: Column) -> Column:
    return _text(c).rlike(SCRIPTS[0][1])


def not_ascii(c: Column) -> Column:
    return _text(c).rlike(r"[^\x00-\x7F]")


def address_probes(c: Column) -> dict[str, Column]:
    """What an address looks like, as booleans."""
    t = _text(c)
    return {
        "any_digit": t.rlike(r"\d"),
        "leading_number": t.rlike(r"^\s*\d"),
        "five_digits": t.rlike(r"\b\d{5}\b"),
        "six_digits": t.rlike(r"\b\d{6}\b"),
        "cedex": F.upper(t).contains("CEDEX"),
    }


def has_form(c: Column, form: str) -> Column:
    """Whether a legal form occurs as a word, in any case."""
    return F.upper(_text(c)).rlike(rf"\b{form}\b")


def same_prefix(a: Column, b: Column, n: int) -> Column:
    """Both have n characters at least and agree on the first n."""
    return (F.char_length(a) >= n) & (F.char_length(b) >= n) & (F.left(a, F.lit(n)) == F.left(b, F.lit(n)))


def grams(c: Column, n: int) -> Column:
    """Distinct character n-grams; shorter texts have none."""
    t = _text(c)
    at = F.sequence(F.lit(1), F.greatest(F.char_length(t) - n + 1, F.lit(1)))
    return F.when(F.char_length(t) >= n, F.array_distinct(F.transform(at, lambda i: F.substr(t, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 where both are empty."""
    return _ratio(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def containment(a: Column, b: Column) -> Column:
    """Shared elements over the smaller set's; 0 where either is empty."""
    return _ratio(F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b)))


def contained(a: Column, b: Column) -> Column:
    """Shared elements over the first set's; 0 where it is empty."""
    return _ratio(F.size(F.array_intersect(a, b)), F.size(a))


def length_difference(a: Column, b: Column) -> Column:
    x, y = F.char_length(a), F.char_length(b)
    return F.abs(x - y).cast("double") / (x + y + 1)


def log_number_similarity(a: Column, b: Column) -> Column:
    """Lesser over greater of log(1 + n) of the texts' first numbers of two digits or more. 0 if
    either has none; NaN if both are zero, on purpose."""
    x, y = (F.log1p(F.get(numbers(c), F.lit(0)).cast("double")) for c in (a, b))
    return F.when(x.isNull() | y.isNull(), 0.0).when((x == 0) & (y == 0), float("nan")).otherwise(F.least(x, y) / F.when(F.greatest(x, y) > 0, F.greatest(x, y)))


def harmonic(a: Column, b: Column) -> Column:
    return F.when(a + b > 0, 2 * a * b / F.when(a + b > 0, a + b)).otherwise(0.0)
