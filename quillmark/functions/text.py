"""Text normalisation and comparison."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as ECMAScript's ``\\s`` has it; Java's needs a flag and differs.
SPACE = r"\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
#: Runs of white space that are not one plain space already: most are, and need no replacement.
_SPACES = f"[{SPACE}&&[^ ]][{SPACE}]*| [{SPACE}]+"


#: Hangul syllables are decomposed by arithmetic: their first and last, the first leading, vowel and trailing letter, and how many of the last two.
_SYLLABLES, _LETTERS, _VOWELS, _TRAILING = (0xAC00, 0xD7A3), (0x1100, 0x1161, 0x11A7), 21, 28


def _folding() -> tuple[str, str, dict[str, str]]:
    """What stays of canonical decompositions without marks U+0300 to U+036F, over all code points but Hangul: letters that become one other character, these, and those that become several."""
    marked, plain, longer = [], [], {}
    for code in (*range(0xC0, 0x300), *range(0x370, _SYLLABLES[0]), *range(0xE000, 0x110000)):
        parts = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if not 0x300 <= ord(c) <= 0x36F)
        if parts == chr(code):
            continue
        if len(parts) == 1:
            marked.append(chr(code))
            plain.append(parts)
        else:
            longer[chr(code)] = parts
    return "".join(marked), "".join(plain), longer


_MARKED, _PLAIN, _LONGER = _folding()
#: No character before it becomes several.
_FIRST_LONGER = min(_LONGER)


def _decomposed(text: Column) -> Column:
    """Characters that become several, and Hangul syllables, in parts."""
    low, high = (F.lit(chr(c)) for c in _SYLLABLES)
    parts = F.str_to_map(F.lit("|".join(f"{k}={v}" for k, v in _LONGER.items())), F.lit(r"\|"), F.lit("="))

    def one(c: Column) -> Column:
        place = F.conv(F.hex(F.encode(c, "UTF-16BE")), 16, 10).cast("int") - _SYLLABLES[0]
        letter = lambda k, n: F.substring(F.lit("".join(map(chr, range(_LETTERS[k], _LETTERS[k] + 28)))), n + 1, F.lit(1))
        tail = place % _TRAILING
        syllable = F.concat(letter(0, F.floor(place / (_VOWELS * _TRAILING)).cast("int")), letter(1, F.floor(place % (_VOWELS * _TRAILING) / _TRAILING).cast("int")), F.when(tail > 0, letter(2, tail)).otherwise(""))
        return F.when((c >= low) & (c <= high), syllable).otherwise(F.coalesce(F.try_element_at(parts, c), c))

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), one), "")


def strip_marks(text: Column) -> Column:
    """Letters without their combining marks U+0300 to U+036F after canonical decomposition, as Spark has none.

    A table covers every code point, arithmetic the Hangul syllables. Few texts have a character that becomes several; only these are taken
    apart. Marks of other scripts stay as they are written: they are not put into canonical order.
    """
    rare = text.rlike(f"[^\\x00-{chr(ord(_FIRST_LONGER) - 1)}]") & text.rlike(f"[{''.join(_LONGER)}{chr(_SYLLABLES[0])}-{chr(_SYLLABLES[1])}]")
    whole = F.when(rare, _decomposed(text)).otherwise(text)
    return F.regexp_replace(F.translate(whole, _MARKED, _PLAIN), r"[\u0300-\u036f]", "")


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, _SPACES, " "))


def normalize(text: Column) -> Column:
    """For lexicon matching: lower case, no marks, single spaces; punctuation stays."""
    return collapse_spaces(strip_marks(F.lower(text)))


def normalize_words(text: Column) -> Column:
    """For name matching: as ``normalize``, and all but a-z, 0-9 and spaces becomes a space; null is empty."""
    return collapse_spaces(F.regexp_replace(strip_marks(F.lower(F.coalesce(text, F.lit("")))), f"[^a-z0-9{SPACE}]", " "))


def normalize_key(text: Column, length: int = 100) -> Column:
    """For composite keys: as ``normalize_words``, cut to a length."""
    return F.substring(normalize_words(text), 1, length)


def strip_html(text: Column) -> Column:
    return collapse_spaces(F.regexp_replace(text, "<[^>]*>", " "))


def long_tokens(text: Column, longer_than: int = 2) -> Column:
    """Distinct tokens of a normalised text."""
    return F.array_distinct(F.filter(F.split(normalize_words(text), " "), lambda t: F.length(t) > longer_than))


def overlap(a: Column, b: Column) -> Column:
    """Common tokens over those of the larger set; 0 where either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b)))


def similarity(a: Column, b: Column) -> Column:
    """1 minus the edit distance over the longer length; 1 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise((longest - F.levenshtein(a, b)) / longest)


def contains_folded(text: Column, term: Column) -> Column:
    """Does a text contain a term, case aside? A term's percent signs and underscores are ordinary characters."""
    return F.contains(F.lower(text), F.lower(term))


def format_eur(amount: Column) -> Column:
    """French currency notation without decimals: thousands apart by narrow no-break spaces."""
    return F.concat(F.replace(F.format_number(amount, 0), F.lit(","), F.lit("\u202f")), F.lit("\u00a0€"))


def plural(count: Column, one: str, many: str) -> Column:
    """French plural: 0 and 1 are singular."""
    return F.concat(count.cast("string"), F.lit(" "), F.when(count > 1, F.lit(many)).otherwise(F.lit(one)))


def escape_html(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out
