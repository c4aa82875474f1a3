"""Text expressions with the same meaning on every row, all JVM-side.

Whitespace and word classes are spelled out because the regex engines disagree on the
shorthand forms: ``WS`` equals the Unicode white space of Python's ``str.strip`` and
``W`` its word characters.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\t-\r\x1C-\x20\x85\p{Z}]"
NOT_WS = r"[^\t-\r\x1C-\x20\x85\p{Z}]"
W = r"[\p{L}\p{N}_]"

# The same characters as WS, for trimming at the ends without a regex.
WS_CHARS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())

HANGUL = (0xAC00, 0xD7A3)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it any number of times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def blank_if_null(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))


def strip(col: Column) -> Column:
    """Remove white space at both ends, Unicode-aware."""
    return F.btrim(col, F.lit(WS_CHARS))


def is_blank(col: Column) -> Column:
    return strip(blank_if_null(col)) == ""


def normalize_text(col: Column) -> Column:
    """Lower case, URLs and @handles to a space, white space runs to one space, stripped."""
    out = F.lower(col)
    out = F.regexp_replace(out, rf"https?://{NOT_WS}+", " ")
    out = F.regexp_replace(out, rf"@{W}+", " ")
    return strip(F.regexp_replace(out, f"{WS}+", " "))


# The lead-in phrases removed from a stored reply.
REPLY_PHRASES = ("You can check here", "Check here", "See here")


def clean_response(col: Column) -> Column:
    """Make a stored reply presentable; the order of the steps matters."""
    phrases = "|".join(REPLY_PHRASES)
    steps = (
        (r"@[\p{Nd}]+", ""),
        (rf"https?://t\.co/{NOT_WS}+", ""),
        (rf"\^?[A-Z]{{2}}{WS}*\z", ""),
        (rf"(?iu){WS}*(?:{phrases}):?{WS}*\.?", ""),
        (f"{WS}+", " "),
    )
    for pattern, replacement in steps:
        col = F.regexp_replace(col, pattern, replacement)
    return F.regexp_replace(strip(col), rf"{WS}+([.!?,])", "$1")


# Stands for a character whose folding is longer than one character.
EXPANDS = "\uf8ff"


@functools.cache
def _fold_tables() -> tuple[str, str, dict[str, str]]:
    """Compatibility foldings without combining marks, derived from ``unicodedata``.

    Returns the from/to strings of ``translate`` and the map of the foldings that expand,
    which the former replaces with ``EXPANDS``. Hangul syllables are left to arithmetic.
    """
    single, dropped, longer = {}, [], {}
    for code in range(sys.maxunicode + 1):
        if 0xD800 <= code <= 0xDFFF or HANGUL[0] <= code <= HANGUL[1]:
            continue
        char = chr(code)
        folded = "".join(
            c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c)
        )
        if folded == char:
            continue
        if not folded:
            dropped.append(char)
        elif len(folded) == 1:
            single[char] = folded
        else:
            longer[char] = folded
    source = "".join(single) + "".join(longer) + "".join(dropped)
    return source, "".join(single.values()) + EXPANDS * len(longer), longer


def _literal_list(items: list[str]) -> Column:
    """Constant array from one string literal; folded once at planning."""
    return F.split(F.lit("\x00".join(items)), "\x00")


def _hangul_jamo(char: Column) -> Column:
    """Decompose one Hangul syllable by its code point."""
    lead = _literal_list([chr(0x1100 + i) for i in range(19)])
    vowel = _literal_list([chr(0x1161 + i) for i in range(21)])
    tail = _literal_list(["", *[chr(0x11A8 + i) for i in range(27)]])
    index = F.ascii(char) - F.lit(HANGUL[0])
    return F.concat(
        F.get(lead, F.floor(index / 588).cast("int")),
        F.get(vowel, F.floor(index % 588 / 28).cast("int")),
        F.get(tail, index % 28),
    )


def fold_accents(col: Column) -> Column:
    """Accent folding: compatibility decomposition minus combining marks.

    ASCII rows pass through, nearly all others take one ``translate``; only rows with a
    character that expands (ligatures, fractions, Hangul) are rebuilt by character.
    """
    source, target, longer = _fold_tables()
    table = F.map_from_arrays(_literal_list(list(longer)), _literal_list(list(longer.values())))

    def expand(char: Column) -> Column:
        is_hangul = char.between(chr(HANGUL[0]), chr(HANGUL[1]))
        return F.when(is_hangul, _hangul_jamo(char)).otherwise(
            F.coalesce(F.try_element_at(table, char), char)
        )

    def non_ascii(text: Column) -> Column:
        simple = F.translate(text, source, target)
        by_char = F.transform(F.regexp_extract_all(text, F.lit("(?s)."), 0), expand)
        expands = F.contains(simple, F.lit(EXPANDS)) | text.rlike(f"[{chr(HANGUL[0])}-{chr(HANGUL[1])}]")
        return F.when(expands, F.translate(F.array_join(by_char, ""), source, target)).otherwise(simple)

    return F.when(F.length(col) == F.octet_length(col), col).otherwise(non_ascii(col))


def tokens(col: Column) -> Column:
    """Lower-cased, accent-folded words of at least two word characters."""
    return F.regexp_extract_all(fold_accents(F.lower(col)), F.lit(f"{W}{{2,}}"), 0)


def ngrams(words: Column, n_max: int) -> Column:
    """All word n-grams of length 1..``n_max``, words joined with one space."""
    if n_max == 1:
        return words

    def spread(base: Column) -> Column:
        levels, previous = [base], base
        for n in range(2, n_max + 1):
            joined = F.zip_with(
                previous,
                F.slice(base, F.lit(n), F.greatest(F.size(base), F.lit(1))),
                lambda a, b: F.concat(a, F.lit(" "), b),
            )
            previous = F.filter(joined, lambda x: x.isNotNull())
            levels.append(previous)
        return F.concat(*levels)

    return let(words, spread)


def term_counts(terms: Column) -> Column:
    """Array of (term, tf) with one entry per distinct term, computed inside the row.

    The terms are sorted and the run lengths read off, so counting needs no shuffle.
    """

    def runs(ordered: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(ordered) - 1),
            lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)),
        )
        return let(
            starts,
            lambda begin: F.transform(
                begin,
                lambda at, i: F.struct(
                    F.get(ordered, at).alias("term"),
                    (F.coalesce(F.get(begin, i + 1), F.size(ordered)) - at).alias("tf"),
                ),
            ),
        )

    return let(F.sort_array(terms), lambda s: F.when(F.size(s) > 0, runs(s)))


def text_terms(col: Column, ngram_max: int) -> Column:
    """(term, tf) array of one text."""
    return term_counts(ngrams(tokens(blank_if_null(col)), ngram_max))


def signature(col: Column) -> Column:
    """The words of a text joined with spaces; equal signatures mean equal terms."""
    return F.array_join(tokens(blank_if_null(col)), " ")


def signature_terms(col: Column, ngram_max: int) -> Column:
    """(term, tf) array of a signature."""
    return F.when(col != "", term_counts(ngrams(F.split(col, " "), ngram_max)))
