"""Text functions: cleaning, BERT-style normalisation, pre-tokenisation, truncation.

Everything here is a built-in Spark expression, so text never leaves the JVM.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The CJK blocks whose characters stand alone as tokens.
CJK_BLOCKS = [
    (0x4E00, 0x9FFF),
    (0x3400, 0x4DBF),
    (0x20000, 0x2A6DF),
    (0x2A700, 0x2B73F),
    (0x2B740, 0x2B81F),
    (0x2B920, 0x2CEAF),
    (0xF900, 0xFAFF),
    (0x2F800, 0x2FA1F),
]
# ASCII symbols that count as punctuation although Unicode files them under S*.
ASCII_SYMBOLS = "$+<=>^`|~"

# ASCII punctuation as the tokeniser sees it, symbols included.
ASCII_PUNCT = "!-/:-@\\x5B-\\x60\\x7B-\\x7E"

_CJK = "".join(f"\\x{{{lo:X}}}-\\x{{{hi:X}}}" for lo, hi in CJK_BLOCKS)
_SPACE = "\\t\\n\\r\\p{Z}"
# Characters past ASCII that are a token of their own.
_SINGLE = f"\\p{{P}}{_CJK}"
# Deleted by normalisation, but too many to list one by one.
_PRIVATE = "\\x{E000}-\\x{F8FF}\\x{F0000}-\\x{10FFFF}"


def _beyond_ascii(inside: str) -> str:
    """A class for characters past ASCII; the cheap test comes first and decides most of them."""
    return f"[[^\\x00-\\x7F]&&[{inside}]]"


# Single characters in a class share one bit table in the regex engine; ranges cost a call each.
_ASCII_WORD = "abcdefghijklmnopqrstuvwxyz0123456789"

#: One token of *normalised* text: a word, a punctuation mark or a CJK character.
TOKEN_PATTERN = (
    f"[{_ASCII_WORD}{_beyond_ascii('^' + _SPACE + _SINGLE)}]++"
    f"|[{ASCII_PUNCT}]|{_beyond_ascii(_SINGLE)}"
)


def _stripped(char: str) -> str:
    """Canonical decomposition of one character without its non-spacing marks."""
    return "".join(c for c in unicodedata.normalize("NFD", char) if unicodedata.category(c) != "Mn")


@cache
def _decompositions() -> tuple[str, str, dict[str, str]]:
    """(from, to) for one-to-one replacements, plus the few one-to-many ones.

    Built from the Unicode tables; Hangul syllables follow a formula and are left out.
    """
    source, target, longer = [], [], {}
    for code in range(0x80, 0x30000):
        if 0xD800 <= code <= 0xDFFF or 0xAC00 <= code <= 0xD7A3:
            continue
        char = chr(code)
        if unicodedata.category(char) == "Mn":
            continue
        base = _stripped(char)
        if base == char or not base:
            continue
        if len(base) == 1:
            source.append(char)
            target.append(base)
        else:
            longer[char] = base
    # Lower-casing is per character: a final capital sigma becomes a plain small sigma.
    return "".join(source) + "Σ", "".join(target) + "σ", longer


@cache
def _deleted() -> str:
    """The characters that normalisation deletes, from the Unicode tables (private use aside)."""
    kinds = {"Cc", "Cf", "Mn"}
    found = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) in kinds]
    return "".join(c for c in found if c not in "\t\n\r") + "�"


@cache
def _dropped() -> str:
    """The deleted characters past ASCII as ranges of a regex class.

    The same table as the folding uses: the regex engine knows another Unicode version.
    """
    codes = sorted(ord(c) for c in _deleted() if ord(c) > 0x7F)
    ranges: list[list[int]] = []
    for code in codes:
        if ranges and ranges[-1][1] == code - 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return _PRIVATE + "".join(f"\\x{{{lo:X}}}-\\x{{{hi:X}}}" for lo, hi in ranges)


@cache
def _symbol_lookalikes() -> str:
    """Characters that decompose into an ASCII symbol and so become punctuation."""
    source, target, _ = _decompositions()
    return "".join(f"\\x{{{ord(s):X}}}" for s, t in zip(source, target) if t in ASCII_SYMBOLS)


def _raw_token_pattern() -> str:
    """One token of *raw* text, aligned one to one with the tokens of the normalised text.

    Deleted characters may follow inside a word but cannot make up a word alone.
    """
    single = _SINGLE + _symbol_lookalikes()
    first = _beyond_ascii(f"^{_SPACE}{single}{_dropped()}")
    later = _beyond_ascii(f"^{_SPACE}{single}")
    ascii_controls = "\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F"
    letters = _ASCII_WORD + _ASCII_WORD[:26].upper()
    return f"[{letters}{first}][{letters}{ascii_controls}{later}]*+|[{ASCII_PUNCT}]|{_beyond_ascii(single)}"


def _lead_pattern() -> str:
    """Whatever may stand in front of a raw token: white space and deleted characters."""
    inside = "\\p{Z}" + _dropped()
    return f"[\\x00-\\x20\\x7F{_beyond_ascii(inside)}]*+"


def strip_space(col: Column) -> Column:
    """Remove Unicode white space at both ends (``trim`` removes blanks only)."""
    edge = "[\\s\\x{1C}-\\x{1F}]"
    return F.regexp_replace(col, f"(?U)^{edge}++|(?<!{edge}){edge}++$", "")


def clean_cut(col: Column, max_chars: int = 10_000) -> Column:
    """Strip white space, then keep the first ``max_chars`` code points. Null becomes ''."""
    return F.substring(strip_space(F.coalesce(col, F.lit(""))), 1, max_chars)


def _hangul(char: Column) -> Column:
    """Decompose one Hangul syllable into its letters (the Unicode formula)."""
    index = F.conv(F.hex(F.encode(char, "UTF-16BE")), 16, 10).cast("int") - 0xAC00

    def letter(code: Column) -> Column:
        return F.decode(F.unhex(F.hex(code.cast("int"))), "UTF-16BE")

    head = letter(F.floor(index / 588) + 0x1100)
    middle = letter(F.floor((index % 588) / 28) + 0x1161)
    tail = F.when(index % 28 > 0, letter(index % 28 + 0x11A7)).otherwise("")
    return F.concat(head, middle, tail)


@cache
def _rare_ranges() -> str:
    """Blocks of 256 code points that hold a one-to-many decomposition."""
    blocks = sorted({ord(c) >> 8 for c in _decompositions()[2]} | set(range(0xAC, 0xD8)))
    return "".join(f"\\x{{{b << 8:X}}}-\\x{{{(b << 8) + 255:X}}}" for b in blocks if b != 0xD7) + "\\x{D700}-\\x{D7A3}"


def _take_apart(col: Column) -> Column:
    """Hangul syllables, other one-to-many decompositions and private use, for the texts that have any."""
    longer = _decompositions()[2]
    table = F.create_map(*[F.lit(part) for pair in longer.items() for part in pair])

    def one(ch: Column) -> Column:
        several = F.coalesce(F.try_element_at(table, ch), ch)
        return F.when(ch.rlike("[\\x{AC00}-\\x{D7A3}]"), _hangul(ch)).otherwise(several)

    parts = F.array_join(F.transform(F.split(F.regexp_replace(col, f"[{_PRIVATE}]", ""), ""), one), "")
    return F.when(col.rlike(_beyond_ascii(_rare_ranges() + _PRIVATE)), parts).otherwise(col)


def folded(text: Column) -> Column:
    """Deleted characters removed, accents stripped, lower case. White space is left as it is.

    One character table does both: characters without a counterpart vanish.
    """
    source, target, _ = _decompositions()
    return F.lower(F.translate(_take_apart(text), source + _deleted(), target))


def bert_normalize(col: Column) -> Column:
    """Drop control characters, space out CJK, strip accents, lower-case."""
    clean = folded(F.coalesce(col, F.lit("")))
    blanks = F.regexp_replace(F.translate(clean, "\t\n\r", "   "), _beyond_ascii("\\p{Z}"), " ")
    return F.regexp_replace(blanks, _beyond_ascii(_CJK), " $0 ")


def pretokenize(col: Column) -> Column:
    """Words, single punctuation marks and single CJK characters of the normalised text."""
    return F.regexp_extract_all(folded(F.coalesce(col, F.lit(""))), F.lit(TOKEN_PATTERN), F.lit(0))


def raw_tokens(col: Column) -> Column:
    """The tokens of T3 as they stand in the raw text, each with what precedes it.

    Element i belongs to element i of :func:`pretokenize`; the lengths add up to end offsets.
    """
    pattern = f"{_lead_pattern()}(?:{_raw_token_pattern()})"
    return F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit(pattern), F.lit(0))


def lead_length(token: Column) -> Column:
    """Length of what precedes the token proper in an element of :func:`raw_tokens`."""
    return F.length(F.regexp_extract(token, f"^{_lead_pattern()}", 0))


def truncate_words(col: Column, n: int) -> Column:
    """T5: the part of the text that holds its first ``n`` pre-tokens."""
    pattern = f"^(?:{_lead_pattern()}(?:{_raw_token_pattern()})){{0,{n}}}+"
    return F.regexp_extract(F.coalesce(col, F.lit("")), pattern, 0)
