"""Text analysis in built-in expressions: accent folding, tokens, 1-2-grams, hashes."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_PATTERN = r"(?U)\b\w\w+\b"


# Hangul syllables fold to two or three letters by arithmetic; fixed values of their encoding.
_SYLLABLES, _LEADS, _VOWELS, _TAILS = 0xAC00, 0x1100, 0x1161, 0x11A7
_N_VOWELS, _N_TAILS, _N_SYLLABLES = 21, 28, 11_172


def _fold_tables() -> tuple[str, str, dict[str, str]]:
    """Characters that fold to one character, their targets, and those that fold to several.

    Covers all of Unicode but Hangul syllables: compatibility decomposition without combining
    marks. The marks themselves come last and have no target, so ``translate`` drops them.
    """
    source, target, several, marks = [], [], {}, []
    for code in range(0x80, sys.maxunicode + 1):
        char = chr(code)
        if unicodedata.combining(char):
            marks.append(char)
        elif unicodedata.decomposition(char):
            plain = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
            if len(plain) == 1 and plain != char:
                source.append(char)
                target.append(plain)
            elif len(plain) > 1:
                several[char] = plain
    return "".join(source + marks), "".join(target), several


_FOLD_FROM, _FOLD_TO, _SEVERAL = _fold_tables()


def _class_of(codes: Iterable[int], runs_a_block: int = 10) -> str:
    """A pattern for one of the characters, as runs inside blocks of runs: a character is tried against the few
    blocks and the runs of one, not against each of a thousand characters in turn."""
    runs: list[list[int]] = []
    for code in sorted(codes):
        if runs and runs[-1][1] == code - 1:
            runs[-1][1] = code
        else:
            runs.append([code, code])

    def span(low: int, high: int) -> str:
        return f"\\x{{{low:x}}}-\\x{{{high:x}}}"

    blocks = [runs[i : i + runs_a_block] for i in range(0, len(runs), runs_a_block)]
    inner = "".join(f"[{span(b[0][0], b[-1][1])}&&[{''.join(span(*r) for r in b)}]]" for b in blocks)
    return f"[{span(runs[0][0], runs[-1][1])}&&[{inner}]]"


_SEVERAL_PATTERN = _class_of([*map(ord, _SEVERAL), *range(_SYLLABLES, _SYLLABLES + _N_SYLLABLES)])


def _hangul_tables() -> tuple[str, str, str, str]:
    """All syllables with their first and second letters; those with a third one first, and the third ones."""
    codes = sorted(range(_N_SYLLABLES), key=lambda i: (i % _N_TAILS == 0, i))
    return (
        "".join(chr(_SYLLABLES + i) for i in codes),
        "".join(chr(_LEADS + i // (_N_VOWELS * _N_TAILS)) for i in codes),
        "".join(chr(_VOWELS + i // _N_TAILS % _N_VOWELS) for i in codes),
        "".join(chr(_TAILS + i % _N_TAILS) for i in codes if i % _N_TAILS),
    )


def _unfolded_singly(text: Column) -> Column:
    """Characters that fold to several, one by one; only texts that hold such a character come here."""
    known = F.str_to_map(F.lit("\x01".join(f"{c}\x02{p}" for c, p in _SEVERAL.items())), F.lit("\x01"), F.lit("\x02"))
    syllables, leads, vowels, tails = _hangul_tables()

    def one(c: Column) -> Column:
        letters = F.concat(F.translate(c, syllables, leads), F.translate(c, syllables, vowels), F.translate(c, syllables, tails))
        return F.when(c.between(chr(_SYLLABLES), chr(_SYLLABLES + _N_SYLLABLES - 1)), letters).otherwise(F.coalesce(known[c], c))

    return F.array_join(F.transform(F.split(text, ""), one), "")


def fold(text: Column) -> Column:
    """Lower-case text without accents and compatibility forms; pure ASCII skips the tables."""
    lowered = F.lower(text)
    single = F.translate(lowered, _FOLD_FROM, _FOLD_TO)
    return (
        F.when(~lowered.rlike(r"[^\x00-\x7F]"), lowered)
        .when(lowered.rlike(_SEVERAL_PATTERN), _unfolded_singly(single))
        .otherwise(single)
    )


def tokens(text: Column) -> Column:
    """Words of two or more characters, Unicode-aware."""
    return F.regexp_extract_all(fold(text), F.lit(TOKEN_PATTERN), F.lit(0))


def one_two_grams(words: Column) -> Column:
    """Each word and each pair of neighbouring words.

    The one-element ``transform`` names the word array, so an expensive ``words``
    expression runs once per row although three places use it.
    """

    def grams(w: Column) -> Column:
        others = F.greatest(F.size(w) - 1, F.lit(0))
        pairs = F.zip_with(F.slice(w, 1, others), F.slice(w, 2, others), lambda a, b: F.concat(a, F.lit(" "), b))
        return F.concat(w, pairs)

    return F.transform(F.array(words), grams)[0]


def text_hash(text: Column) -> Column:
    """SHA-256 of the UTF-8 text, in hex; a missing text counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)
