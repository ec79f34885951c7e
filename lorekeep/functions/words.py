"""Word expressions for inflection-tolerant lexical search."""

from __future__ import annotations

import itertools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words, inflection suffixes and the least stem length that results depend on.
STOP_WORDS = [
    "aber", "alle", "als", "also", "am", "an", "auch", "auf", "aus", "bei", "bin", "bis", "das", "dem", "den", "der", "des", "die",
    "ein", "eine", "einer", "eines", "für", "hat", "ich", "im", "in", "ist", "mit", "nach", "nicht", "oder", "sich", "sind", "über", "um",
    "und", "vom", "von", "vor", "was", "welche", "welcher", "welches", "werden", "wie", "wo", "zu", "zum", "zur",
]
SUFFIXES = ["e", "en", "er", "ern", "es", "n", "s"]
MIN_STEM = 6
TOKEN = r"[\p{L}\p{N}]{3,}"


def tokens(text: Column) -> Column:
    """Distinct words of three letters or digits and more, lower-cased, without stop words, in order of first use."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)))
    return F.array_except(found, F.array(*map(F.lit, STOP_WORDS)))


def folded(word: Column) -> Column:
    return F.replace(F.translate(F.lower(word), "äöü", "aou"), F.lit("ß"), F.lit("ss"))


def match(a: Column, b: Column) -> Column:
    """Whether two words are equal after folding, or one is the other's stem of MIN_STEM letters or more and a suffix."""
    x, y = folded(a), folded(b)

    def stem(s: Column, long: Column) -> Column:
        n = F.char_length(s)
        return (n >= MIN_STEM) & F.startswith(long, s) & F.substr(long, n + 1).isin(SUFFIXES)

    return (x == y) | stem(x, y) | stem(y, x)


def fold_word(word: str) -> str:
    return word.lower().translate(str.maketrans("äöü", "aou")).replace("ß", "ss")


def forms(word: str) -> list[str]:
    """Every folded word that `match` accepts for this one."""
    w = fold_word(word)
    out = {w}
    if len(w) >= MIN_STEM:
        out |= {w + s for s in SUFFIXES}
    out |= {w[: -len(s)] for s in SUFFIXES if w.endswith(s) and len(w) - len(s) >= MIN_STEM}
    return sorted(out)


def stems(word: str) -> list[str]:
    """The folded word and what is left of it without each suffix, where that is a stem: terms of a prefix search."""
    w = fold_word(word)
    return [*dict.fromkeys([w, *(w[: -len(s)] for s in SUFFIXES if w.endswith(s) and len(w) - len(s) >= MIN_STEM)])]


def _spellings(form: str) -> list[list[str]]:
    """What each letter, or run of s, of a folded form may be folded from."""
    letters = {"a": ["a", "ä"], "o": ["o", "ö"], "u": ["u", "ü"]}

    def runs(n: int) -> list[str]:
        return [""] if n == 0 else ["s" + x for x in runs(n - 1)] + (["ß" + x for x in runs(n - 2)] if n > 1 else [])

    return [runs(len(m[0])) if m[0][0] == "s" else letters.get(m[0], [m[0]]) for m in re.finditer("s+|[^s]", form)]


def word_pattern(word: str) -> str:
    """A pattern (RE2) for lower-cased texts that finds a token which `match` accepts for this word."""
    found = forms(word)
    if any(len(f) <= 3 for f in found) or any(fold_word(w) in found for w in STOP_WORDS):
        # a token has three characters at least and is no stop word, so what folds to a form is listed
        tokens = ("".join(x) for f in found for x in itertools.product(*_spellings(f)))
        out = [re.escape(t) for t in tokens if len(t) >= 3 and t not in STOP_WORDS] or [r"[^\s\S]"]
    else:
        out = ["".join("(?:" + "|".join(map(re.escape, x)) + ")" if len(x) > 1 else re.escape(x[0]) for x in _spellings(f)) for f in found]
    return r"(?:^|[^\p{L}\p{N}])(?:" + "|".join(out) + r")(?:$|[^\p{L}\p{N}])"


def coverage(query: list[str], words: Column) -> Column:
    """The share of query words that match a word of the array; a small set of forms for each stands for the pairwise test."""
    if not query:
        return F.lit(0.0)
    own = F.transform(words, folded)
    hits = [F.arrays_overlap(own, F.array(*map(F.lit, forms(q)))).cast("int") for q in query]
    return sum(hits[1:], hits[0]) / F.lit(float(len(query)))
