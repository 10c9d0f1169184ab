"""Porter's suffix stripping (1980), with the limits that full-text indexes put on it."""

from __future__ import annotations

import functools
import re

#: Words outside these lengths are left alone.
SHORTEST, LONGEST = 3, 64
# A y is a consonant at the beginning and after a vowel.
_CONS, _VOWELS = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
_TO_VOWELS = f"(?:{_CONS}{_VOWELS}|[aeiou]+)"
_MORE_THAN_0 = re.compile(f"^{_TO_VOWELS}{_CONS}")
_EXACTLY_1 = re.compile(f"^{_TO_VOWELS}{_CONS}(?:{_VOWELS})?$")
_MORE_THAN_1 = re.compile(f"^{_TO_VOWELS}{_CONS}{_VOWELS}{_CONS}")
_HAS_VOWEL = re.compile("^(?:.*[aeiou]|.+y)")
_SHORT_END = re.compile(f"^{_CONS}[aeiouy][^aeiouwxy]$")
# Suffixes and replacements of the second, third and fourth step.  Fixed values.
_SECOND = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "logi": "log", "bli": "ble", "alli": "al",
    "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive",
    "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
_THIRD = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _first_step(word: str) -> str:
    """Plurals, past forms and a final y."""
    if len(word) > 3 and word.endswith("ies") or len(word) > 4 and word.endswith("sses"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if len(word) > 3 and word.endswith("eed"):
        if _MORE_THAN_0.match(word[:-3]):
            word = word[:-1]
    else:
        for end in ("ed", "ing"):
            if word.endswith(end) and _HAS_VOWEL.match(word[: -len(end)]):
                word = _after_removal(word[: -len(end)])
                break
    if word.endswith("y") and _HAS_VOWEL.match(word[:-1]):
        word = word[:-1] + "i"
    return word


def _after_removal(word: str) -> str:
    if word.endswith(("at", "bl", "iz")):
        return word + "e"
    if len(word) > 1 and word[-1] == word[-2] and re.match(r"[^aeioulsz]", word[-1]):
        return word[:-1]
    if _EXACTLY_1.match(word) and _SHORT_END.match(word):
        return word + "e"
    return word


@functools.lru_cache(maxsize=1 << 18)
def stem(word: str) -> str:
    """The stem of a lower-case ASCII word."""
    if not SHORTEST <= len(word) <= LONGEST:
        return word
    word = _first_step(word)
    for table in (_SECOND, _THIRD):
        end = _longest(word, table)
        if end and _MORE_THAN_0.match(word[: -len(end)]):
            word = word[: -len(end)] + table[end]
    end = _longest(word, _FOURTH)
    if end and _MORE_THAN_1.match(word[: -len(end)]) and (end != "ion" or word[: -len(end)].endswith(("s", "t"))):
        word = word[: -len(end)]
    if word.endswith("e"):
        rest = word[:-1]
        if _MORE_THAN_1.match(rest) or (_EXACTLY_1.match(rest) and not _SHORT_END.match(rest)):
            word = rest
    if word.endswith("ll") and _MORE_THAN_1.match(word[:-1]):
        word = word[:-1]
    return word
