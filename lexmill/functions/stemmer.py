"""A suffix-stripping stemmer of Porter's kind, with the deviations that the index format expects.

A word is seen through its shape, a string of one ``V`` or ``C`` a letter, in which ``y`` is a vowel unless a vowel
stands before it; the measure of a stem is how often a vowel run is followed by a consonant. Deviations from the published
algorithm: undoubling also drops doubled vowels; ``y`` is never a vowel in the consonant-vowel-consonant test; the
fourth step goes on to shorter suffixes where the measure is too low; the test for a vowel counts every ``y``.
"""

from __future__ import annotations

import re

_ASCII = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

# Suffixes with what replaces them where the measure of the rest is positive; the first that fits decides.
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
    ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

_CVC = re.compile("[^aeiou][aeiou][^aeiouwxy]$").search
_DOUBLE = re.compile(r"([^lsz])\1$").search


def measure(stem: str) -> int:
    """Vowel runs that a consonant follows."""
    shape = re.sub("[aeiou]", "V", re.sub("[^aeiouy]", "C", stem))
    # from left to right a y is a vowel where no vowel precedes it
    while "y" in shape:
        at = shape.index("y")
        shape = shape[:at] + ("C" if shape[:at].endswith("V") else "V") + shape[at + 1 :]
    return len(re.findall("V+C", shape))


def _swap(word: str, rules: tuple[tuple[str, str], ...]) -> str:
    rule = next((r for r in rules if word.endswith(r[0])), None)
    if rule is None:
        return word
    rest = word.removesuffix(rule[0])
    return rest + rule[1] if measure(rest) else word


def _plural(word: str) -> str:
    if word.endswith(("sses", "ies")):
        return word[:-2]
    return word[:-1] if re.search("(?<!s)s$", word) else word


def _past(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if measure(word[:-3]) else word
    found = re.fullmatch("(.*[aeiouy].*)(?:ed|ing)", word)
    if not found:
        return word
    rest = found[1]
    if rest.endswith(("at", "bl", "iz")):
        return rest + "e"
    if _DOUBLE(rest):
        return rest[:-1]
    return rest + "e" if measure(rest) == 1 and _CVC(rest) else rest


def _drop(word: str) -> str:
    for suffix in STEP_4:
        if word.endswith(suffix) and measure(word.removesuffix(suffix)) > 1:
            return word.removesuffix(suffix)
    rest = word.removesuffix("ion")
    return rest if rest != word and rest.endswith(("s", "t")) and measure(rest) > 1 else word


def _tidy(word: str) -> str:
    if word.endswith("e"):
        rest = word[:-1]
        m = measure(rest)
        if m > 1 or m == 1 and not _CVC(rest):
            word = rest
    return word[:-1] if word.endswith("ll") and measure(word) > 1 else word


def stem(word: str) -> str:
    """The stem of a word; characters other than ASCII letters are left out first, so the result may be empty."""
    word = re.sub("[^A-Za-z]", "", word).translate(_ASCII)
    if len(word) < 3:
        return word
    word = _past(_plural(word))
    if re.search("[aeiouy].*y$", word):
        word = word[:-1] + "i"
    return _tidy(_drop(_swap(_swap(word, STEP_2), STEP_3)))
