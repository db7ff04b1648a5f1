"""English word stems by the suffix rules of M. F. Porter (1980), with the later extensions that ROUGE scorers use."""

from __future__ import annotations

from functools import lru_cache

#: Irregular stems, and the suffix rules of the steps (ending, what takes its place).
IRREGULAR = {
    "skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning", "outings": "outing",
    "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
STEP_2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"),
    ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"),
    ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"),
]
STEP_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def shape(word: str) -> str:
    """A letter a letter: v for vowels (and y after a consonant), c for others."""
    out = ""
    for ch in word:
        vowel = ch in "aeiou" or ch == "y" and out[-1:] == "c"
        out += "v" if vowel else "c"
    return out


def measure(word: str) -> int:
    """How often a vowel is followed by a consonant."""
    return shape(word).count("vc")


def _short(word: str) -> bool:
    """Ends consonant, vowel, consonant other than w, x, y; or is just vowel, consonant."""
    s = shape(word)
    return s.endswith("cvc") and word[-1] not in "wxy" or s == "vc"


def _by_rules(word: str, rules: list[tuple[str, str]]) -> str:
    """The first ending that fits decides, if something of measure stands before it."""
    for ending, new in rules:
        if word.endswith(ending):
            stem = word.removesuffix(ending)
            return stem + new if measure(stem) > 0 else word
    return word


def _plural(w: str) -> str:
    if w.endswith("ies"):
        return w[:-1] if len(w) == 4 else w[:-2]
    if w.endswith("sses"):
        return w[:-2]
    return w[:-1] if w.endswith("s") and not w.endswith("ss") else w


def _past(w: str) -> str:
    if w.endswith("ied"):
        return w[:-1] if len(w) == 4 else w[:-2]
    if w.endswith("eed"):
        return w[:-1] if measure(w[:-3]) > 0 else w
    for ending in ("ed", "ing"):
        stem = w.removesuffix(ending)
        if stem != w:
            if "v" not in shape(stem):
                return w
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if len(stem) > 1 and stem[-1] == stem[-2] and shape(stem)[-1] == "c":
                return stem if stem[-1] in "lsz" else stem[:-1]
            return stem + "e" if measure(stem) == 1 and _short(stem) else stem
    return w


def _derived(w: str) -> str:
    if w.endswith("alli") and measure(w[:-4]) > 0:
        return _derived(w[:-2])
    if w.endswith("logi"):
        return w[:-1] if measure(w[:-3]) > 0 else w
    return _by_rules(w, STEP_2)


def _long(w: str) -> str:
    for ending in sorted(STEP_4, key=len, reverse=True):
        if w.endswith(ending):
            stem = w.removesuffix(ending)
            fits = measure(stem) > 1 and (ending != "ion" or stem.endswith(("s", "t")))
            return stem if fits else w
    return w


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    w = _past(_plural(word))
    if w.endswith("y") and len(w) > 2 and shape(w)[-2] == "c":
        w = w[:-1] + "i"
    w = _long(_by_rules(_derived(w), STEP_3))
    if w.endswith("e") and (measure(w[:-1]) > 1 or measure(w[:-1]) == 1 and not _short(w[:-1])):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and measure(w[:-1]) > 1 else w
