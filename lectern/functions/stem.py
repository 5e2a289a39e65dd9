"""English stems by the published Porter2 rules; a small helper for the words of a vocabulary."""

from __future__ import annotations

import re
from functools import lru_cache

# Fixed values of the published algorithm: words with stems of their own, words left alone after step 1a, suffix tables.
_OWN = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_LEFT = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous",
    "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble", "ogi": "og", "li": "",
}
_STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")
_VOWEL, _LI = "aeiouy", "cdeghkmnrt"
_REGION = re.compile(rf"[{_VOWEL}][^{_VOWEL}]")
_SHORT = re.compile(rf"(^[{_VOWEL}][^{_VOWEL}]$)|([^{_VOWEL}][{_VOWEL}][^{_VOWEL}wxY]$)")


def _regions(word: str) -> tuple[int, int]:
    """Where the word's first and second region begin: each after the first consonant that follows a vowel."""
    head = re.match("gener|commun|arsen", word)
    found = None if head else _REGION.search(word)
    first = head.end() if head else found.end() if found else len(word)
    second = _REGION.search(word, first)
    return first, second.end() if second else len(word)


def _longest(word: str, suffixes) -> str:
    return max((s for s in suffixes if word.endswith(s)), key=len, default="")


def _plural(w: str) -> str:
    w = w[: len(w) - len(_longest(w, ("'", "'s", "'s'")))]
    end = _longest(w, ("sses", "ied", "ies", "us", "ss", "s"))
    if end == "sses":
        return w[:-2]
    if end in ("ied", "ies"):
        return w[:-2] if len(w) > 4 else w[:-1]
    return w[:-1] if end == "s" and re.search(f"[{_VOWEL}]", w[:-2]) else w


def _past(w: str, r1: int) -> str:
    end = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    base = w[: len(w) - len(end)]
    if end in ("eed", "eedly"):
        return base + "ee" if len(base) >= r1 else w
    if not end or not re.search(f"[{_VOWEL}]", base):
        return w
    if base.endswith(("at", "bl", "iz")):
        return base + "e"
    if re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", base):
        return base[:-1]
    return base + "e" if len(base) <= r1 and _SHORT.search(base) else base


def _derived(w: str, r1: int, r2: int) -> str:
    end = _longest(w, _STEP2)
    base = w[: len(w) - len(end)]
    if end and len(base) >= r1 and not (end == "ogi" and not base.endswith("l")) and not (end == "li" and base[-1:] not in tuple(_LI)):
        w = base + _STEP2[end]
    end = _longest(w, _STEP3)
    base = w[: len(w) - len(end)]
    if end and len(base) >= r1 and not (end == "ative" and len(base) < r2):
        w = base + _STEP3[end]
    end = _longest(w, _STEP4)
    base = w[: len(w) - len(end)]
    if end and len(base) >= r2 and not (end == "ion" and base[-1:] not in ("s", "t")):
        w = base
    base = w[:-1]
    if w.endswith("e") and (len(base) >= r2 or (len(base) >= r1 and not _SHORT.search(base))):
        return base
    return base if w.endswith("ll") and len(base) >= r2 else w


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of up to two letters, and such as aren't a-z, stay."""
    if len(word) <= 2 or not re.fullmatch("[a-z']+", word):
        return word
    if word in _OWN:
        return _OWN[word]
    w = re.sub(rf"(^|[{_VOWEL}])y", r"\1Y", word.removeprefix("'"))
    r1, r2 = _regions(w)
    w = _plural(w)
    if w in _LEFT:
        return w
    w = _past(w, r1)
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWEL:
        w = w[:-1] + "i"
    return _derived(w, r1, r2).lower()
