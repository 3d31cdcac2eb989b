"""Porter's stemmer (1980) and a tokenizer that folds diacritics, as an Arrow function over whole columns."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

_WORD = re.compile(r"[^\W_]+")


def _consonant(w: str, i: int) -> bool:
    if w[i] in "aeiou":
        return False
    return not (w[i] == "y" and i > 0 and _consonant(w, i - 1))


def _measure(w: str) -> int:
    shape = re.sub(r"(.)\1+", r"\1", "".join("c" if _consonant(w, i) else "v" for i in range(len(w))))
    return shape.count("vc")


def _vowel(w: str) -> bool:
    return any(not _consonant(w, i) for i in range(len(w)))


def _cvc(w: str) -> bool:
    n = len(w)
    return n > 2 and _consonant(w, n - 1) and not _consonant(w, n - 2) and _consonant(w, n - 3) and w[-1] not in "wxy"


#: Suffixes of steps 2 to 4 and what they become (fixed values of the published algorithm).
_STEP2 = (
    "ational ate, tional tion, enci ence, anci ance, izer ize, abli able, alli al, entli ent, eli e, ousli ous, ization ize, ation ate, ator ate, "
    "alism al, iveness ive, fulness ful, ousness ous, aliti al, iviti ive, biliti ble"
)
_STEP3 = "icate ic, ative , alize al, iciti ic, ical ic, ful , ness "
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _pairs(text: str) -> list[tuple[str, str]]:
    out = [(p.split(" ")[0], p.split(" ")[1] if " " in p.strip() or p.endswith(" ") else "") for p in text.split(", ")]
    return sorted(out, key=lambda x: -len(x[0]))


_PAIRS2, _PAIRS3 = _pairs(_STEP2), _pairs(_STEP3)
_SORTED4 = sorted(_STEP4, key=len, reverse=True)


@lru_cache(maxsize=200_000)
def stem(w: str) -> str:
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    again = False
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    elif w.endswith("ed") and _vowel(w[:-2]):
        w, again = w[:-2], True
    elif w.endswith("ing") and _vowel(w[:-3]):
        w, again = w[:-3], True
    if again:
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1) and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _cvc(w):
            w += "e"
    if w.endswith("y") and _vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_PAIRS2, _PAIRS3):
        for old, new in table:
            if w.endswith(old):
                if _measure(w[: -len(old)]) > 0:
                    w = w[: -len(old)] + new
                break
    for old in _SORTED4:
        if w.endswith(old):
            base = w[: -len(old)]
            if _measure(base) > 1 and (old != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def tokens(text: str | None, porter: bool = True) -> list[str]:
    if not text:
        return []
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))
    out = _WORD.findall(text.lower())
    return [stem(w) for w in out] if porter else out
