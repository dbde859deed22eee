"""Porter's suffix stripper, with its author's later departures: short words stay, -bli and -logi rules."""

from __future__ import annotations

import re

_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
_M0 = re.compile(f"^({_C})?{_V}{_C}")
_M1 = re.compile(f"^({_C})?{_V}{_C}({_V})?$")
_M2 = re.compile(f"^({_C})?{_V}{_C}{_V}{_C}")
_VOWEL = re.compile(f"^({_C})?{_V}")
_CVC = re.compile(f"^{_C}[aeiouy][^aeiouwxy]$")

_STEP2 = dict(p.split(":") for p in "ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble logi:log".split())
_STEP3 = dict(p.split(":") for p in "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:".split())
_STEP4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()


def _suffix(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def porter(w: str) -> str:
    """The stem of a lower-case word."""
    if len(w) <= 2:
        return w
    first_y = w[0] == "y"
    if first_y:
        w = "Y" + w[1:]
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _M0.match(w[:-3]):
            w = w[:-1]
    else:
        e = "ed" if w.endswith("ed") else "ing" if w.endswith("ing") else None
        if e and _VOWEL.match(w[: -len(e)]):
            w = w[: -len(e)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and w[-1] not in "aeiouylsz":
                w = w[:-1]
            elif _CVC.match(w):
                w += "e"
    if w.endswith("y") and _VOWEL.match(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        e = _suffix(w, table)
        if e and _M0.match(w[: -len(e)]):
            w = w[: -len(e)] + table[e]
    e = _suffix(w, _STEP4)
    ion = w.endswith(("sion", "tion"))
    if e and not (ion and len(e) < 3):
        if _M2.match(w[: -len(e)]):
            w = w[: -len(e)]
    elif ion and _M2.match(w[:-3]):
        w = w[:-3]
    if w.endswith("e"):
        s = w[:-1]
        if _M2.match(s) or (_M1.match(s) and not _CVC.match(s)):
            w = s
    if w.endswith("ll") and _M2.match(w):
        w = w[:-1]
    return "y" + w[1:] if first_y else w
