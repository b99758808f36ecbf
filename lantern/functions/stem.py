"""The Porter stemmer (Porter, 1980), for index terms; applied to distinct terms only."""

from __future__ import annotations

# Suffix rules of the published algorithm, longest first within a step.
STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("logi", "log"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


#: A letter's kind, as bytes: vowel, y (which depends on what is before it) or consonant.
_KINDS = bytes(ord("v") if c in b"aeiou" else c if c == ord("y") else ord("c") for c in range(256))


def _kinds(w: str) -> bytes:
    """v or c for each letter of a word; those of its beginnings are beginnings of this."""
    out = w.encode("latin-1", "replace").translate(_KINDS)
    at = out.find(b"y")
    while at >= 0:
        out = out[:at] + (b"v" if out[at - 1 : at] == b"c" else b"c") + out[at + 1 :]
        at = out.find(b"y", at)
    return out


def _by_end(rules: list[tuple[str, str]]) -> dict[str, list[tuple[str, str, bytes]]]:
    """Rules by the last two letters of their suffix, longest first, with the kinds of what takes its place."""
    out: dict[str, list] = {}
    for end, to in sorted(rules, key=lambda r: -len(r[0])):
        out.setdefault(end[-2:], []).append((end, to, _kinds(to)))
    return out


_STEPS23 = (_by_end(STEP2), _by_end(STEP3))
_STEP4 = _by_end([(end, "") for end in STEP4])


def porter(w: str) -> str:
    """Kinds of letters are told once a word and cut with it: a measure is the number of vc in a beginning of them."""
    if len(w) < 3:
        return w
    if w[-1] == "s":
        if w.endswith("sses"):
            w = w[:-2]
        elif w.endswith("ies"):
            w = w[:-3] + "i"
        elif w[-2] != "s":
            w = w[:-1]
    kinds = _kinds(w)
    if w.endswith("eed"):
        if kinds.count(b"vc", 0, len(w) - 3) > 0:
            w, kinds = w[:-1], kinds[:-1]
    else:
        cut = 2 if w.endswith("ed") else 3 if w.endswith("ing") else 0
        if cut and kinds.find(b"v", 0, len(w) - cut) >= 0:
            w, kinds = w[:-cut], kinds[:-cut]
            if w.endswith(("at", "bl", "iz")):
                w, kinds = w + "e", kinds + b"v"
            elif len(w) > 1 and w[-1] == w[-2] and kinds[-1:] == b"c":
                if w[-1] not in "lsz":
                    w, kinds = w[:-1], kinds[:-1]
                elif kinds.count(b"vc") == 1 and kinds.endswith(b"cvc"):
                    w, kinds = w + "e", kinds + b"v"
            elif kinds.count(b"vc") == 1 and kinds.endswith(b"cvc") and w[-1] not in "wxy":
                w, kinds = w + "e", kinds + b"v"
    if w[-1] == "y" and kinds.find(b"v", 0, len(w) - 1) >= 0:
        w, kinds = w[:-1] + "i", kinds[:-1] + b"v"
    for rules in _STEPS23:
        for end, to, more in rules.get(w[-2:], ()):
            if w.endswith(end):
                n = len(w) - len(end)
                if kinds.count(b"vc", 0, n) > 0:
                    w, kinds = w[:n] + to, kinds[:n] + more
                break
    for end, _, _ in _STEP4.get(w[-2:], ()):
        if w.endswith(end):
            n = len(w) - len(end)
            if kinds.count(b"vc", 0, n) > 1 and (end != "ion" or w[n - 1 : n] in ("s", "t")):
                w, kinds = w[:n], kinds[:n]
            break
    if w[-1:] == "e":
        m = kinds.count(b"vc", 0, len(w) - 1)
        if m > 1 or (m == 1 and not (kinds[:-1].endswith(b"cvc") and w[-2] not in "wxy")):
            w, kinds = w[:-1], kinds[:-1]
    if w.endswith("ll") and kinds.count(b"vc", 0, len(w) - 1) > 1:
        w = w[:-1]
    return w


_FORMS: dict[str, str] = {}
_OLDER: dict[str, str] = {}


def stemmed_form(t: str | None) -> str | None:
    """The stem of an ASCII term; others stay. A worker keeps the stems of terms that it has met, up to a number; of those, what it
    meets again outlasts the rest."""
    global _FORMS, _OLDER
    if not t or not t.isascii():
        return t
    form = _FORMS.get(t)
    if form is None:
        if len(_FORMS) > 100_000:
            _FORMS, _OLDER = {}, _FORMS
        form = _OLDER.get(t)
        if form is None:
            form = porter(t)
        _FORMS[t] = form
    return form
