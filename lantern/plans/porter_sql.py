"""The Porter stemmer (Porter, 1980) as a chain of SQL queries, written apart from the one that the engine runs.

A `y` that is a consonant (at the start or after a vowel) is written `Y` on the way, so that patterns can tell the two."""

from __future__ import annotations

# Suffix rules of the published algorithm, with the departures that its author published later, for which no
# shorter suffix of the same step may stand before a longer one.
DOUBLE_SUFFIXES = {"ational": "ate", "ization": "ize", "iveness": "ive", "fulness": "ful", "ousness": "ous", "tional": "tion", "biliti": "ble", "entli": "ent", "ousli": "ous", "ation": "ate", "alism": "al", "aliti": "al", "iviti": "ive", "enci": "ence", "anci": "ance", "izer": "ize", "alli": "al", "ator": "ate", "logi": "log", "bli": "ble", "eli": "e"}
FULL_NESS = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ness": "", "ful": ""}
LAST_SUFFIXES = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic", "ou"]

_C, _V = "[^aeiouy]", "[aeiouy]"


def _m(s: str, least: int) -> str:
    """Whether a stem has at least `least` sequences of a vowel and a consonant."""
    return f"regexp_matches({s}, '^{_C}*({_V}+{_C}+){{{least},}}')"


def _cvc(s: str) -> str:
    return f"regexp_matches({s}, '{_C}{_V}[^aeiouywxY]$')"


def _without(n: int) -> str:
    return f"left(w, length(w) - {n})"


def _rules(rules: dict[str, str]) -> str:
    cases = "".join(f" WHEN ends_with(w, '{end}') THEN CASE WHEN {_m(_without(len(end)), 1)} THEN {_without(len(end))} || '{to}' ELSE w END" for end, to in rules.items())
    return f"CASE{cases} ELSE w END"


def _last() -> str:
    cases = ""
    for end in LAST_SUFFIXES:
        stem = _without(len(end))
        extra = f" AND right({stem}, 1) IN ('s', 't')" if end == "ion" else ""
        cases += f" WHEN ends_with(w, '{end}') THEN CASE WHEN {_m(stem, 2)}{extra} THEN {stem} ELSE w END"
    return f"CASE{cases} ELSE w END"


def stems(words: str) -> str:
    """term, stem of the distinct terms of a query's column term."""
    has = f"regexp_matches({{}}, '{_V}')"
    twin = "right(w, 1) = left(right(w, 2), 1) AND length(w) > 1 AND regexp_matches(w, '[^aeiouylsz]$')"
    steps = [
        "CASE WHEN ends_with(w, 'sses') OR ends_with(w, 'ies') THEN left(w, length(w) - 2) WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN left(w, length(w) - 1) ELSE w END AS w, false AS cut",
        f"CASE WHEN ends_with(w, 'eed') THEN CASE WHEN {_m(_without(3), 1)} THEN {_without(1)} ELSE w END WHEN ends_with(w, 'ed') AND {has.format(_without(2))} THEN {_without(2)} WHEN ends_with(w, 'ing') AND {has.format(_without(3))} THEN {_without(3)} ELSE w END AS w,"
        f" NOT ends_with(w, 'eed') AND ((ends_with(w, 'ed') AND {has.format(_without(2))}) OR (ends_with(w, 'ing') AND {has.format(_without(3))})) AS cut",
        f"CASE WHEN NOT cut THEN w WHEN ends_with(w, 'at') OR ends_with(w, 'bl') OR ends_with(w, 'iz') THEN w || 'e' WHEN {twin} THEN {_without(1)} WHEN {_m('w', 1)} AND NOT {_m('w', 2)} AND {_cvc('w')} THEN w || 'e' ELSE w END AS w, cut",
        f"CASE WHEN lower(right(w, 1)) = 'y' AND {has.format(_without(1))} THEN {_without(1)} || 'i' ELSE w END AS w, cut",
        f"{_rules(DOUBLE_SUFFIXES)} AS w, cut",
        f"{_rules(FULL_NESS)} AS w, cut",
        f"{_last()} AS w, cut",
        f"CASE WHEN ends_with(w, 'e') AND ({_m(_without(1), 2)} OR ({_m(_without(1), 1)} AND NOT {_cvc(_without(1))})) THEN {_without(1)} ELSE w END AS w, cut",
        f"CASE WHEN ends_with(w, 'll') AND {_m(_without(1), 2)} THEN {_without(1)} ELSE w END AS w, cut",
    ]
    marked = "regexp_replace(regexp_replace(term, '(^|[aeiou])y', '\\1Y', 'g'), 'yy', 'yY', 'g')"
    sql = f"SELECT DISTINCT term, {marked} AS w, false AS cut FROM ({words}) WHERE length(term) > 2 AND regexp_full_match(term, '[a-z0-9]+')"
    for step in steps:
        sql = f"SELECT term, {step} FROM ({sql})"
    return f"SELECT term, lower(w) AS stem FROM ({sql})"
