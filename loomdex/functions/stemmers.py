"""The published Snowball stemmers for English (Porter2) and Russian, and the choice between them by script."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

_VOWELS = "aeiouy"
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
# Fixed values of the published algorithms.
_SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", **{w: w for w in "sky news howe atlas cosmos bias andes".split()}}
_AFTER_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
_STEP2 = {"ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble"}
_STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")
_LI = "cdeghkmnrt"


def _regions(word: str, vowels: str) -> tuple[int, int]:
    """Where R1 and R2 begin."""

    def after(at: int) -> int:
        for i in range(at + 1, len(word)):
            if word[i] not in vowels and word[i - 1] in vowels:
                return i + 1
        return len(word)

    r1 = after(0)
    for prefix in ("gener", "commun", "arsen"):
        if word.startswith(prefix):
            r1 = len(prefix)
    return r1, after(r1) if r1 < len(word) else len(word)


def _short_end(word: str) -> bool:
    if len(word) == 2:
        return word[0] in _VOWELS and word[1] not in _VOWELS
    return len(word) > 2 and word[-3] not in _VOWELS and word[-2] in _VOWELS and word[-1] not in _VOWELS + "wxY"


def _step1(word: str, r1: int) -> str:
    for end in ("'s'", "'s", "'"):
        if word.endswith(end):
            word = word[: -len(end)]
            break
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and any(c in _VOWELS for c in word[:-2]):
        word = word[:-1]
    if word in _AFTER_1A:
        return word
    for end in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if word.endswith(end):
            stem = word[: -len(end)]
            if end in ("eed", "eedly"):
                if len(stem) >= r1:
                    word = stem + "ee"
            elif any(c in _VOWELS for c in stem):
                word = stem
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif word.endswith(_DOUBLES):
                    word = word[:-1]
                elif r1 >= len(word) and _short_end(word):
                    word += "e"
            break
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in _VOWELS:
        word = word[:-1] + "i"
    return word


def _step2(word: str, r1: int) -> str:
    for end, new in _STEP2.items():
        if word.endswith(end):
            return word[: -len(end)] + new if len(word) - len(end) >= r1 else word
    if word.endswith("ogi"):
        return word[:-1] if len(word) - 3 >= r1 and word[-4:-3] == "l" else word
    if word.endswith("li") and len(word) - 2 >= r1 and word[-3:-2] and word[-3] in _LI:
        return word[:-2]
    return word


def _steps345(word: str, r1: int, r2: int) -> str:
    for end, new in _STEP3.items():
        if word.endswith(end):
            if len(word) - len(end) >= r1:
                word = word[: -len(end)] + new
            break
    else:
        if word.endswith("ative") and len(word) - 5 >= r2:
            word = word[:-5]
    for end in _STEP4:
        if word.endswith(end):
            if len(word) - len(end) >= r2:
                word = word[: -len(end)]
            break
    else:
        if word.endswith("ion") and len(word) - 3 >= r2 and word[-4:-3] in ("s", "t"):
            word = word[:-3]
    if word.endswith("e"):
        if len(word) - 1 >= r2 or (len(word) - 1 >= r1 and not _short_end(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word


def stem_english(word: str) -> str:
    """Porter2; words of one or two letters stay as they are."""
    word = word.lower().translate({0x2019: "'", 0x2018: "'", 0x201B: "'"})
    if len(word) <= 2:
        return word
    if word in _SPECIAL:
        return _SPECIAL[word]
    word = word.removeprefix("'")
    marked = "".join("Y" if c == "y" and (i == 0 or word[i - 1] in _VOWELS) else c for i, c in enumerate(word))
    r1, r2 = _regions(marked, _VOWELS)
    word = _step1(marked, r1)
    if word not in _AFTER_1A:
        word = _steps345(_step2(word, r1), r1, r2)
    return word.replace("Y", "y")


_RU_VOWELS = "аеиоуыэюя"
# Fixed values of the published algorithm; endings after which а or я must stand come first.
_GERUND = ("вшись", "вши", "в"), ("ывшись", "ившись", "ывши", "ивши", "ыв", "ив")
_ADJECTIVE = sorted("ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею".split(), key=len, reverse=True)
_PARTICIPLE = ("ем", "нн", "вш", "ющ", "щ"), ("ивш", "ывш", "ующ")
_VERB = (
    sorted("ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно".split(), key=len, reverse=True),
    sorted("ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю".split(), key=len, reverse=True),
)
_NOUN = sorted("а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я".split(), key=len, reverse=True)


def _cut(word: str, at: int, endings) -> str | None:
    """The word without the longest of the endings that lies behind `at`; None if there is none."""
    for end in endings:
        if len(word) - len(end) >= at and word.endswith(end):
            return word[: -len(end)]
    return None


def _cut_two(word: str, at: int, groups) -> str | None:
    """As _cut, but endings of the first group must follow an а or я, which stays."""
    for end in sorted([*groups[0], *groups[1]], key=len, reverse=True):
        if len(word) - len(end) >= at and word.endswith(end):
            if end in groups[1]:
                return word[: -len(end)]
            if len(word) - len(end) - 1 >= at and word[-len(end) - 1] in "ая":
                return word[: -len(end)]
    return None


def stem_russian(word: str) -> str:
    word = word.lower()
    rv = next((i + 1 for i, c in enumerate(word) if c in _RU_VOWELS), len(word))
    r1 = next((i + 1 for i in range(1, len(word)) if word[i] not in _RU_VOWELS and word[i - 1] in _RU_VOWELS), len(word))
    r2 = next((i + 1 for i in range(r1 + 1, len(word)) if word[i] not in _RU_VOWELS and word[i - 1] in _RU_VOWELS), len(word))
    done = _cut_two(word, rv, _GERUND)
    if done is None:
        word = _cut(word, rv, ("ся", "сь")) or word
        done = _cut(word, rv, _ADJECTIVE)
        if done is not None:
            further = _cut_two(done, rv, _PARTICIPLE)
            done = done if further is None else further
        else:
            done = _cut_two(word, rv, _VERB)
            if done is None:
                done = _cut(word, rv, _NOUN)
    word = word if done is None else done
    if len(word) > rv and word.endswith("и"):
        word = word[:-1]
    word = _cut(word, max(r2, rv), ("ость", "ост")) or word
    if len(word) - 2 >= rv and word.endswith("нн"):
        return word[:-1]
    further = _cut(word, rv, ("ейше", "ейш"))
    if further is not None:
        return further[:-1] if len(further) - 2 >= rv and further.endswith("нн") else further
    return word[:-1] if len(word) > rv and word.endswith("ь") else word


_FIRST = re.compile(r"[^\W\d_]")


@lru_cache(maxsize=1 << 17)
def stem(token: str) -> str:
    """By the token's first Cyrillic or Latin letter: the Russian or the English stem; a token without either stays as it is."""
    for m in _FIRST.finditer(token):
        name = unicodedata.name(m[0], "")
        if name.startswith("CYRILLIC"):
            return stem_russian(token)
        if name.startswith("LATIN") or m[0] in "ªº":
            return stem_english(token)
    return token
