"""One consistent form of text that looks the same.

Two steps. (1) Quick check: a pattern finds the unstable segments, that is characters whose NFC quick-check property is not Yes or that have a
folding (width forms, ligatures, presentation forms, other spaces, invisible characters), with the starter before them and the marks after them
as boundary context; only these segments are folded and composed, then spliced into the unchanged rest. (2) Letters that look alike across
Latin, Cyrillic and Greek: a word is unstable if it has letters of another script than its own; its own script is that of its letters that have no
double elsewhere, else that of the nearest word
before it in its sentence which has such letters, else of the nearest after it in its sentence, else before that, else of the text's first, else Latin. Both steps depend on looks only, so texts that look the
same end in the same form. Case, accents, punctuation marks and the number and kind of ordinary blanks stay as they are.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

# Letters of the same shape, in the same order in each line.
_CYRILLIC, _LATIN_C = "АВЕЅІЈКМНОРСТУХаеѕіјорсух", "ABESIJKMHOPCTYXaesijopcyx"
_GREEK, _LATIN_G = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανιρυγχ", "ABEZHIKMNOPTYXoavipuyx"
# Rare letters that are read as the Latin ones wherever they stand.
_RARE, _LATIN_R = "ԁһԛԝӏԌԚԜϲϳϹՕօᴏɑɡⲞⲟⲢⲣⲤⲥⲦⲎⲒⲔⲘⲚⲨⲬ", "dhqwlGQWcjCOooagOoPpCcTHIKMNYX"
_CHEROKEE, _LATIN_K = "ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏏᏔᏙᏚᏞᏟᏢᏦ", "DRTAJEWMHGZbWVSLCPK"
_LISU, _LATIN_S = "ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"
# Format characters that can be seen, and letters and marks that can't.
_SEEN_FORMAT = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}
_UNSEEN = {0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
_KEPT_CONTROLS = {0x9, 0xA, 0xB, 0xC, 0xD, 0x85}
_TAGS = {"<wide>", "<narrow>", "<initial>", "<medial>", "<final>", "<isolated>", "<noBreak>", "<font>"}
_COMPAT = re.compile("LIGATURE|MICRO SIGN|ROMAN NUMERAL|LETTER (DZ|LJ|NJ)|LETTER [DLN] WITH SMALL LETTER")


def _foldings() -> tuple[dict[int, str], set[int], set[int]]:
    """Foldings of single characters; characters whose NFC quick check is not Yes; characters with a combining class."""
    fold: dict[int, str] = {}
    check: set[int] = {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}
    marks: set[int] = set()
    for code in range(sys.maxunicode + 1):
        ch = chr(code)
        kind = unicodedata.category(ch)
        if kind in ("Cn", "Co", "Cs"):
            continue
        if unicodedata.combining(ch):
            marks.add(code)
        if code in _UNSEEN or (kind == "Cf" and code not in _SEEN_FORMAT) or (kind == "Cc" and code not in _KEPT_CONTROLS):
            fold[code] = ""
            continue
        if kind == "Zs" and code != 0x20:
            fold[code] = " "
            continue
        parts = unicodedata.decomposition(ch).split()
        if not parts:
            continue
        if parts[0][0] != "<":
            if unicodedata.normalize("NFC", ch) != ch:
                check.add(code)
            elif len(parts) == 2:
                check.add(int(parts[1], 16))  # may compose with what stands before it
        elif parts[0] in _TAGS or (parts[0] == "<compat>" and _COMPAT.search(unicodedata.name(ch, ""))):
            fold[code] = unicodedata.normalize("NFKC", ch)
    for rare, latin in zip(_RARE + _CHEROKEE + _LISU, _LATIN_R + _LATIN_K + _LATIN_S, strict=True):
        fold[ord(rare)] = latin
    return fold, check, marks


def _class(codes: set[int]) -> str:
    """A character class of a regular expression, as ranges."""
    out, at = [], sorted(codes)
    i = 0
    while i < len(at):
        j = i
        while j + 1 < len(at) and at[j + 1] == at[j] + 1:
            j += 1
        out.append(f"\\U{at[i]:08x}-\\U{at[j]:08x}" if j > i else f"\\U{at[i]:08x}")
        i = j + 1
    return "".join(out)


class _Tables:
    """Made once per process; a third of a second."""

    def __init__(self) -> None:
        self.fold, check, marks = _foldings()
        u, m = _class(check | set(self.fold)), _class(marks - check - set(self.fold))
        self.folded = re.compile(f"[{_class(set(self.fold))}]")
        self.segment = re.compile(f"[^{u}{m}]?[{m}]*[{u}][{u}{m}]*|[^{u}{m}]?[{m}]{{2,}}")


@lru_cache(maxsize=1)
def _tables() -> _Tables:
    return _Tables()


#: Latin letter of a class to its double in each script, and each double to its Latin letter.
_DOUBLES = {"C": dict(zip(_LATIN_C, _CYRILLIC, strict=True)), "G": dict(zip(_LATIN_G, _GREEK, strict=True)), "L": {}}
_TO_LATIN = {**dict(zip(_CYRILLIC, _LATIN_C, strict=True)), **dict(zip(_GREEK, _LATIN_G, strict=True))}
_AMBIGUOUS = frozenset(_LATIN_C + _LATIN_G)
_SHARED = _AMBIGUOUS | frozenset(_CYRILLIC + _GREEK)
_SKELETON = str.maketrans(_TO_LATIN)
_LATIN, _CYR, _GRE = "A-Za-zÀ-ÖØ-öø-ɏḀ-ỿ", "Ѐ-ԯ", "Ͱ-Ͽἀ-῿"
_WORD = re.compile(f"[{_LATIN}{_CYR}{_GRE}][{_LATIN}{_CYR}{_GRE}̀-ͯ]*")
_HAS = {"L": re.compile(f"[{_LATIN}]"), "C": re.compile(f"[{_CYR}]"), "G": re.compile(f"[{_GRE}]")}
_PAUSE = re.compile(r"[.!?;:|\n\r。]")
_PLAIN_ASCII = re.compile(r"[\t-\r -~]*\Z")


def _quick_check(text: str) -> bool:
    """Whether every character is stable: composed, in canonical order, and without a folding."""
    return unicodedata.is_normalized("NFC", text) and not _tables().folded.search(text)


def _stable_segments(text: str) -> str:
    if _quick_check(text):
        return text
    t = _tables()
    return t.segment.sub(lambda m: unicodedata.normalize("NFC", m[0].translate(t.fold)), text)


def _thai_am(text: str) -> str:
    """The Thai and Lao vowel AM as one character."""
    return text.replace("\u0e4d\u0e32", "\u0e33").replace("\u0ecd\u0eb2", "\u0eb3")


@lru_cache(maxsize=1 << 16)
def _skeleton(word: str) -> tuple[str, str]:
    """The word with look-alikes as Latin letters, decomposed; the script of its letters that have no double, '' if there are none or as many of two."""
    bones = unicodedata.normalize("NFD", word).translate(_SKELETON)
    n = {"L": 0, "C": 0, "G": 0}
    for ch in bones:
        if ch not in _AMBIGUOUS and ch.isalpha():
            n["L" if ch < "Ͱ" or ch > "᷿" and ch < "ἀ" else "C" if "Ѐ" <= ch <= "ԯ" else "G"] += 1
    most = max(n.values())
    own = [s for s, k in n.items() if k == most]
    return bones, own[0] if most and len(own) == 1 else ""


@lru_cache(maxsize=1 << 16)
def _worded(bones: str, script: str) -> str:
    return unicodedata.normalize("NFC", "".join(_DOUBLES[script].get(ch, ch) for ch in bones))


def _contexts(text: str, words: list[re.Match[str]], known: list[tuple[str, str]]) -> list[str]:
    """The script of each word: its own, else the nearest earlier one of its sentence, else the nearest later one of it, else the one before it."""
    own = [s for _, s in known]
    begins = [i == 0 or bool(_PAUSE.search(text, words[i - 1].end(), w.start())) for i, w in enumerate(words)]
    out, before, inside = list(own), next((s for s in own if s), "L"), ""
    for i, s in enumerate(own):
        inside = "" if begins[i] else inside
        if s:
            before = inside = s
        elif inside:
            out[i] = inside
        else:
            later = next((own[j] for j in range(i + 1, len(own)) if own[j] or begins[j]), "")
            out[i] = later or before
    return out


def _one_script(text: str) -> str:
    there = [s for s, p in _HAS.items() if p.search(text)]
    if not there:
        return text
    words = list(_WORD.finditer(text))
    if len(there) == 1 and any(_skeleton(w[0])[1] for w in words):
        return text
    known = [_skeleton(w[0]) for w in words]
    out, at = [], 0
    for w, (bones, _), script in zip(words, known, _contexts(text, words, known), strict=True):
        form = _worded(bones, script)
        if form != w[0]:
            out += [text[at : w.start()], form]
            at = w.end()
    return "".join([*out, text[at:]]) if out else text


def shared_shapes(text: str) -> bool:
    """Whether every letter of a text in normal form has a double of its shape in another script, accents aside."""
    return all(unicodedata.normalize("NFD", ch)[0] in _SHARED for ch in text if ch.isalpha())


def is_stable(text: str) -> bool:
    """Quick check: whether normalising the text, or a part of it, changes no character by itself."""
    if text.isascii():
        return bool(_PLAIN_ASCII.match(text))
    return "\u0e4d" not in text and "\u0ecd" not in text and _quick_check(text)


def scripts_of(text: str) -> int:
    """How many of the scripts with letters of the same shape the text has."""
    return 1 if text.isascii() else sum(bool(p.search(text)) for p in _HAS.values())


def normal_form(text: str | None, stable: bool = False) -> str:
    """The form in which texts that look the same are equal; NULL gives the empty text. Applying it again changes nothing.

    `stable`: the text is known to be so (is_stable), and only its look-alike letters are looked at.
    """
    if not text or _PLAIN_ASCII.match(text):
        return text or ""
    return _one_script(text if stable else _thai_am(_stable_segments(text)))
