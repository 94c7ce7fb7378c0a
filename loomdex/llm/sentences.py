"""Splitting a document into sentences, by evidence from the document itself with the corpus as fallback.

A full stop after a word is ambiguous. Words whose full stop is followed by small letters, digits or commas elsewhere, and words that hardly
ever end a paragraph, are abbreviations; a capital letter after one begins a sentence only if the word it begins stands elsewhere in small letters, so isn't a proper
name: in the document, or in the corpus where the document is silent. A full stop after a number ends nothing before words that follow numbers far
more often than other full stops. There is no list of abbreviations, titles or months. Marks of scripts without that ambiguity end sentences wherever
they stand outside quotations and brackets.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Set
from functools import lru_cache
from math import exp, lgamma, log, log1p

# Marks that end sentences, marks that close and open quotations and brackets, and their pairs.
_ENDS = ".!?…。！？｡؟۔।॥;;"
_STRONG = frozenset("。！？｡؟۔।॥")
_PAIRS = {"“": "”", "„": "“”", "«": "»", "‹": "›", "(": ")", "[": "]", "（": "）", "「": "」", "『": "』", "【": "】", "〈": "〉", "《": "》", "‘": "’"}
_OPENERS = "“„«‹\"([（「『【¿¡‘'"
_DASHES = "—–-―"
#: Least probability of so few paragraph ends, and the share of the usual ones from which a word's are few and are as usual.
CHANCE, FEW, USUAL = 0.001, 0.1, 0.5
#: Least probability that a word stands after numbers so often; names, many of which are rare, are tested along with months.
CHANCE_NUMBER = 1e-5

_END = re.compile(f"[{re.escape(_ENDS)}]+")
_QUOTES = re.compile('["“”„«»‹›()\\[\\]（）「」『』【】〈〉《》‘]')
_CLOSERS = re.compile("(?:[   ]?[»›]|[\"”’')\\]）」』】〉》“])*")
_GLUED = re.compile(r"\A.*[^\W\d_]{3}\.(?=[^\W\d_])")
_ITEM = re.compile(r"[ \t]*(?:([-*•·–—▪◦●○‣])|\(?(\d{1,3})[.)])[ \t]+(\S)")
_BLANK = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")
_THAI = re.compile("(?<=[ก-ๅ็-๎])\\s+(?=[ก-๎])")
#: A blank after Thai before three or more words of another script, which are no name within a statement.
_THAI_OUT = re.compile("(?<=[ก-ๅ็-๎])\\s+(?=[\"«“„¿¡]?[A-Za-zÀ-ɏͰ-ϿЀ-ӿ][^\\s฀-๿]*(?:\\s+[^\\s฀-๿]+){2})")
_THAI_TAIL, _THAI_HEAD = re.compile(r"[^฀-๿]+\Z"), re.compile(r"[^฀-๿]+")
_THAI_ANY = re.compile("[฀-๿]")
_WORDS = re.compile(r"[^\W\d_]+")
#: Words within a sentence, where a capital marks a name, and words after a full stop.
_MID = re.compile(r" (?<=[\w,] )([^\W\d_]+)")
_AFTER_STOP = re.compile(rf"\.(?<=[^\W_]\.)\s+[{re.escape(_OPENERS)}]*([^\W\d_]+)")
_AFTER_NUMBER = re.compile(r"(?<=\S[ \u00a0])\d{1,2}\.\s+([^\W\d_]+)")
#: What a word before a full stop doesn't hold, besides blanks.
_EDGES = "\"“”„«»‹›([（「『!?…。！？"
#: A run of characters up to its last full stop after a letter or digit, and what follows it. It begins only where a word does, so long runs are read once.
_STOPPED = re.compile(rf"(?<![^\s{re.escape(_EDGES)}])([^\s{re.escape(_EDGES)}]+)(?<=[^\W_])\.(?=(\s*)(\S?))")
_EDGE = frozenset(_EDGES)
#: A word after a full stop, and the end of a word or comma with a blank, after which a sentence goes on.
_NEXT, _WITHIN = re.compile(rf"\.\s*[{re.escape(_OPENERS)}]*([^\W\d_]+)"), re.compile(r"[\w,;:] \Z")
#: Characters looked at before a full stop for rules on short words; known words are found at any length.
_REACH = 64
_TERMINAL = re.compile(f"[{re.escape(_ENDS)}:：][\\s\"”’»›)\\]）」』】“]*\\Z")


def _mode(text: str) -> str:
    """'lower' or 'upper' for a text in one letter case, 'mixed' for others, also those without case."""
    low, up = text.upper() != text, text.lower() != text
    return "lower" if low and not up else "upper" if up and not low else "mixed"


def _key(token: str) -> str:
    return token.lower().strip("-–—,")


def full_stops(text: str) -> Iterable[tuple[str, str]]:
    """(word, what follows its full stop) in texts with both cases: 'l' what can't begin a sentence, 'u' what may, 'p' the paragraph's end."""
    if _mode(text) != "mixed":
        return
    for token, gap, after in _STOPPED.findall(text):
        key = _key(token)
        if not key or key.isdigit():
            continue
        if not after or "\n\n" in gap:
            yield key, "p"
        elif not gap:
            if after in ",;:":
                yield key, "l"
        else:
            yield key, "l" if after.islower() or after.isdigit() or after in ",;:" else "u"


def asked_words(text: str) -> set[str]:
    """Every word that splitting the text may ask the corpus for: those before full stops and those after them."""
    out = {m.lower() for m in _NEXT.findall(text)}
    at = text.find(".")
    while at >= 0:
        token = _token(text, 0, at, _REACH)
        out.update((_key(token), _key(_GLUED.sub("", token))))
        at = text.find(".", at + 1)
    return out | {_key(token) for token, _, _ in _STOPPED.findall(text)}


def _token(text: str, a: int, s: int, reach: int) -> str:
    """The word that ends at s, at most `reach` characters of it."""
    low = max(a, s - reach)
    at = s
    while at > low and text[at - 1] not in _EDGE and not text[at - 1].isspace():
        at -= 1
    return text[at:s]


def word_forms(texts: Iterable[str]) -> dict[str, tuple[int, int, int, int]]:
    """How often words of texts with both cases stand in small letters and with a capital within a sentence, with a capital after a full stop, and
    so after that of a number of one or two digits."""
    mid: Counter[str] = Counter()
    after: Counter[str] = Counter()
    number: Counter[str] = Counter()
    for text in texts:
        if _mode(text) == "mixed":
            mid.update(_MID.findall(text))
            after.update(_AFTER_STOP.findall(text))
            number.update(_AFTER_NUMBER.findall(text))
    out: dict[str, list[int]] = {}
    for found, at in ((mid, 1), (after, 2), (number, 3)):
        for word, n in found.items():
            small = word.islower()
            if not small or at == 1:
                out.setdefault(word.lower(), [0, 0, 0, 0])[0 if small else at] += n
    return {w: (a, b, c, d) for w, (a, b, c, d) in out.items()}


def after_numbers(counts: Iterable[tuple[str, int, int]], usual: float) -> Iterable[str]:
    """From (word, times after full stops, of these after a number's): words before which a number's full stop ends nothing, such as months.

    `usual`: the share of numbers' full stops before all words. A word that stands after a number at least every other time, where
    so many times have a probability below CHANCE_NUMBER, is one.
    """
    return (w for w, n, d in counts if d and 2 * d >= n and d > n * usual and _tail(d, n, usual) < CHANCE_NUMBER)


def abbreviations(counts: Iterable[tuple[str, int, int, int]], at_end: float) -> dict[str, str]:
    """From corpus counts (word, l, u, p): words whose full stop doesn't end a sentence ('n'), and short words whose does ('f').

    `at_end`: the share of paragraph ends among all full stops that may end a sentence. A word that comes before capitals often, and ends
    paragraphs at a tenth of that rate at most and so seldom as has a probability below one in a thousand, is an abbreviation. A word that ends
    them at half that rate or more isn't. Both are rates, so a few stray ends decide nothing in a large corpus.
    """
    out = {}
    for word, low, up, end in counts:
        n, usual = low + up + end, at_end * (up + end)
        if low >= 3 and low >= 0.5 * n:
            out[word] = "n"
        elif up and end <= FEW * usual and _at_most(end, up + end, at_end) < CHANCE:
            out[word] = "n"
        elif n >= 5 and end and end >= USUAL * usual:
            out[word] = "f"
    return out


def _at_most(k: int, n: int, p: float) -> float:
    """Probability of at most k hits in n trials at chance p, for k below n * p."""
    if not 0 < p < 1:
        return float(p <= 0)
    term = lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * log(p) + (n - k) * log1p(-p)
    total, last = 0.0, exp(term)
    while k >= 0 and last > total * 1e-12:
        total += last
        last *= k * (1 - p) / ((n - k + 1) * p)
        k -= 1
    return total


def _tail(k: int, n: int, p: float) -> float:
    """Probability of at least k hits in n trials at chance p, for k above n * p."""
    if not 0 < p < 1:
        return float(p >= 1)
    total, last = 0.0, exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * log(p) + (n - k) * log1p(-p))
    while k <= n and last > total * 1e-12:
        total += last
        last *= (n - k) * p / ((k + 1) * (1 - p))
        k += 1
    return total


class Splitter:
    """Splits texts, given what the corpus says about abbreviations, the words that it has mostly in small letters, and those after numbers."""

    def __init__(self, corpus: dict[str, str] | None = None, common: Set[str] = frozenset(), numbered: Set[str] = frozenset()):
        self.corpus, self.common, self.numbered = corpus or {}, common, numbered
        self.reach = max(map(len, self.corpus), default=0) + 1

    def split(self, text: str | None) -> list[tuple[int, int]]:
        """(start, end) of each sentence, in code points; together they hold every non-blank character. None for NULL or blank texts."""
        if not text or not text.strip():
            return []
        mode = _mode(text)
        doc = self._own(text) if mode == "mixed" and "." in text else {}
        self.far = max(_REACH, self.reach, max(map(len, doc), default=0) + 1)
        small = None
        out: list[tuple[int, int]] = []
        for a, b in self._units(text, mode):
            if text[a : a + 1] == "\0":
                continue
            cuts, small = self._cuts(text, a, b, mode, doc, small)
            for c, d in zip([a, *cuts], [*cuts, b], strict=True):
                piece = text[c:d]
                if kept := piece.strip():
                    start = c + len(piece) - len(piece.lstrip())
                    out.append((start, start + len(kept)))
        return out

    def _own(self, text: str) -> dict[str, str]:
        """What the document itself says: a word seen before small letters and never at a paragraph's end doesn't end sentences."""
        seen: dict[str, Counter[str]] = {}
        for word, kind in full_stops(text):
            seen.setdefault(word, Counter())[kind] += 1
        return {w: "n" for w, n in seen.items() if n["l"] and not n["p"] and n["l"] >= n["u"]}

    def _units(self, text: str, mode: str) -> Iterable[tuple[int, int]]:
        """Stretches that no sentence crosses: items, headings, lines of notes, and paragraphs of prose."""
        at = 0
        for gap in [*_BLANK.finditer(text), None]:
            end = gap.start() if gap else len(text)
            if text[at:end].strip():
                if "\n" in text[at:end].strip("\n") or _ITEM.match(text, at):
                    yield from self._lines(text, at, end, mode)
                else:
                    yield at, end
            at = gap.end() if gap else end

    def _lines(self, text: str, a: int, b: int, mode: str) -> Iterable[tuple[int, int]]:
        lines, at = [], a
        for line in text[a:b].split("\n"):
            if line.strip():
                lines.append((at, at + len(line)))
            at += len(line) + 1
        run: list[tuple[int, int]] = []
        number = 1
        for i, (c, d) in enumerate(lines):
            m = _ITEM.match(text, c, d)
            item = False
            if m and m[2]:
                item = int(m[2]) == number
                number += item
            elif m:
                last = text[lines[-1][0] : lines[-1][1]]
                item = not m[3].islower() if mode == "mixed" else not _TERMINAL.search(last) or i == 0
            if item:
                yield from self._prose(text, run, mode)
                run = []
                yield c, d
            else:
                run.append((c, d))
        yield from self._prose(text, run, mode)

    def _prose(self, text: str, run: list[tuple[int, int]], mode: str) -> Iterable[tuple[int, int]]:
        """Joins the lines of hard-wrapped prose; other lines without end punctuation are units of their own."""
        if not run:
            return
        widest = max(d - c for c, d in run)
        prose = bool(_TERMINAL.search(text[run[-1][0] : run[-1][1]]))
        start, (_, before) = run[0][0], run[0]
        for (c, d), (e, f) in zip(run, run[1:], strict=False):
            line, after = text[c:d].rstrip(), text[e:f].lstrip()
            small = mode == "mixed" and after[0].islower()
            if prose:
                soft = bool(_TERMINAL.search(line)) or small or len(line) + 1 + len(after.split(None, 1)[0]) > widest
            else:
                soft = small or bool(_TERMINAL.search(line)) or self._thai_name(line, after)
            if not soft:
                yield start, before
                start = e
            before = f
        yield start, before

    def _thai_name(self, line: str, after: str) -> bool:
        """Whether a line break stands between Thai and a name or number, which belong together."""
        if not (_THAI_ANY.search(line) and _THAI_ANY.search(after)):
            return False
        tail, head = _THAI_TAIL.search(line), _THAI_HEAD.match(after)
        beside = tail or head
        return bool(beside) and not (tail and head) and len(beside[0].split()) <= 2

    def _matched(self, text: str, a: int, b: int) -> list[tuple[int, int]]:
        """Outermost matched quotations and brackets, as (opening, closing) places."""
        stack: list[tuple[str, int]] = []
        pairs: list[tuple[int, int]] = []
        for m in _QUOTES.finditer(text, a, b):
            ch, i = m[0], m.start()
            if ch == '"':
                k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == '"'), -1)
            else:
                k = next((k for k in range(len(stack) - 1, -1, -1) if ch in _PAIRS.get(stack[k][0], "")), -1)
            if k >= 0:
                pairs.append((stack[k][1], i))
                del stack[k:]
            elif ch == '"' or ch in _PAIRS:
                if ch != "‘":
                    stack.append((ch, i))
        pairs.sort()
        outer: list[tuple[int, int]] = []
        for p in pairs:
            if not outer or p[0] > outer[-1][1]:
                outer.append(p)
        return outer

    def _cuts(self, text: str, a: int, b: int, mode: str, doc: dict[str, str], small: dict[str, int] | None) -> tuple[list[int], dict[str, int] | None]:
        """Places in text[a:b] where a new sentence begins."""
        item = _ITEM.match(text, a, b)
        if item and not _TERMINAL.search(text[a:b].rstrip()):
            return [], small  # an item is one unit
        begin = item.start(3) if item else a
        pairs = self._matched(text, a, b)
        ends = [(m.start(), m.end()) for m in _END.finditer(text, begin, b)]
        cuts: list[int] = []
        k = 0
        done = a
        for s, e in ends:
            if s < done:
                continue
            while k < len(pairs) and pairs[k][1] < s:
                k += 1
            if k < len(pairs) and pairs[k][0] < s:  # within a quotation: only its very end counts
                close = pairs[k][1]
                if text[e:close].strip("   \"”’»)') ") or e > close:
                    continue
                done = close + 1
                at = _CLOSERS.match(text, done, b).end() if text[done : done + 1] in "\"”’»)）」』" else done
                if self._after_quote(text, at, b, mode, text[s - 1 : s]):
                    cuts.append(at)
                continue
            at = _CLOSERS.match(text, e, b).end() if e < b and not (k < len(pairs) and pairs[k][0] <= e + 1) else e
            yes, small = self._ends_here(text, a, s, e, at, b, mode, doc, small)
            if yes:
                cuts.append(at)
        if _THAI_ANY.search(text, a, b):
            cuts = sorted({*cuts, *self._thai(text, a, b, pairs)})
        return cuts, small

    def _thai(self, text: str, a: int, b: int, pairs: list[tuple[int, int]]) -> list[int]:
        """Spaces between Thai letters part statements, but not the words of a list that ends with the sign for "and so on"."""
        found = sorted({m.end() for p in (_THAI, _THAI_OUT) for m in p.finditer(text, a, b)})
        cuts = [c for c in found if not any(p < c - 1 < q for p, q in pairs)]
        kept: list[int] = []
        for cut in cuts:
            if text.startswith("ฯลฯ", cut):
                edge = cut
                while kept and len(text[kept[-1] : edge].strip()) <= 8:
                    edge = kept.pop()
            else:
                kept.append(cut)
        return kept

    def _after_quote(self, text: str, at: int, b: int, mode: str, inner: str) -> bool:
        """Whether a sentence ends with a quotation whose last mark ends one: only before a capital in a text with both cases."""
        rest = text[at:b].lstrip()
        if not rest:
            return False
        if mode != "mixed" or at < b and not text[at].isspace():
            return False
        first = rest.lstrip(_OPENERS)[:1]
        cased = inner.upper() != inner.lower() or any(ch.upper() != ch.lower() for ch in text[max(0, at - 12) : at])
        return cased and first.isupper()

    def _ends_here(self, text: str, a: int, s: int, e: int, at: int, b: int, mode: str, doc: dict[str, str], small: dict[str, int] | None) -> tuple[bool, dict[str, int] | None]:
        marks = text[s:e]
        rest = text[at:b]
        after = rest.lstrip()
        if not after:
            return False, small
        gap = len(after) < len(rest)
        before = text[s - 1] if s > a else " "
        if ";" in marks or ";" in marks:
            if not ("Ͱ" <= before <= "Ͽ" or "ἀ" <= before <= "῿"):
                marks = marks.replace(";", "")
                if not marks:
                    return False, small
        first = after[0]
        if first in _DASHES:
            first = after.lstrip(_DASHES + "  ")[:1] or first
            if mode != "mixed" or not first.isupper():
                return False, small
        elif first in ",;:，、；：،)":
            return False, small
        lead = after.lstrip(_OPENERS + " ")[:1] or first
        if marks.strip("….") == "" and (len(marks) > 1 or "…" in marks):  # an ellipsis
            return gap and mode == "mixed" and lead.isupper(), small
        if any(ch in _STRONG for ch in marks):
            return not (mode == "mixed" and lead.islower() and gap and before.isascii()), small
        if marks[-1] in "!?;;" or "!" in marks or "?" in marks:
            if mode == "mixed" and lead.islower():
                return False, small
            return gap or lead.isupper() or before.isspace() or lead.isalpha(), small
        # one full stop
        word = _token(text, a, s, self.far)
        if len(word) > 3 and gap and word.isalpha() and doc.get(low := word.lower(), self.corpus.get(low)) != "n":
            return not (mode == "mixed" and lead.islower()), small  # the usual case
        if "." in word:
            word = _GLUED.sub("", word)
        key = _key(word)
        if not gap:
            nxt = _WORDS.match(after)
            kind = self._kind(key, doc)
            if not nxt or kind == "n" or not (kind == "f" or word[-1:].isdigit() or (len(word) >= 3 and word.isalpha())):
                return False, small
            if mode == "mixed":
                return lead.isupper() and (not word[-1:].isdigit() or len(nxt[0]) > 1) or (lead.upper() == lead.lower() and len(nxt[0]) >= 2), small
            return len(nxt[0]) >= 3, small
        if mode == "mixed" and lead.islower():
            return False, small
        if word.isdigit():
            nxt = _WORDS.match(after)
            return not (len(word) <= 2 and nxt and nxt[0].lower() in self.numbered), small
        letters = re.sub(r"[\W\d_]", "", word)
        kind = self._kind(key, doc)
        if letters and len(letters) <= 3 and all(len(re.sub(r"\W", "", p)) <= 1 for p in re.split(r"[.\-‐]+", word)):
            if mode == "mixed" and (letters.isupper() or letters.upper() == letters.lower()):
                return False, small  # initials, also in scripts without case
            if mode != "mixed" and kind != "f":
                return False, small
        if kind != "n":
            return True, small
        if mode != "mixed" or lead.isdigit() or word[:1].isupper() and _WITHIN.search(text, a, s - len(word)):
            return False, small  # a capital within the sentence: a title, before a name
        # an abbreviation before a capital: a new sentence only if the word that follows is known in small letters
        rest = after.lstrip(_OPENERS)
        nxt = _WORDS.match(rest)
        if not nxt or len(nxt[0]) == 1 or rest.startswith(".", nxt.end()) and self._kind(nxt[0].lower(), doc) == "n":
            return False, small
        low = nxt[0].lower()
        if low not in self.common and low not in text:
            return False, small
        if small is None:
            small = Counter(w for w in _WORDS.findall(text) if w.islower())
            small.subtract(w.lower() for w in _MID.findall(text) if not w.islower())
        known = small.get(low, 0)
        return known > 0 or known == 0 and low in self.common, small

    def _kind(self, key: str, doc: dict[str, str]) -> str:
        """What the document says of a word, else the corpus; empty if neither knows it."""
        return doc.get(key) or self.corpus.get(key, "")


@lru_cache(maxsize=1)
def splitter() -> Splitter:
    """The splitter without a corpus."""
    return Splitter()
