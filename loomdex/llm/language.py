"""Languages of a document by mixture inference over n-gram likelihoods.

`fit` makes a character n-gram model per language; `LanguageModel.scores` gives each unit of text (a title, a sentence) one log-likelihood per
language. `mixture` then estimates a document's language proportions by expectation-maximisation and picks the set of languages by penalised
likelihood: a language joins as long as the gain in log-likelihood exceeds a penalty that grows with the number of units.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa

from loomdex.llm.normal import shared_shapes

#: Longest n-gram; log of the least share that a word gives any language, if it is known from training and if not.
ORDER, KNOWN_FLOOR, UNKNOWN_FLOOR = 4, -7.0, -2.5
#: What a unit of two letters or more says at least against a language of other scripts, enough to pay for a further one in a document of 10 million units.
OTHER_SCRIPT = -45.0
#: Share of a script's training words from which a language is written in it.
OWN_SCRIPT = 0.02
#: Characters that the base distribution spreads over.
ALPHABET = 4096
#: What a further language must gain: a constant and a share per log of the number of units.
PENALTY, PENALTY_UNITS = 6.0, 1.0
#: Words that a process remembers the scores of.
REMEMBERED = 200_000

_RUN = re.compile(r"(?:[^\W\d_]+[̀-ͯ؀-ۿऀ-ॿ฀-๿’']*)+")
_DENSE = re.compile("[฀-๿぀-ヿ㐀-鿿ｦ-ﾟ々ー]+")
_BEYOND_LATIN = re.compile("[Ͱ-\U0010ffff]")


@lru_cache(maxsize=1 << 14)
def _script(ch: str) -> str:
    if ch < "Ͱ" or "Ḁ" <= ch <= "ỿ":
        return "latin"
    if ch <= "Ͽ" or "ἀ" <= ch <= "῿":
        return "greek"
    if ch <= "ԯ":
        return "cyrillic"
    if "฀" <= ch <= "๿":
        return "thai"
    if "぀" <= ch <= "鿿" or "ｦ" <= ch <= "ﾟ":
        return "east"
    return "indic" if "ऀ" <= ch <= "෿" else "arabic" if ch <= "ۿ" else "other"


def words(text: str) -> list[str]:
    """Lower-cased words of the text's main script; scripts without spaces give overlapping pairs of characters.

    Words of another script are names or loan words and are left out. Latin is the main script beside another one only with three words or
    more and half as many letters again as the other.
    """
    return main_words(text)[0]


def main_words(text: str) -> tuple[list[str], bool]:
    """The words of a text's main script, and whether the text is in that script as a whole: no other script occurs, or Latin is the main
    one, and not all letters have doubles in another script."""
    found, single, main = script_words(text)
    return found, bool(found) and (single or main == "latin") and (main in ("thai", "east") or not shared_shapes(text))


def script_words(text: str) -> tuple[list[str], bool, str]:
    """The words of a text's main script, whether no other script occurs, and which it is ('' for a text without words)."""
    text = text.lower()
    runs = _RUN.findall(text)
    beyond = _BEYOND_LATIN.search(text)
    if beyond and _DENSE.search(text):
        runs = [part for run in runs for part in _parts(run)]
    if not runs:
        return [], True, ""
    scripts = {"latin"} if not beyond else {_script(ch) for ch in {run[0] for run in runs}}
    if len(scripts) == 1:
        main, own = next(iter(scripts)), runs
    else:
        found: dict[str, list[str]] = {}
        for run in runs:
            found.setdefault(_script(run[0]), []).append(run)
        main = "latin"
        size = {k: sum(map(len, v)) for k, v in found.items()}
        latin = size.pop("latin", 0)
        if not (len(found.get("latin", ())) >= 3 and latin > 1.5 * sum(size.values())):
            main = max(size, key=size.__getitem__)
        own = found[main]
    if main in ("thai", "east"):
        return [part[i : i + 2] for part in own for i in range(max(1, len(part) - 1))], len(scripts) == 1, main
    return [w.strip("’'") for w in own] if "’" in text or "'" in text else own, len(scripts) == 1, main


def _parts(run: str) -> Iterable[str]:
    """A run of letters, parted where a script without spaces begins or ends."""
    at = 0
    for m in _DENSE.finditer(run):
        if m.start() > at:
            yield run[at : m.start()]
        yield m[0]
        at = m.end()
    if at < len(run):
        yield run[at:]


class LanguageModel:
    """Log-likelihoods of words in each language."""

    def __init__(self, langs: list[str], grams: dict[str, np.ndarray], known: frozenset[str], scripts: dict[str, np.ndarray]):
        self.langs, self.grams, self.known, self.scripts = langs, grams, known, scripts
        self.memory: dict[str, int] = {}
        self.rows = np.zeros((1024, len(langs)))
        self.script_at = {script: i for i, script in enumerate(scripts, 1)}
        self.uses = np.array([np.ones(len(langs), bool), *scripts.values()])  # any other script excludes no language

    def __getstate__(self):
        return self.langs, self.grams, self.known, self.scripts

    def __setstate__(self, state):
        self.__init__(*state)

    def word(self, word: str) -> np.ndarray:
        """Log-likelihood of a word relative to its best language, bounded from below, so that no word alone settles a unit."""
        total = np.zeros(len(self.langs))
        padded = f" {word} "
        for i in range(1, len(padded)):
            for k in range(min(ORDER, i + 1), 0, -1):
                v = self.grams.get(padded[i + 1 - k : i + 1])
                if v is not None:
                    total += v
                    break
        total -= total.max()
        return np.logaddexp(total, KNOWN_FLOOR if word in self.known else UNKNOWN_FLOOR)

    def written(self, word: str) -> np.ndarray:
        """For each language, whether it is written in the word's script."""
        return self.uses[self.script_at.get(_script(word[0]), 0) if word else 0]

    def _row(self, word: str) -> int:
        """Where the word's scores are remembered."""
        at = self.memory.get(word)
        if at is None:
            at = self.memory[word] = len(self.memory)
            if at == len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[at] = self.word(word)
        return at

    def scores(self, units: list[list[str]], whole: list[bool] | None = None) -> np.ndarray:
        """One row of log-likelihoods per unit; zeros for a unit without words.

        In a unit that is of one script as a whole (all are, if not told), a language of other scripts has OTHER_SCRIPT at most.
        """
        if len(self.memory) >= REMEMBERED:
            self.memory.clear()
        k = len(self.langs)
        out = np.zeros((len(units), k))
        # each distinct word is looked up once
        coded = pa.array(chain.from_iterable(units), pa.string()).dictionary_encode()
        at = np.array([self._row(w) for w in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else ()
        if len(at):
            sizes = np.array([len(u) for u in units])
            full = np.flatnonzero(sizes)
            sums = np.add.reduceat(self.rows[at], (np.cumsum(sizes) - sizes)[full], axis=0)
            one = np.ones(len(full), bool) if whole is None else np.array(whole)[full]
            heads = [units[i][0] for i in full]
            used = self.uses[[self.script_at.get(_script(h[0]), 0) if h else 0 for h in heads]]
            letters = (sizes[full] > 1) | np.fromiter((len(h) > 1 for h in heads), bool, len(heads))
            least = np.where(letters, OTHER_SCRIPT, 0.0)[:, None]
            out[full] = np.where(one[:, None] & ~used, np.minimum(sums, least), sums)
        return out


def fit(samples: Iterable[tuple[str, str]], langs: list[str]) -> LanguageModel:
    """From (language, text): interpolated (Witten-Bell) character n-gram probabilities of every n-gram seen in any language."""
    counts = [defaultdict(int) for _ in langs]
    kinds = [defaultdict(set) for _ in langs]
    at = {x: i for i, x in enumerate(langs)}
    known: set[str] = set()
    written: dict[str, np.ndarray] = {}
    for lang, text in samples:
        if lang not in at:
            continue
        count, kind = counts[at[lang]], kinds[at[lang]]
        for word in words(text):
            known.add(word)
            if word:
                written.setdefault(_script(word[0]), np.zeros(len(langs)))[at[lang]] += 1
            padded = f" {word} "
            for i in range(1, len(padded)):
                for k in range(1, min(ORDER, i + 1) + 1):
                    gram = padded[i + 1 - k : i + 1]
                    count[gram] += 1
                    kind[gram[:-1]].add(gram[-1])
    sums = []
    for count in counts:
        total: dict[str, int] = defaultdict(int)
        for gram, n in count.items():
            total[gram[:-1]] += n
        sums.append(total)
    grams: dict[str, np.ndarray] = {}
    p: dict[str, np.ndarray] = {}
    for gram in sorted({g for c in counts for g in c}, key=len):
        lower = p[gram[1:]] if len(gram) > 1 else np.full(len(langs), 1 / ALPHABET)
        own = np.empty(len(langs))
        for i in range(len(langs)):
            n, t = sums[i].get(gram[:-1], 0), len(kinds[i].get(gram[:-1], ()))
            own[i] = (counts[i].get(gram, 0) + max(t, 1) * lower[i]) / (n + max(t, 1))
        p[gram] = own
        grams[gram] = np.log(own).astype(np.float32)
    least = OWN_SCRIPT * sum(written.values())
    scripts = {k: (n > 0) & (n >= least) for k, n in written.items()}
    return LanguageModel(langs, grams, frozenset(known), {k: own for k, own in scripts.items() if own.any()})


def proportions(scores: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Expectation-maximisation over units: the languages' shares, and the log-likelihood they reach."""
    n, k = scores.shape
    share = np.full(k, 1 / k)
    top = scores.max(axis=1, keepdims=True)
    like = np.exp(scores - top)
    before = -np.inf
    for _ in range(rounds):
        joint = like * share
        total = joint.sum(axis=1)
        now = float(np.log(total).sum())
        share = (joint / total[:, None]).mean(axis=0) + 1e-9
        share /= share.sum()
        if now - before < 1e-4:
            break
        before = now
    return share, now + float(top.sum())


def price(units):
    """What a further language must gain in a document of so many units."""
    return PENALTY + PENALTY_UNITS * np.log(1 + units)


def mixture(scores: np.ndarray) -> tuple[list[int], np.ndarray]:
    """The document's set of languages, largest gain first, and its shares; units without evidence should be left out."""
    totals = scores.sum(axis=0)
    chosen = [int(totals.argmax())]
    best, shares = float(totals[chosen[0]]), np.ones(1)
    cost = price(len(scores))
    bound = float(scores.max(axis=1).sum())  # no mixture gets above
    while len(chosen) < scores.shape[1] and bound - best > cost:
        most = np.maximum(scores, scores[:, chosen].max(axis=1, keepdims=True)).sum(axis=0)  # no mixture with the further language gets above
        gains = [(int(i), float(most[i])) for i in np.argsort(-most) if i not in chosen and most[i] - best > cost]
        step = None
        for i, above in gains:
            if step is not None and above <= step[0][1]:
                break  # neither this nor a later one gets above what is found
            tried = proportions(scores[:, [*chosen, i]])
            if step is None or tried[1] > step[0][1]:
                step = tried, i
        if step is None or step[0][1] - best <= cost:
            break
        (shares, best), i = step
        chosen.append(i)
    return chosen, shares
