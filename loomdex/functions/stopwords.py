"""Stop words and the choice of them by language."""

from __future__ import annotations

# The stop words that results depend on.
RUSSIAN = """
и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по только её мне было вот от меня еще нет о из ему теперь когда
уже вам ни быть был им до если или ней для была были этот эта эти это который которая которые которое свой своя свои своё чтобы при между чем
над под после
""".split()

ENGLISH = """
a an the and or but in on at to for of with by from as is was are were been be have has had do does did will would could should may might must
shall can need dare ought used it its this that these those i you he she we they what which who whom when where why how all each every both few
more most other some such no nor not only own same so than too very just also now here there then once if about
""".split()


def stop_words(language: str) -> frozenset[str]:
    """Those of 'russian' or 'english'; of both for any other language."""
    return frozenset({"russian": RUSSIAN, "english": ENGLISH}.get(language, RUSSIAN + ENGLISH))


def is_stop_word(word: str, language: str = "mixed") -> bool:
    return word.lower() in stop_words(language)
