"""Hangul by its letters (jamo): final consonants, and a transducer that reads a text from its end and turns verb forms into nouns."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Letters as they are written alone, and as the final consonants of a syllable.
FINALS = {"ㄴ": "ᆫ", "ㄹ": "ᆯ", "ㅁ": "ᆷ", "ㅂ": "ᆸ"}


def letters(text: str) -> str:
    """A text with its syllables taken apart; a consonant that stands alone is a final one."""
    return unicodedata.normalize("NFD", "".join(FINALS.get(ch, ch) for ch in text))


def whole(text: str) -> str:
    return unicodedata.normalize("NFC", text)


def _is_final(letter: str) -> bool:
    return "ᆨ" <= letter <= "ᇂ"


def _is_vowel(letter: str) -> bool:
    return "ᅡ" <= letter <= "ᅵ"


def has_final_consonant(word: str) -> bool:
    """Whether the last Hangul syllable of a text, whatever stands behind it, ends in a consonant; false if there is none."""
    for ch in reversed(word or ""):
        if "가" <= ch <= "힣":
            return _is_final(unicodedata.normalize("NFD", ch)[-1])
    return False


@dataclass
class Endings:
    """A transducer over the letters of a text from last to first.

    ``rules`` are (ending, what takes its place, what it stands behind): behind a
    ``closed`` syllable (final consonant), an ``open`` one, or either (empty). The
    longest ending that fits is replaced, if something is left before it. Where
    no Hangul stands before an ending, both kinds fit.
    """

    rules: tuple[tuple[str, str, str], ...]
    arcs: list[dict[str, int]] = field(default_factory=lambda: [{}])
    puts: list[tuple[str, str, str] | None] = field(default_factory=lambda: [None])

    def __post_init__(self):
        for ending, put, behind in self.rules:
            at = 0
            for letter in reversed(letters(ending)):
                if letter not in self.arcs[at]:
                    self.arcs[at][letter] = len(self.arcs)
                    self.arcs.append({})
                    self.puts.append(None)
                at = self.arcs[at][letter]
            self.puts[at] = (ending, letters(put), behind)

    def apply(self, text: str) -> tuple[str, str | None]:
        """(text with its ending replaced, the ending that was found or null)."""
        read, at, best = letters(text), 0, None
        for i in range(len(read) - 1, 0, -1):
            at = self.arcs[at].get(read[i], -1)
            if at < 0:
                break
            found = self.puts[at]
            if found and read[:i].strip() and self._fits(read[i - 1], found[2]):
                best = (i, found)
        if best is None:
            return text, None
        i, (ending, put, _) = best
        return whole(read[:i] + put), ending

    @staticmethod
    def _fits(before: str, behind: str) -> bool:
        if behind == "closed":
            return not _is_vowel(before)
        return behind != "open" or not _is_final(before)


# Adnominal and purpose endings, verbs in 하다 and 되다 first, and what is left of them as nouns.
ADNOMINAL = Endings((
    ("하는", "", ""), ("하ㄴ", "", ""), ("하ㄹ", "", ""), ("하던", "", ""), ("하려는", "", ""), ("하고자 하는", "", ""), ("하ㄹ 수 있는", "", ""), ("하기 위한", "", ""),
    ("되는", "", ""), ("되ㄴ", "", ""), ("되ㄹ", "", ""), ("되ㄹ 수 있는", "", ""),
    ("는", "기", ""), ("던", "기", ""), ("려는", "기", "open"), ("으려는", "기", "closed"), ("고자 하는", "기", ""), ("ㄹ 수 있는", "기", ""), ("을 수 있는", "기", "closed"), ("기 위한", "기", ""),
))
# The particle of an object.
OBJECT = Endings((("을", "", "closed"), ("를", "", "open")))


def noun_phrase(text: str | None, endings: Endings = ADNOMINAL) -> tuple[str, str | None]:
    """A clause as a noun phrase, and the ending that was turned: 자료를 찾아낼 수 있는 is 자료 찾아내기. Null is empty; text without such an ending stays."""
    clause = " ".join((text or "").split())
    found, ending = endings.apply(clause)
    found = found.strip()
    if ending is None:
        return clause, None
    head, _, verb = found.rpartition(" ")
    return (f"{OBJECT.apply(head)[0]} {verb}" if head else verb), ending


def nominaliser(endings: Endings = ADNOMINAL):
    """A UDF of ``noun_phrase``; each distinct text of a batch is read once."""

    @F.pandas_udf(StructType([StructField("text", StringType()), StructField("ending", StringType())]))
    def run(c: pd.Series) -> pd.DataFrame:
        at, texts = pd.factorize(c.fillna(""))
        done = pd.DataFrame([noun_phrase(t, endings) for t in texts], columns=["text", "ending"], dtype=object)
        return done.iloc[at].reset_index(drop=True)

    return run
