"""An English lemmatiser: sentences, tags by context, then the lemma of a word under its tag.

It stands where a full part-of-speech lemmatiser would: the first word of a sentence loses its capital
unless it is a name, names and "I" keep theirs. Runs as an Arrow pandas UDF over whole batches; pass
another function of list[str] to lemmatise differently.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from topicloom.functions.tagger import _BE_HAVE_DO, _COMPARED, _WHOLE, PARTICIPLE, PAST, PLURAL, sentences, tag

_VERBAL = frozenset(["base", "past", "part", "ing", "verbs", "be", "have", "modal"])


def _without_s(word: str) -> str:
    for end, new in (("sses", "ss"), ("ches", "ch"), ("shes", "sh"), ("xes", "x"), ("ies", "y"), ("zzes", "zz")):
        if word.endswith(end):
            return word[: -len(end)] + new if len(word) > len(end) + 1 else word
    if word.endswith("s") and not word.endswith(("ss", "us", "is")):
        return word[:-1]
    return word


def _verb(word: str) -> str:
    """The base of a verb's form."""
    if word in _BE_HAVE_DO:
        return _BE_HAVE_DO[word]
    if word in PAST or word in PARTICIPLE:
        return PAST.get(word) or PARTICIPLE[word]
    if word in _WHOLE:
        return word
    if word in ("goes", "does"):
        return word[:-2]
    if word.endswith("s"):
        return _without_s(word)
    for end in ("ing", "ied", "ed"):
        stem = word[: -len(end)]
        if word.endswith(end) and re.search("[aeiouy]", stem) and len(stem) >= 2:
            if end == "ied":
                return stem + "y"
            if len(stem) > 2 and stem[-1] == stem[-2] and stem[-1] not in "lsz":
                return stem[:-1]
            if stem + "e" in PAST.values() or re.search("(at|iz|is|us|iv|nc|rg|ag|ov|as|os|bl|tl|[aeiou]r)$", stem) and not stem.endswith(("er", "or")) or stem.endswith(("ang", "rng")):
                return stem if stem in PAST.values() else stem + "e"
            return stem
    return word


@lru_cache(1 << 17)
def lemma(word: str, tagged: str = "") -> str:
    """Lemma of one lower-case word under its tag; without one, of the word as a verb's form or plural, whichever it looks like."""
    if not word.isalpha():
        return word
    if not tagged:
        tagged = "nouns" if word in PLURAL and word not in PAST else "verbs" if word.endswith(("ing", "ed")) or word in PAST or word in PARTICIPLE or word in _BE_HAVE_DO else "adj" if word in _COMPARED else "nouns"
    if tagged in _VERBAL:
        return _verb(word) if len(word) > 3 or word in PAST or word in PARTICIPLE or word in _BE_HAVE_DO else word
    if tagged == "nouns":
        return PLURAL.get(word) or (word if word in _WHOLE or len(word) < 4 else _without_s(word))
    if tagged in ("adj", "adv"):
        return _COMPARED.get(word, word)
    return word


def lemmas_of(texts: list[str]) -> list[list[str]]:
    """Lemmas of the tokens of raw texts, punctuation included; all sentences are tagged together."""
    parts, owners = [], []
    for i, t in enumerate(texts):
        own = sentences(t)
        parts += own
        owners += [i] * len(own)
    out: list[list[str]] = [[] for _ in texts]
    for i, words, tags in zip(owners, parts, tag(parts), strict=True):
        for word, t in zip(words, tags, strict=True):
            out[i].append(word if word == "I" or t == "name" or not word[0].isalpha() else lemma(word.lower(), t))
    return out


#: Characters of the texts that are tagged together; what is held for them is many times as much.
STRETCH = 1 << 20


def stretches(texts: list[str]) -> Iterator[list[str]]:
    """texts in their order, as many together as have STRETCH characters, one at least."""
    held, n = [], 0
    for t in texts:
        if held and n + len(t) > STRETCH:
            yield held
            held, n = [], 0
        held.append(t)
        n += len(t)
    if held:
        yield held


def lemmas(text: str | None) -> list[str]:
    return lemmas_of([text or ""])[0]


def lemmatizer(function: Callable[[str], list[str]] | None = None) -> Callable[[Column], Column]:
    """A tokenizer (text column to array<string>), by tags over stretches of a batch or by a function of one text.

    Lemmas of a stretch are passed on before the next is read, so a process holds no more for a larger batch.
    """

    @F.pandas_udf("array<string>")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            for held in stretches(texts.fillna("").tolist()):
                yield pd.Series(lemmas_of(held) if function is None else [function(t) for t in held])

    return apply
