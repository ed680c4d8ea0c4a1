"""Text cleaning and tokenising as Column expressions, and the tokenizer interface.

A tokenizer is any callable from a text column to a column of array<string>.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Tokenizer = Callable[[Column], Column]

#: Common English function words, the default where a caller brings no list of their own.
DEFAULT_STOP_WORDS = tuple(
    "a about above after again all also am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from further had has have having he her here hers him his how i if in into is it its just may me might more most must my no nor not now of off on once only or other our out over own same shall she should so some such than that the their them then there these they this those through to too under until up very was we were what when where which while who whom why will with would you your -lrb- -rrb-".split()
)

#: Words that a Treebank tokenizer writes as two.
_JOINED = {"cannot": "can not", "gonna": "gon na", "gotta": "got ta", "wanna": "wan na", "gimme": "gim me", "lemme": "lem me"}


def join_lines(text: Column) -> Column:
    """Lines joined by a space; one trailing line break is dropped."""
    return F.regexp_replace(F.regexp_replace(text, r"(\r\n|\r|\n)\z", ""), r"\r\n|\r|\n", " ")


def clean(text: Column) -> Column:
    """Letters and spaces only, in lower case; other characters vanish without a gap."""
    return F.lower(F.regexp_replace(text, "[^a-zA-Z ]", ""))


def words(text: Column) -> Column:
    """Words between spaces of a cleaned text."""
    return F.filter(F.split(text, " +"), lambda w: w != "")


def cleaned_words(text: Column) -> Column:
    """The bag-of-words tokenizer: line breaks as spaces, cleaned, split."""
    return words(clean(join_lines(text)))


_LETTERS = bytes(range(ord("a"), ord("z") + 1))
_LOWER = bytes.maketrans(_LETTERS.upper() + b"\r\n", _LETTERS + b"  ")
_GONE = bytes(b for b in range(256) if b not in _LETTERS + _LETTERS.upper() + b" \r\n")


def cleaned_bytes(text: bytes | None) -> list[bytes]:
    """The words of cleaned_words for a text in UTF-8: all that stays is one byte long, so bytes are told apart alone."""
    return text.translate(_LOWER, _GONE).split() if text else []


def treebank_words(text: Column) -> Column:
    """Treebank-style tokens of a raw text, each in lower case: words, clitics, numbers, punctuation marks one by one."""
    t = F.regexp_replace(text, r"(?i)\b(can)(not)\b", "$1 $2")
    for joined, apart in list(_JOINED.items())[1:]:
        cut = len(apart.split()[0])
        t = F.regexp_replace(t, rf"(?i)\b({joined[:cut]})({joined[cut:]})\b", "$1 $2")
    t = F.regexp_replace(t, r"(?i)([a-z])(n't|'(?:s|m|d|ll|re|ve))\b", "$1 $2")
    pattern = r"n't(?![\p{L}])|'(?:s|m|d|ll|re|ve)(?![\p{L}])|[\p{L}\p{N}]+(?:[-./,][\p{L}\p{N}]+)*|\.\.\.|--|[^\s\p{L}\p{N}]"
    t = F.regexp_replace(t, r"\bn('t)\b", "n$1")
    return F.transform(F.regexp_extract_all(t, F.lit(f"({pattern})"), 1), lambda w: F.lower(F.when(w == "(", "-lrb-").when(w == ")", "-rrb-").otherwise(w)))


#: Shortened words that keep their point.
_SHORT = "mr|mrs|ms|dr|prof|st|jr|sr|vs|etc|inc|ltd|co|corp|dept|gen|sen|rep|rev|gov|capt|col|lt|sgt|approx|fig|vol"
_ALNUM = r"[\p{L}\p{N}]"
#: Penn-Treebank tokens: at each place the first of these that fits, so a text is read once.
_PENN = "|".join(
    [
        r"https?://[^\s<>\"]*[^\s<>\".,;:!?)\]]",
        r"[A-Za-z0-9._+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        r"(?:(?<![\p{L}])\p{L}\.(?=\p{L}\.))+\p{L}\.",  # U.S., e.g., a.m.
        rf"(?<!{_ALNUM})(?i:{_SHORT})\.(?=,|\s+\S)",
        rf"(?<!{_ALNUM})[\p{{Lu}}&&[^I]]\.(?=\s*\p{{Lu}}\p{{Ll}})",  # initials
        rf"(?<!{_ALNUM})(?i:can(?=not(?!{_ALNUM}))|gon(?=na(?!{_ALNUM}))|got(?=ta(?!{_ALNUM}))|wan(?=na(?!{_ALNUM}))|gim(?=me(?!{_ALNUM}))|lem(?=me(?!{_ALNUM})))",
        rf"(?i:n['’]t)(?!{_ALNUM})",
        rf"['’](?i:s|m|d|ll|re|ve)(?!{_ALNUM})",
        rf"\p{{L}}+(?=(?i:n['’]t)(?!{_ALNUM}))",
        rf"\p{{N}}+(?:[.,:/]\p{{N}}+)*(?i:st|nd|rd|th)?(?:-{_ALNUM}+)*",
        rf"\p{{L}}{_ALNUM}*(?:-{_ALNUM}+|['’](?!(?i:s|m|d|ll|re|ve|t)(?!{_ALNUM}))\p{{L}}+|[./]{_ALNUM}+)*",
        r"\.\.\.+|--+|``|''|\S",
    ]
)
_BRACKETS = {"(": "-lrb-", ")": "-rrb-", "[": "-lsb-", "]": "-rsb-", "{": "-lcb-", "}": "-rcb-"}


def penn_pieces(text: Column) -> Column:
    """The stretches of a raw text that are its Penn-Treebank tokens, as they are written; only white space lies between them."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({_PENN})"), 1)


def penn_words(text: Column) -> Column:
    """Penn-Treebank tokens of a raw text, each in lower case, by longest match in one reading.

    Abbreviations, initials and acronyms keep their point; clitics and words that are written as two part; currency signs,
    percent signs and marks stand alone; brackets have names; a double quote opens (``) after white space, a bracket or at the start, and closes ('') elsewhere.
    """
    opened = F.regexp_replace(text, r"(?<![^\s(\[{`'])\"(?=\S)", "``")
    names = F.create_map(*[F.lit(x) for pair in (_BRACKETS | {'"': "''"}).items() for x in pair])
    return F.transform(penn_pieces(opened), lambda w: F.coalesce(F.try_element_at(names, w), F.lower(w)))


def has_letter(word: Column) -> Column:
    return word.rlike("[A-Za-z]")
