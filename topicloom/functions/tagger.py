"""Sentences, and part-of-speech tags by Viterbi search: weights of tags for words times weights of tags for neighbours.

Words of closed classes and irregular forms are listed; other words get their tags by ending, capital and
place. Weights are set by hand and rough: they are for telling a noun from a verb where a lemma hangs on it.
All sentences of a batch are searched together, a word of each at a time.
"""

from __future__ import annotations

import re

import numpy as np

TOKEN = re.compile(r"[A-Za-z]+(?:[-'][A-Za-z]+)*|\d+(?:[.,]\d+)*|\.\.\.|[^\sA-Za-z0-9]")
#: Shortened words whose point ends no sentence.
SHORT = frozenset("mr mrs ms dr prof st vs etc fig eg ie no vol pp jr sr inc ltd co dept approx".split())
_END = frozenset([".", "!", "?", "..."])
_CLOSE = frozenset("\"')]}”’»")

TAGS = ["noun", "nouns", "name", "base", "past", "ing", "part", "verbs", "adj", "adv", "det", "pron", "prep", "conj", "modal", "to", "be", "have", "num", "mark", "poss"]
_AT = {t: i for i, t in enumerate(TAGS)}

#: Tags that follow a tag, with weights; all others have weight 1. "start" stands before a sentence.
_FOLLOW = """start: det 20 pron 20 name 15 noun 10 nouns 8 adj 8 adv 10 prep 10 base 6 ing 4 conj 3 num 3 poss 8 modal 1 to 1 verbs .2 past .2 part .5
det: noun 40 nouns 25 adj 25 name 6 num 5 ing 3 adv 3 part 3 base .05 past .05 verbs .05 be .1 have .1 modal .1 prep .3
poss: noun 40 nouns 25 adj 20 ing 2 num 2 part 1 base .05 past .05 verbs .05 be .1 have .1 modal .1
adj: noun 40 nouns 25 mark 10 conj 6 adj 6 prep 6 to 4 base .1 verbs .2 past .3
noun: mark 15 prep 18 verbs 9 past 12 be 10 have 5 modal 5 conj 7 noun 8 nouns 5 adv 4 to 3 part 2 ing 2 base .3 pron 2 det 1 adj .5
nouns: mark 15 prep 18 base 6 past 9 be 10 have 5 modal 5 conj 7 adv 4 to 3 part 2 ing 2 pron 2 noun .5 nouns .3 verbs .3 det 1
name: mark 15 prep 8 verbs 10 past 14 be 10 have 5 modal 5 conj 7 name 12 noun 3 nouns 2 adv 3 poss 2 base .5
pron: past 22 verbs 10 base 14 be 20 have 12 modal 12 adv 8 mark 8 prep 4 noun .2 nouns .4 name .3 adj 1 to 2 det 2
base: det 20 pron 10 prep 12 poss 6 adv 6 nouns 4 noun 4 adj 5 name 4 mark 6 to 4 num 2 base .3 verbs .1 past .3
past: det 18 prep 16 pron 7 poss 6 adv 7 mark 8 to 5 nouns 4 noun 4 adj 4 name 4 part 1 num 2 base .2 verbs .1 past .2
verbs: det 18 prep 14 pron 6 poss 6 adv 7 mark 6 to 5 nouns 4 noun 4 adj 5 name 4 num 2 base .2 verbs .1 past .1
ing: det 14 prep 12 nouns 7 noun 8 pron 4 poss 5 adj 5 mark 7 to 4 name 3 adv 4
part: prep 25 mark 10 to 6 adv 5 det 5 noun 4 nouns 3 conj 4 base .2 verbs .2
adv: adj 10 past 9 base 8 verbs 8 part 6 ing 4 adv 6 mark 8 prep 5 det 5 pron 5 be 3 have 2 modal 2 noun 2
prep: det 30 noun 14 nouns 10 name 12 pron 10 poss 10 adj 8 num 6 ing 8 base .1 past .05 verbs .05 be .1 have .1 modal .05
conj: det 12 noun 10 nouns 8 pron 10 name 8 adj 8 past 6 base 5 verbs 4 adv 6 prep 4 ing 4 poss 5 be 2 have 1 modal 1
modal: base 50 be 12 have 10 adv 14 pron 4 noun .1 nouns .1 verbs .05 past .05
to: base 40 be 6 have 5 det 12 noun 5 name 6 poss 5 nouns 4 pron 4 adj 2 adv 2 verbs .05 past .05
be: part 16 adj 18 det 14 ing 14 adv 12 prep 10 noun 4 nouns 3 to 3 pron 3 mark 3 base .1 verbs .05 past .3
have: part 30 past 2 det 16 adv 8 to 6 noun 4 nouns 4 adj 5 be 8 pron 3 have 2 poss 4 num 3 base .2 verbs .05
num: nouns 25 noun 15 mark 10 prep 6 adj 4 num 3
mark: det 12 pron 12 name 10 noun 8 nouns 6 adj 6 adv 8 conj 10 prep 8 past 4 verbs 3 base 4 ing 5 mark 8 poss 5 be 2 have 1 modal 1 num 3"""

#: Words of closed classes, by tag.
_CLOSED = {
    "det": "the a an this that these those each every some any no all both another either neither such",
    "poss": "my your his her its our their whose",
    "pron": "i you he she it we they me him us them who whom which what myself yourself himself herself itself ourselves themselves someone somebody something anyone anything everyone everything nobody nothing mine yours hers ours theirs there",
    "prep": "of in on at by for with from into onto over under after before between through during without within about against among above below across behind beyond near since until upon via than as like if because while although though whether unless off out up down around along",
    "conj": "and or but nor yet so",
    "modal": "can could may might must shall should will would cannot do does did don't doesn't didn't won't can't couldn't wouldn't shouldn't",
    "to": "to",
    "be": "be am is are was were been being isn't aren't wasn't weren't",
    "have": "have has had having haven't hasn't hadn't",
    "adv": "not n't also very too now then here today yesterday tomorrow often always never again just only even still already soon ever perhaps maybe rather quite almost together away back once twice when where why how however therefore thus well",
    "adj": "old new good great big small little young long short high low large early late own able same few many much more most other first last next free full real true whole hard easy strong weak rich poor red green blue white black dark bright hot cold warm cool dry wet clean dirty happy sad public private local general special common open clear certain possible better best worse worst",
    "num": "one two three four five six seven eight nine ten hundred thousand million",
}
#: Irregular verbs: base, past, participle where it differs.
_VERBS = """see saw seen|go went gone|come came|get got gotten|give gave given|take took taken|make made|know knew known|think thought|find found|tell told|become became|leave left|feel felt|bring brought|begin began begun|keep kept|hold held|write wrote written|stand stood|hear heard|mean meant|meet met|run ran|pay paid|sit sat|speak spoke spoken|lead led|grow grew grown|lose lost|fall fell fallen|send sent|build built|understand understood|draw drew drawn|break broke broken|spend spent|rise rose risen|drive drove driven|buy bought|wear wore worn|choose chose chosen|say said|put put|cut cut|let let|set set|read read|eat ate eaten|sing sang sung|swim swam swum|drink drank drunk|fly flew flown|throw threw thrown|catch caught|teach taught|fight fought|sell sold|win won|sleep slept|shake shook shaken|forget forgot forgotten|steal stole stolen|freeze froze frozen|hide hid hidden|ride rode ridden|bite bit bitten|show showed shown|feed fed|bind bound|wind wound|grind ground|lie lay lain|bear bore born|tear tore torn|swear swore sworn|blow blew blown"""
#: Irregular plurals.
_PLURALS = "man men|woman women|child children|person people|foot feet|tooth teeth|mouse mice|goose geese|leaf leaves|knife knives|wife wives|life lives|wolf wolves|half halves|shelf shelves|thief thieves|loaf loaves|calf calves|self selves|hoof hooves|datum data|analysis analyses|basis bases|crisis crises|thesis theses|movie movies|cookie cookies|species species|series series|sheep sheep|fish fish"
_BE_HAVE_DO = {"am": "be", "is": "be", "are": "be", "was": "be", "were": "be", "been": "be", "being": "be", "has": "have", "had": "have", "having": "have", "does": "do", "did": "do", "done": "do", "doing": "do"}
_COMPARED = {"better": "good", "best": "good", "worse": "bad", "worst": "bad"}
#: Nouns in s that are no plurals, and words whose ing or ed is no ending.
_WHOLE = frozenset("this his was is as its us bus gas news always perhaps thus during nothing something anything everything thing king ring spring string morning evening need feed seed speed red bed lens class glass grass less".split())

PAST, PARTICIPLE, PLURAL = {}, {}, {}
for _entry in _VERBS.split("|"):
    _base, _past, *_part = _entry.split()
    PAST[_past] = _base
    PARTICIPLE[_part[0] if _part else _past] = _base
for _entry in _PLURALS.split("|"):
    PLURAL[_entry.split()[1]] = _entry.split()[0]


def _transitions() -> tuple[np.ndarray, np.ndarray]:
    rows = {}
    for line in _FOLLOW.split("\n"):
        tag, _, rest = line.partition(": ")
        fields = rest.split()
        given = dict(zip(fields[::2], map(float, fields[1::2]), strict=True))
        weights = np.array([given.get(t, 1.0) for t in TAGS])
        rows[tag] = np.log(weights / weights.sum())
    return rows["start"], np.stack([rows[t] for t in TAGS])


_START, _NEXT = _transitions()
_LISTED: dict[str, list[str]] = {}
for _tag, _words in _CLOSED.items():
    for _w in _words.split():
        _LISTED.setdefault(_w, []).append(_tag)
_LISTED |= {"her": ["poss", "pron"], "that": ["det", "pron", "prep"], "like": ["prep", "base"], "do": ["modal", "base"], "does": ["modal", "verbs"], "did": ["modal", "past"], "so": ["adv", "conj"], "will": ["modal", "noun"], "can": ["modal", "noun"], "back": ["adv", "noun"], "open": ["adj", "base"], "free": ["adj", "base"], "own": ["adj", "base"], "clean": ["adj", "base"], "dry": ["adj", "base"], "cold": ["adj", "noun"], "well": ["adv", "noun"]}


def _open(word: str) -> dict[str, float]:
    """Tags of a lower-case word of an open class."""
    if word in PAST or word in PARTICIPLE or word in PLURAL:
        tags: dict[str, float] = {}
        if word in PAST:
            tags["past"] = 5
        if word in PARTICIPLE:
            tags["part"] = 4
        if word in PLURAL:
            tags["nouns"] = 5
        if word in ("saw", "left", "felt", "found", "ground", "wound", "bit", "lay", "rose", "shook", "spoke", "bore"):
            tags |= {"noun": 2, "adj": 0.5, "base": 0.3}
        if word in PLURAL and word.endswith("ves"):
            tags["verbs"] = 4
        if word in PAST.values():
            tags["base"] = 3
        return tags
    if word in PAST.values():
        return {"base": 6, "noun": 2}
    if word in _WHOLE:
        return {"noun": 5, "adj": 1, "base": 0.5}
    if word.endswith("ly") and len(word) > 4:
        return {"adv": 9, "adj": 1}
    if word.endswith("ing") and len(word) > 4:
        return {"ing": 7, "noun": 2, "adj": 1}
    if word.endswith("ed") and len(word) > 3:
        return {"past": 5, "part": 5, "adj": 1}
    if re.search("(tion|ness|ment|ity|ism|ship|ance|ence|er|or)$", word):
        return {"noun": 9, "adj": 1, "base": 1}
    if re.search("(ous|ful|able|ible|ive|al|ic|less|ish)$", word):
        return {"adj": 8, "noun": 2}
    if word.endswith("s") and not word.endswith(("ss", "us", "is")) and len(word) > 2:
        return {"nouns": 6, "verbs": 4}
    return {"noun": 5, "base": 2, "adj": 2, "adv": 0.3}


def word_weights(word: str, first: bool) -> np.ndarray:
    """Log weights of all tags for a word; first: at the start of a sentence, where a capital says little."""
    low = word.lower()
    if not low[0].isalpha():
        tags = {"num": 1.0} if low[0].isdigit() else {"mark": 1.0}
    elif low in _LISTED:
        tags = {t: 1.0 for t in _LISTED[low]} | ({"name": 0.2} if word[0].isupper() and not first and low != "i" else {})
    elif word[0].isupper() and not first:
        tags = {"name": 20.0} | {t: w / 10 for t, w in _open(low).items()}
    else:
        tags = dict(_open(low))
        if word[0].isupper():
            tags["name"] = 4
    out = np.full(len(TAGS), 1e-6)
    total = sum(tags.values())
    for t, w in tags.items():
        out[_AT[t]] = w / total
    return np.log(out)


#: Words whose weights a process keeps.
_CACHE = 200_000
_weights: dict[tuple[str, bool], np.ndarray] = {}


def _known(word: str, first: bool) -> np.ndarray:
    key = (word, first)
    if key not in _weights:
        if len(_weights) >= _CACHE:
            _weights.clear()
        _weights[key] = word_weights(word, first)
    return _weights[key]


def sentences(text: str) -> list[list[str]]:
    """Tokens of a text by sentence: a point, question or exclamation mark ends one, with closing quotes and brackets; points of shortened words and initials don't."""
    out, now = [], []
    tokens, opened = TOKEN.findall(text), False
    for i, token in enumerate(tokens):
        closes = token in _CLOSE and (opened or token != '"')
        opened ^= token == '"'
        if now or not out or not closes:
            now.append(token)
        else:
            out[-1].append(token)
            continue
        if token in _END:
            before = tokens[i - 1] if i else ""
            after = tokens[i + 1] if i + 1 < len(tokens) else ""
            if token == "." and (before.lower() in SHORT or len(before) == 1 and before.isupper() and before != "I" and after[:1].isupper()):
                continue
            if after in _END:
                continue
            out.append(now)
            now = []
    return [*out, now] if now else out


#: Sentences and places that are searched at once.
_PLACES = 200_000


def tag(parts: list[list[str]]) -> list[list[str]]:
    """The tags of each sentence's tokens: the path of the largest product of weights."""
    out: list[list[str]] = [[] for _ in parts]
    order = sorted((i for i, s in enumerate(parts) if s), key=lambda i: -len(parts[i]))
    at = 0
    while at < len(order):
        longest = len(parts[order[at]])
        rows = order[at : at + max(1, _PLACES // longest)]
        at += len(rows)
        sizes = np.array([len(parts[i]) for i in rows])
        back = np.zeros((longest, len(rows), len(TAGS)), np.int8)
        score = _START + np.stack([_known(parts[i][0], True) for i in rows])
        for place in range(1, longest):
            live = int((sizes > place).sum())  # sentences come by length
            steps = score[:live, :, None] + _NEXT
            back[place, :live] = steps.argmax(1)
            here = np.stack([_known(parts[i][place], parts[i][place - 1] in ('"', "“", "(")) for i in rows[:live]])
            score[:live] = np.take_along_axis(steps, back[place, :live][:, None, :].astype(np.intp), 1)[:, 0] + here
        last = score.argmax(1)
        for r, i in enumerate(rows):
            path, t = [], int(last[r])
            for place in range(len(parts[i]) - 1, -1, -1):
                path.append(TAGS[t])
                t = int(back[place, r, t])
            out[i] = path[::-1]
    return out
