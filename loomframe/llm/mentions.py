"""Personal information inside free text (problem 1).

A semi-Markov conditional random field over whole spans.  Patterns propose
candidate segments, often several with different boundaries or kinds for one
place; every candidate is scored as a whole (its form, its digit groups, the
words around it), text outside of segments scores nothing, and a dynamic
programme over the candidates, each bounded in length, picks the boundaries and
kinds of a stretch of text jointly.  The weights maximise the conditional
likelihood of labelled sentences, which ``mention_training`` writes.
"""

from __future__ import annotations

import base64
import bisect
import functools
import itertools
import math
import random
import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.llm.mention_training import labelled_sentences

KINDS = ("person", "email", "phone", "identity", "address")
Span = tuple[int, int, str, str]

_UP = r"[\p{Lu}]"

#: A public vocabulary in which the frequent words of many languages are single tokens, in the order of their frequency.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
_WORD = re.compile(r"([^\W\d_]+(?:['’\-](?!s\b)[^\W\d_]+)*)")
_PARTICLES = {w: "P" for w in "van von de del di da bin al ten".split()} | {w: "D" for w in "der den la los".split()}
#: Forms of names over the classes of words: T capitalised, C so and frequent, U in capitals, V so and frequent, r in small
#: letters and in no vocabulary, k so and known but seldom, I and i initials, P and D particles, Q these in capitals; then a blank,
#: or a comma and a blank.
_NAMES = [
    ("cap", re.compile(r"(?=((?:[TC]|I)(?: I)?(?: P(?: D)?)? [TC]))")),
    ("comma", re.compile(r"(?=((?:P (?:D )?)?[TC],(?:[TC]|I)(?: I)?))")),
    ("caps", re.compile(r"(?=((?:[UV]|I)(?: I)?(?: [PDQ]){0,2} [UV]))")),
    ("commacaps", re.compile(r"(?=([UV],(?:[UV]|I)(?: I)?))")),
    ("low", re.compile(r"(?=((?:[rk]|i)(?: i)?(?: P(?: D)?)? [rk]))")),
    ("commalow", re.compile(r"(?=([rk],(?:[rk]|i)(?: i)?))")),
]
#: The class of the seldom word that a name of each form holds.
_SELDOM = {"cap": "T", "comma": "T", "caps": "U", "commacaps": "U", "low": "r", "commalow": "r"}
#: Titles and roles, which are no part of a name.
_TITLES = frozenset("dr prof mr mrs ms mx herr frau sr sra srta señor señora mister doctor miss sir madam don doña mme mlle".split())
_HANGUL_NAME = regex.compile(r"(?<![\p{Hangul}])[\p{Hangul}]{2,4}(?= ?(?:씨|님|담당자|귀하|께서))|(?<=(?:받는 사람|담당자|성명|이름:?) )[\p{Hangul}]{2,4}(?![\p{Hangul}])", regex.V1)


@functools.cache
def _ranks(path: str = VOCABULARY) -> dict[str, int]:
    """The words of small letters that are one token after a blank, by rank."""
    words = {}
    with open(path, "rb") as f:
        for line in f:
            token, rank = line.split()
            token = base64.b64decode(token)
            if token[:1] == b" ":
                word = token[1:].decode("utf-8", "ignore")
                if word.isalpha() and word.islower():
                    words[word] = int(rank)
    return words


@functools.lru_cache(200_000)
def _bucket(word: str) -> int:
    """How seldom a word is: 0 very frequent to 3 seldom, 4 unknown."""
    rank = _ranks().get(word.lower(), 1 << 30)
    return 0 if rank < 1500 else 1 if rank < 5000 else 2 if rank < 15_000 else 3 if rank < 1 << 30 else 4


@functools.lru_cache(200_000)
def _class(word: str, dot: bool) -> str:
    if len(word) == 1:
        return ("I" if word.isupper() else "i" if word.islower() else "x") if dot else "x"
    low = word.lower()
    if low in _PARTICLES:
        return "Q" if word.isupper() else _PARTICLES[low]
    if low in _TITLES:
        return "x"
    seldom = _bucket(word)
    if word.isupper():
        return "V" if seldom < 2 else "U"
    if word[0].isupper():
        return "C" if seldom < 2 else "T"
    return ("l" if seldom < 3 else "k" if seldom < 4 else "r") if word.islower() else "x"


class _Classes(dict):
    """The class of every word met, given the words that are no part of a name; ``?``: a single letter, an initial if a dot follows."""

    def __init__(self, frequent: frozenset[str]):
        self.frequent = frequent

    def __missing__(self, word: str) -> str:
        if len(self) >= 400_000:
            self.clear()
        kind = "?" if len(word) == 1 and _class(word, True) != "x" else _class(word, False)
        kind = self[word] = "l" if kind in "rk" and word in self.frequent else kind
        return kind


@functools.lru_cache(4)
def _classes(frequent: frozenset[str]) -> _Classes:
    return _Classes(frequent)


class Words:
    """The words of a text: where they start and end, and their classes with what stands between them in one string."""

    def __init__(self, text: str, frequent: frozenset[str] = frozenset()):
        parts = _WORD.split(text)  # what is between words at even places
        at = list(itertools.accumulate(map(len, parts)))
        self.starts, self.ends, self.text = at[:-1:2], at[1::2], text
        kinds = [*map(_classes(frequent).__getitem__, parts[1::2])]
        gaps = parts[2:-1:2]
        if "?" in kinds:
            for i, kind in enumerate(kinds):
                if kind == "?":
                    b = self.ends[i]
                    dotted = text[b : b + 1] == "." and not text[b + 1 : b + 2].isalpha()
                    kinds[i] = kind = _class(text[b - 1], dotted)
                    if kind == "x":
                        continue
                    self.ends[i] = b + 1
                    if i < len(gaps):
                        gaps[i] = gaps[i][1:]
        both = [""] * (2 * len(kinds) - 1)
        both[::2], both[1::2] = kinds, [gap if gap == " " else "," if gap == ", " else "|" for gap in gaps]
        self.classes = "".join(both)

    def word(self, i: int) -> str:
        return self.text[self.starts[i] : self.ends[i]]


_EMAIL = [
    ("plain", regex.compile(r"[\p{L}\p{N}][\p{L}\p{N}._+\-]*@[\p{L}\p{N}][\p{L}\p{N}\-]*(?:\.[\p{L}\p{N}][\p{L}\p{N}\-]*)*", regex.V1)),
    ("spelled", regex.compile(r"[\p{L}\p{N}][\p{L}\p{N}._+\-]*\s?[(\[{]\s?(?i:at)\s?[)\]}]\s?[\p{L}\p{N}\-]+(?:(?:\.|\s?[(\[{]\s?(?i:dot)\s?[)\]}]\s?|\s(?i:dot)\s)[\p{L}\p{N}\-]+)+", regex.V1)),
    ("words", regex.compile(r"[\p{L}\p{N}][\p{L}\p{N}._+\-]*\s(?i:at)\s[\p{L}\p{N}\-]+(?:\s(?i:dot)\s[\p{L}\p{N}\-]+)+", regex.V1)),
]
_PHONE = regex.compile(r"(?<![\p{L}\p{N}_.\-/@#])(?<!\d:)(?:\+\d{1,3}|\(\+?\d{2,5}\)|\d{2,6})(?:[ ./\-]{0,2}(?:\(\d{1,5}\)|\d{1,8})){0,5}(?![\p{N}@_])", regex.V1)
_IDENTITY = regex.compile(
    r"(?<![\p{L}\p{N}_.\-/@#\[])(?<!\d:)(?:\d{6}-\d{7}|\d{3}[ \-]\d{2}[ \-]\d{4}|\d{9}|\d{3} \d{6}|[A-Za-z]\d{8}|[A-Za-z]{2}\d{7}|[A-Za-z]{2}\d{3} \d{5})(?![\p{L}\p{N}_\-@])", regex.V1
)
_STREET = r"(?:Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Boulevard|Blvd|Close|Drive|Dr|Court|Ct|Way|Place|Pl|Square|Terrace|Crescent|Row|Hill|Gate|Walk|Mews|Parade|Gardens|Grove|Park)"
_ROADS = frozenset(re.findall(r"\w{3,}", _STREET)) | frozenset("Hall Lake Port Mount Bay Hollow Falls Church School Bridge River Saint".split())
_TOWN = rf"{_UP}[\p{{L}}'’\-]+(?: {_UP}[\p{{L}}'’\-]+){{0,2}}"
_POST = r"(?:[A-Z]{1,2}\d{1,2}[A-Z]? ?\d[A-Z]{2}|[A-Z]{2} \d{5}(?:-\d{4})?|\d{5})"
_ADDRESS = [
    ("number first", regex.compile(rf"(?<![\p{{L}}\p{{N}}.,\-/#:])\d{{1,5}}[a-z]?(?: {_UP}\.)?(?: St\.)?(?: {_UP}[\p{{L}}'’\-]+){{1,4}}(?<= {_STREET})\.?", regex.V1), ("unit", "town", "post")),
    ("number first", regex.compile(rf"(?<![\p{{L}}\p{{N}}.,\-/#:])\d{{1,4}}(?: bis| ter)?,? (?:[Rr]ue|[Aa]venue|[Bb]oulevard|[Pp]lace|[Cc]hemin|[Aa]llée|[Qq]uai)(?: (?:de|du|des|la|le|les))*(?: (?:d['’])?{_UP}[\p{{L}}'’\-]+){{1,3}}", regex.V1), ("town after post",)),
    ("number last", regex.compile(rf"(?<![\p{{L}}\p{{N}}])(?:(?:Am|An|Auf|Im|In|Zum|Zur|Unter|Hinter|Vor|Alte|Alter|Calle|Rue|Via|Avenida|Plaza)(?: (?:der|den|dem|de|del|la|du))? )?{_UP}[\p{{L}}\-]+ \d{{1,4}} ?[a-z]?(?=, \d{{5}} )", regex.V1), ("town after post",)),
    ("number last", regex.compile(rf"(?<![\p{{L}}\p{{N}}])(?:(?:Am|An|Auf|Im|Zum|Zur) )?{_UP}[\p{{L}}\-]*(?:straße|strasse|weg|platz|gasse|allee|stieg|ring|damm|ufer|teich) \d{{1,4}}[a-z]?(?![\p{{L}}\p{{N}}])", regex.V1), ("town after post",)),
    ("hangul", regex.compile(r"[\p{Hangul}]{1,8}(?:시|도|군)(?: [\p{Hangul}]{1,8}(?:시|군|구|읍|면|동))* [\p{Hangul}\d]{1,10}(?:로|길)(?: \d{1,3}(?:번)?길)? \d{1,4}(?:-\d{1,4})?(?:번지)?(?:,? \d{1,4}동)?(?:,? \d{1,5}호)?", regex.V1), ()),
]
_MORE = {
    "unit": regex.compile(r", (?:Apt|Flat|Unit|Suite|Apartment|Floor|No)\.? ?[\p{L}\p{N}\-]{1,6}"),
    "town": regex.compile(rf", {_TOWN}(?![\p{{L}}\p{{N}}])"),
    "post": regex.compile(rf",? {_POST}(?![\p{{L}}\p{{N}}])"),
    "town after post": regex.compile(rf", \d{{5}} {_TOWN}"),
}
_DIGITS = re.compile(r"\d+")
_SERVICE = regex.compile(r"(?i)^(?:no-?reply|do-?not-?reply|git|root|admin|daemon|mailer-daemon|postmaster|notifications?|alerts?|bot|user|localhost|www|ci|build|svn|hg|ssh|deploy|service|system)$")
#: The fewest digits of a telephone number.
_PHONE_DIGITS = 7
#: What every match of a slow pattern holds; a text without it is not searched.  By the forms of ``_EMAIL`` and of ``_ADDRESS``.
_MAIL_HOLDS = [re.compile("@"), re.compile(r"(?i)[(\[{]\s?at\s?[)\]}]"), re.compile(r"(?i)\sdot\s")]
_PHONE_HOLDS = re.compile(r"\d(?:[ ./\-()]{0,4}\d){6}")
_IDENTITY_HOLDS = re.compile(r"\d{7}|\d{3} \d{5}|\d\d[ \-]\d{4}")
_ADDRESS_HOLDS = [
    re.compile(rf" {_STREET}"),
    re.compile(r"\d(?: bis| ter)?,? (?:[Rr]ue|[Aa]venue|[Bb]oulevard|[Pp]lace|[Cc]hemin|[Aa]llée|[Qq]uai)"),
    re.compile(r"\d ?[a-z]?, \d{5} "),
    re.compile(r" (?=\d)(?:" + "|".join(f"(?<={road} )" for road in "straße strasse weg platz gasse allee stieg ring damm ufer teich".split()) + ")"),
    None,
]
#: A name stands neither behind nor before one of these.
_GLUED = frozenset("@._-/#'’0123456789")
_GLUES = frozenset("@_")
_HANGUL = re.compile(r"[\uac00-\ud7a3]")
_DIGIT = re.compile(r"\d")


_LETTER = regex.compile(r"\p{L}")


def _shape(text: str) -> str:
    return _LETTER.sub("x", _DIGITS.sub(lambda m: str(len(m[0])), text))


def _person_spans(words: Words) -> Iterator[Span]:
    """Two words of which one at least is not among the most frequent, with initials and particles, in any case and order."""
    text, classes = words.text, words.classes
    for form, pattern in _NAMES:
        if _SELDOM[form] not in classes or form.startswith("comma") and "," not in classes:
            continue
        for m in pattern.finditer(classes):
            i, j = m.start() // 2, (m.end(1) - 1) // 2
            found = m[1]
            if _SELDOM[form] not in found:
                continue
            a, b = words.starts[i], words.ends[j]
            if text[a - 1 : a] in _GLUED or text[b : b + 1] in _GLUES or text[b : b + 1].isdigit():
                continue
            yield a, b, "person", form
    if not text.isascii() and _HANGUL.search(text):
        for m in _HANGUL_NAME.finditer(text):
            yield m.start(), m.end(), "person", "hangul"


def _address_spans(text: str) -> Iterator[Span]:
    hangul = not text.isascii() and _HANGUL.search(text)
    for (form, pattern, parts), holds in zip(_ADDRESS, _ADDRESS_HOLDS, strict=True):
        if not (hangul if holds is None else holds.search(text)):
            continue
        for m in pattern.finditer(text):
            end = m.end()
            yield m.start(), end, "address", form
            for part in parts:
                n = _MORE[part].match(text, end)
                if n is None:
                    continue
                if part.startswith("town"):
                    at = n.end()
                    for word in reversed(n[0].split(" ")[2 + ("post" in part) :]):
                        at -= len(word) + 1
                        yield m.start(), at, "address", f"{form}, {part} short"
                end = n.end()
                yield m.start(), end, "address", f"{form}, {part}"


def _phone_spans(text: str) -> Iterator[Span]:
    for m in _PHONE.finditer(text):
        s, e = m.span()
        if sum(c.isdigit() for c in m[0]) < _PHONE_DIGITS:
            continue
        yield s, e, "phone", _shape(text[s:e])
        groups = list(_DIGITS.finditer(text, s, e))
        for g in groups[1:]:
            if text[g.start() - 1] == " " and sum(c.isdigit() for c in text[g.start() : e]) >= _PHONE_DIGITS:
                yield g.start(), e, "phone", _shape(text[g.start() : e])
        for g in groups[1:-1]:
            if sum(c.isdigit() for c in text[s : g.end()]) >= _PHONE_DIGITS:
                yield s, g.end(), "phone", _shape(text[s : g.end()])


def candidates(text: str, words: Words | None = None) -> list[Span]:
    """Candidate segments ``(start, end, kind, form)`` of the whole text, of a few dozen tokens at most each."""
    found: list[Span] = []
    for (form, pattern), holds in zip(_EMAIL, _MAIL_HOLDS, strict=True):
        if holds.search(text):
            found.extend((m.start(), m.end(), "email", form) for m in pattern.finditer(text))
    if _DIGIT.search(text):
        if _PHONE_HOLDS.search(text):
            found.extend(_phone_spans(text))
        if _IDENTITY_HOLDS.search(text):
            found.extend((m.start(), m.end(), "identity", _shape(m[0])) for m in _IDENTITY.finditer(text))
        found.extend(_address_spans(text))
    found.extend(_person_spans(words or Words(text)))
    return list(dict.fromkeys(found))


def _told(word: str) -> str:
    """A word as a feature: itself if it is frequent, else its class."""
    return word.lower() if _bucket(word) < 3 else "<" + _class(word, False) + ">"


def features(text: str, span: Span, words: Words) -> list[str]:
    """Whole-span features of one candidate: its form and words, and what stands before and after it."""
    s, e, kind, form = span
    before, after = bisect.bisect_left(words.starts, s) - 1, bisect.bisect_left(words.starts, e)
    n = len(words.starts)
    near_left = before >= 0 and s - words.ends[before] <= 3
    near_right = after < n and words.starts[after] - e <= 3
    l1 = _told(words.word(before)) if near_left else "<none>"
    r1 = _told(words.word(after)) if near_right else "<none>"
    left, right = text[max(0, s - 2) : s], text[e : e + 2]
    lp = left.strip()[-1:] or ("<blank>" if left else "<start>")
    rp = right[:1] or "<end>"
    lp, rp = ("w" if lp.isalnum() else lp), ("w" if rp.isalnum() else rp)
    begins = not left or left[0] in ".!?。\n" or left[-1] == "\n" or lp in "-*>|"
    out = [kind, f"{kind}|{form}", f"{kind}|l1={l1}", f"{kind}|r1={r1}", f"{kind}|lp={lp}", f"{kind}|rp={rp}"]
    body = text[s:e]
    if kind == "person":
        if form == "hangul":
            return [*out, f"h|n={len(body)}", f"h|first={body[0]}", f"h|r={right.strip()[:1]}", f"h|l={text[max(0, s - 4) : s].strip()[-2:]}"]
        lc = words.classes[2 * before] if before >= 0 else "-"
        rc = words.classes[2 * after] if after < n else "-"
        ll = words.classes[2 * before - 2] if before >= 1 else "-"
        rr = words.classes[2 * after + 2] if after + 1 < n else "-"
        inner = [words.word(i) for i in range(before + 1, after)]
        rare = "".join(str(_bucket(w)) for w in inner if len(w.rstrip(".")) > 1 and w.lower() not in _PARTICLES)
        kinds = words.classes[2 * before + 2 : 2 * after - 1]
        tied = "y" if text[s - 1 : s] == " " and before >= 0 and words.ends[before] == s - 1 else "n"
        tied += "y" if right[:1] == " " and after < n and words.starts[after] == e + 1 else "n"
        out += [
            f"p|rare={rare}|{form}", f"p|{kinds}|{begins}", f"p|{form}|{lc}{rc}{tied}", f"p|{form}|{ll}{lc}", f"p|{form}|{rc}{rr}", f"p|{form}|l={l1}", f"p|{form}|r={r1}|{begins}",
            f"p|cue={l1}&{r1}", f"p|{rare}|{lc}|{tied}", f"p|{rare}|{rc}|{tied}", f"p|lp={lp}{rp}|{form}", f"p|{form}|{rp}{rc}", f"p|{form}|{lp}{lc}", f"p|short={min(map(len, inner))}|{form}",
        ]
        if form in ("low", "commalow"):
            out += [f"p|{form}|end={inner[-1][-2:]}|{tied}", f"p|{form}|end={inner[0][-2:]} {inner[-1][-2:]}"]
        out += [f"p|first={inner[0].lower() if _bucket(inner[0]) < 4 else kinds[:1]}", f"p|last={inner[-1].lower() if _bucket(inner[-1]) < 4 else kinds[-1:]}"]
        ends = (inner[0] in _ROADS, inner[-1] in _ROADS)
        if right.strip()[:1].isdigit():
            out.append(f"p|number|{begins}")
        if any(ends):
            out.append(f"p|road={ends}")
        if right in ("'s", "’s"):
            out.append("p|owner")
    elif kind == "email":
        local, _, host = body.partition("@")
        out += [f"e|service={bool(_SERVICE.match(local))}", f"e|dots={min(host.count('.'), 2)}|{form}", f"e|digits={bool(re.search(r'@v?[0-9]', body))}", f"e|path={rp == ':'}", f"e|cap={bool(re.search(r'[.][A-Z][a-z]+$', body))}"]
    elif kind in ("phone", "identity"):
        l2 = _told(words.word(before - 1)) if near_left and before >= 1 else "<none>"
        touching = "w" if right[:1].isalnum() else "n"
        out += [f"{kind}|n={sum(x.isdigit() for x in body)}", f"{kind}|l2={l2} {l1}", f"{kind}|f&l={form}|{l1}", f"{kind}|zero={body.lstrip('(')[:1] in '0+'}|{form}", f"{kind}|right word={touching}", f"{kind}|head={body[:2] if body[:1] in '(+' else body[:1]}"]
    else:
        more = re.match(r", [A-Z0-9]", text[e : e + 3]) is not None
        out += [f"a|post={bool(re.search(r'[0-9]{5}|[0-9][A-Z]{2}$', body))}", f"a|commas={body.count(',')}", f"a|more={more}|{form}", f"a|last={_bucket(body.split(' ')[-1])}|{'cap' if re.match(r' [A-Z]', text[e : e + 2]) else 'no'}"]
    return out


def _ordered(spans: list[Span]) -> tuple[list[Span], list[int]]:
    """Spans by end, and for each the number of spans that end before it starts."""
    spans = sorted(spans, key=lambda x: (x[1], x[0], x[2]))
    ends = [x[1] for x in spans]
    return spans, [bisect.bisect_right(ends, x[0]) for x in spans]


def best_segments(text: str, weights: dict[str, float], frequent: frozenset[str] = frozenset()) -> list[tuple[int, int, str]]:
    """The segmentation of greatest score: exact dynamic programming over the candidates."""
    words = Words(text, frequent)
    found = candidates(text, words)
    if not found:
        return []
    spans, before = _ordered(found)
    best, taken = [0.0], []
    for i, span in enumerate(spans):
        score = sum(filter(None, map(weights.get, features(text, span, words)))) + best[before[i]]
        taken.append(score > best[-1])
        best.append(max(score, best[-1]))
    out, i = [], len(spans)
    while i > 0:
        if taken[i - 1]:
            out.append(spans[i - 1][:3])
            i = before[i - 1]
        else:
            i -= 1
    return out[::-1]


def _log_add(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def train(sentences: list[tuple[str, set[tuple[int, int, str]]]], passes: int = 6, rate: float = 0.5, decay: float = 1e-4, seed: int = 7) -> dict[str, float]:
    """Maximum conditional likelihood by adaptive gradient steps; the expectations come from forward and backward sums."""
    prepared = []
    for text, gold in sentences:
        words = Words(text)
        spans, before = _ordered(candidates(text, words))
        if spans:
            starts = sorted(range(len(spans)), key=lambda i: spans[i][0])
            prepared.append((spans, before, [features(text, s, words) for s in spans], [s[:3] in gold for s in spans], starts))
    weights: dict[str, float] = defaultdict(float)
    squares: dict[str, float] = defaultdict(float)
    order = random.Random(seed)
    for _ in range(passes):
        order.shuffle(prepared)
        for spans, before, feats, gold, starts in prepared:
            scores = [sum(weights[f] for f in fs) for fs in feats]
            ahead = [0.0]
            for i in range(len(spans)):
                ahead.append(_log_add(ahead[-1], scores[i] + ahead[before[i]]))
            firsts = [spans[i][0] for i in starts]
            back = [0.0] * (len(starts) + 1)  # back[k]: all choices among the spans starts[k:]
            for k in range(len(starts) - 1, -1, -1):
                i = starts[k]
                back[k] = _log_add(back[k + 1], scores[i] + back[bisect.bisect_left(firsts, spans[i][1])])
            total = ahead[-1]
            for i, fs in enumerate(feats):
                behind = back[bisect.bisect_left(firsts, spans[i][1])]
                expected = math.exp(min(0.0, ahead[before[i]] + scores[i] + behind - total))
                slope = (1.0 if gold[i] else 0.0) - expected
                if abs(slope) < 1e-4:
                    continue
                for f in fs:
                    g = slope - decay * weights[f]
                    squares[f] += g * g
                    weights[f] += rate * g / math.sqrt(squares[f] + 1e-6)
    return {f: round(w, 4) for f, w in weights.items() if abs(w) > 1e-3}


_MODEL: dict[int, dict[str, float]] = {}


def model(n_sentences: int = 14_000) -> dict[str, float]:
    """The weights, trained once per process on ``n_sentences`` labelled sentences (a fixed bound)."""
    if n_sentences not in _MODEL:
        _MODEL[n_sentences] = train(labelled_sentences(n_sentences))
    return _MODEL[n_sentences]


def frequent_words(texts: DataFrame, text_col: str, least: int = 5, share: float = 0.8, most: int = 50_000) -> frozenset[str]:
    """Words that stand in small letters ``least`` times and in a ``share`` of their places at least, counted over all texts: no part of a name in small letters.

    Of more than ``most`` such words (the bound of what every task is told) the most frequent.
    """
    word = texts.select(F.explode(F.split(F.col(text_col), r"[^\p{L}'’\-]+")).alias("w")).groupBy("w").count()
    low = F.col("w") == F.lower("w")
    counts = word.groupBy(F.lower("w").alias("w")).agg(F.sum(F.when(low, F.col("count")).otherwise(0)).alias("small"), F.sum("count").alias("all"))
    often = counts.filter((F.length("w") > 1) & (F.col("small") >= least) & (F.col("small") >= share * F.col("all")))
    return frozenset(r.w for r in often.orderBy(F.desc("small"), "w").limit(most).select("w").collect())


def _tagger(df: DataFrame, text_col: str, weights: dict[str, float] | None) -> Callable[[str], list[tuple[int, int, str]]]:
    shared = df.sparkSession.sparkContext.broadcast((model() if weights is None else weights, frequent_words(df, text_col)))
    return lambda text: best_segments(text, *shared.value)


def find_mentions(df: DataFrame, id_col: str, text_col: str, weights: dict[str, float] | None = None) -> DataFrame:
    """``rec_id, start_pos, end_pos, kind, mention``: every mention of a person, mailbox, phone or identity number or address.

    Positions are 0-based code points of the whole text.  Null and empty texts
    hold no mention; repeated rows give repeated mentions, so take ``distinct``
    where rows may come twice.  Segments never overlap.  Other columns are ignored.
    """
    tag = _tagger(df, text_col, weights)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(i, a, b, kind, t[a:b]) for i, t in zip(batch["rec_id"], batch["_text"], strict=True) for a, b, kind in tag(t)]
            yield pd.DataFrame(out, columns=["rec_id", "start_pos", "end_pos", "kind", "mention"])

    texts = df.select(F.col(id_col).alias("rec_id"), F.col(text_col).alias("_text")).filter(F.col("_text").isNotNull() & F.col("rec_id").isNotNull())
    return texts.mapInPandas(rows, f"rec_id {df.schema[id_col].dataType.simpleString()}, start_pos int, end_pos int, kind string, mention string")


def redact(df: DataFrame, text_col: str, weights: dict[str, float] | None = None) -> DataFrame:
    """``df`` with every mention in ``text_col`` replaced by ``[PERSON]``, ``[EMAIL]`` and so on; all else is unchanged.  Null stays null."""
    tag = _tagger(df, text_col, weights)

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        parts, at = [], 0
        for a, b, kind in tag(text):
            parts += [text[at:a], f"[{kind.upper()}]"]
            at = b
        return "".join(parts) + text[at:]

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series) -> pd.Series:
        return texts.map(clean)

    return df.withColumn(text_col, cleaned(F.col(text_col)))
