"""Sentence boundaries across languages and scripts (problem 8).

The layout decides first: blank lines, headings, list items and code fences.
Inside a paragraph the Unicode sentence-break properties name the terminators
of every script; the decision after a terminator follows the standard rules
(decimals, upper case inside words, lower case after a full stop, continuation
marks), narrowed by abbreviation lists of the paragraph's language and widened by the handling of
quotations and of blanks and full stops that were lost.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Short forms by language: never the end of a sentence; not the end before a number or a small letter; the end unless a small letter follows.
NEVER = {
    "en": "dr prof mr mrs ms mx st messrs rev gen col capt lt sgt hon e.g i.e cf viz approx incl excl sect resp vs dept est al ca",
    "de": "dr prof hr fr st dipl ing e.g i.e vgl bzw evtl ggf inkl zzgl sog z.b d.h u.a i.d.r z.t u.u ca bspw bsp zb dh usf",
    "es": "dr dra prof sr sra srta d ing lic p.ej ej aprox ca vs pág núm",
}
NUMBERED = {
    "en": "no nr p pp s vol art fig figs ch chap cap sec sect eq ed tab jan feb mar apr jun jul aug sep sept oct nov dec",
    "de": "nr no s abs art abb fig kap tab bd zif ziff jan jän feb mär apr jun jul aug sep sept okt nov dez",
    "es": "núm num no pág págs pag p art cap fig tab vol sec ene feb mar abr may jun jul ago sep sept oct nov dic",
}
UNLESS_SMALL = {
    "en": "etc a.m p.m inc ltd co corp jr ph.d m.a b.a u.s u.k e.u u.n d.c ff",
    "de": "usw usf etc ff m.a b.a u.s",
    "es": "etc a.m p.m ee.uu u.e",
}
MONTHS = {
    "en": "january february march april may june july august september october november december",
    "de": "januar jänner februar märz april mai juni juli august september oktober november dezember jahrhundert",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
}
#: Frequent words that tell the language of a paragraph.
TELLING = {
    "en": "the of and to in is was for that with on as it be by at this are not or from",
    "de": "der die das und den von zu mit sich des auf für ist im dem nicht ein eine als auch wurde am",
    "es": "el la los las de que y en un una por con para del se es no al lo como",
}
_LISTS = {lang: tuple(frozenset(t[lang].split()) for t in (NEVER, NUMBERED, UNLESS_SMALL, MONTHS)) for lang in NEVER}
_TELLING = {lang: frozenset(words.split()) for lang, words in TELLING.items()}
_ANY = frozenset().union(*(lists[i] for lists in _LISTS.values() for i in range(3)))
_VOWEL = regex.compile(r"[aeiouyàáâäèéêëìíîïòóôöùúûü]")
#: Words that start a sentence even after an upper-case abbreviation such as U.S.
STARTERS = frozenset("The A An It This That These Those We They He She You There In On At But And If When After Since Every Our One No Never".split())

_LINE = regex.compile(r"[^\n\r\x85  ]*(?:\r\n|[\n\r\x85  ]|\Z)")
_FENCE = regex.compile(r"[ \t]*(`{3,}|~{3,})")
_HEADING = regex.compile(r"[ ]{0,3}#{1,6}(?:\s|$)")
_BULLET = regex.compile(r"[ \t]*[-*+•‣▪][ \t]+(?=\S)")
_NUMBER = regex.compile(r"[ \t]*(\d{1,9})[.)][ \t]+(?=\S)")
_TERMINATOR = regex.compile(r"[\p{Sentence_Break=STerm}\p{Sentence_Break=ATerm}]+")
_QUOTE = regex.compile(r"[\"“”„«»「」『』《》‹›]")
_CLOSERS = regex.compile(r"[\p{Pe}\p{Pf}’']*")
_BLANKS = regex.compile(r"\s*")
_WORD_BEFORE = regex.compile(r"[^\s\"“”„«»(\[{]+$")
_WORD_AFTER = regex.compile(r"[\p{L}\p{M}\p{N}_][\p{L}\p{M}\p{N}_.\-]*")
_OPENERS = regex.compile(r"[\p{Ps}\p{Pi}\"'¿¡„*_`]+")
_FILE = regex.compile(r"[\w\-]+(?:\.[\w\-]+)*\.[a-z]{1,5}\b")
_THAI_GAP = regex.compile(r"(?<=[ก-ฮะ-ฺเ-๎])[ \t ]+(?=[ก-ฮะ-ฺเ-๎])")
_CONTINUES = regex.compile(r"[,;:،؛、，；：]")
_PARTS = {"“": "”", "„": "“”", "«": "»", "»": "«", "「": "」", "『": "』", "《": "》", "‹": "›", '"': '"'}


def paragraphs(text: str) -> Iterator[tuple[int, int, int]]:
    """``(start, end, marker)`` of the layout units; ``marker`` is where running text starts, -1 for a unit that is never cut."""
    start, marker, last, number, fence, fence_at = None, 0, 0, None, None, 0
    for m in _LINE.finditer(text):
        a, b = m.span()
        if a == b and a == len(text):
            break
        line = m[0]
        if fence:
            last = b
            if line.strip().startswith(fence) and not line.strip().strip(fence[0]):
                yield fence_at, b, -1
                fence = None
            continue
        opened = _FENCE.match(line)
        heading = _HEADING.match(line)
        if start is not None and (opened or heading or not line.strip()):
            yield start, last, marker
            start = None
        if opened:
            fence, fence_at, last, number = opened[1][:3], a, b, None
            continue
        if heading:
            yield a, b, -1
            number = None
            continue
        if not line.strip():
            continue
        item = _BULLET.match(line)
        counted = None if item else _NUMBER.match(line)
        if counted and start is not None:
            n = int(counted[1])
            if not (n == 1 or (number is not None and n == number + 1)):
                counted = None
        if item or counted:
            if start is not None:
                yield start, last, marker
            start, marker = a, a + (item or counted).end()
            number = int(counted[1]) if counted else None
        elif start is None:
            start, marker, number = a, a, None
        last = b
    if fence:
        yield fence_at, len(text), -1
    elif start is not None:
        yield start, last, marker


def quotations(text: str, low: int, high: int) -> list[tuple[int, int]]:
    """The outermost quotations that open and close in ``text[low:high]``; an opening mark without its closing one is none."""
    found, at, closing = [], -1, ""
    for m in _QUOTE.finditer(text, low, high):
        i, c = m.start(), m[0]
        before = text[i - 1] if i > low else " "
        after = text[i + 1] if i + 1 < high else " "
        opens = c in _PARTS and not after.isspace() and (c != '"' or not before.isalnum() and before not in ".!?,;।…")
        if at >= 0 and c in closing and not (c == '"' and opens and before.isspace()):
            found.append((at, i))
            at = -1
        elif opens and (at < 0 or c in closing or c == text[at]):
            if c == "»" and at < 0 and "«" not in text[i:high]:
                continue
            at, closing = i, _PARTS[c]
    return found


def language_of(paragraph: str, tagged: str | None) -> str:
    """The language whose abbreviations hold in a paragraph: that of most of its telling words; where none or as many, that of the tag, else English."""
    words = regex.findall(r"\p{L}+", paragraph.lower())
    votes = {lang: sum(w in telling for w in words) for lang, telling in _TELLING.items()}
    most = max(votes.values())
    first = [lang for lang, n in votes.items() if n == most]
    tag = (tagged or "").lower()[:2]
    return first[0] if len(first) == 1 else tag if tag in first else first[0]


def _is_abbreviation(text: str, low: int, dot: int, after: str, following: str, language: Callable[[], str]) -> bool:
    """Whether the full stop at ``dot`` only marks a short form; ``after`` and ``following``: the next letter and word."""
    m = _WORD_BEFORE.search(text, max(low, dot - 24), dot)
    word = m[0] if m else ""
    key = word.lower().rstrip(".")
    if not key:
        return False
    if key not in _ANY and "." in key and key.rsplit(".", 1)[1] in _ANY:  # the blank before the short form was lost
        word = word.rstrip(".").rsplit(".", 1)[1]
        key = word.lower()
    small = after.islower()
    if key in _ANY or key.isdigit():
        never, numbered, unless_small, months = _LISTS[language()]
    else:
        never = numbered = unless_small = months = frozenset()
    if len(key) == 1 and key.isalpha():
        pair = text[max(low, dot - 4) : dot].lower()
        if regex.search(r"(?:^|\W)[ap]\.\s?m$", pair):
            return small
        if regex.search(r"(?:^|\W)(?:z\.\s?b|d\.\s?h|u\.\s?a|i\.\s?e|e\.\s?g)$", pair):
            return True
        return word.isupper() or small or after.isdigit() or following.lower() in ("ej", "m", "b", "h", "a", "g", "e")
    if key in never:
        return True
    if key in numbered:
        return after.isdigit() or small
    if key in unless_small:
        if small:
            return True
        return word.isupper() and "." in word and following not in STARTERS and after.isupper() and key not in ("a.m", "p.m")
    if key.isdigit() and len(key) <= 2:
        return following.lower() in months
    if "." in key and all(len(p) == 1 and p.isalpha() for p in key.split(".")):
        return small or (word.isupper() and following not in STARTERS)
    return False


def _plain_word(text: str, low: int, dot: int) -> bool:
    """Whether a whole word stands before the full stop: two letters or more, a vowel among them, the short form of no language."""
    m = _WORD_BEFORE.search(text, max(low, dot - 40), dot)
    word = m[0].lower() if m else ""
    return len(word) > 1 and word.isalpha() and word not in _ANY and _VOWEL.search(word) is not None


def _breaks(text: str, low: int, high: int, run: str, dot: int, end: int, quoted: bool, language: Callable[[], str]) -> bool:
    """Whether a sentence ends at ``end``, after the terminators ``run`` (the last one at ``dot``) and what closes behind them."""
    nxt = _BLANKS.match(text, end, high).end()
    if nxt >= high:
        return True
    if _CONTINUES.match(text, nxt):
        return False
    spaced = nxt > end
    opened = _OPENERS.match(text, nxt, high)
    letter = opened.end() if opened and opened.end() < high else nxt
    m = _WORD_AFTER.match(text, letter, high)
    following = m[0].rstrip(".") if m else ""
    after = text[letter]
    small = after.islower() and not (following and following != following.lower()) and not _FILE.match(text, letter, high)
    last = run[-1]
    if not spaced:
        if quoted and regex.match(r"[\p{Hiragana}\p{Hangul}]", after):
            return False
        if last in ".!?":
            if not after.isalpha():
                return bool(opened) and last != "." and not after.isdigit()
            before = text[dot - 1] if dot > low else " "
            if not after.isupper() and not after.islower():
                return end > dot + 1 or not (before.isdigit() or before.isascii() and before.isalpha() and last == ".")
            if not after.isupper():
                return False
            if last != "." or end > dot + 1:
                return True
            word = _WORD_BEFORE.search(text, max(low, dot - 24), dot)
            tail = regex.search(r"[\p{L}\p{N}]+$", word[0]) if word else None
            return bool(tail) and len(tail[0]) > 1 and not _is_abbreviation(text, low, dot, after, following, language) and not _FILE.match(text, word.start(), high)
        return True
    if quoted and small:
        return False
    if last == ".":
        if len(run) > 1:
            return not small
        if end == dot + 1 and _is_abbreviation(text, low, dot, after if not opened else " ", following, language):
            return False
        before = text[dot - 1] if dot > low else " "
        caseless = before.isalpha() and not before.islower() and not before.isupper()
        return not small or caseless or bool(opened) or _plain_word(text, low, dot)
    return True


def sentences(text: str, lang: str | None = None) -> list[tuple[int, int]]:
    """``(start, end)`` of the sentences of ``text`` in code points, without white space at either end.

    ``lang`` counts only where the words of a paragraph do not tell its language.
    """
    out = []

    def add(a: int, b: int) -> None:
        part = text[a:b]
        bare = part.strip()
        if bare:
            a += len(part) - len(part.lstrip())
            out.append((a, a + len(bare)))

    for low, high, marker in paragraphs(text):
        if marker < 0:
            add(low, high)
            continue
        quotes = quotations(text, marker, high)
        language = functools.cache(lambda a=marker, b=high: language_of(text[a:b], lang))
        cuts, q, limit = [], 0, marker
        for m in _TERMINATOR.finditer(text, marker, high):
            s, e = m.span()
            if s < limit:
                continue
            while q < len(quotes) and quotes[q][1] < s:
                q += 1
            inside = q < len(quotes) and quotes[q][0] < s
            quoted = False
            if inside:
                close = quotes[q][1]
                if _CLOSERS.match(text, e, close).end() != close:
                    continue
                end, quoted = close + 1, True
            else:
                end = e
            stop = _CLOSERS.match(text, end, high).end()
            if stop > end and text[end] in "'’" and stop < high and text[stop].isalpha():
                stop = end
            quoted, end, limit = quoted or stop > end, stop, max(e, stop)
            if _breaks(text, marker, high, m[0], e - 1, end, quoted, language):
                cuts.append(end)
        if _THAI_GAP.search(text, marker, high):
            for m in _THAI_GAP.finditer(text, marker, high):
                if not any(a < m.start() < b for a, b in quotes):
                    cuts.append(m.start())
            cuts.sort()
        at = low
        for c in cuts:
            add(at, c)
            at = c
        add(at, high)
    return out


def split_sentences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """``id_col, sentence_no, start_pos, end_pos``: every sentence of every text in order, as 0-based code points.

    Null, empty and blank texts give no sentence.  Repeated rows count once;
    of rows of one id that differ, the one with the greatest list of sentences
    counts.  The language tag (any case, may be missing or wrong, ``lang_col`` may
    be None) only settles which abbreviations hold in paragraphs whose words do not
    tell.  Other columns are ignored.
    """
    lang = F.lit(None).cast("string") if lang_col is None else F.col(lang_col)

    @F.pandas_udf("array<struct<start_pos:int,end_pos:int>>")
    def spans(texts: pd.Series, langs: pd.Series) -> pd.Series:
        return pd.Series([[{"start_pos": a, "end_pos": b} for a, b in sentences(t, tag)] for t, tag in zip(texts, langs, strict=True)])

    rows = df.select(F.col(id_col), F.col(text_col).alias("_text"), lang.alias("_lang")).filter(F.col("_text").isNotNull() & (F.col("_text") != ""))
    found = rows.select(F.col(id_col), spans("_text", "_lang").alias("s")).groupBy(id_col).agg(F.max("s").alias("s"))
    return found.select(F.col(id_col), F.posexplode("s").alias("sentence_no", "s")).select(
        id_col, "sentence_no", F.col("s.start_pos").alias("start_pos"), F.col("s.end_pos").alias("end_pos")
    )
