"""Sentence units with offsets, by a pushdown automaton over lines and marks.

The outer level of the automaton walks over lines and keeps what it is inside of:
a fenced code block, a list item, a heading or a paragraph. The inner level walks
over the terminators, quotation marks and brackets of a paragraph with a stack of
open marks; only a terminator at the bottom of the stack, or a closing mark that
empties it after one, can end a sentence. A trie of abbreviations, kept by the way
they behave, tells which full stops don't.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Abbreviations by behaviour, month names, marks.
ABBREVIATIONS = {
    "never": "dr mr mrs ms mme mlle mm prof st ste sr sra srta dra hr fr frau rev hon gen col capt lt sgt gov sen rep pres vs e.g i.e eg ie cf vgl viz approx incl bzw ca z.b d.h u.a z.t i.d.r s.o s.u p.ex p.ej ej т.е т.д т.п т.к т.н г гг ул пр пер им о-в см ср напр тыс млн млрд руб коп тел др проф акад д डॉ श्री पं प्रो د أ م ص",
    "number": "no nr nos fig figs ch chap sec art eq tab p pp pg pág págs vol vols n núm s bd abs kap рис стр табл гл п nº num ex op ed",
    "often": "etc inc ltd co corp jr al a.m p.m u.s u.k u.n e.u usw etcétera ff plc gmbh",
    "month": "jan feb mar apr jun jul aug sep sept oct nov dec janv févr avr juil déc ene abr ago dic okt dez mrz янв февр апр авг сент окт нояб дек",
}
MONTHS = "januar februar märz april mai juni juli august september oktober november dezember jänner january february march may june july october december"
STARTERS = "the a an in on at it this that these those when where why who what how if there some most few many after before because since over between one each every no nobody nothing we they he she you i his her their its but and so then however"
PAIRS = {"(": ")", "（": "）", "[": "]", "「": "」", "『": "』", "“": "”", "„": "“", "«": "»", "‹": "›", '"': '"', "【": "】", "〈": "〉", "《": "》", "〝": "〟"}
BRACKETS = "(（["

_TERMINATORS = "!?。！？｡।॥؟۔…."
_EVENT = re.compile(rf"[{_TERMINATORS}]+|[{re.escape(''.join(set(PAIRS) | set(PAIRS.values())))}]")
_STOPS = re.compile(rf"[{_TERMINATORS}]+")
_MARKS = re.compile(rf"[{re.escape(''.join(set(PAIRS) | set(PAIRS.values())))}]")
_WIDE = frozenset("。！？｡।॥؟۔")
_FILL = "\u2060"
_TAIL = re.compile(r"(?:['’\u2060]|\s?\[\d+\]|[¹²³⁴-⁹]+)*")
_WORD_BREAK = frozenset(" \t\n\r\x0b\x0c\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000,;:!?()[]«»\"“”„")
_WORD = re.compile(r"[^\W\d_]+")
_INITIAL = re.compile(r"[^\W\d_]\.")
_CODE_NAME = re.compile(r"[a-z]+[a-z]*[_\d]\w*|[a-z]+[A-Z]\w*")
_DAMAGED = re.compile(r"&(?:quot|#34|#x22|ldquo|rdquo);|â€(?:œ|\x9d)|&(?:apos|#39|#x27|rsquo|lsquo);|â€(?:™|˜)|&(?:laquo|raquo);")
_FENCE = re.compile(r"\s{0,3}(```+|~~~+)")
_BULLET = re.compile(r"\s*[-*+•·▪◦‣]\s+\S")
_COUNTED = re.compile(r"\s*(?:\(?\d{1,3}[.)]|\(?[a-zA-Z]\)|\(?[ivx]{1,4}\))\s+\S")
_HEADING = re.compile(r"\s{0,3}#{1,6}\s")
_NUMBERED = re.compile(r"\s*\d+(?:\.\d+)+\.?\s+\S")
_LINE = re.compile(r"[^\n\r\u2028\u2029]*(?:\r\n|[\n\r\u2028\u2029]|$)")
_THAI_GAP = re.compile(r"(?<=[\u0e00-\u0e7f])[ \t\u00a0\u2000-\u200a\u3000]+(?=[^\s\d\u0e50-\u0e59])")
_THAI = re.compile(r"[฀-๿]")
_CASELESS = re.compile(r"[぀-ヿ一-鿿㐀-䶿가-힯֐-ۿऀ-෿฀-๿]")
_OPENERS = frozenset(PAIRS)
_CLOSERS = frozenset(PAIRS.values())


def _trie(entries: dict[str, str]) -> dict:
    root: dict = {}
    for kind, listed in entries.items():
        for word in listed.split():
            node = root
            for letter in reversed(word):
                node = node.setdefault(letter, {})
            node[""] = kind
    return root


_ABBREVIATIONS = _trie(ABBREVIATIONS)
_MONTHS = frozenset(MONTHS.split())
_STARTERS = frozenset(STARTERS.split())


def abbreviation(text: str, stop: int, floor: int = 0) -> str | None:
    """The kind of the abbreviation that ends at ``text[stop]``, a full stop; it must begin a word."""
    node, at, kind = _ABBREVIATIONS, stop - 1, None
    while at >= floor - 1:
        if "" in node and (at < floor or not (text[at].isalnum() or text[at] in "._")):
            kind = node[""]
        if at < floor:
            break
        step = node.get(text[at].lower())
        if step is None:
            # "z. B." is written with or without a space
            if text[at].isspace() and at > floor and text[at - 1] == "." and "." in node:
                at -= 1
                continue
            break
        node, at = step, at - 1
    return kind


def _word_before(text: str, begin: int, end: int) -> str:
    """The word that ends at ``end``, with full stops inside it."""
    at = end
    while at > begin and text[at - 1] not in _WORD_BREAK:
        at -= 1
    return text[at:end].strip(".")


def _goes_on(text: str, at: int) -> bool:
    """Whether what follows at ``at`` continues a sentence that may have ended: lower case, a comma, a dash before lower case."""
    c = text[at]
    if c.islower():
        return not _CODE_NAME.match(text, at)
    if c in ",;:،，、；：":
        return True
    if c in "—–-":
        rest = text[at + 1 : at + 4].lstrip()
        return bool(rest) and rest[0].islower()
    return False


def _stop_ends(text: str, begin: int, s: int, e: int, after: int, end: int) -> bool:
    """Whether the terminators text[s:e], outside all quotes and brackets, end the sentence begun at ``begin``."""
    if after >= end:
        return True
    run, c = text[s:e], text[after]
    if run[-1] in _WIDE or run[0] in _WIDE:
        return c not in ",，、،"
    if not c.isspace():
        if run[-1] == "…":
            return s > begin and bool(_CASELESS.match(text, s - 1)) and bool(_CASELESS.match(text, after))
        before = text[s - 1] if s > begin else " "
        if run == "." or run[-1] in "!?":
            if c.isupper() and s - 2 >= begin and text[s - 2].isalpha() and (before.islower() or before in "]%)"):
                word = text.rfind(" ", begin, s)
                return "/" not in text[word + 1 : s] and "@" not in text[word + 1 : s]
            return run[-1] in "!?" and (c in _OPENERS or bool(_CASELESS.match(text, after)))
        return False
    m = after
    while m < end and text[m].isspace():
        m += 1
    if m >= end:
        return True
    if run == ".":
        kind = abbreviation(text, s, begin)
        if kind == "never":
            return False
        c = text[m]
        if kind == "number":
            if c.isdigit() or text[s - 1 : s].lower() != "o":
                return False
        elif kind == "month":
            if c.isdigit():
                return False
        own = _word_before(text, begin, s)
        if kind == "often":
            if _goes_on(text, m) or c.isdigit():
                return False
            if own.lower() in ("u.s", "u.k", "u.n", "e.u"):
                follow = _WORD.match(text, m)
                return bool(follow) and follow[0].lower() in _STARTERS
            return True
        if len(own) == 1 and own.isalpha() and not _CASELESS.match(own) and own.isupper():
            return False
        if len(own) == 1 and own.isalpha() and _INITIAL.match(text, m):
            return False
        if own.isdigit() and len(own) <= 2:
            follow = _WORD.match(text, m)
            if follow and follow[0].lower() in _MONTHS:
                return False
    return not _goes_on(text, m)


def _close_ends(text: str, begin: int, opened: int, at: int, after: int, end: int) -> bool:
    """Whether a mark opened at ``opened`` and closed at ``at``, with a terminator before it, ends the sentence."""
    if text[opened] in BRACKETS:
        return opened == begin
    if after >= end:
        return True
    m = after
    while m < end and text[m].isspace():
        m += 1
    if m >= end:
        return True
    if _goes_on(text, m) or text[m] in _CLOSERS and text[m] not in _OPENERS:
        return False
    if text[m] in "と":
        return False
    k = opened - 1
    while k >= begin and text[k].isspace():
        k -= 1
    if k >= begin and text[k] in ":：,،，":
        return True
    if _CASELESS.match(text, m) or _CASELESS.match(text, max(opened - 1, begin)):
        # without letter case: a quotation at the beginning is followed by its speaker
        return m > after and opened != begin
    return m > after


def _paragraph(text: str, start: int, end: int, out: list[tuple[int, int]]) -> None:
    """Sentences of text[start:end], a paragraph."""
    while start < end and text[start].isspace():
        start += 1
    while end > start and text[end - 1].isspace():
        end -= 1
    if start >= end:
        return
    cuts: list[int] = []
    begin = start
    gaps: list[int] = []
    if _THAI.search(text, start, end):
        gaps = [m.start() for m in _THAI_GAP.finditer(text, start, end)]
    stack: list[tuple[str, int]] = []
    marked = _MARKS.search(text, start, end) is not None
    skip = start
    gap = 0
    for event in (_EVENT if marked else _STOPS).finditer(text, start, end):
        s, e = event.span()
        while gap < len(gaps) and gaps[gap] < s:
            if not stack and gaps[gap] >= skip:
                begin = _cut(text, gaps[gap], end, cuts)
            gap += 1
        if s < skip:
            continue
        c = text[s]
        if c in _TERMINATORS:
            if stack:
                continue
            after = _TAIL.match(text, e, end).end()
            if after < end and text[after] in '"”»' and not text[after + 1 : after + 2].isalnum() and text[after] != '"':
                after += 1
            if _stop_ends(text, begin, s, e, after, end):
                begin = _cut(text, after, end, cuts)
                skip = after
            continue
        if stack and c == stack[-1][0]:
            opened = stack.pop()[1]
            if not stack:
                k = s - 1
                while k > opened and (text[k].isspace() or text[k] in "'’" or text[k] in _CLOSERS):
                    k -= 1
                if text[k] in _TERMINATORS:
                    after = _TAIL.match(text, s + 1, end).end()
                    if _close_ends(text, begin, opened, s, after, end):
                        begin = _cut(text, after, end, cuts)
                        skip = after
            continue
        close = PAIRS.get(c)
        if close and not (c == '"' and s > start and text[s - 1].isalnum()) and text.find(close, s + 1, end) > 0:
            stack.append((close, s))
    while gap < len(gaps):
        if not stack and gaps[gap] >= skip:
            begin = _cut(text, gaps[gap], end, cuts)
        gap += 1
    begin = start
    for cut in cuts:
        _unit(text, begin, cut, out)
        begin = cut
    _unit(text, begin, end, out)


def _cut(text: str, at: int, end: int, cuts: list[int]) -> int:
    """End a sentence at ``at``; gives where the next one begins."""
    cuts.append(at)
    while at < end and text[at].isspace():
        at += 1
    return at


def _unit(text: str, start: int, end: int, out: list[tuple[int, int]]) -> None:
    while start < end and text[start].isspace():
        start += 1
    while end > start and text[end - 1].isspace():
        end -= 1
    if start < end:
        out.append((start, end))


def _mended(match: re.Match) -> str:
    """The mark that a damaged or escaped one stands for, filled up to the same length."""
    own = match[0]
    mark = "«" if own == "&laquo;" else "»" if own == "&raquo;" else "’" if own[-1] in "™˜" or own in ("&apos;", "&#39;", "&#x27;", "&rsquo;", "&lsquo;") else '"'
    return mark + _FILL * (len(own) - 1)


def _indent(line: str) -> int:
    wide = line.expandtabs(4)
    return len(wide) - len(wide.lstrip())


def _item(text: str, start: int, end: int, depth: int, outer: list[tuple[int, int]], out: list[tuple[int, int]]) -> None:
    """Units of a list item with lines that aren't indented: where one follows a finished sentence, the item ends; it belongs to an outer item or is prose."""
    spans: list[tuple[int, int]] = []
    _paragraph(text, start, end, spans)
    begins = {a for a, _ in spans}
    for at, held in outer:
        first = at
        while text[first].isspace():
            first += 1
        if first in begins and held < depth:
            _unit(text, start, at, out)
            start, depth = at, held
            if not held:
                _paragraph(text, start, end, out)
                return
    _unit(text, start, end, out)


def sentences(text: str | None) -> list[tuple[int, int]]:
    """Start and end (exclusive, in code points) of each unit of ``text``."""
    out: list[tuple[int, int]] = []
    if not text or text.isspace():
        return out
    if "&" in text or "â€" in text:
        text = _DAMAGED.sub(_mended, text)
    state, begin, fence, lines = "", 0, "", 0
    # indentations of the open list levels, and lines of an item no further in than its mark: start and levels that hold them
    levels: list[int] = []
    outer: list[tuple[int, int]] = []

    def close(at: int) -> None:
        nonlocal state
        if state == "prose":
            if lines == 1 and _NUMBERED.match(text, begin, at):
                _unit(text, begin, at, out)
            else:
                _paragraph(text, begin, at, out)
        elif state == "item" and outer:
            _item(text, begin, at, len(levels), outer, out)
        elif state:
            _unit(text, begin, at, out)
        state = ""

    before = ""
    for match in _LINE.finditer(text):
        s, e = match.span()
        if s == e:
            break
        if state == "code":
            if text[s:e].strip().startswith(fence) and not text[s:e].strip().strip(fence[0]):
                close(e)
            continue
        line = text[s:e]
        if not line.strip():
            close(s)
            before = ""
            continue
        opens = _FENCE.match(line)
        if opens:
            close(s)
            state, begin, fence = "code", s, opens[1]
        elif _HEADING.match(line):
            close(s)
            _unit(text, s, e, out)
        elif _BULLET.match(line) or _COUNTED.match(line) and (state in ("", "item") or before.endswith((":", "："))):
            close(s)
            state, begin, outer = "item", s, []
            depth = _indent(line)
            levels = [*(x for x in levels if x < depth), depth]
        elif state == "item" or state == "prose":
            lines += 1
            if state == "item" and _indent(line) <= levels[-1]:
                outer.append((s, sum(x < _indent(line) for x in levels)))
        else:
            state, begin, lines, levels = "prose", s, 1, []
        before = line.rstrip()
    close(len(text))
    return out


def split_sentences(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns ``key``, ``sent_no`` (from 1), ``sent_start`` and ``sent_end`` (code points, end exclusive) for each unit of each document.

    Null, empty and blank texts have no units; a repeated document has its units
    under each of its rows; null ids are kept; other columns are ignored. The
    work is one pass without a shuffle, whatever the texts' lengths.
    """
    kind = dict(documents.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id")
            rows: list[int] = []
            numbers: list[int] = []
            spans: list[tuple[int, int]] = []
            for i, t in enumerate(batch.column("text").to_pylist()):
                units = sentences(t)
                rows += [i] * len(units)
                numbers += range(1, len(units) + 1)
                spans += units
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int32()), pa.array([a for a, _ in spans], pa.int32()), pa.array([b for _, b in spans], pa.int32())],
                ["id", "sent_no", "sent_start", "sent_end"],
            )

    named = documents.select(F.col(key).alias("id"), F.col(text).alias("text")).where("text is not null")
    return named.mapInArrow(run, f"id {kind}, sent_no int, sent_start int, sent_end int").withColumnRenamed("id", key)
