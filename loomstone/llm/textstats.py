"""Statistics of many texts at once, as array operations over their code points.

A batch of texts is one array of code points. A table gives each its character
classes; runs of a class are tokens, words, lines and cells; what a run holds is a
difference of two running totals. No text, line or word is handled by itself.
"""

from __future__ import annotations

import unicodedata

import numpy as np

from loomstone.llm.wordgrams import _powers, mix

# Common words by language, navigation words, articles, words that can't follow an article.
COMMON = {
    "en": "the a an of to and in is was were for that it its on at by with from as be are but or who why what how when where than then there they we he she i you if so no not which about before because after over under between each every only some most few many had has have will would can into one out up this these those his her their our all more do does did been being",
    "de": "der die das und ist wird wurde hat für von zu mit den dem des ein eine einen einer im in am an auf nicht als auch es er sie wir ich bleibt aber denn warum bei nach noch sich dass so wie oder um aus seit trotz mehr",
    "fr": "le la les de des du et est un une que qui pour dans par sur avec au aux en il elle ne pas plus se son sa ses ce cette car mais pourquoi dit a selon chaque",
    "es": "el la los las de del y en es un una que por para con se lo al su sus no más como pero porque ya sin desde entre cada qué dijo dice está sobre",
    "ru": "и в на не что как за из по с для от к у о он она но или это так же мы вы бы потому чем если г до при без его её",
}
MENU = "home login logout search menu share next previous top more print cart terms archive subscribe comments tags about contact help sitemap register account shop news blog faq privacy policy cookies accept back forward close open follow like reply sign up in submit download upload settings profile language rss feed categories links skip navigation toggle sidebar footer header checkout wishlist read all view post page"
ARTICLES = "the a an le les un une du des el los las una der das den dem ein eine"
NO_NOUNS = "the a an of in to and is was were for by with from as are but or at on der die das den dem des und ist ein eine im le la les de des du et un une el los las y en por para con и в на не из для"
LEVELS = "info warn warning error debug trace fatal"
CELL_TAGS = "table tr td th tbody thead"
COUNTED = "step item no nr"
CONJUNCTIONS = "and und et y и"

_NAMES = "space break alpha digit word punct wide own odd vowel consonant term term_line wide_term closer closer_line upper lower bullet hex hex_letter number code mark_strip cell_strip unseen letter part_sep cell_sep pair_left pair_right ascii".split()
_BIT = {name: np.uint32(1 << i) for i, name in enumerate(_NAMES)}
_MARKS = ";,\t|:/"


def _within(c: int, *spans: tuple[int, int]) -> bool:
    return any(a <= c <= b for a, b in spans)


def _classes(c: int) -> int:
    ch = chr(c)
    kind = unicodedata.category(ch)
    alnum, digit, space = ch.isalnum(), kind == "Nd", ch.isspace()
    has = {
        "space": space,
        "break": ch in "\n\r\x0b\x0c\x1c\x1d\x1e\x85  ",
        "alpha": alnum and not digit,
        "digit": digit,
        "word": alnum or ch == "_",
        "punct": not space and not alnum,
        "wide": _within(c, (0x3040, 0x30FF), (0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x0E00, 0x0E7F)),
        "own": _within(c, (0x0400, 0x04FF), (0x0590, 0x06FF), (0x0900, 0x0DFF), (0x0E00, 0x0E7F), (0x3040, 0x30FF), (0x4E00, 0x9FFF), (0xAC00, 0xD7AF)),
        "odd": _within(c, (0x80, 0xBF), (0xD0, 0xD1), (0x2018, 0x2026)) or ch in "ŒœŠšŸŽžƒˆ˜‰‹›€™�ÂÃâï",
        "vowel": ch in "aeiouyàáâäæèéêëìíîïòóôöùúûüœ",
        "consonant": ch in "bcdfghjklmnpqrstvwxz",
        "term": ch in ".!?…",
        "term_line": ch in ".!?…。！？｡।॥؟۔",
        "wide_term": ch in "。！？।؟۔",
        "closer": ch in "\"'”’»)]",
        "closer_line": digit or ch in "\"'”’»)]」』[",
        "upper": alnum and not "a" <= ch <= "z",
        "lower": ch.islower(),
        "bullet": ch in "-*+•·▪◦‣●○■□➤►✓✔–—>",
        "hex": ch in "0123456789abcdefABCDEF",
        "hex_letter": ch in "abcdefABCDEF",
        "number": digit or ch in ".,:%/e+-",
        "code": ch in "{}();=&|!$<>[]\\",
        "mark_strip": ch in "|;,",
        "cell_strip": ch in ".,;:!?()[]\"'«»“”",
        "unseen": space or _within(c, (0x200B, 0x200F)) or ch in "⁠﻿",
        "letter": alnum and not digit or _within(c, (0x0900, 0x0E7F)),
        "part_sep": ch in ",;、，；،·•/|",
        "cell_sep": ch in "»›·•|>/→",
        "pair_left": alnum or ch in "_.-",
        "pair_right": alnum or ch in "_.-%+",
        "ascii": c < 128,
    }
    return sum(int(_BIT[name]) for name, holds in has.items() if holds)


_tables: list[np.ndarray] = []


def _table() -> tuple[np.ndarray, np.ndarray]:
    """Classes and lower case of each code point of the basic plane; beyond it of ideographs and letters (one row) and of symbols (another)."""
    if not _tables:
        flags = np.array([*map(_classes, range(0x10000)), _classes(0x20000), _classes(0x1F600)], dtype=np.uint32)
        lower = np.arange(0x10002, dtype=np.uint32)
        for c in range(0x10000):
            small = chr(c).lower()
            if len(small) == 1:
                lower[c] = ord(small)
        _tables.extend([flags, lower])
    return _tables[0], _tables[1]


def _cum(flag: np.ndarray) -> np.ndarray:
    out = np.zeros(len(flag) + 1, dtype=np.int32)
    np.cumsum(flag, out=out[1:], dtype=np.int32)
    return out


def _any(values: np.ndarray, letters: str) -> np.ndarray:
    """Where a code point is one of a few letters."""
    found = values == ord(letters[0])
    for letter in letters[1:]:
        found |= values == ord(letter)
    return found


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(mask.view(np.int8), prepend=0, append=0))
    return edges[0::2], edges[1::2]


def _last(mask: np.ndarray) -> np.ndarray:
    """At each place the last place up to it where the mask holds, or -1."""
    return np.maximum.accumulate(np.where(mask, np.arange(len(mask), dtype=np.int32), np.int32(-1)))


def _next(mask: np.ndarray) -> np.ndarray:
    """At each place, and one past the end, the next place from it on where the mask holds, or the end."""
    at = np.full(len(mask) + 1, len(mask), dtype=np.int32)
    at[:-1][mask] = np.flatnonzero(mask)
    return np.minimum.accumulate(at[::-1])[::-1]


class _Hash:
    """Hashes of runs of an array, equal for equal runs wherever they stand."""

    def __init__(self, values: np.ndarray) -> None:
        power, self.inverse = _powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * power[:-1], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


_sets: dict[str, np.ndarray] = {}


def _member(hashes: np.ndarray, words: str) -> np.ndarray:
    if words not in _sets:
        own = [_points(w) for w in dict.fromkeys(words.split())]
        _sets[words] = np.sort(np.array([_Hash(p)(np.array([0]), np.array([len(p)]))[0] for p in own], dtype=np.uint64))
    known = _sets[words]
    return known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes


def _kinds(hashes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each owner how many different hashes it has, and how often its commonest occurs."""
    keys = mix(hashes + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first, count = np.unique(keys, return_index=True, return_counts=True)
    most = np.zeros(n, dtype=np.int64)
    np.maximum.at(most, owner[first], count)
    return np.bincount(owner[first], minlength=n), most


_ALL_COMMON = " ".join(COMMON.values())


def statistics(texts: list[str]) -> dict[str, np.ndarray]:
    """Each statistic as an array with a value for each text."""
    n = len(texts)
    size = np.array([len(t) for t in texts], dtype=np.int64)
    cps = _points("\n".join(texts) + "\n")
    t1 = np.cumsum(size + 1) - 1
    t0 = t1 - size
    table, lower = _table()
    spot = np.where(cps < 0x10000, cps, np.where((cps >= 0x20000) & (cps < 0x40000) | (cps >= 0x1D400) & (cps < 0x1D800), 0x10000, 0x10001))
    flags = table[spot]
    low = np.where(cps < 0x10000, lower[np.minimum(spot, 0xFFFF)], cps)
    total = len(cps)
    owner = np.repeat(np.arange(n, dtype=np.int32), size + 1)
    has = lambda name: (flags & _BIT[name]) != 0
    sums: dict[str, np.ndarray] = {}

    def held(name: str, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """How many characters of a class a run holds."""
        if name not in sums:
            sums[name] = _cum(has(name))
        return sums[name][e] - sums[name][s]

    def char(at: np.ndarray, shift: int = 0) -> np.ndarray:
        at = at + shift
        return np.where((at >= 0) & (at < total), cps[np.clip(at, 0, total - 1)], 10)

    def is_char(at: np.ndarray, letters: str) -> np.ndarray:
        return _any(char(at), letters)

    def of(name: str, at: np.ndarray) -> np.ndarray:
        return ((at >= 0) & (at < total)) & ((flags[np.clip(at, 0, total - 1)] & _BIT[name]) != 0)

    space, alpha, digit = has("space"), has("alpha"), has("digit")
    solid = ~space
    hashed = _Hash(low)

    # tokens, words and runs of letters
    ts, te = _runs(solid)
    tt = owner[ts]
    token_at = np.zeros(total, dtype=bool)
    token_at[ts] = True
    c_token = _cum(token_at)
    joiner = _any(cps, "'’-")
    joiner[1:-1] &= alpha[:-2] & alpha[2:]
    joiner[[0, -1]] = False
    ws, we = _runs(alpha | joiner)
    wt, wh = owner[ws], hashed(ws, we)
    plain_s, plain_e = _runs(alpha)
    plain_h = hashed(plain_s, plain_e)

    def at_words(flag: np.ndarray) -> np.ndarray:
        marked = np.zeros(total, dtype=bool)
        marked[ws[flag]] = True
        return _cum(marked)

    common, menu = _member(wh, _ALL_COMMON), _member(wh, MENU)
    c_word, c_common, c_menu = at_words(np.ones(len(ws), dtype=bool)), at_words(common), at_words(menu)
    n_tokens = np.bincount(tt, minlength=n)
    n_words = np.bincount(wt, minlength=n)
    n1, w1 = np.maximum(1, n_tokens), np.maximum(1, n_words)

    def number(s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """A number in any notation: sign or currency, a digit, digits and marks, a closing mark."""
        b = s + is_char(s, "-+$€£(")
        last = e - (is_char(e - 1, ")") & (e - 1 > b))
        return (b < last) & of("digit", b) & (held("number", np.minimum(b, last), last) == last - b)

    # sentences that end inside a line, told at the next token's beginning
    not_closer = _last(~has("closer"))
    stop = np.zeros(len(ts), dtype=bool)
    if len(ts):
        p = not_closer[te - 1]
        stop = (p >= ts) & of("term", p)
    follows = np.zeros(total, dtype=bool)
    if len(ts) > 1:
        inner = stop[:-1] & of("upper", ts[1:]) & (tt[1:] == tt[:-1])
        follows[ts[1:][inner]] = True
    c_follow = _cum(follows)
    at_line_start = lambda s, e: c_follow[e] - c_follow[np.minimum(s + 1, e)] + held("wide_term", s, e)

    # lines that aren't blank: trimmed and whole
    raw_s, raw_e = _runs(~has("break"))
    next_solid, last_solid = _next(solid), _last(solid)
    ls = next_solid[raw_s]
    real = ls < raw_e
    raw_s, raw_e, ls = raw_s[real], raw_e[real], ls[real]
    le = last_solid[raw_e - 1] + 1
    lt = owner[ls]
    n_lines = np.bincount(lt, minlength=n)
    l1 = np.maximum(1, n_lines)
    line_sum = lambda x: np.bincount(lt, weights=x, minlength=n)
    first_line = np.ones(len(lt), dtype=bool)
    first_line[1:] = lt[1:] != lt[:-1]
    length = le - ls
    l_tokens = c_token[le] - c_token[ls]
    tail = _last(~has("closer_line"))[le - 1] if len(le) else le
    ended = (tail >= ls) & of("term_line", tail)

    def sentence_like(s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Reads as a sentence or as a part of one; the runs end where lines end."""
        w, c, wide = c_word[e] - c_word[s], c_common[e] - c_common[s], held("wide", s, e)
        share = c / np.maximum(1, w)
        native = (held("own", s, e) > 0) & (share < 0.1)
        plain = ended & ((share >= 0.2) | native | (w >= 7)) & (w >= 5) | (w >= 9) & ((share >= 0.25) | native)
        return np.where(wide > 0, (at_line_start(s, e) > 0) | (wide > 40), (w >= 4) & plain)

    # markers of list items, and where the item's text begins
    line_token = np.searchsorted(ts, ls)
    first_e = te[line_token] if len(ls) else ls
    span = first_e - ls
    mark = held("bullet", ls, first_e) == span
    mark |= is_char(ls, "[") & ((span == 2) & is_char(ls + 1, "]") | (span == 3) & is_char(ls + 1, "xX✓") & is_char(ls + 2, "]"))
    b = ls + is_char(ls, "(")
    digits = np.zeros(len(ls), dtype=np.int64)
    roman = np.zeros(len(ls), dtype=np.int64)
    for k in range(5):
        if k < 3:
            digits += (digits == k) & of("digit", b + k)
        roman += (roman == k) & is_char(b + k, "ivxIVX")
    mark |= (digits > 0) & (first_e == b + digits + 1) & is_char(first_e - 1, ".):")
    mark |= of("alpha", b) & of("ascii", b) & (first_e == b + 2) & is_char(b + 1, ".)")
    mark |= (roman > 0) & (first_e == b + roman + 1) & is_char(first_e - 1, ".)")
    mark |= is_char(ls, "#") & (span > 1) & (held("digit", ls, first_e) == span - 1)
    begin = next_solid[np.minimum(first_e, total)]
    mark &= begin < le
    # two tokens: "[ ]", "step 3:"
    two = line_token + 1
    second_e = te[np.minimum(two, len(te) - 1)] if len(ts) else ls
    second_s = ts[np.minimum(two, len(ts) - 1)] if len(ts) else ls
    more = l_tokens >= 3
    box = more & (span == 1) & is_char(ls, "[") & (second_e - second_s == 1) & is_char(second_s, "]")
    alpha_end = _next(~alpha)[ls]
    named = _member(hashed(ls, alpha_end), COUNTED) & (alpha_end > ls) if len(ls) else mark
    dotted = first_e - alpha_end == is_char(alpha_end, ".").astype(np.int64)
    counted_e = second_e - is_char(second_e - 1, ".:)")
    step = more & named & dotted & (counted_e > second_s) & (held("digit", second_s, counted_e) == counted_e - second_s)
    glued_e = first_e - is_char(first_e - 1, ".:)")
    glued = named & (l_tokens >= 2) & (glued_e > alpha_end) & (held("digit", alpha_end, glued_e) == glued_e - alpha_end)
    begin = np.where(box | step, next_solid[np.minimum(second_e, total)], begin)
    marker = mark | box | step | glued
    rest_like = sentence_like(np.where(marker, np.minimum(begin, le), ls), le)
    own_like = sentence_like(ls, le)

    # leaders of contents pages: dots, spaces or rules before a number at the line's end
    number_s = _last(~digit)[le - 1] + 1 if len(le) else le
    q = last_solid[np.maximum(number_s - 1, 0)] + 1
    q = np.where(number_s > ls, np.maximum(q, ls), ls)
    dots = _any(cps, ".")
    lead = _last(~(dots | space))[np.maximum(q - 1, 0)]
    c_dots = _cum(dots)
    many_dots = c_dots[q] - c_dots[np.minimum(np.maximum(lead + 1, ls), q)] >= 4
    ruled = lambda letter, least: q - np.maximum(_last(cps != ord(letter))[np.maximum(q - 1, 0)] + 1, ls) >= least
    leader = (number_s < le) & (number_s > ls) & (many_dots | (number_s - q >= 3) & (le - number_s <= 4) | ruled("…", 2) | ruled("_", 4))

    # rows of tables
    trim_s, trim_e = _next(~has("mark_strip"))[ts], _last(~has("mark_strip"))[te - 1] + 1 if len(ts) else te
    numeric = (trim_s < trim_e) & (trim_s < te) & (trim_e > ts) & number(np.minimum(trim_s, te), np.maximum(trim_e, ts))
    marked_numbers = np.zeros(total, dtype=bool)
    marked_numbers[ts[numeric]] = True
    c_numeric = _cum(marked_numbers)
    l_numeric = c_numeric[le] - c_numeric[ls]
    bars = _cum(cps == ord("|"))
    angle = np.flatnonzero(cps == ord("<"))
    tag_name = angle + 1 + (char(angle, 1) == ord("/"))
    name_e = _next(~alpha)[np.minimum(tag_name, total)]
    is_cell = _member(hashed(np.minimum(tag_name, total), np.maximum(name_e, np.minimum(tag_name, total))), CELL_TAGS) if len(angle) else np.zeros(0, dtype=bool)
    cell_at = np.zeros(total, dtype=bool)
    cell_at[angle[is_cell]] = True
    c_cell = _cum(cell_at)
    head = ls + is_char(ls, "[")
    shape = lambda *steps: np.logical_and.reduce([of("digit", head + i) if k == "d" else of("word", head + i) if k == "w" else is_char(head + i, k) for i, k in enumerate(steps)])
    stamp = shape("d", "d", "d", "d", "-/", "d", "d", "-/", "d", "d") | shape("d", "d", ":", "d", "d", ":", "d", "d") | shape("d", "d", "/", "w", "w", "w", "/", "d", "d", "d", "d")
    capital = _member(plain_h, LEVELS) & (cps[plain_s] != low[plain_s]) & (char(plain_e, -1) != np.where(plain_e > 0, low[plain_e - 1], 10)) & ~of("word", plain_s - 1) & (of("space", plain_e) | is_char(plain_e, ":]"))
    level_at = np.zeros(total, dtype=bool)
    level_at[plain_s[capital]] = True
    c_level = _cum(level_at)
    logged = stamp | (c_level[le] > c_level[ls])
    # key=value and key: value
    sep = np.flatnonzero(_any(cps, "=:"))
    left_e = sep - of("space", sep - 1)
    right_s = sep + 1 + of("space", sep + 1)
    pair = of("pair_left", left_e - 1) & of("pair_right", right_s)
    sep, left_e, right_s = sep[pair], left_e[pair], right_s[pair]
    left_s = _last(~has("pair_left"))[left_e - 1] + 1
    right_e = _next(~has("pair_right"))[right_s]
    overlap = np.zeros(len(sep), dtype=bool)
    overlap[1:] = left_s[1:] < right_e[:-1]
    chain = np.flatnonzero(~overlap)
    in_chain = np.arange(len(sep)) - (chain[np.searchsorted(chain, np.arange(len(sep)), "right") - 1] if len(sep) else 0)
    keep = in_chain % 2 == 0
    pair_at = np.zeros(total, dtype=np.int64)
    pair_size = np.zeros(total, dtype=np.int64)
    pair_at[sep[keep]], pair_size[sep[keep]] = 1, (right_e - left_s)[keep]
    c_pair, c_pair_size = _cum(pair_at), _cum(pair_size)
    blanks = _cum(cps == 32)
    keyed = (c_pair[le] - c_pair[ls] >= 2) & (c_pair_size[le] - c_pair_size[ls] >= 0.6 * (raw_e - raw_s - blanks[raw_e] + blanks[raw_s]))
    # columns apart by tabs or several spaces
    tabs = _cum(cps == 9)
    gap_at = np.zeros(total, dtype=bool)
    if len(ts) > 1:
        gap_s, gap_e = te[:-1], ts[1:]
        wide_gap = (tabs[gap_e] > tabs[gap_s]) | (blanks[gap_e] - blanks[gap_s] >= 2)
        gap_at[gap_e[wide_gap]] = True
    c_gap = _cum(gap_at)
    fields = 1 + c_gap[le] - c_gap[np.minimum(ls + 1, le)]
    columns = (fields >= 3) & (l_tokens <= 3.5 * fields)

    def cells(mark_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Runs of lines between separators: beginning, end (trimmed), line, pieces between spaces."""
        inside = ~mark_of & ~has("break")
        s, e = _runs(inside)
        starts = solid & inside
        starts[1:] &= ~(solid & inside)[:-1]
        c = _cum(starts)
        s2, e2 = next_solid[s], last_solid[e - 1] + 1
        line = np.searchsorted(raw_s, s, "right") - 1
        ok = (line >= 0) & (s < raw_e[np.maximum(line, 0)]) if len(raw_s) else np.zeros(len(s), dtype=bool)
        s, e, s2, e2, line = s[ok], e[ok], s2[ok], e2[ok], line[ok]
        return np.minimum(s2, e), np.maximum(np.minimum(e2, e), np.minimum(s2, e)), line, c[e] - c[s]

    listed = np.zeros(len(ls), dtype=bool)
    mark_counts: dict[str, np.ndarray] = {}
    mark_pieces: dict[str, np.ndarray] = {}
    for letter in _MARKS:
        own = cps == ord(letter)
        c_own = _cum(own)
        mark_counts[letter] = c_own[raw_e] - c_own[raw_s]
        s, e, line, pieces = cells(own)
        mark_pieces[letter] = np.bincount(line, weights=pieces, minlength=len(ls))
        if letter in ";,":
            numbers = np.bincount(line[number(s, e)], minlength=len(ls))
            most = np.zeros(len(ls), dtype=np.int64)
            np.maximum.at(most, line, pieces)
            count = mark_counts[letter] + 1
            listed |= (count >= 3) & (numbers > 0) & (numbers >= 0.34 * count) & (most <= 4)
    row = (bars[le] - bars[ls] >= 2) | (c_cell[le] > c_cell[ls]) | logged | (l_tokens >= 3) & (l_numeric >= 0.45 * l_tokens) | keyed | columns | listed

    # an introductory sentence counts for neither side
    l_inner = at_line_start(ls, le)
    intro = first_line & (n_lines[lt] > 2) & ~marker & ~row & (l_inner <= 1) & own_like
    body = ~intro
    n_body = line_sum(body)
    body1 = np.maximum(1, n_body)

    def delimited(lines: np.ndarray) -> np.ndarray:
        """Texts whose lines hold the same number of one delimiter, at least two, between short cells."""
        own = np.flatnonzero(lines)
        t = lt[own]
        many = np.bincount(t, minlength=n)
        start = np.cumsum(many) - many
        nth = np.arange(len(own)) - start[t]
        early_end = np.bincount(t[(nth < 3) & ended[own]], minlength=n) > 0
        found = np.zeros(n, dtype=bool)
        for letter in _MARKS:
            count = mark_counts[letter][own]
            order = np.lexsort((count, t))
            middle = np.zeros(n, dtype=np.int64)
            some = many > 0
            middle[some] = count[order][(start + many // 2)[some]]
            same = np.bincount(t[count == middle[t]], minlength=n)
            in_cells = np.bincount(t, weights=mark_pieces[letter][own], minlength=n)
            found |= (many >= 3) & (middle >= 2) & (same >= 0.8 * many) & (in_cells <= 3 * np.bincount(t, weights=count + 1, minlength=n))
        return found & ~early_end

    # tags
    closing = np.append(np.flatnonzero(cps == ord(">")), total)
    tag_e = closing[np.searchsorted(closing, angle)]
    opening = np.append(angle, total)
    clear = (tag_e < opening[1:]) & (tag_e - angle - 1 >= 1) & (tag_e - angle - 1 <= 300) & (tag_e < total)
    breaks = _cum(cps == 10)
    clear &= breaks[np.minimum(tag_e, total)] == breaks[angle]
    c_solid = _cum(solid)
    tagged = np.bincount(owner[angle[clear]], weights=(c_solid[np.minimum(tag_e + 1, total)] - c_solid[angle])[clear], minlength=n)
    td = (char(angle, 1) | 32) == ord("t")
    td &= np.isin(char(angle, 2) | 32, _points("dh")) & ~of("alpha", angle + 3)
    body_start = t0.copy()
    body_start[lt[intro]] = raw_e[intro]

    # separators of enumerations
    part = has("part_sep")
    conj = np.flatnonzero(_member(plain_h, CONJUNCTIONS) & of("space", plain_s - 1) & of("space", plain_e))
    shut = np.flatnonzero((cps == ord(")")) & np.concatenate([[False], digit[:-1]]))
    open_digit = _last(~digit)[np.maximum(shut - 1, 0)]
    blank_out = np.zeros(total + 1, dtype=np.int64)
    for s, e in ((plain_s[conj], plain_e[conj]), (np.where(is_char(open_digit, "("), open_digit, shut - 1), shut + 1), (raw_s[intro], raw_e[intro])):
        np.add.at(blank_out, s, 1)
        np.add.at(blank_out, e, -1)
    part |= np.cumsum(blank_out[:-1]) > 0
    part[t1] = True
    ps, pe = _runs(~part)
    starts = solid & ~part
    starts[1:] &= ~(solid & ~part)[:-1]
    c_start = _cum(starts)
    pieces = c_start[pe] - c_start[ps]
    ps, pe, pieces = ps[pieces > 0], pe[pieces > 0], pieces[pieces > 0]
    part_t = owner[ps]
    part_size = last_solid[pe - 1] + 1 - next_solid[ps]
    n_parts = np.bincount(part_t, minlength=n)
    p1 = np.maximum(1, n_parts)

    # cells of menus
    menu_sep = has("cell_sep")
    colon = cps == ord(":")
    double = np.zeros(total, dtype=bool)
    double[:-1] = colon[:-1] & colon[1:]
    dash = np.zeros(total, dtype=bool)
    dash[1:-1] = (cps[1:-1] == ord("-")) & space[:-2] & space[2:]
    n_seps = lambda m: (c := _cum(m))[t1] - c[t0]
    separators = n_seps(menu_sep | double | dash)
    both = menu_sep | double | dash
    both[1:] |= double[:-1]
    ms, me, _, menu_pieces = cells(both)
    filled = menu_pieces > 0
    ms, me, menu_pieces = ms[filled], me[filled], menu_pieces[filled]
    cell_t = owner[ms]
    n_cells = np.bincount(cell_t, minlength=n)
    k1 = np.maximum(1, n_cells)

    # letters that stand together as no language has them
    low_flags = table[np.where(low < 0x10000, low, 0x10001)]
    consonant = (low_flags & _BIT["consonant"]) != 0
    four = np.zeros(total, dtype=bool)
    if total > 4:
        four[:-3] = consonant[:-3] & consonant[1:-2] & consonant[2:-1] & consonant[3:]
    c_four = _cum(four)
    vowels = _cum((low_flags & _BIT["vowel"]) != 0)
    latin = (we - ws > 2) & (held("ascii", ws, we) == we - ws)
    clumsy = (c_four[np.maximum(we - 3, ws)] > c_four[ws]) | (vowels[we] == vowels[ws])
    n_latin = np.bincount(wt[latin], minlength=n)

    # what follows an article
    article = np.flatnonzero(_member(plain_h, ARTICLES))
    event = alpha.copy()
    event[1:] &= ~alpha[:-1]
    comma = _any(cps, ".,;:!?")
    after = _next(event | digit | comma)[plain_e[article]]
    inside = after < t1[owner[plain_s[article]]]
    article, after = article[inside], after[inside]
    run_after = np.searchsorted(plain_s, after)
    no_noun = _member(plain_h, NO_NOUNS)
    wrong = comma[after] | (~digit[after] & no_noun[np.minimum(run_after, max(0, len(plain_s) - 1))]) if len(article) else np.zeros(0, dtype=bool)
    article_t = owner[plain_s[article]]

    # repetition
    th = hashed(ts, te)
    token_kinds, _ = _kinds(th, tt, n)
    next_same = tt[1:] == tt[:-1]
    two_h = (th[:-1] * np.uint64(0x9FB21C651E98DF25) + th[1:])[next_same]
    pair_kinds, _ = _kinds(two_h, tt[:-1][next_same], n)
    three_same = wt[2:] == wt[:-2]
    three_h = ((wh[:-2] * np.uint64(0x9FB21C651E98DF25) + wh[1:-1]) * np.uint64(0x9FB21C651E98DF25) + wh[2:])[three_same]
    _, top_phrase = _kinds(three_h, wt[:-2][three_same], n)
    line_kinds, _ = _kinds(_Hash(cps)(ls, le), lt, n)
    wide_n = held("wide", t0, t1)
    wide_share = wide_n / np.maximum(1, size)
    n_solid = c_solid[t1] - c_solid[t0]
    chosen = (wide_share > 0.2)[owner] & solid
    six = cps[chosen].astype(np.uint64)
    six_t = owner[chosen]
    six_kinds = np.zeros(n, dtype=np.int64)
    if len(six) > 5:
        h = six[:-5].copy()
        for k in range(1, 6):
            h = h * np.uint64(0x9FB21C651E98DF25) + six[k : len(six) - 5 + k]
        ok = six_t[:-5] == six_t[5:]
        six_kinds, _ = _kinds(h[ok], six_t[:-5][ok], n)

    bare = np.maximum(0, _last(~has("cell_strip"))[te - 1] + 1 - _next(~has("cell_strip"))[ts]) if len(ts) else te
    hex_s = ts + np.where(is_char(ts, "0\\") & is_char(ts + 1, "x"), 2, np.where(is_char(ts, "%"), 1, 0))
    hex_s = np.minimum(hex_s, te)
    hexed = (te - hex_s >= 2) & (te - hex_s <= 8) & (held("hex", hex_s, te) == te - hex_s) & ((held("alpha", ts, te) < te - ts) | (te - ts == 2))
    whole_number = number(ts, np.maximum(ts, te - is_char(te - 1, ",;|")))
    slashes = (cps[:-2] == ord(":")) & (cps[1:-1] == ord("/")) & (cps[2:] == ord("/")) if total > 2 else np.zeros(0, dtype=bool)
    link = np.flatnonzero(slashes)
    scheme = _last(~alpha)[np.maximum(link - 1, 0)] + 1
    linked = np.bincount(owner[link[_member(hashed(scheme, np.maximum(link, scheme)), "http https")]], minlength=n) if len(link) else np.zeros(n)
    letters = held("letter", t0, t1)
    body_sum = lambda x: line_sum(x & body)
    first_low = of("lower", ls)
    later = body & ~np.where(n_body[lt] < n_lines[lt], np.concatenate([[False], intro[:-1]]) if len(intro) else intro, first_line)
    short_marked = marker & ~(rest_like & (l_tokens >= 9))
    longest = np.zeros(n, dtype=np.int64)
    np.maximum.at(longest, lt, l_tokens)
    raw = raw_e - raw_s
    hashes = _any(cps, "#…")
    dot_s, dot_e = _runs(dots)
    three_dots = np.bincount(owner[dot_s], weights=(dot_e - dot_s) // 3, minlength=n)
    body_chars = line_sum(np.where(body, length, 0))
    wide_body = np.bincount(lt[body], weights=held("wide", ls, le)[body], minlength=n)
    ellipsis = is_char(le - 1, "…") | is_char(le - 1, ".") & is_char(le - 2, ".") & is_char(le - 3, ".") & (length >= 3)
    return {
        "n_chars": size,
        "n_words": n_tokens + wide_n // 2,
        "n_lines": n_lines,
        "word_length": np.bincount(tt, weights=bare, minlength=n) / n1,
        "symbol_ratio": (n_seps(hashes) + three_dots) / n1,
        "letter_share": letters / np.maximum(1, size),
        "punctuation_ratio": held("punct", t0, t1) / np.maximum(1, size),
        "bullet_share": line_sum(marker) / l1,
        "ellipsis_share": line_sum(ellipsis) / l1,
        "ending_share": line_sum(ended) / l1,
        "lettered_share": np.bincount(tt, weights=held("alpha", ts, te) > 0, minlength=n) / n1,
        "number_share": np.bincount(tt, weights=whole_number, minlength=n) / n1,
        "common_share": np.bincount(wt, weights=common, minlength=n) / w1,
        "common_kinds": _kinds(wh[common], wt[common], n)[0],
        "repeated_lines": 1 - line_kinds / l1,
        "top_phrase": np.where(n_words >= 12, top_phrase * 3 / w1, 0.0),
        "wide_share": wide_share,
        # of the lines after an introduction
        "body_lines": n_body,
        "row_share": line_sum(np.where(row & body, length, 0)) / np.maximum(1, body_chars),
        "leaders": body_sum(leader),
        "leader_share": body_sum(leader) / body1,
        "marked_lines": body_sum(marker),
        "marked_share": line_sum(np.where(short_marked & body, raw, 0)) / np.maximum(1, line_sum(np.where(body, raw, 0))),
        "short_share": body_sum(l_tokens <= 7) / body1,
        "short_wide_share": body_sum((length <= 30) & ~ended) / body1,
        "body_ending_share": body_sum(ended) / body1,
        "body_inner_share": body_sum(l_inner > 0) / body1,
        "runs_on_share": line_sum(first_low & later) / body1,
        "tokens_per_line": line_sum(np.where(body, l_tokens, 0)) / body1,
        "body_wide": wide_body,
        "same_delimiter": delimited(body).astype(np.int64),
        "cell_tags": np.bincount(owner[angle[td & (angle >= body_start[owner[angle]])]], minlength=n),
        "parts": n_parts,
        "part_stops": (c_follow[t1] - c_follow[np.minimum(body_start + 1, t1)] + held("wide_term", body_start, t1)) / p1,
        "small_part_share": np.bincount(part_t, weights=pieces <= 6, minlength=n) / p1,
        "small_wide_part_share": np.bincount(part_t, weights=part_size <= 14, minlength=n) / p1,
        "part_tokens": np.bincount(part_t, weights=pieces, minlength=n) / p1,
        # of the whole text
        "solid_chars": n_solid,
        "seen_chars": size - held("unseen", t0, t1),
        "words": n_words,
        "tokens": n_tokens,
        "odd_share": held("odd", t0, t1) / np.maximum(1, n_solid),
        "letter_solid_share": letters / np.maximum(1, n_solid),
        "numeric_share": np.bincount(tt, weights=numeric, minlength=n) / n1,
        "all_delimited": delimited(np.ones(len(lt), dtype=bool)).astype(np.int64),
        "hex_share": np.bincount(tt, weights=hexed, minlength=n) / n1,
        "hex_letters": held("hex_letter", t0, t1) / n1,
        "links": linked,
        "braces": n_seps(_any(cps, "{};")),
        "open_braces": n_seps(cps == ord("{")),
        "angles": n_seps(cps == ord("<")),
        "untagged_share": (n_solid - tagged) / np.maximum(1, n_solid),
        "code_share": held("code", t0, t1) / np.maximum(1, n_solid),
        "all_cell_tags": np.bincount(owner[angle[td]], minlength=n),
        "cell_lines": c_cell[t1] - c_cell[t0],
        "token_kinds": token_kinds / n1,
        "repeated_pairs": (np.maximum(0, n_tokens - 1) - pair_kinds) / n1,
        "wide_kinds": six_kinds / np.maximum(1, n_solid),
        "menu_share": np.bincount(wt, weights=menu, minlength=n) / w1,
        "separators": separators,
        "cells": n_cells,
        "small_cell_share": np.bincount(cell_t, weights=menu_pieces <= 3, minlength=n) / k1,
        "menu_cell_share": np.bincount(cell_t, weights=(c_menu[me] > c_menu[ms]), minlength=n) / k1,
        "latin": n_latin,
        "latin_share": n_latin / w1,
        "clumsy_share": np.bincount(wt[latin & clumsy], minlength=n) / np.maximum(1, n_latin),
        "own_chars": held("own", t0, t1),
        "articles": np.bincount(article_t, minlength=n),
        "wrong_articles": np.bincount(article_t[wrong], minlength=n) / np.maximum(1, np.bincount(article_t, minlength=n)),
        "longest_line": longest,
    }
