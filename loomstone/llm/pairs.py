"""Defective question-answer pairs, by labelling functions under a label model.

For every kind of defect several noisy functions vote for it, against it or not at
all, each by a sign of its own: wording, layout, length, overlap, script, how the
source usually writes, how a word is used in the corpus. No function looks at
another's vote or at another defect. The votes of all pairs are counted by
pattern; expectation maximisation over those counts estimates how common the
defect is and how each function votes on sound and on defective pairs, and gives
each pattern its posterior. A pair gets every label whose posterior exceeds that
defect's cutoff.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.session import cut

# Role labels, placeholders, refusal wording, languages, function words.
USER_LABELS = "user human question instruction prompter customer q input prompt client"
ASSISTANT_LABELS = "assistant ai answer response bot model a output gpt chatbot agent reply"
SYSTEM_LABELS = "system sys context"
PLACEHOLDERS = "none null nil n/a na nan todo tbd tba fixme empty blank undefined missing placeholder nooutput nothing -"
REFUSAL = [
    r"\b(?:can(?:no|')?t|cannot|can not|unable to|not able to|won't|will not|may not|refuse to|decline to|must decline|have to decline|not permitted|not allowed|no permission|not comfortable|don't feel comfortable)\b[^.!?]{0,40}\b(?:help|assist|provide|discuss|comment|answer|answering|reply|write|share|give|giving|talk|continue|go on|do that|comply|fulfil|engage|that)\b",
    r"\b(?:won't be answering|outside (?:of )?my guidelines|against (?:what i am allowed|my (?:guidelines|rules|policy|policies|programming))|blocked by my|my safety rules|i refuse|i must decline|i decline|against my|not something i can|something i won't)\b",
    r"\bas an? (?:ai|language model|ai language model|assistant)\b[^.!?]{0,40}\b(?:can|cannot|can't|unable|not|don't)\b",
    r"\b(?:darf ich|kann ich)\b[^.!?]{0,40}\b(?:nicht|nichts|keine)\b|\btut mir leid\b|\bverweigere\b|\bich (?:kann|darf)\b[^.!?]{0,40}\b(?:nicht|keine)\b",
    r"\bil m'est interdit\b|\bje ne (?:peux|puis|suis) pas\b|\bne suis pas autoris|\bje refuse\b",
    r"\bno me está permitido\b|\bno puedo (?:ayudar|responder|hablar|dar)|\bno estoy autorizad|\bme niego\b",
    r"не могу (?:помочь|ответить|говорить|обсуждать)|мне запрещено|я отказываюсь|не имею права",
    r"无法(?:回答|提供|帮助|协助)|不能(?:回答|提供|帮助)|我拒绝|お答えできません|お手伝いできません|できかねます|ไม่สามารถ(?:ช่วย|ตอบ)|ไม่ได้รับอนุญาต|नहीं कर सकता|अनुमति नहीं|لا أستطيع|لا يمكنني|غير مسموح",
]
REFUSAL_SIGNS = "can't cant cannot can_not unable not_able won't will_not may_not refus declin permi allow comfort guideline against blocked rules something language_model assistant an_ai darf_ich kann_ich leid ich_kann ich_darf verweiger interdit je_ne puedo autoriz niego могу запрещ отказ права 无法 不能 我拒绝 できません かねます ไม่ सकता अनुमति أستطيع يمكنني مسموح"
"""Of these one occurs in every wording above; a cheap test before the patterns."""
SORRY = r"\b(?:sorry|apolog\w+|unfortunately|regret|afraid|leider|désolée?|lo siento|lamento|извините|к сожалению)\b|抱歉|对不起|申し訳|ขออภัย|क्षमा|عذر|آسف"
LANGUAGES = {
    "en": "english englisch anglais inglés английск 英语 英文 英語 अंग्रेज़ी อังกฤษ الإنجليزية",
    "de": "german deutsch allemand alemán немецк 德语 ドイツ語",
    "fr": "french französisch français francés французск 法语 フランス語",
    "es": "spanish spanisch espagnol español испанск 西班牙语 スペイン語",
    "ru": "russian russisch russe ruso русск 俄语 ロシア語",
    "zh": "chinese chinesisch chinois chino mandarin китайск 中文 汉语 中国語",
    "ja": "japanese japanisch japonais japonés японск 日语 日本語",
    "th": "thai thailändisch thaï tailandés тайск 泰语 タイ語 ไทย",
    "hi": "hindi хинди 印地语 ヒンディー हिंदी हिन्दी",
    "ar": "arabic arabisch arabe árabe арабск 阿拉伯语 アラビア العربية",
}
STOPWORDS = {
    "en": "the a an of to and in is was were for that it on at by with from as be are who what why how when which this has have had not but they we you your my me can do does did after before between so if then than into over under out up no more such been being would could should their his her its our these those",
    "de": "der die das und ist wird wurde hat für von zu mit den dem des ein eine einen im am auf nicht als auch es ich denn aber bei seit nach warum wie was kannst du sich sie er wir ihr oder wenn dass noch nur sehr über unter um aus bis durch gegen ohne wer wo jeder seine mehr war sind in so",
    "fr": "le la les de des du et est un une que qui pour dans par sur avec au aux en plus ne pas ce cette ces mais pourquoi dit chaque il elle ils on je à son sa ses leur se sont était a ont ou donc très comme nous vous sans sous entre depuis",
    "es": "el la los las de del y en es un una que por para con se lo al su sus no más como pero porque desde cada qué dijo hay le me si muy todo ya este esta son fue ha sin sobre entre antes hasta donde cuando o a",
}
TRANSLATE = r"\btranslat|\bhow do you say\b|\bput (?:this|it) in(?:to)?\b|\bübersetz|\btradui|\btraduc|перевед|翻译|翻訳|แปล|अनुवाद|ترجم|\b(?:answer|reply|respond|write|explain|say) (?:it |this )?in\b|\bauf (?:englisch|deutsch)|\ben (?:anglais|français|español|inglés)"
REPEAT = r"\b(?:repeat|say after me|copy (?:the|this|out)|word for word|verbatim|exactly as|echo|recite|quote (?:the|this)|write (?:out )?the same|reproduce|wiederhole|répète|recopie|repite|copia|повтори|重复|繰り返|ทวน|दोहरा|كرر)"
FUNCTION_WORDS = "the a an of to and in is was were it they we he she this these has have had will would can could for that by with from as be are at on or but its their his her than then which who whose into beside between over under near because when if while not der die das und ist mit den dem des ein eine von zu im am auf für le la les de des du et est un une que qui pour dans par sur avec el los las del y en es una por con para и в на не с из по для"

CLAUSE_WORDS = "is was were are be been has had have does did do will would can could may might must shall if when because although while since that which who whom whose they we it he she said says made makes went goes came comes became becomes gave gives took takes und oder weil dass ist war wurde hat et est était que qui parce y es era fue porque и не что был была"
COUNT_WORDS = "how many|how much|any left|wie viele|combien|cuánt|сколько"

DEFECTS = ("empty", "truncated", "refusal", "copied", "other_language")
LABELLERS = {
    "empty": ("no_turn", "blank", "placeholder", "no_words", "length", "asked_for"),
    "truncated": ("end_mark", "fence", "dangling", "item_marks", "brackets", "complete", "fragment", "asked_end", "source_habit", "word_habit"),
    "refusal": ("wording", "first_person", "apology", "brevity", "place"),
    "copied": ("inside", "covered", "order", "length", "extra", "asked_for"),
    "other_language": ("language", "script", "letters", "length", "asked_for"),
}
CUTOFFS = {"empty": 0.3, "truncated": 0.35, "refusal": 0.6, "copied": 0.5, "other_language": 0.4}
"""Posteriors above which a label is kept: those that do best on the first half of the labelled pairs of tests/llm/labelled.py."""
PRIOR_SHARE, PRIOR_HIT, PRIOR_ALARM, PRIOR_WEIGHT = 0.05, 0.9, 0.02, 0.02
"""Beginning of EM: share of defective pairs; how often a function that votes votes for the defect on defective and on sound pairs; the weight of that belief as a share of the pairs on which a function votes."""
WEAK, WEAK_HIT, WEAK_ALARM = frozenset("script length brevity place apology fragment letters brackets".split()), 0.6, 0.3
"""Functions of which less is believed at the beginning."""
LEAST = 0.005
"""No function is believed to be wrong less often than so."""
USUAL, SELDOM, SEEN = 0.9, 0.5, 20
"""A source's answers in sentences usually or seldom end with a mark; told once it has so many."""


def _labels(words: str) -> str:
    return "|".join(re.escape(w) for w in words.split())


_STYLES = [
    re.compile(rf"(?im)^[ \t]*<\|(?:im_start\|>)?(?:(?P<u>{_labels(USER_LABELS)})|(?P<a>{_labels(ASSISTANT_LABELS)})|(?P<s>{_labels(SYSTEM_LABELS)}))(?:\|>)?[ \t]*:?"),
    re.compile(rf"(?im)^[ \t]*#{{2,4}}[ \t]*(?:(?P<u>{_labels(USER_LABELS)})|(?P<a>{_labels(ASSISTANT_LABELS)})|(?P<s>{_labels(SYSTEM_LABELS)}))[ \t]*:?[ \t]*$"),
    re.compile(rf"(?im)^[ \t]*\[(?:(?P<u>{_labels(USER_LABELS)})|(?P<a>{_labels(ASSISTANT_LABELS)})|(?P<s>{_labels(SYSTEM_LABELS)}))\][ \t]*:?"),
    re.compile(r"(?m)^[ \t]*(?:\*\*)?(?:(?P<u>User|USER|user)|(?P<a>Assistant|ASSISTANT|assistant)|(?P<s>System|SYSTEM|system))(?:\*\*)?[ \t]*[:：](?:\*\*)?"),
    re.compile(r"(?m)^[ \t]*(?:\*\*)?(?:(?P<u>Human|HUMAN|human)|(?P<a>AI|Ai|Assistant|ASSISTANT|Bot|Model)|(?P<s>System|SYSTEM|system))(?:\*\*)?[ \t]*[:：](?:\*\*)?"),
    re.compile(r"(?m)^[ \t]*(?:\*\*)?(?:(?P<u>Question|QUESTION|question|Q|Instruction|Prompt|Customer|Client)|(?P<a>Answer|ANSWER|answer|A|Response|Reply|Agent)|(?P<s>System|SYSTEM|system))(?:\*\*)?[ \t]*[:：](?:\*\*)?"),
]
_SENTENCE_END = re.compile(r"[.!?。！？।؟]+[\"'”»)]*(?=\s|$)|[。！？।؟]|\n")
_UNSEEN = "​‌‍⁠﻿­"
_WORD = re.compile(r"[^\W_]+(?:['’][^\W\d_]+)?")
_PLACEHOLDER = re.compile(rf"^[\s\W_]*(?:(?:no|empty|missing|without)?\s*(?:response|answer|output|reply|content|text)|{_labels(PLACEHOLDERS)}|(?:to be|not) (?:added|answered|available|provided|filled in))[\s\W_]*$", re.I)
_NOTE_END = re.compile(r"\s*\[\d+\]$")
_TERMINATORS, _CLOSERS = ".!?…。！？｡।॥؟۔", "\"'”’“»)]」』*_ \t\n"
_REFUSAL = [re.compile(p) for p in REFUSAL]
_SIGNS = [s.replace("_", " ") for s in REFUSAL_SIGNS.split()]
_SORRY = re.compile(SORRY, re.I)
_TRAP_BEGIN = re.compile(r"\s*(?:you (?:could|can|might) (?:write|say|tell)|(?:write|say|try|tell \w+)\s*:|here is (?:a|one) (?:way|draft))", re.I)
_TRAP = re.compile(r"[\"“][^\"”]{0,60}(?:sorry|can[’']?t|cannot)|\bnot able to \w+ every\b|\bhere (?:is|are) what\b|\bsorry to hear\b", re.I)
# questions are searched in lower case, which is far cheaper than ignoring case
_TRANSLATE, _REPEAT = re.compile(TRANSLATE), re.compile(REPEAT)
_NAMED = {code: re.compile("|".join(re.escape(w) for w in words.lower().split())) for code, words in LANGUAGES.items()}
_ANY_NAMED = re.compile("|".join(re.escape(w) for words in LANGUAGES.values() for w in words.lower().split()))
_STOP_OF: dict[str, tuple[str, ...]] = {}
for _code, _words in STOPWORDS.items():
    for _w in _words.split():
        _STOP_OF[_w] = (*_STOP_OF.get(_w, ()), _code)
_FUNCTION = frozenset(FUNCTION_WORDS.split())
_CLAUSE = frozenset(CLAUSE_WORDS.split())
_COUNT = re.compile(COUNT_WORDS, re.I)
_SENTENCE = re.compile(r"[.!?。！？।؟](?=\s|$)")
_ITEM_END = re.compile(r"[.;,!?。；]$")
_OPENER = re.compile(r"^(?:sure|of course|certainly|hello|here you go|ok|okay|yes|no|hi|good question|thanks)\b[.!:;,]?\s*(.*)$", re.I | re.S)
# letters that one language of Latin script uses and the others don't
_LETTERS = {"de": re.compile("[äöüß]"), "fr": re.compile("[êèàçœùîô]"), "es": re.compile("[ñ¿¡áíóú]")}
_QUOTED = re.compile(r'"[^"]*"|“[^”]*”|«[^»]*»|„[^“]*“')
_FIRST_PERSON = re.compile(r"\b(?:i|i'm|we|my|our)\b[^.!?]{0,30}(?:\bnot\b|n't\b|\bcannot\b|\bunable\b|\brefuse|\bdeclin|\bagainst\b)|\bagainst\b[^.!?]{0,20}\b(?:my|our)\b|\b(?:my|our)\b[^.!?]{0,20}\b(?:rules|guidelines|polic)|\bsomething i\b")
_NAME = re.compile(r"\b[A-ZÀ-Þ]\w*")
_PLAIN = (" th", " wh", " sh", "ing ", "ight")
_SCRIPT_NAMES = frozenset(("th", "hi", "ar", "ru", "ja", "ko", "zh"))
_SCRIPTS = [("th", re.compile(r"[฀-๿]")), ("hi", re.compile(r"[ऀ-ॿ]")), ("ar", re.compile(r"[؀-ۿ]")), ("ru", re.compile(r"[Ѐ-ӿ]")), ("ja", re.compile(r"[぀-ヿ]")), ("ko", re.compile(r"[가-힯]")), ("zh", re.compile(r"[一-鿿]"))]
_ITEM = re.compile(r"\s*(?:[-*+•·]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)])\s+\S")
_FENCE = re.compile(r"^\s*(?:```|~~~)", re.M)
_CODE = re.compile(r"(?:```|~~~).*?(?:(?:```|~~~)|$)", re.S)
_NUMBER_END = re.compile(r"(?:answer is|=|equals|total(?: is)?|makes|are|is)\s*[-+$€]?\d[\d.,]*\s*%?$|^\W*(?:[\w.]+\W+){0,3}[-+$€]?\d[\d.,]*\s*%?$", re.I)
_WH = re.compile(r"\b(?:who|which|what is the (?:name|capital)|what(?:'s| is)|where|when|how many|how much|name of|in which|whose|wer|qui|quién|кто|is it|was it|did|does|has)\b|谁|誰|ใคร|कौन|من هو", re.I)
_EXPLAIN = re.compile(r"\b(?:summari[sz]e|explain|compare|describe|convince|why|how would|how can|what should|what are the|tell|draft|compose|write|list|give me|show|what can i do|can you)\b", re.I)


def split_pairs(text: str) -> list[tuple[str, str | None]]:
    """Question and answer (None: there is no answer turn) of each user turn, in the label style the record uses."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    best: list[re.Match] = []
    for style in _STYLES:
        marks = list(style.finditer(text))
        users = [m for m in marks if m.lastgroup == "u"]
        if users and (not best or marks[0].start() < best[0].start()):
            best = marks
            if marks[0].start() == 0:
                break
    pairs: list[tuple[str, str | None]] = []
    for i, m in enumerate(best):
        body = text[m.end() : best[i + 1].start() if i + 1 < len(best) else len(text)]
        body = body.replace("<|end|>", "").replace("<|im_end|>", "").strip().strip(_UNSEEN).strip()
        if m.lastgroup == "u":
            pairs.append((body, None))
        elif m.lastgroup == "a" and pairs:
            question, before = pairs[-1]
            pairs[-1] = (question, body if before is None else f"{before}\n{body}".strip())
    return pairs


def language(text: str, words: list[str] | None = None) -> str | None:
    """Language of a text by script, or by function words where the script is Latin; None if it can't be told."""
    if not text.isascii():
        letters = len(text) or 1
        for code, script in _SCRIPTS:
            found = len(script.findall(text))
            if found >= 3 and found > 0.12 * letters:
                return code
    votes: dict[str, float] = {}
    for w, n in Counter(words if words is not None else _WORD.findall(text.lower())).items():
        if codes := _STOP_OF.get(w):
            for code in codes:
                votes[code] = votes.get(code, 0.0) + n / len(codes)
    if not votes:
        return None
    ranked = sorted(votes.items(), key=lambda x: -x[1])[:2]
    if ranked[0][1] >= 2 and (len(ranked) == 1 or ranked[0][1] >= 1.5 * ranked[1][1]):
        return ranked[0][0]
    if len(ranked) == 2:
        found = [code for code, _ in ranked if code in _LETTERS and _LETTERS[code].search(text.lower())]
        if len(found) == 1:
            return found[0]
    return None


def asked_languages(question: str) -> set[str]:
    """Languages that a question, in lower case, names."""
    if not _ANY_NAMED.search(question):
        return set()
    return {code for code, names in _NAMED.items() if names.search(question)}


def item_words(answer: str) -> Iterator[tuple[str, int]]:
    """Words of finished list items, and of Thai clauses the endings: what ends there, and what only stands inside."""
    lines = answer.split("\n")
    items = [x for x in lines if _ITEM.match(x)]
    for x in items[:-1]:
        words = _WORD.findall(x)
        for w in words[:-1]:
            if w.islower():
                yield w, 0
        if words and words[-1].islower():
            yield words[-1], 1
    if "฀" <= answer[-1:] <= "๿":
        for clause in answer.split()[:-1]:
            yield clause[-3:], 1


@dataclass(slots=True)
class Pair:
    """A question and an answer with what several functions need of them."""

    question: str
    query: str
    bare: str
    low: str
    asked: list[str]
    words: list[str]
    lines: list[str]
    items: list[str]
    ended: bool
    sentences: int
    told: bool

    @property
    def last(self) -> str:
        return self.lines[-1].strip()

    @property
    def last_is_item(self) -> bool:
        return bool(_ITEM.match(self.lines[-1]))


def read_pair(question: str, answer: str) -> Pair:
    bare = answer.strip(_UNSEEN + " \t\n\u3000\xa0")
    low = bare.lower()
    lines = bare.split("\n")
    query = question.lower()
    told = bool(_REPEAT.search(query) or _TRANSLATE.search(query))
    return Pair(question, query, bare, low, _WORD.findall(query), _WORD.findall(low), lines, [x.rstrip() for x in lines if _ITEM.match(x)], ended_by_mark(bare), len(_SENTENCE.findall(bare)), told)


def ended_by_mark(text: str) -> bool:
    """Whether a text ends with an end mark, apart from closing marks and notes after it."""
    text = text.rstrip()
    while text.endswith("]") and (note := _NOTE_END.search(text)):
        text = text[: note.start()]
    return text.rstrip(_CLOSERS)[-1:] in tuple(_TERMINATORS)


def vote(question: str, answer: str | None) -> tuple[dict[str, tuple[int, ...]], str | None, bool]:
    """Votes of the functions of each defect; the word whose habits at the ends of list items count as one more vote; and whether the source's habit of ending with marks does."""
    pair = read_pair(question, answer or "")
    votes = {"empty": _empty_votes(answer, pair)}
    if not pair.bare:
        return votes | {name: (0,) * len(LABELLERS[name]) for name in DEFECTS[1:]}, None, False
    truncated, last = _truncated_votes(pair)
    votes |= {"truncated": truncated, "refusal": _refusal_votes(pair), "copied": _copied_votes(pair), "other_language": _language_votes(pair)}
    return votes, last, truncated[0] > 0 and truncated[1] <= 0 and truncated[3] == 0


def _sign(yes: bool, no: bool = True) -> int:
    """1, -1, or 0 where neither holds."""
    return 1 if yes else -1 if no else 0


def _empty_votes(answer: str | None, pair: Pair) -> tuple[int, ...]:
    """No answer turn; nothing to see in it; a placeholder's wording; no letter or digit; length; an amount asked for that may be none."""
    bare = pair.bare
    if answer is None or not bare:
        return (_sign(answer is None, False), 1, 0, 1, 0, 0)
    held = bool(_PLACEHOLDER.match(bare))
    wordless = not any(c.isalnum() for c in bare)
    return (0, 0, _sign(held), _sign(wordless, len(pair.words) > 3), _sign(len(bare) < 3 and not bare.isdigit(), len(bare) > 40), -1 if held and _COUNT.search(pair.question) else 0)


def _refusal_votes(pair: Pair) -> tuple[int, ...]:
    """Wording anywhere, neither quoted nor about a part only; a negated first person outside quotations; apology beside the wording; brevity; place of the wording. Without any wording only the first can tell."""
    words, low = pair.words, pair.low.replace("’", "'")
    places = sorted(m.start() for p in _REFUSAL for m in p.finditer(low)) if any(sign in low for sign in _SIGNS) else []
    if not places:
        return (-1, 0, 0, 0, 0)
    brief = _sign(len(words) <= 40 and pair.sentences <= 3, len(words) > 80)
    spans = _sentence_spans(low)
    quotes = [m.start() for m in re.finditer('"', low)]
    at = sorted({bisect_right(spans, (place, len(low))) - 1 for place in places})
    own = [i for i in at if not _trapped(low, spans, quotes, i)]
    if _TRAP_BEGIN.match(low):
        own = []
    sorry = any(_SORRY.search(low, spans[max(0, i - 1)][0], spans[min(len(spans) - 1, i + 1)][1]) for i in own)
    edge = any(i <= 1 or i >= len(spans) - 2 for i in own)
    said = _QUOTED.sub(" ", low)
    person = _sign(bool(_FIRST_PERSON.search(said)), False)
    return (_sign(bool(own)), person, _sign(sorry, False), brief, _sign(edge, bool(own)))


def _sentence_spans(text: str) -> list[tuple[int, int]]:
    """Beginning and end of the sentences; a line break ends one as well."""
    spans, begin = [], 0
    for m in _SENTENCE_END.finditer(text):
        if text[begin : m.end()].strip():
            spans.append((begin, m.end()))
            begin = m.end()
    if text[begin:].strip() or not spans:
        spans.append((begin, len(text)))
    return spans


def _trapped(low: str, spans: list[tuple[int, int]], quotes: list[int], i: int) -> bool:
    """Whether a sentence with refusal wording only quotes it or declines a part, by itself and the sentences beside it."""
    begin, end = spans[max(0, i - 1)][0], spans[min(len(spans) - 1, i + 1)][1]
    # a straight mark opens a quotation only if an even number of them stands before it
    return any(m[0][0] != '"' or bisect_left(quotes, m.start()) % 2 == 0 for m in _TRAP.finditer(low, begin, end))


def _copied_votes(pair: Pair) -> tuple[int, ...]:
    """Share of the answer's words that are the question's; of the question's words that are the answer's; and of its pairs of words; length; a sentence of other words; a repetition or translation asked for, beside which the overlap says nothing."""
    asked, words = pair.asked, pair.words
    if len(words) < 4 or len(asked) < 4:
        return (-1, -1, 0, 0, 0, 0)
    if pair.told:
        return (0, 0, 0, 0, 0, -1)
    mine, theirs = set(words), set(asked)
    inside, covered = sum(w in theirs for w in words) / len(words), sum(w in mine for w in asked) / len(asked)
    order = extra = 0
    if inside >= 0.5:
        ours = set(zip(words, words[1:], strict=False))
        ordered = sum(p in ours for p in zip(asked, asked[1:], strict=False)) / (len(asked) - 1)
        order = _sign(ordered >= 0.6, ordered < 0.4)
        sentences = [_WORD.findall(pair.low[a:b]) for a, b in _sentence_spans(pair.low)]
        extra = -1 if any(len(w) >= 4 and 2 * sum(x in theirs for x in w) < len(w) for w in sentences) else 0
    return (_sign(inside >= 0.8, inside < 0.7), _sign(covered >= 0.7 and len(words) <= 3 * len(asked), covered < 0.6), order, _sign(len(words) <= 1.25 * len(asked) + 4), extra, 0)


def _language_votes(pair: Pair) -> tuple[int, ...]:
    """Language by script or function words; script alone; letters of one language only; enough text to tell; another language asked for, beside which the others say nothing."""
    text, asked = (_CODE.sub(" ", x) if "```" in x or "~~~" in x else x for x in (pair.bare, pair.question))
    words = pair.words if text == pair.bare else _WORD.findall(text.lower())
    own, theirs = language(text, words), language(asked, pair.asked)
    wanted = asked_languages(pair.query)
    if own != theirs and wanted and (own in wanted or _TRANSLATE.search(pair.query)):
        return (0, 0, 0, 0, -1)
    told = _sign(own != theirs) if own and theirs else 0  # else neither it nor the script can be told
    mine, yours = (x if x in _SCRIPT_NAMES else "latin" for x in (own, theirs))
    a, b = letters_of(text), letters_of(asked)
    return (told, _sign(mine != yours, mine != "latin") if told else 0, _sign(a != b) if a and b else 0, _sign(len(words) >= 5 or len(text) >= 20, len(words) < 3) if own and theirs else -1, -1 if wanted else 0)


def letters_of(text: str) -> str | None:
    """The language of Latin script that the letters of a text's words point to, names left out; None if to none or several."""
    if text.isascii():
        return "en" if sum(map(text.count, _PLAIN)) >= 3 else None
    low = _NAME.sub(" ", text)
    if low.isascii():
        return "en" if sum(map(low.count, _PLAIN)) >= 3 else None
    found = [code for code, own in _LETTERS.items() if own.search(low)]
    return found[0] if len(found) == 1 else None


def _truncated_votes(pair: Pair) -> tuple[tuple[int, ...], str | None]:
    """An end mark where the answer's layout calls for one, or the fence that ends code; code fence; last word; marks of the other items; open brackets; a reply that is whole without a mark; a last sentence shorter than the others; the question's own end; and, told later, the habit of the source and of the corpus's last words."""
    fences = len(_FENCE.findall(pair.bare))
    in_code = fences % 2 == 1 or bool(fences) and pair.last.startswith(("```", "~~~"))
    fence = _sign(fences % 2 == 1, fences > 0)
    if _PLACEHOLDER.match(pair.bare):  # nothing that could break off
        return (0,) * 10, None
    if in_code:
        return (fence, fence, 0, 0, 0, 0, 0, 0, 0, 0), None
    tail = _WORD.findall(pair.last)
    final = tail[-1].lower() if tail else ""
    listed = pair.last_is_item
    thai = "฀" <= pair.last[-1:] <= "๿"
    hanging = not pair.ended and (final in _FUNCTION and len(tail) > 1 or pair.last.endswith((",", " -", "—", "(")))
    complete = not pair.ended and not hanging and _complete(pair, tail)
    asked_end = -1 if not pair.ended and len(pair.words) >= 4 and pair.words[-3:] == pair.asked[-3:] else 0
    items = _item_marks(pair) if listed else 0
    end_mark = -1 if pair.ended else 0 if listed and items <= 0 or thai or complete or asked_end else 1
    habit = None
    if not pair.ended and not items:
        if thai:
            habit = pair.last[-3:]
        elif listed and len(pair.items) >= 2 and final.isalpha() and tail[-1].islower():
            habit = final
    whole = complete and habit is None
    opened = not pair.ended and not listed and any(pair.bare.count(a) > pair.bare.count(b) for a, b in ("()", "«»", "「」", "“”"))
    fragment = 0
    if end_mark > 0 and pair.sentences >= 2:
        spans = _sentence_spans(pair.bare)
        before = [len(pair.bare[a:b].split()) for a, b in spans[:-1]]
        fragment = _sign(2 * len(pair.bare[spans[-1][0] :].split()) < sum(before) / len(before), False)
    return (end_mark, fence, _sign(hanging, False), items, _sign(opened, False), -1 if whole else 0, fragment, asked_end, 0, 0), habit


def _item_marks(pair: Pair) -> int:
    """Whether the last item lacks, or has, the mark that the others end with; 0 if they have none."""
    others = pair.items[:-1]
    if not others or sum(bool(_ITEM_END.search(x)) for x in others) < 0.7 * len(others):
        return 0
    return _sign(not _ITEM_END.search(pair.items[-1]) and not pair.ended)


def _complete(pair: Pair, tail: list[str]) -> bool:
    """A reply that needs no end mark: an item, a number, a name, a few words, a signature, or that after an opening like "Sure"."""
    last = pair.last
    if pair.last_is_item:
        return not _item_marks(pair)
    if (last[-1:].isdigit() or last.endswith("%")) and _NUMBER_END.search(last):
        return True
    if not pair.sentences and not _clause(tail):
        named = bool(tail) and all(w[0].isupper() or w[0].isdigit() or w.lower() in _FUNCTION for w in tail)
        if len(tail) <= 8 and len(last) <= 60 and (named or len(tail) <= 5 or len(tail) == 6 and _WH.search(pair.question) and not _EXPLAIN.search(pair.question)):
            return True
    if pair.sentences and len(tail) <= 5 and len(pair.lines) > 1 and tail and not _caseless(last) and all(w[:1].isupper() or w[:1].isdigit() for w in tail):
        return True
    opened = _OPENER.match(pair.bare)
    rest = _WORD.findall(opened[1]) if opened else []
    return bool(rest) and len(rest) <= 5 and not _clause(rest)


def _caseless(text: str) -> bool:
    return language(text, []) in ("th", "zh", "ja", "hi", "ar")


def _clause(tail: list[str]) -> bool:
    """A clause with a verb or a conjunction can't be a mere name."""
    return any(w.lower() in _CLAUSE for w in tail[1:] or tail)


def _pattern(votes: tuple[int, ...]) -> int:
    total = 0
    for v in votes:
        total = total * 3 + v + 1
    return total


@lru_cache(maxsize=None)
def _votes_of(pattern: int, n: int) -> tuple[int, ...]:
    votes = []
    for _ in range(n):
        pattern, digit = divmod(pattern, 3)
        votes.append(digit - 1)
    return tuple(reversed(votes))


def fit(counts: dict[tuple[int, ...], int], names: tuple[str, ...] = (), rounds: int = 300) -> dict[tuple[int, ...], float]:
    """Posterior of the defect for each pattern of votes, by EM from a prior belief that a vote is mostly right.

    The model has the share of defective pairs and, for each function, how often
    it votes for the defect, where it votes, on defective and on sound pairs. The
    belief is weaker for the functions ``names`` that are WEAK, and keeps a weight of PRIOR_WEIGHT of a function's votes, and of ten votes,
    so one that hardly votes can't turn its meaning round. Silence carries no
    evidence.
    """
    total = sum(counts.values())
    if not total:
        return {}
    votes = np.array(list(counts), dtype=np.float64)
    n = np.array(list(counts.values()), dtype=np.float64)
    up, down = (votes > 0).astype(np.float64), (votes < 0).astype(np.float64)
    weight = np.maximum(10.0, PRIOR_WEIGHT * (n @ (up + down)))
    # the belief about defective pairs weighs as many pairs as the belief holds to be defective
    few = np.maximum(2.0, PRIOR_SHARE * weight)
    whole = max(1.0, PRIOR_WEIGHT * total)
    weak = np.array([name in WEAK for name in names] or [False] * votes.shape[1])
    first_hit, first_alarm = np.where(weak, WEAK_HIT, PRIOR_HIT), np.where(weak, WEAK_ALARM, PRIOR_ALARM)
    share, hit, alarm = PRIOR_SHARE, first_hit, first_alarm
    p = np.zeros(len(n))
    for _ in range(rounds):
        odds = math.log(share / (1 - share)) + up @ np.log(hit / alarm) + down @ np.log((1 - hit) / (1 - alarm))
        before, p = p, 1 / (1 + np.exp(-np.clip(odds, -60, 60)))
        bad, good = p * n, (1 - p) * n
        share = (bad.sum() + PRIOR_SHARE * whole) / (total + whole)
        hit = np.clip((bad @ up + first_hit * few) / (bad @ (up + down) + few), LEAST, 1 - LEAST)
        alarm = np.clip((good @ up + first_alarm * weight) / (good @ (up + down) + weight), LEAST, 1 - LEAST)
        if np.abs(p - before).max() < 1e-7:
            break
    return dict(zip(counts, p.tolist(), strict=True))


def best_cutoff(scored: list[tuple[float, bool]]) -> float:
    """The cutoff with the best F1 on labelled pairs; of a range that does as well, its middle."""
    ranked = sorted({0.0, 1.0, *(p for p, _ in scored)})
    wanted = sum(w for _, w in scored)
    best: tuple[float, float, float] = (-1.0, 0.5, 0.5)
    for low, high in zip(ranked, ranked[1:], strict=False):
        kept = [w for p, w in scored if p > low]
        f1 = 2 * sum(kept) / max(1, len(kept) + wanted)
        if f1 > best[0] + 1e-12:
            best = (f1, low, high)
        elif abs(f1 - best[0]) <= 1e-12 and low == best[2]:
            best = (f1, best[1], high)
    return (best[1] + best[2]) / 2


def label(records: DataFrame, key: str = "rec_id", text: str = "text", source: str | None = "source") -> DataFrame:
    """``key``, ``pair_no`` (user turns from 1), ``defect`` and ``posterior`` for each defect of each pair.

    A user turn without an answer turn is an empty answer. Texts without a role
    label, null and blank texts have no pairs; repeated records are labelled under
    each id; null ids are kept; records without a source have none whose habits
    could vote; other columns are ignored. What goes to the driver is the count of
    each pattern of votes, at most 3 to the power of the number of a defect's
    functions.
    """
    kind = dict(records.dtypes)[key]
    origin = F.lower(F.trim(F.col(source).cast("string"))) if source and source in records.columns else F.lit(None).cast("string")
    named = records.select(F.col(key).alias("id"), F.col(text).alias("text"), origin.alias("source")).where("text is not null")
    rows = cut(named.mapInArrow(_votes, f"id {kind}, pair_no int, patterns array<int>, last string, origin string, of string, ends bigint, total bigint"))
    votes = rows.where("pair_no is not null").select("id", "pair_no", "patterns", "last", "origin")
    habits = rows.where("pair_no is null").groupBy("of", "last").agg(F.sum("ends").alias("ends"), F.sum("total").alias("total"))
    share = F.col("ends") / F.col("total")
    # does this source end its sentences with marks? and does this word end items in the corpus as it ends this one?
    of_source = F.when(F.col("total") < SEEN, 0).when(share >= USUAL, 1).when(share <= SELDOM, -1).otherwise(0)
    thai = F.col("last").rlike("[\u0e00-\u0e7f]")
    of_word = F.when(thai, F.when(F.col("ends") >= 2, -1).otherwise(F.lit(1))).when(F.col("total") < 5, 0).when(share < 0.1, 1).when(share > 0.3, -1).otherwise(0)
    sources = habits.where("of = 'source'").select(F.col("last").alias("origin"), of_source.alias("source_habit"))
    words = habits.where("of = 'word'").select("last", of_word.alias("word_habit"))
    plain = votes.where("last is null and origin is null").select("id", "pair_no", "patterns")
    asked = votes.where("last is not null or origin is not null").join(words, "last", "left").join(sources, "origin", "left")
    # a Thai ending that the corpus doesn't know speaks for a break
    word_habit = F.coalesce("word_habit", F.when(thai, 1).otherwise(0))
    # the last two digits of the pattern, in which 1 stands for silence
    moved = F.col("patterns")[DEFECTS.index("truncated")] + 3 * F.coalesce("source_habit", F.lit(0)) + word_habit
    told = asked.select("id", "pair_no", F.transform("patterns", lambda x, i: F.when(i == DEFECTS.index("truncated"), moved).otherwise(x)).alias("patterns"))
    voted = plain.unionByName(told).select("id", "pair_no", F.posexplode("patterns").alias("defect", "pattern"))
    counts = voted.groupBy("defect", "pattern").count().collect()
    known = []
    for d, name in enumerate(DEFECTS):
        own = {_votes_of(r.pattern, len(LABELLERS[name])): r["count"] for r in counts if r.defect == d}
        known += [(d, _pattern(v), name, p) for v, p in fit(own, LABELLERS[name]).items() if p > CUTOFFS[name]]
    spark = records.sparkSession
    table = spark.createDataFrame(known, "defect int, pattern int, name string, posterior double")
    found = voted.join(F.broadcast(table), ["defect", "pattern"])
    return found.select(F.col("id").alias(key), "pair_no", F.col("name").alias("defect"), "posterior")


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Patterns of votes of each pair; and, without a pair number, how often words of list items, and a source's answers, end as they do."""
    names = ["id", "pair_no", "patterns", "last", "origin", "of", "ends", "total"]
    for batch in batches:
        ids = batch.column("id")
        at: list[int] = []
        pair: list[int] = []
        patterns: list[list[int]] = []
        last: list[str | None] = []
        origins: list[str | None] = []
        ends: Counter = Counter()
        total: Counter = Counter()
        for i, (t, origin) in enumerate(zip(batch.column("text").to_pylist(), batch.column("source").to_pylist(), strict=True)):
            for no, (question, answer) in enumerate(split_pairs(t), 1):
                found, word, by_source = vote(question, answer)
                at.append(i)
                pair.append(no)
                patterns.append([_pattern(found[name]) for name in DEFECTS])
                last.append(word)
                origins.append(origin if by_source else None)
                end_mark = found["truncated"][0]
                if end_mark and origin and (by_source or end_mark < 0):
                    total["source", origin] += 1
                    ends["source", origin] += end_mark < 0
                if answer:
                    for w, end in item_words(answer):
                        total["word", w] += 1
                        ends["word", w] += end
        none = pa.nulls(len(at), pa.int64())
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), pa.array(pair, pa.int32()), pa.array(patterns, pa.list_(pa.int32())), pa.array(last, pa.string()), pa.array(origins, pa.string()), pa.nulls(len(at), pa.string()), none, none], names)
        keys = list(total)
        none = pa.nulls(len(keys), pa.string())
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(keys), ids.type), pa.nulls(len(keys), pa.int32()), pa.nulls(len(keys), pa.list_(pa.int32())), pa.array([k for _, k in keys], pa.string()), none, pa.array([of for of, _ in keys], pa.string()), pa.array([ends[k] for k in keys], pa.int64()), pa.array([total[k] for k in keys], pa.int64())],
            names,
        )
