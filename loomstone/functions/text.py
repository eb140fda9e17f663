"""Text normalisation as Column builders; all run inside the JVM but ``html_unescape`` and ``code_body``."""

from __future__ import annotations

import ast
import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from loomstone.functions import constants as K


def strip(text: Column) -> Column:
    """White space removed from both ends, line breaks too."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def words(text: Column) -> Column:
    """Lower-cased runs of ASCII letters, with an inner apostrophe."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-zA-Z]+(?:'[a-zA-Z]+)?"), F.lit(0))


def tokens(text: Column) -> Column:
    """Pieces between white space."""
    return F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))


def sentences(text: Column) -> Column:
    """Pieces between end marks followed by white space, of more than 5 characters."""
    return F.filter(F.transform(F.split(text, r"[.!?]+\s+"), strip), lambda s: F.length(s) > 5)


def paragraphs(text: Column) -> Column:
    """Pieces between blank lines, of more than 20 characters."""
    return F.filter(F.transform(F.split(text, "\n\n"), strip), lambda s: F.length(s) > 20)


def newlines(text: Column) -> Column:
    """Line breaks as \\n, at most one blank line in a row, ends stripped."""
    unix = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return strip(F.regexp_replace(unix, r"\n{3,}", "\n\n"))


def mend(text: Column) -> Column:
    """Damaged punctuation replaced, the longest match first."""
    for bad, good in K.MOJIBAKE:
        text = F.replace(text, F.lit(bad), F.lit(good))
    return text


def untag(text: Column) -> Column:
    """Tags dropped and blank lines collapsed; entities stay (see ``html_unescape``)."""
    return strip(F.regexp_replace(F.regexp_replace(text, r"<[^>]+>", ""), r"\n{3,}", "\n\n"))


@F.pandas_udf(StringType())
def html_unescape(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else html.unescape(t))


def html_strip(text: Column) -> Column:
    """Tags dropped, then entities resolved, blank lines collapsed, ends stripped."""
    return newlines(html_unescape(F.regexp_replace(text, r"<[^>]+>", "")))


def chat_wrappers(text: Column) -> Column:
    """Turn headings removed and marked-up role headings written as ``User: `` and ``Assistant: ``."""
    plain = newlines(text)
    plain = F.regexp_replace(plain, r"(?m)^\s*(?:#{1,6}\s*)?(?:\*\*)?Turn\s+\d+(?:\s*[-:][^\n]*)?(?:\*\*)?\s*$", "")
    heads = r"(?m)^\s*(?:[-*]\s*)?(?:#{1,6}\s*)?(?:\*\*)?(User|Assistant)(?:\s*(?:turn|response|message))?(?:\s*\d+)?\s*:(?:\*\*)?\s*"
    return newlines(F.regexp_replace(plain, heads, "$1: "))


def prompt_key(text: Column) -> Column:
    """Prompts compared apart from case and marks: white space first becomes one blank, then all but ASCII letters, digits and blanks goes."""
    return F.regexp_replace(F.regexp_replace(strip(F.lower(text)), r"\s+", " "), r"[^a-z0-9 ]", "")


def classifier_text(text: Column, size: int) -> Column:
    return F.substring(F.replace(strip(text), F.lit("\n"), F.lit(" ")), 1, size)


def rendered(question: Column, answer: Column) -> Column:
    return F.concat(F.lit("User: "), question, F.lit("\nAssistant: "), answer)


def with_context(instruction: Column, context: Column, gap: str = "\n\n") -> Column:
    return F.when(strip(context) != "", F.concat(instruction, F.lit(gap), context)).otherwise(instruction)


def fenced(answer: Column) -> Column:
    """Bare code in a fence."""
    bare = strip(answer)
    starts = bare.rlike(r"^(def |class |import |from |for |while |print\(|#)") & ~F.contains(bare, F.lit("```"))
    return F.when(starts, F.concat(F.lit("```python\n"), bare, F.lit("\n```"))).otherwise(bare)


def cut_at_stops(text: Column, stops: list[str] = K.STOP_MARKERS) -> Column:
    """Cut before the first of each stop marker, in their order."""
    text = strip(text)
    for stop in stops:
        text = F.substring_index(text, stop, 1)
    return strip(text)


def cut_speaker(text: Column) -> Column:
    """Cut before an invented speaker's turn, in a line of its own or after a sentence."""
    roles = "|".join(K.SPEAKER_WORDS)
    whole = F.length(text) + 1
    inline = F.regexp_instr(text, F.lit(rf"(?i)(?<=[.!?…])\s+({roles})\s?:\s"))
    line = F.regexp_instr(text, F.lit(rf"(?i)\n[ \t]*(?:{roles}|q|a)[ \t]?:[ \t]"))
    first = F.least(F.when(inline > 0, inline).otherwise(whole), F.when(line > 0, line).otherwise(whole))
    return F.regexp_replace(F.left(text, first - 1), r"\s+$", "")


def clean_response(text: Column, stop: Column) -> Column:
    """Template slots dropped, line ends trimmed, and the broken tail of a response that ran out of room cut at its last sentence."""
    slots = F.regexp_replace(text, r"\[(?:Insert|Your|Name of)[^\]\n]{0,80}\]", "")
    body = strip(F.regexp_replace(slots, r"(?m)[ \t\r\f]+$", ""))
    tail = F.regexp_replace(F.substring_index(body, "\n", -1), r"^\s+", "")
    structural = tail.rlike(r"^(?:-|\*|```|\d+[.)])") | F.endswith(tail, F.lit(":"))
    last = F.length(F.regexp_extract(body, r"(?s)^(.*[.!?])", 1))
    broken = stop.isin("length", "context") & (F.length(body) > 100) & ~body.rlike(r"""[.!?"')]\z""") & ~structural & (last > 51)
    return F.when(broken, F.left(body, last)).otherwise(body)


@F.pandas_udf(StringType())
def code_body(text: pd.Series) -> pd.Series:
    """The longest prefix of the code from its first ``def`` that parses; nothing is run."""

    def body(t: str | None) -> str | None:
        if t is None:
            return None
        inside = t.split("```")
        code = inside[1].removeprefix("python") if len(inside) > 2 else t
        at = code.find("def ")
        lines = code[max(at, 0) :].strip("\n").split("\n")
        while lines:
            try:
                ast.parse("\n".join(lines))
                return "\n".join(lines)
            except SyntaxError as error:
                # whatever holds that line as well fails there too
                del lines[max(0, min(len(lines), error.lineno or len(lines)) - 1) :]
            except ValueError:
                lines.pop()
        return ""

    return text.map(body)


def auto_title(text: Column) -> Column:
    short = strip(F.left(text, F.lit(50)))
    return F.when(F.length(text) > 50, F.concat(short, F.lit("..."))).otherwise(short)


def clock(seconds: Column) -> Column:
    s = seconds.cast("bigint")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def duration(seconds: Column) -> Column:
    s = seconds.cast("bigint")
    days, hours, minutes = F.floor(s / 86400), F.floor(s % 86400 / 3600), F.floor(s % 3600 / 60)
    long, short = F.format_string("%dd %dh %dm", days, hours, minutes), F.format_string("%dh %dm", hours, minutes)
    return F.when(seconds.isNull() | (seconds <= 0), "?").when(days > 0, long).otherwise(short)


def coerced_kind(text: Column) -> Column:
    """The type a configuration value reads as: bool, null, int, float or str."""
    low = F.lower(text)
    return F.when(low.isin("true", "false"), "bool").when(low.isin("null", "none"), "null").when(text.rlike(r"^-?\d+$"), "int").when(text.rlike(r"^-?\d+\.\d*([eE][-+]?\d+)?$"), "float").otherwise("str")


def age_bucket(days: Column) -> Column:
    return F.when(days < 1, "Today").when(days < 2, "Yesterday").when(days < 7, "Last 7 days").when(days < 30, "Last 30 days").otherwise("Older")


def contains_any(text: Column, phrases: list[str]) -> Column:
    found = F.lit(False)
    for phrase in phrases:
        found = found | F.contains(text, F.lit(phrase))
    return found


def starts_with_any(text: Column, phrases: list[str]) -> Column:
    found = F.lit(False)
    for phrase in phrases:
        found = found | F.startswith(text, F.lit(phrase))
    return found
