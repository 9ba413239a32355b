"""Statistics of one text: plain Python that the quality operator runs per Arrow batch.

They count words, signs, lines and repetitions only; nothing in them knows a kind of page, a language or a programming
language. What a value means is left to its rank among the documents of the same language.
"""

from __future__ import annotations

import re
import zlib

NAMES = (
    "n_words", "mean_word_length", "symbol_ratio", "digit_ratio", "punctuated_lines", "common_words", "words_per_line", "distinct_words",
    "short_lines", "cell_lines", "capital_tokens", "bracket_ratio", "distinct_pairs", "short_words", "lower_tokens", "marked_lines",
    "compressed", "line_spread", "mixed_tokens", "sentence_lines", "ideographs", "stops_per_line",
)

_word = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*").findall
_cjk = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uff66-\uff9f]").findall
_digit = re.compile(r"\d").search
_letter = re.compile(r"[^\W\d_]").search
_cell = re.compile(r"\t|;|\||\s{3,}").split
_bracket = re.compile(r"[{}()\[\]<>=\\#$@^~_*;+/]").findall
_stop = re.compile(r"[.!?。！？…](?=\s|$|[^\w])").findall
_end = frozenset(".!?。！？…:;”\"»)]）」")

#: Words of a line from which it can hold a sentence; ideographs count for a third of a word.
SENTENCE_WORDS = 5
#: Words up to which a line is short, letters up to which a word is, and cells from which a line is one of cells.
SHORT_LINE, SHORT_WORD, CELLS = 4, 3, 3


def statistics(text: str, common: frozenset[str] | set[str]) -> list[float]:
    """The statistics in the order of NAMES; a blank text has none (all 0)."""
    lines = [s for s in map(str.strip, text.splitlines()) if s]
    if not lines:
        return [0.0] * len(NAMES)
    words: list[str] = []
    lengths: list[int] = []
    ended = stops = tokens = capital = lower = mixed = marked = short = cells = sentences = ideographs = 0
    for s in lines:
        n = len(s)
        lengths.append(n)
        here = _word(s.lower())
        words += here
        cjk = 0 if s.isascii() else len(_cjk(s))
        ideographs += cjk
        weight = len(here) + cjk // 3
        parts = s.split()
        tokens += len(parts)
        for p in parts:
            if p[0].isupper():
                capital += 1
            elif p[0].islower():
                lower += 1
        if _digit(s):
            mixed += sum(1 for p in parts if _digit(p) and _letter(p))
        end = s[-1] in _end
        ended += end
        if weight <= SHORT_LINE:
            short += n
        if ("\t" in s or ";" in s or "|" in s or "   " in s) and len(_cell(s)) >= CELLS:
            cells += n
        if not s[0].isalpha():
            marked += 1
        stop = len(_stop(s))
        stops += stop
        if weight >= SENTENCE_WORDS and (end or stop):
            sentences += n
    total, count, w = sum(lengths), len(lines), len(words)
    letters = sum(map(len, words))
    digits = sum(map(text.count, "0123456789"))
    spaces = sum(map(text.count, (" ", "\n", "\r", "\t")))
    raw = text.encode("utf-8", "surrogatepass")
    mean = total / count
    spread = (sum((x - mean) ** 2 for x in lengths) / count) ** 0.5
    return [
        float(w),
        letters / w if w else 0.0,
        max(0, len(text) - spaces - letters - digits) / total,
        digits / total,
        ended / count,
        sum(map(common.__contains__, words)) / w if w else 0.0,
        w / count,
        len(set(words)) / w if w else 0.0,
        short / total,
        cells / total,
        capital / tokens,
        len(_bracket(text)) / total,
        len(set(zip(words, words[1:]))) / (w - 1) if w > 1 else 1.0,
        sum(1 for x in words if len(x) <= SHORT_WORD) / w if w else 0.0,
        lower / tokens,
        marked / count,
        len(zlib.compress(raw, 1)) / len(raw),
        spread / mean,
        mixed / tokens,
        sentences / total,
        ideographs / total,
        stops / count,
    ]
