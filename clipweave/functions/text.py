"""Text rules as column expressions; greedy wraps are the only Python helpers."""

from __future__ import annotations

import difflib
import functools
import itertools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def n_words(text: Column) -> Column:
    t = squeeze(text)
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, " ")))


def words_per_second(text: Column, ms: Column) -> Column:
    return n_words(text) / (F.greatest(ms, F.lit(1e-3)) / 1000.0)


def normalize_text(text: Column) -> Column:
    """Lower case, ё as е, letters and digits only, single spaces."""
    return F.trim(F.regexp_replace(F.translate(F.lower(F.coalesce(text, F.lit(""))), "ё", "е"), r"[^a-z0-9а-я]+", " "))


def tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(normalize_text(text), " "), lambda w: w != ""))


def token_f1(a: Column, b: Column) -> Column:
    """F1 of two token sets (arrays without repeats); 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), 2.0 * both / (F.size(a) + F.size(b))).otherwise(F.lit(0.0))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of character sequences, of the first 3000 characters of each."""
    return pd.Series([difflib.SequenceMatcher(None, (x or "")[:3000], (y or "")[:3000]).ratio() for x, y in zip(a, b, strict=True)])


def safe_title(text: Column, index: Column, most: int = 68) -> Column:
    """Squeezed; a numbered stand-in when empty; cut at a space within `most` characters, with an ellipsis."""
    t = squeeze(text)
    cut = F.substring(t, 1, most)
    at_space = F.when(F.instr(cut, " ") > 0, F.regexp_replace(cut, r" [^ ]*$", "")).otherwise(cut)
    return F.when(t == "", F.concat(F.lit("Фрагмент "), index.cast("string"))).when(F.length(t) <= most, t).otherwise(F.concat(F.regexp_replace(at_space, r"[ ,.;:-]+$", ""), F.lit("…")))


def safe_label(text: Column, default: str = "item") -> Column:
    t = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9_]+", "_"), r"_+", "_")
    t = F.regexp_replace(t, r"^_|_$", "")
    return F.when(t == "", F.lit(default)).otherwise(t)


def title_typography(text: Column) -> Column:
    """No-break space as space, all dashes and the minus sign as hyphen."""
    return F.translate(text, " ‐‑‒–—―−", " -------")


#: Filler phrases; fixed values.
FILLERS = ("в целом", "на самом деле", "как бы", "по сути", "в общем")


def polish_title(text: Column, most: int = 140, least_cut: int = 80) -> Column:
    t = squeeze(text)
    for f in FILLERS:
        t = F.regexp_replace(t, rf"(?iu)(?<![\p{{L}}\p{{N}}_]){f}(?![\p{{L}}\p{{N}}_])\s*", "")
    t = F.regexp_replace(F.regexp_replace(t, "^[ \"'«»]+|[ \"'«»]+$", ""), " {2,}", " ")
    t = F.regexp_replace(t, r"([!?.,;:])[!?.,;:]+", "$1")
    cut = F.substring(t, 1, most)
    space = F.length(cut) - F.instr(F.reverse(cut), " ")  # place of the last space, counted from 0
    at_word = (F.instr(cut, " ") > 0) & (space > least_cut)
    return F.when(F.length(t) <= most, t).otherwise(F.rtrim(F.when(at_word, F.regexp_replace(cut, " [^ ]*$", "")).otherwise(cut)))


def title_seconds(title: Column, base: Column) -> Column:
    """Longer display for titles over 7 words or 42 characters: at most 1.2 s more, 3.2 s in all."""
    t, b = squeeze(title), F.greatest(F.lit(0.0), base)
    words, chars = n_words(title), F.length(t)
    extra = F.least(F.lit(1.2), F.greatest(F.lit(0.0), (words - 7) * 0.06, (chars - 42) * 0.012))
    return F.when((words <= 7) & (chars <= 42), b).otherwise(F.bround(F.least(F.lit(3.2), b + extra), 3))


#: Glyph classes and widths in hundredths of the font size; fixed values.
NARROW, WIDE = " ilI1|.,:;!'`", "WwMm@%#&ЖШЩЮФЫД"
WIDTHS = (34, 60, 90)
PANEL_PX = 1080 * 0.726


def text_width(text: Column, font: Column) -> Column:
    """Estimated width in hundredths of a pixel: glyph class widths times font size (at least 8 is counted as given)."""
    t = F.coalesce(text, F.lit(""))
    narrow = F.length(t) - F.length(F.translate(t, NARROW, ""))
    wide = F.length(t) - F.length(F.translate(t, WIDE, ""))
    return (narrow * WIDTHS[0] + wide * WIDTHS[2] + (F.length(t) - narrow - wide) * WIDTHS[1]) * font


def needs_scroll(text: Column, font: Column) -> Column:
    return text_width(text, font) / 100 > PANEL_PX


def sanitize_ass(text: Column) -> Column:
    return F.translate(F.replace(text, F.lit("\\"), F.lit("\\\\")), "{}", "[]")


def accent_spans(text: Column, terms: list[str]) -> Column:
    """Words of the text that begin with a term, longest term first, whatever the case."""
    alternatives = "|".join(escape_term(t) for t in sorted(terms, key=len, reverse=True))
    return F.regexp_extract_all(text, F.lit(rf"(?iu)(?<![\p{{L}}\p{{N}}_])((?:{alternatives})[\p{{L}}\p{{N}}_]*)"), 1)


def escape_term(term: str) -> str:
    return "".join(c if c.isalnum() or c == "_" else "\\" + c for c in term)


def source_name(source: Column) -> Column:
    """Last path part of a path, yadisk: reference or URL; a URL's filename parameter wins."""
    given = F.regexp_extract(source, r"[?&]filename=([^&#]+)", 1)
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(source, r"[?#].*$", ""), r"^yadisk:", ""), r"/+$", "")
    return F.url_decode(F.when(given != "", given).otherwise(F.regexp_extract(bare, r"([^/\\]*)$", 1)))


def source_stem(source: Column) -> Column:
    return F.regexp_replace(source_name(source), r"(?<=.)\.[^.]*$", "")


def source_extension(source: Column) -> Column:
    return F.lower(F.regexp_extract(source_name(source), r".(\.[^.]*)$", 1))


def cache_key(source: Column) -> Column:
    return F.md5(source.cast("binary"))


def cache_name(source: Column) -> Column:
    return F.concat(source_stem(source), F.lit("_"), F.substring(cache_key(source), 1, 8), source_extension(source))


def clip_file_name(stem: Column, index: Column, start: Column, end: Column) -> Column:
    mark = lambda t: F.translate(t, ":", "-")
    return F.concat(stem, F.format_string("_%02d_", index), mark(start), F.lit("_"), mark(end), F.lit(".mp4"))


def greedy_lines(words: list[str], fits) -> list[str]:
    """Words in lines: a word joins the line while fits(line with it)."""
    lines: list[str] = []
    for w in words:
        if lines and fits(f"{lines[-1]} {w}"):
            lines[-1] += f" {w}"
        else:
            lines.append(w)
    return lines


def wrap_text(most: int):
    """UDF: lines of at most `most` characters; longer words stand alone; empty text is one line."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: (greedy_lines((t or "").split(), lambda x: len(x) <= most) if most > 0 else []) or [t or ""])

    return run


def wrap_title(most: int = 28, lines: int = 3):
    """UDF: at most `lines` lines joined by a line break; what does not fit ends in three dots."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(t):
            got = greedy_lines((t or "").split(), lambda x: len(x) <= most)
            if len(got) > lines:
                last = got[lines - 1]
                room = most - 3
                got = [*got[: lines - 1], f"{last}..." if len(last) <= room else f"{last[:room].rstrip()}..." if room > 0 else last]
            return "\n".join(got)

        return s.map(one)

    return run


def estimated_units(text: str) -> int:
    return sum(WIDTHS[0] if c in NARROW else WIDTHS[2] if c in WIDE else WIDTHS[1] for c in text)


def wrap_by_width(units: int):
    """UDF: lines of at most `units` hundredths of the font size."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: greedy_lines((t or "").split(), lambda x: estimated_units(x) <= units) or [""])

    return run


def wrap_balanced(units: int, most_lines: int = 4):
    """UDF: the fewest lines that fit (at most most_lines), with the least widest - 0.3 * narrowest line, without a lone word of up to four letters after the first line; the whole text in one line where there is no such split."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: balanced_lines((t or "").split(), units, most_lines))

    return run


def balanced_lines(words: list[str], units: int, most_lines: int = 4) -> list[str]:
    """The lines of wrap_balanced. Only breaks after which a line still fits are tried, so the work is bounded by the words of a line, not of the text."""
    space = estimated_units(" ")
    upto = [0, *itertools.accumulate(estimated_units(w) + space for w in words)]
    width = lambda i, j: upto[j] - upto[i] - space
    if not words or upto[-1] - space > most_lines * (units + space):
        return [" ".join(words)]

    def splits(i: int, n: int):
        """Ends of the n lines from word i on, earliest first."""
        if n == 1:
            if width(i, len(words)) <= units:
                yield (len(words),)
            return
        for j in range(i + 1, len(words) - n + 2):
            if width(i, j) > units:
                break
            if width(j, len(words)) <= (n - 1) * (units + space):
                for rest in splits(j, n - 1):
                    yield (j, *rest)

    for n in range(1, min(most_lines, len(words)) + 1):
        best = None
        for ends in splits(0, n):
            lines = list(zip((0, *ends), ends))  # noqa: B905  one start more than ends
            if any(j == i + 1 and len(words[i]) <= 4 for i, j in lines[1:]):
                continue
            wide = [width(i, j) for i, j in lines]
            score = 10 * max(wide) - 3 * min(wide)
            if best is None or score < best[0]:
                best = score, lines
        if best:
            return [" ".join(words[i:j]) for i, j in best[1]]
    return [" ".join(words)]


def slice_text(text: Column, words: Column | None, seg_start: Column, seg_end: Column, lo: Column, hi: Column) -> Column:
    """The part of a segment's text inside [lo, hi): its timed words, else the proportional share of its words.

    Texts of up to three words, windows over the whole segment and degenerate windows give the whole text.
    """
    raw = squeeze(text)
    parts = F.split(raw, " ")
    n = F.size(parts)
    length = F.greatest(seg_end - seg_start, F.lit(1))
    share = lambda t: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (t - seg_start) / length))
    a, b = share(lo), share(hi)
    first = F.greatest(F.lit(0), F.least(n - 1, F.floor(a * n))).cast("int")
    last = F.greatest(first + 1, F.least(n, F.ceil(b * n))).cast("int")
    proportional = F.when((b <= a) | ((a <= 0.001) & (b >= 0.999)) | (n <= 3), raw).otherwise(F.array_join(F.slice(parts, first + 1, last - first), " "))
    if words is None:
        return proportional
    timed = F.array_join(F.transform(F.filter(words, lambda w: (w["end"] > lo) & (w["start"] < hi) & (squeeze(w["word"]) != "")), lambda w: squeeze(w["word"])), " ")
    return F.when(F.coalesce(timed, F.lit("")) != "", timed).otherwise(proportional)


#: Title rules: all of some words (each a list of alternatives) in a text give the title. Fixed values.
TITLE_RULES = [
    ([["вмк"], ["мехмат"]], "ВМК против мехмата: куда идти?"),
    ([["вмк"], ["физфак"]], "ВМК или физфак: что выбрать?"),
    ([["вмк"], ["поступ"]], "Поступление на ВМК: что важно знать?"),
    ([["задач"]], "Как решать задачи и не застревать?"),
    ([["учител", "репетитор"], ["физ"]], "Репетитор по физике нужен или нет?"),
    ([["факульт", "поступ", "вуз"]], "Как выбрать факультет и не пожалеть?"),
]
#: Words that do not begin a title; fixed values.
TITLE_FILLERS = ("ну", "вот", "короче", "типа", "знаешь", "слушай")


def title_of(text: Column, rules: list | None = None, fillers: tuple[str, ...] = TITLE_FILLERS) -> Column:
    """The title of the first rule that a text meets, else its first sentence as a question (8 words, 64 characters); null where that has fewer than 8 characters."""
    low = F.lower(text)
    has = lambda need: functools.reduce(Column.__and__, (functools.reduce(Column.__or__, (F.contains(low, F.lit(w)) for w in ws)) for ws in need))
    phrase = F.trim(F.regexp_replace(F.split(text, "[.!?]", 2)[0], "^[ \t\r\n,:;-]+|[ \t\r\n,:;-]+$", ""))
    phrase = F.regexp_replace(phrase, rf"(?iu)^({'|'.join(fillers)})\s+", "")
    phrase = F.trim(F.substring(F.array_join(F.slice(F.split(phrase, " "), 1, 8), " "), 1, 64))
    phrase = F.concat(F.upper(F.substring(phrase, 1, 1)), F.substring(phrase, 2, 64))
    out = F.when(F.length(phrase) >= 8, F.when(phrase.endswith("?"), phrase).otherwise(F.concat(phrase, F.lit("?"))))
    for need, title in reversed(TITLE_RULES if rules is None else rules):
        out = F.when(has(need), F.lit(title)).otherwise(out)
    return out
