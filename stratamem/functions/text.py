"""Text functions: lexical tokens and ranks, windows of text, conversations, previews."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: Window and overlap of stored chunks, in code points.
CHUNK_SIZE, CHUNK_OVERLAP = 1000, 100
_GAP = re.compile(r"\s")


def tokens(c: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda t: t != "")


def query_tokens(text: str) -> list[str]:
    out, word = [], ""
    for ch in text.lower() + " ":
        if ch.isascii() and ch.isalnum():
            word += ch
        elif word:
            out.append(word)
            word = ""
    return sorted(set(out))


def lexical_match(toks: Column, query: Sequence[str]) -> Column:
    """Every query token occurs; a query without tokens matches nothing."""
    if not query:
        return F.lit(False)
    out = F.array_contains(toks, query[0])
    for q in query[1:]:
        out = out & F.array_contains(toks, q)
    return out


def lexical_rank(toks: Column, query: Sequence[str]) -> Column:
    """Summed term frequency of the query tokens; only its order is used."""
    return F.size(F.filter(toks, lambda t: t.isin(*query))) if query else F.lit(0)


def windows(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> list[str]:
    """Overlapping windows that end at white space where there is some.

    A window of ``size`` code points that ends inside the text is cut back to its last white
    space, unless that is its first character. The next one starts ``overlap`` (at most half
    of ``size``) before its end, or at its end where that would not be further on. Pieces are
    trimmed; empty ones and repeats of the one before are dropped.
    """
    size = max(1, size)
    back = min(overlap, size // 2)
    gaps = [m.start() for m in _GAP.finditer(text)]
    out: list[str] = []
    begin = 0
    while begin < len(text):
        stop = begin + size
        if stop < len(text):
            last = bisect_left(gaps, stop) - 1
            if last >= 0 and gaps[last] > begin:
                stop = gaps[last]
        piece = text[begin:stop].strip()
        if piece and out[-1:] != [piece]:
            out.append(piece)
        if stop >= len(text):
            break
        begin = stop - back if stop - back > begin else stop
    return out


def chunked(df: DataFrame, text: str = "content", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """``df`` without ``text`` and one row per window: ``ord, chunk``. Rows of null or blank text vanish."""

    @F.pandas_udf("array<string>")
    def cut(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda t: windows(t, size, overlap) if isinstance(t, str) else [])

    rest = [c for c in df.columns if c != text]
    return df.select(*rest, F.posexplode(cut(F.col(text))).alias("ord", "chunk"))


def conversation_text(df: DataFrame, by: Sequence[str], order: str, role: str = "role", text: str = "content") -> DataFrame:
    """``by + (conversation, n_turns)``: the turns as ``role: content`` lines in order."""
    line = F.concat(F.col(role), F.lit(": "), F.coalesce(F.col(text), F.lit("")))
    turns = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line"))))
    return df.groupBy(*by).agg(F.array_join(F.transform(turns, lambda x: x["line"]), "\n").alias("conversation"), F.count("*").alias("n_turns"))


def token_estimate(c: Column) -> Column:
    """A quarter of the characters."""
    return F.floor(F.length(c) / 4)


def preview(snippets: Column, width: int = 80) -> Column:
    """First line of the first of several snippets, cut to ``width`` characters, and how many others there are; ``(none)`` without any."""
    line = F.left(F.split(F.element_at(snippets, 1), "\r?\n").getItem(0), F.lit(width))
    more = F.size(snippets) - 1
    return F.when(F.coalesce(F.size(snippets), F.lit(0)) < 1, "(none)").otherwise(F.concat(F.coalesce(line, F.lit("")), F.when(more > 0, F.concat(F.lit(" (+"), more.cast("string"), F.lit(" more)"))).otherwise("")))


#: Words that carry no meaning in a search.
STOP_WORDS = tuple("a an and are as at be by for from has in is it its of on or that the this to was were will with".split())


def stems(c: Column) -> Column:
    """Analysed tokens: no stop words, plural and third-person endings removed (ies to y, then es after a hiss, then s)."""
    kept = F.filter(tokens(c), lambda t: ~t.isin(*STOP_WORDS))
    return F.transform(kept, lambda t: F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "(..)ies$", "$1y"), "(..(?:s|x|z|ch|sh))es$", "$1"), "([a-z][^su])s$", "$1"))


def profile_text(attribute: str = "attribute", value: str = "value", content: str = "content") -> Column:
    """``attribute: value``, the attribute alone, or the content of a row without one."""
    return F.when(F.col(attribute).isNotNull(), F.concat(F.col(attribute), F.coalesce(F.concat(F.lit(": "), F.col(value)), F.lit("")))).otherwise(F.col(content))
