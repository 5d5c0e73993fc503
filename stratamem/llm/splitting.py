"""Cutting long texts into overlapping pieces at natural boundaries.

The least number of pieces is computed from the limit and the overlap, equal-length targets
are placed, and each target is moved to the strongest boundary nearby: blank line, line end,
sentence end, clause end, space, and otherwise a place that splits no grapheme. If a limit
cannot be kept with that number, pieces are added.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

_BREAKS = re.compile(
    r"(?P<p>(?:\r\n|\n|\r)(?:[ \t]*(?:\r\n|\n|\r))+[ \t]*)"
    r"|(?P<l>\r\n|\n|\r| | )"
    r"|(?P<s>[.!?…]+[\"'”’)\]]*\s+|[。！？]+[」』”]*)"
    r"|(?P<c>[,;:]\s+|[、，；：])"
    r"|(?P<w>\s+)"
)
_STRENGTH = {"p": 5, "l": 4, "s": 3, "c": 2, "w": 1}


def boundaries(text: str) -> tuple[list[int], list[int]]:
    """Offsets at which a piece may start, ascending, and how strong each is."""
    at, strength = [], []
    for m in _BREAKS.finditer(text):
        at.append(m.end())
        strength.append(_STRENGTH[m.lastgroup])
    return at, strength


def _safe_cut(text: str, low: int, high: int) -> int:
    """The last offset in (low, high] that splits no grapheme; ``high`` if there is none."""
    best = high
    for m in regex.finditer(r"\X", text, pos=low, endpos=min(len(text), high + 64)):
        if m.end() > high:
            break
        best = m.end()
    return best if best > low else high


def _attempt(text: str, n: int, limit: int, overlap: int, at: list[int], strength: list[int]) -> list[tuple[int, int]] | None:
    size = len(text)
    each = (size + (n - 1) * overlap) / n
    reach = each * 0.3
    pieces, start = [], 0
    for k in range(1, n):
        target = each + (k - 1) * (each - overlap)
        floor = pieces[-1][1] if pieces else 0  # every piece brings new text
        high = min(start + limit, int(target + reach), size - 1)
        low = max(floor + 1, int(target - reach))
        if low > high:
            return None
        i, j = bisect_left(at, low), bisect_right(at, high)
        if i < j:
            end = at[max(range(i, j), key=lambda x: (strength[x], -abs(at[x] - target)))]
        else:
            end = _safe_cut(text, max(floor, min(int(target), high) - 200), min(int(target) + 1, high))
        pieces.append((start, end))
        first = max(end - overlap, start + 1)
        x = bisect_left(at, first)
        if x < len(at) and at[x] < end:
            start = at[x]
        else:
            start = next((m.end() for m in regex.finditer(r"\X", text, pos=max(0, first - 16), endpos=end) if m.end() >= first), end)
    pieces.append((start, size))
    return pieces if size - start <= limit else None


def split_offsets(text: str, limit: int = 1000, overlap: int = 100) -> list[tuple[int, int]]:
    """``[start, end)`` of each piece of ``text``, which is taken as it is (trim it before)."""
    if limit < 1 or not 0 <= overlap < limit:
        raise ValueError("limit must be positive and overlap smaller than limit")
    size = len(text)
    if size <= limit:
        return [(0, size)] if size else []
    at, strength = boundaries(text)
    n = 1 + -(-(size - limit) // (limit - overlap))
    while n < 2 * size:
        if (found := _attempt(text, n, limit, overlap, at, strength)) is not None:
            return found
        n += max(1, n // 50)
    step = limit - overlap
    return [(s, min(s + limit, size)) for s in range(0, size - overlap, step)]


def _pieces(limit: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, no, start, end, parts, chars = [], [], [], [], [], 0

            def flush() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays(
                    [pa.array(keys, batch.schema.field(0).type), pa.array(no, pa.int32()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(parts, pa.string())],
                    names=["rec_id", "piece_no", "start_pos", "end_pos", "piece"],
                )

            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = raw.strip()
                lead = len(raw) - len(raw.lstrip()) if text else 0
                for k, (s, e) in enumerate(split_offsets(text, limit, overlap)):
                    keys.append(key), no.append(k), start.append(lead + s), end.append(lead + e), parts.append(text[s:e])
                    chars += e - s
                    if chars > 8_000_000:
                        yield flush()
                        keys, no, start, end, parts, chars = [], [], [], [], [], 0
            yield flush()

    return run


def split_texts(df: DataFrame, id_col: str, text_col: str, limit: int = 1000, overlap: int = 100) -> DataFrame:
    """``(rec_id, piece_no, start_pos, end_pos, piece)``: ordered pieces of every text.

    Whitespace at both ends is left out; offsets are 0-based code points of the text as
    stored. Each piece is at most ``limit`` code points, starts at most ``overlap`` before
    the end of the one before, and together they cover the trimmed text. A text within the
    limit is one piece, a null or blank text none; repeated rows give repeated pieces.
    """
    src = df.select(F.col(id_col).alias("rec_id"), F.col(text_col).alias("text")).where("text is not null")
    kind = src.schema["rec_id"].dataType.simpleString()
    return src.mapInArrow(_pieces(limit, overlap), f"rec_id {kind}, piece_no int, start_pos bigint, end_pos bigint, piece string")


def oversized(df: DataFrame, id_col: str, text_col: str, limit: int = 1000, overlap: int = 100) -> DataFrame:
    """``rec_id`` of the texts that :func:`split_texts` cuts. Texts short before trimming skip the cutter."""
    return split_texts(df.where(F.length(text_col) > limit), id_col, text_col, limit, overlap).where("piece_no = 1").select("rec_id")
