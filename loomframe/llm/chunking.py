"""Splitting oversized texts at natural boundaries (problem 2).

Content-defined chunking: a rolling hash over the last 32 characters marks
landmarks; the first landmark between the smallest and the largest piece size
is moved to the nearest natural boundary in that range.  Both the landmarks
and the boundaries depend on the text around them alone, so an edit changes
the pieces near it and the later cuts fall back into step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Cuts are made after a match.  Strongest first: line or sentence, clause, blank.
_PAUSES = (
    regex.compile(r"""\n+|[.!?…]+["'”’»)\]]*(?=\s)\s*|[。！？｡।॥۔؟]["'”’»」』）)\]]*[ \t]*"""),
    regex.compile(r"[,;:](?=\s)[ \t]+|[、，；：،؛]|[}\])](?:,)|(?<=[\p{Thai}]) +(?=[\p{Thai}])"),
    regex.compile(r"\s+"),
)


def rolling_hash(codes: np.ndarray) -> np.ndarray:
    """A 32-bit hash of the 32 characters up to and including each position."""
    with np.errstate(over="ignore"):
        h = codes.astype(np.uint32) * np.uint32(2654435761)
        h ^= h >> np.uint32(15)
        h *= np.uint32(2246822519)
        step = 1
        while step < 32:
            shifted = np.zeros_like(h)
            shifted[step:] = h[:-step] << np.uint32(step)
            h = h + shifted
            step *= 2
    return h


def _joins(text: str, i: int) -> bool:
    """Whether a cut before position ``i`` would tear a visible character apart."""
    if i <= 0 or i >= len(text):
        return False
    low = max(0, i - 64)
    return not any(m.start() + low == i for m in regex.finditer(r"\X", text[low : i + 4]))


def _snap(text: str, pauses: tuple[np.ndarray, ...], low: int, high: int, aim: int) -> int:
    """The boundary in ``[low, high]`` nearest to ``aim``; of the strongest kind that occurs there."""
    for ends in pauses:
        a, b = np.searchsorted(ends, low), np.searchsorted(ends, high, side="right")
        near = [int(p) for p in ends[a:b] if not _joins(text, int(p))] if b - a < 4 else None
        if near is None:
            inside = ends[a:b]
            near = [int(p) for p in inside[np.argsort(np.abs(inside - aim), kind="stable")[:4]] if not _joins(text, int(p))]
        if near:
            return min(near, key=lambda p: (abs(p - aim), p))
    for p in range(aim, max(low - 1, 0), -1):
        if not _joins(text, p):
            return p
    return aim


def cut(text: str, max_size: int = 2000, overlap: int = 200, min_size: int = 1000, spacing: int = 256) -> list[tuple[int, int, int]]:
    """``(start, end, shared)`` of the pieces of one text, ``shared`` characters being those of the piece before."""
    n = len(text)
    if n <= max_size:
        return [(0, n, 0)] if n else []
    hashes = rolling_hash(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"))
    marks = np.flatnonzero(hashes % np.uint32(spacing) == 0) + 1
    pauses = tuple(np.fromiter((m.end() for m in p.finditer(text)), np.int64) for p in _PAUSES)
    pieces, start, before = [], 0, 0
    while n - start > max_size:
        low, high = max(start + min_size, before + 1), start + max_size
        at = np.searchsorted(marks, low)
        if at < len(marks) and marks[at] <= high:
            aim = int(marks[at])
        else:
            aim = low + int(np.argmax(hashes[low - 1 : high]))
        end = _snap(text, pauses, low, high, aim)
        pieces.append((start, end, before - start))
        back = end - overlap
        start, before = _snap(text, pauses, max(back - overlap // 2, start + 1), back + overlap // 2, back), end
    pieces.append((start, n, before - start))
    return pieces


def split_oversized(
    df: DataFrame,
    id_col: str = "chunk_id",
    text_col: str = "text",
    keep: tuple[str, ...] = ("page_id", "heading_path", "position"),
    max_size: int = 2000,
    overlap: int = 200,
    min_size: int = 1000,
) -> DataFrame:
    """The pieces of every text of more than ``max_size`` code points.

    Columns: ``id_col, *keep, piece, start_pos, end_pos, overlap, text_col``;
    ``piece`` counts from 0 and ``text_col`` is ``text[start_pos:end_pos]``, of at
    most ``max_size`` code points.  ``overlap`` is the number of leading code
    points that the piece before holds too.

    Texts within the limit, empty and null texts give no piece.  Repeated rows
    count once; rows of one id that differ are cut separately.  Columns that are
    not named are ignored, so none can clash.  A stretch without any pause is cut
    at its landmark, never inside a combined character.
    """
    if not 0 <= overlap * 2 < min_size < max_size:
        raise ValueError("overlap must be under half of min_size, and min_size under max_size")
    columns = [id_col, *keep, text_col]
    long = df.select(*columns).filter(F.char_length(text_col) > max_size).distinct()
    kinds = [f for f in long.schema.fields if f.name != text_col]
    schema = T.StructType(
        [
            *kinds,
            T.StructField("piece", T.IntegerType()),
            T.StructField("start_pos", T.IntegerType()),
            T.StructField("end_pos", T.IntegerType()),
            T.StructField("overlap", T.IntegerType()),
            T.StructField(text_col, T.StringType()),
        ]
    )
    names = [f.name for f in schema.fields]

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cuts = [cut(t, max_size, overlap, min_size) for t in batch[text_col]]
            counts = [len(c) for c in cuts]
            out = batch[[id_col, *keep]].loc[batch.index.repeat(counts)].reset_index(drop=True)
            out["piece"] = [k for n in counts for k in range(n)]
            for i, name in enumerate(("start_pos", "end_pos", "overlap")):
                out[name] = [p[i] for c in cuts for p in c]
            out[text_col] = [t[a:b] for t, c in zip(batch[text_col], cuts, strict=True) for a, b, _ in c]
            yield out[names]

    return long.mapInPandas(pieces, schema)
