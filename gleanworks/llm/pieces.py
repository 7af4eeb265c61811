"""Splitting oversized texts at natural boundaries.

The least number of pieces that cuts no word (but words longer than a piece) is computed from the limit and the
boundaries, equal targets are placed, and each target is snapped to the strongest boundary near it that leaves the rest
divisible in the same way.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanworks.functions.markdown import LINES, markdown_blocks

# --- boundaries ------------------------------------------------------------------------------------------------------

#: Strength of a cut before a character: the stronger, the further a target may be moved to it.
HEADING, BLOCK, LINE, SENTENCE, CLAUSE, WORD = 6, 5, 4, 3, 2, 1
#: How far a target may move for each strength, as a share of the target length.
REACH = {HEADING: 0.35, BLOCK: 0.3, LINE: 0.22, SENTENCE: 0.2, CLAUSE: 0.12, WORD: 0.1}

_SENTENCE = re.compile(r"[.!?…][\"')\]»”*_]*\s+")
_CLAUSE = re.compile(r"[,;:–—][\"')\]»”]*\s+")
_WORD = re.compile(r"\s+")


def boundaries(text: str, blocks: list[tuple[str, int, int]] | None = None) -> np.ndarray:
    """Strength of a cut at each position of the text (0 to its length); 0 inside a word. ``blocks``: its Markdown blocks, if known."""
    strength = np.zeros(len(text) + 1, np.int8)
    for pattern, level in ((_WORD, WORD), (_CLAUSE, CLAUSE), (_SENTENCE, SENTENCE)):
        for m in pattern.finditer(text):
            strength[m.end()] = level
    for m in LINES.finditer(text):
        strength[m.end()] = max(strength[m.end()], LINE)
    for kind, start, end in markdown_blocks(text) if blocks is None else blocks:
        strength[start] = HEADING if kind == "heading" else BLOCK
        if kind == "heading":  # a heading stays with what follows it
            after = re.compile(r"\s*").match(text, end).end()
            strength[end : after + 1] = 0
            strength[end] = 0
        elif kind in ("code_block", "table"):  # inside, only ends of lines are natural
            inner = strength[start + 1 : end]
            inner[inner < LINE] = np.minimum(inner[inner < LINE], WORD)
    return strength


def cut_points(text: str, limit: int, overlap: int, strength: np.ndarray | None = None) -> list[int]:
    """Ends of the new parts of the pieces; piece i is the text from ``end[i-1] - overlap`` to ``end[i]``."""
    n = len(text)
    if n <= limit:
        return [n]
    room = limit - overlap  # new characters in every piece but the first
    if strength is None:
        strength = boundaries(text)
    places = {level: np.flatnonzero(strength >= level) for level in REACH}
    spots = _spots(places[WORD], n, limit, room)
    pieces, at = 1, 0
    while n - at > (room if at else limit):  # as far as each piece can go: the least number of pieces
        at = int(spots[np.searchsorted(spots, at + (room if at else limit), side="right") - 1])
        pieces += 1
    lows, low = [], n
    for _ in range(pieces - 1):  # from the end: where each cut has to lie at least, that the rest can be cut at spots
        low = int(spots[np.searchsorted(spots, low - room)])
        lows.append(low)
    ends, at = [], 0
    for i, low in enumerate(reversed(lows)):
        high, low = min(n - 1, at + (room if i else limit)), max(at + 1, low)
        target = min(max(at + (n - at) / (pieces - i), at + 1, n - (pieces - 1 - i) * room), high)
        at = snap(places, spots, target, low, high, n / pieces)
        ends.append(at)
    return [*ends, n]


def _spots(found: np.ndarray, n: int, limit: int, room: int) -> np.ndarray:
    """Where cuts may lie: at boundaries, and anywhere between two that are further apart than a piece can be long."""
    known = np.unique(np.concatenate(([0], found, [n])))
    wide = np.flatnonzero(np.diff(known) > np.where(known[:-1] > 0, room, limit))
    inside = [np.arange(known[k] + 1, known[k + 1]) for k in wide]
    spots = np.sort(np.concatenate([known, *inside]))
    return spots[(spots > 0) & (spots < n)]


def snap(places: dict[int, np.ndarray], spots: np.ndarray, target: float, low: int, high: int, length: float) -> int:
    """The strongest boundary that is near enough to the target, the nearest of equal ones; else the nearest spot."""
    best, worth = int(target), -1.0
    for level, found in places.items():
        reach = REACH[level] * length
        a, b = max(low, int(target - reach)), min(high, int(target + reach))
        i, j = np.searchsorted(found, a), np.searchsorted(found, b, side="right")
        if i >= j:
            continue
        near = found[i:j]
        pick = int(near[np.argmin(np.abs(near - target))])
        value = level - 1.5 * abs(pick - target) / max(1.0, reach)
        if value > worth:
            best, worth = pick, value
    if worth < 0:  # no boundary near: any between the limits will do before a word is cut
        for found in (places[WORD], spots):
            i, j = np.searchsorted(found, low), np.searchsorted(found, high, side="right")
            if i < j:
                near = found[i:j]
                return int(near[np.argmin(np.abs(near - target))])
    return best


def clean_limits(limit: int | None, overlap: int | None) -> tuple[int | None, int]:
    """A limit below 1 or missing is none; an overlap is at least 0 and leaves half of a piece for new text."""
    if limit is None or limit < 1:
        return None, 0
    return int(limit), max(0, min(int(overlap or 0), limit // 2 if limit > 1 else 0))


def _read(batches: Iterator[pa.RecordBatch], make) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield from make(zip(*(b.column(c).to_pylist() for c in ("md_id", "content", "max_chars", "overlap_chars")), strict=True))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def make(rows):
        out = []
        for key, text, limit, overlap in rows:
            limit, overlap = clean_limits(limit, overlap)
            if not text or not limit or len(text) <= limit:
                continue
            blocks = markdown_blocks(text)
            cuts = cut_points(text, limit, overlap, boundaries(text, blocks))[:-1]
            for no, (kind, start, end) in enumerate(blocks, 1):
                inside = bisect_left(cuts, end) - bisect_right(cuts, start)
                if inside > 0:
                    out.append((key, no, kind, end - start, limit, inside))
        cols = list(zip(*out, strict=True)) or [[]] * 6
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=["md_id", "block_no", "kind", "chars", "max_chars", "cuts"])

    return _read(batches, make)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def make(rows):
        names = ["md_id", "piece_no", "start", "end", "overlap", "strength", "piece"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()]
        out, size = [], 0
        for key, text, limit, overlap in rows:
            if not text or not text.strip():
                continue
            limit, overlap = clean_limits(limit, overlap)
            strength = boundaries(text) if limit and len(text) > limit else None
            ends = [len(text)] if strength is None else cut_points(text, limit, overlap, strength)
            at = 0
            for no, end in enumerate(ends, 1):
                back = min(overlap, at) if no > 1 else 0
                out.append((key, no, at - back, end, back, int(strength[at]) if strength is not None and at else None, text[at - back : end]))
                size += end - at + back
                at = end
            if size > 1 << 24:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                out, size = [], 0
        cols = list(zip(*out, strict=True)) or [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return _read(batches, make)


def _once(texts: DataFrame) -> DataFrame:
    """One row per md_id: the latest that has a content (a row delivered twice counts once)."""
    order = F.struct(F.col("content").isNotNull().alias("has"), F.col("updated_at") if "updated_at" in texts.columns else F.lit(0).alias("updated_at"), "content")
    rows = texts.filter("md_id is not null").groupBy(F.col("md_id").cast("bigint").alias("md_id"))
    rows = rows.agg(F.max_by(F.struct("content", F.col("max_chars").cast("int").alias("max_chars"), F.col("overlap_chars").cast("int").alias("overlap_chars")), order).alias("x"))
    return rows.select("md_id", "x.content", "x.max_chars", "x.overlap_chars")


def divided_blocks(texts: DataFrame) -> DataFrame:
    """Blocks that a cut between two pieces divides: ``md_id, block_no, kind, chars, max_chars, cuts``.

    Characters are code points, the line end that closes a block included. A missing or non-positive max_chars is no
    limit and divides nothing; null, blank and empty texts have no blocks; further columns are ignored.
    """
    return _once(texts).mapInArrow(_blocks, "md_id bigint, block_no int, kind string, chars bigint, max_chars int, cuts int")


def oversized_blocks(texts: DataFrame) -> DataFrame:
    """Blocks that had to be divided: of those that the pieces of ``split_texts`` cut, the ones longer than max_chars.

    A block of more than max_chars characters lies whole in no piece, so some cut divides it; a shorter one that is cut
    lies across the border of two pieces and could be whole in another division.
    """
    return divided_blocks(texts).filter("chars > max_chars").drop("max_chars")


def split_texts(texts: DataFrame) -> DataFrame:
    """Pieces of every text: ``md_id, piece_no, start, end, overlap, strength, piece``.

    A piece is ``content[start:end]``, has at most max_chars characters and begins with the last ``overlap`` of the
    piece before it; without the overlaps the pieces are the text. strength tells what was cut (6 heading, 5 block,
    4 line, 3 sentence, 2 clause, 1 word, 0 inside a word, null at the beginning). overlap_chars is honoured up to
    half of max_chars; a missing max_chars is no limit; null and blank texts give no piece.
    """
    return _once(texts).mapInArrow(_pieces, "md_id bigint, piece_no int, start bigint, end bigint, overlap int, strength int, piece string")
