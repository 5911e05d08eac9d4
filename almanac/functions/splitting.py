"""Recursive character splitting of one text, by positions.

A text is cut where the coarsest separator occurs; a separator stays at the
head of the piece it opens. Pieces too long are cut again with the finer
separators. Neighbouring pieces are then packed into chunks of at most
``size`` characters that share up to ``overlap`` characters.
"""

from __future__ import annotations

from collections.abc import Iterator

# Separators from coarse to fine; the empty one cuts anywhere.
SEPARATORS = ("\n\n", "\n", " ", "")


def _cuts(text: str, lo: int, hi: int, separator: str) -> list[int]:
    if separator == "":
        return list(range(lo, hi + 1))
    cuts, at = [lo], text.find(separator, lo, hi)
    while at >= 0:
        if at > lo:
            cuts.append(at)
        at = text.find(separator, at + len(separator), hi)
    return [*cuts, hi]


def _pack(cuts: list[int], size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Spans over consecutive cuts: as long as fits, stepping back by at most ``overlap``."""
    first = 0
    for i in range(len(cuts) - 1):
        start, end = cuts[i], cuts[i + 1]
        if end - cuts[first] > size and first < i:
            yield cuts[first], start
            while first < i and (start - cuts[first] > overlap or end - cuts[first] > size):
                first += 1
    yield cuts[first], cuts[-1]


def _spans(text: str, lo: int, hi: int, level: int, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    while SEPARATORS[level] != "" and text.find(SEPARATORS[level], lo, hi) < 0:
        level += 1
    cuts = _cuts(text, lo, hi, SEPARATORS[level])
    finest = SEPARATORS[level] == ""
    run = [lo]
    for start, end in zip(cuts, cuts[1:]):
        if end - start < size or finest:
            run.append(end)
            continue
        if len(run) > 1:
            yield from _pack(run, size, overlap)
        yield from _spans(text, start, end, level + 1, size, overlap)
        run = [end]
    if len(run) > 1:
        yield from _pack(run, size, overlap)


def split_text(text: str, size: int = 500, overlap: int = 50) -> list[str]:
    chunks = (text[a:b].strip() for a, b in _spans(text, 0, len(text), 0, size, overlap)) if text else ()
    return [c for c in chunks if c]
