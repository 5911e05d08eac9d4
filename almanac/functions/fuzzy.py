"""Partial similarity of short names with texts.

The score of a name and a text is the best Indel similarity, in percent, of
the shorter of the two with any window of the longer: twice the longest common
subsequence over the summed lengths. Windows have the length of the shorter
string; at both ends of the longer one they may be shorter.

``least_common`` and ``least_grams`` say what a pair must share to reach a
threshold; ``NameIndex`` scores the pairs that do.
"""

from __future__ import annotations

import math

import numpy as np

WORD = 63  # characters that one machine word holds as the state of a row


def _lcs(a: str, b: str) -> int:
    """Longest common subsequence, one big integer as the state of a row."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    state = full
    for ch in b:
        hit = state & where.get(ch, 0)
        state = ((state + hit) | (state - hit)) & full
    return len(a) - state.bit_count()


def partial_ratio(a: str, b: str) -> float:
    """The plain definition for one pair."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 100.0 if not long else 0.0
    pairs = [(short, long)] if len(short) < len(long) else [(short, long), (long, short)]
    return max(_ratio_in(s, text, True, True) for s, text in pairs)


def _ratio_in(short: str, text: str, left: bool, right: bool) -> float:
    """The best window of a text; ``left`` and ``right`` allow shorter ones at its ends."""
    m, n = len(short), len(text)
    windows = [text[e - m : e] for e in range(m, n + 1)]
    if left:
        windows += [text[:e] for e in range(1, min(m, n + 1))]
    if right:
        windows += [text[i:] for i in range(max(0, n - m) + 1, n)]
    return max((200.0 * _lcs(short, w) / (m + len(w)) for w in windows), default=0.0)


def least_common(m: int, window: int, threshold: float) -> int:
    """The least common subsequence of a string of m and a window that reaches the threshold."""
    return math.ceil(round(threshold * (m + window) / 200.0, 9))


def least_grams(m: int, threshold: float, window: int | None = None) -> int:
    """How many of the m - 1 pairs of neighbours of a string of m stand in any window that reaches the threshold.

    A character that the window lacks breaks two pairs at most, one that it has besides breaks one.
    """
    windows = range(1, m + 1) if window is None else [window]
    kept = [(least_common(m, w, threshold), w) for w in windows]
    return min((m - 1 - 2 * (m - n) - (w - n) for n, w in kept if n <= min(m, w)), default=m)


class _Grams:
    """How often each name has each single character (size 1) or pair of neighbours (size 2), as a matrix."""

    def __init__(self, names: list[str], size: int):
        self.size, self.vocabulary = size, {}
        cells: dict[tuple[int, int], int] = {}
        for j, n in enumerate(names):
            for k in range(len(n) - size + 1):
                cell = self.vocabulary.setdefault(n[k : k + size], len(self.vocabulary)), j
                cells[cell] = cells.get(cell, 0) + 1
        self.counts = np.zeros((len(self.vocabulary) + 1, len(names)), np.float32)  # the last row: all other grams
        for cell, times in cells.items():
            self.counts[cell] = times

    def shared(self, pieces: list[str], longest: int) -> np.ndarray:
        """(piece, name): no less than the grams that a window of one has in common with the other."""
        other, out = len(self.vocabulary), np.zeros((len(pieces), len(self.vocabulary) + 1), np.float32)
        for r, piece in enumerate(pieces):
            ids = [self.vocabulary.get(piece[k : k + self.size], other) for k in range(len(piece) - self.size + 1)]
            if len(piece) <= longest:  # it may be the shorter string, of which each gram counts
                np.add.at(out[r], ids, 1)
            else:
                out[r, ids] = 1
        return out @ self.counts


class NameIndex:
    """Finds the best of many names for texts. Only pairs that share as much as the threshold asks for are scored.

    Texts come in pieces that overlap by the longest name, so that each window lies in one. Pieces are laid side by side,
    parted by as many blanks as the longest name has characters, and all windows of all names go forward together, one
    character a step; the state of a window is one word.
    """

    PIECE, CELLS = 512, 1 << 14  # characters of a piece; windows times names that are looked at together

    def __init__(self, names: list[str], threshold: float):
        self.names, self.threshold, self.scored = names, threshold, 0
        self.lengths = np.array([len(n) for n in names] or [0])
        self.longest = int(self.lengths.max())
        self.grams = [_Grams(names, 1), _Grams(names, 2)]
        lengths = range(self.longest + 1)
        self.needed = [
            np.array([min((n for w in range(1, m + 1) if (n := least_common(m, w, threshold)) <= w), default=1) for m in lengths]),
            np.array([least_grams(m, threshold) for m in lengths]),
        ]
        word = [min(len(n), WORD) for n in names] or [0]
        self.kind = np.uint32 if max(word) <= 32 else np.uint64
        letters = self.grams[0].vocabulary
        self.table = np.zeros((len(names), len(letters) + 1), self.kind)  # at which places of a name a character stands
        for j, n in enumerate(names):
            for k, ch in enumerate(n if len(n) <= WORD else ""):
                self.table[j, letters[ch]] |= self.kind(1 << k)

    def best(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each text the best score and the first name that reaches it; below the threshold 0 and -1."""
        best, place = np.zeros(len(texts)), np.full(len(texts), -1)
        pieces: list[tuple[int, str, bool, bool]] = []  # text, piece, and whether it begins and ends where its text does
        step = max(self.PIECE, 2 * self.longest)
        for i, t in enumerate(texts):
            spelled = next((j for j, n in enumerate(self.names) if n and (n in t or t and t in n)), None)
            if spelled is not None:  # nothing scores higher
                best[i], place[i] = 100.0, spelled
                continue
            for k in range(0, max(1, len(t) - self.longest), step) if t else ():
                pieces.append((i, t[k : k + step + self.longest], not k, k + step + self.longest >= len(t)))
        wide = max(1, self.CELLS // ((self.longest + 100) * max(1, len(self.names))))
        for k in range(0, len(pieces), 256):
            part = pieces[k : k + 256]
            may = self._may([p[1] for p in part])
            for j in range(0, len(part), wide):
                self._score(part[j : j + wide], may[j : j + wide], best, place)
        return best, place

    def _may(self, pieces: list[str]) -> np.ndarray:
        least = np.minimum(np.array([len(p) for p in pieces])[:, None], self.lengths)
        may = least > 0
        for grams, needed in zip(self.grams, self.needed):
            may &= grams.shared(pieces, self.longest) >= needed[least]
        return may

    def _score(self, part: list[tuple[int, str, bool, bool]], may: np.ndarray, best: np.ndarray, place: np.ndarray) -> None:
        live = np.flatnonzero(may.any(axis=1))
        if not len(live):
            return
        part, may = [part[r] for r in live], may[live]
        self.scored += int(may.sum())
        sizes = np.array([len(p[1]) for p in part])
        scores = np.zeros(may.shape)
        fits = may & (self.lengths <= sizes[:, None])
        columns = np.flatnonzero(fits.any(axis=0) & (self.lengths <= WORD))
        if len(columns):
            columns = columns[np.argsort(-self.lengths[columns], kind="stable")]
            wide = max(16, self.CELLS // int((sizes + self.longest).sum()))
            for k in range(0, len(columns), wide):
                scores[:, columns[k : k + wide]] = self._windows(part, sizes, columns[k : k + wide])
            scores[~fits] = 0
        # texts no longer than the name, and names that a word doesn't hold
        odd = may & ((self.lengths >= sizes[:, None]) | (self.lengths > WORD))
        for r, j in zip(*(x.tolist() for x in np.nonzero(odd))):
            _, text, left, right = part[r]
            name = self.names[j]
            if len(name) <= len(text):
                scores[r, j] = max(scores[r, j], _ratio_in(name, text, left, right))
            if len(text) <= len(name):
                scores[r, j] = max(scores[r, j], _ratio_in(text, name, True, True))
        first = scores.argmax(axis=1)
        for r, ((i, _, _, _), j) in enumerate(zip(part, first.tolist())):
            s = scores[r, j]
            if s >= self.threshold and (s > best[i] or s == best[i] and j < place[i]):
                best[i], place[i] = s, j

    def _windows(self, part: list[tuple[int, str, bool, bool]], sizes: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """(piece, column): the best window of each piece for each name, names by falling length."""
        lengths, letters, other = self.lengths[columns], self.grams[0].vocabulary, len(self.grams[0].vocabulary)
        most = int(lengths[0])
        blank = [other] * most
        ids = [c for _, text, _, _ in part for c in (*blank, *(letters.get(ch, other) for ch in text))] + blank
        masks = self.table[columns][:, np.array(ids)]
        segment = np.concatenate(([0], np.cumsum(sizes + most)))  # a piece's windows begin in the blanks before it
        n = int(segment[-1])
        full = np.array([(1 << int(m)) - 1 for m in lengths], self.kind)[:, None]
        state = np.broadcast_to(full, (len(columns), n)).copy()
        hit, more = np.empty_like(state), np.empty_like(state)
        for step in range(most):
            live = int(np.searchsorted(-lengths, -step, side="left"))  # names longer than the step
            s, h, m = state[:live], hit[:live], more[:live]
            np.bitwise_and(s, masks[:live, step : step + n], out=h)
            np.add(s, h, out=m)
            np.subtract(s, h, out=s)
            np.bitwise_or(s, m, out=s)
        lengths = lengths[:, None]
        common = lengths - np.bitwise_count(state & full).astype(np.int64)
        at, owner = np.arange(n), np.repeat(np.arange(len(part)), sizes + most)
        start = (segment[:-1] + most)[owner]
        end = start + sizes[owner]
        left, right = (np.array([p[k] for p in part])[owner] for k in (2, 3))
        inside = np.minimum(at + lengths, end) - np.maximum(at, start)
        # a window that an end cuts short counts where the text ends too
        cut = inside < lengths
        common[cut & ~(left & (at < start) | right & (at >= start)) | (inside <= 0)] = 0
        return np.maximum.reduceat(200.0 * common / (lengths + np.maximum(inside, 1)), segment[:-1], axis=1).T
