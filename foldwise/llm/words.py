"""Encoding by pieces that a tokenizer treats alone, each distinct piece encoded once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Pieces that a worker remembers once they are met again, and of those met once; which are remembered
#: changes no result.
REMEMBERED, MET = 150_000, 100_000


class Pieces:
    """Remembers the encoded bytes of pieces; `encode` takes a list of new pieces at once."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], remembered: int = REMEMBERED, met: int = MET) -> None:
        self.encode, self.known, self.met, self.most = encode, {}, {}, (remembered, met)

    def __call__(self, texts: list[list[str]]) -> list[bytes]:
        """For each text, given as its pieces, the encoded pieces joined."""
        if len(self.met) > self.most[1]:
            self.met = {}
        if len(self.known) > self.most[0]:
            self.known, self.met = {}, self.known
        known, met = self.known, self.met
        found = [list(map(known.get, pieces)) for pieces in texts]
        gaps = [[k for k, x in enumerate(row) if x is None] for row in found]
        new = {pieces[k] for pieces, at in zip(texts, gaps, strict=True) for k in at}
        again = new.intersection(met)
        now = {p: met.pop(p) for p in again}
        known.update(now)
        fresh = list(new - again)
        fresh = dict(zip(fresh, self.encode(fresh), strict=True)) if fresh else {}
        met.update(fresh)
        now |= fresh
        for pieces, row, at in zip(texts, found, gaps, strict=True):
            for k in at:
                row[k] = now[pieces[k]]
        return list(map(b"".join, found))


def runs(lengths: list[int], most: int = 1 << 20) -> list[tuple[int, int]]:
    """Runs of texts of about `most` in all, so that memory follows that and the longest text."""
    out, lo, held = [], 0, 0
    for k, n in enumerate(lengths):
        if held and held + n > most:
            out.append((lo, k))
            lo, held = k, 0
        held += n
    return [*out, (lo, len(lengths))] if lengths else out


def slices(texts: list[str], most: int = 1 << 20) -> list[tuple[int, int]]:
    """Runs of texts of about `most` characters."""
    return runs([len(t) for t in texts], most)


def split_at(ids: np.ndarray, mark: int) -> list[bytes]:
    """The bytes of the parts of ids between marks."""
    width, data = ids.itemsize, ids.tobytes()
    at = np.flatnonzero(ids == mark) * width
    return [data[a:b] for a, b in zip([0, *(at + width).tolist()], [*at.tolist(), len(data)], strict=True)]
