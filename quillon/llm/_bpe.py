"""Byte-level BPE ids for many texts at once.

Text is cut into pieces with array operations, each distinct piece is encoded
once by the public ``tiktoken`` ranks (the same vocabulary as the ``tokenizers``
file; the tests hold the ids against it), and ids are gathered per text. A text
with a contraction, a special token spelled out or a character outside the
scripts classified here goes through the library whole, so every text gets the
library's own ids.
"""

from __future__ import annotations

import base64
import re
import unicodedata

import numpy as np

from quillon.llm._arrow import span_hashes, splitmix

#: Code points below this one are classified here; others take the slow path.
KNOWN = 0x0530
_CONTRACTION = re.compile(r"'(?:[stmd]|re|ve|ll)")
_UNKNOWN = re.compile(f"[^\\x00-{chr(KNOWN - 1)}]")
_WHITE = [*range(9, 14), 0x20, 0x85, 0xA0]
SLOTS = 1 << 21


def _classes() -> np.ndarray:
    kinds = np.zeros(KNOWN, np.uint8)
    for c in range(KNOWN):
        kinds[c] = {"L": 1, "N": 2}.get(unicodedata.category(chr(c))[0], 0)
    kinds[_WHITE] = 3
    return kinds


class Encoder:
    """Encodes batches of texts; one per Python worker."""

    def __init__(self, ranks_path: str, pattern: str, special: tuple[tuple[str, int], ...] = ()):
        import tiktoken

        with open(ranks_path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(special))
        self.special = re.compile("|".join(re.escape(t) for t, _ in special)) if special else None
        self.kinds = _classes()
        self.table = splitmix(np.arange(KNOWN, dtype=np.uint64))
        self.width = np.zeros(max(ranks.values()) + 1, np.int64)
        for piece, rank in ranks.items():
            self.width[rank] = len(piece)
        self._reset()

    def _reset(self) -> None:
        self.keys = np.zeros(SLOTS, np.uint64)
        self.where = np.zeros(SLOTS, np.int32)
        self.flat = np.zeros(1 << 16, np.uint32)
        self.begin = np.zeros(1 << 16, np.int64)
        self.length = np.zeros(1 << 16, np.int64)
        self.used = self.pieces = 0

    def _keep(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Store the ids of some pieces; returns their places."""
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.pieces + len(counts) > len(self.begin):
            self.begin = np.concatenate([self.begin, np.zeros_like(self.begin)])
            self.length = np.concatenate([self.length, np.zeros_like(self.length)])
        self.flat[self.used : self.used + len(ids)] = ids
        places = np.arange(self.pieces, self.pieces + len(counts))
        self.begin[places] = self.used + np.cumsum(counts) - counts
        self.length[places] = counts
        self.used += len(ids)
        self.pieces += len(counts)
        return places

    def _encode_pieces(self, joined: str, codes: np.ndarray, kind: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Encode pieces joined[a:b]; those of a blank and letters in one call, as they part again alone."""
        found = np.empty(len(a), np.int64)
        plain = (codes[a] == 0x20) & (b > a + 1) & (kind[np.minimum(a + 1, len(kind) - 1)] == 1)
        if plain.any():
            pieces = [joined[x:y] for x, y in zip(a[plain].tolist(), b[plain].tolist(), strict=True)]
            ids = np.asarray(self.library.encode_ordinary("".join(pieces)), np.uint32)
            ends = np.cumsum(self.width[ids])
            stops = np.searchsorted(ends, np.cumsum([len(p.encode()) for p in pieces])) + 1
            found[plain] = self._keep(ids, np.diff(stops, prepend=0))
        for k in np.flatnonzero(~plain).tolist():
            ids = np.asarray(self.library.encode_ordinary(joined[a[k] : b[k]]), np.uint32)
            found[k] = self._keep(ids, np.array([len(ids)]))[0]
        return found

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text as uint32."""
        out: list[np.ndarray | None] = [None] * len(texts)
        quick = []
        for i, text in enumerate(texts):
            if self.special and self.special.search(text):
                out[i] = np.asarray(self.library.encode(text, allowed_special="all"), np.uint32)
            elif _UNKNOWN.search(text) or _CONTRACTION.search(text):
                out[i] = np.asarray(self.library.encode_ordinary(text), np.uint32)
            else:
                quick.append(i)
        at = 0
        while at < len(quick):
            end, size = at, 0
            while end < len(quick) and (end == at or size + len(texts[quick[end]]) <= 1 << 20):
                size += len(texts[quick[end]])
                end += 1
            for i, ids in zip(quick[at:end], self._quick([texts[i] for i in quick[at:end]]), strict=True):
                out[i] = ids
            at = end
        return out

    def _quick(self, texts: list[str]) -> list[np.ndarray]:
        joined = "".join(texts)
        n = len(joined)
        edges = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=edges[1:])
        if not n:
            return [np.zeros(0, np.uint32) for _ in texts]
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        first = np.zeros(n + 1, bool)
        first[edges] = True
        kind = self.kinds[codes]
        white, blank = kind == 3, codes == 0x20
        run = first[:n].copy()
        run[1:] |= kind[1:] != kind[:-1]
        before = np.zeros(n, bool)  # a blank of the same text stands just before and joins this piece
        before[1:] = blank[:-1]
        before &= ~first[:n]
        start = run & (white | ~before)
        # the last of some white space is a piece of its own, or begins the next one
        last = white.copy()
        last[:-1] &= ~white[1:] | first[1:n]
        start |= last & ~first[1:]
        starts = np.flatnonzero(start)
        ends = np.append(starts[1:], n)
        hashes = span_hashes(codes, starts, ends, self.table)
        if self.used > 1 << 22:
            self._reset()
        slots = (hashes & np.uint64(SLOTS - 1)).astype(np.int64)
        index = self.where[slots].astype(np.int64)
        missed = np.flatnonzero(self.keys[slots] != hashes)
        if len(missed):
            fresh, example, back = np.unique(hashes[missed], return_index=True, return_inverse=True)
            example = missed[example]
            found = self._encode_pieces(joined, codes, kind, starts[example], ends[example])
            slot = (fresh & np.uint64(SLOTS - 1)).astype(np.int64)
            self.keys[slot], self.where[slot] = fresh, found
            index[missed] = found[back]
        counts = self.length[index]
        total = np.zeros(len(index) + 1, np.int64)
        np.cumsum(counts, out=total[1:])
        ids = self.flat[np.arange(total[-1]) + np.repeat(self.begin[index] - total[:-1], counts)]
        cuts = total[np.searchsorted(starts, edges)]
        return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
