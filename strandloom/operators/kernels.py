"""Vector kernels of semi-global alignment: one read position at a time over all graph nodes."""

from __future__ import annotations

import math

import numpy as np

#: Letters as small numbers; a separator carries no edge, N equals nothing.
CODES = np.full(256, 9, dtype=np.uint8)
for _i, _c in enumerate(b"ACGT"):
    CODES[_c] = _i
SEPARATOR = 255
_COMPLEMENT = bytes.maketrans(b"ACGT", b"TGCA")


def encode(seq: str) -> np.ndarray:
    return CODES[np.frombuffer(seq.encode("ascii", "replace"), dtype=np.uint8)]


def encode_read(seq: str) -> np.ndarray:
    """As encode, with other letters kept apart from those of a reference: they equal nothing."""
    codes = encode(seq)
    codes[codes == 9] = 8
    return codes


def reversed_complement(seq: str) -> str:
    return seq.encode("ascii", "replace").translate(_COMPLEMENT)[::-1].decode()


#: Number types of the cells of a strip, the narrowest first, and the cost from which each only says "at least so much".
LADDER = ((np.uint8, 120), (np.int16, 16_000), (np.int32, 1 << 29))


def lay_out(chains: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of chains side by side with a separator behind each but the last, and the first node of each."""
    width = np.array([len(c) + 1 for c in chains], dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(width)[:-1]])
    codes = encode("|".join(chains))
    codes[first[1:] - 1] = SEPARATOR
    return codes, first


class Finder:
    """Finds reads letter by letter: a table of their first letters, as many as WIDTHS allow, is asked at every node once for all reads."""

    WIDTHS = (12, 8, 4, 1)

    def __init__(self, reads: list[str]):
        self.coded, heads = [encode_read(r) for r in reads], {}
        for r, read in enumerate(self.coded):
            width = next((w for w in self.WIDTHS if w <= len(read)), 0)
            if width and int(read.max()) < 4:  # other letters stand nowhere
                heads.setdefault(width, {}).setdefault(int(pack(read[:width], width)[0]), []).append(r)
        self.heads = heads

    def places(self, codes: np.ndarray):
        """(number of a read, the nodes at which it begins) over chains of lay_out."""
        for width, words in self.heads.items():
            if len(codes) < width:
                continue
            wanted = np.zeros(4**width, dtype=bool)
            wanted[list(words)] = True
            packed = pack(codes, width)
            met = np.flatnonzero(wanted[packed])
            met = met[np.argsort(packed[met], kind="stable")]
            word, lo = np.unique(packed[met], return_index=True)
            for w, begin, end in zip(word.tolist(), lo.tolist(), [*lo[1:].tolist(), len(met)], strict=True):
                for r in words[w]:
                    read = self.coded[r]
                    at = met[begin:end]
                    at = at[at + len(read) <= len(codes)]
                    for j, c in enumerate(read.tolist()):  # those of the word too, which may hold a separator
                        at = at[codes[at + j] == c]
                        if not len(at):
                            break
                    else:
                        yield r, at


def pack(codes: np.ndarray, width: int) -> np.ndarray:
    """The words of `width` letters at every node as numbers, two bits a letter, of which only A, C, G and T are told apart."""
    out = (codes[: len(codes) - width + 1] & 3).astype(np.uint32)
    for j in range(1, width):
        out <<= 2
        out |= codes[j : len(codes) - width + 1 + j] & 3
    return out


class Strip:
    """Edges of one or more chains in a row: codes hold the letter from node j to node j + 1, SEPARATOR where there is no edge.

    A read goes over all nodes letter by letter. Cells are of the narrowest type
    of LADDER that holds its least cost; costs from the type's limit on are cut
    to it, and where nothing stays below the next type takes over.
    """

    def __init__(self, codes: np.ndarray, costs: tuple[int, int, int, int]):
        self.codes, self.costs = codes, costs
        self.border = np.flatnonzero(codes == SEPARATOR)
        self.priced: dict = {}

    def _price(self, kind, cap: int, c: int) -> np.ndarray:
        """Of each edge for the read letter c."""
        key = (kind, c)
        if key not in self.priced:
            self.priced[key] = np.where(self.codes == c, kind(min(self.costs[0], cap)), kind(min(self.costs[1], cap)))
            self.priced[key][self.border] = cap
        return self.priced[key]

    def _skip(self, kind, cap: int, k: int) -> np.ndarray:
        """Price of leaving out 2**k edges in a row, at each node that has as many behind it."""
        key = (kind, "skip", k)
        if key not in self.priced:
            if k == 0:
                one = np.full(len(self.codes), min(self.costs[3], cap), dtype=kind)
                one[self.border] = cap
            else:
                half = self._skip(kind, cap, k - 1)
                one = np.minimum(half[: len(half) - (1 << (k - 1))] + half[1 << (k - 1) :], kind(cap))
            self.priced[key] = one
        return self.priced[key]

    def rungs(self, least: int) -> list:
        """The types that can tell a cost of `least` from more."""
        fit = [(kind, cap) for kind, cap in LADDER if cap > least and cap + self.costs[2] <= np.iinfo(kind).max]
        return fit or [LADDER[-1]]

    def sweep(self, read: np.ndarray, kind, cap: int, now: np.ndarray, rows: list | None = None) -> np.ndarray:
        """Costs after the letters of read, from the costs now, which is written over; rows receives them after each letter."""
        ins, dele, size = self.costs[2], self.costs[3], len(now)
        along = np.empty(max(size - 1, 0), dtype=kind)
        for c in read.tolist():
            np.add(now[:-1], self._price(kind, cap, c), out=along)
            np.add(now, kind(ins), out=now)
            np.minimum(now[1:], along, out=now[1:])
            np.minimum(now, kind(cap), out=now)
            # k edges left out in a row, for every k that can pay: by powers of two
            spread, k = int(now.max()) - int(now.min()), 0
            while dele << k < spread and 1 << k < size:
                step = 1 << k
                out = along[: size - step]
                np.add(now[:-step], self._skip(kind, cap, k), out=out)
                np.minimum(now[step:], out, out=now[step:])
                k += 1
            if rows is not None:
                rows.append(now.copy())
        return now

    def costs_of(self, read: np.ndarray) -> tuple[np.ndarray, int]:
        """Least cost of the whole read ending at each node, started anywhere, and the cost from which they are cut."""
        for kind, cap in self.rungs(len(read) * max(self.costs[:2])):
            now = self.sweep(read, kind, cap, np.zeros(len(self.codes) + 1, dtype=kind))
            if int(now.min()) < cap:
                break
        return now, cap


class Rows:
    """Rows of a dynamic programme by their number, of which only every isqrt(n)-th is kept and a block at a time recomputed."""

    def __init__(self, first: np.ndarray, letters: np.ndarray, sweep):
        self.letters, self.sweep, self.step = letters, sweep, max(1, math.isqrt(len(letters)))
        self.kept, self.base, self.block = [first.copy()], -1, []
        now = first
        for lo in range(0, len(letters), self.step):
            now = sweep(letters[lo : lo + self.step], now, None)
            self.kept.append(now.copy())
        self.last = now

    def __getitem__(self, i: int) -> np.ndarray:
        base = max(0, i - 1) // self.step
        if base != self.base:
            self.base, self.block = base, [self.kept[base]]
            self.sweep(self.letters[base * self.step : (base + 1) * self.step], self.kept[base].copy(), self.block)
        return self.block[i - base * self.step]

    def pair(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows i and i - 1, which lie in one block."""
        row = self[i]
        return row, self.block[i - 1 - self.base * self.step]


def chain_costs(codes: np.ndarray, read: np.ndarray, costs: tuple[int, int, int, int]) -> np.ndarray:
    """Least cost of the whole read ending at each node of a chain, started anywhere; far above the least one they may be cut."""
    return Strip(codes, costs).costs_of(read)[0]


def batch_costs(codes: np.ndarray, reads: np.ndarray, costs: tuple[int, int, int, int]) -> np.ndarray:
    """As chain_costs for many pairs at once: codes (pairs, width), padded by SEPARATOR on the right, and reads (pairs, length)."""
    match, subst, ins, dele = costs
    most = (reads.shape[1] + 2) * (max(costs) + 1)
    kind, far = (np.int16, 30_000) if most < 14_000 else (np.int32, 1 << 30)
    pad = np.where(codes == SEPARATOR, far // 2, 0).astype(kind)
    padded = bool(pad.any())
    now = np.zeros((len(codes), codes.shape[1] + 1), dtype=kind)
    for i in range(reads.shape[1]):
        along = now[:, :-1] + np.where(codes == reads[:, i : i + 1], kind(match), kind(subst))
        if padded:
            along = np.minimum(along, kind(far // 2)) + pad
        now = now + kind(ins)
        np.minimum(now[:, 1:], along, out=now[:, 1:])
        while True:
            skip = now[:, :-1] + kind(dele)
            if padded:
                skip = np.minimum(skip, kind(far // 2)) + pad
            if not (skip < now[:, 1:]).any():
                break
            np.minimum(now[:, 1:], skip, out=now[:, 1:])
    if padded:
        # a node behind a separator belongs to the padding
        now[:, 1:][codes == SEPARATOR] = far
    return now


def straight_path(codes: np.ndarray, read: str, costs: tuple[int, int, int, int], end: int, cost: int) -> tuple[int, list[tuple[str, str]]] | None:
    """The path without gaps to node `end`, if it has that cost: chain_path would return the same."""
    start = end - len(read)
    if start < 0:
        return None
    equal = codes[start:end] == encode_read(read)
    n = int(equal.sum())
    if n * costs[0] + (len(read) - n) * costs[1] != cost:
        return None
    return start, [(c, "ORIG" if e else "SUBST") for c, e in zip(read, equal.tolist(), strict=True)]


def chain_path(codes: np.ndarray, read: str, costs: tuple[int, int, int, int], end: int) -> tuple[int, list[tuple[str, str]]]:
    """Start node and steps (label, type) of an optimal alignment that ends at node `end`; matches and substitutions are preferred, then insertions.

    Memory is that of about 2 * isqrt(len(read)) rows.
    """
    match, subst, ins, dele = costs
    coded, strip = encode_read(read), Strip(codes[:end], costs)
    for kind, cap in strip.rungs(len(read) * max(match, subst)):
        rows = Rows(np.zeros(end + 1, dtype=kind), coded, lambda letters, now, out, kind=kind, cap=cap: strip.sweep(letters, kind, cap, now, out))
        if int(rows.last[end]) < cap:
            break
    i, v, steps = len(read), end, []
    while i > 0:
        row, above = rows.pair(i)
        here = int(row[v])
        edge = v > 0 and codes[v - 1] != SEPARATOR
        equal = edge and codes[v - 1] == coded[i - 1]
        if edge and int(above[v - 1]) + (match if equal else subst) == here:
            steps.append((read[i - 1], "ORIG" if equal else "SUBST"))
            i, v = i - 1, v - 1
        elif int(above[v]) + ins == here:
            steps.append((read[i - 1], "INS"))
            i -= 1
        else:
            steps.append(("e", "DEL"))
            v -= 1
    return v, steps[::-1]


class Graph:
    """Edges sorted by target, for a minimum over each node's in-edges."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, label: list[str]):
        self.ids = np.unique(np.concatenate([src, dst]))
        s, d = np.searchsorted(self.ids, src), np.searchsorted(self.ids, dst)
        order = np.lexsort((s, d))
        self.src, self.dst = s[order], d[order]
        self.code = CODES[np.frombuffer("".join(label).encode(), dtype=np.uint8)][order]
        self.heads, self.first = np.unique(self.dst, return_index=True)

    def rows(self, read: np.ndarray, costs: tuple[int, int, int, int]) -> Rows:
        """The costs of all nodes after every letter; of the last row all optimal ends can be traced."""
        return Rows(np.zeros(len(self.ids), dtype=np.int32), read, lambda letters, now, out: self.sweep(letters, costs, now, out))

    def sweep(self, read: np.ndarray, costs: tuple[int, int, int, int], now: np.ndarray, rows: list | None = None) -> np.ndarray:
        """As Strip.sweep, on any graph; deletions are closed until none improves, so cycles settle."""
        match, subst, ins, dele = costs
        for c in read.tolist():
            nxt = now + ins
            if len(self.src):
                along = now[self.src] + np.where(self.code == c, match, subst)
                nxt[self.heads] = np.minimum(nxt[self.heads], np.minimum.reduceat(along, self.first))
                while True:
                    skip = np.minimum.reduceat(nxt[self.src] + dele, self.first)
                    if not (skip < nxt[self.heads]).any():
                        break
                    nxt[self.heads] = np.minimum(nxt[self.heads], skip)
            now = nxt.astype(np.int32)
            if rows is not None:
                rows.append(now)
        return now

    def path(self, rows: Rows, read: str, costs: tuple[int, int, int, int], end: int) -> tuple[int, list[tuple[str, str]]]:
        match, subst, ins, dele = costs
        coded = encode_read(read)
        i, v, steps, left = len(read), end, [], 0
        while i > 0:
            row, above = rows.pair(i)
            here, lo = int(row[v]), int(np.searchsorted(self.dst, v))
            hi = int(np.searchsorted(self.dst, v, side="right"))
            for e in range(lo, hi):
                equal = self.code[e] == coded[i - 1]
                if int(above[self.src[e]]) + (match if equal else subst) == here:
                    steps.append((read[i - 1], "ORIG" if equal else "SUBST"))
                    i, v, left = i - 1, int(self.src[e]), 0
                    break
            else:
                if int(above[v]) + ins == here:
                    steps.append((read[i - 1], "INS"))
                    i, left = i - 1, 0
                else:
                    # a free deletion could circle; a walk of more steps than nodes has done so
                    e = next(e for e in range(lo, hi) if int(row[self.src[e]]) + dele == here and left <= len(self.ids))
                    steps.append(("e", "DEL"))
                    v, left = int(self.src[e]), left + 1
        return v, steps[::-1]
