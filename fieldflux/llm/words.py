"""Words of many texts at once as numpy arrays: places, 64-bit hashes, hashes of word runs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
PIECE = 1 << 19
BLOCK = 1 << 15  # words whose keys are made at once, in the cache
LONG = 64  # bytes of a word, beyond which it is hashed as a run


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit (splitmix64's finish)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    if n:
        out[0] = 1
        np.cumprod(out, out=out)
    return out


class Poly:
    """Polynomial hash modulo 2^64 of any run of a sequence, from running sums."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
        self.base = int(rng.integers(1 << 60, 1 << 62)) * 8 + 3
        self.back = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.empty(0, U)

    def _room(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            self.up, self.down = _powers(self.base % (1 << 64), n), _powers(self.back, n)

    def sums(self, values: np.ndarray) -> np.ndarray:
        self._room(len(values) + 1)
        out = np.zeros(len(values) + 1, U)
        np.cumsum(values * self.up[: len(values)], out=out[1:])
        return out

    def runs(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._room(len(sums))
        return mix((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(U) * U(0x9E3779B97F4A7C15))

    def fixed(self, sums: np.ndarray, k: int) -> np.ndarray:
        """The hash of every run of k, by its start."""
        n = len(sums) - k
        if n <= 0:
            return np.empty(0, U)
        self._room(len(sums))
        return mix((sums[k:] - sums[:n]) * self.down[:n])


BYTES, BYTES2, RUNS, RUNS2 = Poly(1), Poly(2), Poly(3), Poly(4)


class Words:
    """All words of a column of texts; gap: whether a byte stands between words, the line feed included.

    buffer: the texts' bytes with a line feed between texts; starts, ends: places of words;
    first: for each text the number of its first word, and at the end the number of words."""

    def __init__(self, texts: pa.ChunkedArray | pa.Array, lower: bool = False, gap: np.ndarray = SPACE):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
            if isinstance(texts, pa.ChunkedArray):
                texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.large_string())
        texts = texts.cast(pa.large_binary())
        # A line feed after each text keeps the words of two texts apart.
        closed = pa.compute.binary_join_element_wise(
            texts.fill_null(b""), pa.scalar(b"", pa.large_binary()), pa.scalar(b"\n", pa.large_binary())
        )
        self.n = len(closed)
        if self.n:
            offsets = np.frombuffer(closed.buffers()[1], np.int64, self.n + 1, closed.offset * 8)
            raw = np.frombuffer(closed.buffers()[2], np.uint8) if closed.buffers()[2] else np.empty(0, np.uint8)
            self.buffer = raw[offsets[0] : offsets[-1]]
            self.offsets = offsets - offsets[0]
        else:
            self.buffer, self.offsets = np.empty(0, np.uint8), np.zeros(1, np.int64)
        if lower:
            self.buffer = self.buffer | ((self.buffer - np.uint8(65) < 26).view(np.uint8) << np.uint8(5))
        # Comparisons take a byte at a fraction of what a look into a table takes.
        word = (self.buffer != 32) & (self.buffer - np.uint8(9) > 4) if gap is SPACE else ~gap[self.buffer]
        change = np.zeros(len(word) + 1, bool)
        if len(word):
            change[0], change[-1] = word[0], word[-1]
            np.not_equal(word[1:], word[:-1], out=change[1:-1])
        edge = np.flatnonzero(change)
        self.starts, self.ends = edge[::2], edge[1::2]
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first)

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.counts)

    def hashes(self, poly: Poly = BYTES) -> np.ndarray:
        """A 64-bit hash of each word."""
        out = np.empty(len(self.starts), U)
        i = 0
        while i < len(self.starts):
            # Words of about PIECE bytes, one word at least.
            j = max(i + 1, int(np.searchsorted(self.ends, self.starts[i] + PIECE, "right")))
            a, b = int(self.starts[i]), int(self.ends[j - 1])
            sums = poly.sums(poly.table[self.buffer[a:b]])
            out[i:j] = poly.runs(sums, self.starts[i:j] - a, self.ends[i:j] - a)
            i = j
        return out

    def word(self, i: int) -> bytes:
        return self.buffer[self.starts[i] : self.ends[i]].tobytes()

    def hashes_of(self, some: np.ndarray, poly: Poly = BYTES) -> np.ndarray:
        """`hashes` of the words with these numbers alone: a byte of all words at a time, long words as runs."""
        out = np.empty(len(some), U)
        starts, lengths = self.starts[some], self.ends[some] - self.starts[some]
        order = np.argsort((LONG + 1 - np.minimum(lengths, LONG + 1)).astype(np.uint8), kind="stable")  # longest first
        n_long = int((lengths > LONG).sum())
        short = order[n_long:]
        at, left = starts[short], np.cumsum(np.bincount(lengths[short], minlength=LONG + 1)[::-1])[::-1]
        poly._room(LONG)
        total = np.zeros(len(short), U)
        for j in range(LONG):
            n = int(left[j + 1])  # words of more than j bytes
            if not n:
                break
            total[:n] += poly.table[self.buffer[at[:n] + j]] * poly.up[j]
        out[short] = mix(total + lengths[short].astype(U) * U(0x9E3779B97F4A7C15))
        for i in order[:n_long]:
            sums = poly.sums(poly.table[self.buffer[starts[i] : starts[i] + lengths[i]]])
            out[i] = poly.runs(sums, np.zeros(1, np.int64), lengths[i : i + 1])[0]
        return out

    def _folded(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(a, b, wide): two keys of each word from its bytes, eight at a time, and whether one of them is 128 or more.
        A word of eight bytes or less is exactly told by its keys."""
        size = len(self.buffer) // 8 + 2
        eights = np.zeros(size, "<u8")
        eights.view(np.uint8)[: len(self.buffer)] = self.buffer
        masks = np.append((U(1) << (U(8) * np.arange(8, dtype=U))) - U(1), ~U(0))

        def load(at, length):
            i, s = at >> 3, (at & 7).astype(U) << U(3)
            # The upper part is shifted in two steps, as a shift by 64 has no meaning.
            return (eights[i] >> s | eights[i + 1] << U(1) << (U(63) - s)) & masks[np.minimum(length, 8)]

        n = len(self.starts)
        a, b, high = np.empty(n, U), np.empty(n, U), np.empty(n, U)
        length = self.ends - self.starts
        for i in range(0, n, BLOCK):
            j = slice(i, i + BLOCK)
            b[j] = high[j] = load(self.starts[j], length[j])
            a[j] = mix(b[j] + length[j].astype(U) * U(0x9E3779B97F4A7C15))
        left, at = np.flatnonzero((length > 8) & (length <= LONG)), 8
        while len(left):
            more = load(self.starts[left] + at, length[left] - at)
            a[left] = mix((a[left] ^ more) * U(0xD6E8FEB86659FD93))
            b[left] = mix((b[left] + more) * U(0xA0761D6478BD642F))
            high[left] |= more
            at += 8
            left = left[length[left] > at]
        left = np.flatnonzero(length > LONG)
        wide = high & U(0x8080808080808080) != 0
        if len(left):
            a[left], b[left] = self.hashes_of(left, BYTES), self.hashes_of(left, BYTES2)
            places = np.flatnonzero(self.buffer >= 128)
            wide[left] = np.searchsorted(places, self.ends[left]) > np.searchsorted(places, self.starts[left])
        return a, b, wide

    def numbered(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What `distinct` returns, for texts whose words come again and again: words are met by cheaper keys,
        and only the different ones are hashed.  Sets `wide`: whether each word has a byte of 128 or more."""
        n = len(self.starts)
        a, b, self.wide = self._folded()
        # Keys with the places in their last bits are sorted as plain numbers, which is much faster than their order.
        bits = U(n.bit_length())
        order = np.sort(a >> bits << bits | np.arange(n, dtype=U))
        order = (order & ((U(1) << bits) - U(1))).astype(np.int64)
        a, b = a[order], b[order]
        new = np.ones(n, bool)
        new[1:] = a[1:] != a[:-1]
        if (a[1:] < a[:-1]).any() or (b[1:] != b[:-1])[~new[1:]].any():
            return self.distinct()  # two words share a key's first bits: practically never
        which = np.empty(n, np.int64)
        which[order] = np.cumsum(new) - 1
        first = order[new]
        h = self.hashes_of(first)
        order = np.argsort(h)
        keys = h[order]
        if (keys[1:] == keys[:-1]).any():
            return self.distinct()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return keys, first[order], place[which]

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, first place, number of it for each word) of the different words; two words of
        one 64-bit hash are told apart by a second one."""
        h = self.hashes()
        keys, first, which = np.unique(h, return_index=True, return_inverse=True)
        other = self.hashes(BYTES2)
        wrong = other != other[first[which]]
        if wrong.any():
            # Practically never: give the odd words a key of their own.
            h = h.copy()
            h[wrong] = mix(h[wrong] ^ other[wrong])
            keys, first, which = np.unique(h, return_index=True, return_inverse=True)
        return keys, first, which


def gathered(lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Indices of the runs (start, length) one after another."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) - np.repeat(ends - lengths - starts, lengths)


def sliding(x: np.ndarray, w: int, least: bool = True) -> np.ndarray:
    """Least (or largest) of every w neighbours, by the start of the window."""
    pick = np.minimum if least else np.maximum
    if len(x) < w:
        return x[:0]
    got, size = x, 1
    while size * 2 <= w:
        got = pick(got[:-size], got[size:])
        size *= 2
    rest = w - size
    return pick(got[: len(got) - rest], got[rest:]) if rest else got
