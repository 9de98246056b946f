"""BPE encoding and decoding with a public vocabulary, by a pair occurrence index.

The different words of a large batch of a partition are laid out as one long row of symbols.
The index maps each mergeable pair to all its places in that row.  Ranks are taken in ascending
order from a heap of those that occur: all places of a rank are merged at once, and the lists of
the pairs that this makes or breaks are brought up to date (a broken place is noticed when its
own rank comes).  In such a vocabulary a pair that holds a merged symbol always ranks after the
merge that makes it, which `Vocabulary` checks, so this order gives each word the same symbols as
merging word by word.  Ranks with many places are merged by numpy, the long tail one by one.

Words seen before by the same worker are looked up, in a table of limited size.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, mapped, worker_cache
from .words import Words, gathered

VOCABULARY = "word_bpe_49k.json"
WHITE = "\t-\r \x85\xa0  -     　"
MANY = 48  # places of a rank from which numpy merges them


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_symbols() -> list[str]:
    """The printable character for each byte, as byte-level vocabularies write them."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """Encoder for a vocabulary whose words end in a marked symbol."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        end, ids = model["end_of_word_suffix"], model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens: dict[int, str] = {i: t for t, i in [*ids.items(), *self.special.items()]}
        symbols = byte_symbols()
        self.inner = np.array([ids[s] for s in symbols], np.int32)
        self.last = np.array([ids[s + end] for s in symbols], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.left = np.array([ids[a] for a, _ in pairs], np.int64)
        self.right = np.array([ids[b] for _, b in pairs], np.int64)
        self.made = np.array([ids[a + b] for a, b in pairs], np.int64)
        born = {int(m): r for r, m in reversed(list(enumerate(self.made)))}
        if any(born.get(int(x), -1) >= r for side in (self.left, self.right) for r, x in enumerate(side)):
            raise ValueError("a merge ranks before one that makes its parts: ascending ranks don't apply")
        code = self.left << 16 | self.right
        self.order = np.argsort(code)
        self.code = code[self.order]
        self.rank = dict(zip(code.tolist(), range(len(code)), strict=True))
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.pattern = regex.compile(split.replace("\\s", WHITE) if "[^\\s" in split else split)
        # The same for ASCII alone: no letters, digits or white space beyond it to think of.
        self.plain = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
        self.marks = regex.compile("|".join(regex.escape(s) for s in self.special)) if self.special else None

    def _pieces(self, word: str) -> list[bytes | int]:
        """The parts of a word that are encoded apart: bytes, or the id of a special token."""
        if word.isascii() and "<|" not in word:
            return self.plain.findall(word.lower().encode())
        out, at = [], 0
        spots = list(self.marks.finditer(word)) if self.marks else []
        for m in [*spots, None]:
            part = word[at : m.start() if m else len(word)]
            part = unicodedata.normalize("NFC", part)
            # Character by character: no rule that looks at neighbours, which only sigma has.
            part = "".join(c.lower() for c in part) if "Σ" in part else part.lower()
            out += [p.encode() for p in self.pattern.findall(part)]
            if m:
                out.append(self.special[m.group()])
                at = m.end()
        return out

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after another, number of ids of each).  Each different part of
        the words is encoded once."""
        number: dict[bytes | int, int] = {}
        which, parts = [], []
        for word in words:
            got = self._pieces(word)
            parts.append(len(got))
            which += [number.setdefault(p, len(number)) for p in got]
        ids, counts = self.encode_pieces(list(number)) if number else (np.empty(0, np.int32), np.zeros(0, np.int64))
        which = np.array(which, np.int64)
        starts = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)[:-1]
        own = counts[which] if len(which) else which
        ends = np.concatenate([[0], np.cumsum(own)])[np.concatenate([[0], np.cumsum(parts)]).astype(np.int64)]
        return ids[gathered(own, starts[which])], np.diff(ends)

    def encode_pieces(self, pieces: list[bytes | int]) -> tuple[np.ndarray, np.ndarray]:
        fixed = np.array([p if isinstance(p, int) else -1 for p in pieces])
        raw = [b"?" if isinstance(p, int) else p for p in pieces]
        data, lengths = np.frombuffer(b"".join(raw), np.uint8), np.array([len(r) for r in raw])
        ends = np.cumsum(lengths)
        sym = self.inner[data]
        sym[ends - 1] = np.where(fixed >= 0, fixed, self.last[data[ends - 1]])
        left = self._merged(sym, ends)
        return sym[left], np.diff(np.searchsorted(left, np.concatenate([[0], ends])))

    def _merged(self, sym: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Merges the symbols in place; the places that are left.  A place that a merge has
        swallowed holds -1; nxt and prv chain the others, and n closes every word."""
        n = len(sym)
        nxt, prv = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        nxt[ends - 1] = n
        prv[np.concatenate([[0], ends[:-1]])] = n
        sym_ = np.append(sym, np.int32(-1))
        s, nx, pv = memoryview(sym_), memoryview(nxt), memoryview(prv)
        rank_of, index, heap = self.rank, {}, []

        def note(ranks: np.ndarray, places: np.ndarray) -> None:
            order = np.argsort(ranks, kind="stable")
            ranks, places = ranks[order], places[order]
            cut = np.flatnonzero(np.concatenate([[True], ranks[1:] != ranks[:-1]])) if len(ranks) else []
            for r, own in zip(ranks[cut].tolist() if len(ranks) else [], np.split(places, cut[1:]) if len(ranks) else [], strict=True):
                if r in index:
                    index[r].extend(own.tolist())
                else:
                    index[r] = own.tolist()
                    heapq.heappush(heap, r)

        def ranked(a: np.ndarray, b: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            code = a.astype(np.int64) << 16 | b
            at = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
            hit = (self.code[at] == code) & (a >= 0) & (b >= 0)
            return self.order[at[hit]], places[hit]

        places = np.arange(n, dtype=np.int32)
        note(*ranked(sym_[:n], sym_[nxt[:n]], places))
        while heap:
            r = heapq.heappop(heap)
            spots = index.pop(r)
            a, b, new = int(self.left[r]), int(self.right[r]), int(self.made[r])
            if len(spots) >= MANY:
                p = np.unique(np.array(spots, np.int32))
                p = p[(sym_[p] == a) & (sym_[nxt[p]] == b)]
                if a == b and len(p):
                    # Of a chain of overlapping places every other one, from the left.
                    fresh = np.concatenate([[True], p[1:] != nxt[p[:-1]]])
                    begin = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
                    p = p[(np.arange(len(p)) - begin) % 2 == 0]
                j = nxt[p]
                sym_[p], sym_[j] = new, -1
                after = nxt[j]
                nxt[p] = after
                prv[after] = p  # that of n means nothing
                before = prv[p]
                one, two = ranked(sym_[before], np.full(len(p), new), before), ranked(np.full(len(p), new), sym_[after], p)
                note(np.concatenate([one[0], two[0]]), np.concatenate([one[1], two[1]]))
                continue
            for i in sorted(spots):
                if s[i] != a:
                    continue
                j = nx[i]
                if s[j] != b:
                    continue
                s[i], s[j] = new, -1
                after, before = nx[j], pv[i]
                nx[i] = after
                pv[after] = i
                for x, y, at in ((s[before], new, before), (new, s[after], i)):
                    if x >= 0 and y >= 0:
                        got = rank_of.get(x << 16 | y)
                        if got is not None:
                            if got in index:
                                index[got].append(at)
                            else:
                                index[got] = [at]
                                heapq.heappush(heap, got)
        sym[:] = sym_[:n]
        return np.flatnonzero(sym >= 0)


class Library(Vocabulary):
    """Ids by the tokenizers library, for operators that only use them: its model encodes the parts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__(path)
        self.model = Tokenizer.from_file(path).model
        self.spelled = str.maketrans(dict(enumerate(byte_symbols())))

    def encode_pieces(self, pieces: list[bytes | int]) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = [], []
        for p in pieces:
            got = [p] if isinstance(p, int) else [t.id for t in self.model.tokenize(p.decode("latin-1").translate(self.spelled))]
            ids += got
            counts.append(len(got))
        return np.array(ids, np.int32), np.array(counts, np.int64)


class WordIds:
    """Ids of words, by the words' hash; forgets everything at `limit` words.

    Splitting at white space first changes nothing: the vocabulary drops white space, and neither
    its normal form nor its pattern nor a special token looks across it."""

    def __init__(self, encode: Callable, limit: int = 600_000):
        self.encode, self.limit = encode, limit
        self._clear()

    def _clear(self) -> None:
        self.at: dict[int, int] = {}
        self.flat = np.empty(0, np.uint16)
        self.counts = np.empty(0, np.int32)

    def __call__(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all words, number of ids of each word, number of each word's different word,
        and of the different words: where their ids start, how many)."""
        keys, first, which = words.distinct()
        if len(self.at) + len(keys) > self.limit:
            self._clear()
        got = list(map(self.at.get, keys.tolist()))
        new = [i for i, x in enumerate(got) if x is None]
        if new:
            flat, counts = self.encode([words.word(first[i]).decode("utf-8") for i in new])
            base = len(self.counts)
            self.flat = np.concatenate([self.flat, flat.astype(np.uint16)])
            self.counts = np.concatenate([self.counts, counts.astype(np.int32)])
            self.at.update(zip(keys[new].tolist(), range(base, base + len(new)), strict=True))
            for x, i in enumerate(new):
                got[i] = base + x
        at = np.array(got, np.int64)
        starts = np.concatenate([[0], np.cumsum(self.counts)])[:-1] if len(self.counts) else np.empty(0, np.int64)
        start, count = starts[at], self.counts[at].astype(np.int64)
        per_word = count[which]
        return self.flat[gathered(per_word, start[which])], per_word, which, start, count


def word_ids(path: str, library: bool) -> WordIds:
    """One for each worker."""
    held = worker_cache(("bpe", path, library))
    if "ids" not in held:
        held["ids"] = WordIds((Library if library else Vocabulary)(path).encode_words)
    return held["ids"]


def _encode(path: str, with_ids: bool):
    def work(batches: Iterator[pa.RecordBatch]):
        coder = word_ids(path, library=False)
        tokens = _tokens(path)
        for t in chunks(batches, "text", 8 << 20):
            w = Words(t["text"])
            ids, per_word, which, start, count = coder(w)
            ends = np.concatenate([[0], np.cumsum(per_word)])[w.first]
            pieces = [" ".join([tokens[i] for i in coder.flat[a : a + n].tolist()]).encode() for a, n in zip(start.tolist(), count.tolist(), strict=True)]
            n_tokens, ids_sha, decoded_sha, kept, texts = [], [], [], [], []
            for i in range(w.n):
                own = ids[ends[i] : ends[i + 1]].astype("<u4")
                spoken = which[w.first[i] : w.first[i + 1]]
                decoded = b" ".join([pieces[x] for x in spoken[count[spoken] > 0].tolist()])
                n_tokens.append(len(own))
                ids_sha.append(hashlib.sha256(own.tobytes()).hexdigest())
                decoded_sha.append(hashlib.sha256(decoded).hexdigest())
                if with_ids:
                    kept.append(own)
                    texts.append(decoded.decode())
            cols = [t["doc_id"].combine_chunks().cast(pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols += [pa.array(kept, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return work


_spoken: dict[str, dict[int, str]] = {}


def _tokens(path: str) -> dict[int, str]:
    if path not in _spoken:
        _spoken[path] = Vocabulary(path).tokens
    return _spoken[path]


def encode_decode(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row for each row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256 (and, if asked
    for, ids and decoded).

    Ids are those of the vocabulary's own library without special tokens added; the decoded text
    joins the tokens as they are by a space, as there is no decoder in the file.  Null and empty
    texts have no ids and decode to the empty text.  Special tokens that stand in a text are
    recognised.  Rows are worked on where they are, so repeated or null doc_ids change nothing;
    an empty table gives no rows; other columns are not read."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return mapped(base, _encode(path or vocabulary_path(), with_ids), schema)
