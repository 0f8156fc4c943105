"""BPE encoding by forced boundaries.

A byte pair that occurs inside no token of the vocabulary can never be merged
over, so a text may be cut there and its fragments encoded apart: joining their ids
gives the ids of the whole. The places where the tokenizer's own split rule cuts
are certain too. Pieces repeat a lot, so each task keeps a bounded table of their
ids; the fragments of pieces not in it are merged together, as matrices.

The files are those of the ``tokenizers`` library. Ids are little-endian unsigned
32-bit integers.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from metricspark.llm.arrays import KNOWN, NUMBER, SPACE, classes, code_points, offsets, piece_hash, ragged, slices


def byte_alphabet() -> dict[int, str]:
    """Byte -> the printable character that stands for it in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Pieces:
    """Bounded table from the hashes of split pieces to their ids.

    Two independent 64-bit hashes stand for a piece. Each slot holds the latest piece
    that fell on it; ids lie in a pool, which is emptied with the table when full.
    """

    def __init__(self, bits: int = 20, pool: int = 4_000_000):
        self.shift, self.size, self.most = np.uint64(64 - bits), 1 << bits, pool
        self.clear()

    def clear(self) -> None:
        self.h1 = np.zeros(self.size, dtype=np.uint64)
        self.h2 = np.zeros(self.size, dtype=np.uint64)
        self.at = np.zeros(self.size, dtype=np.int64)
        self.n = np.zeros(self.size, dtype=np.int32)
        self.pool, self.used = np.zeros(1 << 16, dtype="<u4"), 0

    def find(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        slot = h1 >> self.shift
        return (self.h1[slot] == h1) & (self.h2[slot] == h2), self.at[slot], self.n[slot]

    def add(self, h1: np.ndarray, h2: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Place of each new piece's ids in the pool."""
        need = self.used + len(ids)
        if need > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(need, 2 * len(self.pool)) - len(self.pool), "<u4")])
        self.pool[self.used : need] = ids
        at = self.used + np.cumsum(counts) - counts
        self.used = need
        slot = h1 >> self.shift
        self.h1[slot], self.h2[slot], self.at[slot], self.n[slot] = h1, h2, at, counts
        return at


def both(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Two hashes as one value that sorts and compares."""
    out = np.empty(len(h1), dtype=[("a", np.uint64), ("b", np.uint64)])
    out["a"], out["b"] = h1, h2
    return out


class Merges:
    """The merge rules of a vocabulary, looked up for arrays of pairs."""

    BITS = 20

    def __init__(self, merges: list[tuple[int, int, int]]):
        self.new = np.array([c for _, _, c in merges], dtype=np.int64)
        size = 1 << self.BITS
        self.keys = np.full(size, 2**64 - 1, dtype=np.uint64)
        self.ranks = np.full(size, self.none, dtype=np.int32)
        self.probes = 1
        for rank, (a, b, _) in enumerate(merges):
            key = a << 32 | b
            slot = (key * 0x9E3779B97F4A7C15 % 2**64) >> (64 - self.BITS)
            for k in range(size):
                s = (slot + k) % size
                if self.keys[s] == 2**64 - 1:
                    self.keys[s], self.ranks[s] = key, rank
                    self.probes = max(self.probes, k + 1)
                    break

    none = 2**31 - 1

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, ``none`` where there is no rule for it."""
        key = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
        slot = ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)
        out = np.full(key.shape, self.none, dtype=np.int32)
        for k in range(self.probes):
            s = (slot + k) & ((1 << self.BITS) - 1)
            out = np.where(self.keys[s] == key, self.ranks[s], out)
        return out

    def apply(self, symbols: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Merge each row of a matrix as far as it goes: (rows, their final symbols).

        Every round merges, in each row that still has a rule, the leftmost pair of the
        lowest rank; rows in work thus keep one length.
        """
        done, rows = [], np.arange(len(symbols))
        ranks = self.rank(symbols[:, :-1], symbols[:, 1:])
        while len(rows):
            if symbols.shape[1] == 1:
                done.append((rows, symbols))
                break
            j = ranks.argmin(axis=1)
            i = np.arange(len(rows))
            best = ranks[i, j]
            go = best != self.none
            if not go.all():
                done.append((rows[~go], symbols[~go]))
                rows, symbols, ranks, j, best = rows[go], symbols[go], ranks[go], j[go], best[go]
                i = np.arange(len(rows))
                if not len(rows):
                    break
            symbols[i, j] = self.new[best]
            width = symbols.shape[1] - 1
            keep = np.arange(width) + (np.arange(width) > j[:, None])
            symbols = np.take_along_axis(symbols, keep, axis=1)
            if width > 1:
                keep = np.arange(width - 1) + (np.arange(width - 1) >= j[:, None])
                ranks = np.take_along_axis(ranks, keep, axis=1)
                left, right = j > 0, j < width - 1
                ranks[i[left], j[left] - 1] = self.rank(symbols[i[left], j[left] - 1], symbols[i[left], j[left]])
                ranks[i[right], j[right]] = self.rank(symbols[i[right], j[right]], symbols[i[right], j[right] + 1])
        return done


class ForcedBoundaryBPE:
    """Encodes and decodes with one tokenizer file, exactly as the library does.

    Two kinds of files are known: byte-level BPE with its usual split rule, and
    lower-casing BPE with word ends. Special tokens in a text are recognised as the
    library does by default; nothing is added, cut off or padded. Texts with special
    tokens, with code points from KNOWN on, or that composition may change are split
    by the library's own normalizer and splitter.
    """

    #: Fragments with more bytes go to the library's merge procedure, one at a time.
    LONG = 40

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        model = json.loads(self.tokenizer.to_str())["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.lower = self.tokenizer.normalizer is not None
        alphabet = byte_alphabet()
        self.to_alphabet = {b: ord(c) for b, c in alphabet.items()}
        from_alphabet = {c: b for b, c in alphabet.items()}
        vocab = model["vocab"]
        special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.special = {c: np.array([i], dtype="<u4") for c, i in special.items()}
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")")
        raw_of = [b""] * (max([*vocab.values(), *special.values()]) + 1)
        within = np.zeros((256, 256), dtype=bool)
        for token, i in vocab.items():
            if token in special:
                continue
            raw_of[i] = raw = bytes(from_alphabet[c] for c in token.removesuffix(self.suffix))
            for a, b in zip(raw, raw[1:]):
                within[a, b] = True
        for token, i in special.items():
            raw_of[i] = token.encode()
        #: forced[a, b]: no token holds byte a followed by byte b.
        self.forced = ~within
        self.n_bytes = np.array([len(b) for b in raw_of], dtype=np.int64)
        self.bytes_at = np.cumsum(self.n_bytes) - self.n_bytes
        self.bytes_pool = np.frombuffer(b"".join(raw_of), dtype=np.uint8)
        self.first = np.array([vocab[alphabet[b]] for b in range(256)], dtype=np.int64)
        self.last = np.array([vocab[alphabet[b] + self.suffix] for b in range(256)], dtype=np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges = Merges([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])
        self.unknown = re.compile(f"[^\\u0000-\\u{KNOWN - 1:04x}]").search
        #: Below this composition changes nothing.
        self.composed = re.compile("[^\\u0000-\\u02ff]").search
        self.table = Pieces()

    # Distinct pieces -> ids

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after the other, and how many each has."""
        sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        b = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        ends = np.cumsum(sizes)
        cut = np.zeros(len(b) + 1, dtype=bool)
        cut[1:-1] = self.forced[b[:-1], b[1:]]
        cut[0] = cut[ends] = True
        at = np.flatnonzero(cut)
        start, length = at[:-1], np.diff(at)
        symbols = self.first[b]
        if self.suffix:
            symbols[ends - 1] = self.last[b[ends - 1]]
        counts = np.zeros(len(start), dtype=np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for n in np.unique(length):
            here = np.flatnonzero(length == n)
            if n > self.LONG:
                for f in here:
                    s, e = int(start[f]), int(at[f + 1])
                    found.append((np.array([f]), self.merge_long(symbols[s:e])[None, :]))
                continue
            matrix = symbols[start[here][:, None] + np.arange(n)]
            found += [(here[rows], out) for rows, out in self.merges.apply(matrix)]
        for rows, out in found:
            counts[rows] = out.shape[1]
        where = np.cumsum(counts) - counts
        ids = np.zeros(int(counts.sum()), dtype="<u4")
        for rows, out in found:
            ids[where[rows][:, None] + np.arange(out.shape[1])] = out
        piece = np.searchsorted(ends, start, side="right")
        return ids, np.bincount(piece, weights=counts, minlength=len(pieces)).astype(np.int64)

    def merge_long(self, symbols: np.ndarray) -> np.ndarray:
        """Merge one long run of symbols, with a heap of pairs by rank and place."""
        s = symbols.tolist()
        n = len(s)
        ranks = self.merges.rank(symbols[:-1], symbols[1:])
        heap = [(int(ranks[i]), i, s[i], s[i + 1]) for i in np.flatnonzero(ranks != self.merges.none).tolist()]
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def offer(i: int, j: int) -> None:
            r = int(self.merges.rank(np.array([s[i]]), np.array([s[j]]))[0])
            if r != self.merges.none:
                heapq.heappush(heap, (r, i, s[i], s[j]))

        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if s[i] != a or j >= n or s[j] != b:
                continue
            s[i], s[j] = int(self.merges.new[r]), -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return np.array([x for x in s if x >= 0], dtype=np.int64)

    # Texts -> pieces

    def cut_points(self, cp: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of every piece of the split rule; cp has known code points only."""
        n = len(cp)
        kind = np.full(n + 1, 255, dtype=np.uint8)
        kind[:n] = classes(cp)
        prev = np.full(n + 1, 254, dtype=np.uint8)
        prev[1:] = kind[:-1]
        head = np.zeros(n + 1, dtype=bool)
        head[at] = True
        prev[head] = 254
        following = np.zeros(n + 4, dtype=np.uint32)
        following[:n] = cp
        new = (kind != prev) | head
        if self.lower:
            new |= kind == NUMBER
            free = new
        else:
            blank = np.zeros(n + 1, dtype=bool)
            blank[:n] = cp == 32
            # A run of white space gives its last one to what follows, unless the text ends.
            ends_space = np.zeros(n + 1, dtype=bool)
            ends_space[:n] = (kind[:n] == SPACE) & (kind[1:] != SPACE) & ~head[1:]
            joins = np.zeros(n + 1, dtype=bool)
            joins[1:] = ends_space[:-1] & blank[:-1]
            new = (new & ~joins) | ends_space
            free = new
        # 's 't 'm 'd 're 've 'll: an apostrophe that begins a piece takes them along.
        quote = np.flatnonzero(free[:n] & (cp == 39))
        if len(quote):
            stop = at[np.searchsorted(at, quote, side="right")]
            x, y = following[quote + 1], following[quote + 2]
            two = np.isin(x, [ord(c) for c in "stmd"]) & (quote + 1 < stop)
            three = (((x == ord("r")) | (x == ord("v"))) & (y == ord("e"))) | ((x == ord("l")) & (y == ord("l")))
            three &= quote + 2 < stop
            for hit, size in ((two, 2), (three, 3)):
                q = quote[hit]
                for k in range(1, size):
                    new[q + k] = False
                new[q + size] = True
                # Numbers and spaces after it begin pieces anyway; a text's end is a head.
        new[head] = True
        start = np.flatnonzero(new[:n])
        end = np.append(start[1:], n)
        if self.lower:
            keep = kind[start] != SPACE
            start, end = start[keep], end[keep]
        return start, end

    def encode_known(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without special tokens and with known code points only."""
        cp, at = code_points(texts)
        start, end = self.cut_points(cp, at)
        hashes = [piece_hash(seed)(cp, start, end) for seed in (11, 12)]
        return self.gather(*hashes, np.searchsorted(start, at), lambda i: (start[i], end[i]), "".join(texts))

    def gather(self, h1, h2, first_piece, span, whole: str) -> tuple[np.ndarray, np.ndarray]:
        if self.table.used > self.table.most:
            self.table.clear()
        hit, at, n = self.table.find(h1, h2)
        n = n.astype(np.int64)
        miss = np.flatnonzero(~hit)
        if len(miss):
            _, pick, back = np.unique(both(h1[miss], h2[miss]), return_index=True, return_inverse=True)
            s, e = span(miss[pick])
            pieces = [whole[i:j].encode() for i, j in zip(s.tolist(), e.tolist())]
            ids, counts = self.encode_pieces(pieces)
            place = self.table.add(h1[miss[pick]], h2[miss[pick]], ids, counts)
            at[miss], n[miss] = place[back], counts[back]
        ids = ragged(self.table.pool, at, n)
        return ids, offsets(n)[first_piece]

    def prepared(self, text: str) -> str | None:
        """The text as the split rule takes it, None if the library has to split it."""
        if "<|" in text and self.special_split.search(text):
            return None
        if text.isascii():
            return text.lower() if self.lower else text
        if self.lower:
            return None if self.composed(text) else text.lower()
        return None if self.unknown(text) else text

    def encode_odd(self, text: str) -> np.ndarray:
        """Ids of any text, split by the library."""
        out = []
        for part in self.special_split.split(text):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                if self.lower:
                    part = self.tokenizer.normalizer.normalize_str(part)
                pieces = [part[i:j].encode() for _, (i, j) in self.tokenizer.pre_tokenizer.pre_tokenize_str(part)]
                if pieces:
                    out.append(self.encode_pieces(pieces)[0])
        return np.concatenate(out) if out else np.zeros(0, dtype="<u4")

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts one after the other, and where each text's ids begin."""
        ready = [self.prepared(t) for t in texts]
        ids, at = self.encode_known([t for t in ready if t is not None])
        if None not in ready:
            return ids, at
        parts, k = [], 0
        for text, r in zip(texts, ready):
            if r is None:
                parts.append(self.encode_odd(text))
            else:
                parts.append(ids[at[k] : at[k + 1]])
                k += 1
        return np.concatenate(parts), offsets([len(p) for p in parts])

    def encode_slices(self, texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first, end, ids, offsets) of bounded slices of the texts, in order."""
        for i, j in slices(texts):
            yield i, j, *self.encode_batch(texts[i:j])

    def encode(self, text: str) -> np.ndarray:
        return self.encode_batch([text])[0]

    def decode(self, ids: np.ndarray) -> str:
        """As the library decodes byte-level ids, special tokens kept."""
        return ragged(self.bytes_pool, self.bytes_at[ids], self.n_bytes[ids]).tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=4)
def coder(path: str) -> ForcedBoundaryBPE:
    """One coder for each file and worker process; path: on every executor."""
    return ForcedBoundaryBPE(path)


def tokenizer_path(name: str) -> str:
    """Place of an installed public tokenizer file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
