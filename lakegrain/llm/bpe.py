"""Byte-level BPE on cached pieces, and BPE by prefix dynamic programming.

Two engines share one text walker:

* :class:`LibraryPieces` asks the ``tokenizers`` library for pieces it has not seen;
* :class:`PrefixPieces` runs the prefix dynamic programme of :class:`PrefixBpe`.

Why pieces can be cached: the split pattern of these vocabularies never lets a
piece hold white space after a character that is not white space, nor a mark after
a letter or digit.  So a text may be cut before each single blank that follows such a
character and between an ASCII letter or digit and a mark; every such *unit*
splits into pieces on its own, and equal units always give equal ids.  A text in
which a blank has white space on both sides (or ends the text after white space)
is the one case where that cut could differ; it takes the slow path as a whole.

Caches are bounded (``max_entries``), so a worker's memory does not grow with the corpus.
"""

from __future__ import annotations

import base64
import re
from array import array

import numpy as np
import public_tokenizers
import regex

from .kernels import ragged_take, span_hashes

#: Units that a worker's table holds (some 40 bytes each), the bytes of the longest, and entries of the cache of other pieces.
MAX_ENTRIES, MAX_CACHED, MAX_PIECES = 1_000_000, 128, 30_000
#: Entries of a prefix engine's tables of pairs and of prefixes.
PAIRS, PREFIXES = 300_000, 100_000

#: Marks, and the letters and digits that they follow: a piece always ends between the two, so texts are cut there too.
_MARK, _PLAIN = np.zeros(256, bool), np.zeros(256, bool)
_MARK[list(b".,;:!?)")] = True
_PLAIN[[c for c in range(128) if chr(c).isalnum()]] = True

#: A blank between white space, or one that follows white space and ends the text.
_AMBIGUOUS = re.compile(r"(?:^|\s) (?:\s|$)")
#: Bytes that can end, and that can begin, a character of white space.
_SPACE_END, _SPACE_START = np.zeros(256, bool), np.zeros(256, bool)
for _c in filter(str.isspace, map(chr, range(0x3001))):
    _SPACE_END[_c.encode()[-1]] = _SPACE_START[_c.encode()[0]] = True


def ambiguous(text: str) -> bool:
    return _AMBIGUOUS.search(text) is not None


def _alphabet() -> dict[int, int]:
    """Byte -> the printable character that byte-level vocabularies write for it."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, n = {b: b for b in plain}, 0
    for b in range(256):
        if b not in out:
            out[b], n = 256 + n, n + 1
    return out


_ALPHABET = _alphabet()
_BLANK = chr(_ALPHABET[32])


def load_ranks(path: str) -> dict[bytes, int]:
    """Rank file (base64 token, rank per line) as {token bytes: rank}."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class UnitTable:
    """Ids of known units, found by the 128-bit hash of a unit: five flat arrays, some 40 bytes for a unit.

    Holds ``most`` units at most; when more come, those that the last chunk did not use go.
    """

    def __init__(self, most: int):
        self.most = most
        self.one, self.two = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.start, self.len = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, "<u4")

    def find(self, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the units stand in the table, and which of them do."""
        if not len(self.one):
            return np.zeros(len(one), np.int64), np.zeros(len(one), bool)
        at = np.minimum(np.searchsorted(self.one, one), len(self.one) - 1)
        return at, (self.one[at] == one) & (self.two[at] == two)

    def add(self, one: np.ndarray, two: np.ndarray, lens: np.ndarray, flat: np.ndarray, used: np.ndarray) -> None:
        """Units that ``find`` lacked, in any order; ``used``: places of those that it had."""
        if len(self.one) + len(one) > self.most:
            used = np.unique(used)
            self.flat = ragged_take(self.flat, self.start, self.len, used)
            self.one, self.two, self.len = self.one[used], self.two[used], self.len[used]
            self.start = np.cumsum(self.len) - self.len
        start = len(self.flat) + np.cumsum(lens) - lens
        order = np.argsort(one, kind="stable")
        at = np.searchsorted(self.one, one[order])
        self.one, self.two = np.insert(self.one, at, one[order]), np.insert(self.two, at, two[order])
        self.start, self.len = np.insert(self.start, at, start[order]), np.insert(self.len, at, lens[order])
        self.flat = np.concatenate([self.flat, flat])


class PieceCache:
    """Encodes chunks of texts unit by unit; equal units of a chunk are looked up once, and those of earlier chunks in a table.

    ``encode_plain`` takes the bytes of a blank or ASCII letter and ASCII letters, ``encode_piece`` any piece.
    """

    def __init__(self, encode_plain, encode_piece, pattern: str, specials: list[str] = (), encode_special=None, max_entries: int = MAX_ENTRIES):
        self.encode_plain, self.encode_piece, self.split = encode_plain, encode_piece, regex.compile(pattern).findall
        self.specials, self.encode_special = list(specials), encode_special
        self.special = regex.compile("|".join(map(regex.escape, self.specials))).search
        self.least_special = min((len(s.encode()) for s in self.specials), default=1 << 62)
        self.table = UnitTable(max_entries)
        self.pieces: dict[str, bytes] = {}

    def unit(self, data: bytes) -> bytes:
        text = data.decode("utf-8", "replace")
        if len(data) >= self.least_special and self.special(text):  # the library finds these before it splits
            return self.encode_special(text)
        return b"".join([self.pieces.get(x) or self.piece(x) for x in self.split(text)])

    def piece(self, p: str) -> bytes:
        ids = self.encode_piece(p)
        if len(p) <= MAX_CACHED:
            if len(self.pieces) >= MAX_PIECES:
                self.pieces.clear()
            self.pieces[p] = ids
        return ids

    def encode_chunk(self, buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of texts end to end, text k at bounds[k]:bounds[k + 1] -> (ids, where each text's ids begin, and the end)."""
        from pandas import factorize  # loaded where texts are encoded only

        n = len(bounds) - 1
        if not len(buf):
            return np.zeros(0, "<u4"), np.zeros(n + 1, np.int64)
        blanks = np.flatnonzero(buf == 32)
        data = buf.tobytes()
        whole = set()  # texts that may not be cut
        prev = np.where(blanks > 0, buf[blanks - 1], 32)
        after = buf[np.minimum(blanks + 1, len(buf) - 1)]
        ends = np.isin(blanks, np.concatenate([bounds[1:] - 1, bounds[:-1]]))
        odd = blanks[ends | (_SPACE_END[prev] & _SPACE_START[after])]
        for k in np.unique(np.searchsorted(bounds, odd, "right") - 1).tolist():
            text = data[bounds[k] : bounds[k + 1]].decode("utf-8", "replace")
            if ambiguous(text):
                whole.add(k)
        for s in self.specials:
            if (at := data.find(s.encode())) >= 0:
                while at >= 0:
                    whole.add(int(np.searchsorted(bounds, at, "right") - 1))
                    at = data.find(s.encode(), at + 1)
        cut = np.zeros(len(buf) + 1, bool)
        cut[blanks] = True
        cut[1:-1] |= _MARK[buf[1:]] & _PLAIN[buf[:-1]]
        for k in whole:
            cut[bounds[k] : bounds[k + 1]] = False
        cut[bounds] = True
        starts = np.flatnonzero(cut)
        starts, stops = starts[:-1], starts[1:]
        one, two = span_hashes(buf, starts, stops)
        inverse, keys = factorize(one)
        first = np.empty(len(keys), np.int64)
        first[inverse[::-1]] = np.arange(len(one) - 1, -1, -1)
        if not np.array_equal(two[first][inverse], two):  # a collision of 64 bits: tell units apart by 128
            pairs = np.stack([one, two], 1)
            _, first, inverse = np.unique(pairs, axis=0, return_index=True, return_inverse=True)
            inverse = inverse.reshape(-1)
        one, two, table = one[first], two[first], self.table
        at, known = table.find(one, two)
        new = np.flatnonzero(~known)
        sizes = (stops - starts)[first[new]]
        new = new[np.argsort(sizes > MAX_CACHED, kind="stable")]  # long units come last and are not kept
        n_kept = int(np.count_nonzero(sizes <= MAX_CACHED))
        plain, unit, values = self.encode_plain, self.unit, []
        for a, b in zip(starts[first[new]].tolist(), stops[first[new]].tolist()):
            key = data[a:b]
            values.append(plain(key) if key[1:].isalpha() and (key[0] == 32 or key[:1].isalpha()) else unit(key))
        got = np.frombuffer(b"".join(values), "<u4")
        got_lens = np.fromiter(map(len, values), np.int64, len(values)) >> 2
        lens, begin = np.empty(len(one), np.int64), np.empty(len(one), np.int64)
        lens[known], begin[known] = table.len[at[known]], table.start[at[known]]
        lens[new], begin[new] = got_lens, len(table.flat) + np.cumsum(got_lens) - got_lens
        ids = ragged_take(np.concatenate([table.flat, got]), begin, lens, inverse)
        total = np.concatenate([[0], np.cumsum(lens[inverse])])
        keep = new[:n_kept]
        fresh = np.unique(one[keep], return_index=True)[1]  # of units with one hash of 64 bits one is kept
        if len(fresh) == n_kept and not np.isin(one[keep], table.one[at[~known]] if len(table.one) else table.one).any():
            table.add(one[keep], two[keep], got_lens[:n_kept], got[: int(got_lens[:n_kept].sum())], at[known])
        return ids, total[np.searchsorted(starts, bounds)]


class Pieces:
    """What both engines offer: ids of single texts, and of chunks of UTF-8."""

    cache: PieceCache

    def encode(self, text: str | None) -> bytes:
        """Ids as packed little-endian uint32."""
        data = (text or "").encode("utf-8", "replace")
        return self.cache.encode_chunk(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0].tobytes()

    def encode_chunk(self, buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.cache.encode_chunk(buf, bounds)


class LibraryPieces(Pieces):
    """Encodes texts as ``Tokenizer.encode(text, add_special_tokens=False)`` of the tokenizers library does."""

    def __init__(self, path: str, specials_as_text: bool = False, max_entries: int = MAX_ENTRIES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = specials_as_text
        self.tokenize = self.tokenizer.model.tokenize
        specials = [] if specials_as_text else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cache = PieceCache(self._plain, self._piece, public_tokenizers.PATTERN, specials, self._whole, max_entries)

    def _plain(self, data: bytes) -> bytes:
        text = _BLANK + data[1:].decode() if data[0] == 32 else data.decode()
        return array("I", [t.id for t in self.tokenize(text)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        """The library's model on one piece, whose bytes are written in the model's alphabet."""
        if piece.isascii() and piece.isprintable():  # only the blank is written otherwise
            known = piece.replace(" ", _BLANK)
        else:
            known = piece.encode().decode("latin-1").translate(_ALPHABET)
        return array("I", [t.id for t in self.tokenize(known)]).tobytes()

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


class PrefixBpe:
    """BPE of one piece by prefix dynamic programming.

    For every byte prefix exactly one token can be the last of its encoding.
    ``last[i]`` holds it for the prefix of ``i`` bytes: of the tokens that end at
    ``i`` it is the one that encodes itself and forms a valid pair with the last
    token of the prefix before it.  Following ``last`` backwards gives the
    encoding, an append only extends the table, and after an edit only positions
    from the edit on are computed again.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.tokens[r] = t
        self.longest = max(map(len, ranks))
        #: Every suffix of a token: while the bytes before a position are none of these, no longer token ends there.
        self.suffixes = {t[i:] for t in ranks for i in range(len(t))}
        self._pair: dict[int, bool] = {}
        self._self: dict[int, bool] = {}
        self._prefixes: dict[bytes, int] = {}

    def merges(self, piece: bytes) -> list[int]:
        """The definition: repeatedly join the adjacent pair of lowest rank, leftmost first."""
        parts, ranks = [piece[i : i + 1] for i in range(len(piece))], self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def own(self, token: int) -> bool:
        """Whether the token's bytes encode to the token itself."""
        ok = self._self.get(token)
        if ok is None:
            ok = self._self[token] = self.merges(self.tokens[token]) == [token]
        return ok

    def pair(self, left: int, right: int) -> bool:
        """Whether the two tokens stay as they are when their bytes meet."""
        key = left << 32 | right
        ok = self._pair.get(key)
        if ok is None:
            if len(self._pair) > PAIRS:
                self._pair.clear()
            ok = self._pair[key] = self.own(right) and self.merges(self.tokens[left] + self.tokens[right]) == [left, right]
        return ok

    def extend(self, data: bytes, last: list[int], start: int = 0) -> list[int]:
        """Fills the table for prefixes longer than ``start``; ``last[0]`` is -1. Shorter entries are kept."""
        del last[start + 1 :]
        rank, suffixes, pair, own, known = self.ranks.get, self.suffixes, self.pair, self.own, self._pair
        for i in range(len(last), len(data) + 1):
            j = i - 1
            while j >= 0 and (tail := data[j:i]) in suffixes:
                t = rank(tail)
                if t is not None:
                    if j == 0:
                        if own(t):
                            break
                    else:
                        ok = known.get(last[j] << 32 | t)
                        if pair(last[j], t) if ok is None else ok:
                            break
                j -= 1
            else:
                raise ValueError("the vocabulary lacks a byte")
            last.append(t)
        return last

    def read(self, last: list[int], end: int | None = None) -> list[int]:
        """Ids of the prefix of ``end`` bytes."""
        i, out = len(last) - 1 if end is None else end, []
        while i > 0:
            out.append(last[i])
            i -= len(self.tokens[last[i]])
        return out[::-1]

    def table(self, data: bytes) -> list[int]:
        return self.extend(data, [-1])

    def encode(self, piece: bytes) -> list[int]:
        """As the rank library does: a piece that is a token is that token, whatever merges would give."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        known, n = self._prefixes, len(piece) - 1
        while n > 0 and piece[:n] not in known:
            n -= 1
        last = [-1, *(known[piece[:i]] for i in range(1, n + 1))] if n else [-1]
        self.extend(piece, last, n)
        if len(piece) <= 64:  # all prefixes of a known prefix are known
            if len(known) > PREFIXES:
                known.clear()
                n = 0
            for i in range(n + 1, len(piece) + 1):
                known[piece[:i]] = last[i]
        return self.read(last)

    def append(self, data: bytes, last: list[int], more: bytes) -> tuple[bytes, list[int]]:
        """Exact re-encoding state after an append."""
        return data + more, self.extend(data + more, last, len(data))

    def edit(self, data: bytes, last: list[int], at: int, removed: int, new: bytes) -> tuple[bytes, list[int]]:
        """Exact state after replacing ``removed`` bytes at ``at``; prefixes before ``at`` are reused."""
        out = data[:at] + new + data[at + removed :]
        return out, self.extend(out, last, at)


class PrefixPieces(Pieces):
    """Encodes texts as the rank library does without special tokens, by :class:`PrefixBpe`; decodes ids."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN, max_entries: int = MAX_ENTRIES):
        self.bpe = PrefixBpe(load_ranks(path))
        self.cache = PieceCache(self._plain, self._piece, pattern, max_entries=max_entries)
        self.lens = np.array([len(t) for t in self.bpe.tokens], np.int64)
        self.flat = np.frombuffer(b"".join(self.bpe.tokens), np.uint8)
        self.starts = np.cumsum(self.lens) - self.lens

    def _plain(self, data: bytes) -> bytes:
        return array("I", self.bpe.encode(data)).tobytes()

    def _piece(self, piece: str) -> bytes:
        return array("I", self.bpe.encode(piece.encode("utf-8", "replace"))).tobytes()

    def decode_chunk(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts end to end -> (their bytes, where each text begins, and the end)."""
        total = np.concatenate([[0], np.cumsum(self.lens[ids])])
        return ragged_take(self.flat, self.starts, self.lens, ids), total[bounds]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bpe.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))
