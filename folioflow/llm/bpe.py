"""Problem 8: encoding the corpus with a public byte-level BPE vocabulary.

The merges are compiled into a transducer over bytes that is determinised as
it is used. It rests on one fact: the encoding of a prefix is that of a
shorter prefix plus one token, and a token may follow another exactly if the
two, spelt out and encoded together, come out unchanged. A state holds the
positions from which a token may still be running, each with the way the text
before it is encoded, back to where all of them agree; what they agree on has
been emitted. The longest token bounds how far a state looks ahead.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from folioflow.arrow import map_rows

#: Fixed value: the pattern that parts text before merges, from the vocabulary's documentation.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes → rank, from a file of base64 and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_encode(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The plain definition: merge the adjacent pair of lowest rank, leftmost first, until none is left."""
    parts = [word[i : i + 1] for i in range(len(word))]
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


class Transducer:
    """Lazily determinised transducer from bytes to token ids.

    A state is a tuple of live items, oldest first. An item is (offset, node,
    last, back): ``offset`` bytes ago a token may have begun, ``node`` is the
    bytes since then (a proper prefix of some token, or empty for now),
    ``last`` the last token before it, and ``back`` the tokens between what has
    been emitted and that point.
    """

    MOST_ARCS = 2_000_000

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.prefixes = {t[:i] for t in ranks for i in range(1, len(t))}
        self.start = ((0, b"", -1, ()),)
        self.arcs: dict = {}
        self.follow: dict[tuple[int, int], bool] = {}
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.whole: dict[int, bool] = {}

    def _fits(self, last: int, token: int) -> bool:
        ok = self.whole.get(token)
        if ok is None:
            ok = self.whole[token] = merge_encode(self.bytes_of[token], self.ranks) == [token]
        if not ok or last < 0:
            return ok
        key = (last, token)
        got = self.follow.get(key)
        if got is None:
            got = self.follow[key] = merge_encode(self.bytes_of[last] + self.bytes_of[token], self.ranks) == [last, token]
        return got

    def step(self, state, byte: int):
        """(next state, ids emitted)."""
        arc = self.arcs.get((state, byte))
        if arc is None:
            if len(self.arcs) > self.MOST_ARCS:  # only memory is freed; arcs are made again
                self.arcs.clear()
            arc = self.arcs[(state, byte)] = self._determinise(state, byte)
        return arc

    def _determinise(self, state, byte: int):
        live, here = [], None
        b = bytes([byte])
        for off, node, last, back in state:
            grown = node + b
            if here is None:
                r = self.ranks.get(grown)
                if r is not None and self._fits(last, r):
                    here = (0, b"", r, (*back, r))
            if grown in self.prefixes:
                live.append((off + 1, grown, last, back))
        if here is None:
            raise ValueError("a byte is missing from the vocabulary")
        live.append(here)
        # what every live item agrees on can go
        n = 0
        shortest = min(len(x[3]) for x in live)
        while n < shortest and all(x[3][n] == live[0][3][n] for x in live):
            n += 1
        out = live[0][3][:n]
        return tuple((o, node, last, back[n:]) for o, node, last, back in live), out

    def encode(self, word: bytes) -> list[int]:
        state, out = self.start, []
        for byte in word:
            state, ids = self.step(state, byte)
            out.extend(ids)
        out.extend(state[-1][3])  # the item that ends here has the encoding of all that was read
        return out


class Encoder:
    """Texts to ids; each different word goes through the transducer once while it is remembered."""

    MOST_WORDS = 1_000_000

    def __init__(self, path: str):
        self.fst = Transducer(read_ranks(path))
        self.findall = regex.compile(PATTERN).findall
        self.words = _Words(self.fst, self.MOST_WORDS)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        return list(chain.from_iterable(map(self.words.__getitem__, self.findall(text))))


class _Words(dict):
    def __init__(self, fst: Transducer, most: int):
        super().__init__()
        self.fst, self.most = fst, most

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = tuple(self.fst.encode(word.encode("utf-8", "surrogatepass")))
        if len(word) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[word] = ids
        return ids


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def utf8_step(state: tuple[int, int, int], byte: int) -> tuple[tuple[int, int, int], str]:
    """One step of an incremental UTF-8 decoder.

    A state is (bytes still due, code point so far, least code point of this
    length); ill-formed sequences give U+FFFD and decoding goes on.
    """
    due, code, least = state
    if due:
        if 0x80 <= byte < 0xC0:
            code = code << 6 | byte & 0x3F
            if due > 1:
                return (due - 1, code, least), ""
            ok = code >= least and code <= 0x10FFFF and not 0xD800 <= code < 0xE000
            return (0, 0, 0), chr(code) if ok else "�"
        again, text = utf8_step((0, 0, 0), byte)
        return again, "�" + text
    if byte < 0x80:
        return state, chr(byte)
    if 0xC2 <= byte < 0xE0:
        return (1, byte & 0x1F, 0x80), ""
    if 0xE0 <= byte < 0xF0:
        return (2, byte & 0x0F, 0x800), ""
    if 0xF0 <= byte < 0xF5:
        return (3, byte & 0x07, 0x10000), ""
    return state, "�"


def decode_stream(ids, bytes_of: dict[int, bytes]):
    """Text of a stream of ids, character by character as they become complete."""
    state = (0, 0, 0)
    for i in ids:
        for byte in bytes_of[i]:
            state, c = utf8_step(state, byte)
            if c:
                yield c
    if state[0]:
        yield "�"


def encode_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): the token ids of each text, without special tokens.

    Null and empty texts have an empty list; blank texts are encoded as they
    are. Every row gives one row, repeated rows too; an empty table gives an
    empty one. Only the two columns are read. There is no shuffle.
    """
    kind = dict(docs.dtypes)[key]

    def make():
        enc = encoder(path)

        def kernel(ids, texts):
            offsets, flat = [0], []
            for t in texts:
                flat.extend(enc.encode(t))
                offsets.append(len(flat))
            return [ids, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))]

        return kernel

    return map_rows(docs.select(key, text), f"{key} {kind}, ids array<int>", make)


def decode_documents(encoded: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """(key, text): the inverse of encode_documents; an empty or null list gives an empty text."""
    kind = dict(encoded.dtypes)[key]

    def make():
        bytes_of = encoder(path).fst.bytes_of

        def kernel(ids, lists):
            return [ids, ["".join(decode_stream(x or (), bytes_of)) for x in lists]]

        return kernel

    return map_rows(encoded.select(key, "ids"), f"{key} {kind}, text string", make)
