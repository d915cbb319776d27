"""Byte-level BPE as a lazily determinised transducer, and a streaming decoder.

A token sequence is the BPE encoding of its bytes exactly if every adjacent pair of it is stable: encoding the
two tokens' bytes gives the two tokens again.  So the encoder is a nondeterministic transducer whose state is
the last token and a place in the trie of the tokens.  It is determinised while it runs: a state is the set of
hypotheses that are still alive, and a move says which token ends at its byte.  Tokens that all hypotheses share are
put out at the end of a piece, or every ``AHEAD`` bytes of a long one.

Defined results: a null text is empty; an empty text has no ids; ids of a text don't depend on its neighbours.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import CACHE_LIMIT, doc_slices, no_cycles, only_mine
from .id_store import Store

#: States that are kept before the lazily built tables start afresh, and bytes after which a long piece puts out tokens.
STATE_LIMIT, AHEAD = 150_000, 1024
NONE = -1


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_down(piece: bytes, ranks: dict[bytes, int], below: int) -> list[bytes]:
    """The parts of ``piece`` after all merges whose rank is under ``below``."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = below, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1], below)
            if r < best:
                best, at = r, i
        if at < 0:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


@lru_cache(maxsize=4)
def compile_merges(path: str) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Bytes of each token, and the two tokens that its merge joins (-1: a byte, or a token that no merge makes).

    Its size is that of the vocabulary, whatever the data.
    """
    ranks = read_ranks(path)
    tokens = [b""] * (max(ranks.values()) + 1)
    left, right = np.full(len(tokens), NONE, np.int32), np.full(len(tokens), NONE, np.int32)
    for word, r in ranks.items():
        tokens[r] = word
        if len(word) > 1 and len(parts := merge_down(word, ranks, r)) == 2:
            left[r], right[r] = ranks[parts[0]], ranks[parts[1]]
    return tokens, left, right


class Transducer:
    """States are tuples of hypotheses (last token, place in the trie), oldest first.

    Every prefix of a piece has one encoding, so at most one hypothesis completes a token at a byte that fits the token
    before it.  That token is what a move puts out; the tokens of the way are no part of a state, so words that
    end alike share states however they began.
    """

    def __init__(self, tokens: list[bytes], left, right):
        self.tokens = tokens
        self.sizes = list(map(len, tokens))
        self.left, self.right = list(map(int, left)), list(map(int, right))
        self.ids = {w: i for i, w in enumerate(tokens) if w}
        self.merged = {(a, b): i for i, (a, b) in enumerate(zip(self.left, self.right)) if a >= 0}
        self.edges: list[dict[int, int]] = [{}]
        self.ends: list[int] = [NONE]
        for i, word in enumerate(tokens):
            if len(word) == 1 or self.left[i] >= 0:
                self._insert(word, i)
        self.stable: dict[tuple[int, int], bool] = {}
        self._reset(((NONE, 0),))

    def _insert(self, word: bytes, token: int) -> None:
        node = 0
        for b in word:
            nxt = self.edges[node].get(b)
            if nxt is None:
                nxt = self.edges[node][b] = len(self.edges)
                self.edges.append({})
                self.ends.append(NONE)
            node = nxt
        self.ends[node] = token

    def _reset(self, *keys) -> None:
        self.states, self.numbers, self.moves = list(keys), {k: i for i, k in enumerate(keys)}, {}

    def _is_stable(self, a: int, b: int) -> bool:
        """Whether no merge across the border between ``a`` and ``b`` comes before those that make them.

        The merges that make a token finish in order of rank, so at the time of rank r its right edge is the
        part that was made before r and is taken up after r; equal ranks go from left to right.
        """
        out, x, x_taken = True, a, 1 << 60
        while x >= 0 and out:
            y, y_taken = b, 1 << 60
            while y >= 0:
                r = self.merged.get((x, y))
                if r is not None and r < x_taken and r <= y_taken:
                    out = False
                    break
                y, y_taken = self.left[y], y
            x, x_taken = self.right[x], x
        if len(self.stable) >= CACHE_LIMIT:
            self.stable.clear()
        self.stable[a, b] = out
        return out

    def _step(self, state: int, byte: int) -> tuple[int, int]:
        """The next state and the token that ends at this byte."""
        edges, ends, stable = self.edges, self.ends, self.stable
        after, found = [], NONE
        for last, node in self.states[state]:
            child = edges[node].get(byte)
            if child is None:
                continue
            if edges[child]:
                after.append((last, child))
            token = ends[child]
            if token >= 0 and found < 0:
                fits = last < 0 or stable.get((last, token))
                if fits is None:
                    fits = self._is_stable(last, token)
                if fits:
                    found = token
        after.append((found, 0))
        key = tuple(after)
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.states)
            self.states.append(key)
        move = self.moves[state << 8 | byte] = (number, found)
        return move

    def _settled(self, ended: list[int], state: int) -> int:
        """Bytes of the way on whose tokens all hypotheses of ``state`` agree; ``ended`` has the token that ends at each."""
        depth = self._depths()
        places = {len(ended) - depth[node] for _, node in self.states[state]}
        while len(places) > 1:
            last = max(places)
            places.discard(last)
            places.add(last - self.sizes[ended[last - 1]])
        return places.pop()

    def _depths(self) -> list[int]:
        depth = [0] * len(self.edges)
        for node, below in enumerate(self.edges):
            for child in below.values():
                depth[child] = depth[node] + 1
        self._depths = lambda: depth
        return depth

    def _back(self, ended: list[int], to: int) -> list[int]:
        out, sizes = [], self.sizes
        while to > 0:
            token = ended[to - 1]
            out.append(token)
            to -= sizes[token]
        out.reverse()
        return out

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one match of the pattern; one pass over its bytes, whatever its length."""
        whole = self.ids.get(piece)
        if whole is not None:
            return [whole]
        out: list[int] = []
        state, moves, ended = 0, self.moves, []
        for at in range(0, len(piece), AHEAD):
            if len(self.states) > STATE_LIMIT:  # tables start afresh; the state is carried over
                key = self.states[state]
                self._reset(((NONE, 0),), *([key] if key != self.states[0] else []))
                state, moves = self.numbers[key], self.moves
            for b in piece[at : at + AHEAD]:
                state, token = moves.get(state << 8 | b) or self._step(state, b)
                ended.append(token)
            if len(ended) > AHEAD:  # what all hypotheses share is put out
                done = self._settled(ended, state)
                out += self._back(ended, done)
                del ended[:done]
        return out + self._back(ended, len(ended))


def _machine() -> list[bytes]:
    """Next state by state and byte: 0 accepts, 8 rejects, 1-3 wait for so many continuation bytes, and 4-7 are
    those after E0, ED, F0 and F4, whose next byte has a narrower range."""
    rows = [bytearray([8] * 256) for _ in range(8)]
    rows[0][0x00:0x80] = bytes(0x80)
    for lo, hi, to in ((0xC2, 0xDF, 1), (0xE1, 0xEC, 2), (0xEE, 0xEF, 2), (0xF1, 0xF3, 3), (0xE0, 0xE0, 4), (0xED, 0xED, 5), (0xF0, 0xF0, 6), (0xF4, 0xF4, 7)):
        rows[0][lo : hi + 1] = bytes([to]) * (hi - lo + 1)
    for state, lo, hi, to in ((1, 0x80, 0xBF, 0), (2, 0x80, 0xBF, 1), (3, 0x80, 0xBF, 2), (4, 0xA0, 0xBF, 1), (5, 0x80, 0x9F, 1), (6, 0x90, 0xBF, 2), (7, 0x80, 0x8F, 2)):
        rows[state][lo : hi + 1] = bytes([to]) * (hi - lo + 1)
    return [bytes(r) for r in rows]


MACHINE = _machine()
REPLACEMENT = "�".encode()


class StreamDecoder:
    """Token ids in, whole UTF-8 characters out; bytes of a character that isn't complete wait for the next call.

    Bytes that can't be part of UTF-8 come out as U+FFFD, one for each maximal part of a sequence.
    """

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.plain = np.array([self._is_plain(t) for t in tokens], dtype=bool)
        self.state, self.waiting = 0, bytearray()

    @staticmethod
    def _is_plain(token: bytes) -> bool:
        state = 0
        for b in token:
            state = MACHINE[state][b]
            if state == 8:
                return False
        return state == 0

    def _bytes(self, token: bytes, out: list[bytes]) -> None:
        for b in token:
            to = MACHINE[self.state][b]
            if to == 8 and self.state:  # the sequence broke off; the byte may begin another
                out.append(REPLACEMENT)
                self.waiting.clear()
                to = MACHINE[0][b]
            if to == 8:
                out.append(REPLACEMENT)
                self.state = 0
                continue
            self.waiting.append(b)
            self.state = to
            if to == 0:
                out.append(bytes(self.waiting))
                self.waiting.clear()

    def feed(self, ids: np.ndarray) -> bytes:
        out: list[bytes] = []
        words = self.tokens
        listed, at = ids.tolist(), 0
        for i in np.flatnonzero(~self.plain[ids]).tolist() + [len(listed)]:
            while at < i and self.state:
                self._bytes(words[listed[at]], out)
                at += 1
            if at > i:
                continue
            out.extend(map(words.__getitem__, listed[at:i]))
            at = i
            if i < len(listed):
                self._bytes(words[listed[i]], out)
                at = i + 1
        return b"".join(out)

    def finish(self) -> bytes:
        out = REPLACEMENT if self.state else b""
        self.state = 0
        self.waiting.clear()
        return out


#: Letters, digits and white space under U+0250; with them the faster module re can stand in for regex.
LATIN = {r"\p{L}": "A-Za-zªµºÀ-ÖØ-öø-ɏ", r"\p{N}": "0-9²³¹¼½¾", r"\s": r"\t-\r \x85\xa0"}


def splitter(pattern: str):
    """``findall`` of the pattern; texts under U+0250 go by an equal pattern with the classes written out."""
    general = regex.compile(pattern).findall
    if set(regex.findall(r"\\.(?:\{\w+\})?|\[\^|\[|\]", pattern)) - {*LATIN, r"\S", "[^", "]"}:
        return general
    inner = regex.sub(r"\[\^[^\]]*\]", lambda m: _spelled(m[0], bare=False), pattern)
    latin = re.compile(_spelled(inner, bare=True)).findall
    beyond = re.compile("[^\0-\u024f]").search
    return lambda text: general(text) if beyond(text) else latin(text)


def _spelled(part: str, bare: bool) -> str:
    for name, span in LATIN.items():
        part = part.replace(name, f"[{span}]" if bare else span)
    return part.replace(r"\S", rf"[^{LATIN[chr(92) + 's']}]") if bare else part


class Codec:
    def __init__(self, tokens, left, right, pattern: str):
        self.transducer = Transducer(tokens, left, right)
        self.pieces = Store(self._pieces, np.dtype("<u4"))
        self.split = splitter(pattern)
        self.decoder = StreamDecoder(tokens)

    def _pieces(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of matches of the pattern, each from the start state on."""
        found, encode = [], self.transducer.encode
        for piece in names.to_pylist():
            found.append(encode(piece.encode()))
        return np.array(list(chain.from_iterable(found)), "<u4"), np.fromiter(map(len, found), np.int64, len(found))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; a piece that was met before isn't run through the transducer again."""
        pieces, ends = [], []
        for text in texts:
            if text:
                pieces += self.split(text)
            ends.append(len(pieces))
        if not pieces:
            return [np.empty(0, "<u4") for _ in texts]
        lists = self.pieces.of(pa.array(pieces, pa.string()).dictionary_encode())
        at = lists.offsets.to_numpy()[[0, *ends]].tolist()
        flat = lists.flatten().to_numpy()
        return [flat[a:b] for a, b in zip(at, at[1:])]

    def decode(self, ids: np.ndarray, step: int = 1 << 16) -> list[bytes]:
        return [self.decoder.feed(ids[i : i + step]) for i in range(0, len(ids), step)] + [self.decoder.finish()]


def encode_decode(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Encodes ``text`` of each row of ``docs`` (doc_id, text) and decodes the ids again.

    Returns doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row, repeated rows too, and with ``with_ids``
    also ids (array of int) and decoded (string).  It is one pass without a shuffle; a task holds one slice of
    texts, the vocabulary's tables, and caches of bounded size.  The vocabulary file is read on the driver.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(compile_merges(path))
    fields = [pa.field("doc_id", pa.int64()), pa.field("n_tokens", pa.int64()), pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string())]
    kind = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        fields += [pa.field("ids", pa.list_(pa.int32())), pa.field("decoded", pa.string())]
        kind += ", ids array<int>, decoded string"
    schema = pa.schema(fields)

    @no_cycles
    def run(batches):
        codec = only_mine(("bpe", path, pattern), lambda: Codec(*shipped.value, pattern))
        for batch in batches:
            for part in doc_slices(batch):
                rows = []
                for numbers in codec.encode(part.column("text").to_pylist()):
                    decoded = codec.decode(numbers)
                    digest = hashlib.sha256()
                    for piece in decoded:
                        digest.update(piece)
                    row = [len(numbers), hashlib.sha256(numbers).hexdigest(), digest.hexdigest()]
                    rows.append(row + [numbers.astype(np.int32).tolist(), b"".join(decoded).decode()] if with_ids else row)
                columns = [part.column("doc_id").cast(pa.int64())] + [pa.array(c, type=f.type) for c, f in zip(zip(*rows), fields[1:])]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, kind)
