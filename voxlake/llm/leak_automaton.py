"""Benchmark decontamination by a generalised suffix automaton.

Items are normalised to words; an automaton over their words has a state for each set of places where a run of words
ends, so a text that is streamed through it knows at each word the longest run ending there that some item holds.
Where that length reaches the window, or a whole item that is shorter than a window, the words of the window are hit,
and the state says which items hold it.

The items are cut into pieces that overlap by a window less one, and dealt to parts of about ``PART_WORDS`` words;
each part's automaton is built in a task, and is what is broadcast, so its size doesn't grow with the benchmark.  Texts
are streamed once for each part and never shuffled.  Most words never reach the automaton: a word that no item has, and
a pair of words that no item has in this order, leave a match of at most one word, so a text is cut there and only what
is as long as the shortest window is streamed.  Words are looked up by hash; what is streamed is compared by its bytes.

Defined results: a null or empty text or item has no words; equal rows are each judged; items with equal ids are one
item; a null item_id is hit but not named; an item of fewer words than the window counts as a whole.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHash, doc_slices, dropped, no_cycles, only_mine, written
from .plain_words import plain_words

#: Words of a part's pieces, about, of a piece at most, and words whose bytes are compared at a time.
PART_WORDS, PIECE_WORDS, CHECKED = 200_000, 20_000, 1 << 18
#: Columns that carry what earlier parts found; names that no table is likely to have.
HIT, NAMES = "__hit", "__names"
HASH = WordHash(4, False)


class Automaton:
    """Suffix automaton of several runs of symbols: moves, suffix link and longest length of each state."""

    def __init__(self):
        self.moves: list[dict] = [{}]
        self.link, self.size = [-1], [0]

    def _state(self, moves: dict, link: int, size: int) -> int:
        self.moves.append(moves)
        self.link.append(link)
        self.size.append(size)
        return len(self.size) - 1

    def _split(self, p: int, symbol, q: int) -> int:
        """The part of ``q`` that is reached from ``p`` and shorter states, as a state of its own."""
        half = self._state(dict(self.moves[q]), self.link[q], self.size[p] + 1)
        self.link[q] = half
        while p >= 0 and self.moves[p].get(symbol) == q:
            self.moves[p][symbol] = half
            p = self.link[p]
        return half

    def _at(self, p: int, symbol) -> int:
        """The state of exactly ``p``'s longest run and ``symbol``, which ``p`` has a move for."""
        q = self.moves[p][symbol]
        return q if self.size[q] == self.size[p] + 1 else self._split(p, symbol, q)

    def add(self, symbols) -> int:
        """Adds a run; its state."""
        last = 0
        for s in symbols:
            if s in self.moves[last]:
                last = self._at(last, s)
                continue
            new, p = self._state({}, 0, self.size[last] + 1), last
            while p >= 0 and s not in self.moves[p]:
                self.moves[p][s] = new
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._at(p, s)
            last = new
        return last

    def stream(self, symbols) -> Iterator[tuple[int, int]]:
        """For each symbol the state and length of the longest run that ends there and is in what was added."""
        moves, link, size = self.moves, self.link, self.size
        state = length = 0
        for s in symbols:
            to = moves[state].get(s)
            while to is None and state:
                state = link[state]
                length = size[state]
                to = moves[state].get(s)
            if to is None:
                yield 0, 0
                continue
            state, length = to, length + 1
            yield state, length


class Part:
    """The automaton of some pieces, its words, and which items each state tells of."""

    def __init__(self, pieces: list[tuple[str | None, str]], window: int):
        """``pieces``: name of the item, or None, and words joined by spaces."""
        ids: dict[str, int] = {}
        runs = [[ids.setdefault(w, len(ids)) for w in words.split(" ")] for _, words in pieces]
        self.window, self.auto = window, Automaton()
        self.shortest = min((min(window, len(r)) for r in runs), default=window)
        self.names = sorted({n for n, _ in pieces if n is not None})
        number = {n: k for k, n in enumerate(self.names)}
        ends = [self.auto.add(r) for r in runs]
        size, link = self.auto.size, self.auto.link
        #: Items that are told by a state: of a whole short item, or the one where a window's run is.
        told: dict[int, set[int]] = {}
        for (name, _), run, end in zip(pieces, runs, ends):
            if len(run) < window:
                told.setdefault(end, set()).update([] if name is None else [number[name]])
        short = set(told)
        #: The state itself or the nearest by links that is a whole short item; and the one where its windows are.
        self.whole, self.home = [-1] * len(size), [-1] * len(size)
        for s in sorted(range(1, len(size)), key=size.__getitem__):
            self.whole[s] = s if s in short else self.whole[link[s]]
            if size[s] >= window:
                self.home[s] = s if size[link[s]] < window else self.home[link[s]]
            if s in short and (up := self.whole[link[s]]) >= 0:
                told[s] |= told[up]
        for (name, _), run in zip(pieces, runs):
            if name is not None and len(run) >= window:
                for state, length in self.auto.stream(run):
                    if length >= window:
                        told.setdefault(self.home[state], set()).add(number[name])
        for s in {h for h in self.home if h >= 0}:
            told[s] = told.get(s, set()) | (told[self.whole[s]] if self.whole[s] >= 0 else set())
        self.told = {s: sorted(v) for s, v in told.items()}
        words = list(ids)
        raw = [w.encode() for w in words]
        self.flat = np.frombuffer(b"".join(raw), np.uint8)
        self.ends = np.cumsum([len(w) for w in raw], dtype=np.int64)
        self.starts = self.ends - np.array([len(w) for w in raw], np.int64)
        hashes = HASH(self.flat, self.starts, self.ends) if words else np.zeros(0, np.uint64)
        self.by_hash = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.by_hash]
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two words of the items have one hash")
        self.pairs = np.unique(np.array([a * len(words) + b for r in runs for a, b in zip(r, r[1:])], np.int64))

    def told_at(self, state: int, length: int) -> tuple[int, int]:
        """The state that tells the items whose window ends here, and that window's words; -1 if none does."""
        if length >= self.window:
            return self.home[state], self.window
        told = self.whole[state] if length == self.auto.size[state] else self.whole[self.auto.link[state]]
        return told, self.auto.size[told] if told >= 0 else 0

    def word_ids(self, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Number of each word by its hash, -1 where no item has it."""
        if not len(self.hashes) or not len(starts):
            return np.full(len(starts), -1, np.int64)
        h = HASH(flat, starts, ends)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.by_hash[at], -1)

    def same_bytes(self, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Whether words are the item words of their numbers."""
        size = ends - starts
        same = size == self.ends[ids] - self.starts[ids]
        for k in range(0, len(ids), CHECKED):
            some = k + np.flatnonzero(same[k : k + CHECKED])
            if len(some):
                n = size[some]
                first = np.cumsum(n) - n
                step = np.arange(int(n.sum())) - np.repeat(first, n)
                equal = flat[np.repeat(starts[some], n) + step] == self.flat[np.repeat(self.starts[ids[some]], n) + step]
                same[some] = np.logical_and.reduceat(equal, first)
        return same

    def candidates(self, flat, starts, ends, counts) -> Iterator[tuple[int, list[int]]]:
        """Stretches of words that may hold a window: number of the first word, and item word numbers."""
        ids = self.word_ids(flat, starts, ends)
        if not len(ids):
            return
        joined = (ids[:-1] >= 0) & (ids[1:] >= 0)
        at = np.flatnonzero(joined)
        if len(at):
            key = ids[at] * len(self.hashes) + ids[at + 1]
            place = np.minimum(np.searchsorted(self.pairs, key), max(0, len(self.pairs) - 1))
            joined[at] = self.pairs[place] == key if len(self.pairs) else False
        text_ends = np.cumsum(counts)
        text_ends = text_ends[(text_ends > 0) & (text_ends < len(ids))]
        joined[text_ends - 1] = False
        cuts = np.flatnonzero(~joined) + 1
        lows, highs = np.append(0, cuts), np.append(cuts, len(ids))
        long = (highs - lows >= self.shortest) & (ids[lows] >= 0)
        for low, high in zip(lows[long].tolist(), highs[long].tolist()):
            run = ids[low:high]
            true = self.same_bytes(flat, starts[low:high], ends[low:high], run)
            yield low, run.tolist() if true.all() else np.where(true, run, -1).tolist()

    def hits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, dict[int, set[int]], tuple]:
        """Words of each text, whether each word is hit, the items of each text with hits, and the words' places."""
        flat, starts, ends, counts = plain_words(texts)
        depth, text_ends = np.zeros(len(starts) + 1, np.int64), np.cumsum(counts)
        items: dict[int, set[int]] = {}
        for low, run in self.candidates(flat, starts, ends, counts):
            told, covered = set(), []
            for k, (state, length) in enumerate(self.auto.stream(run)):
                if length >= self.shortest:
                    by, words = self.told_at(state, length)
                    if by >= 0:
                        told.add(by)
                        covered.append((low + k + 1 - words, low + k + 1))
            if covered:
                edges = np.array(covered)
                np.add.at(depth, edges[:, 0], 1)
                np.add.at(depth, edges[:, 1], -1)
                items.setdefault(int(np.searchsorted(text_ends, low, side="right")), set()).update(n for s in told for n in self.told[s])
        return counts, np.cumsum(depth[:-1]) > 0, items, (starts, ends)


def pieces(items: DataFrame, window: int, key: str, column: str) -> DataFrame:
    """name and words of each piece of an item; items without words have none."""

    def run(batches):
        for batch in batches:
            names, runs = [], []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                flat, starts, ends, _ = plain_words(pa.array([text.as_py()], pa.string()))
                words = [flat[a:b].tobytes().decode() for a, b in zip(starts.tolist(), ends.tolist())]
                step = PIECE_WORDS - window + 1
                for at in range(0, max(len(words) - window + 1, min(1, len(words))), step):
                    names.append(name)
                    runs.append(" ".join(words[at : at + PIECE_WORDS]))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(runs, pa.string())], names=["name", "words"])

    return items.select(F.col(key).cast("string").alias("name"), F.col(column).alias("words")).mapInArrow(run, "name string, words string").distinct()


def parts(items: DataFrame, window: int, key: str, column: str) -> DataFrame:
    """A written table with one automaton a row, each built in a task of its own."""
    spark = items.sparkSession
    cut = written(pieces(items, window, key, column), spark)
    words = cut.agg(F.sum(F.size(F.split("words", " ")))).first()[0] or 0
    n = -(-words // PART_WORDS)

    def build(part, got):
        some = sorted(zip(got.column("name").to_pylist(), got.column("words").to_pylist()), key=lambda p: (p[1], p[0] or ""))
        return pa.table({"part": pa.array([part[0].as_py()], pa.int64()), "blob": [pickle.dumps(Part(some, window))]})

    dealt = cut.withColumn("part", F.pmod(F.xxhash64("words"), F.lit(max(1, n))))
    built = written(dealt.groupBy("part").applyInArrow(build, "part long, blob binary"), spark)
    dropped(cut)
    return built


def _streamed(docs: DataFrame, blob: bytes | None, finish: Callable, kind: str) -> DataFrame:
    """``finish(batch, counts, hit, names, places)`` of all slices of the texts; ``names`` are lists, by number of the text."""
    shipped = docs.sparkSession.sparkContext.broadcast(blob)
    digest = hashlib.sha256(blob or b"").digest()

    @no_cycles
    def run(batches):
        part = only_mine(("leaks", digest), lambda: pickle.loads(shipped.value) if shipped.value else Part([], 1))
        for batch in batches:
            for some in doc_slices(batch):
                counts, hit, items, places = part.hits(some.column("text"))
                names = {t: {part.names[k] for k in v} for t, v in items.items()}
                if HIT in some.schema.names:  # what the parts before this one found
                    ends = np.cumsum(counts)
                    for t, (bits, known) in enumerate(zip(some.column(HIT).to_pylist(), some.column(NAMES).to_pylist())):
                        low, high = ends[t] - counts[t], ends[t]
                        hit[low:high] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=high - low).astype(bool)
                        if known:
                            names.setdefault(t, set()).update(known)
                yield finish(some, counts, hit, names, places)

    return docs.mapInArrow(run, kind)


def _carry(batch, counts, hit, names, places) -> pa.RecordBatch:
    bits = [np.packbits(h).tobytes() for h in np.split(hit, np.cumsum(counts)[:-1])]
    keep = [n for n in batch.schema.names if n not in (HIT, NAMES)]
    lists = pa.array([sorted(names.get(t, ())) for t in range(batch.num_rows)], pa.list_(pa.string()))
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(bits, pa.binary()), lists], names=[*keep, HIT, NAMES])


def _found(docs: DataFrame, items: DataFrame, window: int, key: str, column: str, finish: Callable, kind: str) -> DataFrame:
    """``finish`` of all texts after all parts."""
    spark = docs.sparkSession
    built = parts(items, window, key, column)
    numbers = sorted(r.part for r in built.select("part").collect())  # one for PART_WORDS words of the benchmark
    plain = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    between = None
    for number in numbers[:-1]:
        blob = bytes(built.where(F.col("part") == number).first().blob)
        out = written(_streamed(docs, blob, _carry, f"{plain}, {HIT} binary, {NAMES} array<string>"), spark)
        if between is not None:
            dropped(between)
        docs = between = out
    blob = bytes(built.where(F.col("part") == numbers[-1]).first().blob) if numbers else None
    dropped(built)
    return _streamed(docs, blob, finish, kind)


def leaks(docs: DataFrame, items: DataFrame, window: int = 10, key: str = "item_id", column: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and items (the names, sorted) of each row of ``docs``."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("items", pa.list_(pa.string()))])

    def finish(batch, counts, hit, names, places):
        ends = np.cumsum(counts)
        upto = np.append(0, np.cumsum(hit))
        hits = upto[ends] - upto[ends - counts]
        lists = [sorted(names.get(t, ())) for t in range(batch.num_rows)]
        digests = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in lists]
        columns = [batch.column("doc_id"), counts, hits, [len(x) for x in lists], digests, hits > 0, lists]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _found(rows, items, window, key, column, finish, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, coverage: float = 0.5, key: str = "item_id", column: str = "text") -> DataFrame:
    """``docs`` without hit words, from the first to the last of each span; documents with over ``coverage`` of their words hit go."""

    def finish(batch, counts, hit, names, places):
        starts, ends = places
        word_ends = np.cumsum(counts)
        texts, keep = [], []
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0), np.int64)
        base = 0
        for t, text in enumerate(batch.column("text")):
            low, high = int(word_ends[t] - counts[t]), int(word_ends[t])
            some = hit[low:high]
            keep.append(not some.any() or some.mean() <= coverage)
            if some.any():
                raw, at, left = text.as_py().encode(), 0, []
                edge = np.diff(np.concatenate([[0], some.astype(np.int8), [0]]))
                for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
                    left.append(raw[at : starts[low + a] - base])
                    at = int(ends[low + b - 1]) - base
                texts.append(b"".join([*left, raw[at:]]).decode())
            else:
                texts.append(text.as_py())
            base += int(sizes[t])
        fields = [n for n in batch.schema.names if n not in (HIT, NAMES)]
        columns = [pa.array(texts, batch.column("text").type) if n == "text" else batch.column(n) for n in fields]
        return pa.RecordBatch.from_arrays(columns, names=fields).filter(pa.array(keep))

    return _found(docs, items, window, key, column, finish, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))
