"""Substring dedup over bytes by interval expansion on a Burrows-Wheeler transform.

Every string of ``length`` bytes is dealt by its minimiser, the k bytes in it with the least hash; the strings that
follow one another with the same minimiser form a segment.  Minimisers that occur once in the corpus hold no repeat.
The others' segments, each content once, meet in a bucket.  There the suffixes are sorted by doubling as far as
``length`` symbols; of the transform only the last-first map is kept, inverted.  Intervals of rows that share a prefix
of up to seven symbols come from packed integers, and are then expanded breadth first by backward extension: a row's interval for prefixes of l + 1 bytes is
its first byte with the interval of l bytes of the row one byte on, which the inverse of the transform's last-first
map gives.  So common prefixes come out in increasing length, and the expansion stops at ``length``.  Rows that still
share an interval are occurrences of one string; the earliest of them stays.

A minimiser that has over ``HOT`` segments, such as a line that very many documents hold in different surroundings,
would fill one bucket.  Its strings are dealt one by one instead, by 96 bits of their hash, and equal names are equal
strings; which minimisers these are is counted over all documents.

Defined results: a null text is empty; rows with one doc_id are ordered by their text; a null doc_id comes last.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import split_by, windows
from .packed import Chunks, array, ids_of

#: Segments over which a minimiser's strings are dealt one by one.
HOT = 50_000
#: Bytes of a minimiser, of a block of text that is hashed at once, and of a block that is sorted at once.
K, BLOCK, SORTED = 20, 1 << 17, 1 << 17
#: Symbols of nine bits in a 64-bit integer.
PACK = 7


class Bytes:
    """The texts of a chunk, one after another."""

    def __init__(self, docs: pa.Table):
        raws = [t.encode() if t else b"" for t in docs.column("text").to_pylist()]
        self.sizes = np.array([len(r) for r in raws], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.buffer = b"".join(raws)
        self.flat = np.frombuffer(self.buffer, np.uint8)

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, at, side="right")


def slide_min(a: np.ndarray, width: int) -> np.ndarray:
    n, span = len(a) - width + 1, 1
    while span * 2 <= width:
        a = np.minimum(a[:-span], a[span:])
        span *= 2
    return np.minimum(a[:n], a[width - span : width - span + n])


def segments(text: Bytes, length: int, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser hash, first and one past the last start of each segment's strings, in order of the text."""
    width, out = length - k + 1, []
    for begin in range(0, max(0, len(text.flat) - length + 1), BLOCK):
        end = min(len(text.flat), begin + BLOCK + length - 1)
        h = windows(text.flat[begin:end] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x5851F42D4C957F2D), k)
        least = slide_min(h >> np.uint64(32) << np.uint64(32) | np.arange(len(h), dtype=np.uint64), width)
        starts = np.arange(len(least))
        a, b = np.searchsorted(text.ends, (begin, end), side="right")
        for e in text.ends[a : b + 1].tolist():  # strings don't cross documents
            starts[max(0, e - length + 1 - begin) : max(0, e - begin)] = -1
        starts = starts[starts >= 0]
        if not len(starts):
            continue
        at = (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        cut = np.flatnonzero((at[1:] != at[:-1]) | (np.diff(starts) != 1)) + 1
        first, last = np.append(0, cut), np.append(cut, len(starts)) - 1
        out.append((h[at[first]], starts[first] + begin, starts[last] + begin + 1))
    if not out:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(map(np.concatenate, zip(*out)))


def _distinct(keys: np.ndarray, buckets: int):
    unique, counts = np.unique(keys, return_counts=True)
    for b, rows in split_by((unique % np.uint64(buckets)).astype(np.int64), buckets):
        yield b, unique[rows], counts[rows]


def judge_keys(messages: list[dict], hot: int) -> list[tuple]:
    """For messages of distinct keys (64 bit) and of the power of two that their count in the chunk is within: packed
    bits of the keys that occur more than once, and of those that have over ``hot`` segments."""
    keys = [array(m["a"], np.uint64) for m in messages]
    flat = np.concatenate(keys)
    counts = 1 << np.concatenate([array(m["b"], np.uint8) for m in messages]).astype(np.int64)
    unique, inverse = np.unique(flat, return_inverse=True)
    total = np.bincount(inverse, counts, len(unique))[inverse]
    ends = np.cumsum([0, *map(len, keys)])
    return [(i, np.packbits(total[a:b] > 1), np.packbits(total[a:b] > hot) if (total[a:b] > hot).any() else None) for i, (a, b) in enumerate(zip(ends, ends[1:]))]


def string_names(text: Bytes, low: np.ndarray, high: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, and 64 and 32 bits of the hash, of each string of the segments from ``low`` to ``high``."""
    out = [(np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint32))]
    cuts = np.flatnonzero(np.diff(np.cumsum(high - low + length) // BLOCK)) + 1
    for lo, hi in zip(np.split(low, cuts), np.split(high, cuts)):
        sizes = hi - lo + length - 1
        if not len(sizes):
            continue
        begins = np.cumsum(sizes) - sizes
        offset = np.arange(sizes.sum()) - np.repeat(begins, sizes)
        at = np.repeat(lo, sizes) + offset
        first = np.flatnonzero(offset < np.repeat(hi - lo, sizes))
        bytes_ = text.flat[at].astype(np.uint64)
        a, b = (windows(bytes_ * np.uint64(m) + np.uint64(c), length)[first] for m, c in ((0x9E3779B97F4A7C15, 0x2545F4914F6CDD1D), (0xC2B2AE3D27D4EB4F, 0x5851F42D4C957F2D)))
        out.append((at[first], a, (b >> np.uint64(32)).astype(np.uint32)))
    return tuple(map(np.concatenate, zip(*out)))


def settle_names(messages: list[dict]) -> list[tuple]:
    """Runs of starts of those named strings that start earlier elsewhere."""
    a, b = (np.concatenate([array(m[c], t) for m in messages]) for c, t in (("a", np.uint64), ("b", np.uint32)))
    places = np.concatenate([array(m["d"], np.int64).reshape(-1, 2) for m in messages])
    order = np.lexsort((places[:, 1], places[:, 0], b, a))
    fresh = np.append(True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1]))
    later = np.zeros(len(a), bool)
    later[order] = ~fresh
    ends = np.cumsum([0, *(len(array(m["b"], np.uint32)) for m in messages)])
    for i, (x, y) in enumerate(zip(ends, ends[1:])):
        starts = places[x:y, 1][later[x:y]]
        if len(starts):
            yield i, np.column_stack([starts, starts + 1])


def packed(symbols: np.ndarray) -> np.ndarray:
    """The ``PACK`` symbols (under 512) from each place on, in one integer."""
    n = len(symbols)
    key, padded = np.zeros(n, np.uint64), np.append(symbols, np.zeros(PACK - 1, symbols.dtype)).astype(np.uint64)
    for j in range(PACK):
        key = key << np.uint64(9) | padded[j : j + n]
    return key


def suffix_order(key: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order of their first ``depth`` symbols at least, from ``packed``, and each suffix's row."""
    n, known = len(key), PACK
    while True:
        order = np.argsort(key)
        s = key[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.append(True, s[1:] != s[:-1]))
        if known >= depth or int(rank.max()) == n:
            row = np.empty(n, np.int32)
            row[order] = np.arange(n, dtype=np.int32)
            return order, row
        ahead = np.zeros(n, np.uint64)
        ahead[: n - known] = rank[known:]
        key = rank << np.uint64(32) | ahead
        known *= 2


def intervals(symbols: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order, and for each row whether a new interval of suffixes with ``length`` equal symbols begins.

    Symbol 0 ends a segment and equals no other.
    """
    key = packed(symbols)
    order, row = suffix_order(key, length)
    onward = row[np.where(order + 1 < len(order), order + 1, 0)].astype(np.intp)
    have = PACK if length >= PACK else 1  # intervals of the first symbols come from the packed integers at once
    first, ended = (key if have > 1 else symbols)[order], np.append(symbols, np.ones(PACK, symbols.dtype)) == 0
    ends_soon = np.logical_or.reduce([ended[j : j + len(symbols)] for j in range(have)])[order]
    begins = np.append(True, (first[1:] != first[:-1]) | ends_soon[1:])
    open_rows = np.flatnonzero(~begins)
    here, before = onward[open_rows], onward[open_rows - 1]
    interval = np.cumsum(begins, dtype=np.int32)
    for _ in range(length - have):
        parted = interval.take(here) != interval.take(before)
        if parted.any():
            begins[open_rows[parted]] = True
            stay = np.flatnonzero(~parted)
            open_rows, here, before = open_rows.take(stay), here.take(stay), before.take(stay)
            np.cumsum(begins, dtype=np.int32, out=interval)
        if not len(open_rows):
            break
    return order, begins


def earliest(contents: list[bytes], docs: np.ndarray, starts: np.ndarray, length: int) -> list[np.ndarray]:
    """For each segment, whether each of its strings occurs nowhere earlier in the segments.

    ``docs`` and ``starts`` place the first byte of each segment.
    """
    sizes = np.array([len(c) for c in contents], np.int64)
    symbols = np.frombuffer(b"\0".join(contents) + b"\0", np.uint8).astype(np.uint16) + 1
    ends = np.cumsum(sizes + 1) - 1
    symbols[ends] = 0
    order, begins = intervals(symbols, length)
    segment = np.repeat(np.arange(len(contents)), sizes + 1)
    offset = np.arange(len(symbols)) - (ends - sizes)[segment]
    _, doc_rank = np.unique(docs, return_inverse=True)
    valid = (offset + length <= sizes[segment])[order]
    rows = order[valid]
    place = (doc_rank[segment[rows]].astype(np.int64) << 40) + starts[segment[rows]] + offset[rows]
    group = np.cumsum(begins)[valid]
    heads = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    least = np.minimum.reduceat(place, heads)
    first = np.zeros(len(symbols), bool)
    first[rows] = place == np.repeat(least, np.diff(np.append(heads, len(rows))))
    return [first[e - n : e - length + 1] for e, n in zip(ends.tolist(), sizes.tolist())]


def settle_segments(messages: list[dict], length: int) -> list[tuple]:
    entries, by_content = [], {}
    for i, m in enumerate(messages):
        spans, tags, raw, at = array(m["a"], np.int64).reshape(-1, 2).tolist(), array(m["d"], np.int64).reshape(-1, 2).tolist(), m["c"], 0
        for (lo, hi), (doc, key) in zip(spans, tags):
            size = hi - lo + length - 1
            entries.append((doc, lo, hi, i))
            by_content.setdefault((key, raw[at : at + size]), []).append(len(entries) - 1)
            at += size
    runs: list[list[tuple[int, int]]] = [[] for _ in messages]
    block, block_bytes, last_key = [], 0, None

    def sort_block():
        firsts = [min(numbers, key=lambda e: entries[e][:2]) for _, numbers in block]
        docs, starts = np.array([entries[e][0] for e in firsts]), np.array([entries[e][1] for e in firsts])
        for (_, numbers), head, alone in zip(block, firsts, earliest([c for (_, c), _ in block], docs, starts, length)):
            for e in numbers:
                _, lo, hi, i = entries[e]
                if e != head:
                    runs[i].append((lo, hi))
                elif not alone.all():
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], ~alone, [0]]).astype(np.int8))) + lo
                    runs[i] += zip(edges[::2].tolist(), edges[1::2].tolist())

    for item in sorted(by_content.items(), key=lambda x: x[0][0]):
        if block_bytes > SORTED and item[0][0] != last_key:  # strings of one minimiser stay together
            sort_block()
            block, block_bytes = [], 0
        block.append(item)
        block_bytes += len(item[0][1])
        last_key = item[0][0]
    if block:
        sort_block()
    own = [array(m["b"], np.int64).reshape(-1, 2) for m in messages]
    return [(i, np.concatenate([np.array(r, np.int64).reshape(-1, 2), o])) for i, (r, o) in enumerate(zip(runs, own)) if r or len(o)]


def remove(docs: DataFrame, length: int = 100, with_text: bool = False, most: int = HOT) -> DataFrame:
    """Removes each byte of a ``length``-byte string that also starts earlier: in a smaller doc_id, or before in the same.

    Returns doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row of ``docs`` (doc_id, text), and with
    ``with_text`` also spans (array of start and end in bytes) and kept (binary).  Strings of a minimiser that has over
    ``most`` segments are dealt one by one.
    """
    chunks = Chunks(docs.select("doc_id", "text"))
    n, names = chunks.n, chunks.keys

    def send_keys(docs: pa.Table):
        return [[b, unique, np.ceil(np.log2(counts)).astype(np.uint8)] for b, unique, counts in _distinct(segments(Bytes(docs), length)[0], n)]

    def send_segments(docs: pa.Table, answers: list[dict]):
        text, numbers = Bytes(docs), ids_of(docs)
        keys, low, high = segments(text, length)
        flags = {m["bucket"]: m for m in answers}
        shared, hot = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
        for b, unique, _ in _distinct(keys, n):
            for found, bits in zip((shared, hot), (flags[names[b]]["a"], flags[names[b]]["b"]) if names[b] in flags else ()):
                if bits is not None:
                    found.append(unique[np.unpackbits(array(bits, np.uint8), count=len(unique)).astype(bool)])
        common, hot = np.sort(np.concatenate(shared)), np.sort(np.concatenate(hot))
        if not len(common):
            return []
        hit = common[np.minimum(np.searchsorted(common, keys), len(common) - 1)] == keys
        keys, low, high = keys[hit], low[hit], high[hit]
        seen, fresh, again = set(), [], []
        for i, (lo, hi) in enumerate(zip(low.tolist(), high.tolist())):
            content = text.buffer[lo : hi + length - 1]
            if content in seen:
                again.append((lo, hi))
            else:
                seen.add(content)
                fresh.append(i)
        del seen
        fresh = np.array(fresh)
        keys, low, high = keys[fresh], low[fresh], high[fresh]
        named = []
        if len(hot):
            dealt = hot[np.minimum(np.searchsorted(hot, keys), len(hot) - 1)] == keys
            starts, a, b = string_names(text, low[dealt], high[dealt], length)
            keys, low, high = keys[~dealt], low[~dealt], high[~dealt]
            order = np.lexsort((starts, b, a))
            head = np.append(True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])) if len(order) else np.empty(0, bool)
            again += [(s, s + 1) for s in starts[order[~head]].tolist()]
            first = order[head]
            starts, a, b = starts[first], a[first], b[first]
            places = np.column_stack([numbers[text.doc_of(starts)], starts])
            named = [[k, a[rows], b[rows], None, places[rows]] for k, rows in split_by((a % np.uint64(n)).astype(np.int64), n)]
        tags = np.column_stack([numbers[text.doc_of(low)], keys.view(np.int64)])
        spans, out = np.column_stack([low, high]), []
        for b, rows in split_by((keys % np.uint64(n)).astype(np.int64), n):
            raw = b"".join(text.buffer[lo : hi + length - 1] for lo, hi in spans[rows].tolist())
            out.append([b, spans[rows], None, np.frombuffer(raw, np.uint8), tags[rows]])
        if again:  # strings that the chunk itself has before go with any message
            out = out or [[0, spans[:0], None, np.empty(0, np.uint8), tags[:0]]]
            out[0][2] = np.array(again, np.int64)
        return out + named

    def receive(docs: pa.Table, answers: list[dict]):
        text = Bytes(docs)
        marks = np.zeros(len(text.flat) + 1, np.int32)
        for m in answers:
            runs = array(m["a"], np.int64).reshape(-1, 2)
            np.add.at(marks, runs[:, 0], 1)
            np.add.at(marks, runs[:, 1] + length - 1, -1)
        removed = np.cumsum(marks)[:-1] > 0
        rows = []
        for a, b in zip((text.ends - text.sizes).tolist(), text.ends.tolist()):
            gone = removed[a:b]
            edges = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]]).astype(np.int8))).tolist()
            kept = text.flat[a:b][~gone].tobytes() if edges else text.buffer[a:b]
            rows.append((b - a, int(gone.sum()), len(edges) // 2, hashlib.sha256(kept).hexdigest(), *((list(zip(edges[::2], edges[1::2])), kept) if with_text else ())))
        columns = list(zip(*rows)) if rows else [[]] * (6 if with_text else 4)
        out = {"doc_id": docs.column("doc_id").cast(pa.int64()), **{c: pa.array(columns[i], pa.int64()) for i, c in enumerate(("n_bytes", "n_removed", "n_spans"))}, "kept_sha256": pa.array(columns[3], pa.string())}
        if with_text:
            out["spans"] = pa.array([[list(s) for s in x] for x in columns[4]], pa.list_(pa.list_(pa.int64())))
            out["kept"] = pa.array(columns[5], pa.binary())
        return pa.table(out)

    def settle(messages: list[dict]):
        for kind, judge in ((False, lambda some: settle_segments(some, length)), (True, settle_names)):
            rows = [i for i, m in enumerate(messages) if (m["c"] is None) == kind]
            for i, *answer in judge([messages[i] for i in rows]) if rows else ():
                yield rows[i], *answer

    flags = chunks.settle(chunks.send(send_keys), lambda messages: judge_keys(messages, most))
    answers = chunks.settle(chunks.send_after(flags, send_segments), settle)
    return chunks.receive(answers, receive, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", spans array<array<long>>, kept binary" * with_text)
