"""Substring dedup over words with difference-cover anchors.

D is a difference cover modulo v: any two residues differ by a difference of two members, so two equal runs of
``length`` words have a common shift below v that puts both at cover positions.  Hashing the runs of
``length - v + 1`` words that begin at cover positions therefore meets every match, with |D| / v of all positions.
Anchors that more than one document has are extended: every run of ``length`` words around them is named by 96 bits of
its words' hashes, all of which travel both ways, and the smallest doc_id that has a name decides.

Defined results: words are runs without ASCII white space; a null text has none; a document with fewer words than a
run loses nothing; rows with one doc_id don't remove each other's words; a null doc_id counts as the largest.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import EXACT, EXACT_TOO, WordHash, doc_slices, hashed_words, split_by, windows
from .packed import CHUNK, Chunks, array, ids_of, shared_flags

#: Perfect difference sets: modulus and cover.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}


class Words:
    """The words of a slice of a chunk, one document after another: hashes, document number and place of each."""

    def __init__(self, texts: pa.Array, *kinds: WordHash):
        self.sizes, self.hashes = hashed_words(texts, *kinds)
        self.ends = np.cumsum(self.sizes)
        self.n = int(self.ends[-1]) if len(self.ends) else 0
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.left = self.ends[self.doc] - np.arange(self.n)  # words from here to the document's end

    def places(self) -> np.ndarray:
        return self.sizes[self.doc] - self.left


def slices(docs: pa.Table):
    """Number of the first row and texts of each slice of a chunk."""
    at = 0
    for batch in docs.to_batches():
        for part in doc_slices(batch):
            yield at, part.column("text")
            at += part.num_rows


def anchors(words: Words, length: int, modulus: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors."""
    span = length - modulus + 1
    cover = np.zeros(modulus, bool)
    cover[list(COVERS[modulus])] = True
    at = np.flatnonzero(cover[words.places() % modulus] & (words.left >= span))
    return at, windows(words.hashes[0], span)[at] if len(at) else np.empty(0, np.uint64)


def _distinct(keys: np.ndarray, doc: np.ndarray, buckets: int):
    """bucket, distinct keys, and whether each is in more than one document; always in the same order.

    ``doc`` doesn't fall.
    """
    if not len(keys):
        return
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    first = np.ones(len(s), bool)
    first[1:] = s[1:] != s[:-1]
    starts = np.flatnonzero(first)
    last = np.append(starts[1:], len(s)) - 1
    many = doc[order[starts]] != doc[order[last]]
    unique = s[starts]
    for b, rows in split_by((unique % np.uint64(buckets)).astype(np.int64), buckets):
        yield b, unique[rows], many[rows]


def candidates(words: Words, shared: np.ndarray, length: int, modulus: int) -> np.ndarray:
    """Starts of runs that hold a shared anchor."""
    marks = np.zeros(words.n + 1, np.int32)
    marks[shared] = 1
    sums = np.concatenate([[0], np.cumsum(marks, dtype=np.int32)])
    starts = np.flatnonzero(words.left >= length)
    return starts[sums[starts + modulus] > sums[starts]]


class Names:
    """Sorted names of 64 and 32 more bits that can be asked for many at a time."""

    def __init__(self, a: np.ndarray, b: np.ndarray | None = None):
        self.order = np.argsort(a, kind="stable") if b is None else np.lexsort((b, a))
        self.a, self.b = a[self.order], None if b is None else b[self.order]
        self.shift = np.uint64(64 - max(10, min(22, len(a).bit_length() + 4)))
        self.some = np.zeros(1 << (64 - int(self.shift)), bool)
        self.some[self.a >> self.shift] = True

    def find(self, a: np.ndarray, b: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``a`` (and ``b``) are names, and which names."""
        rows = np.flatnonzero(self.some[a >> self.shift])
        at = np.searchsorted(self.a, a[rows])
        found = np.full(len(rows), -1)
        while len(rows):
            at = np.minimum(at, len(self.a) - 1)
            same = self.a[at] == a[rows]
            hit = same if b is None else same & (self.b[at] == b[rows])
            found[hit] = at[hit]
            more = same & ~hit & (at + 1 < len(self.a))  # another name with these 64 bits may follow
            if not more.any():
                break
            at = np.where(more, at + 1, at)
        hit = found >= 0
        return rows[hit], self.order[found[hit]]


def remove(docs: DataFrame, length: int = 50, modulus: int = 31, rewrite: bool = False) -> DataFrame:
    """Removes each word of a run of ``length`` words that also starts in a document with a smaller doc_id.

    Returns doc_id, n_words, n_removed, kept_sha256 of each row of ``docs``; with ``rewrite`` its rows with all their
    columns instead, where texts that lost words are the words that stay, joined by a blank, and others as they were.
    """
    kept = docs if rewrite else docs.select("doc_id", "text")
    chunks = Chunks(kept)
    n, chunk_keys = chunks.n, chunks.keys

    def all_anchors(docs: pa.Table):
        keys, doc = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for first, texts in slices(docs):
            words = Words(texts, EXACT)
            at, found = anchors(words, length, modulus)
            keys.append(found)
            doc.append(words.doc[at] + first)
        return np.concatenate(keys), np.concatenate(doc)

    def send_anchors(docs: pa.Table):
        return [[b, unique, np.packbits(many)] for b, unique, many in _distinct(*all_anchors(docs), n)]

    def candidate_runs(docs: pa.Table, answers: list[dict]):
        """Both parts of the name and document of each run that holds a shared anchor."""
        keys, doc = all_anchors(docs)
        flags = {m["bucket"]: m["a"] for m in answers}
        shared = []
        for b, unique, _ in _distinct(keys, doc, n):
            got = flags.get(chunk_keys[b])
            if got is not None:
                shared.append(unique[np.unpackbits(array(got, np.uint8), count=len(unique)).astype(bool)])
        out = []
        if sum(map(len, shared)):
            common = Names(np.concatenate(shared))
            has_some = np.zeros(docs.num_rows, bool)
            has_some[doc[common.find(keys)[0]]] = True
            for first, texts in slices(docs):
                if not has_some[first : first + len(texts)].any():
                    continue
                words = Words(texts, EXACT, EXACT_TOO)
                at, found = anchors(words, length, modulus)
                starts = candidates(words, at[common.find(found)[0]], length, modulus)
                if len(starts):
                    a, b = (windows(h, length)[starts] for h in words.hashes)
                    out.append((a, (b >> np.uint64(32)).astype(np.uint32), words.doc[starts] + first))
        return tuple(map(np.concatenate, zip(*out))) if out else (np.empty(0, np.uint64), np.empty(0, np.uint32), np.empty(0, np.int64))

    def send_runs(docs: pa.Table, answers: list[dict]):
        a, b, doc = candidate_runs(docs, answers)
        if not len(a):
            return []
        numbers = ids_of(docs)
        order = np.lexsort((b, a))  # stable: within a name, in order of the text
        sa, sb = a[order], b[order]
        first = np.ones(len(order), bool)
        first[1:] = (sa[1:] != sa[:-1]) | (sb[1:] != sb[:-1])
        begin = np.flatnonzero(first)
        end = np.append(begin[1:], len(order)) - 1
        low, high = order[begin], order[end]
        place = np.argsort(low)  # in order of the text, so that doc_ids run on
        low, high = low[place], high[place]
        out = []
        for k, rows in split_by((a[low] % np.uint64(n)).astype(np.int64), n):
            lo, hi = low[rows], high[rows]
            out.append([k, a[lo], b[lo], numbers[doc[lo]], numbers[doc[hi]] - numbers[doc[lo]]])
        return out

    def settle_runs(messages: list[dict]):
        a = np.concatenate([array(m["a"], np.uint64) for m in messages])
        b = np.concatenate([array(m["b"], np.uint32) for m in messages])
        low = np.concatenate([array(m["c"], np.int64) for m in messages])
        high = low + np.concatenate([array(m["d"], np.int64) for m in messages])
        sizes = [len(array(m["b"], np.uint32)) for m in messages]
        order = np.lexsort((low, b, a))
        sa, sb = a[order], b[order]
        first = np.ones(len(order), bool)
        first[1:] = (sa[1:] != sa[:-1]) | (sb[1:] != sb[:-1])
        least = np.empty(len(order), np.int64)
        least[order] = low[order[np.flatnonzero(first)]][np.cumsum(first) - 1]
        ends = np.cumsum([0, *sizes])
        for i in range(len(messages)):
            span = slice(ends[i], ends[i + 1])
            hit = high[span] > least[span]
            if hit.any():
                yield i, a[span][hit], b[span][hit], least[span][hit]

    def receive(docs: pa.Table, answers: list[dict]):
        numbers, removed, sizes = ids_of(docs), [np.empty(0, bool)], [np.empty(0, np.int64)]
        names = Names(*(np.concatenate([array(m[c], kind) for m in answers]) for c, kind in (("a", np.uint64), ("b", np.uint32)))) if answers else None
        least = np.concatenate([array(m["c"], np.int64) for m in answers]) if answers else None
        for first, texts in slices(docs):
            words = Words(texts, EXACT)
            gone = np.zeros(words.n, bool)
            starts = np.flatnonzero(words.left >= length)
            if names is not None and len(starts):
                a = windows(words.hashes[0], length)[starts]
                likely, _ = names.find(a)
                if len(likely):
                    b = (windows(Words(texts, EXACT_TOO).hashes[0], length)[starts[likely]] >> np.uint64(32)).astype(np.uint32)
                    rows, which = names.find(a[likely], b)
                    hit = starts[likely[rows]]
                    hit = hit[least[which] < numbers[words.doc[hit] + first]]
                    marks = np.zeros(words.n + 1, np.int32)
                    marks[hit] += 1
                    np.add.at(marks, hit + length, -1)
                    gone = np.cumsum(marks)[:-1] > 0
            removed.append(gone)
            sizes.append(words.sizes)
        return _result(docs, np.concatenate(sizes), np.concatenate(removed), rewrite)

    flags = chunks.settle(chunks.send(send_anchors), shared_flags)
    answers = chunks.settle(chunks.send_after(flags, send_runs), settle_runs)
    if rewrite:
        return chunks.receive(answers, receive, kept.schema).select(*docs.columns)
    return chunks.receive(answers, receive, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def _result(docs: pa.Table, sizes: np.ndarray, removed: np.ndarray, rewrite: bool) -> pa.Table:
    ends = np.cumsum(sizes)
    begins = ends - sizes
    lost = np.diff(np.concatenate([[0], np.cumsum(removed)])[np.append(0, ends)])
    texts, digests = [], []
    for i, text in enumerate(docs.column("text").to_pylist()):
        if rewrite and not lost[i]:
            texts.append(text)
            continue
        split = text.encode().split() if text else []
        if lost[i]:
            stay = ~removed[begins[i] : ends[i]]
            split = [w for w, s in zip(split, stay.tolist()) if s]
        joined = b" ".join(split)
        if rewrite:
            texts.append(joined.decode())
        else:
            digests.append(hashlib.sha256(joined).hexdigest())
    if rewrite:
        out = docs.drop_columns([CHUNK])
        out = out.set_column(out.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))
        if "n_chars" in out.schema.names:
            old = out.column("n_chars").to_pylist()
            out = out.set_column(out.schema.get_field_index("n_chars"), "n_chars", pa.array([len(t) if k else o for t, o, k in zip(texts, old, lost.tolist())], out.schema.field("n_chars").type))
        return out
    return pa.table({"doc_id": docs.column("doc_id").cast(pa.int64()), "n_words": sizes, "n_removed": lost.astype(np.int64), "kept_sha256": pa.array(digests, pa.string())})
