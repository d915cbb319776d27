"""URL filters by a bit-parallel wildcard automaton.

All glob patterns are laid end to end in one row of 64-bit words, a bit for each place in a pattern.  A character
moves every bit one place on where its pattern has that character (Shift-And), and a bit before a star stays.  So
one pass over a URL simulates all patterns, and a batch of URLs is advanced together, a character at a time.

A canonical URL is ``.host`` + a separator byte that no UTF-8 text has + ``path``.  A star in a host part doesn't
pass the separator, one in a path part passes anything.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .block_naming import LOWER, UPPER

SEPARATOR, HOST_STAR, PATH_STAR, ANY = 0xFF, 256, 257, 258


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def symbols(self) -> list[int]:
        """Host and all its subdomains, and any path that starts with the rule's."""
        return [HOST_STAR, ord("."), *self.host.encode(), SEPARATOR, *self.path.encode(), PATH_STAR]


def host_glob(glob: str) -> list[int]:
    """A glob for the whole host: ``*`` any run, ``?`` any one byte of it; any path."""
    out = [ord(".")]
    for c in glob:
        out += [{"*": HOST_STAR, "?": ANY}[c]] if c in "*?" else c.encode()
    return [*out, SEPARATOR, PATH_STAR]


class ShiftAnd:
    def __init__(self, patterns: list[list[int]]):
        places, masks, stays, starts, self.accept = 0, [], [], [], []
        for pattern in patterns:
            starts.append(places)
            at = places
            for s in pattern:
                if s in (HOST_STAR, PATH_STAR):
                    stays.append((at, s))
                else:
                    at += 1
                    masks.append((at, s))
            self.accept.append(at)
            places = at + 1
        self.words = max(1, -(-places // 64))
        self.match, self.stay = np.zeros((256, self.words), np.uint64), np.zeros((256, self.words), np.uint64)
        self.first = np.zeros(self.words, np.uint64)
        for at in starts:
            self.first[at // 64] |= self._bit(at)
        for at, s in masks:
            for c in (x for x in range(256) if x != SEPARATOR) if s == ANY else (s,):
                self.match[c, at // 64] |= self._bit(at)
        for at, s in stays:
            for c in range(256):
                if s == PATH_STAR or c != SEPARATOR:
                    self.stay[c, at // 64] |= self._bit(at)

    @staticmethod
    def _bit(at: int) -> np.uint64:
        return np.uint64(1 << (at % 64))

    def run(self, texts: list[bytes]) -> np.ndarray:
        """(texts, patterns) booleans: whether the pattern fits the whole text."""
        sizes = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-sizes, kind="stable")
        ends = np.concatenate([[0], np.cumsum(sizes)])
        flat = np.frombuffer(b"".join(texts), np.uint8)
        state = np.repeat(self.first[None], len(texts), axis=0)
        begins, lengths = ends[:-1][order], sizes[order]
        active = len(texts)
        for i in range(int(sizes.max(initial=0))):
            while active and lengths[active - 1] <= i:
                active -= 1
            c = flat[begins[:active] + i]
            now = state[:active]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:active] = (moved & self.match[c]) | (now & self.stay[c])
        out = np.empty((len(texts), len(self.accept)), bool)
        for k, at in enumerate(self.accept):
            out[order, k] = (state[:, at // 64] >> np.uint64(at % 64)) & np.uint64(1) != 0
        return out


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(pages: DataFrame, rules: list[Rule], blocked: list[str], url: str = "url", key: str = "page_id") -> DataFrame:
    """page_id, host, path, rule, verdict of each row of ``pages``.

    The longest rule that fits decides.  Where none fits, the automaton's globs of blocked hosts do: a host that one
    of them fits is blocked, and so is a URL without a host; others are allowed.  One pass without a shuffle.  A null
    URL has an empty host and path; repeated rows and those without a page_id are judged each; no rows give none.
    """
    automaton = ShiftAnd([r.symbols() for r in rules] + [host_glob(g) for g in blocked])
    order = sorted(range(len(rules)), key=lambda k: len(rules[k].text))
    kind = f"{key} long, host string, path string, rule string, verdict string"
    schema = pa.schema([(key, pa.int64()), *((c, pa.string()) for c in ("host", "path", "rule", "verdict"))])

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
                fits = automaton.run([b"." + h.encode() + b"\xff" + p.encode() for h, p in zip(hosts, paths)])
                rule, verdict = np.full(len(hosts), None, object), np.where(fits[:, len(rules) :].any(axis=1), "block", "allow").astype(object)
                verdict[[not h for h in hosts]] = "block"
                for k in order:  # longer ones later, so they win
                    rule[fits[:, k]], verdict[fits[:, k]] = rules[k].text, rules[k].verdict
                yield pa.RecordBatch.from_arrays([batch.column(key).cast(pa.int64()), batch.column("host"), batch.column("path"), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], schema=schema)

    return pages.select(key, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")).mapInArrow(run, kind)
