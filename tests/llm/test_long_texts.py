"""Texts of a megabyte: one word over and over, one single word, and many words with a changed copy, beside short ones."""

import hashlib
import random
import zlib

import brute
import numpy as np
import public_tokenizers as public
import pytest
import tiktoken
from tokenizers import Tokenizer

from voxlake.llm import block_naming, bound_packing, bpe_fst, bwt_dedup, cover_dedup, partition_join, token_files

RANKS, WORDS = public.path("byte_bpe_multi_50k.tiktoken"), public.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = [f"w{rng.randrange(40_000)}" for _ in range(150_000)]
    changed = list(words)
    for _ in range(400):
        changed[rng.randrange(len(changed))] = "other"
    return [(1, "lang " * 210_000), (2, "Z" * 1_050_000), (3, " ".join(words)), (4, " ".join(changed)), (5, " ".join(words[500:600])), (6, None), (7, "lang " * 210_000)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache()


def test_exact(docs, rows):
    got = block_naming.exact_dedup(docs).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute.exact(rows)


def test_word_runs(docs, rows):
    assert sorted(map(tuple, cover_dedup.remove(docs).collect()), key=str) == brute.word_runs(rows, 50)


def test_byte_runs(docs, rows):
    assert sorted(map(tuple, bwt_dedup.remove(docs).collect()), key=str) == brute.byte_runs(rows, 100)


def test_jaccard(docs, rows):
    got = sorted(map(tuple, partition_join.classes(docs, 4, 85, 100).collect()))
    assert got == brute.jaccard(rows, 4, 85, 100) and {r[0]: r[2] for r in got}[4] == 3


def test_ids(docs, rows):
    """Packing, token files and the byte-level codec against the libraries."""
    tok = Tokenizer.from_file(WORDS)
    ids = {d: tok.encode(t or "", add_special_tokens=False).ids for d, t in rows}
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    pieces = sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in bound_packing.pack(docs, WORDS, 1, capacity=4096).collect())
    cut = {d: [(v + [1])[a : a + 4096] for a in range(0, len(v) + 1, 4096)] for d, v in ids.items()}
    assert pieces == [(d, k, k * 4096, len(p), crc(p)) for d in sorted(cut) for k, p in enumerate(cut[d])]
    files = [(r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.round_trip(docs, WORDS, 2).orderBy("start").collect()]
    assert files == [(d, len(v) + 1, crc(v + [2])) for d, v in sorted(ids.items())]
    enc = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=bpe_fst.read_ranks(RANKS), special_tokens={})
    got = {r.doc_id: (r.ids_sha256, r.decoded_sha256) for r in bpe_fst.encode_decode(docs, RANKS, public.PATTERN).collect()}
    digest = lambda b: hashlib.sha256(b).hexdigest()
    assert got == {d: (digest(np.array(enc.encode_ordinary(t or ""), "<u4").tobytes()), digest(brute.raw(t))) for d, t in rows}
