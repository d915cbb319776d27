"""Operators on documents against brute force, with nulls, empty and long texts, ties, repeated rows and odd columns."""

import hashlib
import random
import zlib

import brute
import numpy as np
import pyarrow as pa
import public_tokenizers as public
import pytest
import tiktoken
from tokenizers import Tokenizer

from voxlake.llm import block_naming, bound_packing, bpe_fst, bwt_dedup, cover_dedup, id_store, partition_join, token_files
from voxlake.llm.common import shared_dir
from voxlake.llm.word_tokens import WordIds

SCHEMA = "doc_id long, text string, lang string, chunk string, name string, v long"
RANKS, WORDS = public.path("byte_bpe_multi_50k.tiktoken"), public.path("word_bpe_49k.json")


def corpus(seed=7, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(("the", "Re", "ön", "é", "日", "x9", "ing,", "--")) for _ in range(rng.randint(1, 3)))
    passage = [word() for _ in range(70)]
    rows = []
    for i in range(n):
        w = [word() for _ in range(rng.randint(1, 160))]
        if i % 4 == 0:
            at = rng.randint(0, len(w))
            w[at:at] = passage[: rng.randint(40, 70)]
        if i % 5 == 1 and rows:
            w = (rng.choice(rows)[1] or "a").split(" ")
            if rng.random() < 0.7:
                w[rng.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    rows += [(100, None), (101, ""), (102, " \n\t"), (103, "Same Text"), (104, "same text"), (105, "ÄB same"), (106, "äb same"), (107, "one")]
    rows += [(112, "a <|endoftext|> b<|startoftext|>c <|ENDOFTEXT|> d")]
    rows += [(108, "lang " * 3000), (109, "lang " * 3001), (110, "ab" * 9000), (111, "Z" * 5000 + "😀" * 800)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "en", "c", "n", 1) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).repartition(3).cache()


def test_bpe_is_tiktokens_and_round_trips(docs, rows):
    enc = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=bpe_fst.read_ranks(RANKS), special_tokens={})
    got = {r.doc_id: r for r in bpe_fst.encode_decode(docs, RANKS, public.PATTERN, with_ids=True).collect()}
    for d, t in rows:
        ids = enc.encode_ordinary(t or "")
        r = got[d]
        assert (r.ids, r.decoded, r.n_tokens) == (ids, t or "", len(ids))
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r.decoded_sha256 == hashlib.sha256(brute.raw(t)).hexdigest()


def test_bpe_on_odd_strings_and_small_tables(monkeypatch):
    codec = bpe_fst.Codec(*bpe_fst.compile_merges(RANKS), public.PATTERN)
    enc = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=bpe_fst.read_ranks(RANKS), special_tokens={})
    rng = random.Random(1)
    letters = list("ab 'sTé日😀²½_\n\t\x85\xa0\x1c") + ["\u2003", "ʰ", "the", "ing"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(800)] + ["a" * 3000, "abé" * 900]
    for limit in (bpe_fst.STATE_LIMIT, 50):
        monkeypatch.setattr(bpe_fst, "STATE_LIMIT", limit)
        codec = bpe_fst.Codec(*bpe_fst.compile_merges(RANKS), public.PATTERN)
        for i in range(0, len(texts), 50):
            part = [*texts[i : i + 50], None]
            assert [x.tolist() for x in codec.encode(part)] == [enc.encode_ordinary(t or "") for t in part]
    for _ in range(200):
        ids = np.array([rng.randrange(256) for _ in range(20)])
        assert b"".join(codec.decode(ids, 3)).decode() == b"".join(codec.decoder.tokens[i] for i in ids).decode("utf-8", "replace")


@pytest.mark.parametrize("block,key", [(4096, None), (16, None), (64, "few")])
def test_exact_dedup(docs, rows, block, key):
    from pyspark.sql import functions as F

    route = block_naming.route_key if key is None else lambda b: F.pmod(F.xxhash64(b), F.lit(5))  # keys that clash
    got = block_naming.exact_dedup(docs, block, route).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute.exact(rows)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_exact_dedup_repeated_and_null_ids(spark):
    rows = [(1, "A"), (1, "a"), (None, "a"), (2, None), (3, "")]
    got = block_naming.exact_dedup(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute.exact(rows)
    assert sum(r.kept for r in got) == 2
    assert sorted(r.doc_id for r in block_naming.keep_one(frame(spark, rows)).collect()) == [1, 3]


@pytest.mark.parametrize("length,modulus", [(50, 31), (10, 7)])
def test_word_runs(docs, rows, length, modulus):
    got = cover_dedup.remove(docs, length, modulus).collect()
    assert sorted(map(tuple, got), key=str) == brute.word_runs(rows, length)


def test_word_runs_rewritten(spark, docs, rows):
    out = {r.doc_id: r for r in cover_dedup.remove(docs, 10, 7, rewrite=True).collect()}
    want = {d: (n, g, h) for d, n, g, h in brute.word_runs(rows, 10)}
    for d, t in rows:
        assert out[d].chunk == "c" and hashlib.sha256(b" ".join(brute.raw(out[d].text).split())).hexdigest() == want[d][2]
        if not want[d][1]:
            assert out[d].text == t
    repeated = [(5, "a b c d e f g h i j k"), (5, "a b c d e f g h i j k"), (None, "a b c d e f g h i j"), (4, "x")]
    assert sorted(map(tuple, cover_dedup.remove(frame(spark, repeated), 10, 7).collect()), key=str) == brute.word_runs(repeated, 10)


def test_covers_are_difference_covers():
    for v, cover in cover_dedup.COVERS.items():
        assert {(a - b) % v for a in cover for b in cover} == set(range(v))


def test_hot_byte_runs(spark, rows):
    passage = "the line that everybody has, over and over again"
    more = [(200 + i, f"{i * 7919 % 1009} {i} {passage} {i * 104729 % 1013} and {passage} {i % 7}") for i in range(80)]
    every = rows + more
    for most in (30, 1):
        got = bwt_dedup.remove(frame(spark, every).repartition(3), 40, most=most).collect()
        assert sorted(map(tuple, got), key=str) == brute.byte_runs(every, 40)


@pytest.mark.parametrize("length", [100, 40])
def test_byte_runs(docs, rows, length):
    got = bwt_dedup.remove(docs, length).collect()
    assert sorted(map(tuple, got), key=str) == brute.byte_runs(rows, length)


def test_byte_runs_repeated_rows(spark):
    rows = [(5, "ab" * 60), (5, "ab" * 60), (None, "ab" * 50 + "c"), (6, "x" * 40 + "\0" * 70)]
    out = bwt_dedup.remove(frame(spark, rows), 40, with_text=True).collect()
    assert sorted((tuple(r)[:5] for r in out), key=str) == brute.byte_runs(rows, 40)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and sum(b - a for a, b in r.spans) == r.n_removed for r in out)


@pytest.mark.parametrize("k,num,den", [(4, 85, 100), (2, 60, 100), (1, 50, 100)])
def test_jaccard_classes(docs, rows, k, num, den):
    assert sorted(map(tuple, partition_join.classes(docs, k, num, den).collect())) == brute.jaccard(rows, k, num, den)


def test_jaccard_chain_and_keep(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[i : i + 40])) for i in range(20)] + [(50, None), (51, "solo"), (52, "SOLO")]
    got = sorted(map(tuple, partition_join.classes(frame(spark, rows), 1, 90, 100).collect()))
    assert got == brute.jaccard(rows, 1, 90, 100)
    kept = {r.doc_id for r in partition_join.keep_one(frame(spark, rows), 1, 90, 100).collect()}
    assert kept == {0, 50, 51}


def test_forest_joins_what_all_pairs_join():
    rng = np.random.default_rng(2)
    for size in (1, 5, 60):
        pairs = rng.integers(0, 40, (size, 2))
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        margin = rng.integers(-5, 0, len(pairs)).astype(float)
        rows = partition_join.forest(pairs, pairs[:, 0], pairs[:, 1], margin)
        whole, part = brute.Forest(range(40)), brute.Forest(range(40))
        for a, b in pairs.tolist():
            whole.join(a, b)
        for a, b in pairs[rows].tolist():
            assert part.find(a) != part.find(b)
            part.join(a, b)
        assert [whole.find(i) for i in range(40)] == [part.find(i) for i in range(40)]


def test_schemes_cover_every_pair():
    for low, high in partition_join.bands(3000, 85, 100):
        for sets in (10, 10**5, 10**9):
            s = partition_join.Scheme(3, low, high, sets, 85, 100)
            assert s.single + 2 * s.double > s.differ


def test_word_ids_are_the_librarys(monkeypatch):
    coder, tok = WordIds(open(WORDS, encoding="utf-8").read()), Tokenizer.from_file(WORDS)
    rng = random.Random(3)
    letters = list("abXY09'.,!-_$é ßÄ²ÀİǅȺσΣ\n\t\x85\xa0\x1c­日é×") + ["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "'s", "'T", " "]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    want = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert coder.cuts and any(49407 in x for x in want)
    for keep in (id_store.KEEP, 40):  # the second forgets again and again
        monkeypatch.setattr(id_store, "KEEP", keep)
        got = []
        for i in range(0, len(texts), 100):
            ids, ends = coder.encode(pa.array([*texts[i : i + 100], None], pa.string()))
            got += [x.tolist() for x in np.split(ids, ends[:-1])]
            assert got.pop() == [] and len(coder.words.names) <= max(keep, 3000)
        assert got == want


def reference_ids(rows, end):
    tok = Tokenizer.from_file(WORDS)
    return [(d, tok.encode(t or "", add_special_tokens=False).ids + [end]) for d, t in rows]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(spark, docs, rows):
    uri, at, want = shared_dir(spark), 0, []
    for d, ids in reference_ids(sorted(rows), 2):
        want.append((d, at, len(ids), crc(ids)))
        at += len(ids)
    shards = token_files.write_tokens(docs, WORDS, 2, uri, shards=3)
    assert sorted(map(tuple, token_files.read_digests(spark, uri, shards).collect())) == want
    reader = token_files.ShardReader(f"{uri}/tokens-{shards[0][0]}.arrow")
    ids, mask = reader.sequence(0)
    assert len(ids) == len(mask) == reader.length and mask.sum() == min(reader.length, shards[0][2])


def test_packing_tears_partitions_with_gaps_only(spark, monkeypatch):
    from pyspark.sql import functions as F

    sizes, rounds = np.random.default_rng(0).integers(5, 16, 90), []
    df = spark.createDataFrame([(i, 0, 0, int(n), 0) for i, n in enumerate(sizes)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    one, even = bound_packing._round, F.shiftright("sequence_id", 24) % 2 == 0
    monkeypatch.setattr(bound_packing, "pieces", lambda docs, *_: docs)
    need = bound_packing.lower_bound(np.bincount(sizes, minlength=31))
    out = bound_packing.pack(df, "", 1, capacity=30, per_task=20).collect()
    assert sorted(r.doc_id for r in out) == list(range(90)) and len({r.sequence_id for r in out}) == need
    # partitions of even number are said to have a gap: all their pieces, and no others, come to the next round

    def gaps(rows, *a):
        rounds.append((rows, bound_packing.written(one(rows, *a), spark)))
        return rounds[-1][1].withColumn("gap", F.when(even, 1).otherwise(0))

    monkeypatch.setattr(bound_packing, "_round", gaps)
    out = bound_packing.pack(df, "", 1, capacity=30, per_task=20).collect()
    assert sorted(r.doc_id for r in out) == list(range(90))
    assert {r.doc_id for r in rounds[1][0].collect()} == {r.doc_id for r in rounds[0][1].where(even).collect()}


def test_packing(docs, rows):
    out = bound_packing.pack(docs, WORDS, 1, capacity=256, per_task=20).collect()
    want = {(d, k, a): (len(ids[a : a + 256]), crc(ids[a : a + 256])) for d, ids in reference_ids(rows, 1) for k, a in enumerate(range(0, len(ids), 256))}
    assert {(r.doc_id, r.piece, r.start): (r.length, r.ids_crc32) for r in out} == want and len(out) == len(want)
    bins = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 256
    bound = bound_packing.lower_bound(np.bincount([n for n, _ in want.values()], minlength=257))
    assert bound <= len(bins) <= bound + 1
    assert {(r.n_sequences, r.least_sequences) for r in out} == {(len(bins), bound)}


def test_lower_bound_is_sound():
    rng = random.Random(4)
    for _ in range(60):
        sizes = [rng.randint(1, 20) for _ in range(rng.randint(1, 7))]
        best = len(sizes)

        def place(i, rooms):
            nonlocal best
            if len(rooms) >= best:
                return
            if i == len(sizes):
                best = len(rooms)
                return
            for k, room in enumerate(rooms):
                if room >= sizes[i]:
                    place(i + 1, [*rooms[:k], room - sizes[i], *rooms[k + 1 :]])
            place(i + 1, [*rooms, 20 - sizes[i]])

        place(0, [])
        assert bound_packing.lower_bound(np.bincount(sizes, minlength=21)) <= best
    assert bound_packing.lower_bound(np.bincount([11] * 5, minlength=21)) == 5


def test_repeated_rows_and_rows_without_id(spark):
    rows = [(7, "Same words here"), (7, "Same words here"), (None, "no name"), (None, None), (3, ""), (3, None)]
    docs = frame(spark, rows)
    got = bpe_fst.encode_decode(docs, RANKS, public.PATTERN).collect()
    enc = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=bpe_fst.read_ranks(RANKS), special_tokens={})
    assert sorted((r.doc_id or -1, r.n_tokens) for r in got) == sorted((d or -1, len(enc.encode_ordinary(t or ""))) for d, t in rows)
    packed = bound_packing.pack(docs, WORDS, 1, capacity=16)
    out = packed.collect()
    assert len(out) == 6 and sum(r.length for r in out) == sum(len(ids) for _, ids in reference_ids(rows, 1))
    assert packed.certificate == (len({r.sequence_id for r in out}), 1)
    files = sorted(token_files.round_trip(docs, WORDS, 2).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in files] == [None, None, 3, 3, 7, 7] and sum(r.n_tokens for r in files) == files[-1].start + files[-1].n_tokens
    assert sorted(r.ids_crc32 for r in files) == sorted(crc(ids) for _, ids in reference_ids(rows, 2))
    classes = partition_join.classes(frame(spark, [(1, "a b c d e"), (1, "a b c d e"), (1, "x y z v w"), (None, "A b c d e"), (2, "x y z v w"), (None, "q r s t u")]), 4, 85, 100)
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in classes.collect()) == [(-1, -1), (-1, 1), (1, 1), (1, 1), (1, 1), (2, 1)]


def test_empty_tables(spark):
    none = frame(spark, [])
    assert not bpe_fst.encode_decode(none, RANKS, public.PATTERN).collect()
    assert not block_naming.exact_dedup(none).collect()
    assert not cover_dedup.remove(none).collect() and not bwt_dedup.remove(none).collect()
    assert not partition_join.classes(none).collect()
    assert not bound_packing.pack(none, WORDS, 1).collect()
    assert not token_files.round_trip(none, WORDS, 2).collect()
