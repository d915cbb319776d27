"""Leak automaton, exponion codes and bucket resampling against plain versions."""

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import brute
import numpy as np
import pyarrow as pa
import pytest

from voxlake.llm import bucket_resampling, exponion_codes, leak_automaton, plain_words

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(brute.fold(text))


def leaks(docs, items, window):
    runs = {}
    for name, text in items:
        w = words(text)
        size = min(window, len(w))
        for a in range(len(w) - size + 1 if w else 0):
            runs.setdefault(tuple(w[a : a + size]), set()).add(name)
    out = []
    for d, text in docs:
        w = words(text)
        hit, names = [False] * len(w), set()
        for size in {len(r) for r in runs}:
            for a in range(len(w) - size + 1):
                if (found := runs.get(tuple(w[a : a + size]))) is not None:
                    hit[a : a + size] = [True] * size
                    names |= found
        names = sorted(str(n) for n in names if n is not None)
        out.append((d, len(w), sum(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), any(hit)))
    return sorted(out, key=str)


def leaky(seed, letters="abc", n=60):
    rng = random.Random(seed)
    items = [(rng.choice([None, k, k // 2]), " ".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 2, 3, 5, 8, 30])))) for k in range(12)]
    items += [(90, None), (91, "Ünd é, 5x!"), (92, "...")]
    docs = [(k if rng.random() < 0.9 else None, rng.choice([" ", ", ", "\n"]).join(rng.choice(letters.upper() + letters + "xé") for _ in range(rng.randrange(60)))) for k in range(n)]
    docs += [(100, None), (101, ""), (102, "ünd É ÜND é 5X ünd é 5x"), (103, items[0][1]), (103, items[0][1]), (104, (items[5][1] + " zz ") * 40)]
    return docs, items


@pytest.mark.parametrize("window,part,piece", [(4, 200_000, 20_000), (4, 15, 7), (10, 200_000, 20_000), (1, 200_000, 20_000)])
def test_leaks(spark, monkeypatch, window, part, piece):
    monkeypatch.setattr(leak_automaton, "PART_WORDS", part)
    monkeypatch.setattr(leak_automaton, "PIECE_WORDS", max(piece, window + 2))
    docs, items = leaky(window)
    table = spark.createDataFrame([(d, t, "k", True) for d, t in docs], "doc_id int, text string, n_hit string, contaminated boolean")
    got = leak_automaton.leaks(table, spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int"), window)
    assert sorted((tuple(r)[:6] for r in got.collect()), key=str) == leaks(docs, items, window)


def test_leaks_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), spark.createDataFrame([(1, "b")], "item_id long, text string")
    assert not leak_automaton.leaks(docs.where("false"), items).collect()
    (row,) = leak_automaton.leaks(docs, items.where("false")).collect()
    assert tuple(row)[:4] == (1, 3, 0, 0) and row.items_sha256 == hashlib.sha256(b"").hexdigest()


def test_long_leaky_text_and_cut_texts(spark):
    rng = random.Random(3)
    item = " ".join(f"w{rng.randrange(500)}" for _ in range(300))
    noise = " ".join(f"w{rng.randrange(500)}" for _ in range(400_000))
    docs = spark.createDataFrame([(1, f"{noise}\n{item}.\n{noise}", "x"), (2, item, "y"), (3, f"Clean {item[:20]}", "z"), (None, None, None)], "doc_id long, text string, lang string")
    items = spark.createDataFrame([("q", item)], "item_id string, text string")
    got = {r.doc_id: r for r in leak_automaton.leaks(docs, items).collect()}
    assert [got[d].n_hit for d in (1, 2, 3, None)] == [300, 300, 0, 0] and got[1].n_words == 800_300 and got[1]["items"] == ["q"]
    kept = {r.doc_id: r for r in leak_automaton.decontaminate(docs, items, coverage=0.5).collect()}
    assert kept.keys() == {1, 3, None} and kept[1].text == f"{noise}\n.\n{noise}" and kept[1].lang == "x" and kept[3].text.startswith("Clean")


def test_automaton_matches_longest_runs():
    rng = random.Random(4)
    runs = [[rng.randrange(3) for _ in range(rng.randrange(1, 25))] for _ in range(8)]
    auto = leak_automaton.Automaton()
    for r in runs:
        assert auto.size[auto.add(r)] == len(r)
    held = {tuple(r[a:b]) for r in runs for a in range(len(r)) for b in range(a + 1, len(r) + 1)}
    text = [rng.randrange(4) for _ in range(400)]
    for at, (_, length) in enumerate(auto.stream(text)):
        assert length == max((n for n in range(26) if n <= at + 1 and tuple(text[at + 1 - n : at + 1]) in held), default=0)


def test_colliding_words_are_compared_by_bytes(monkeypatch):
    monkeypatch.setattr(leak_automaton, "HASH", lambda flat, starts, ends: np.array([flat[a] % 4 for a in starts], np.uint64))
    part = leak_automaton.Part([("q", "a b c")], 3)
    _, hit, items, _ = part.hits(pa.array(["a b c", "e f g", "a b c a f c", None, "a b", "c"]))
    assert hit.tolist() == [True] * 3 + [False] * 3 + [True] * 3 + [False] * 6 and list(items) == [0, 2]


def test_plain_words_of_all_bytes():
    texts = ["".join(chr(c) for c in range(256)), "ÀB cD€0", None, "", "a", "b"]
    flat, starts, ends, counts = plain_words.plain_words(pa.array(texts))
    got = [flat[a:b].tobytes() for a, b in zip(starts, ends)]
    assert got == [w for t in texts for w in words(t)] and counts.tolist() == [len(words(t)) for t in texts]


def codes(rows, parts, entries, rounds):
    """Plain product codes of (id, vector, label) rows that are all kept, in order of id and vector."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = [[math.floor(Fraction(v) * 1024) for v in r[1]] for r in rows]
    w = len(x[0]) // parts
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for v in x]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def assign():
        out = []
        for c in cut:
            out.append([min((sum((a - b) ** 2 for a, b in zip(c[p], e)), k) for k, e in enumerate(books[p])) for p in range(parts)])
        return out

    for _ in range(rounds):
        now = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [c[p] for c, a in zip(cut, now) if a[p][1] == k]
                if mine:
                    books[p][k] = [sum(v) // len(mine) for v in zip(*mine)]
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    done = [(r[0], "".join(f"{k:02x}" for _, k in a), sum(d for d, _ in a), r[2]) for r, a in zip(rows, assign())]
    sums = {}
    for _, _, e, label in done:
        sums[label] = sums.get(label, 0) + e
    fits = lambda v: v if v < 1 << 63 else None
    return sorted(((i, c, fits(e), fits(sums[label]), digest) for i, c, e, label in done), key=str)


@pytest.mark.parametrize("scale,dim,entries", [(1.0, 8, 16), (0.003, 4, 40), (3e8, 4, 7), (1.0, 12, 200)])
def test_codes(spark, scale, dim, entries):
    rng = np.random.default_rng(dim)
    x = rng.normal(size=(150, dim)) * scale
    x[40:90] = np.round(x[40:90] / scale) * scale  # ties
    x[90:110] = x[3]
    rows = [(int(k), v.tolist(), [1, 2, None][k % 3]) for k, v in enumerate(x)]
    rows += [(None, x[5].tolist(), 4), (7, x[7].tolist(), 1), (7, x[8].tolist(), 1)]
    odd = [(3, None, 1), (0, [], 1), (0, [None] * dim, 1), (0, [float("nan")] * dim, 1), (0, [float("-inf")] + [0.0] * (dim - 1), 1), (900, [1.0] * (dim + 4), 1), (901, [1e30] * dim, 1)]
    table = spark.createDataFrame([(*r, "k", 1) for r in rows + odd], "vec_id long, embedding array<double>, label int, code string, id int").repartition(5)
    got = exponion_codes.compress(table, 4, entries, 3)
    assert sorted((tuple(r) for r in got.collect()), key=str) == codes(rows, 4, entries, 3)


def test_codes_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, label string"
    assert not exponion_codes.compress(spark.createDataFrame([], schema)).collect()
    assert not exponion_codes.compress(spark.createDataFrame([(1, None, "a"), (2, [1.0] * 3, "a")], schema)).collect()
    (row,) = exponion_codes.compress(spark.createDataFrame([(1, [0.5, -0.3, 1.0, 0.0], None)], schema)).collect()
    assert (row.code, row.error, row.label_error) == ("00000000", 0, 0)


def test_search_measures_less_than_all():
    rng = np.random.default_rng(1)
    centres = rng.integers(-9000, 9000, (64, 4))
    x = (centres[rng.integers(0, 64, 5000)] + rng.integers(-60, 60, (5000, 4))).astype(float)
    book = exponion_codes.Book(centres.astype(float))
    code, error, _ = book.assign(x, np.zeros(5000, np.int64))
    again, same, measured = book.assign(x, code)
    full = ((x[:, None, :] - centres) ** 2).sum(-1)
    assert (code == full.argmin(1)).all() and (again == code).all() and (error == full.min(1)).all() and (same == error).all()
    assert measured < 0.2 * full.size


def test_decoded_codes_are_the_entries():
    books = exponion_codes.Codebooks([[[1, 2], [3, 4]], [[5, 6], [7, 8]]])
    assert books.decode(np.array([[0, 1], [1, 0]])).tolist() == [[1, 2, 7, 8], [3, 4, 5, 6]] and books.text() == "1,2,3,4,5,6,7,8"


def runs_of(text):
    w = words(text)
    return [*w, *(b" ".join(p) for p in zip(w, w[1:]))]


def drawn(docs, target, buckets, seed, least, percent):
    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for f in (f for x in texts for f in runs_of(x)):
            counts[zlib.crc32(f) % buckets] += 1
    raw, aim = sum(s) + buckets, sum(t) + buckets
    gain = [math.floor(1000 * math.log((float(b + 1) * raw) / (float(a + 1) * aim))) for a, b in zip(s, t)]
    out = []
    for d, x in docs:
        f = runs_of(x)
        weight = sum(gain[zlib.crc32(k) % buckets] for k in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words(x))])
    enough = sorted((r for r in out if r[-1] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for k, r in enumerate(enough[: percent * len(enough) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def odd_texts(seed, n):
    rng = random.Random(seed)
    pool = ["a", "B", "longer", "Ünï", "5", "x" * 63, "y" * 64, "z" * 65, "w" * 3000, "mid" * 9]
    rows = [(k if rng.random() < 0.9 else None, rng.choice([" ", ", ", "\n"]).join(rng.choice(pool) for _ in range(rng.randrange(30)))) for k in range(n)]
    return [*rows, (500, None), (501, ""), (502, "..."), (503, rows[0][1]), (503, rows[0][1]), (504, "one " * 200_000)]


@pytest.mark.parametrize("buckets,least,percent", [(10000, 20, 25), (97, 1, 60), (1 << 16, 0, 100)])
def test_importance(spark, buckets, least, percent):
    docs, target = odd_texts(buckets, 120), [x for _, x in odd_texts(buckets + 1, 30)]
    table = spark.createDataFrame([(d, x, "k", 1) for d, x in docs], "doc_id int, text string, rank string, words int").repartition(7)
    got = bucket_resampling.importance(table, spark.createDataFrame([(x,) for x in target], "text string"), buckets, 7, least, percent)
    assert sorted((tuple(r) for r in got.collect()), key=str) == drawn(docs, target, buckets, 7, least, percent)


def test_importance_of_empty_tables(spark):
    docs, target = spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), spark.createDataFrame([("a",)], "text string")
    assert not bucket_resampling.importance(docs.where("false"), target).collect()
    (row,) = bucket_resampling.importance(docs, target.where("false"), least_words=1, percent=100).collect()
    assert (row.n_features, row.rank) == (5, 1)
    assert [r.doc_id for r in bucket_resampling.draw(docs, target, least_words=1, percent=100).collect()] == [1]


def test_many_equal_rows_are_ranked(spark):
    docs = spark.range(3000).selectExpr("CAST(NULL AS long) AS doc_id", "repeat('same words ', 20) AS text")
    got = bucket_resampling.importance(docs, spark.createDataFrame([("same words",)], "text string"))
    assert sorted(r["rank"] for r in got.where("rank IS NOT NULL").collect()) == list(range(1, 751))
