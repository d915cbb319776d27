"""Jaccard join of shingle sets by partition of the universe.

Sets whose Jaccard similarity reaches a threshold differ in at most H tokens, where H follows from their sizes.  For
each band of sizes the tokens are hashed into segments of weight 1 or 2 with a total weight over H.  By the pigeonhole
principle two such sets agree wholly on a segment of weight 1, or differ by at most one token on one of weight 2; the
first is met by an index of the segments' contents, the second by contents with one token deleted.  How many segments
of either kind a band has, and how much weight to spare, is chosen by cost from the band's count of sets.

An empty content says little, so sets that still have more weight without their empty segments than their own size lets
partners differ aren't paired by those; only the few others (probers) are, with all that have the same segment empty.

Sets with one signature form a group.  Copies are one set.  Groups aren't expanded: each member is verified against
the group's first, and only members whose components still differ are compared with one another, inside tasks, in
blocks of a group, by sketches: two sets' sketches differ in no more bits than the sets do in tokens.  Of the pairs that
pass a task first returns a spanning forest of the components, likeliest links first; when these are verified by the
exact intersection, most components are one, and all pairs that still pass between different ones are verified too.

Defined results: null and empty texts have an empty set and no links; with fewer words than a shingle the whole
sequence is the only shingle; repeated rows are copies; rows with one doc_id are one vertex; a row without a doc_id
belongs to the class of a row with an equal set, if there is one, and links with nothing else.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWERED, doc_slices, dropped, hashed_words, joined_back, mix, no_cycles, partitions, split_by, windows, written
from .components import components
from .packed import Chunks, array, ids_of

#: Cost of verifying a pair, in index entries.
PAIR_COST = 30.0
#: Members of a block of a group, rows of a task that compares blocks, and pairs that it looks at together.
BLOCK, TASK_ROWS, TOGETHER = 1024, 100_000, 1 << 18


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted 64-bit hashes of the distinct shingles of each text, A-Z lower-cased."""
    counts, (h,) = hashed_words(texts, LOWERED)
    runs = {j: windows(h, j) ^ np.uint64(j) for j in np.unique(np.minimum(counts, k)).tolist() if j}
    out, at = [], 0
    for c in counts.tolist():
        j = min(c, k)
        s = np.sort(runs[j][at : at + c - j + 1]) if c else np.empty(0, np.uint64)
        out.append(s[np.append(True, s[1:] != s[:-1])] if len(s) > 1 else s)
        at += c
    return out


def sketch(tokens: np.ndarray) -> bytes:
    """Whether the tokens in each of about 2 to 4 cells a token are odd in number, a bit a cell.

    Sketches of two sets differ in no more bits than the sets do in tokens; the halves of one, xored, are the sketch
    of half the size.
    """
    cells = 64 << max(0, (len(tokens) - 1) // 32).bit_length()
    return np.packbits((np.bincount((mix(tokens) & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1).astype(np.uint8)).tobytes()


def folded(sketches: np.ndarray, words: int) -> np.ndarray:
    """Sketches, one a row, of ``words`` 64-bit words."""
    while sketches.shape[1] > words:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def set_digests(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, key (a hash of the text), n, 128 bits (f1, f2) and sketch of each row's set."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("k", pa.binary())])

    @no_cycles
    def run(batches):
        for batch in batches:
            for part in doc_slices(batch):
                sets = shingle_sets(part.column("text"), k)
                prints = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("key"), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints[:, 0].copy()), pa.array(prints[:, 1].copy()), pa.array([sketch(s) for s in sets], pa.binary())], schema=schema)

    return docs.select("doc_id", "text", F.xxhash64("text").alias("key")).mapInArrow(run, "doc_id long, key long, n long, f1 long, f2 long, k binary")


def most_different(total: int, num: int, den: int) -> int:
    """Tokens by which two sets of ``total`` tokens together differ at most when num / den of their union is common."""
    return total - 2 * -(-num * total // (num + den))


class Scheme:
    """Segments for pairs whose larger set is in one band of sizes."""

    def __init__(self, number: int, low: int, high: int, sets: int, num: int, den: int):
        self.number, self.low, self.high, self.num, self.den = number, low, high, num, den
        self.differ = max(max(most_different(t, num, den) for t in range(max(2, 2 * high - 40), 2 * high + 1)), 0)
        need = self.differ + 1
        double, spare = (g.ravel() for g in np.meshgrid(np.unique(np.linspace(0, (need + 1) // 2, 33).astype(int)), np.unique([*range(8), *(need * np.arange(1, 17) // 128)])))
        single = np.maximum(0, need + spare - 2 * double)
        units, cost = single + 2 * double, 0.0
        for size in (max(1, low * num // den), low, high):  # the smallest set of the band below, and the band's own ends
            unit = size / units
            slack = np.maximum(0, units - int(self.most(np.array([size]))[0]) - 1)
            empty = np.maximum(single * np.exp(-unit) + double * np.exp(-2 * unit) * (1 + 2 * unit), 1e-300)
            j = np.arange(slack.max() + 1)[:, None]
            logs = np.array([math.lgamma(i + 1) for i in range(len(j))])[:, None]
            within = np.where(j <= slack, np.exp(j * np.log(empty) - empty - logs), 0).sum(axis=0)
            pairs = sets * np.maximum(0, 1 - within) * (slack + 1) * sets * np.maximum(np.where(single > 0, np.exp(-unit), 0), np.exp(-2 * unit))
            cost = cost + (sets * (single + double * (1 + 2 * unit)) + PAIR_COST * pairs) / 3
        best = int(np.argmin(cost))
        self.single, self.double = int(single[best]), int(double[best])
        self.units = self.single + 2 * self.double
        self.count = self.single + self.double

    def most(self, sizes: np.ndarray) -> np.ndarray:
        """Tokens by which sets of these sizes and their partners here differ at most."""
        return (sizes + np.minimum(self.high, sizes * self.den // self.num)) * (self.den - self.num) // (self.den + self.num)

    def signatures(self, tokens: np.ndarray, owner: np.ndarray, n: int):
        """(signature, owner, kind) of ``n`` sets; kind 0 has a content, 1 is empty, 2 is empty and of a prober."""
        salt = np.uint64((self.number + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        unit = (mix(tokens ^ salt) % np.uint64(self.units)).astype(np.int64)
        segment = np.where(unit < self.single, unit, self.single + (unit - self.single) // 2)
        at = owner * self.count + segment
        value = mix(tokens + salt)
        sums = np.zeros(n * self.count, np.uint64)
        np.add.at(sums, at, value)
        counts = np.bincount(at, minlength=n * self.count)
        weight = np.where(np.arange(self.count) < self.single, 1, 2)
        strong = (counts.reshape(n, -1) >= weight) @ weight
        prober = strong <= self.most(np.bincount(owner, minlength=n))
        place = np.tile(np.arange(self.count, dtype=np.uint64), n)
        full = mix(sums ^ mix(place + salt))
        sigs, owners, empty = [full], [np.repeat(np.arange(n), self.count)], [counts == 0]
        if self.double:
            cut = np.flatnonzero(segment >= self.single)
            sigs.append(mix((sums[at[cut]] - value[cut]) ^ mix(segment[cut].astype(np.uint64) + salt)))
            owners.append(owner[cut])
            empty.append(counts[at[cut]] == 1)
        sig, own, void = map(np.concatenate, (sigs, owners, empty))
        return sig, own, np.where(void, 1 + prober[own], 0).astype(np.uint8)


def bands(largest: int, num: int, den: int) -> list[tuple[int, int]]:
    """Ranges of sizes; a set's partners are in its own range or those beside it."""
    out, low = [], 1
    while low <= largest:
        high = low * den // num
        out.append((low, high))
        low = high + 1
    return out


def candidate_groups(messages: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """g and x of the members of each group, and x, y (g null) of pairs of a prober and another."""
    schema = pa.schema([("g", pa.int64()), ("x", pa.int64()), ("y", pa.int64())])

    def run(key, got):
        rows = got.to_pylist()
        sig, doc, kind, sizes = (np.concatenate([array(m[c], t) for m in rows]) for c, t in (("a", np.uint64), ("b", np.int64), ("c", np.uint8), ("d", np.uint32)))
        size = np.zeros(len(sig), np.int64)  # only those with an empty content send theirs
        size[kind > 0] = sizes
        order = np.lexsort((doc, sig))
        sig, doc, kind, size = sig[order], doc[order], kind[order], size[order]
        fresh = np.append(True, (sig[1:] != sig[:-1]) | (doc[1:] != doc[:-1]))
        sig, doc, kind, size = sig[fresh], doc[fresh], kind[fresh], size[fresh]
        heads = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
        ends = np.append(heads[1:], len(sig))
        g, x, y, known = [], [], [], set()
        for a, b in zip(heads[ends - heads > 1].tolist(), ends[ends - heads > 1].tolist()):
            members = doc[a:b]
            if kind[a]:
                for p in (np.flatnonzero(kind[a:b] == 2) + a).tolist():
                    others = members[(size[a:b] * den >= size[p] * num) & (size[p] * den >= size[a:b] * num) & (members != doc[p])]
                    g.append(np.full(len(others), 0)), x.append(np.full(len(others), doc[p])), y.append(others)
                continue
            name = xxhash.xxh3_64_intdigest(members.tobytes()) >> 1 or 1
            if name not in known:
                known.add(name)
                g.append(np.full(b - a, name)), x.append(members), y.append(np.full(b - a, -1))
        if not g:
            return schema.empty_table()
        g, x, y = (np.concatenate(c).astype(np.int64) for c in (g, x, y))
        return pa.table([pa.array(g, mask=g == 0), pa.array(x), pa.array(y, mask=g != 0)], schema=schema)

    return messages.repartition(n, "bucket").groupBy("bucket").applyInArrow(run, "g long, x long, y long")


class Sketches:
    """Sketches of rows, as a matrix for each width."""

    def __init__(self, blobs: list[bytes]):
        self.words = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 8
        self.place, self.of = np.empty(len(blobs), np.int64), {}
        for w in np.unique(self.words).tolist():
            rows = np.flatnonzero(self.words == w)
            self.place[rows] = np.arange(len(rows))
            self.of[w] = np.frombuffer(b"".join([blobs[r] for r in rows.tolist()]), np.uint64).reshape(-1, w)


def near(one: Sketches, i: np.ndarray, two: Sketches, j: np.ndarray, total: np.ndarray, num: int, den: int) -> np.ndarray:
    """By how many tokens pairs of rows i and j may differ beyond what their sketches show; below 0 they can't link.

    ``total`` is the number of tokens of both.
    """
    out = np.zeros(len(i), np.int64)
    most = total - 2 * -(-num * total // (num + den))
    shapes, which = np.unique(one.words[i] << 32 | two.words[j], return_inverse=True)
    for shape_number, shape in enumerate(shapes.tolist()):
        rows, a, b = np.flatnonzero(which == shape_number), one.of[shape >> 32], two.of[shape & (1 << 32) - 1]
        words = min(a.shape[1], b.shape[1])
        step = max(1, (1 << 18) // max(a.shape[1], b.shape[1]))  # 2 MB of either side
        for k in range(0, len(rows), step):
            some = rows[k : k + step]
            apart = np.bitwise_count(folded(a[one.place[i[some]]], words) ^ folded(b[two.place[j[some]]], words)).sum(axis=1, dtype=np.int64)
            out[some] = most[some] - apart
    return out


def _placed(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    """``pairs`` with n and a column of both sets."""
    at = sets.select("id", "n", column)
    out = pairs.join(at.toDF("x", "nx", "sx"), "x")
    return out.join(at.toDF("y", "ny", "sy"), "y")


def sieve(pairs: DataFrame, reps: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (x, y) that sizes and sketches let link."""
    schema = pa.schema([("x", pa.int64()), ("y", pa.int64())])

    def run(batches):
        for batch in batches:
            total = batch.column("nx").to_numpy() + batch.column("ny").to_numpy()
            all_rows = np.arange(batch.num_rows)
            fits = near(Sketches(batch.column("sx").to_pylist()), all_rows, Sketches(batch.column("sy").to_pylist()), all_rows, total, num, den) >= 0
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y")], schema=schema).filter(pa.array(fits))

    fits = (F.col("nx") * den >= F.col("ny") * num) & (F.col("ny") * den >= F.col("nx") * num)
    return _placed(pairs, reps, "k").where(fits).mapInArrow(run, "x long, y long").distinct()


def verify(pairs: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (x, y) whose sets' common part is at least num / den of their union.

    Only texts of documents in ``pairs`` are read again; a set that several rows of a document hold is sent once.
    """
    sets_schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("f", pa.binary()), ("s", pa.binary())])

    def own_sets(batches):
        for batch in batches:
            for part in doc_slices(batch):
                sets = shingle_sets(part.column("text"), k)
                blobs = [s.tobytes() for s in sets]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(map(xxhash.xxh3_128_digest, blobs), pa.binary()), pa.array(blobs, pa.binary())], schema=sets_schema)

    schema = pa.schema([("x", pa.int64()), ("y", pa.int64())])

    def exact(batches):
        for batch in batches:
            keep = []
            for a, b in zip(*(batch.column(c).to_pylist() for c in ("sx", "sy"))):
                a, b = array(a, np.uint64), array(b, np.uint64)
                if len(a) > len(b):
                    a, b = b, a
                common = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) if len(a) else 0
                keep.append(den * common >= num * (len(a) + len(b) - common) and common > 0)
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y")], schema=schema).filter(pa.array(keep, pa.bool_()))

    ids = pairs.select(F.explode(F.array("x", "y")).alias("doc_id")).distinct()
    sets = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi").mapInArrow(own_sets, "id long, n long, f binary, s binary")
    sets = written(sets.where("n > 0").dropDuplicates(["id", "f"]), docs.sparkSession)
    out = written(_placed(pairs, sets, "s").mapInArrow(exact, "x long, y long").distinct(), docs.sparkSession)
    dropped(sets)
    return out


def forest(pairs: np.ndarray, one: np.ndarray, two: np.ndarray, margin: np.ndarray) -> np.ndarray:
    """Rows of ``pairs`` that join all components (``one`` and ``two`` of each pair) which the pairs join, those with the
    least margin first: each round every component takes its best pair to another."""
    names, ends = np.unique(np.concatenate([one, two]), return_inverse=True)
    label, chosen = np.arange(len(names)), []
    rows = np.lexsort((pairs[:, 1], pairs[:, 0], margin))
    a, b = ends[: len(one)], ends[len(one) :]
    while len(rows):
        la, lb = label[a[rows]], label[b[rows]]
        rows, la, lb = rows[la != lb], la[la != lb], lb[la != lb]
        if not len(rows):
            break
        both = np.column_stack([la, lb]).ravel()
        best = np.unique(np.unique(both, return_index=True)[1] // 2)
        for k in best.tolist():  # at most one for each component
            x, y = int(la[k]), int(lb[k])
            while label[x] != x:
                x = int(label[x])
            while label[y] != y:
                y = int(label[y])
            if x != y:
                label[max(x, y)] = min(x, y)
                chosen.append(rows[k])
        while (label[label] != label).any():
            label = label[label]
    return np.array(chosen, np.int64)


def within_groups(groups: DataFrame, linked: DataFrame, reps: DataFrame, num: int, den: int, every: bool) -> DataFrame:
    """x, y: pairs of a group that sizes and sketches let link and whose components in ``linked`` differ; ``every`` such
    pair, or those of a spanning forest in each task.

    A group is cut into blocks of about ``BLOCK`` members, whose pairs are units; a task gets some units' sketches.
    """
    spark = groups.sparkSession
    labels = components(linked.select(F.col("x").alias("a"), F.col("y").alias("b")))
    named = written(groups.join(labels.withColumnRenamed("id", "x"), "x", "left").select("g", "x", F.coalesce("component", "x").alias("c")), spark)
    mixed = named.groupBy("g").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).where("c0 <> c1").select("g", "blocks")
    rows = named.join(mixed, "g").withColumn("block", F.pmod(F.xxhash64("x"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select(F.xxhash64("g", F.least("block", "other"), F.greatest("block", "other")).alias("unit"), F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1).alias("side"), F.col("x").alias("id"), "c")
    tasks = max(partitions(spark), -(-named.count() // TASK_ROWS))
    rows = rows.join(reps.select("id", "n", "k"), "id").withColumn("task", F.pmod("unit", F.lit(tasks)))
    schema = pa.schema([("x", pa.int64()), ("y", pa.int64())])

    def run(key, got):
        got = got.take(pc.sort_indices(got, sort_keys=[("unit", "ascending"), ("side", "ascending"), ("id", "ascending")]))
        unit, side, ids, comp, n = (got.column(c).to_numpy() for c in ("unit", "side", "id", "c", "n"))
        sketches, waiting, have = Sketches(got.column("k").to_pylist()), [], 0
        found, ends, margins = np.empty((0, 2), np.int64), np.empty((0, 2), np.int64), np.empty(0)

        def settle():
            nonlocal found, ends, margins
            i, j = (np.concatenate(c) for c in zip(*waiting))
            fits = (comp[i] != comp[j]) & (n[i] * den >= n[j] * num) & (n[j] * den >= n[i] * num)
            i, j = i[fits], j[fits]
            low, high = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
            order = np.lexsort((high, low))
            fresh = np.append(True, (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])) if len(order) else np.empty(0, bool)
            rows = order[fresh]
            i, j = i[rows], j[rows]
            spare = near(sketches, i, sketches, j, n[i] + n[j], num, den)
            fit = spare >= 0
            rows, i, j = rows[fit], i[fit], j[fit]
            found = np.concatenate([found, np.column_stack([low[rows], high[rows]])])
            ends = np.concatenate([ends, np.column_stack([comp[i], comp[j]])])
            margins = np.concatenate([margins, -spare[fit] / (n[i] + n[j])])
            if not every and len(found):
                stay = forest(found, ends[:, 0], ends[:, 1], margins)
                found, ends, margins = found[stay], ends[stay], margins[stay]

        heads = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
        for a, b in zip(heads.tolist(), np.append(heads[1:], len(unit)).tolist()):
            own = np.arange(a, b)
            if side[a] == 2:
                i, j = np.triu_indices(b - a, 1)
                i, j = own[i], own[j]
            else:
                i, j = (x.ravel() for x in np.meshgrid(own[side[a:b] == 0], own[side[a:b] == 1], indexing="ij"))
            waiting.append((i, j))
            have += len(i)
            if have > TOGETHER:
                settle()
                waiting, have = [], 0
        if waiting:
            settle()
        pairs = np.unique(found, axis=0)
        return pa.table([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=schema)

    out = written(rows.groupBy("task").applyInArrow(run, "x long, y long").distinct(), spark)
    dropped(named)
    return out


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).where("x < y").distinct()


def links(docs: DataFrame, digests: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """a, b: links between representatives (least doc_id of equal sets) that join all that are linked at all."""
    spark = docs.sparkSession
    reps = written(digests.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("id"), F.first("k").alias("k")), spark)
    edges = [b for b in bands(int(reps.agg(F.max("n")).first()[0] or 0), num, den)]
    lows = [low for low, _ in edges]
    if not lows:
        return reps.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    band = F.size(F.filter(F.array(*(F.lit(x) for x in lows)), lambda x: x <= F.col("n"))) - 1
    sizes = {r["band"]: r["count"] for r in reps.groupBy(band.alias("band")).count().collect()}  # a row for each band
    schemes = [Scheme(i, lo, hi, sizes.get(i, 0) + sizes.get(i - 1, 0), num, den) for i, (lo, hi) in enumerate(edges)]
    chunks = Chunks(docs.select("doc_id", "text"))
    n, low = chunks.n, np.array(lows)

    def signatures(sets: list[np.ndarray], numbers: np.ndarray):
        lengths = np.array([len(s) for s in sets])
        of = np.searchsorted(low, lengths, side="right") - 1
        for scheme in schemes:
            rows = np.flatnonzero((of == scheme.number) | (of == scheme.number - 1))
            if scheme.differ >= 1 and len(rows):
                sig, own, kind = scheme.signatures(np.concatenate([sets[i] for i in rows]), np.repeat(np.arange(len(rows)), lengths[rows]), len(rows))
                yield sig, numbers[rows][own], kind, lengths[rows][own].astype(np.uint32)

    def send(docs: pa.Table, answers: list[dict]):
        numbers = ids_of(docs)
        docs = docs.filter(pa.array(np.isin(numbers, [a["id"] for a in answers])))
        parts = []
        for batch in docs.to_batches():
            for part in doc_slices(batch):
                sets = shingle_sets(part.column("text"), k)
                full = [i for i, s in enumerate(sets) if len(s)]
                if full:
                    parts += signatures([sets[i] for i in full], ids_of(part)[full])
        if not parts:
            return []
        sig, doc, kind, size = map(np.concatenate, zip(*parts))
        return [[b, sig[rows], doc[rows], kind[rows], size[rows][kind[rows] > 0]] for b, rows in split_by((sig % np.uint64(n)).astype(np.int64), n)]

    at_chunks = reps.select("id", chunks.place(F.col("id")).alias("chunk")).distinct().repartition(n, "chunk")
    found = written(candidate_groups(chunks.send_after(at_chunks, send), n, num, den), spark)
    groups = written(found.where("g IS NOT NULL").select("g", "x").distinct(), spark)
    hub = groups.groupBy("g").agg(F.min("x").alias("y"))
    tested = _ordered(groups.join(hub, "g").select("x", "y").unionByName(found.where("g IS NULL").select("x", "y")))
    likely = written(sieve(tested, reps, num, den), spark)
    dropped(found)
    linked = verify(likely, docs, k, num, den)
    for every in (False, True):
        rest = within_groups(groups, linked, reps, num, den, every)
        if not rest.isEmpty():
            linked = linked.unionByName(verify(rest, docs, k, num, den))
        dropped(rest)
    dropped(likely, groups, reps)
    return linked.select(F.col("x").alias("a"), F.col("y").alias("b"))


def _classes(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    digests = written(set_digests(docs, k), docs.sparkSession)
    labels = components(links(docs, digests, k, num, den))
    reps = written(digests.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), docs.sparkSession)
    out = joined_back(digests.drop("k"), reps, ["n", "f1", "f2"], "copies").select("doc_id", "key", "n", F.when(F.col("n") > 0, F.coalesce("rep", "doc_id")).otherwise(F.col("doc_id")).alias("rep"))
    out = out.join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    return out.select("doc_id", "key", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component", "rep")).otherwise(F.col("doc_id")).alias("component_id"))


def classes(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of ``docs`` (doc_id, text).

    Rows are linked when num / den of the union of their sets of k-word shingles is common, and copies always.
    """
    return _classes(docs, k, num, den).drop("key")


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one document of each class, that with the least doc_id, and all rows without shingles.

    Rows that share that doc_id stay as its parts, equal ones once.
    """
    spark, own = docs.sparkSession, "__key"
    rows = written(_classes(docs, k, num, den).where("n_shingles > 0").groupBy("doc_id", "key", "component_id").agg(F.count(F.lit(1)).alias("n")), spark)
    out = docs.withColumn(own, F.xxhash64("text"))
    same = lambda keys: out["doc_id"].eqNullSafe(keys["doc_id"]) & (out[own] == keys["key"])
    gone = rows.where("component_id IS NOT NULL AND NOT component_id <=> doc_id").select("doc_id", "key").distinct()
    kept = out.join(gone, same(gone), "left_anti")
    twins = rows.where("component_id = doc_id AND n > 1").select("doc_id", "key")
    if not twins.isEmpty():
        once = kept.join(twins, same(twins), "left_semi").dropDuplicates(["doc_id", own])
        kept = kept.join(twins, same(twins), "left_anti").unionByName(once)
    return kept.drop(own)
