"""URL automaton, cover tree, site quality, and the pipeline's stages."""

import random

import brute
import numpy as np

from voxlake.llm import cover_tree, partition_join, queries, site_quality, url_automaton


def judge(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, path = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    fits = [r for r in queries.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    bad = not host or any(g.strip("*") in host for g in queries.BLOCKED_HOSTS)
    return host, path, best and best.text, best.verdict if best else "block" if bad else "allow"


def test_urls(spark):
    rng = random.Random(5)
    urls = [None, "", "no scheme", "://", "http://", "https://A.Net", "https://A.Net/", "http://example.net/en/x", "http://xexample.net/en/", "http://a.com/x.net/", "x://y://org/fr/", "http://ex.org/fr/?q#f", "http://é.net/ü", "http://a.net\x00/"]
    urls += ["http://" + ".".join(rng.choice(("example", "net", "org", "com", "Casino7", "www")) for _ in range(rng.randint(1, 4))) + rng.choice(("", "/", "/en/", "/de/a", "/fr/", "?x", "#y")) for _ in range(300)]
    rows = [(i, u, "allow", "x") for i, u in enumerate(urls)] + [(0, urls[0], "allow", "x")]
    got = url_automaton.judge(spark.createDataFrame(rows, "page_id long, url string, verdict string, host string"), queries.RULES, queries.BLOCKED_HOSTS).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == judge(urls[r.page_id])


def test_urls_of_no_table_and_single_bytes(spark):
    assert not url_automaton.judge(spark.createDataFrame([], "page_id long, url string"), queries.RULES, queries.BLOCKED_HOSTS).collect()
    pages = spark.createDataFrame([(None, "http://ab/c"), (1, "http://a/b"), (1, "http://a/b")], "page_id long, url string")
    got = url_automaton.judge(pages, [], ["a?"]).collect()
    assert sorted((r.page_id or -1, r.verdict) for r in got) == [(-1, "block"), (1, "allow"), (1, "allow")]


def test_automaton_over_many_words():
    rng = random.Random(6)
    patterns = [[rng.choice([97, 98, url_automaton.PATH_STAR, url_automaton.ANY]) for _ in range(rng.randint(1, 9))] for _ in range(40)]
    import re

    exprs = [re.compile(b"".join({257: b".*", 258: b"."}.get(s) or bytes([s]) for s in p), re.S) for p in patterns]
    texts = [bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 12))) for _ in range(300)]
    got = url_automaton.ShiftAnd(patterns).run(texts)
    assert got.tolist() == [[bool(e.fullmatch(t)) for e in exprs] for t in texts]


def test_cover_tree(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(700, 8))
    x[100:300] = x[0] + rng.normal(0, 0.12, (200, 8)) * np.abs(x[0]).max()
    x[300:400] = x[1]
    x[400:450] = x[2] * rng.uniform(0.5, 3, (50, 1))
    listed = [v.tolist() for v in x] + [None, [0.0] * 8, [float("nan")] + [1.0] * 7, [float("inf")] * 8, [None] + [1.0] * 7, [1.0, 2.0], [1.0, 2.1], [1e-200] * 8, []]
    rows = [(i, v, i % 3, "k") for i, v in enumerate(listed)] + [(3, listed[3], 0, "k")]
    got = {r.vec_id: r for r in cover_tree.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, id int, v string"), 0.9).collect()}
    unit = [None if v is None or not v or None in v or not np.isfinite(v).all() or not any(v) else cover_tree.unit(np.array([v]))[0] for _, v, *_ in rows]
    forest, links = brute.Forest(i for i, *_ in rows), [0] * len(rows)
    for i, a in enumerate(unit):
        for j, b in enumerate(unit[:i]):
            if a is not None and b is not None and len(a) == len(b) and a @ b >= 0.9:
                links[i] += 1
                links[j] += 1
                forest.join(rows[i][0], rows[j][0])
    for (i, *_), n in zip(rows, links):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (n, forest.find(i), forest.find(i) == i)
    assert not cover_tree.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>")).collect()


def test_cover_tree_float_tables(spark):
    import pyarrow.parquet as pq

    t = pq.read_table("/root/testdata/sf0.001/embeddings.parquet")
    x = cover_tree.unit(np.array(t["embedding"].to_pylist(), float))
    links = (x @ x.T >= 0.9).sum(axis=1) - 1
    got = {r.vec_id: r.n_links for r in queries.op7_cover_tree(spark, "/root/testdata/sf0.001").collect()}
    assert got == dict(zip(t["vec_id"].to_pylist(), links.tolist()))
    rows = [(None, [1.0, 2.0]), (None, [1.0, 2.0]), (4, [2.0, 4.0]), (4, [1.0, -9.0])]
    out = cover_tree.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(out) == 4 and all(r.kept is None for r in out if r.vec_id is None)


def test_cover_tree_ids_of_all_kinds(spark):
    """Null, repeated and shared ids among linked vectors, against all pairs."""
    rng = np.random.default_rng(12)
    base = rng.normal(size=(12, 6))
    x = np.concatenate([base[k] + rng.normal(0, 0.02, (n, 6)) for k, n in enumerate([1, 2, 5, 9, 3, 1, 1, 4, 2, 6, 7, 2])])
    x[5] = x[4]
    ids = [None if rng.random() < 0.3 else int(rng.integers(0, 30)) for _ in x]
    ids[-2:] = [None, None]  # a component without an id
    u = cover_tree.unit(x)
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    forest = brute.Forest(range(len(x)))
    for a, b in np.argwhere(link):
        forest.join(int(a), int(b))
    least = {}
    for k, i in enumerate(ids):
        least.setdefault(forest.find(k), []).append(i)
    want = []
    for k, i in enumerate(ids):
        c = min((j for j in least[forest.find(k)] if j is not None), default=None)
        want.append((i, int(link[k].sum()), c, None if i is None or c is None else i == c))
    for shift in (0, 10**12):  # ids don't have to be small
        moved = [(None if i is None else i + shift, v.tolist()) for i, v in zip(ids, x)]
        got = cover_tree.near_duplicates(spark.createDataFrame([*moved, (None, [0.0] * 6)], "vec_id long, embedding array<double>")).collect()
        back = [(None if r.vec_id is None else r.vec_id - shift, r.n_links, None if r.component_id is None else r.component_id - shift, r.kept) for r in got]
        assert sorted(back, key=str) == sorted([*want, (None, 0, None, None)], key=str)


def test_cover_tree_prunes(spark):
    """Vectors of few dimensions in tight groups: nearly all pairs go by radii, whole nodes or tiles."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(60, 4))
    x = cover_tree.unit(np.repeat(centres, 40, axis=0) + rng.normal(0, 0.01, (2400, 4)))
    tree, order = cover_tree.Tree.plant(x)
    x = x[order]
    assert (tree.radius >= [cover_tree.distances(x[a:b], x[a : a + 1]).max() - 1e-7 for a, b in zip(tree.low, tree.high)]).all()
    joined = cover_tree.Joined(np.ones(2400, np.int64), 0.9)
    joined.descend(x, tree, tree, 0)
    assert joined.counts.tolist() == ((x @ x.T >= 0.9).sum(axis=1) - 1).tolist()
    assert joined.measured + joined.compared < 0.25 * 2400 * 2399 / 2


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.1"
    from pyspark.sql import functions as F

    from voxlake.llm.common import table

    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    fold = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2))
    judged = site_quality.classify(docs, labels.where(fold == 0), F.col("source"), F.col("lang")).join(labels.where(fold == 1), "doc_id").toPandas()
    clean = judged[(judged.quality == 1) & (judged.toxic == 0)]
    assert clean.kept.mean() > 0.98
    assert judged[judged.quality == 0].kept.mean() < 0.1 and judged[judged.toxic == 1].kept.mean() < 0.2


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, None, "en"), (1, None, None, "en"), (2, "", "s", None), (3, "fine text here", "s", "en"), (None, "x", "s", "en")], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(3, 1, 0), (9, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    from pyspark.sql import functions as F

    out = site_quality.classify(docs, labels, F.col("source"), F.col("lang")).collect()
    assert len(out) == 5 and all(0 < r.p_good < 1 and 0 < r.p_toxic < 1 for r in out)
    assert not site_quality.classify(docs.limit(0), labels, F.col("source"), F.col("lang")).collect()


def test_strength_shrinks_sparse_sites(spark):
    rows = [("big", "a", 1.0)] * 200 + [("bad", "a", -3.0)] * 200 + [("tiny", "a", -3.0)] + [(f"s{i}", "a", 1.0 + i % 3) for i in range(30)] * 3
    shifts = {r.site: r.good_shift for r in site_quality.combine(spark.createDataFrame(rows, "site string, path string, good double"), "good").collect()}
    assert shifts["bad"] < shifts["tiny"] < 0 < shifts["big"]


def shifts(keys, log_odds):
    """(site, path) to the shift of log odds, in numpy: sums, moments, shrinkage of sites and then of paths."""
    p = 1 / (1 + np.exp(-np.array(log_odds)))
    prior = p.mean()
    logit = lambda x: np.log(x / (1 - x))

    def shrink(groups, above):
        n, mean = (np.array([f(p[rows]) for rows in groups.values()]) for f in (len, np.mean))
        level = np.array([above(k) for k in groups])
        k = site_quality.STRONGEST
        if n.sum() > len(n) >= 2:
            within = sum(((p[r] - p[r].mean()) ** 2).sum() for r in groups.values()) / (n.sum() - len(n))
            spread = n.sum() - (n**2).sum() / n.sum()
            between = max(0.0, ((n * (mean - level) ** 2).sum() - (len(n) - 1) * within) / spread)
            k = min(k, within / between) if between > 0 else k
        return dict(zip(groups, (n * mean + k * level) / (n + k)))

    def grouped(keys):
        return {k: np.array([i for i, x in enumerate(keys) if x == k]) for k in dict.fromkeys(keys)}

    sites = shrink(grouped([k[0] for k in keys]), lambda k: prior)
    return {k: logit(v) - logit(prior) for k, v in shrink(grouped(keys), lambda k: sites[k[0]]).items()}


def test_combination_is_empirical_bayes(spark):
    rng = np.random.default_rng(3)
    rows = [(f"s{rng.integers(12)}" if rng.random() > 0.1 else None, f"p{rng.integers(4)}" if rng.random() > 0.1 else None, float(rng.normal())) for _ in range(900)]
    rows += [("alone", "p", 2.0), ("alone", "q", -2.0)]
    got = {(r.site, r.path): r.good_shift for r in site_quality.combine(spark.createDataFrame(rows, "site string, path string, good double"), "good").collect()}
    want = shifts([r[:2] for r in rows], [g for *_, g in rows])
    assert set(got) == set(want) and all(abs(got[k] - v) < 1e-9 for k, v in want.items())


def test_site_quality_query_is_its_plain_version(spark):
    """Every row of the query again: scores of whole texts by the fitted model, then the combination in numpy."""
    from voxlake.llm.common import table

    d = "/root/testdata/sf0.001"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    model, rows = site_quality.fit(docs, labels), docs.collect()
    scores = [model.score(r.text) for r in rows]
    good, toxic = (shifts([(r.source, r.lang) for r in rows], [s[k] for s in scores]) for k in (0, 1))
    got = {r.doc_id: r for r in queries.op4_site_quality(spark, d).collect()}
    assert len(got) == len(rows)
    for r, (g, t) in zip(rows, scores):
        p_good, p_toxic = (1 / (1 + np.exp(-(x + by[r.source, r.lang]))) for x, by in ((g, good), (t, toxic)))
        assert abs(got[r.doc_id].p_good - p_good) < 1e-9 and abs(got[r.doc_id].p_toxic - p_toxic) < 1e-9
        assert got[r.doc_id].kept == (p_good >= 0.5 and p_toxic <= 0.5)


ODD = "doc_id long, text string, lang string, source string, n_chars long, chunk string, id int, key string, cell int"


def odd_docs(spark, rows):
    return spark.createDataFrame([(d, t, *more, None if t is None else len(t), "c", 1, "k", None) for d, t, *more in rows], ODD)


def test_stages_on_odd_tables(spark):
    """Nulls in any column, empty and repeated rows, shared doc_ids, clashing names, and no rows at all."""
    import corpus_pipeline as cp

    d = "/root/testdata/sf0.001"
    good = [r.text for r in cp.table(spark, d, "documents").join(cp.table(spark, d, "labels").where("quality = 1 AND toxic = 0"), "doc_id").orderBy("doc_id").limit(6).collect()]
    rows = [(i, t, "en", "s") for i, t in enumerate(good)] + [(0, good[0], "en", "s"), (None, good[1], None, None), (None, None, None, None), (9, "", "en", "s"), (9, None, "en", "s"), (3, good[2], "en", "s"), (10, good[4] + " tail", None, "s")]
    docs = odd_docs(spark, rows)
    for name, stage in cp.STAGES:
        nxt = cp.written(stage(spark, docs, d), spark)
        out = nxt.collect()
        if name == "quality_classifier":
            assert len(out) == len(rows)
        if name == "exact_dedup":
            keys = [r.text.lower() if r.text else "" for r in out]
            assert len(set(keys)) == len(keys) == len({(t or "").lower() for _, t, *_ in rows})
        if name == "ngram_jaccard":
            assert sorted((r.doc_id, r.text or "") for r in out if r.text) == sorted((r.doc_id, r.text or "") for r in before if r.text and r.doc_id != 10)
        if name != "best_fit_packing":
            assert nxt.columns == docs.columns
            docs, before = nxt, out
        else:
            assert {r.doc_id for r in out} == {r.doc_id for r in before}
    docs = odd_docs(spark, [])
    for name, stage in cp.STAGES:
        out = cp.written(stage(spark, docs, d), spark)
        assert out.isEmpty(), name
        docs = out if name != "best_fit_packing" else docs


def test_rows_are_judged_and_kept_each(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = odd_docs(spark, [(1, text, "en", "s"), (1, text, "en", "s"), (1, "other words that are long enough here", "en", "s"), (None, text.upper(), "en", "s"), (2, text + " x", "en", "s"), (3, None, "en", "s"), (3, "", "en", "s"), (None, "some words of its own in a row", "en", "s")])
    out = partition_join.keep_one(docs, 5, 80, 100).collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in out if r.doc_id != 1) == [(-1, "some words of its own in a row"), (3, ""), (3, "")]
    assert sorted(r.text for r in out if r.doc_id == 1) == sorted([text, "other words that are long enough here"])
    judged = site_quality.classify
    site_quality.classify = lambda *a, key, **o: a[0].select("doc_id", key, (a[0]["text"] == text).alias("bad")).selectExpr("doc_id", key, "NOT coalesce(bad, false) AS kept")
    try:
        left = site_quality.keep_good(docs, None).collect()
    finally:
        site_quality.classify = judged
    assert len(left) == 6 and all(r.text != text for r in left)


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    d = "/root/testdata/sf0.001"
    docs = cp.table(spark, d, "documents")
    before = docs.columns
    for name, stage in cp.STAGES[:4]:
        nxt = cp.written(stage(spark, docs, d), spark)
        assert nxt.columns == before, name
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        got = {r.doc_id: r.text for r in nxt.select("doc_id", "text").collect()}
        if name == "exact_dedup":
            assert set(got) == {k for _, k, *_ in brute.exact(rows)}
        if name == "ngram_jaccard":
            assert set(got) == {i for i, n, c in brute.jaccard(rows, 5, 80, 100) if i == c}
        if name == "substring_dedup":
            want = {i: n - g for i, n, g, _ in brute.word_runs(rows, 50)}
            assert {i: len(brute.raw(t).split()) for i, t in got.items()} == want
        docs = nxt
    # pieces, their ids and their places, from the library
    import zlib

    from tokenizers import Tokenizer

    tok, want = Tokenizer.from_file(cp.WORD_BPE), {}
    for r in docs.collect():
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 1]
        want |= {(r.doc_id, k): (at, len(ids[at : at + 4096]), zlib.crc32(np.array(ids[at : at + 4096], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 4096))}
    out = cp.written(cp.STAGES[4][1](spark, docs, d), spark).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in out} == want and len(out) == len(want)
    places = {}
    for r in sorted(out, key=lambda r: r.offset):
        assert places.get(r.sequence_id, 0) == r.offset
        places[r.sequence_id] = r.offset + r.length
    assert max(places.values()) <= 4096
