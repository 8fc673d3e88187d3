"""Manifest, ranked search and near vectors against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import ODD, WORDS, documents
from pyspark.sql import functions as F

from pulsemill.llm import merkle, neardup, queries, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# -- 11 --------------------------------------------------------------------------------


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def brute_tree(nodes, fanout):
    """The root, and for each node the (before, after) of each level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, place in enumerate(at):
            run = place - place % fanout
            paths[i].append(("".join(nodes[run:place]), "".join(nodes[place + 1 : run + fanout])))
            at[i] = place // fanout
        nodes = [sha("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]
    return nodes[0], paths


def brute_manifest(given, fanout):
    """given: (key, group, leaf)."""
    groups = defaultdict(list)
    for key, group, leaf in given:
        groups[group].append((key is not None, key or 0, leaf, key))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort()
        trees[name] = brute_tree([x[2] for x in groups[name]], fanout)
    root, over = brute_tree([trees[n][0] for n in names], fanout)
    return [
        (x[3], n, x[2], trees[n][0], root, own + above)
        for n, above in zip(names, over) for x, own in zip(groups[n], trees[n][1])
    ]


@pytest.mark.parametrize("fanout", [2, 3, 5, 16, 20])
def test_manifest_is_that_of_a_plain_tree(spark, fanout):
    counts = {"a": 1, "b": 2, "ä": 16, "c": 17, None: 33, "": 70, "d": 257}
    given = [(i if i % 50 else None, g, f"t{i % 11}é" if i % 7 else None) for g, n in counts.items() for i in range(n)]
    df = spark.createDataFrame(given, "key long, grp string, text string").repartition(7)
    out = merkle.manifest(df, "key", "grp", ("key", "grp", "text"), fanout)
    got = [(*r[:5], [tuple(x) for x in r[5]]) for r in out.collect()]
    want = brute_manifest([(k, g, brute_leaf((k, g, t))) for k, g, t in given], fanout)
    assert Counter(map(repr, got)) == Counter(map(repr, want))
    folded = out.select(merkle.fold(F.col("leaf"), F.col("path")).alias("x"), "root").distinct().collect()
    assert [r["x"] for r in folded] == [r["root"] for r in folded] and len(folded) == 1


def test_manifest_of_odd_rows(spark, odd, nothing):
    out = merkle.manifest(odd, keep={"path_length": F.length("text")})
    given = [(i, "en", brute_leaf((i, s, "en", None, t))) for i, t, s in ODD]
    assert [r[:5] for r in rows(out, *out.columns)] == sorted([x[:5] for x in brute_manifest(given, 2)], key=repr)
    assert merkle.manifest(nothing).collect() == []
    single = spark.createDataFrame([(1, "x", "a"), (2, "y", None)], "doc_id long, text string, lang string")
    got = merkle.manifest(single, fields=("doc_id", "text"))
    assert [len(r["path"]) for r in got.collect()] == [1, 1]
    alone = merkle.manifest(single.where("doc_id = 1"), fields=("doc_id", "text")).first()
    assert alone["leaf"] == alone["subroot"] == alone["root"] == brute_leaf((1, "x")) and alone["path"] == []
    with pytest.raises(ValueError):
        merkle.manifest(odd, fanout=1)


def test_groups_of_single_rows(spark):
    df = spark.range(40).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("lang"))
    out = merkle.manifest(df, fields=("doc_id",))
    want = brute_manifest([(i, str(i), brute_leaf((i,))) for i in range(40)], 2)
    assert sorted((*r[:5], [tuple(x) for x in r[5]]) for r in out.collect()) == sorted(want)


def test_every_tampered_row_is_found(spark, table):
    from conftest import SF

    for r in queries.op11_merkle(spark, SF).collect():
        assert r["verified"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 != 0)


# -- 12 --------------------------------------------------------------------------------


def brute_search(docs, items, k):
    terms = [(i, TERM.findall((t or "").translate(LOW))) for i, t in docs]
    terms = [(i, Counter(t), len(t)) for i, t in terms if t]
    big_n, big_l = len(terms), sum(n for _, _, n in terms)
    df = Counter(t for _, c, _ in terms for t in c)
    out = []
    for item, text in items:
        own, scores = set(TERM.findall((text or "").translate(LOW))), []
        for i, c, n in terms:
            m = 50 + 50 * n * big_n // big_l
            score = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in own if t in c)
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def some_texts(n, seed=3):
    draw = np.random.default_rng(seed)
    for _ in range(n):
        size = int(draw.integers(0, 60))
        yield " ".join(WORDS[int(x)] for x in draw.zipf(1.3, size) % 60)


@pytest.mark.parametrize("piece", [40, 1 << 20])
def test_search_is_that_of_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(search, "PIECE", piece)
    monkeypatch.setattr(search, "BLOCK_TERMS", 50)
    texts = list(some_texts(700))
    given = [(i % 640, t) for i, t in enumerate(texts)]  # some ids twice
    asked = [(i % 18, t) for i, t in enumerate(some_texts(20, 9))] + [(99, None), (100, "unheard-of W1é1"), (None, texts[5])]
    docs = spark.createDataFrame(given, "doc_id long, text string").repartition(3)
    items = spark.createDataFrame(asked, "item_id int, text string")
    for k in (1, 7, 50):
        got = search.search(docs, items, k)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert rows(got, *got.columns) == brute_search(given, asked, k)


def test_search_in_odd_and_empty_tables(spark, odd, nothing):
    asked = [(1, WORDS[0] + " same ONE"), (1, WORDS[0] + " same ONE"), (2, ""), (3, None), (4, "a5 a6 a119999")]
    items = spark.createDataFrame(asked, "item_id long, text string")
    assert rows(search.search(odd, items), "item_id", "rank", "doc_id", "score") == brute_search([(i, t) for i, t, _ in ODD], asked, 50)
    assert search.search(nothing, items).collect() == []
    assert search.search(odd, items.limit(0)).collect() == []


def test_accumulators_stop_but_lose_nothing():
    draw = np.random.default_rng(5)
    stopped = 0
    for _ in range(300):
        size, k = int(draw.integers(1, 200)), int(draw.integers(1, 12))
        postings, total = [], np.zeros(size, np.int64)
        for share in np.sort(draw.random(int(draw.integers(1, 8)))):
            doc = np.flatnonzero(draw.random(size) < share)
            gain = draw.integers(0, max(2, int(100 * (1 - share) ** 3)), len(doc))
            total[doc] += gain
            postings.append((doc, gain, int(gain.max(initial=0))))
        floor = int(draw.integers(0, 60))
        who, score = search.accumulate(postings, size, k, floor)
        assert (total[who] == score).all() and (score > 0).all()
        want = [i for i in range(size) if total[i] >= max(floor, 1) and total[i] >= np.sort(total)[::-1][min(k, size) - 1]]
        assert set(want) <= set(who.tolist())
        stopped += len(who) < (total > 0).sum()
    assert stopped > 100


# -- 13 --------------------------------------------------------------------------------


def brute_vectors(given, least):
    """given: (vec_id, vector, label)."""
    fine = [
        lab is not None and v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)
        for _, v, lab in given
    ]
    units = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if ok else None for (_, v, _), ok in zip(given, fine)]
    links = defaultdict(set)
    for i in range(len(given)):
        for j in range(i):
            if fine[i] and fine[j] and given[i][2] == given[j][2] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= least:
                links[i].add(j)
                links[j].add(i)
    out = []
    for i, (vec, _, _) in enumerate(given):
        seen, todo = {i}, [i]
        while todo:
            todo += (new := links[todo.pop()] - seen)
            seen |= new
        named = [given[j][0] for j in seen if given[j][0] is not None]
        low = min(named) if named else None
        out.append((vec, len(links[i]), low, vec == low))
    return sorted(out, key=repr)


def vectors(draw, d, n):
    """Groups of near copies at many angles, lone vectors, and exact copies."""
    out = []
    for g in range(n):
        base = draw.normal(size=d)
        base /= np.linalg.norm(base)
        for _ in range(1 + (g % 3) * (g % 7)):
            noise = draw.normal(size=d)
            out.append(((base + noise / np.linalg.norm(noise) * draw.uniform(0, 0.2)) * draw.uniform(0.5, 2)).astype(np.float32).tolist())
    return out + out[:10]


@pytest.mark.parametrize("block", [4, 512])
def test_near_vectors_are_those_of_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    draw = np.random.default_rng(2)
    given = [(i, v, i % 2 if i % 40 else None) for i, v in enumerate(x for x in vectors(draw, 48, 60) for _ in range(2))]
    df = spark.createDataFrame(given, "vec_id long, embedding array<float>, label int").repartition(5)
    got = neardup.near_duplicates(df, tables=6, probes=8)  # none is missed
    assert got.dtypes == [("vec_id", "bigint"), ("n_links", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]
    assert rows(got, *got.columns) == brute_vectors(given, 0.98)


def test_odd_vectors(spark):
    one, two = [1.0, 2.0, 3.0], [3.0, -2.0, 1.0]
    given = [
        (5, one, 1), (5, one, 1), (4, [x * 2 for x in one], 1), (6, one, 2), (7, one, None), (None, one, 1), (8, None, 1), (9, [], 1),
        (10, [0.0, 0.0, 0.0], 1), (11, [1.0, None, 3.0], 1), (12, [1.0, float("nan"), 3.0], 1), (13, [1.0, float("inf"), 3.0], 1),
        (None, two, 1), (14, [1e300, 2e300, 3e300], 1), (15, [1e-300, 2e-300, 3e-300], 1), (16, [1.0, 2.0], 1), (17, [5.0], 3), (18, [4.0], 3), (19, [-4.0], 3),
    ]
    df = spark.createDataFrame([(*x, "n", 1) for x in given], "vec_id long, embedding array<double>, label int, node string, n_links int")
    want = [(v, [x / 1e300 for x in e] if v == 14 else [x * 1e300 for x in e] if v == 15 else e, lab) for v, e, lab in given]
    got = neardup.near_duplicates(df, tables=6, probes=8)  # none is missed
    assert rows(got, *got.columns) == brute_vectors(want, 0.98)
    assert neardup.near_duplicates(df.limit(0)).collect() == []


@pytest.mark.parametrize("d", [64, 300])
def test_recall_at_the_threshold(d):
    draw = np.random.default_rng(d)
    x, noise = draw.normal(size=(2, 4000, d))
    x = neardup.unit(x)
    noise = neardup.unit(noise - (noise * x).sum(1, keepdims=True) * x)
    y = 0.981 * x + math.sqrt(1 - 0.981**2) * noise
    a, b = (neardup.cells_of(v, neardup.TABLES, neardup.PROBES, 11) for v in (x, y))
    assert (a[:, :, None] == b[:, None, :]).any((1, 2)).mean() > 0.97


def test_recall_is_measured(spark):
    draw = np.random.default_rng(4)
    given = [(i, v, 1) for i, v in enumerate(vectors(draw, 32, 80))]
    df = spark.createDataFrame([*given, (None, None, None), (1000, [float("nan")], 1)], "vec_id long, embedding array<float>, label int")
    assert neardup.recall(df, one_in=3) > 0.97
    assert neardup.recall(df, tables=1, probes=1, one_in=3) < 0.97


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(1).normal(size=(5, 16))
    y = neardup.hadamard(x)
    assert np.allclose((y * y).sum(1), (x * x).sum(1)) and np.allclose(neardup.hadamard(y), x)
