"""Decontamination, similarity join, substring dedup, mixing, quality and toxicity against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import ODD, documents

from pulsemill.llm import decontam, graph, jaccard, mixing, quality, substrings, toxicity
from pulsemill.llm import words as W

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def texts(given):
    return [t for _, t, _ in given]


# -- words -----------------------------------------------------------------------------


@pytest.mark.parametrize("size", [50, 1 << 20])
def test_words_are_those_of_the_pattern(size):
    given = [*texts(ODD), "A-b C\x00d é1\x7f", "x" * 300]
    batch = pa.RecordBatch.from_arrays([pa.array(given, pa.string())], ["text"])
    seen = []
    for part in W.slices(iter([batch]), "text", size):
        w = W.find(part.column("text"), W.ALNUM, W.LOWER)
        low = W.LOWER[w.data].tobytes()
        seen += [[low[w.start[j] : w.end[j]].decode() for j in range(a, b)] for a, b in zip(w.first, w.first[1:])]
    assert seen == [ALNUM.findall((t or "").translate(LOW)) for t in given]


def test_equal_words_have_equal_hashes_wherever_they_stand():
    w = W.find(pa.array(["b aa b", "", "aa  b ab"]))
    names = [w.word(i) for i in range(len(w.start))]
    assert len(set(zip(names, w.hash.tolist()))) == len(set(names)) == len(set(w.hash.tolist()))
    grams, valid = W.grams(w, 2)
    assert valid.tolist() == [True, True, False, True, True]
    assert grams[1] != grams[0] and grams[3] == grams[1]  # "aa b" twice


# -- 3 ---------------------------------------------------------------------------------


def brute_overlaps(docs, items, n=10):
    windows = defaultdict(set)
    for item, t in items:
        w = ALNUM.findall((t or "").translate(LOW))
        for i in range(max(1, len(w) - n + 1)) if w else ():
            windows[tuple(w[i : i + n])].add(item)
    out = []
    for doc, t in docs:
        w = ALNUM.findall((t or "").translate(LOW))
        hit, met = set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if (found := windows.get(tuple(w[i : i + size]))) is not None:
                    hit |= set(range(i, i + size))
                    met |= found
        out.append((doc, len(w), len(hit), sorted(str(x) for x in met if x is not None)))
    return sorted(out, key=repr)


def check_overlaps(spark, docs, items):
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, words string")
    got = decontam.overlaps(docs, bench)
    given = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert rows(got, "doc_id", "n_words", "n_hit", "items") == brute_overlaps(given, items)
    return got


def test_overlaps_of_odd_rows(spark, odd, nothing):
    own = ODD[0][1].split()
    items = [
        (1, " ".join(own[40:70])), (2, " ".join(own[60:90])), (2, " ".join(own[60:90])), (3, "ONE, two!"), (4, "one"), (5, None),
        (6, ""), (None, " ".join(own[100:112])), (7, "same same same"), (8, "a5 a6 a7 a8 a9 a10 a11 a12 a13 a14"), (9, "no such words in here at all " * 3),
    ]
    got = check_overlaps(spark, odd, items)
    spans = got.where("doc_id = 7").first()["spans"]
    assert all(a["to"] < b["at"] for a, b in zip(spans, spans[1:]))
    check_overlaps(spark, odd, [])
    check_overlaps(spark, nothing, items)


@pytest.mark.parametrize("seed", range(3))
def test_every_shared_window_is_found(spark, seed):
    """Few different words, so that fingerprints tie and repeat."""
    rng = np.random.default_rng(seed)
    word = lambda n: " ".join(rng.choice(list("abc"), n, p=[0.6, 0.3, 0.1]))
    docs = documents(spark, [(i, word(int(rng.integers(0, 60))), "s") for i in range(60)])
    check_overlaps(spark, docs, [(i, word(int(rng.integers(1, 25)))) for i in range(15)])


# -- 4 ---------------------------------------------------------------------------------


def brute_components(given, k, num):
    sets = []
    for _, t in given:
        w = SPACE.findall((t or "").translate(LOW))
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    up = list(range(len(given)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= num * (len(sets[i]) + len(sets[j]) - both):
                up[top(i)] = top(j)
    low = defaultdict(list)
    for i, (doc, _) in enumerate(given):
        low[top(i)].append(doc)
    least = lambda ids: min((x for x in ids if x is not None), default=None)
    return sorted(((doc, len(s), least(low[top(i)]) if s else doc) for i, ((doc, _), s) in enumerate(zip(given, sets))), key=repr)


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80)])
def test_components_of_odd_rows(spark, odd, nothing, k, num):
    got = jaccard.link(odd, k=k, num=num)
    assert rows(got, "doc_id", "n_shingles", "component_id") == brute_components([(i, t) for i, t, _ in ODD], k, num)
    assert jaccard.link(nothing, k=k, num=num).count() == 0


@pytest.mark.parametrize(("seed", "num"), [(0, 90), (1, 80), (2, 50)])
def test_components_of_chains_of_near_copies(spark, monkeypatch, seed, num):
    """Clusters in which only some pairs link; small cells, so that groups are opened in many."""
    monkeypatch.setattr(jaccard, "CELL", 3)
    rng = np.random.default_rng(seed)
    given = []
    for c in range(4):
        base = [f"{c}x{i}" for i in range(int(rng.integers(20, 60)))]
        for _ in range(25):
            if rng.random() < 0.3:
                base = [w if rng.random() > 0.04 else f"n{rng.integers(1000)}" for w in base]  # the chain drifts
            own = [w if rng.random() > rng.choice([0, 0.02, 0.05]) else f"m{rng.integers(1000)}" for w in base]
            given.append((int(rng.integers(500)), " ".join(own)))
    got = jaccard.link(documents(spark, [(i, t, "s") for i, t in given]), k=2, num=num)
    assert rows(got, "doc_id", "n_shingles", "component_id") == brute_components(given, 2, num)


def test_one_document_of_each_component_stays(spark, odd, nothing):
    kept = jaccard.one_of_each(odd)
    assert kept.columns == odd.columns
    got = rows(kept, "doc_id", "text", "source", "_row", "n_words")
    assert sum(t is None for _, t, *_ in got) == 2 and sum((t or "").strip() == "" for _, t, *_ in got) == 4
    ids = Counter(r[0] for r in got if (r[1] or "").strip())
    assert ids == Counter([3, 9, 10, 12, 13, 14, 15])
    assert jaccard.one_of_each(nothing).count() == 0


def test_components_of_links(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(20, 60)] + [(1, 2), (2, 1), (5, 5)], "a long, b long")
    assert {r["node"]: r["label"] for r in graph.components(links).collect()} == {1: 1, 2: 1} | {i: 20 for i in range(20, 61)}


# -- 6 ---------------------------------------------------------------------------------


def brute_repeats(given, n):
    words = [SPACE.findall(t or "") for _, t in given]
    seen = Counter(tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1))
    out = []
    for (doc, _), w in zip(given, words):
        hit = {p for i in range(len(w) - n + 1) if seen[tuple(w[i : i + n])] > 1 for p in range(i, i + n)}
        kept = " ".join(x for i, x in enumerate(w) if i not in hit)
        out.append((doc, len(w), len(hit), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def got_repeats(docs, n):
    out = substrings.repeats(docs, n=n)
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha"].hex()) for r in out.collect()), key=repr)


def test_repeats_of_odd_rows(odd, nothing):
    assert got_repeats(odd, 35) == brute_repeats([(i, t) for i, t, _ in ODD], 35)
    assert got_repeats(nothing, 35) == []


@pytest.mark.parametrize(("seed", "n"), [(0, 8), (1, 8), (2, 6), (3, 3)])
def test_every_repeated_window_is_found(spark, seed, n):
    rng = np.random.default_rng(seed)
    pool = [" ".join(rng.choice(list("abcdefgh"), int(rng.integers(n - 2, 3 * n)))) for _ in range(12)]
    given = []
    for i in range(80):
        parts = [" ".join(rng.choice([f"u{j}" for j in range(40)], int(rng.integers(0, 15)))), rng.choice(pool)] * int(rng.integers(1, 3))
        given.append((i, "  ".join(rng.permutation(parts))))
    given += [(99, "p q " * 40), (98, "z " * 30)]
    assert got_repeats(documents(spark, [(i, t, "s") for i, t in given]), n) == brute_repeats(given, n)


# -- 8 ---------------------------------------------------------------------------------


def reshare(sizes, weights, most=3.0):
    """Targets by the rule as it is told: stop at the limit, give the excess to the others, again."""
    budget, full, out = float(sum(sizes.values())), set(), {}
    while True:
        open_ = [s for s in sizes if s not in full]
        rest = budget - sum(most * sizes[s] for s in full)
        share = {s: rest * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * sizes[s]}
        if not over:
            return {**{s: most * sizes[s] for s in full}, **share}
        full |= over


def test_mixing_of_odd_rows(odd, nothing):
    got = mixing.mix(odd).collect()
    size = defaultdict(int)
    for _, t, s in ODD:
        size[s] += len(SPACE.findall(t or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    want = reshare(size, {s: i % 3 + 1 for i, s in enumerate(order)})
    assert len(got) == len(ODD)
    for r in got:
        assert r["_size"] == len(SPACE.findall(r["text"] or "")) and r["_source_size"] == size[r["source"]]
        assert r["_target"] == pytest.approx(want[r["source"]])
        rate = r["_target"] / r["_source_size"] if r["_source_size"] else 0
        assert int(rate) <= r["_copies"] <= int(rate) + (rate % 1 > 0) <= 3
    assert mixing.mix(nothing).count() == 0
    again = sorted((r["doc_id"] or -1, r["_copies"]) for r in mixing.mix(odd).collect())
    assert again == sorted((r["doc_id"] or -1, r["_copies"]) for r in got)


def test_mixing_comes_near_its_targets(spark):
    rng = np.random.default_rng(5)
    docs = documents(spark, [(i, "w " * int(rng.integers(1, 40)), "abcdefg"[int(rng.integers(7)) * (i % 3 > 0)]) for i in range(9000)])
    mixed = mixing.mix(docs)
    taken = mixed.groupBy("source", "_target").agg({"*": "count"}).join(
        mixed.selectExpr("source", "_size * _copies AS t").groupBy("source").sum("t"), "source"
    )
    for r in taken.collect():
        assert abs(r["sum(t)"] / r["_target"] - 1) < 0.06
    times = Counter(r["doc_id"] for r in mixing.repeat(mixed).select("doc_id").collect())
    assert times == Counter({r["doc_id"]: r["_copies"] for r in mixed.collect() if r["_copies"]})
    own = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "source string, weight double")
    assert mixing.mix(docs, weights=own).where("_copies > 0 AND source NOT IN ('a', 'b')").count() == 0


def test_equal_rows_meet_the_target_together(spark):
    rows_ = [(7, "one two three four five six seven eight", "a")] * 1000 + [(i, "one two three four", "b") for i in range(1000)]
    docs = documents(spark, rows_).repartition(5)
    mixed = mixing.mix(docs)
    assert mixed.columns == [c for c in docs.columns if c != "_size"] + ["_size", "_source_size", "_target", "_rate", "_copies"]
    assert {r["_key"] for r in mixed.select("_key").distinct().collect()} == {"k"}
    for r in mixed.groupBy("source", "_target").agg({"*": "count"}).collect():
        taken = mixed.where(mixed["source"] == r["source"]).selectExpr("sum(_size * _copies)").first()[0]
        assert abs(taken - r["_target"]) <= 4  # half a row of the larger
    counts = Counter(mixed.where("source = 'a'").toPandas()["_copies"])
    assert len(counts) == 2 and counts == Counter(mixing.mix(docs).where("source = 'a'").toPandas()["_copies"])


# -- 9 ---------------------------------------------------------------------------------


def toxic_table(spark, n, seed):
    rng = np.random.default_rng(seed)
    given, labels = [], []
    for i in range(n):
        words = [f"k{rng.integers(400)}" for _ in range(int(rng.integers(5, 60)))]
        bad = i % 5 == 0
        if bad:
            words += [f"vile{rng.choice(list('abcdefgh'))}" for _ in range(int(rng.integers(1, 5)))]
        given.append((i, " ".join(rng.permutation(words)), "s"))
        labels.append((i, int(bad)))
    return documents(spark, given), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_toxicity_on_documents_that_it_has_not_seen(spark):
    docs, labels, truth = toxic_table(spark, 900, 1)
    model = toxicity.train(docs, labels.where("doc_id < 600"))
    assert (np.diff(model.cuts) > 0).all() and len(model.cuts) == 2
    got = toxicity.grade(docs.where("doc_id >= 600"), model).collect()
    assert np.mean([r["toxic"] == (truth[r["doc_id"]] == 1) for r in got]) > 0.97
    assert {r["grade"] for r in got} <= {0, 1, 2}


def test_chosen_features_are_those_of_a_plain_count(spark):
    docs, labels, truth = toxic_table(spark, 400, 3)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows_ = toxicity.sampled(docs, labels)
    words = toxicity.choose_words(rows_)
    found = lambda text: set(toxicity.features(W.find(pa.array([text]), W.ALNUM, W.LOWER))[0].tolist())
    n, bad, base = Counter(), Counter(), np.mean(list(truth.values()))
    for i, t in texts.items():
        n.update(found(t))
        bad.update(found(t) if truth[i] else ())
    want = {f for f in n if n[f] >= 5 and (bad[f] - base * n[f]) / np.sqrt(n[f] * base * (1 - base)) >= toxicity.SIGNIFICANT}
    label, own = toxicity.held(rows_, words)
    assert set(words.tolist()) == want and want
    assert label.tolist() == [truth[i] for i in sorted(texts)]
    assert [set(x.tolist()) for x in own] == [found(texts[i]) & want for i in sorted(texts)]


def test_fit_recovers_ordered_grades():
    """Held-out likelihood of a known model: near that of the model itself."""
    rng = np.random.default_rng(0)
    words, weight = np.arange(1, 21, dtype=np.uint64), np.linspace(0.5, 2.0, 20)
    docs = [np.sort(rng.choice(words, int(rng.integers(0, 6)), replace=False)) for _ in range(4000)]
    score = np.array([weight[(d - 1).astype(int)].sum() for d in docs])
    noise = np.log(1 / rng.random(4000) - 1)
    grades = (score + noise > 2).astype(int) + (score + noise > 4)
    model = toxicity.fit(grades[:3000], docs[:3000], words, steps=1500)
    assert np.abs(model.cuts - [2, 4]).max() < 0.4 and np.corrcoef(model.weights, weight)[0, 1] > 0.9


def test_toxicity_of_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(7, 0), (7, 1), (None, 1), (3, None), (99, 1), (4, 0)], "doc_id long, toxic int")
    for given in (labels, labels.limit(0)):
        model = toxicity.train(odd, given)
        got = toxicity.grade(odd, model)
        assert got.count() == len(ODD) and got.where("toxic IS NULL OR expected_severity IS NULL").count() == 0
        assert set(odd.columns) - {"toxic"} <= set(got.columns)
        assert toxicity.grade(nothing, model).count() == 0
    assert toxicity.train(nothing, labels).cuts.shape == (1,)


# -- 10 --------------------------------------------------------------------------------


def brute_counts(t):
    w = SPACE.findall(t or "")
    lines = [x for x in (t or "").split("\n") if SPACE.search(x)]
    grams = list(zip(w, w[1:], w[2:]))
    seen = Counter(grams)
    hit = {p for i, g in enumerate(grams) if seen[g] > 1 for p in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit)


def test_quality_counts(odd, nothing):
    got = quality.assess(odd, sample=10)
    assert Counter(tuple(r[c] for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for r in got.collect()) == Counter(
        (i, *brute_counts(t)) for i, t, _ in ODD
    )
    for r in got.collect():
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and r["failed_rule"] is None)
    assert quality.assess(nothing).count() == 0


def test_cascade_verdict_does_not_depend_on_the_order():
    page = quality.Page(pa.array([*texts(ODD), "A% B% " * 40, "LOUD WORDS HERE " * 9, "l1 x\n" * 30, "1 2 3 " * 30]))
    names = list(quality.RULES)
    kept = [tuple(quality.run_cascade(page, [(n, quality.RULES[n]) for n in order])[0] < 0) for order in (names, names[::-1])]
    assert kept[0] == kept[1] and not any(kept[0][-4:])
    page = quality.Page(pa.array([None, "a\nb\n\n a\nb \nb\nb", ""]))
    assert page.n_dup_lines.tolist() == [0, 2, 0]


def test_rules_run_in_the_order_of_rejections_per_cost(spark, odd):
    slow = lambda p, alive: [sum(range(300_000)) < 0 for _ in p.n_words]
    rules = {"slow": lambda p, a: np.array(slow(p, a)), "none": lambda p, a: np.zeros(len(a), bool), "many": lambda p, a: p.n_words < 100}
    assert quality.ordered(quality.measure(odd, rules, sample=1000), rules)[0] == "many"
    seen = quality.run_cascade(quality.Page(pa.array(texts(ODD))), [("many", rules["many"]), ("none", rules["none"])])[1]
    assert seen[1][1] == seen[0][1] - seen[0][2]  # the second rule sees what the first has left


def test_a_rule_does_not_work_on_rejected_documents():
    given = [f"{'short ' * (i % 4 > 0)}{i}" for i in range(40)]
    seen = []

    def note(page, alive):
        seen.append((page.texts.to_pylist(), alive.sum()))
        return page.n_words < 1

    rules = [("two", lambda p, alive: p.n_words == 2), ("note", note), ("none", lambda p, alive: p.n_words == 1)]
    failed, counts = quality.run_cascade(quality.Page(pa.array(given)), rules)
    assert seen == [(given[::4], 10)] and [c[1:3] for c in counts] == [(40, 30), (10, 0), (10, 10)]
    assert failed.tolist() == [0 if i % 4 else 2 for i in range(40)]
