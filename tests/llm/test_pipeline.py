"""The stages one after the other against brute force on the given tables."""

from collections import Counter, defaultdict

import corpus_pipeline
from conftest import ODD, SF
from test_text_operators import brute_components, brute_overlaps

from pulsemill.llm import tokenids, toxicity


def test_stages_on_given_tables(spark, table):
    docs = table("documents")
    columns = docs.columns
    model = toxicity.train(docs, table("labels"))
    bad = {r["doc_id"] for r in toxicity.grade(docs, model).where("toxic").collect()}
    first = corpus_pipeline.toxicity_stage(spark, docs, SF)
    clean = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] not in bad}
    assert first.columns == columns and {r["doc_id"]: r["text"] for r in first.collect()} == clean

    second = corpus_pipeline.near_duplicates_stage(spark, first, SF)
    single = {c for i, n, c in brute_components(sorted(clean.items()), 5, 80)}
    assert second.columns == columns and {r["doc_id"]: r["text"] for r in second.collect()} == {i: clean[i] for i in single}

    third = corpus_pipeline.decontamination_stage(spark, second, SF)
    items = [(r["item_id"], r["text"]) for r in table("benchmark").collect()]
    good = {i for i, _, hit, _ in brute_overlaps([(i, clean[i]) for i in single], items) if not hit}
    assert third.columns == columns and {r["doc_id"] for r in third.collect()} == good < single

    fourth = corpus_pipeline.mixing_stage(spark, third, SF)
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    times = Counter(r["doc_id"] for r in fourth.select("doc_id").collect())
    by_source = defaultdict(set)
    for i in good:
        by_source[source[i]].add(times[i])
    assert fourth.columns == columns and set(times) <= good and all(max(x) - min(x) <= 1 and max(x) <= 3 for x in by_source.values())

    ids, n = tokenids.encoder(tokenids.default_tokenizer())(fourth.select("text").toArrow()["text"].combine_chunks())
    fifth = corpus_pipeline.tokens_stage(spark, fourth, SF).collect()
    assert Counter(r["doc_id"] for r in fifth) == times and sum(r["n_tokens"] for r in fifth) == len(ids) + len(n)


def test_run_gives_the_stages_result(spark, table):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and got.count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "tokens"]


def test_stages_on_odd_rows(spark, odd, nothing, table):
    for given, left in ((odd, len(ODD)), (nothing, 0)):
        docs = given
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            out.write.mode("overwrite").format("noop").save()
            if name != "tokens":
                assert out.columns == given.columns
                docs = out
        assert (docs.count() > 0) == (left > 0)
