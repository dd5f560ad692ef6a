import corpus_pipeline
from tidelog.llm import common, near, queries


def first_of_each(rows):
    """(doc_id,) of each component of texts whose five-word Jaccard similarity, over all pairs, is at least 0.8: the smallest, null if none has one."""
    ids = {}
    for r in rows:
        ids.setdefault(near.normal(r.text), []).append(r.doc_id)
    texts = sorted(ids)
    cut, to = [near.shingles(t) for t in texts], list(range(len(texts)))

    def root(i):
        while to[i] != i:
            i = to[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if near.similarity(cut[i], cut[j]) >= 0.8:
                to[root(i)] = root(j)
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(root(i), []).extend(ids[t])
    return [(min((x for x in own if x is not None), default=None),) for own in groups.values()]


def test_stages(spark, sf, documents, odd):
    for docs in (documents, odd):
        columns, seen = docs.columns, docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            before = seen
            seen = common.materialize(stage(spark, before, sf), name)
            assert seen.columns == columns, name
            if name == "simhash_near_dedup":
                assert sorted(seen.select("doc_id").collect(), key=repr) == sorted(first_of_each(before.collect()), key=repr)
            if name == "secret_scan":
                assert seen.count() == before.count()
        packed = corpus_pipeline.pack(spark, seen, sf)
        assert packed.where("piece = 0").count() == seen.count()


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "simhash_near_dedup", "secret_scan", "source_mixing", "best_fit_packing"]


def test_run_covers_registered_queries(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
    assert [k.split("_")[0] for k in queries.QUERIES] == [f"op{n}" for n in range(1, 11)]
