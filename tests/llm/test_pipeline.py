import public_tokenizers as P
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_packing import check
from tests.llm.test_simhash import wide_components

import corpus_pipeline
from docloom.llm import quality, simhash, toxicity


def test_each_stage_against_brute_force(spark, sf001):
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    labels = spark.read.parquet(f"{sf001}/labels.parquet")
    columns, rows = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, sf001)
        if name == "packing":
            check(list(rows.items()), docs.collect(), 4096)
            break
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.columns == columns
        got = {r.doc_id: r.text for r in docs.collect()}
        if name in ("quality", "toxicity"):
            model = (quality if name == "quality" else toxicity).train(before, labels)
            f = model.scores if name == "quality" else model.scorer()
            keep = [d for d, t in rows.items() if (f([t.encode()])[0] >= 0.3 if name == "quality" else f([t.encode()])[0] < 0.5)]
            rows = {d: rows[d] for d in keep}
            assert len(rows) > 120
        elif name == "line_dedup":
            gone = {(d, n) for d, n, *_, kept in brute_lines(list(rows.items())) if not kept}
            rows = {d: "\n".join(x for n, x in enumerate(t.split("\n")) if (d, n) not in gone) for d, t in rows.items()}
        else:
            ids = list(rows)
            of = dict(zip(ids, wide_components(ids, list(rows.values()), simhash.radius_of(0.8))))
            # every component keeps its smallest id; the cells may miss a link, so a few more may stay
            assert set(of.values()) <= set(got) and len(got) <= len(set(of.values())) + 2
            rows = {d: rows[d] for d in ids if d in got}
        assert got == rows
    assert P.path("word_bpe_49k.json")


def test_classifiers_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r for r in labels.collect()}
    part = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    for f, name, least in ((quality.quality_scores, "quality", 0.97), (toxicity.toxicity_scores, "toxic", 0.95)):
        rows = [r for r in f(part, labels).collect() if r.held_out]
        assert sum(r.predicted == truth[r.doc_id][name] for r in rows) / len(rows) >= least


def test_classifiers_odd_rows(spark):
    rows = [(i, "good words in a fine sentence number %d." % i if i % 2 else "bad $$$ | | idiot %d" % i, "x") for i in range(60)]
    rows += [(100, None, "x"), (101, "", "x"), (102, "idiot " * 50000, "x"), (None, "a", "x"), (1, rows[1][1], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(60)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    for module, f in ((quality, quality.quality_scores), (toxicity, toxicity.toxicity_scores)):
        got = f(docs, labels).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
        by = {r.doc_id: r.predicted for r in got}
        assert by[1] == (1 if module is quality else 0) and by[2] == (0 if module is quality else 1)
        none = f(docs, labels.limit(0)).collect()
        assert {r.score for r in none} == {1.0 if module is quality else 0.0}
        assert f(docs.limit(0), labels).count() == 0
        model = module.train(docs, labels)
        kept = module.keep(docs, model)
        assert kept.columns == docs.columns and 0 < kept.count() < len(rows)
