import ast
import inspect
import math

import corpus_pipeline

from octavo.llm import jaccard, packing, quality, toxicity
from test_jaccard import brute
from test_text_operators import brute_spans, check_packing, plain_posteriors

SF = "/root/testdata/sf0.01"


def test_stages_one_after_the_other(spark):
    """Every stage against what it should do to what it was given."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 300")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "secrets", "packing"]
    rows = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == docs.columns
            out = spark.createDataFrame(out.collect(), docs.schema)
        kept = out.collect()
        ids = {r.doc_id for r in kept}
        if name == "quality":
            wrong = [d for d in rows if d in labels and labels[d].quality is not None and (d in ids) != bool(labels[d].quality)]
            assert len(wrong) <= 2
        elif name == "toxicity":
            assert not [d for d in ids if d in labels and labels[d].toxic and "idiot" in rows[d].text.lower().split()]
            assert sum(1 for d in rows if d not in ids and d in labels and not labels[d].toxic) <= 1
        elif name == "near_duplicates":
            want = brute([(r.doc_id, r.text) for r in rows.values()], 5, 80)
            assert ids == {d for d, (_, c) in want.items() if d == c}
        elif name == "secrets":
            assert ids == set(rows)
            for r in kept:
                spans = brute_spans(rows[r.doc_id].text)
                assert (r.text == rows[r.doc_id].text) == (not spans)
                assert not any(rows[r.doc_id].text[a:b] in r.text for a, k, b in spans if b - a > 30)
                assert not spans or r.n_chars == len(r.text)
        else:
            check_packing(kept, [(r.doc_id, r.text) for r in rows.values()])
            break
        docs, rows = out, {r.doc_id: r for r in kept}


def test_stages_decide_by_the_operators(spark):
    """Quality and toxicity stages keep exactly the rows that the operators' scores say, one by one."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 300")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = docs.collect()
    lexicon = toxicity.fit(docs, labels)
    want = [r for r in rows if toxicity.score(r.text, lexicon)[0] < toxicity.THRESHOLD]
    assert sorted(corpus_pipeline.keep_civil(spark, docs, SF).collect()) == sorted(want)
    model = quality.fit(docs, labels)
    odds = model.log_odds([r.text for r in rows])
    sites, prior = plain_posteriors([(r.source, r.lang, z) for r, z in zip(rows, odds, strict=True)])
    logit = lambda p: math.log(p / (1 - p))
    want = [r for r, z in zip(rows, odds, strict=True) if 1 / (1 + math.exp(-(z + logit(sites[r.source, r.lang]) - logit(prior)))) < quality.REJECT]
    assert sorted(corpus_pipeline.keep_quality(spark, docs, SF).collect()) == sorted(want)


def test_stages_take_odd_rows(spark, edge, empty):
    """Nulls, empty and very long texts, repeated rows and ids, columns with clashing names; and no rows at all."""
    from pyspark.sql import functions as F

    odd = edge.withColumn("n_chars", F.lit(None).cast("long")).withColumn("octavo_secrets", F.lit("own"))
    odd = odd.union(odd.where("doc_id = 1").withColumn("text", F.lit("another text with token = abcdefghijklmnop1234 in it")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, SF)
        assert out.columns == odd.columns and out.where("octavo_secrets <> 'own'").count() == 0
        assert stage(spark, odd.limit(0), SF).count() == 0
        texts = {r.text for r in out.collect()}
        if name == "secrets":
            assert out.count() == odd.count() and "another text with [SECRET] in it" in texts
            assert out.where("n_chars IS NOT NULL").count() == 1
        if name == "near_duplicates":
            assert out.where("doc_id IS NULL").count() == 2 and out.where("doc_id = 1").count() == 2 and out.where("doc_id = 8").count() == 1
    check_packing(corpus_pipeline.pack(spark, odd, SF).collect(), [(r.doc_id, r.text) for r in odd.collect()])
    assert corpus_pipeline.pack(spark, odd.limit(0), SF).count() == 0


def test_run_is_the_stages_in_order(spark):
    """run() against the stages called one after the other on collected rows."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
    whole = lambda df: sorted({(r.doc_id, r.doc_tokens) for r in df.collect()})
    found = corpus_pipeline.run(spark, sf)
    want = corpus_pipeline.pack(spark, docs, sf)
    assert whole(found) == whole(want)
    check_packing(found.collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_run_packs_what_is_kept(spark):
    found = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert 0 < found.select("doc_id").distinct().count() < 200


def test_python_stages_give_memory_back():
    """Workers stay for later stages, so every function of batches ends by giving back what it has freed."""
    checked = 0
    for module in (quality, toxicity, jaccard, packing):
        for f in ast.walk(ast.parse(inspect.getsource(module))):
            if isinstance(f, ast.FunctionDef) and [a.arg for a in f.args.args] == ["batches"]:
                assert ast.unparse(f.body[-1]) == "tidy()", (module.__name__, f.name)
                checked += 1
    assert checked >= 12
