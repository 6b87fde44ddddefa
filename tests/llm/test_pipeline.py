"""The pipeline against its stages done by hand on a small input."""

import re

import corpus_pipeline
from pixelweave.llm import mixing, quality, secret_scan, simhash

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "near duplicates", "secrets", "mixing", "packing"]
    out = corpus_pipeline.run(spark, SF).collect()
    kept = {r.doc_id for r in quality.quality_verdicts(docs).where("kept").collect()}
    a = docs.where(docs.doc_id.isin(sorted(kept)))
    single = {r.doc_id for r in simhash.simhash_groups(a).where("kept").collect()}
    b = a.where(a.doc_id.isin(sorted(single)))
    clean = secret_scan.redact(b)
    chosen = {r.doc_id for r in mixing.mixture(clean).where("selected").collect()}
    assert {r.doc_id for r in out} == chosen
    left = {r.doc_id: r.text for r in clean.collect()}
    assert not any(re.search(r"AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}", t or "") for t in left.values())
    total = {}
    for r in out:
        total.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in total.values():
        own.sort()
        assert own[0][0] == 0 and all(x + n == y for (x, n), (y, _) in zip(own, own[1:])) and sum(own[-1]) <= 4096


def test_columns_hold_until_packing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_rows_without_or_with_repeated_ids(spark):
    text = " ".join(f"word{k} other{k * 7 % 50}" for k in range(60))
    rows = [(None, text, "en", "s", 1), (5, text, "en", "s", 1), (5, text, "en", "s", 1), (6, text + " end", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(str(r.doc_id) for r in corpus_pipeline.near_duplicate_stage(spark, docs, SF).collect())[0] == "5"
    assert corpus_pipeline.near_duplicate_stage(spark, docs, SF).where("doc_id = 5").count() == 1


def test_one_id_on_different_texts(spark):
    texts = [" ".join(f"{w}{k} {w}other{k * 7 % 50}" for k in range(60)) for w in ("alpha", "beta", "gamma")]
    rows = [(None, "short", "en", "s", 5), (None, texts[0], "en", "s", 1), (1, "short", "en", "s", 5), (1, texts[1], "en", "s", 1), (1, texts[2], "en", "s", 1), (2, texts[1], "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    good = corpus_pipeline.quality_stage(spark, docs, SF)
    assert sorted((str(r.doc_id), r.text) for r in good.collect()) == sorted((str(i), t) for i, t, *_ in rows if t != "short")
    left = corpus_pipeline.near_duplicate_stage(spark, good, SF).collect()
    assert sorted((str(r.doc_id), r.text) for r in left) == sorted([("None", texts[0]), ("1", texts[1]), ("1", texts[2])])


def test_quality_shuffles_no_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        good = corpus_pipeline.quality_stage(spark, docs, SF)
        nodes = [good._jdf.queryExecution().executedPlan()]
        while nodes:
            node = nodes.pop()
            nodes += [node.initialPlan()] if node.nodeName() == "AdaptiveSparkPlan" else [node.children().apply(k) for k in range(node.children().size())]
            own = {node.output().apply(k).name() for k in range(node.output().size())}
            assert not (node.nodeName() == "Exchange" and own & {"text", "_row"})
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
    kept = {r.doc_id for r in quality.quality_verdicts(docs).where("kept").collect()}
    assert sorted(map(tuple, good.collect())) == sorted(tuple(r) for r in docs.collect() if r.doc_id in kept)
