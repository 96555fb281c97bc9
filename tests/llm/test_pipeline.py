"""The pipeline against the stages' brute-force versions, and its contract."""

import os

import corpus_pipeline as pipeline
from cohortlens import session
from cohortlens.llm import target_ratio
from cohortlens.llm.common import table, tokenizer_file
from tests.llm import reference

SF = "/root/testdata/sf0.001"


def test_pipeline_equals_brute_force(spark):
    from tokenizers import Tokenizer
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    labels = table(spark, SF, "labels").collect()
    trusted = {r.doc_id for r in labels if r.quality == 1 and not r.toxic}
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    scores = reference.ratio_scores(docs, trusted, target_ratio.BUCKETS)
    passed = {}
    for (i, t), s in zip(docs, scores):
        n, _, _, _, repeat = reference.base_rules(t)
        if n >= 50 and 100 * repeat <= 50 * n:
            passed[i] = s
    least = reference.ratio_threshold(passed, labels, target_ratio)
    keep = [(i, t) for i, t in docs if passed.get(i, least - 1) >= least]
    gone = reference.dropped_lines(keep)
    keep = [(i, "\n".join(x for n, x in enumerate(t.split("\n")) if n not in {d[0] for d in gone[i]})) for i, t in keep]
    classes = reference.near_classes(keep)
    keep = [(i, t) for i, t in keep if classes[i] == i]
    leaked = {i for i, _ in reference.leaks(keep, items)}
    keep = [(i, t) for i, t in keep if i not in leaked]
    tok = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    want = {i: (tok.encode(t, add_special_tokens=False).ids, t) for i, t in keep}
    got = {r.doc_id: (r.ids, r.decoded) for r in pipeline.run(spark, SF).collect()}
    assert got == want and 0 < len(got) < len(docs)


def test_stages_keep_the_columns(spark):
    docs = table(spark, SF, "documents")
    assert 4 <= len(pipeline.STAGES) <= 5
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).schema == docs.schema


def test_empty_and_odd_tables(spark, tmp_path):
    """An empty table and rows without ids or texts go through all stages."""
    for name in ("labels", "benchmark", "documents"):
        table(spark, SF, name).limit(0 if name == "documents" else 20).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).collect() == []
    docs = table(spark, SF, "documents")
    odd = docs.limit(30).selectExpr("cast(null as bigint) as doc_id", "if(doc_id % 5 = 0, null, text) as text", "lang", "source", "n_chars")
    odd.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    got = pipeline.run(spark, str(tmp_path)).collect()
    assert got and all(r.doc_id is None and r.n_tokens == len(r.ids) for r in got)


def test_stages_leave_no_used_up_tables(spark):
    """What a stage has written besides the tables that its result is read from is gone when the stage returns."""
    docs = table(spark, SF, "documents")
    folder = f"{session.checkpoint_dir(spark)}/tables"
    for name, stage in pipeline.STAGES[:-1]:
        before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
        left = stage(spark, docs, SF)
        names = sorted(x.split("-")[0] for x in set(os.listdir(folder)) - before)
        assert names in (["judged"], ["components", "lines"], ["gone"]), name
        assert left.count() > 0
