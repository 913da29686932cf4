import corpus_pipeline as P
from stacklight.llm import line_dedup, packing, quality, simhash, span_dedup
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_simhash import brute_near
from tests.llm.test_span_dedup import brute as brute_spans

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in P.STAGES]
    assert names == ["quality classifier", "line dedup", "SimHash near-dedup", "substring dedup", "best-fit packing"]
    now = docs
    rows = {}
    for name, stage in P.STAGES[:-1]:
        now = stage(spark, now, SF)
        assert now.columns == docs.columns
        rows[name] = {r.doc_id: r for r in now.collect()}
        assert all(r.n_chars == len(r.text) for r in rows[name].values())
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r.doc_id for r in quality.scored(docs, model).where("score >= 0.5").collect()}
    assert rows["quality classifier"].keys() == good
    lines = brute_lines([(i, r.text) for i, r in sorted(rows["quality classifier"].items())])
    assert {i: t for i, t, _, _ in lines} == {i: r.text for i, r in rows["line dedup"].items()}
    kept = rows["SimHash near-dedup"]
    assert set(kept) == brute_near({i: r.text for i, r in rows["line dedup"].items()})
    spans = brute_spans([(i, r.text) for i, r in sorted(kept.items())])
    assert {i: t for i, t, _, _ in spans} == {i: r.text for i, r in rows["substring dedup"].items()}
    packed = P.STAGES[-1][1](spark, now, SF)
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert packing.lower_bound_of(packed.select("length")) <= packed.select("sequence_id").distinct().count()


def test_run_and_odd_tables(spark):
    assert {r.doc_id for r in P.run(spark, SF).collect()}
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, "One plain sentence with some words in it. And then another one.", "en", "a", 62), (2, "One plain sentence with some words in it. And then another one.", "en", "a", 62)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{SF}/documents.parquet").schema)
    for some in (docs, docs.limit(0)):
        now = some
        for _, stage in P.STAGES:
            now = stage(spark, now, SF)
        now.collect()


def test_operators_are_those_of_the_list():
    assert all(m.__name__.startswith("stacklight.llm.") for m in (line_dedup, packing, quality, simhash, span_dedup))
