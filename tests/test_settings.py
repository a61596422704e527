from __future__ import annotations

import json

import pytest

from gleanframe.config import PRESETS, PipelineConfig, load_config, sweep
from gleanframe.functions import vectors
from gleanframe.operators import ablation
from gleanframe.retriever import RunTelemetry
from gleanframe.sources import tables


def test_defaults_and_files(tmp_path):
    assert load_config().backend.max_seq_length == 256
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"name": "x", "query": {"hyde_enabled": True, "hyde_weight": 0.25}}))
    found = load_config(str(path))
    assert found.describe() == "x [model=all-MiniLM-L6-v2, hyde@0.25]"
    assert load_config(found) is found and load_config(found.to_dict()) == found
    assert all(isinstance(load_config(c), PipelineConfig) for c in PRESETS.values())


@pytest.mark.parametrize("bad", [{"nope": 1}, {"query": {"nope": 1}}, {"query": {"hyde_weight": 2}}, {"backend": {"kind": "x"}}, {"backend": {"batch_size": 0}}, {"scoring": {"fusion": "x"}}, {"snippet": {"max_chars": -1}}, {"versioning": {"reference": "x"}}])
def test_bad_settings_are_refused(bad):
    with pytest.raises(ValueError):
        load_config(bad)


def test_backend_falls_back_unless_strict():
    own = load_config({"backend": {"model_name": "no-such/model"}}).backend
    with pytest.warns(UserWarning):
        assert isinstance(vectors.build_backend(own), vectors.HashingBackend)
    with pytest.raises(RuntimeError):
        vectors.build_backend(own, strict=True)


def test_prompts_reach_the_model(spark):
    class Model:
        def get_sentence_embedding_dimension(self):
            return 2

        def encode(self, texts, **_):
            import numpy as np

            return np.array([[len(t), t.startswith("query: ")] for t in texts], float)

    backend = vectors.ModelBackend("m", normalize=False, query_prompt="query: ", passage_prompt="passage: ", loader=lambda **_: Model())
    df = spark.createDataFrame([("a", "sort a list")], "id string, text string")
    assert backend.embed(df, ["id"], "text", is_query=True).first().vec == [18.0, 1.0]
    assert backend.embed(df, ["id"], "text").first().vec == [20.0, 0.0]


def test_ablation_measures_against_the_first(spark, tmp_path):
    scores = {"baseline": 0.5, "+multiview": 0.6, "+hyde": 0.4, "+hybrid_rrf": 0.5, "+all": 0.7}
    found = ablation.ablation_table(spark, sweep(), lambda c: spark.createDataFrame([(scores[c.name], 0.1)], "ndcg_at_10 double, mrr_at_100 double"))
    rows = {r.name: r for r in found.collect()}
    assert [rows[n].kept for n in scores] == [True, True, False, False, True]
    assert rows["+hyde"].delta_ndcg == pytest.approx(-0.1) and rows["baseline"].mrr_at_10 == 0.1
    assert ablation.write_report(found, None, str(tmp_path / "out" / "t.json")) == [str(tmp_path / "out" / "t.json")]
    ablation.write_report(found, str(tmp_path / "t.md"))
    lines = (tmp_path / "t.md").read_text().splitlines()
    assert len(lines) == 7 and "| — |" in lines[2] and "+0.1000" in lines[3] and lines[4].endswith("| drop |")
    assert json.loads((tmp_path / "out" / "t.json").read_text())["baseline_ndcg_at_10"] == 0.5


def test_tables_and_results(spark, tmp_path):
    assert [r.doc_id for r in tables.corpus_from(spark, ["x", "y"]).orderBy("doc_pos").collect()] == ["0", "1"]
    batch = spark.createDataFrame([(" T ", "body"), (None, "body"), ("  ", None)], "title string, query string")
    assert sorted(r.body for r in tables.benchmark_texts(batch).collect()) == ["", "T\nbody", "body"]
    assert tables.read_sketch_cache(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "s.json").write_text('{"a b": "code"}')
    assert tables.read_sketch_cache(spark, str(tmp_path / "s.json")).first().sketch == "code"
    result = {"scores": {"dev": [{"ndcg_at_10": 0.5, "languages": ["x"], "main_score": 0.5}]}}
    assert tables.extract_scores(result, "test") == {"ndcg_at_10": 0.5, "main_score": 0.5}
    made = tables.write_result_files({"result": result, "scores": {}}, load_config(), str(tmp_path / "out" / "r.json"))
    assert json.loads(open(made[0]).read()) == result and made[1].endswith("r.debug.json")


def test_telemetry():
    t = RunTelemetry(num_queries=4, query_seconds=2.0)
    assert t.to_dict()["queries_per_second"] == 2.0 and t.mean_query_latency_ms == 500.0
    assert RunTelemetry().queries_per_second == 0.0


def test_entry_lists_queries():
    import __spark_entry__ as entry

    assert {"bm25_topk", "rrf_topk", "p4_found"} <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
