"""Model-based selectors inside pipelines, nested result trees."""

import json

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskspark.operators import models as M
from riskspark.operators import stages as G
from riskspark.sources import tables as S


def test_positions_by_every_rule():
    v = np.array([0.0, 5.0, 1.0, 5.0, 2.0])
    pick = lambda *a: G.selected_positions(v, *a)
    assert pick("median", 0, 1) == [1, 3, 4] and pick("mean", 0, 1) == [1, 3] and pick("0.5*mean", 0, 1) == [1, 3, 4]
    assert pick("median", 1, 1) == [1] and pick("4.5", 0, 3) == [1, 3, 4] and pick("99", 0, 2) == [1, 3]
    assert pick("99", 0, 10) == [0, 1, 2, 3, 4]
    with pytest.raises(ValueError):
        G.ModelSelector("other")


@pytest.mark.parametrize("name", ["LR_L1", "RF"])
def test_selector_in_a_saved_pipeline(spark, tmp_path, name):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 6))
    y = (x[:, 1] - 2 * x[:, 4] + 0.3 * rng.normal(size=300) > 0).astype(int)
    names = list("abcdef")
    df = spark.createDataFrame([(i, int(y[i]), *map(float, x[i])) for i in range(300)], "id int, y int, " + ", ".join(f"{c} double" for c in names))
    stages = [*M.preprocess(names), G.ModelSelector(name, "mean", minFeatures=1), M.learner("LR_L2").setFeaturesCol("selected")]
    model = M.Pipeline(stages=stages).fit(df)
    assert model.stages[-2].selected(names) == ["b", "e"] and model.stages[-1].numFeatures == 2
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    a = {r.id: r.y_prob for r in M.score(df, model).collect()}
    assert again.stages[-2].selected(names) == ["b", "e"] and a == {r.id: r.y_prob for r in M.score(df, again).collect()}
    M.Pipeline(stages=stages).write().overwrite().save(str(tmp_path / "p"))
    whole = M.build_pipeline("LR_L2", names, selector={"modelName": name, "threshold": "mean", "minFeatures": 2}).fit(df)
    assert whole.transform(df).select(F.size(vector_to_array("selected")).alias("n")).first().n == 2


def tree(root):
    for run, model, seed in (("20240101_R1_p5", "LR", 0), ("20240101_R1_p5", "LR", 1), ("20240102_R2_p9", "RF", 0), ("20240102_R2_p9", "ENSEMBLE", 3)):
        base = root / f"run_{run}" / model / "splits" / f"split_seed{seed}"
        (base / "core").mkdir(parents=True)
        (base / "core" / "test_metrics.csv").write_text(f"scenario,model,auroc,n\nx,{model},0.{seed + 7},2\n")
        settings = {"seed": seed, "timing": {"fit": {"seconds": 1.5 + seed}}, "features": ["a", "b"]}
        if model == "ENSEMBLE":
            settings["ensemble"] = {"method": "blend", "base_models": ["LR", "RF"], "meta_model": {"C": 0.5}}
        if seed != 1:
            (base / "core" / "run_settings.json").write_text(json.dumps(settings, indent=1))
        agg = root / f"run_{run}" / model / "aggregated" / "metrics"
        agg.mkdir(parents=True, exist_ok=True)
        (agg / "pooled_test_metrics.csv").write_text(f"model,auroc\n{model},0.81\n")
    return str(root)


def test_nested_trees_become_rows(spark, tmp_path):
    seeds, whole = S.compile_run_tree(spark, tree(tmp_path), id_pattern=r"_(R\d+)_p(\d+)", id_names=["recipe", "size"])
    rows = {(r.model, r.split_seed): r for r in seeds.collect()}
    assert len(rows) == 4 and rows["LR", 0].settings_timing_fit_seconds == 1.5 and rows["LR", 0].settings_features == "a;b"
    assert rows["LR", 1].settings_seed is None and rows["LR", 1].test_auroc == 0.8 and rows["RF", 0].recipe == "R2" and rows["RF", 0]["size"] == "9"
    assert rows["ENSEMBLE", 3].settings_ensemble_meta_model_C == 0.5 and rows["ENSEMBLE", 3].settings_ensemble_base_models == "LR;RF"
    assert sorted((r.model, r.pooled_test_auroc) for r in whole.collect()) == [("ENSEMBLE", 0.81), ("LR", 0.81), ("RF", 0.81)]
    [e] = S.ensemble_settings(spark, str(tmp_path)).collect()
    assert (e.split_seed, e.method, e.base_models, e.meta_model_type, e.meta_model_C) == (3, "blend", "LR, RF", "logistic_regression", 0.5)
    assert S.compile_run_tree(spark, str(tmp_path / "nothing")) == (None, None)


def test_lists_of_structs_stay_json(spark):
    df = spark.read.json(spark.sparkContext.parallelize(['{"a": {"b": [{"c": 1}], "d": [1, 2]}, "e": null}']))
    assert S.flatten_structs(df).first().asDict() == {"a_b": '[{"c":1}]', "a_d": "1;2", "e": None}
