import pytest

from flowspark.plans import q_detect


def test_registered_forest_has_the_default_trees(spark, sf_dir):
    assert q_detect.iforest_trees(spark, sf_dir).select("tree").distinct().count() == 100


@pytest.mark.parametrize("name,fit,small", [
    ("fast_detect", "iforest_fit", {"n_trees"}), ("iforest_trees", "iforest_fit", {"n_trees"}),
    ("supervised_detect", "supervised_fit", {"rounds", "depth"}), ("sequence_detect", "sequence_fit", {"k"}),
])
def test_registered_queries_fit_default_models(spark, sf_dir, monkeypatch, name, fit, small):
    def fail(*args, **options):
        raise RuntimeError(",".join(options))

    monkeypatch.setattr(q_detect.T, fit, fail)
    with pytest.raises(RuntimeError) as options:
        getattr(q_detect, name)(spark, sf_dir)
    assert not small & set(str(options.value).split(","))
