import pandas as pd
import pytest

from feltgrid import domain
from feltgrid.operators import scoring
from feltgrid.plans import build
from feltgrid.sources import manifest


def test_validation_plan(spark):
    rows = [("1", "happy happy", "happy"), ("2", "sad cry", "sad"), ("3", "plain", "neutral"), ("4", "happy", "unknown"), ("5", "angry", "happy")]
    bench = spark.createDataFrame(rows, "id string, content string, label string")
    tables = build.build_validation(bench, lambda df: scoring.score_with_lexicon(df, neutral=0.5))
    summary = tables["summary"].first()
    assert summary.rows == 4 and summary.accuracy == 0.75
    assert {r.label for r in tables["class_report"].collect()} == set(domain.BENCHMARK_LABELS.values())


def test_bundle_without_a_required_table_is_an_error(spark, tmp_path):
    df = spark.range(3)
    with pytest.raises(ValueError, match="anomaly_detection"):
        manifest.export_bundle({"x": df}, str(tmp_path), required=["x", "anomaly_detection"])
    assert not list(tmp_path.iterdir())
    manifest.export_bundle({"x": df}, str(tmp_path), required=["x"])
    assert sum(r.row_count for r in manifest.manifest(spark, str(tmp_path)).collect()) == 3


def test_batches_go_on_across_frames():
    frames = [pd.DataFrame({"x": range(a, b)}) for a, b in ((0, 7), (7, 8), (8, 8), (8, 31))]
    out = list(scoring.whole_batches(iter(frames), 10))
    assert [x for f in out for x in f["x"]] == list(range(31))
    assert [len(f) % 10 for f in out[:-1]] == [0] * (len(out) - 1) and len(out[-1]) == 1
    assert not list(scoring.whole_batches(iter([]), 10))
