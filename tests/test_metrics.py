import math

import pytest
from pyspark.sql import functions as F

from strandline.operators.evaluate import (
    areas,
    auprc,
    auroc,
    bce_from_logits,
    binary_prf,
    confusion,
    decide,
    masked_ce,
    multilabel_f1,
    slot_accuracy,
    slot_prefix_accuracy,
    token_accuracy,
)
from strandline.operators.scoring import fit_labels, predict_labels


def scored(spark, rows):
    return spark.createDataFrame(rows, "label int, prob double")


def test_all_equal_scores(spark):
    df = scored(spark, [(1, 0.3), (0, 0.3), (0, 0.3), (1, 0.3)])
    assert auroc(df).first().auroc == 0.5
    assert auprc(df).first().auprc == 0.5


def test_areas(spark):
    df = scored(spark, [(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.1)])
    assert auroc(df).first().auroc == 0.75
    assert auprc(df).first().auprc == pytest.approx((1 + 2 / 3) / 2)


def test_areas_without_one_side_are_null(spark):
    assert auroc(scored(spark, [(1, 0.9), (1, 0.8)])).first().auroc is None
    assert auprc(scored(spark, [(0, 0.9)])).first().auprc is None


def test_no_positives(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "label int, pred int")
    assert tuple(binary_prf(df).first()) == (0.0, 0.0, 0.0)
    grid = {(r.label, r.pred): (r.n, r.share) for r in confusion(df).collect()}
    assert grid == {(0, 0): (2, 1.0), (0, 1): (0, 0.0), (1, 0): (0, 0.0), (1, 1): (0, 0.0)}


def test_other_classes_have_cells(spark):
    df = spark.createDataFrame([(0, 0), (2, 1), (None, 1), (1, None), (7, 9)], "label int, pred int")
    cells = {(r.label, r.pred): r.n for r in confusion(df).collect()}
    assert cells == {(0, 0): 1, (0, 1): 0, (1, 0): 0, (1, 1): 0, (None, 1): 2, (1, None): 1, (None, None): 1}


def test_decision_is_strict(spark):
    df = spark.createDataFrame([(0.0,), (1e-9,), (-800.0,), (800.0,)], "logit double")
    assert [r.pred for r in decide(df).collect()] == [0, 1, 0, 1]


def test_f1_averages(spark):
    df = spark.createDataFrame([([1, 0], [1, 0]), ([1, 0], [0, 0])], "y array<int>, pred array<int>")
    assert multilabel_f1(df, 2, "micro").first().f1 == pytest.approx(2 / 3)
    assert multilabel_f1(df, 2, "macro").first().f1 == pytest.approx(1 / 3)


def test_token_and_slot_accuracy(spark):
    df = spark.createDataFrame(
        [([4, 9, 4], [7, -100, 8], [7, 1, 9]), ([4, 9, 9], [7, -100, -100], [7, -100, 1]), ([9], [-100], [1])],
        "input_ids array<int>, labels array<int>, preds array<int>",
    )
    assert token_accuracy(df).first().accuracy == pytest.approx(2 / 3)
    assert token_accuracy(df, ignore=None).first().accuracy == pytest.approx(3 / 7)
    assert slot_accuracy(df).first().accuracy == pytest.approx(0.75)


def test_prefix_accuracy(spark):
    df = spark.createDataFrame(
        [([4, 4], ["shop_a", "bank"], ["shop_b_c", "bus"])], "input_ids array<int>, label_texts array<string>, pred_texts array<string>"
    )
    assert slot_prefix_accuracy(df).first().p_accuracy == 0.5


def test_losses(spark):
    df = spark.createDataFrame([(1, 1000.0), (0, 1000.0), (1, 0.0)], "label int, logit double")
    assert bce_from_logits(df, reduction="sum").first().loss == pytest.approx(1000 + math.log(2))
    ce = spark.createDataFrame([([5, -100], [0.5, 0.1]), ([-100, 6], [0.1, 0.25])], "labels array<int>, probs array<double>")
    assert masked_ce(ce).first().loss == pytest.approx(1.5 * math.log(2))
    assert masked_ce(ce, denom=32).first().loss == pytest.approx(3 * math.log(2) / 32)
    assert masked_ce(ce.limit(0)).first().loss is None


def test_label_baseline_beats_the_constant_guess(spark):
    """Two classes, each told by a word."""
    words = [["red"], ["blue"], ["red", "blue"], ["green"]]
    rows = [(" ".join([*words[i % 4], f"w{i}"]), [int("red" in words[i % 4]), int("blue" in words[i % 4])]) for i in range(80)]
    df = spark.createDataFrame(rows, "x string, y array<int>")
    got = predict_labels(fit_labels(df, n_classes=2), df, n_classes=2).collect()
    assert all(list(r.preds) == list(r.y) for r in got)


def test_no_word_is_left_out_of_the_features(spark):
    """70,000 different words: the class hangs on rare ones."""
    df = spark.range(70_000).selectExpr("concat('w', id, if(id % 2 = 0, ' even', ' odd')) AS x", "array(cast(id % 2 as int)) AS y")
    got = predict_labels(fit_labels(df, n_classes=1, max_iter=5), df, n_classes=1)
    assert got.filter("preds[0] <> y[0]").isEmpty()


def test_areas_are_those_of_two_sorts(spark):
    df = scored(spark, [(1, 0.9), (0, 0.9), (1, 0.4), (0, 0.4), (0, 0.4), (1, 0.1), (0, 0.05)])
    both = areas(df).first()
    assert both.auroc == pytest.approx(auroc(df).first().auroc) and both.auprc == pytest.approx(auprc(df).first().auprc)
