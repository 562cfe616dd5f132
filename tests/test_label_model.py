"""The fit of several labels at once against Newton's method on dense rows."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from strandline.operators.label_model import Counted, fit, minimise
from strandline.operators.scoring import fit_labels, predict_labels

BITS = 6


def dense(texts):
    x = np.zeros((len(texts), 1 << BITS))
    for i, text in enumerate(texts):
        for word in (text or "").split(" "):
            if word:
                x[i, zlib.crc32(word.encode()) & ((1 << BITS) - 1)] += 1
    return x


def newton(x, y, ridge):
    """Weights and intercept of one label."""
    rows = np.column_stack([x, np.ones(len(x))])
    penalty = np.diag([ridge] * x.shape[1] + [0.0])
    w = np.zeros(x.shape[1] + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-rows @ w))
        hessian = (rows * (p * (1 - p))[:, None]).T @ rows / len(x) + penalty + 1e-12 * np.eye(len(w))
        w -= np.linalg.solve(hessian, rows.T @ (p - y) / len(x) + penalty @ w)
    return w


@pytest.fixture(scope="module")
def table():
    rng = random.Random(6)
    words = [f"w{i}" for i in range(30)]
    rows = [(None, [0, 0, 1, 0]), ("", [1, 0, 1, 0])]
    for _ in range(300):
        text = [rng.choice(words) for _ in range(rng.randrange(9))]
        flags = [int("w1" in text or rng.random() < 0.2), int(len(text) > 4), 1, 0]
        rows.append((" ".join(text) + "  ", flags))
    return rows


def test_same_as_newton(spark, table):
    df = spark.createDataFrame(table, "x string, y array<int>").repartition(5)
    model = fit(df, "x", "y", 4, BITS, max_iter=200, ridge=0.01)
    x, y = dense([t for t, _ in table]), np.array([flags for _, flags in table], float)
    for k in (0, 1):
        want = newton(x, y[:, k], 0.01)
        assert np.abs(model.weights[:, k] - want[:-1]).max() < 1e-3 and abs(model.intercepts[k] - want[-1]) < 1e-3
    assert np.isnan(model.constants[:2]).all() and model.constants[2:].tolist() == [1, 0]
    got = predict_labels(model, df, 4).collect()
    for r in got:
        row = dense([r.x])[0]
        want = [1 / (1 + np.exp(-(row @ model.weights[:, k] + model.intercepts[k]))) for k in (0, 1)]
        assert r.probs == pytest.approx([*want, 1.0, 0.0]) and r.preds == [int(p > 0.5) for p in r.probs]


def test_sparse_rows():
    texts = ["a b a", None, "", " c  ", "a"]
    rows = Counted.of(pa.array(texts), BITS)
    weights = np.random.default_rng(1).normal(size=(1 << BITS, 3))
    assert np.allclose(rows.times(weights), dense(texts) @ weights)
    total, errors = np.zeros((1 << BITS, 3)), np.random.default_rng(2).normal(size=(5, 3))
    rows.add_transposed(errors, total)
    assert np.allclose(total, dense(texts).T @ errors)


def test_minimise():
    scale = np.array([1.0, 30.0, 0.1])
    found = minimise(lambda x: (float((scale * (x - 2) ** 2).sum()), 2 * scale * (x - 2)), np.zeros(3), 60)
    assert np.allclose(found, 2, atol=1e-4)


def test_no_rows(spark):
    none = spark.createDataFrame([], "x string, y array<int>")
    model = fit_labels(none, n_classes=2, hash_bits=BITS)
    assert predict_labels(model, spark.createDataFrame([("a",)], "x string"), 2).first().preds == [0, 0]
