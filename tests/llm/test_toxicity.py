import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.llm.toxicity import HIDDEN, STRIDE, WINDOW, Network, Scorer, calibrate, drop_toxic, fit, grams_of, score_toxicity, train, window_starts, windows_of, words_of


def documents(n, seed):
    rng = random.Random(seed)
    plain = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    texts, labels = [], []
    for k in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 200))]
        y = int(k % 4 == 0)
        for _ in range(rng.randint(2, 6) if y else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["nasty", "Vile", "xqz" + rng.choice(plain)]))
        texts.append(" ".join(words) + ".")
        labels.append(y)
    return texts, labels


@pytest.fixture(scope="module")
def net():
    return fit(*documents(400, 1))


def test_held_out_accuracy(net):
    texts, labels = documents(200, 2)
    p, y = Scorer(net).scores(texts), np.array(labels)
    auc = np.mean([a > b for a in p[y == 1] for b in p[y == 0]])
    assert auc > 0.95 and ((p >= 0.3) == (y == 1)).mean() > 0.9


@pytest.mark.parametrize("n", [1, 63, 64, 65, 96, 97, 500])
def test_windows_cover_and_overlap(n):
    s = window_starts(n)
    assert s[0] == 0 and s[-1] == max(0, n - WINDOW) and (np.diff(s) <= STRIDE).all() and (np.diff(s) > 0).all()
    w, owner = windows_of([np.arange(n), np.arange(3)])
    assert set(w[owner == 0].ravel()) - {0} == set(range(1, n + 1)) and w[owner == 1].tolist()[0][:4] == [1, 2, 3, 0]


def test_grams():
    buckets, counts = grams_of([b"abc", b"a", b"abc"])
    assert counts.tolist() == [3 + 2, 1, 5] and buckets[:5].tolist() == buckets[6:].tolist()


def test_gradients():
    net = Network({}, 3)
    words = [b"w%d" % k for k in range(9)]
    inputs = net.inputs(words)[0]
    windows = np.array([[1, 2, 3, 4, 0], [5, 6, 0, 0, 0], [7, 8, 9, 1, 2]])

    def loss():
        return float(net.forward(net.gates(inputs), windows).sum())

    _, cache = net.forward(net.gates(inputs), windows, keep=True)
    g, dx = net.backward(cache, np.ones(3, np.float32))
    assert dx.shape == (5, 3, 6 * HIDDEN)
    for name in ("u", "bn", "a", "w", "b"):
        flat, grad = net.p[name].reshape(-1), g[name].reshape(-1)
        for k in range(0, len(flat), max(1, len(flat) // 5)):
            was = flat[k]
            flat[k] = was + 1e-2
            up = loss()
            flat[k] = was - 1e-2
            down = loss()
            flat[k] = was
            assert grad[k] == pytest.approx((up - down) / 2e-2, abs=2e-3)


def test_scores_do_not_depend_on_the_batch(net):
    texts, _ = documents(30, 5)
    texts += ["", "...", "nasty " * 3000]
    one = np.array([Scorer(net, limit=40).scores([t])[0] for t in texts])
    assert Scorer(net).scores(texts) == pytest.approx(one, abs=1e-5)
    assert one[-3] == one[-2] == 0


def test_table(spark, net):
    texts, _ = documents(20, 6)
    df = spark.createDataFrame([*((k, t, "s") for k, t in enumerate(texts)), (None, None, "s"), (3, "", "s")], "doc_id long, text string, score string").repartition(3)
    got = {(r[0], round(r[1], 6)) for r in score_toxicity(df, net).collect()}
    p = Scorer(net).scores(texts)
    assert got == {(k, round(float(x), 6)) for k, x in enumerate(p)} | {(None, 0.0), (3, 0.0)}
    kept = drop_toxic(df, net)
    assert kept.columns == df.columns and kept.count() == (p < 0.3).sum() + 2
    assert score_toxicity(df.limit(0), net).count() == 0


def test_training_uses_usable_rows_only(spark):
    texts, labels = documents(120, 7)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    told = spark.createDataFrame([*((k, y) for k, y in enumerate(labels)), (None, 1), (7, None), (999, 1)], "doc_id long, toxic int")
    usable = F.crc32(F.col("id").cast("string").cast("binary")) % 4 != 2
    flipped = told.withColumn("toxic", F.when((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2), F.col("toxic")).otherwise(1 - F.col("toxic")))
    a, b = (train(docs, x, usable=usable) for x in (told, flipped))
    assert all((a.p[k] == b.p[k]).all() for k in a.p)
    assert any(zlib.crc32(str(k).encode()) % 4 == 2 for k in range(120))
    assert train(docs, told.limit(0)).slope == 0 and Scorer(train(docs, told.filter("toxic = 0"))).scores(texts[:1])[0] < 0.05


def test_calibration():
    x = np.r_[np.full(50, -1.0), np.full(50, 1.0)]
    y = np.r_[np.zeros(45), np.ones(5), np.ones(45), np.zeros(5)]
    a, b = calibrate(x, y, np.ones(100))
    assert 1 / (1 + np.exp(-(a + b))) == pytest.approx(0.9, abs=0.02)
    assert words_of("Été, A-b") == ["été".encode(), b"a", b"b"]
