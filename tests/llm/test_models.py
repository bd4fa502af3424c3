"""The classifiers against slow references, and on tables with repeated ids and hard rows."""

import random
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from netweave.llm import language_id, toxicity
from netweave.llm.common import bounded_sample


def small_net(seed=3):
    net = toxicity.ConvNet(seed)
    rng = np.random.default_rng(seed)
    net.embed = [rng.standard_normal(e.shape).astype(np.float32) for e in net.embed]
    net.bias = [rng.standard_normal(b.shape).astype(np.float32) * 0.1 for b in net.bias]
    return net


def slow_logit(net, words):
    """Word by word, window by window, filter by filter."""
    rows = []
    for word in words:
        bits = int(toxicity.word_places(word)[0])
        rows.append(sum(net.embed[v][bits >> v * toxicity.TABLE_BITS & (toxicity.TABLE - 1)].astype(float) for v in range(toxicity.VIEWS)))
    pooled = []
    for k, width in enumerate(toxicity.WIDTHS):
        for f in range(toxicity.FILTERS):
            best = 0.0
            for at in range(len(rows) - width + 1):
                best = max(best, sum(float(rows[at + j] @ net.filters[k][j, :, f]) for j in range(width)) + float(net.bias[k][f]))
            pooled.append(best)
    return float(np.dot(pooled, net.out) + net.out_bias[0])


TEXTS = ["", "one", "one two", "Vile, words! and (more) of them vile", " ".join(f"w{i % 17}" for i in range(60))]


@pytest.mark.parametrize("text", TEXTS)
def test_forward_pass(text, monkeypatch):
    net = small_net()
    want = slow_logit(net, text.split())
    assert net.logit(toxicity.word_places(text)) == pytest.approx(want, rel=1e-4, abs=1e-4)
    # Long texts are gone through in chunks that overlap.
    monkeypatch.setattr(toxicity, "_CHUNK", 5)
    assert net.logit(toxicity.word_places(text)) == pytest.approx(want, rel=1e-4, abs=1e-4)


def test_gradient_against_differences():
    net = small_net(5)
    for p in net._params()[:3]:
        p *= 0.5
    places, label, weight = toxicity.word_places(TEXTS[3]), 1, 0.7
    grads = [np.zeros_like(p) for p in net._params()[toxicity.VIEWS :]]
    rows = [{} for _ in range(toxicity.VIEWS)]
    net._backward(places, label, weight, grads, rows)

    def loss():
        z = net.logit(places)
        return weight * (np.log1p(np.exp(-z)) if label else np.log1p(np.exp(z)))

    def slope(array, at, step=1e-3):
        held = array[at]
        array[at] = held + step
        up = loss()
        array[at] = held - step
        down = loss()
        array[at] = held
        return (up - down) / (2 * step)

    rng = np.random.default_rng(0)
    for p, g in zip(net._params()[toxicity.VIEWS :], grads):
        for at in {tuple(int(rng.integers(n)) for n in p.shape) for _ in range(12)}:
            assert g[at] == pytest.approx(slope(p, at), rel=0.05, abs=2e-3)
    for table, found in zip(net.embed, rows):
        for row, g in list(found.items())[:6]:
            for c in range(0, toxicity.WIDTH, 3):
                assert g[c] == pytest.approx(slope(table, (row, c)), rel=0.05, abs=2e-3)


def test_thresholds():
    assert toxicity.best_threshold(np.array([-1.0, 0, 2, 3]), np.array([0, 0, 1, 1]), 9.0) == 1.0
    assert toxicity.best_threshold(np.array([1.0, 2]), np.array([1, 1]), 9.0) == 9.0


def grams(text):
    text = " " + text.lower() + " "
    return {text[i : i + n] for n in language_id.LENGTHS for i in range(len(text) - n + 1)}


def test_kernel_of_presence():
    a, b = "Hello there, général", "there is a gênéral hello"
    want = len(grams(a) & grams(b)) / np.sqrt(len(grams(a)) * len(grams(b)))
    rows = language_id.presence_rows([a, b], 1 << 22)
    assert float(rows[0] @ rows[1]) == pytest.approx(want, rel=1e-3)


def test_ridge_against_its_normal_equations():
    rng = random.Random(2)
    words = {"aa": ["aba", "aca", "adda"], "bb": ["obo", "oco", "oddo"], "cc": ["ubu", "ucu", "uddu"]}
    texts = [(" ".join(rng.choice(words[x]) for _ in range(rng.randint(3, 9))), x) for x in words for _ in range(rng.randint(8, 14))]
    model = language_id.KernelModel([t for t, _ in texts], [x for _, x in texts], per_lang=5)
    rows = language_id.presence_rows([t for t, _ in texts]).astype(float)
    y = [model.names.index(x) for _, x in texts]
    m = model.landmarks.astype(float)
    # Weighted squares plus the norm in the landmarks' space, minimised by slow gradient steps.
    k_nm, k_mm = rows @ m.T, m @ m.T
    weight = np.array([len(y) / (3 * y.count(k)) for k in y])
    for k in range(3):
        target = np.array([1.0 if c == k else -1.0 for c in y])
        w = model.weights[:, k].astype(float)

        def loss(w):
            return float((weight * (k_nm @ w - target) ** 2).sum() + language_id.RIDGE * len(y) / 3 * w @ k_mm @ w + 1e-8 * w @ w)

        best = loss(w)
        steps = np.random.default_rng(1)
        assert all(loss(w + steps.standard_normal(len(w)) * size) > best - 1e-4 for size in (1e-3, 1e-2, 0.1) for _ in range(50))
    probs = model.scores([t for t, _ in texts])
    out = rows @ m.T @ model.weights
    want = np.exp(language_id.SHARPNESS * out) / np.exp(language_id.SHARPNESS * out).sum(axis=1, keepdims=True)
    assert np.allclose(probs, want, atol=1e-4) and (probs.argmax(axis=1) == y).mean() > 0.95


def test_bounded_sample(spark):
    keys = spark.range(5000).select(F.col("id").alias("k"), F.when(F.col("id") % 10 == 0, "few").when(F.col("id") % 7 == 0, None).otherwise("many").alias("g"))
    got = bounded_sample(keys, "k", "g", 300).groupBy("g").count().collect()
    assert {r["g"]: r["count"] for r in got} == {"few": 300, "many": 300}
    many = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") % 500).cast("string").alias("g"))
    assert bounded_sample(many, "k", "g", 2).count() == 1000


def test_no_language_is_left_out(spark):
    rows = [(k, f"{'abcdefghijklmnop'[k % 16] * 3}{k} word{k}", f"l{k // 3}") for k in range(750)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(model.names) == {x for k, _, x in rows if zlib.crc32(str(k).encode()) % 4 != 2}


def test_repeated_ids_and_hard_rows(spark, hard):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["plain", "words", "only", "here"]) for _ in range(20)) + (" vile" if i % 3 == 0 else ""), "en", int(i % 3 == 0)) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    many = docs.union(docs).union(docs.where("doc_id < 40"))
    labels = many.select("doc_id", "toxic").union(spark.createDataFrame([(None, 1), (1, 7)], "doc_id long, toxic int"))
    model = toxicity.fit(many, labels)
    once = toxicity.fit(docs, docs.select("doc_id", "toxic"))
    assert model.score("plain vile words") == once.score("plain vile words") > 0.5 > model.score("plain words")
    scored = toxicity.score(hard, model).collect()
    assert len(scored) == hard.count() and {r["doc_id"] for r in scored} == {r["doc_id"] for r in hard.collect()}
    empty = model.score("")
    assert all(r["score"] == empty for r in scored if r["doc_id"] in (2, 3)) and model.score(None) == empty
    assert toxicity.score(hard.limit(0), model).count() == 0 and toxicity.drop_toxic(hard, model).columns == hard.columns
    language = language_id.fit(hard)
    found = language_id.predict(hard, language).collect()
    assert len(found) == hard.count() and {(r["doc_id"], r["lang_pred"]) for r in found} >= {(2, "und"), (3, "und")}
    assert language_id.predict(hard.limit(0), language).count() == 0 and language_id.fit(hard.limit(0)) is None


def test_toxicity_learns_from_every_row(spark):
    """A word that only rows beyond the net's first sample hold is learned; languages are counted over all rows."""
    rows = [(n, f"plain words here {n % 7} and {'vexgrim' if n % 2 else 'there'}", "en" if n % 3 else "de", n % 2) for n in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    model = toxicity.fit(docs, docs.select("doc_id", "toxic"), per_class=1)
    words = sum(len(r[1].split()) for r in rows if zlib.crc32(str(r[0]).encode()) % 5)
    assert round(model.language.words) == words
    assert model.score("plain vexgrim here") > 0.5 > model.score("plain words there")


def test_workers_keep_nothing_of_a_task(spark, monkeypatch):
    # Word places, and freed memory that the allocators keep, count beside the memory of later stages.
    import os

    from netweave.llm import toxicity
    from netweave.llm.common import tidy

    def resident() -> int:
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")

    net = toxicity.ConvNet()
    model = toxicity.ToxicityModel(net, toxicity.WordLanguage({"en": np.ones(toxicity.LANG_TABLE)}))
    docs = spark.createDataFrame([(k, " ".join(f"word{k}x{j}" for j in range(50))) for k in range(200)], "doc_id long, text string").coalesce(1)

    def places(batches):
        for batch in batches:
            yield pd.DataFrame({"n": [len(toxicity._places)] * len(batch)})

    assert toxicity.drop_toxic(docs, model, limit=2.0).count() == 200
    assert toxicity.score(docs, model).count() == 200
    assert set(docs.coalesce(1).mapInPandas(places, "n long").toPandas()["n"]) == {0}

    before, most = resident(), []

    def each(batches):
        held = [bytes(1000) for _ in range(100_000)]
        most.append(resident())
        yield from batches
        held.clear()

    assert list(tidy(each, toxicity.forget)(iter([1, 2]))) == [1, 2]
    assert resident() - before < (most[0] - before) / 2


def test_driver_holds_little_of_a_training(spark, monkeypatch):
    # Texts of a training and whole nets in one result made the driver's heap grow by over 100 MB.
    from netweave.llm import toxicity

    docs = spark.createDataFrame([(k, f"plain words {'vexgrim' if k % 3 == 0 else 'there'} {k}", "en", int(k % 3 == 0)) for k in range(60)], "doc_id long, text string, lang string, toxic int")
    frame, sizes = type(docs), []

    def collect(self, whole=frame.collect):
        rows = whole(self)
        assert "text" not in self.columns
        sizes.append(sum(len(v) for r in rows for v in r if isinstance(v, str | bytes | bytearray)))
        return rows

    monkeypatch.setattr(frame, "collect", collect)
    model = toxicity.fit(docs, docs.select("doc_id", "toxic"))
    assert model.score("plain vexgrim here") > 0.5 > model.score("plain words there")
    bound = 4 * toxicity.PART * toxicity.AT_ONCE
    assert bound <= 1 << 21 and max(sizes) <= bound
    assert sum(sizes) >= 2 * 4 * model.net.size()


def test_driver_gives_memory_back_before_a_stage(spark, monkeypatch):
    from netweave.llm import common

    assert "native heap" in common.trim_native_heap(spark)
    asked = []
    monkeypatch.setattr(common, "trim_native_heap", asked.append)
    with common.stage(spark.range(1)):
        assert asked == [spark]
