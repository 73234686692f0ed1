"""Language ID: gradients against differences, windows against whole texts, held-out accuracy, and edges."""

import zlib

import numpy as np
import pytest

from tidemark.llm import language


def test_gradient_matches_differences():
    """Backpropagation through time agrees with finite differences for every kind of weight."""
    rng = np.random.default_rng(1)
    net = language.Network.fresh(["a", "b", "c"], hidden=3, kind=np.float64)
    x = rng.integers(97, 103, (4, 7)).astype(np.uint8)
    y, counted = np.array([0, 2, 1, 2]), rng.random((4, 7)) < 0.8
    _, grad = net.gradient(x, y, counted)
    for name, w in net.weights.items():
        places = np.argwhere(np.abs(grad[name]) > 0)
        assert len(places)
        for at in map(tuple, places[rng.choice(len(places), min(6, len(places)), replace=False)]):
            held = w[at]
            w[at] = held + 1e-5
            up = net.gradient(x, y, counted)[0]
            w[at] = held - 1e-5
            down = net.gradient(x, y, counted)[0]
            w[at] = held
            assert grad[name][at] == pytest.approx((up - down) / 2e-5, rel=1e-4, abs=1e-9)


def test_states_match_the_equations():
    net = language.Network.fresh(["a", "b"], hidden=4, kind=np.float64)
    text = np.frombuffer(b"some text", np.uint8)
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    for side, order in (("f", range(9)), ("b", range(8, -1, -1))):
        w, u, h = net.weights["w" + side], net.weights["u" + side], np.zeros(4)
        got = net.states(text[None, :], side)
        for t in order:
            g, s = w[:, text[t]], u @ h
            r, z = sigmoid(g[:4] + s[:4]), sigmoid(g[4:8] + s[4:8])
            h = (1 - z) * np.tanh(g[8:] + r * s[8:]) + z * h
            assert got[:, t, 0] == pytest.approx(h)


def test_windows_cover_each_letter_once():
    texts = [b"", b"A", b"x" * 96, b"y" * 97, b"z1 " * 1000, "é".encode() * 100]
    x, of, counted = language.windows(texts)
    assert x.shape[1] == 96
    for i, t in enumerate(texts):
        mine = np.flatnonzero(of == i)
        assert counted[mine].sum() == sum(language._LETTER[b] for b in t)
        assert len(mine) == -(-max(len(t), 96) // 96) if t else not len(mine)


@pytest.fixture(scope="module")
def net(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return language.fit(docs, texts=150, steps=150)


def test_held_out_accuracy(spark, net):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    read = language.predict(docs, net)
    at = docs.columns.index
    rows = read.where(language.held_out(read[f"c{at('doc_id')}"])).collect()
    assert len(rows) == sum(zlib.crc32(str(r[0]).encode()) % 4 == 2 for r in docs.select("doc_id").collect()) > 150
    right = np.mean([r[f"c{at('lang')}"] == r["lang_pred"] for r in rows])
    assert right >= 0.98
    assert all(0 <= r["lang_score"] <= 1 for r in rows)


def test_pooling_matches_one_text_at_a_time(net):
    """Texts that share a batch don't touch each other; probabilities are means over a text's letters."""
    texts = [b"The words of the one", b"", "où est la été".encode() * 40, b"12 34"]
    both = language.pooled(net, texts)
    for t, p in zip(texts, both):
        assert language.pooled(net, [t])[0] == pytest.approx(p, abs=1e-5)
    x, _, counted = language.windows([texts[0]])
    assert both[0] == pytest.approx(net.labels(x)[:, counted[0], 0].mean(1), abs=1e-5)
    assert both[1].sum() == 0 and both[3].sum() == 0


def test_edges(spark, edges, nothing, net):
    """One row per row; null, blank and letterless texts are unknown; nothing but the text counts."""
    rows = language.predict(edges, net).collect()
    assert len(rows) == edges.count()
    for r in rows:
        text = r["c2"]
        known = bool(text) and any(c.isalpha() for c in text)
        assert (r["lang_pred"] in net.langs) == known and (r["lang_pred"] == "und") == (not known)
        assert (r["lang_score"] > 0) == known
    by_text = {}
    for r in rows:
        assert by_text.setdefault(r["c2"], r["lang_pred"]) == r["lang_pred"]
    assert language.predict(nothing, net).count() == 0
    assert language.fit(nothing) is None
    assert {r["lang_pred"] for r in language.predict(edges, None).collect()} == {"und"}


def test_sample_is_bounded_and_never_held_out(spark):
    rows = [(i, f"text number {i % 50}", "en") for i in range(400)] + [(i, "der Text", "de") for i in range(400, 404)]
    rows += [(None, "no id", "en"), (900, None, "en"), (901, "12", "en"), (902, "lang is null", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.sample(docs, texts=20).collect()
    held = {t for i, t, _ in rows if i is not None and zlib.crc32(str(i).encode()) % 4 == 2}
    free = {(lang, t) for i, t, lang in rows if i is not None and t and lang and zlib.crc32(str(i).encode()) % 4 != 2}
    assert len(got) <= 21 and len([r for r in got if r["lang"] == "en"]) == 20 and len({tuple(r) for r in got}) == len(got)
    assert {tuple(r) for r in got} <= free and held
