"""The language net: responses and gradients against plain ones, held-out accuracy, odd rows."""

import numpy as np
from conftest_rows import ROWS

from tidemart.llm import language_net as L
from tidemart.llm.tables import read


def small_net(langs=("a", "b", "c")):
    random = np.random.default_rng(3)
    x = random.integers(97, 123, (40, L.LENGTH)).astype(np.uint8)
    y = np.arange(40) % len(langs)
    for i, c in enumerate(y):
        x[i, 10 * c:10 * c + 4] = [200 + c] * 4
    return L.train(x, y, list(langs), epochs=30), x, y


def test_tables_give_what_the_layers_give():
    net, x, y = small_net()
    h = []
    for w, b in zip(net.filters, net.bias):
        seen = net.embed[x]  # rows, places, depth
        n = L.LENGTH - len(w) + 1
        h.append(sum(seen[:, i:i + n] @ w[i] for i in range(len(w))).max(axis=1) + b)
    z = np.maximum(np.concatenate(h, axis=1), 0) @ net.out + net.out_bias
    plain = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    got = net.probabilities(x, net.tables())
    assert np.allclose(got, plain, atol=1e-4) and (got.argmax(axis=1) == y).all()
    assert net.probabilities(x[:0], net.tables()).shape == (0, 3)


def test_windows_hold_the_whole_text():
    for n in (0, 1, L.LENGTH, L.LENGTH + 1, 5 * L.LENGTH - 1):
        data = bytes(97 + i % 26 for i in range(n))
        assert L.windows(data).tobytes().rstrip(b"\0") == data and len(L.windows(data)) == max(1, -(-n // L.LENGTH))
    assert L.as_bytes("Ab-Ü 9") == "ab ü  ".encode()


def test_held_out_accuracy(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    net = L.fit(docs)
    known = {r.doc_id: r.lang for r in docs.collect()}
    rows = L.predict(docs, net).collect()
    held = [r.lang_pred == known[r.doc_id] for r in rows if r.held_out]
    assert len(rows) == len(known) and len(held) > 150 and np.mean(held) >= 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    # Neither language, source nor id count: other values give the same answers.
    other = docs.selectExpr("doc_id + 1000000 AS doc_id", "text", "'zz' AS lang", "'s' AS source")
    assert ({(r.doc_id - 1000000, r.lang_pred, r.score) for r in L.predict(other, net).collect()}
            == {(r.doc_id, r.lang_pred, r.score) for r in rows})


def test_odd_rows(spark, messy, empty):
    odd = messy.selectExpr("*", "CASE WHEN doc_id < 8 THEN 'x' WHEN doc_id < 11 THEN 'y' END AS lang", "1 AS held_out", "2 AS score")
    rows = L.predict(odd, L.fit(odd)).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        text = next(t for i, t, *_ in ROWS if i == r.doc_id and (i is not None or (t is None) == (r.lang_pred == L.UNKNOWN)))
        assert (r.lang_pred == L.UNKNOWN) == (not text or not text.strip()) and 0 <= r.score <= 1
    nothing = empty.selectExpr("*", "CAST(NULL AS STRING) AS lang")
    assert L.fit(nothing) is None and L.predict(nothing, None).count() == 0
    assert {(r.lang_pred, r.score) for r in L.predict(odd, None).collect()} == {(L.UNKNOWN, 0.0)}
    one = odd.where("lang = 'x'")
    assert {r.lang_pred for r in L.predict(odd, L.fit(one)).collect()} == {"x", L.UNKNOWN}
    digits = spark.createDataFrame([(1, "1234 _ -"), (2, "٣٤")], "doc_id INT, text STRING")
    assert {r.lang_pred for r in L.predict(digits, L.fit(odd)).collect()} == {L.UNKNOWN}
