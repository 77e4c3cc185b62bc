"""The byte network against plain versions of its parts."""

import numpy as np

from episodica.llm import language
from episodica.llm.byte_cnn import EMBEDDING, FILTERS, WIDTHS, WINDOW, Network


def plain_logits(net, window):
    """One window, filter by filter."""
    pooled = []
    for f, b in zip(net.filters, net.bias):
        for k in range(FILTERS):
            z = [sum(float(net.embedding[window[i + j]] @ f[j, :, k]) for j in range(len(f))) + float(b[k]) for i in range(WINDOW - len(f) + 1)]
            pooled.append(max(0.0, max(z)))
    return np.array(pooled) @ net.out + net.out_bias


def test_folded_tables_give_the_logits_of_the_plain_network():
    net = Network(["a", "b", "c"])
    net.bias = [np.linspace(-1, 1, FILTERS).astype(np.float32) for _ in WIDTHS]
    net.fold()
    x = np.random.default_rng(1).integers(0, 256, (5, WINDOW)).astype(np.uint8)
    got = net.logits(x)
    assert np.allclose(got, [plain_logits(net, w) for w in x], atol=1e-4)


def test_gradients_against_differences():
    net = Network(["a", "b"])
    r = np.random.default_rng(2)
    x, y = r.integers(97, 123, (4, WINDOW)).astype(np.uint8), np.array([0, 1, 1, 0])

    def loss():
        z = np.array([plain_logits(net, w) for w in x])
        return float(np.mean([np.log(np.exp(v).sum()) - v[k] for v, k in zip(z, y)]))

    for values, slope in zip(net.parameters(), net.gradients(x, y)):
        at = np.unravel_index(np.abs(slope).argmax(), slope.shape)
        held, step = values[at].copy(), 1e-3
        values[at] = held + step
        up = loss()
        values[at] = held - step
        down = loss()
        values[at] = held
        assert abs((up - down) / (2 * step) - slope[at]) < 0.1 * abs(slope[at]) + 5e-4
    assert net.embedding.shape == (256, EMBEDDING)


def test_texts_without_a_letter_are_undetermined(spark):
    rows = [(k, t, "en" if k % 2 else "de", "s", "x") for k, t in enumerate(["the cat and the dog went home", "der Hund und die Katze gehen heim"] * 20)]
    rows += [(100, "½ ² ① 12", "en", "s", "x"), (101, "é", None, "s", "x"), (None, "the cat", "en", "s", "x"), (None, "the cat", "en", "s", "x")]
    got = language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, hash string")).collect()
    said = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and said[100].lang_pred == "und" and said[100].score == 0.0 and said[101].lang_pred in ("en", "de")


def test_no_label_is_left_out(spark):
    """More labels than the bound on texts leaves room for: each still gives one."""
    rows = [(k, f"{chr(97 + k % 26) * 30} {k}", f"l{k % 26:02d}") for k in range(400)]
    net = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most=26 * 8)
    assert len(net.labels) == 26


def test_labels_of_which_less_than_a_text_is_drawn(spark):
    """Three hundred labels, and room for six texts in all."""
    rows = [(k, f"{chr(97 + k % 26)}{chr(97 + k % 23)} " * 20 + str(k), f"l{k % 300:03d}") for k in range(3000)]
    net = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most=6)
    assert len(net.labels) == 300
