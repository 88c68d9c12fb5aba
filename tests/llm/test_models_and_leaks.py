"""The byte network against plain loops, the licence scan's cost, and benchmark leaks against a search of all pairs."""

import math
import time

import numpy as np
from conftest import DATA

from auditspark.llm import decontaminate as D
from auditspark.llm import langid as N
from auditspark.llm import licenses as C


def forward(model, window):
    """Log probabilities of one window, by loops."""
    data = [*window, *[0] * (max(N.WIDTHS) - 1)]
    hidden = []
    for f in range(N.FILTERS * len(N.WIDTHS)):
        width = N.WIDTHS[f // N.FILTERS]
        best = max(sum(float(model.embed[data[at + i]][e]) * float(model.filters[i * N.EMBED + e][f]) for i in range(width) for e in range(N.EMBED)) for at in range(len(window)))
        hidden.append(max(0.0, best + float(model.bias[f])))
    z = [sum(h * float(model.out[i][k]) for i, h in enumerate(hidden)) + float(model.out_bias[k]) for k in range(len(model.labels))]
    top = max(z)
    norm = top + math.log(sum(math.exp(v - top) for v in z))
    return [v - norm for v in z]


TEXTS = ["the old man and the sea", "der alte Mann und das Meer", "le vieil homme et la mer", "x"]


def test_network_equals_loops():
    model = N.train(TEXTS, ["en", "de", "fr", "en"], steps=5)
    windows = np.concatenate([N.windows_of(t.encode()) for t in TEXTS])
    expected = np.array([forward(model, w.tolist()) for w in windows])
    assert np.abs(model.log_probabilities(windows) - expected).max() < 1e-4


def test_gradients_equal_differences():
    """Adam's first step moves each parameter against the sign of its gradient: that of finite differences of the loss."""
    labels = ["en", "de", "fr", "en"]
    before, after = N.train(TEXTS, labels, steps=0), N.train(TEXTS, labels, steps=1)
    # The batch that the step draws: parameters come first from the same generator.
    rng = np.random.default_rng(3)
    for shape in (before.embed.shape, before.filters.shape, before.out.shape):
        rng.normal(0, 1, shape)
    rows = rng.choice(len(TEXTS), N.BATCH, p=np.full(len(TEXTS), 1 / len(TEXTS)))
    windows, y = np.concatenate([N.windows_of(TEXTS[r].encode()) for r in rows]), np.array([before.labels.index(labels[r]) for r in rows])
    weight = np.array([4 / (3 * labels.count(name)) for name in before.labels])

    def loss(**changed):
        model = N.ByteConv(before.labels, **{n: changed.get(n, getattr(before, n).astype(np.float64)) for n in ("embed", "filters", "bias", "out", "out_bias")})
        return -(model.log_probabilities(windows)[np.arange(len(y)), y] * weight[y]).mean()

    rng, checked = np.random.default_rng(0), 0
    for name in ("embed", "filters", "bias", "out", "out_bias"):
        value = getattr(before, name).astype(np.float64)
        for flat in rng.permutation(value.size)[:400]:
            spot = np.unravel_index(flat, value.shape)
            up, down = value.copy(), value.copy()
            up[spot] += 1e-4
            down[spot] -= 1e-4
            slope = (loss(**{name: up}) - loss(**{name: down})) / 2e-4
            if abs(slope) > 1e-3 and not (name == "embed" and spot[0] == 0) and not (name == "filters" and not N.ByteConv.mask()[spot]):
                assert np.sign(getattr(before, name)[spot] - getattr(after, name)[spot]) == np.sign(slope), (name, spot, slope)
                checked += 1
    assert checked > 150
    assert (after.embed[0] == 0).all() and (after.filters[N.ByteConv.mask() == 0] == 0).all()


def least_edits(item, text):
    """Least edits of the item against any run of the text's words: a table row an item's word, over all places at once."""
    places = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for n, word in enumerate(item, 1):
        step = np.minimum(np.concatenate([[n], row[:-1] + (text != word)]), np.concatenate([[n], row[1:] + 1]))
        row = np.minimum.accumulate(step - places) + places
    return int(row.min())


def test_leaks_equal_a_search_of_all_pairs(spark):
    """Every (document, item) pair of the small tables: what is found is a leak, and few leaks are missed."""
    docs, benchmark = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "benchmark"))
    numbers: dict[str, int] = {}
    words = lambda text: np.array([numbers.setdefault(w, len(numbers)) for w in D.TOKEN.findall((text or "").lower())], np.int64)
    items = [(r.item_id, words(r.text)) for r in benchmark.collect()]
    texts = [(r.doc_id, words(r.text)) for r in docs.collect()]
    expected = {}
    for doc, text in texts:
        for item, asked in items:
            limit = D.edits_allowed(len(asked), 0.2)
            if len(asked) and (edits := least_edits(asked, text)) <= limit:
                expected[doc, item] = edits
    found = {(r.doc_id, r.item_id): r.edits for r in D.find_leaks(docs, benchmark).collect()}
    assert set(found) <= set(expected) and all(edits >= expected[pair] for pair, edits in found.items())
    assert len(set(found) & set(expected)) >= 0.95 * len(expected) and len(expected) >= 3
    assert all(found[pair] == 0 for pair, edits in expected.items() if edits == 0 and pair in found)


def test_licence_lines_are_linear():
    known = C.Templates(C.TEMPLATES, {w: 1.0 for _, text in C.TEMPLATES for w in C.words_of(text)})
    text = "\n".join(f"Licensed under the MIT License, file {i}" for i in range(20_000))
    began = time.process_time()
    found = [b for b in C.blocks_of(text) if known.score(b, 0.6)]
    assert len(found) >= 20_000 and time.process_time() - began < 20


def test_terms_of_texts_are_counted_once(spark, monkeypatch, tmp_path):
    """Also where the join with the totals is split: each text is read once for them."""
    import uuid

    from auditspark.llm import common, pii

    monkeypatch.setattr(common, "FEW_ROWS", 0)
    real, folder = pii.count_terms, str(tmp_path)

    def run(batches):
        for batch in batches:
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as out:
                out.write(str(batch.num_rows))
            yield batch

    monkeypatch.setattr(pii, "count_terms", lambda rows, terms: real(rows.mapInArrow(run, rows.schema), terms))
    # Words that occur once, each beside an address of its own, in a corpus large enough for them to disclose it.
    rows = [(i, f"only{chr(97 + i // 26)}{chr(97 + i % 26)} a{i}@b.example") for i in range(60)] + [(100, "filler " * 60_000)]
    found = pii.scan_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == 61 and sum(len(r.terms) for r in found) == 60
    assert sum(int(f.read_text()) for f in tmp_path.iterdir()) == 61
