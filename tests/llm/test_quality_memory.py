"""What the fit of the quality model holds on the driver."""

import tracemalloc

import numpy as np

from bookfeel.llm import quality


def test_fit_holds_little_beside_the_slots():
    draw = np.random.default_rng(3)
    labels = draw.integers(0, 2, 1500)
    rows = [np.unique(draw.integers(0, 40000, 1500) + 20000 * y).astype("<u2") for y in labels]
    aside = draw.random(1500) < 0.2
    tracemalloc.start()
    model = quality.fit_rows(rows, labels, aside)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * sum(map(np.ndarray.__sizeof__, rows)) + 4 * 8 * quality.SIZE  # was ten times the slots
    wide = quality.fit_rows([x.astype(np.int64) for x in rows], labels, aside)
    assert (model.weights == wide.weights).all() and model.slope == wide.slope
    margins = np.array([model.margin(x) for x in rows])
    assert margins[labels == 1].mean() > margins[labels == 0].mean()
