"""Training goes on until the states differ."""

import numpy as np

from tessera.llm import hmm


def test_held_out_likelihood_beats_the_unigram(spark):
    """Sequences that stay a while in one of two sets of classes: nothing that one class alone tells."""
    rng = np.random.default_rng(6)

    def sequence():
        stays = np.cumsum(rng.random(300) < 0.05) % 2
        return (rng.integers(0, 8, 300) + 8 * stays).astype(np.uint8)

    rows, held = [sequence() for _ in range(60)], [sequence() for _ in range(20)]
    trace = []
    model = hmm.train(spark.createDataFrame([(x.tobytes(),) for x in rows], "classes binary").repartition(3), 2, trace=trace)
    flat = np.concatenate(held)
    unigram = np.log10(np.bincount(np.concatenate(rows), minlength=16) / 300 / 60)[flat].mean()
    got = model.log10(flat, np.arange(21) * 300).sum() / len(flat)
    assert got > unigram + 0.15
    assert 1 < len(trace) < hmm.ROUNDS and trace[-1] - trace[-2] < hmm.TOLERANCE
