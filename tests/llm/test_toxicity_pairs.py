"""op10 with its own defaults on pairs whose parts are mostly harmless alone."""

import random

import numpy as np
import pytest

from quillmere.llm.toxicity import Machine, _TermMemo, learn, term_hashes

KINDS = {
    # words, label, texts
    "a mention beside an insult": [(["vile", "folk"], 1, 60), (["vile"], 0, 120), (["folk"], 0, 480), (["scum"], 1, 140), ([], 0, 1200)],
    "two harmless words": [(["gate", "lamp"], 1, 60), (["gate"], 0, 500), (["lamp"], 0, 500), (["scum"], 1, 60), ([], 0, 880)],
}


@pytest.mark.parametrize("kind", KINDS)
def test_pairs_of_mostly_harmless_parts(spark, kind):
    rng, rows = random.Random(2), []
    for own, label, n in KINDS[kind]:
        rows += [(" ".join(rng.choices([f"n{chr(97 + k)}xyz" for k in range(26)], k=12) + own), label) for _ in range(n)]
    rng.shuffle(rows)
    told, held = rows[:1500], rows[1500:]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(told)], "doc_id long, text string")
    machine = learn(docs, spark.createDataFrame([(i, y) for i, (_, y) in enumerate(told)], "doc_id long, toxic int"))
    memo = _TermMemo()
    for word in KINDS[kind][0][0]:
        assert len(machine.places(term_hashes(memo, word))) > 0
    y = np.array([y for _, y in held])
    right = lambda m: np.mean((m.raw([m.places(term_hashes(memo, t)) for t, _ in held]) >= np.log(0.3 / 0.7)) == y)
    assert right(machine) >= 0.98
    # The pairs are learned by the vectors: the same machine without them does not tell.
    assert right(Machine(machine.terms, machine.bias, machine.weights, 0 * machine.vectors)) < right(machine) - 0.01
