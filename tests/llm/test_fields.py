"""The semi-Markov field: its sums side by side, and what it finds that no pattern does."""

import numpy as np

from ambulo.llm import pii


def test_sums_side_by_side_equal_those_of_each_zone():
    rng = np.random.default_rng(7)
    for _ in range(20):
        examples = []
        for _ in range(int(rng.integers(1, 6))):
            n = int(rng.integers(1, 9))
            spans = sorted({(int(i), int(rng.integers(i + 1, n + 1))) for i in rng.integers(0, n, 6)})
            examples.append((n, [(i, j, [f"f{int(rng.integers(0, 4))}", "bias"]) for i, j in spans], [(*spans[0], int(rng.integers(1, 5)))]))
        held = pii.Lattices(examples)
        weights, step = rng.normal(size=(len(held.features), 4)), rng.normal(size=(5, 5))
        names = ("out", *pii.KINDS)
        field = pii.Field({(k, f): weights[i, c] for f, i in held.features.items() for c, k in enumerate(pii.KINDS)} | {(a, b): step[p, q] for p, a in enumerate(names) for q, b in enumerate(names)})
        chances, pairs = held.expected(weights, step)
        row, total = 0, np.zeros((5, 5))
        for n, segments, _ in examples:
            _, want, own = field.sums(n, field.arcs(n, segments))
            total += own
            for i, j, _ in segments:
                assert np.allclose(chances[row], [want.get((i, j, k), 0.0) for k in range(1, 5)], atol=1e-9)
                row += 1
        assert np.allclose(pairs, total, atol=1e-9)


def test_held_out_entities_in_disguise_are_found(spark):
    """Of texts that are not learnt from: nine of ten disguised entities, and hardly anything beside them."""
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("text rlike '[0-9@]'").orderBy("doc_id").select("text").collect()]
    field = pii.train([e for t in texts[::2] for e in pii.lessons(t)])
    there = found = wrong = beside = base = 0
    for t in texts[1::2]:
        shown, spans = pii.disguised(t, 7)
        known = set(pii.base_spans(shown))
        planted = set(spans) - known
        got = set(pii.added_spans(shown, field, sorted(known, key=lambda s: s[0])))
        there, found, wrong = there + len(planted), found + len(got & planted), wrong + len(got - set(spans))
        plain = pii.base_spans(t)
        base, beside = base + len(plain), beside + len(pii.added_spans(t, field, plain))
    assert there > 200 and found >= 0.9 * there and wrong <= 0.05 * found and beside <= 0.05 * base


def test_variants_hold_the_same_digits():
    for kind, shown in (("phone", "+1 (269) 555-3296"), ("card", "4524132264652876"), ("ip", "10.0.20.1")):
        digits = [c for c in shown if c.isdigit()]
        for draw in range(12):
            got = [c for c in pii.variant(kind, shown, draw) if c.isdigit()]
            assert "".join(digits).endswith("".join(got)) or "".join(got).endswith("".join(digits))
    assert pii.variant("email", "bob@mail.example.com", 0) == "bob@mail-example" and "@" in pii.variant("email", "a@b.c", 1)
    text, spans = pii.disguised("call +1 (269) 555-3296 or bob@mail.example.com")
    assert [k for _, _, k in spans] == ["phone", "email"] and all(0 <= a < b <= len(text) for a, b, _ in spans)
