"""Addresses of any length."""

import random
import time

import numpy as np

from weftgraph.llm import pii


def test_zero_padded_addresses_count_whatever_their_length():
    for zeros in (0, 3, 3990, 4000, 9000):
        text = "at " + "0" * zeros + "1.1.1.1 or " + "0" * zeros + "256.1.1.1"
        assert [s for s in pii.base_spans(text) if s[0] == "ip"] == [("ip", 3, 3 + zeros + 7)]
    assert pii.base_spans("0" * 5000 + ".0.00.000")[0][0] == "ip"
    assert not pii.base_spans("x 1.1.1." + "9" * 5000 + " y" )


def test_long_and_hostile_texts_take_linear_time():
    began = time.time()
    for text in ("1" * 1_000_000, "1." * 300_000, "a" * 500_000 + " (at) b", "@" * 100_000, "a@" * 200_000, "+1 " * 200_000, "a@b.cc " * 50_000, "=" * 500_000):
        pii.detect([text])
    assert time.time() - began < 60
    assert pii.base_spans("7" * 1_000_000 + " 1.2.3.4")[-1] == ("ip", 1_000_001, 1_000_008)


def test_thresholds_are_the_lowest_that_keep_the_precision():
    rows = pii.labelled()
    order = np.random.default_rng(3).permutation(len(rows))
    held = [rows[i] for k, i in enumerate(order) if k % 4 == 3]
    p = pii.model().probability(np.array([pii.features(*r[:4]) for r in held]))
    for kind in pii.GENERATORS:
        mine = sorted(((p[i], r[4]) for i, r in enumerate(held) if r[1] == kind), reverse=True)
        limit = pii.model().limits[kind]
        taken = [y for q, y in mine if q >= limit]
        assert 0 < limit < 1 and sum(taken) >= pii.PRECISION * len(taken) and sum(taken) >= 0.75 * sum(y for _, y in mine)
        for q in {q for q, _ in mine if q < limit}:  # a lower threshold would take too many that are wrong
            lower = [y for r, y in mine if r >= q]
            assert sum(lower) < pii.PRECISION * len(lower)


def test_overlaps_match_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        spans = sorted((("x", a, a + rng.randrange(1, 9)) for a in (rng.randrange(60) for _ in range(rng.randrange(8)))), key=lambda s: s[1])
        blocked, taken, free = pii.covered(spans), pii.Taken(), []
        for _ in range(10):
            a = rng.randrange(60)
            b = a + rng.randrange(1, 9)
            assert blocked.free(a, b) == all(b <= x or y <= a for _, x, y in spans)
            fits = all(b <= x or y <= a for x, y in free)
            assert taken.add(a, b) == fits
            free += [(a, b)] * fits


def test_all_spans_match_brute_force():
    """The selection by plain loops over all candidates, on texts full of them."""
    rng = random.Random(6)
    bits = ["ssn 123-45-6789", 'token = "0f3a9b7c5d1e2f4a6b8c"', "call (555) 234-5678", "acct 12345678901", "a (at) b (dot) com", "1.2.3.4", "+1 555 234 5678", "of 99998888", "x: internationalization", "a@b.cd", "word"]
    for _ in range(60):
        text = " ".join(rng.choice(bits) for _ in range(12))
        base = pii.base_spans(text)
        free = [c for c in pii.candidates(text) if not any(c[1] < y and x < c[2] for _, x, y in base)]
        p = pii.model().probability(np.array([pii.features(text, *c) for c in free])) if free else []
        want = []
        for _, c in sorted(zip(p, free, strict=True), key=lambda z: (-round(float(z[0]), 9), z[1][1], pii.KINDS.index(z[1][0]))):
            score = p[free.index(c)]
            if score >= pii.model().limits[c[0]] and not any(c[1] < y and x < c[2] for _, x, y in want):
                want.append(c)
        assert pii.detect([text])[0][1] == sorted(base + want, key=lambda s: (s[1], pii.KINDS.index(s[0]), s[2]))
