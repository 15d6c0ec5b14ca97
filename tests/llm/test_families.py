"""Settling families of near copies: what is verified, and that it joins what brute force joins."""

import random

import numpy as np
import pytest

from telespark.llm import near_dedup


def family(n, kinds=40, seed=3):
    """Texts of one template in many kinds, most of them a little too far from each other; some repeat shingles."""
    draw = random.Random(seed)
    base = [f"w{draw.randrange(4000)}" for _ in range(200)]
    texts = []
    for i in range(n):
        words, kind, own = list(base), random.Random(1000 + i % kinds), random.Random(9000 + i)
        for _ in range(kind.choice((3, 4, 5))):
            words[kind.randrange(200)] = f"k{i % kinds}-{kind.randrange(999)}"
        words[own.randrange(200)] = f"own{i}"
        texts.append(" ".join(words + words[:12] if i % 9 == 0 else words))
    return texts


def joined(of, links):
    """Components by brute force, as the smallest member of each."""
    label = list(of)
    for a, b in links:
        x, y = label[a], label[b]
        if x != y:
            label = [min(x, y) if v in (x, y) else v for v in label]
    return [label.index(v) for v in label]


@pytest.mark.parametrize("crossing", [False, True])
def test_few_pairs_are_verified_and_no_link_is_lost(monkeypatch, crossing):
    texts = family(120)
    nodes, of = [b"%03d" % i for i in range(120)], [i if i % 3 else i % 40 for i in range(120)]
    side = np.array([crossing and i % 2 == 1 for i in range(120)])
    bags = [near_dedup.shingles([t])[1:] for t in texts]
    real, calls = near_dedup.probability_jaccard, []
    pairs = [(i, j) for i in range(120) for j in range(i) if not crossing or side[i] != side[j]]
    near = {p for p in pairs if real(bags[p[0]], bags[p[1]]) >= 0.8}
    monkeypatch.setattr(near_dedup, "probability_jaccard", lambda *x: calls.append(1) or real(*x))
    for registers in (None, near_dedup.long_registers(texts)):
        calls.clear()
        links = [(int(a), int(b)) for a, b in near_dedup.settle(nodes, [b"%03d" % x for x in of], side, texts, 0.8, registers)]
        assert all((max(x), min(x)) in near for x in links)
        assert joined(of, links) == joined(of, sorted(near))
        repeating = sum(1 for i, j in pairs if i % 9 == 0 or j % 9 == 0)
        assert len(calls) <= repeating + len(near) < len(pairs) / 2


def test_pairs_that_may_reach_are_those_that_do():
    texts = family(80)
    i, j = np.triu_indices(80, 1)
    may = near_dedup.may_reach(texts, i, j, 0.8)
    bags = [near_dedup.shingles([t])[1:] for t in texts]
    does = np.array([near_dedup.probability_jaccard(bags[x], bags[y]) >= 0.8 for x, y in zip(i, j)])
    plain = (i % 9 != 0) & (j % 9 != 0)
    assert (may | ~does).all() and (may[plain] == does[plain]).all() and 0 < does.sum() < len(i)
    assert near_dedup.may_reach(["", *texts], np.append(i, 0), np.append(j, 1), 0.8).all()      # a text without words: nothing is told
