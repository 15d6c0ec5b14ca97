"""Operators 5 and 9 next to their rules written out plainly."""

import random
from collections import Counter

import numpy as np
import pytest

from telespark.llm import language_id, order_minhash

M64 = (1 << 64) - 1


def plain_fingerprint(text):
    if not text:
        return list(range(order_minhash.SIZE))

    def mix(x):
        x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & M64
        return x ^ (x >> 29)

    k, seen, mers = min(order_minhash.K, len(text)), Counter(), []
    for i in range(len(text) - k + 1):
        mer, code = text[i:i + k], 0
        for letter in mer:
            code = (code * 0x9E3779B97F4A7C15 + ord(letter)) & M64
        code = mix(code)
        if seen[mer]:                                           # numbered by occurrence
            code = (code + (mix(seen[mer] + 1) << 1)) & M64
        seen[mer] += 1
        mers.append(mix(code))
    out = []
    for (factor,) in order_minhash._MULT.tolist():
        picked = sorted(range(len(mers)), key=lambda i: ((mers[i] * factor & M64) >> 32, i))[:order_minhash.ELL]
        mark = 0
        for i in sorted(picked):                                # back in the order of the text
            mark = mix((mark * 0xC2B2AE3D27D4EB4F + mers[i]) & M64)
        out.append(mark)
    return out


@pytest.mark.parametrize("text", ["", "a", "abcdef", "abcdefg", "aaaaaaaaaaaaaaaaaaaa", "x y z " * 40, "Größe ☃ 🙂 naïve 日本語テキスト " * 9])
def test_fingerprint_is_the_plain_rule(text):
    assert order_minhash.fingerprint(text).tolist() == plain_fingerprint(text)


def test_fingerprints_of_random_texts():
    rng = random.Random(5)
    for n in (3, 50, 400, 40_000):
        text = "".join(rng.choices("ab cdé", k=n))
        assert order_minhash.fingerprint(text).tolist() == plain_fingerprint(text)


# ------------------------------------------------------------------------------------------ operator 9

def grams(text):
    text = " " + " ".join(text.lower().split()) + " "
    return {text[i:i + n] for n in range(1, language_id.LONGEST + 1) for i in range(len(text) - n + 1)}


def kernel(a, b):
    return len(grams(a) & grams(b)) / np.sqrt(len(grams(a)) * len(grams(b)))


def labelled():
    rng, out = random.Random(9), []
    for lang, letters in (("x", "abcdeé"), ("y", "defghß"), ("z", "ghijkñ")):
        out += [(" ".join("".join(rng.choices(letters, k=rng.randint(2, 6))) for _ in range(rng.randint(3, 20))), lang) for _ in range(25)]
    return out


@pytest.mark.parametrize("product", [1 << 25, 0])
def test_values_are_the_plain_kernel_regression(monkeypatch, product):
    monkeypatch.setattr(language_id, "LANDMARKS", 7)
    monkeypatch.setattr(language_id, "PRODUCT", product)
    rows = labelled()
    model = language_id.Model([t for t, _ in rows], [g for _, g in rows])
    names = sorted({g for _, g in rows})
    label = np.array([names.index(g) for _, g in rows])
    marks = [t for g in names for t, h in [r for r in rows if r[1] == g][:7]]
    w, v = np.linalg.eigh(np.array([[kernel(a, b) for b in marks] for a in marks]))
    good = w > 1e-6 * w.max()
    half = v[:, good] / np.sqrt(w[good])
    z = np.c_[np.array([[kernel(t, b) for b in marks] for t, _ in rows]) @ half, np.ones(len(rows))]
    balance = (1 / np.bincount(label))[label][:, None]
    penalty = language_id.RIDGE * np.eye(z.shape[1])
    penalty[-1, -1] = 0
    beta = np.linalg.solve(z.T @ (balance * z) + penalty, z.T @ (balance * np.where(label[:, None] == np.arange(3), 1.0, -1.0)))
    tests = [*[t for t, _ in rows[::5]], "qqq www", "a", "abc def ghi jk " * 30]
    want = np.c_[np.array([[kernel(t, b) for b in marks] for t in tests]) @ half, np.ones(len(tests))] @ beta
    assert np.allclose(model.values([language_id.grams(t) for t in tests]), want, atol=2e-5)
    found, scores, _ = model.predict([None, "", "12 !", *tests])
    assert found[:3] == ["und"] * 3 and found[3:] == [names[k] for k in want.argmax(axis=1)]
    share = np.exp(language_id.SHARP / 2 * want)
    assert np.allclose(scores[3:], (share / share.sum(axis=1, keepdims=True)).max(axis=1), atol=1e-4)
