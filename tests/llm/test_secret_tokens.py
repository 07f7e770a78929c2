"""Secret scans score every token, whatever its length and characters."""

import random
import re
import string

import numpy as np

from strideflow.llm import secrets

SENTENCES = (
    "The ordinary Identifier_name and another-long-name of things are plain words in This text, Anna and Bob said. "
    "In 1999 and 2024 about 12345 people of New York read getElementById in README files, while OPEN SOURCE grew by 17 percent. "
)


def test_random_letters_digits_and_short_keys_are_found(docs_of):
    rng = random.Random(9)
    keys = ["".join(rng.choices(string.ascii_letters, k=16)) for _ in range(10)]
    keys += ["".join(rng.choices(string.ascii_letters, k=40)) for _ in range(10)]
    keys += ["".join(rng.choices(string.ascii_lowercase, k=40)) for _ in range(5)]
    keys += ["".join(rng.choices(string.ascii_letters + string.digits, k=12)) for _ in range(5)]
    prose = SENTENCES * 40
    out = {r.doc_id: r for r in secrets.scan_secrets(docs_of([(i, f"{prose}é {k} {prose}") for i, k in enumerate(keys)])).collect()}
    at = len(prose) + 2
    found = [out[i].spans == f"markov:{at}:{at + len(k)}" for i, k in enumerate(keys)]
    assert all(found), [k for k, ok in zip(keys, found) if not ok]


def plain(text, ratio, least, least_mean):
    code = {c: i for i, c in enumerate(secrets.ALPHABET)}
    for m in re.finditer(r"[A-Za-z0-9+/_=-]+", text):
        score = sum(ratio[code[a] * secrets.SIZE + code[b]] for a, b in zip(m[0], m[0][1:]))
        if score >= max(least, least_mean * (len(m[0]) - 1)):
            yield m.start(), 3, m.end()


def test_spans_equal_a_plain_scan():
    rng = random.Random(2)
    ratio = np.array([rng.choice([-1.0, 0.5, 2.0]) for _ in range(secrets.PAIRS)])
    hits = 0
    for _ in range(3000):
        text = "".join(rng.choice("abZ09+/_=-. é😀\n\0") if rng.random() < 0.3 else rng.choice("abZ09") for _ in range(rng.randrange(40)))
        want = list(plain(text, ratio, 3.0, 0.5))
        hits += len(want)
        assert secrets.method_spans(text, ratio, 3.0, 0.5) == want, text
    assert hits > 1000
