"""Addresses of operator 1 against the pattern that says what they are, and texts without blanks."""

import random
import re
import time

from demandlens.llm.pii import Pseudonyms

EMAIL = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}")


def test_equals_the_pattern():
    names, rng = Pseudonyms(b"k"), random.Random(4)
    found = 0
    for _ in range(30_000):
        text = "".join(rng.choice(["a", "B3", ".", "_", "-", "@", " ", "é", "x@y", ".com", ".co.uk", "@a-b"]) for _ in range(rng.randint(0, 14)))
        want = [m.span() for m in EMAIL.finditer(text)]
        found += len(want)
        assert list(names.emails(text)) == want, text
    assert found > 3000


def test_a_megabyte_without_blanks():
    rng = random.Random(5)
    letters = "".join(rng.choice("abcdefXYZ+") for _ in range(1_000_000))
    for text in (letters + " me@x.org", "a@" + letters, letters[:500_000] + "@" + letters[500_000:] + ".com", "a.b-" * 250_000 + "@", "@" * 100_000 + "a@b.co"):
        began = time.perf_counter()
        out, _ = Pseudonyms(b"k").text(text)
        assert time.perf_counter() - began < 5 and len(out) >= len(text) - 20
