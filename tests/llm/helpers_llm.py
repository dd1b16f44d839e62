"""Invented prose for the tests."""

import random

#: words of an invented language; `the`, `of`, `and` are frequent
WORDS = [a + b for a in ("tha", "ero", "ino", "ble", "shu", "onda", "kri", "velu") for b in ("ti", "re", "nd", "ou", "st", "mek", "lor", "pan", "zi", "gum")]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(("the", "of", "and")) if r.random() < 0.3 else r.choice(WORDS) + r.choice(WORDS) for _ in range(n))


def edited(text, seed, n):
    r, words = random.Random(seed), text.split(" ")
    for _ in range(n):
        words[r.randrange(len(words))] = r.choice(WORDS) + "x"
    return " ".join(words)
