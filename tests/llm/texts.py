"""Texts that every operator must take, and small helpers."""

import os
import random

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def prose(seed: int, words: int, vocabulary: int = 3000) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words))


ODD = [
    (1, None),
    (2, ""),
    (3, " \t\n\x0b "),
    (4, "a"),
    (5, "é😀 ▁ \x1c\x85  <s> <|endoftext|> \x00"),
    (None, "no id here"),
    (6, "again and again"),
    (6, "again and again"),
    (7, prose(7, 30_000)),
    (8, "x" * 20_000),
]
