"""Awkward rows that every operator must take: nulls, empty and long texts, repeats, extra columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, slot long, path string"


def rows(n: int = 120, seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 120))) + ".\n" + " ".join(rng.choice(words) for _ in range(30)) for _ in range(n)]
    texts[3] = texts[4] = texts[5]  # copies
    near = texts[6].split(" ")
    near[len(near) // 2] = "changed"
    texts[7] = " ".join(near)
    texts[8], texts[9], texts[10], texts[11] = None, "", " \n\t ", "one"
    texts[12] = "long " * 60_000
    texts[13] = "x" * 100_000
    texts[14] = "\x00﻿ 𝒳 ▁ <|endoftext|>   \x1c"
    out = [(i, t, "en", "src0", len(t) if t else None, 0.5, 1, 2, "p") for i, t in enumerate(texts)]
    return [*out, (n, None, None, None, None, None, None, None, None)]


def frame(spark, **kw):
    return spark.createDataFrame(rows(**kw), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
