"""Rows that every operator must take."""

import random


def words(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(n)]


def odd_rows() -> list[tuple]:
    """Nulls, empty and very long texts, copies, near copies, shared passages, repetition, odd characters."""
    base, passage = words(1, 300), words(2, 90)
    near = [*base[:150], "edit", *base[151:]]
    texts = [
        None, "", " \n\t ", "one", "One  two", "one two", " ".join(base), " ".join(base), " ".join(near), " ".join(base[:280]),
        " ".join(words(3, 100) + passage + words(4, 80)), " ".join(passage), "\n".join(words(5, 40) + passage), "la " * 400, "x" * 2000,
        " ".join(words(6, 30_000)), "İstanbul ΑΣ 中文 é <|endoftext|> \x00 \x1c don't", " ".join([*words(7, 60), *words(7, 60)]), "you IDIOT!!! " * 30,
        " ".join(words(9, 25)), " ".join(words(9, 25)).upper(), "▁ a",
    ]
    rows = [(3 * i + 1, t) for i, t in enumerate(texts)]
    rows += [(7, texts[2]), (19, texts[6]), (None, texts[6]), (None, None), (1000, texts[10]), (-5, texts[13])]
    return [(i, t, "clash", None, "x", 1) for i, t in rows]
