"""Invented prose for fixtures."""

WORDS = [a + b for a in "bcdfghlmnprst" for b in ("an", "et", "ix", "ol", "um", "ara", "eno")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))
