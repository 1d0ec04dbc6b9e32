"""Deterministic stand-ins for models; workers import them, so this module imports nothing of the catalogue."""

from __future__ import annotations


def letter_counts(texts):
    """A deterministic stand-in for a second encoder: how often each letter a-z occurs."""
    return [[float(t.count(chr(97 + i))) for i in range(26)] for t in texts]


def plain_decision(texts):
    """A deterministic stand-in for a model: buys what trends upwards."""
    return [(("BUY" if "UPTREND" in t else "HOLD") + f" {len(t)}", True) for t in texts]


def plain_sentiment(texts):
    return ["confident, optimistic" if t.startswith("BUY") else "cautious" for t in texts]
