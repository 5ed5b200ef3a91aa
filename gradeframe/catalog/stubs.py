"""Deterministic stand-ins for a model: the output depends only on prompt and sample number."""

import hashlib


def _digit(prompt: str, sample: int) -> int:
    return int(hashlib.md5(f"{prompt}|{sample}".encode()).hexdigest()[0], 16)


def decision_model():
    def run(prompts, n):
        return [[_decision(_digit(p, i)) for i in range(n)] for p in prompts]

    return run


def _decision(digit: int) -> str:
    if digit < 7:
        return "<decision>SELF_SOLVE</decision>"
    return "I would delegate." if digit < 14 else "unsure"


def number_model():
    def run(prompts, n):
        return [[f"so \\boxed{{{_digit(p, i) % 5}}}" for i in range(n)] for p in prompts]

    return run


def letter_model():
    def run(prompts, n):
        return [[f"\\boxed{{{chr(65 + _digit(p, i) % 4)}}}" for i in range(n)] for p in prompts]

    return run


def text_model():
    def run(prompts, n):
        return [
            [hashlib.md5(f"{p}|{i}".encode()).hexdigest() for i in range(n)] for p in prompts
        ]

    return run


def failing_model():
    """Refuses prompts whose first digit is 12 or more."""

    def run(prompts, n):
        if any(_digit(p, 0) >= 12 for p in prompts):
            raise RuntimeError("refused")
        return number_model()(prompts, n)

    return run


def short_model():
    """Leaves the last text out of replies to prompts whose first digit is 12 or more."""

    def run(prompts, n):
        return [texts[: n - (_digit(p, 0) >= 12)] for p, texts in zip(prompts, number_model()(prompts, n))]

    return run
