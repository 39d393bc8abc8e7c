"""Deterministic offline stand-ins for the model hooks.

They let every model-backed job run end to end (tests, registered queries,
bench) without a network.  Answers follow from the length of the request and
embeddings from letter counts, rules that SQL can restate; so a re-run after
a lost executor gives the same rows, and what reaches a model can be checked.
Each class is a *factory*: calling it returns the completer/embedder, built
once per Python worker.
"""

from __future__ import annotations

import json
import math
import re


def request_size(system, prompt, temperature) -> int:
    """Characters of a request plus ten times its temperature."""
    return len(system or "") + len(prompt) + round(10 * (temperature or 0))


class StubJudge:
    """Answers with one of ``choices``; fails (raises) on every ``fail_every``-th request."""

    def __init__(self, choices=("1", "2", "3", "4", "5"), fail_every: int = 0):
        self.choices = tuple(choices)
        self.fail_every = fail_every

    def __call__(self):
        choices, fail_every = self.choices, self.fail_every

        def complete(system, prompts, temperature, max_tokens, **options):
            out = []
            for p in prompts:
                h = request_size(system, p, temperature)
                if fail_every and h % fail_every == 0:
                    raise RuntimeError("stub model failure")
                out.append(choices[h % len(choices)])
            return out
        return complete


class StubGenerator:
    """Returns an MCQ as JSON made from the request's size; one size in
    ``invalid_every`` breaks the schema (a number where a string goes)."""

    def __init__(self, invalid_every: int = 6):
        self.invalid_every = invalid_every

    def __call__(self):
        invalid_every = self.invalid_every

        def complete(system, prompts, temperature, max_tokens, **options):
            out = []
            for p in prompts:
                h = request_size(system, p, temperature)
                rec = {"question": f"What about {h}?", "option_a": str(h % 7), "option_b": str(h % 11),
                       "option_c": str(h % 13), "option_d": str(h % 17), "correct_option": "abcd"[h % 4]}
                if invalid_every and h % invalid_every == 0:
                    rec["option_b"] = h % 11
                out.append(json.dumps(rec))
            return out
        return complete


class StubExamAnswerer:
    """Returns ``{"answer_option": x}`` with x drawn from letters, digits and noise."""

    ANSWERS = ("A", "b", " c) x", "D", "3", "0", "1", "")

    def __call__(self):
        answers = self.ANSWERS

        def complete(system, prompts, temperature, max_tokens, **options):
            return [json.dumps({"answer_option": answers[request_size(system, p, temperature) % len(answers)]})
                    for p in prompts]
        return complete


class StubCleaner:
    """Returns the sheet text without its header and wiki brackets; fails on
    every ``fail_every``-th request size so the NULL path is exercised."""

    def __init__(self, fail_every: int = 17):
        self.fail_every = fail_every

    def __call__(self):
        fail_every = self.fail_every

        def complete(system, prompts, temperature, max_tokens, **options):
            out = []
            for p in prompts:
                if fail_every and request_size(system, p, temperature) % fail_every == 0:
                    raise RuntimeError("stub model failure")
                body = p.split("\n", 2)[-1]
                out.append(re.sub(r"\[\[|\]\]|'''|''", "", body).strip())
            return out
        return complete


class LetterEmbedder:
    """Counts of a few letters, scaled to unit length (the zero vector where none occurs)."""

    LETTERS = "aeinorst"

    def __call__(self):
        letters = self.LETTERS

        def embed(texts):
            out = []
            for t in texts:
                counts = [(t or "").count(x) for x in letters]
                norm = math.sqrt(sum(c * c for c in counts))
                out.append([c / norm if norm else 0.0 for c in counts])
            return out
        return embed


class WordTokenizer:
    """The places of the words (runs of other characters than white space) of each text."""

    PATTERN = r"[^\x20\x09-\x0D]+"

    def __call__(self):
        words = re.compile(self.PATTERN)

        def tokenize(texts):
            return [[m.span() for m in words.finditer(t)] for t in texts]
        return tokenize
