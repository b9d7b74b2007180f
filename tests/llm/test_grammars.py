"""Formats learned from credentials: held-out ones are found, what only looks alike is not; scores by brute force."""

import math
import random
from collections import Counter

import pytest

from cohortloom.llm import grammars, secrets

UPPER, LOWER, DIGITS, HEX = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"


def formats(draw):
    def drawn(letters, n):
        return "".join(draw.choice(letters) for _ in range(n))

    return {
        "short": lambda: "sk-" + drawn(UPPER + LOWER + DIGITS, 32), "long": lambda: "ghp_" + drawn(UPPER + LOWER + DIGITS, 36),
        "ended": lambda: "pk_" + drawn(HEX, 24) + "_Zq", "grouped": lambda: "-".join(drawn(HEX, k) for k in (8, 4, 4, 4, 12)),
        "parts": lambda: "xoxb-" + drawn(DIGITS, 12) + "-" + drawn(UPPER + LOWER + DIGITS, 24)}


@pytest.mark.parametrize("seed", [1, 2])
def test_held_out_credentials_of_five_formats(seed):
    draw = random.Random(seed)
    kinds = formats(draw)
    examples = [make() for make in kinds.values() for _ in range(80)]
    draw.shuffle(examples)
    automaton = grammars.infer(examples)
    assert len(automaton.states) > 100

    def share(values):
        return sum(automaton.log2_likelihood(v) is not None for v in values) / len(values)

    for make in kinds.values():
        held_out = [make() for _ in range(300)]
        assert share(held_out) >= 0.95
        assert share(["".join(draw.sample(v, len(v))) for v in held_out]) <= 0.02
        assert share([v[:12] for v in held_out]) == 0
        assert share(["".join(draw.choice(DIGITS) for _ in v) for v in held_out]) == 0
    assert share(["20241105102233", "2024-11-05T10.22.33", "123456789012", "000000000000"]) == 0


def test_documents_with_formats(spark):
    draw = random.Random(9)
    kinds = formats(draw)
    free = [make() for make in kinds.values() for _ in range(20)]
    texts = [(i, f"my password: {make()} ok") for i, make in enumerate(list(kinds.values()) * 60)] + [
        (1_000 + i, f"plain text with {v} inside") for i, v in enumerate(free)] + [
        (2_000 + i, f"at 2024-11-05T10.{i % 60:02d}.33 by {LOWER[i % 26] * 2}host{i}.example.com on 20241105{i:06d} and {v[:12]}")
        for i, v in enumerate(free * 3)]
    found = {r["id"]: r for r in secrets.scan_secrets(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    hits = [f"format:16:{16 + len(v)}" in found[1_000 + i]["spans"].split(",") for i, v in enumerate(free)]
    assert sum(hits) >= 0.95 * len(hits)
    assert sum(found[2_000 + i]["n_format"] for i in range(len(free) * 3)) == 0


def test_rare_shapes_are_in_the_sample(spark, monkeypatch):
    monkeypatch.setattr(secrets, "SAMPLE", 20)
    draw = random.Random(3)
    common_ = ["".join(draw.choice(LOWER) for _ in range(20)) for _ in range(500)]
    rare = ["QX-" + "".join(draw.choice(DIGITS) for _ in range(30)) for _ in range(8)]
    rows = [(i, f"token={v}") for i, v in enumerate(common_ + rare)]
    learned = secrets.learn(secrets.scanned(spark.createDataFrame(rows, "doc_id int, text string"), "text"))
    assert learned.automata[0].root.lengths[33] == 8 and learned.automata[0].root.visits == 20


def test_likelihood_by_hand():
    """Of a chain without choice and of two branches, worked out from the counts alone."""
    automaton = grammars.infer(["ab1"] * 30)
    bits, surprise, _ = automaton.scores("ab1")
    want = 0.0
    for size in (6, 6, 10):  # a, b: letters a-f; 1: a digit
        of_class = (30 + grammars.UNSEEN) / 31 / size
        want -= math.log2((30 + grammars.PRIOR * of_class) / (30 + grammars.PRIOR))
    want -= math.log2((30 + grammars.UNSEEN) / 31)
    assert bits == pytest.approx(want) and len(automaton.states) == 4
    assert automaton.scores("ab") is None and automaton.scores("ab12") is None  # lengths no example has
    states = {id(s) for s in automaton.states}
    assert all(id(t) in states for s in automaton.states for t in s.next.values())
    two = grammars.infer(["x1" + c * 3 for c in "abcd"] * 10 + ["y" + "Z" * 8] * 40)
    assert two.root.counts == {"x": 40, "y": 40} and two.root.next["x"] is not two.root.next["y"]
    assert two.log2_likelihood("yZZZZZZZZ") is not None and two.log2_likelihood("x1ZZZ") is None


def test_few_or_no_examples():
    assert grammars.infer([]).log2_likelihood("anything") is None
    single = grammars.infer(["abcdefghijkl"])
    assert single.log2_likelihood("mnopqrstuvwx") is None
    assert Counter(len(s.next) for s in single.states) == {1: 12, 0: 1}
