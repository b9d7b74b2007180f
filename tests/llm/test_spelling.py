"""Spelling variants against brute force on small word lists."""

import random
import re
import zlib
from collections import Counter

import pytest

from cohortloom.llm import spelling
from tests.llm.test_text_edges import ROWS, docs, none  # noqa: F401


def brute_counts(rows, least_count=3):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 5:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= least_count}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(counts):
    near = {w: [v for v in counts if one_apart(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {w: (form[w], root(w), counts[w], len(near[w]), counts.get(form[w])) for w in counts}


def found_variants(spark, counts):
    table = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    found = spelling.variants(table).collect()
    assert len(found) == len({r["word"] for r in found}) == len(counts)
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in found}


@pytest.mark.parametrize("letters,longest,seed", [("ab", 9, 1), ("abcé", 8, 2), ("abcdefghijklmnopÿñ", 7, 3)])
def test_variants_are_those_of_brute_force(spark, letters, longest, seed):
    draw = random.Random(seed)
    counts = {}
    for _ in range(260):
        word = "".join(draw.choice(letters) for _ in range(draw.randint(5, longest)))
        counts[word] = draw.randint(3, 40)
        for _ in range(draw.randint(0, 2)):  # a variant of it
            at, kind = draw.randrange(len(word)), draw.randrange(3)
            other = word[:at] + ("" if kind == 0 else draw.choice(letters)) + word[at + (kind < 2):]
            if len(other) >= 5:
                counts[other] = draw.randint(3, 400)
    assert found_variants(spark, counts) == brute_variants(counts)


def test_runs_ends_and_long_words(spark, monkeypatch):
    long = "x" * 40 + "".join(random.Random(4).choice("abcdefgh") for _ in range(3_000))
    counts = {"a" * n: 3 * 2 ** max(0, 9 - n) for n in range(5, 12)} | {
        "level": 50, "leveled": 9, "evel": 3, "levels": 20, "slevel": 5, "kevel": 4, "lewel": 4, "lével": 4, "leevel": 3, "levvel": 3,
        long: 10, long[:1_500] + long[1_501:]: 3, long[:-1]: 3, long[1:]: 3, "y" + long: 3, long[:700] + "z" + long[701:]: 30,
        "zzzzzz": 3, "qqqqq": 3, "zzzzz": 3}
    want = brute_variants(counts)
    assert found_variants(spark, counts) == want
    monkeypatch.setattr(spelling, "BROADCAST_EDGES", 0)
    assert found_variants(spark, counts) == want
    assert found_variants(spark, {"single": 3}) == {"single": (None, "single", 3, 0, None)}


def test_counts(spark, docs, none):  # noqa: F811
    want = brute_counts([(r[0], r[1]) for r in ROWS])
    assert {r["word"]: r["n"] for r in spelling.word_counts(docs).collect()} == want
    rows = [(i, f"Their thiér ÀÉÎ straße_naïve÷x THEIR their's {'w' * 400} Überall {i}there") for i in range(300)] + [
        (None, "their überall " * 5), (None, None), (7, "")] + [(7, "repeated repeated")] * 3
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r["word"]: r["n"] for r in spelling.word_counts(table).collect()} == brute_counts(rows)
    assert spelling.variants(spelling.word_counts(none)).count() == 0


def test_the_query_gives_brute_force(spark, folder):
    from cohortloom.llm.queries import QUERIES

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    counts = brute_counts(rows)
    by_shape = {}
    for w in counts:  # candidates by what is left without one letter, so that brute force ends
        for i in range(len(w)):
            by_shape.setdefault((i, w[:i], w[i + 1:]), []).append(w)
    near = {w: set() for w in counts}
    for (i, a, z), group in by_shape.items():
        for w in group:
            near[w].update(v for v in group if v != w)
            if a + z in counts:
                near[w].add(a + z)
                near[a + z].add(w)
    found = {r["word"]: r for r in QUERIES["op12_spelling_variants"](spark, folder).collect()}
    assert found.keys() == counts.keys()
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form = best if best is not None and counts[best] >= 2 * counts[w] else None
        assert (found[w]["n"], found[w]["n_near"], found[w]["form"]) == (counts[w], len(others), form)
