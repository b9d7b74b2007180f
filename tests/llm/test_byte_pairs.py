"""Byte-level BPE by backtracking, against the merges' definition and the library."""

import hashlib
import random

import pytest

from cohortloom.llm import byte_pairs
from cohortloom.llm.queries import QUERIES
from tests.llm.test_text_edges import ROWS, docs, none  # noqa: F401


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    ranks = byte_pairs.coder(None).ranks.rank_of
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_the_query_gives_the_librarys_ids(spark, folder, library):
    found = {r["doc_id"]: r for r in QUERIES["op11_byte_pairs"](spark, folder).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert found.keys() == texts.keys()
    for doc_id, text in texts.items():
        ids = library.encode_ordinary(text)
        row = found[doc_id]
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_edges(docs, none, library):  # noqa: F811
    found = byte_pairs.encode_texts(docs).collect()
    assert len(found) == len(ROWS) and byte_pairs.encode_texts(none).count() == 0
    want = sorted((r[0] or 0, library.encode_ordinary(r[1] or ""), (r[1] or "").encode()) for r in ROWS)
    assert sorted((r["id"] or 0, r["ids"], bytes(r["decoded"])) for r in found) == want


def test_odd_texts(library):
    coder, draw = byte_pairs.coder(None), random.Random(8)
    parts = ["a", "b", "the", " ", "é", "語", "😀", "'s", "'LL", "\n", "  ", "1", "²", "ing", "\x1c", "\x85", "　", "ß", "ÿ", "×",
             "՘", "\U00016ea7", "\U0001e5d0", "<|endoftext|>", "\x00", "’", "\xa0"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 50))) for _ in range(5_000)]
    texts += ["y" * 50_000, "ab" * 9_000, " " * 5_000, "the" * 3_000, "".join(map(chr, range(0x250)))]
    ids, starts = coder.encode(texts)
    for text, a, b in zip(texts, starts, starts[1:]):
        assert ids[a:b].tolist() == library.encode_ordinary(text), text[:80]
        assert coder.decode(ids[a:b].tolist()) == text.encode()


def test_letters_are_those_of_the_library(library):
    """Every code point between letters, before a space and doubled; this also covers the lists of late letters."""
    coder = byte_pairs.coder(None)
    points = [*range(0x20, 0x3100), *range(0xA000, 0xAC00), *range(0xF900, 0x20000, 3), *range(0x2B700, 0x2B830), *range(0x32300, 0x33500, 7)]
    for point in points:
        if 0xD800 <= point < 0xE000:
            continue
        c = chr(point)
        text = f"a{c}a {c}{c}1 \n{c} x{c}"
        assert [i for p in coder.pieces(text) for i in coder.ranks.encode(p.encode())] == library.encode_ordinary(text), hex(point)


@pytest.mark.parametrize("seed", range(6))
def test_any_ranks_give_the_merges(seed):
    """Ranks trained on random strings of few letters, where borders conflict often and merging overlaps itself."""
    draw = random.Random(seed)
    ranks = {bytes([b]): b for b in range(256)}
    corpus = [list(map(lambda c: bytes([c]), draw.choices(b"abc", k=draw.randint(5, 60)))) for _ in range(80)]
    for rank in range(256, 256 + 120):
        pairs = {}
        for word in corpus:
            for a, b in zip(word, word[1:]):
                if a + b not in ranks:
                    pairs[a, b] = pairs.get((a, b), 0) + 1
        if not pairs:
            break
        best = max(pairs, key=lambda p: (pairs[p], p))
        ranks[best[0] + best[1]] = rank
        corpus = [byte_pairs.plain_merges(b"".join(word), ranks) for word in corpus]
    built = byte_pairs.Ranks(ranks)
    for _ in range(3_000):
        piece = bytes(draw.choices(b"abcd", weights=[6, 5, 4, 1], k=draw.randint(1, 40)))
        got = [built.token[i] for i in built.encode(piece)]
        assert got == ([piece] if piece in ranks else byte_pairs.plain_merges(piece, ranks)), piece


def test_tokens_that_merging_does_not_reach():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bcd": 257}
    built = byte_pairs.Ranks(ranks)
    assert built.encode(b"bcd") == [257] and built.encode(b"abcd") == [256, ord("c"), ord("d")]
    assert built.encode(b"xbcd") == [ord("x"), ord("b"), ord("c"), ord("d")]
    with pytest.raises(ValueError, match="no rank"):
        byte_pairs.Ranks({b"a": 0})


def test_forgetting_changes_nothing(monkeypatch, library):
    monkeypatch.setattr(byte_pairs, "PAIRS", 3)
    own = byte_pairs.Coder(byte_pairs.Ranks(byte_pairs.coder(None).ranks.rank_of))
    own.known.most = 4
    for text in ("one two three four five six", "one two", "", "seven six five", "éa ü b"):
        ids, starts = own.encode([text, text])
        assert ids.tolist() == library.encode_ordinary(text) * 2 and starts.tolist() == [0, len(ids) // 2, len(ids)]
