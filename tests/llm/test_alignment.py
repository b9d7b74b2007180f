"""Token alignment against a brute-force version that works through whole texts token by token."""

import hashlib
import random
from collections import Counter

import pytest

from cohortloom.llm import alignment
from cohortloom.llm.queries import QUERIES
from tests.llm.test_text_edges import ROWS, docs, none  # noqa: F401


@pytest.fixture(scope="module")
def brute():
    """Rows by index: counts, digest and links of whole texts by the libraries; then the counts over all."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = alignment.byte_of_letter()
    entries = {i: bytes(letters[c] for c in entry) for entry, i in first.get_vocab().items()}

    def piece(i):
        text = second.id_to_piece(i)
        return bytes([int(text[3:-1], 16)]) if second.is_byte(i) else text.replace("▁", " ").encode()

    def one(text):
        if not text:
            return 0, 0, 0, [], ""
        a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
        a_bytes, b_bytes = [entries[i] for i in a], [piece(i) for i in b]
        if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
            return 0, 0, 0, [], ""
        spans = []
        for tokens in (a_bytes, b_bytes):
            at, out = 0, []
            for t in tokens:
                out.append((at, at + len(t)))
                at += len(t)
            spans.append(out)
        links, groups, i, j, from_a, from_b = [], [], 0, 0, 0, 0
        while i < len(a):
            (p, q), (r, s) = spans[0][i], spans[1][j]
            if max(p, r) < min(q, s):
                links.append((a[i], b[j]))
            if q == s:
                groups.append(",".join(map(str, a[from_a:i + 1])) + "|" + ",".join(map(str, b[from_b:j + 1])))
                i, j = i + 1, j + 1
                from_a, from_b = i, j
            elif q < s:
                i += 1
            else:
                j += 1
        return len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()

    def all_of(texts):
        each = [one(t) for t in texts]
        counts = Counter(link for x in each for link in x[3])
        most = Counter()
        for (_, b), n in counts.items():
            most[b] = max(most[b], n)
        return [(n_a, n_b, n_groups, len(links), digest, sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links))
                for n_a, n_b, n_groups, links, digest in each]

    return all_of


NAMES = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum")


def test_the_query_gives_brute_force(spark, folder, brute):
    texts = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect())
    found = sorted(QUERIES["op13_token_alignment"](spark, folder).collect(), key=lambda r: r["doc_id"])
    assert [tuple(r[c] for c in NAMES) for r in found] == brute([t for _, t in texts])


def test_odd_texts(spark, brute, monkeypatch):
    draw = random.Random(6)
    parts = ["a", "the", " ", "  ", "   ", "é", "語", "😀", "'s", "\n", "\n ", " \n", "\t", "1", "ing", "\x1c", "\x85", "\xa0", "　", "ß", "<s>",
             "<|endoftext|>", "<0x41>", "\r\n", "x" * 30, "-", "\x00", "’", "…"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(1, 40))) for _ in range(700)]
    texts += [" ", "  ", "a ", "a  ", " a", "▁", "a▁b", "a ▁", "", None, "one two  three\n four\n  five ", "y" * 4_000, " " * 300, "the " * 2_000]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    want = brute(texts)
    assert want[texts.index("▁")][:4] == (0, 0, 0, 0) and want[texts.index("a ")][0] == 2

    def found():
        return [tuple(r[c] for c in NAMES) for r in sorted(alignment.aligned(table).collect(), key=lambda r: r["id"])]

    assert found() == want
    rows = alignment.align_texts(table).drop("groups")
    size = alignment.aligner(None, None).pair_base
    for bound in (0, 40):  # counts of rare pairs, or of all, by shuffle
        split = sorted(alignment.link_statistics(rows, size, bound).collect(), key=lambda r: r["id"])
        assert [(r["n_best"], r["count_sum"]) for r in split] == [x[5:] for x in want]


def test_forgetting_changes_nothing(brute, monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED", 3)
    own = alignment.aligner(None, None)
    own.forget()
    texts = ["one two three four five six seven", "", "two, three; four", "one one one", "ünï two"]
    want = brute(texts)
    for text, row in zip(texts, want):
        counts, groups, starts, pairs, times = own.align([text, "", text])
        assert counts[0].tolist() == counts[2].tolist() == list(row[:4]) and counts[1].tolist() == [0] * 4
        assert groups[1] == "" and (not text or hashlib.sha256(groups[0].encode()).hexdigest() == row[4])
        assert times[starts[0]:starts[1]].sum() == row[3]


def test_edges(spark, docs, none, brute):  # noqa: F811
    found = alignment.aligned(docs).collect()
    assert alignment.aligned(none).count() == 0

    def order(rows):
        return sorted(rows, key=lambda x: (x[0] or 0, x[1:]))

    assert order([(r["id"], *[r[c] for c in NAMES]) for r in found]) == order(
        [(r[0], *w) for r, w in zip(ROWS, brute([r[1] for r in ROWS]))])
