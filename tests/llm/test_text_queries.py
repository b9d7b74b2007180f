"""Registered queries: SQL twins, brute force where there is none."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest

from cohortloom.llm import queries as registered
from tests.oracle_check import compare, duck

LOW = {i: i + 32 for i in range(65, 91)}


@pytest.fixture(scope="module")
def con(folder):
    return duck(folder)


@pytest.fixture(scope="module")
def documents(spark, folder):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}


@pytest.mark.parametrize("name", list(registered.ORACLES))
def test_query_equals_sql(spark, con, folder, name):
    assert compare(spark, con, name, registered.QUERIES[name], registered.ORACLES[name], folder) is None


def brute_spans(text):
    found = []
    pattern = re.compile(r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|"
                         r"[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    found += [("assign", m.start(), m.end()) for m in pattern.finditer(text) if len(m[2]) >= 12]
    found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found, key=lambda x: (x[1], ("assign", "access", "hex").index(x[0])))


def test_secret_scans(spark, folder, documents):
    rows = registered.QUERIES["op3_secret_scans"](spark, folder).collect()
    assert len(rows) == len(documents)
    for row in rows:
        spans = brute_spans(documents[row["doc_id"]]["text"])
        count = collections.Counter(k for k, _, _ in spans)
        assert (row["n_assign"], row["n_access"], row["n_hex"]) == (count["assign"], count["access"], count["hex"])
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert row["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert set(filter(None, line.split(","))) <= set(row["spans"].split(","))


def test_sentencepiece_gives_every_text_back(spark, folder, documents):
    rows = registered.QUERIES["op6_sentencepiece"](spark, folder).collect()
    assert len(rows) == len(documents)
    assert all(r["round_trip"] and r["decoded"] == documents[r["doc_id"]]["text"] and r["n_ids"] == len(r["ids"])
               for r in rows)


def test_token_files(spark, folder, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    rows = sorted(registered.QUERIES["op8_token_files"](spark, folder).collect(), key=lambda r: r["doc_id"])
    start = 0
    for row, doc in zip(rows, sorted(documents), strict=True):
        ids = tokenizer.encode(documents[doc]["text"], add_special_tokens=False).ids + [0]
        crc = zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        assert (row["doc_id"], row["start"], row["n_tokens"], row["ids_crc32"]) == (doc, start, len(ids), crc)
        start += len(ids)


def test_sharding(spark, folder, documents):
    rows = registered.QUERIES["op9_sharding"](spark, folder).collect()
    assert {r["doc_id"] for r in rows} == set(documents) and len(rows) == len(documents)
    slots = collections.defaultdict(list)
    for r in rows:
        data = documents[r["doc_id"]]["text"].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 16, zlib.crc32(data), "key")
        assert r["grown_shard"] in (r["shard"], 40) and 0 <= r["shard"] < 40
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def is_held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_language_of_held_out_documents(spark, documents):
    folder = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()}
    rows = registered.QUERIES["op7_language_id"](spark, folder).collect()
    assert len(rows) == len(lang) and all(r["held_out"] == is_held_out(r["doc_id"]) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_quality_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = registered.QUERIES["op2_quality_classifier"](spark, folder).collect()
    assert all(r["held_out"] == is_held_out(r["doc_id"]) and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    held = [(label[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in label]
    good = [p for y, p in held if y == 1]
    bad = [p for y, p in held if y == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.15 * len(bad)


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOW))
    return {tuple(words)} if 0 < len(words) < k else {tuple(words[i:i + k]) for i in range(len(words) - k + 1)}


def survivors(texts, k):
    """Smallest id of each component of links at 0.8 and more, by comparing all pairs that share a run."""
    sets = {i: shingles(t, k) for i, t in texts.items()}
    holders = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    shared = collections.Counter()
    for ids in holders.values():
        shared.update((a, b) for a in ids for b in ids if a < b)
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (a, b), n in shared.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {i for i in texts if root(i) == i}


def test_pipeline(spark, folder, documents):
    import corpus_pipeline

    rows = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder).collect()}
    left = {}
    for i, r in documents.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", r["text"])
        seen = collections.Counter(zip(words, words[1:], words[2:]))
        repeated = {p for p, g in enumerate(zip(words, words[1:], words[2:])) if seen[g] > 1}
        covered = repeated | {p + 1 for p in repeated} | {p + 2 for p in repeated}
        if len(words) >= 50 and 100 * len(covered) <= 50 * len(words):
            left[i] = r["text"]
    kept = survivors(left, 5)
    word = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = set()
    for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect():
        w = word.findall(r["text"].translate(LOW))
        windows |= {tuple(w[i:i + 10]) for i in range(max(1, len(w) - 9)) if w}

    def clean(text):
        w = word.findall(text.translate(LOW))
        return not any(tuple(w[i:i + m]) in windows for m in {len(x) for x in windows} for i in range(len(w) - m + 1))

    want = {i for i in kept if clean(left[i])}
    assert set(rows) == want
    for i, r in rows.items():
        assert r["round_trip"]
        if not brute_spans(left[i]):
            assert r["decoded"] == left[i]
        else:
            assert "[SECRET]" in r["decoded"]
