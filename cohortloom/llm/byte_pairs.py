"""Byte-level BPE with the ranks of a file, by backtracking over longest matches.

A text is cut by the pattern of the public tokenizers, and each piece is encoded on its own. Bytes are written as the
Latin-1 characters of the same numbers, so that an Aho-Corasick automaton of all tokens finds the longest token at every
place of a piece in one pass. A piece's tokens are then chosen from left to right, the longest first. A token may
follow another only if merging by ranks would leave the two side by side (``Ranks.apart``, remembered for each pair);
if it may not, the longest token that it starts with is tried, and if none is left the token before is taken back and
the place is never entered again. Tokens that are pairwise apart are exactly what the merges give, and no place is
entered twice, so the time is linear in the length of the piece.

A piece that is a token is that token, even one that merging does not reach; such tokens are not used inside other
pieces. Decoding joins the bytes of the tokens. Null texts count as empty; empty texts have no tokens. Rows are
encoded one by one, whatever their length or order, so repeated rows and ties give equal results; an empty table gives
an empty one. Memory holds a slice of a batch, the remembered pieces (``REMEMBERED``) and pairs (``PAIRS``), which a
worker keeps from one task to the next.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.llm import common
from cohortloom.llm.remembered import Remembered

#: Distinct pieces and pairs of tokens that a worker remembers.
REMEMBERED = 500_000
PAIRS = 500_000
_HELD: dict[str, "Coder"] = {}

LETTERS, NUMBERS, SPACES = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", " \\t-\\r\\x85\\xa0"
#: The public pattern for texts of code points below 256, where its classes can be listed.
SHORT_RANGE = re.compile(
    f" ?[{LETTERS}]++|'(?:[stmd]|re|ve|ll)| ?[{NUMBERS}]++| ?[^{SPACES}{LETTERS}{NUMBERS}]++"
    f"|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]++")
WIDE = re.compile("[^\\x00-\\xff]")
# Letters and numbers added to Unicode after version 16, which the tokenizer library does not know as such
# while the regex module does.
LATER = re.compile(
    "[\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1"
    "\uab6c-\uab6d\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a"
    "\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686"
    "\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda"
    "\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128"
    "\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff"
    "\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4"
    "\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479"
    "\U0003d000-\U0003fc3f]")
NO_LETTER = "\u0378"


def default_ranks() -> str:
    """Rank file of the public tokenizers; a parameter everywhere else."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def coder(path: str | None) -> "Coder":
    """The coder of a rank file, built once per process. Without a path each process looks up the default."""
    path = path or default_ranks()
    if path not in _HELD:
        _HELD.clear()
        _HELD[path] = Coder(Ranks.from_file(path))
    return _HELD[path]


def plain_merges(piece: bytes, rank_of: dict[bytes, int], below: int | None = None) -> list[bytes]:
    """The definition: join the neighbours of lowest rank, the leftmost of equals, until no rank is left."""
    parts = [piece[i:i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        ranks = [rank_of.get(a + b) for a, b in zip(parts, parts[1:])]
        known = [r for r in ranks if r is not None and (below is None or r < below)]
        if not known:
            break
        at = ranks.index(min(known))
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Ranks:
    """Tokens by rank, how each is built, and which pairs stay apart."""

    def __init__(self, rank_of: dict[bytes, int]):
        if missing := [b for b in range(256) if bytes([b]) not in rank_of]:
            raise ValueError(f"{len(missing)} bytes have no rank")
        size = max(rank_of.values()) + 1
        self.rank_of = rank_of
        self.token = [b""] * size
        for token, rank in rank_of.items():
            self.token[rank] = token
        #: The two tokens whose merge makes a token; -1 for single bytes.
        self.left, self.right = [-1] * size, [-1] * size
        #: The longest shorter token that a token starts with.
        self.shorter = [-1] * size
        self.length = [len(t) for t in self.token]
        built = set()
        for token, rank in sorted(rank_of.items(), key=lambda x: x[1]):
            if len(token) > 1:
                halves = plain_merges(token, rank_of, below=rank)
                if len(halves) != 2:
                    continue  # merging never makes it
                self.left[rank], self.right[rank] = rank_of[halves[0]], rank_of[halves[1]]
            built.add(token)
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for token in built:
            rank = rank_of[token]
            self.automaton.add_word(token.decode("latin-1"), rank)
            for n in range(len(token) - 1, 0, -1):
                if token[:n] in built:
                    self.shorter[rank] = rank_of[token[:n]]
                    break
        self.automaton.make_automaton()
        self._apart: dict[int, bool] = {}

    @classmethod
    def from_file(cls, path: str) -> "Ranks":
        with open(path, "rb") as lines:
            return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)})

    def apart(self, a: int, b: int) -> bool:
        """Whether merging the bytes of ``a`` and ``b`` together gives just these two tokens."""
        # Walk back through the merges, the last one first. The symbols on both sides of the border exist until
        # they are merged away from it, ``a`` at rank ``a_ends`` and ``b`` at rank ``b_ends``; a lower rank of the two
        # together would have joined them first. Of equal ranks the left one goes first.
        a_ends = b_ends = len(self.token)
        while True:
            rank = self.rank_of.get(self.token[a] + self.token[b])
            if rank is not None and rank < a_ends and rank <= b_ends:
                return False
            if self.left[a] >= 0 and (self.left[b] < 0 or a > b):
                a_ends, a = a, self.right[a]
            elif self.left[b] >= 0:
                b_ends, b = b, self.left[b]
            else:
                return True

    def encode(self, piece: bytes) -> list[int]:
        """Tokens of one piece."""
        whole = self.rank_of.get(piece)
        if whole is not None:
            return [whole]
        n, length, shorter = len(piece), self.length, self.shorter
        known, size = self._apart, len(self.token)
        if len(known) > PAIRS:
            known.clear()
        longest = [0] * n
        for end, token in self.automaton.iter(piece.decode("latin-1")):  # at one place the longest ends last
            longest[end + 1 - length[token]] = token
        out: list[int] = []
        closed = bytearray(n + 1)
        at, token = 0, longest[0]
        while True:
            if token < 0:  # nothing can follow here: this is no border
                closed[at] = 1
                token = out.pop()
                at -= length[token]
                token = shorter[token]
                continue
            end = at + length[token]
            if closed[end]:
                token = shorter[token]
                continue
            if out:
                pair = out[-1] * size + token
                apart = known.get(pair)
                if apart is None:
                    apart = known[pair] = self.apart(out[-1], token)
                if not apart:
                    token = shorter[token]
                    continue
            out.append(token)
            at = end
            if at == n:
                return out
            token = longest[at]


class Coder:
    """Pieces of texts, their tokens, and back."""

    def __init__(self, ranks: Ranks):
        import public_tokenizers
        import regex

        self.ranks = ranks
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.known = Remembered(lambda new: [ranks.encode(piece.encode("utf-8")) for piece in new], REMEMBERED)

    def pieces(self, text: str) -> list[str]:
        if not WIDE.search(text):
            return SHORT_RANGE.findall(text)
        if LATER.search(text):
            return [text[m.start():m.end()] for m in self.pattern.finditer(LATER.sub(NO_LETTER, text))]
        return self.pattern.findall(text)

    def encode(self, texts: Sequence[str]):
        """Ids of all texts one after another, and where each starts (and the last one ends)."""
        return self.known.encode([self.pieces(t) for t in texts])

    def decode(self, ids: Sequence[int]) -> bytes:
        return b"".join(map(self.ranks.token.__getitem__, ids))


def encode_texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                 ranks: str | None = None) -> DataFrame:
    """(id, n_tokens, ids, decoded) of every row; ``decoded`` has the bytes of the tokens."""
    named = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("_text"))
    out = T.StructType([
        named.schema["id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())),
        T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(ranks)
        for batch in common.slices(batches, 500):
            ids, starts = own.encode(common.texts(batch.column("_text")))
            flat = ids.tolist()
            yield common.with_columns(batch, ["id"], {
                "n_tokens": pa.array(starts[1:] - starts[:-1]),
                "ids": pa.ListArray.from_arrays(pa.array(starts.astype("int32")), pa.array(ids)),
                "decoded": pa.array([own.decode(flat[a:b]) for a, b in zip(starts, starts[1:])], pa.binary())})

    return named.mapInArrow(run, out)
