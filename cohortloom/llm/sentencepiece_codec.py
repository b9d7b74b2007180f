"""SentencePiece encoding and decoding with the pieces of a model file, whole batches at a time.

A text is written as the library does it without further normalization: every space becomes the mark ``▁`` and one
mark is put in front. It is cut before each mark that follows another character; no piece reaches across such
a cut, so the segmentation of the text is made of those of its parts. Distinct parts of a batch are solved together:
those of equal length advance as the rows of a matrix. Hashes of substrings come from prefix hashes and are looked
up among the sorted hashes of the pieces.

Every place of a part stores the piece that leads to it (Viterbi): the way back gives the ids. For a unigram model it is
the piece with the largest sum of scores so far, of equal sums the longest. A BPE model merges, always the
neighbours whose piece has the highest score, the leftmost of equals; what it makes of the characters up to a place is what
it makes of those up to the last piece's start, and that piece. So exactly one piece leads to each place: the one that
merging makes of its own characters and that stays apart from the piece leading to its start. Whether two pieces
stay apart is seen by undoing their merges, the last one first, or, for pieces that share a score (runs of marks), by
merging the two; answers are remembered by pair. Parts of more than
``LONG_PART`` characters go through the same search one by one, so that a long part needs only its own way back.

A character without a piece of its own (in Viterbi it costs the lowest score less ten) is written as its bytes, or as the
unknown piece where the model has no bytes. Decoding joins the pieces and turns marks into spaces, so a text comes
back as it was unless it holds the mark itself (which comes back as a space) or, without byte pieces, unknown
characters. Null texts count as empty; empty texts have no pieces.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.llm import common

MARK = "▁"
PARTS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: Characters of parts that are solved in one block, and parts that a worker remembers.
BLOCK_CHARS = 200_000
REMEMBERED = 150_000
#: Characters up to which a part of a BPE model is a row of a matrix.
LONG_PART = 48
#: Places for remembered pairs, a power of two.
PAIRS = 1 << 20
UNKNOWN_COST = 10.0

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_HELD: dict[str, "Codec"] = {}


def default_model() -> str:
    """Model file of the public tokenizers; a parameter everywhere else."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def codec(path: str | None) -> "Codec":
    """The codec of a model file, built once per process. Without a path each process looks up the default."""
    path = path or default_model()
    if path not in _HELD:
        _HELD.clear()
        _HELD[path] = Codec.from_file(path)
    return _HELD[path]


class Codec:
    def __init__(self, pieces: Sequence[str], scores: Sequence[float], ids: Sequence[int],
                 byte_ids: dict[int, int], unknown_id: int, size: int, merges: bool = False):
        self.merges = merges
        self.pieces, self.unknown_id = list(pieces), unknown_id
        self.text = [""] * size
        for piece, i in zip(pieces, ids):
            self.text[i] = piece
        self.byte_of = {i: b for b, i in byte_ids.items()}
        spaced = [bytes([self.byte_of[i]]) if i in self.byte_of else t.replace(MARK, " ").encode() for i, t in enumerate(self.text)]
        # every piece, and every piece as the first of a text
        self.spaced = pa.array(spaced + [t.removeprefix(b" ") for t in spaced], pa.binary())
        self.is_empty = np.array([not t for t in spaced])
        self.byte_ids = byte_ids
        self.longest = max(map(len, pieces))
        self.powers = np.cumprod(np.concatenate([np.ones(1, dtype=np.uint64), np.full(self.longest, _BASE)]))
        keys = np.array([self._hash_one(p) for p in pieces], dtype=np.uint64)
        order = np.argsort(keys)
        self.keys, self.scores = keys[order], np.array(scores, dtype=np.float64)[order]
        self.ids = np.array(ids, dtype=np.int64)[order]
        self.place = {pieces[i]: k for k, i in enumerate(order.tolist())}
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces with one hash")
        self.sizes = np.array([len(pieces[i]) for i in order.tolist()], dtype=np.int64)
        self.maybe = np.zeros(1 << 21, dtype=bool)
        self.maybe[(self.keys >> np.uint64(43)).astype(np.int64)] = True
        self.unknown_score = float(self.scores.min()) - UNKNOWN_COST
        # a cut before a mark is safe unless some piece goes on across it
        self.whole = any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)
        self.is_byte = np.zeros(size, dtype=bool)
        self.is_byte[list(self.byte_of)] = True
        self.forget()
        if merges:
            self._undo_merges()

    @classmethod
    def from_file(cls, path: str) -> "Codec":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        plain = [i for i in range(size) if not (
            model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
        bytes_ = {int(model.id_to_piece(i)[3:-1], 16): i for i in range(size) if model.is_byte(i)}
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto.FromString(model.serialized_model_proto())
        spec, kinds = proto.trainer_spec, proto.SentencePiece
        if spec.model_type not in (spec.BPE, spec.UNIGRAM):
            raise ValueError(f"{path}: neither a BPE nor a unigram model")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in proto.pieces):
            raise ValueError(f"{path}: user-defined and unused pieces are not supported")
        rules = proto.normalizer_spec
        if (rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix
                or not rules.escape_whitespaces or spec.treat_whitespace_as_suffix
                or proto.denormalizer_spec.precompiled_charsmap):
            raise ValueError(f"{path}: normalizing texts is not supported")
        return cls([model.id_to_piece(i) for i in plain], [model.get_score(i) for i in plain], plain, bytes_,
                   model.unk_id(), size, merges=spec.model_type == spec.BPE)

    def _hash_one(self, piece: str) -> int:
        h = np.zeros(1, dtype=np.uint64)
        for c in piece:
            h = h * _BASE + self._spread(np.array([ord(c)], dtype=np.uint64))
        return int(h[0])

    @staticmethod
    def _spread(points: np.ndarray) -> np.ndarray:
        x = (points + np.uint64(1)) * _MIX
        return x ^ (x >> np.uint64(31))

    def parts(self, text: str) -> list[str]:
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        return [marked] if self.whole else PARTS.findall(marked)

    def forget(self) -> None:
        """Drop the remembered parts."""
        self.number = common.Numbers()
        self.flat, self.ends = np.zeros(0, dtype=np.int32), np.zeros(1, dtype=np.int64)

    def solve(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the largest sums of all words one after another, and the length of each word's share."""
        return self._in_blocks(words, self._solve_block)

    def solve_apart(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same with the pieces a BPE model merges to."""
        return self._in_blocks(words, self._apart_block)

    def _undo_merges(self) -> None:
        """The halves of the last merge of every piece, in ``left`` and ``right``; ``made`` are those merging can make.

        A piece is ``slow`` if the ranks of its merges do not rise: it shares a score, or a half of it is slow.
        """
        single = self.sizes == 1
        alone = {p for p in self.pieces if len(p) == 1}
        if any(c not in alone for p in self.pieces for c in p):
            raise ValueError("a piece has a character that is no piece")
        n = len(self.keys)
        _, rank = np.unique(-self.scores, return_inverse=True)
        self.rank = np.append(rank, n).astype(np.int64)  # number -1: the lowest
        self.left, self.right = np.full(n + 1, -1, dtype=np.int64), np.full(n + 1, -1, dtype=np.int64)
        self.made = np.append(single, False)
        _, group, shared = np.unique(np.where(single, np.inf, self.scores), return_inverse=True, return_counts=True)
        self.slow = np.append(~single & (shared[group] > 1), False)
        self.pair_of = np.zeros(PAIRS, dtype=np.uint64)
        self.pair_apart = np.zeros(PAIRS, dtype=bool)
        self.by_place = sorted(self.place, key=self.place.get)
        for size in range(2, self.longest + 1):
            whole = np.flatnonzero(self.sizes == size)
            words = [self.by_place[i] for i in whole.tolist()]
            if not words:
                continue
            prefix = self._prefixes(words, size)
            rows = np.arange(len(words))
            for cut in range(1, size):
                a = self._numbers(prefix, rows, np.zeros_like(rows), np.full_like(rows, cut))
                b = self._numbers(prefix, rows, np.full_like(rows, cut), np.full_like(rows, size))
                own = self.rank[whole]
                # both halves are there before the merge, and nothing before it joins them
                early = lambda half: self.made[half] & (single[half] | (self.rank[half] < own))
                at = np.flatnonzero((a >= 0) & (b >= 0) & early(a) & early(b))
                at = at[self._stay_apart(a[at].astype(np.int64), b[at].astype(np.int64), own[at])]
                self.left[whole[at]], self.right[whole[at]], self.made[whole[at]] = a[at], b[at], True
                self.slow[whole[at]] |= self.slow[a[at]] | self.slow[b[at]]
            for number, word in zip(whole.tolist(), words):
                if self.slow[number] or not self.made[number]:
                    self.made[number], self.slow[number] = self.merged(word) == [word], True

    def merged(self, word: str) -> list[str]:
        """What merging makes of a short word, by the rule itself."""
        symbols = list(word)
        while True:
            best, at = -np.inf, -1
            for i in range(len(symbols) - 1):
                number = self.place.get(symbols[i] + symbols[i + 1])
                if number is not None and self.scores[number] > best:  # the first of equals
                    best, at = self.scores[number], i
            if at < 0:
                return symbols
            symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]

    def _joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Numbers of the pieces that two pieces make together, -1 where there is none."""
        found = np.full(len(a), -1, dtype=np.int64)
        key = self.keys[a] * self.powers[self.sizes[b]] + self.keys[b]
        may = np.flatnonzero(self.maybe[(key >> np.uint64(43)).astype(np.int64)])
        key = key[may]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found[may] = np.where(self.keys[at] == key, at, -1)
        return found

    def _stay_apart(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Whether merging the characters of two pieces gives just these two, where wanted by merges before a rank only.

        The symbols beside the border last until a merge takes them away from it: the left one at rank ``left_ends``,
        the right one at ``right_ends``. A lower rank of the two together comes first; of equal ranks the leftmost.
        """
        apart = np.ones(len(a), dtype=bool)
        at = np.arange(len(a))
        left_ends = np.full(len(a), len(self.keys)) if before is None else before
        right_ends = left_ends if before is None else before - 1
        while len(at):
            rank = self.rank[self._joined(a, b)]
            joins = (rank < left_ends) & (rank <= right_ends)
            apart[at[joins]] = False
            a_rank, b_rank = self.rank[a], self.rank[b]
            undo_a = (self.left[a] >= 0) & ((self.left[b] < 0) | (a_rank > b_rank))
            undo_b = ~undo_a & (self.left[b] >= 0)
            left_ends, right_ends = np.where(undo_a, a_rank, left_ends), np.where(undo_b, b_rank, right_ends)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_b, self.left[b], b)
            on = np.flatnonzero(~joins & (undo_a | undo_b))
            at, a, b, left_ends, right_ends = at[on], a[on], b[on], left_ends[on], right_ends[on]
        return apart

    def _apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``_stay_apart`` with the answers remembered, one pair at each place."""
        code = a.astype(np.uint64) * np.uint64(len(self.keys)) + b.astype(np.uint64) + np.uint64(1)
        place = ((code * _MIX) >> np.uint64(32)).astype(np.int64) & (PAIRS - 1)
        answer = self.pair_apart[place]
        new = np.flatnonzero(self.pair_of[place] != code)
        if len(new):
            codes, first, use = np.unique(code[new], return_index=True, return_inverse=True)
            rows = new[first]
            one, two = a[rows].astype(np.int64), b[rows].astype(np.int64)
            slow = self.slow[one] | self.slow[two]
            found = np.empty(len(rows), dtype=bool)
            found[~slow] = self._stay_apart(one[~slow], two[~slow])
            for i in np.flatnonzero(slow):
                pair = [self.by_place[one[i]], self.by_place[two[i]]]
                found[i] = self.merged("".join(pair)) == pair
            answer[new] = found[use]
            # of pairs with one place the last is kept, in both arrays
            held, last = np.unique(place[rows][::-1], return_index=True)
            last = len(rows) - 1 - last
            self.pair_of[held], self.pair_apart[held] = codes[last], found[last]
        return answer

    @staticmethod
    def _in_blocks(words: Sequence[str], solve_block) -> tuple[np.ndarray, np.ndarray]:
        by_length: dict[int, list[int]] = {}
        for at, word in enumerate(words):
            by_length.setdefault(len(word), []).append(at)
        order, shares, lengths = [], [], []
        for length, members in by_length.items():
            step = max(1, BLOCK_CHARS // length)
            for first in range(0, len(members), step):
                part = members[first:first + step]
                ids, counts = solve_block([words[i] for i in part], length)
                order += part
                shares.append(ids)
                lengths.append(counts)
        if not order:
            return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)
        sizes = np.concatenate(lengths)
        place = np.argsort(np.array(order))
        return _gathered(np.concatenate(shares), np.cumsum(sizes) - sizes, sizes, place), sizes[place]

    def _prefixes(self, words: list[str], length: int) -> np.ndarray:
        n = len(words)
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(n, length)
        spread = self._spread(points.astype(np.uint64))
        prefix = np.zeros((n, length + 1), dtype=np.uint64)
        for j in range(length):
            prefix[:, j + 1] = prefix[:, j] * _BASE + spread[:, j]
        return prefix

    def _numbers(self, prefix: np.ndarray, rows: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Numbers of the pieces that lie from ``start`` to ``end`` in the given rows, -1 where there is none."""
        size = end - start
        key = prefix[rows, end] - prefix[rows, start] * self.powers[np.minimum(size, self.longest)]
        found = np.full(key.shape, -1, dtype=np.int32)
        may = self.maybe[(key >> np.uint64(43)).astype(np.int64)] & (size <= self.longest)
        key = key[may]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found[may] = np.where(self.keys[at] == key, at, -1)
        return found

    def _apart_block(self, words: list[str], length: int) -> tuple[np.ndarray, np.ndarray]:
        if length > LONG_PART:
            ways = [self._solve_long(w) for w in words]
            ids = np.full((len(words), max(map(len, ways))), -1, dtype=np.int64)
            for row, way in enumerate(ways):
                ids[row, :len(way)] = way
            return self._written(words, ids)
        n, none = len(words), -1
        prefix = self._prefixes(words, length)
        # every piece in every row, by the place it leads to
        rows, starts, ends, numbers = [], [], [], []
        for size in range(1, min(self.longest, length) + 1):
            sub = prefix[:, size:] - prefix[:, :-size] * self.powers[size]
            row, start = np.nonzero(self.maybe[(sub >> np.uint64(43)).astype(np.int64)])
            key = sub[row, start]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = (self.keys[at] == key) & self.made[at]
            rows.append(row[hit])
            starts.append(start[hit])
            ends.append(start[hit] + size)
            numbers.append(at[hit])
        row, start, end, number = map(np.concatenate, (rows, starts, ends, numbers))
        order = np.argsort(end, kind="stable")
        row, start, number = row[order], start[order], number[order]
        upto = np.searchsorted(end[order], np.arange(1, length + 2))
        # a character without a piece stays by itself
        back = np.tile(np.arange(-1, length, dtype=np.int32), (n, 1))
        last = np.full((n, length + 1), none, dtype=np.int64)
        for place in range(1, length + 1):
            share = slice(upto[place - 1], upto[place])
            r, s, piece = row[share], start[share], number[share]
            before = last[r, s]
            on = before == none
            ask = np.flatnonzero(~on)
            on[ask] = self._apart(before[ask], piece[ask])
            last[r[on], place], back[r[on], place] = piece[on], s[on]
        at, end, steps = np.arange(n), np.full(n, length), []
        while (end > 0).any():
            piece, start = last[at, end], np.maximum(back[at, end], 0)
            steps.append(np.where(end > 0, np.where(piece >= 0, self.ids[piece], -2 - start), -1))
            end = start
        return self._written(words, np.stack(steps[::-1], axis=1).astype(np.int64))

    def _solve_long(self, word: str) -> list[int]:
        """Ids of one word, -2 less the place for a character without a piece."""
        n = len(word)
        last, back = [-1] * (n + 1), list(range(-1, n))
        known: dict[tuple[int, int], bool] = {}
        one = np.zeros(1, dtype=np.int64)
        for end in range(1, n + 1):
            for start in range(max(0, end - self.longest), end):
                number = self.place.get(word[start:end], -1)
                if number < 0 or not self.made[number]:
                    continue
                pair = (last[start], number)
                if pair[0] >= 0 and pair not in known:
                    if len(known) > PAIRS:
                        known.clear()
                    known[pair] = bool(self._apart(one + pair[0], one + number)[0])
                if pair[0] < 0 or known[pair]:
                    last[end], back[end] = number, start
                    break
        out, at = [], n
        while at > 0:
            out.append(-2 - back[at] if last[at] < 0 else int(self.ids[last[at]]))
            at = back[at]
        return out[::-1]

    def _solve_block(self, words: list[str], length: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(words)
        prefix = self._prefixes(words, length)
        longest = min(self.longest, length)
        # gain[l - 1, :, s]: score of the piece of l characters at s, and its number
        gain = np.full((longest, n, length), -np.inf)
        piece = np.full((longest, n, length), -1, dtype=np.int32)
        for size in range(1, longest + 1):
            sub = prefix[:, size:] - prefix[:, :-size] * self.powers[size]
            w, s = np.nonzero(self.maybe[(sub >> np.uint64(43)).astype(np.int64)])
            key = sub[w, s]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            gain[size - 1, w[hit], s[hit]] = self.scores[at[hit]]
            piece[size - 1, w[hit], s[hit]] = at[hit]
        alone = gain[0] == -np.inf
        gain[0][alone] = self.unknown_score
        best = np.full((n, length + 1), -np.inf)
        best[:, 0] = 0
        back = np.zeros((n, length + 1), dtype=np.int32)
        for end in range(1, length + 1):
            most = min(longest, end)
            sizes = np.arange(most, 0, -1)  # longest first: it wins a tie
            sums = best[:, end - sizes] + gain[sizes - 1, :, end - sizes].T
            chosen = sums.argmax(axis=1)
            best[:, end] = sums[np.arange(n), chosen]
            back[:, end] = sizes[chosen]
        return self._walk_back(words, length, back, piece)

    def _walk_back(self, words: list[str], length: int, back: np.ndarray, piece: np.ndarray):
        """Ids along the stored ways, all words a piece at a time from their ends."""
        n = len(words)
        rows, end = np.arange(n), np.full(n, length)
        steps = []
        while (end > 0).any():
            size = back[rows, end]
            start = end - size
            number = piece[np.maximum(size, 1) - 1, rows, np.maximum(start, 0)]
            steps.append(np.where(end > 0, np.where(number >= 0, self.ids[np.maximum(number, 0)], -2 - start), -1))
            end = start
        return self._written(words, np.stack(steps[::-1], axis=1).astype(np.int64))

    def _written(self, words: list[str], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids row after row without the filling (-1), characters without a piece (-2 less their place) written out."""
        for row in np.flatnonzero((ids < -1).any(axis=1)):  # characters without a piece
            full: list[int] = []
            for i in ids[row]:
                if i < -1:
                    raw = words[row][-2 - i].encode("utf-8", "surrogatepass")
                    full += [self.byte_ids[b] for b in raw] if self.byte_ids else [self.unknown_id]
                elif i >= 0:
                    full.append(i)
            if len(full) > ids.shape[1]:
                ids = np.pad(ids, ((0, 0), (0, len(full) - ids.shape[1])), constant_values=-1)
            ids[row] = -1
            ids[row, :len(full)] = full
        filled = ids >= 0
        return ids[filled].astype(np.int32), filled.sum(axis=1)

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text starts (and the last one ends)."""
        split = [self.parts(t) for t in texts]
        if len(self.number) > REMEMBERED or len(self.flat) > 8 * REMEMBERED:
            self.forget()
        used, new = self.number.of(split)
        if new:
            ids, lengths = self.solve_apart(new) if self.merges else self.solve(new)
            self.flat = np.concatenate([self.flat, ids])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(lengths)])
        sizes = np.diff(self.ends)
        all_ids = _gathered(self.flat, self.ends[:-1], sizes, used)
        upto = np.concatenate([[0], np.cumsum(sizes[used])])
        starts = upto[np.concatenate([[0], np.cumsum([len(words) for words in split])]).astype(np.int64)]
        return all_ids, starts

    def decode_all(self, ids: np.ndarray, starts: np.ndarray) -> pa.Array:
        """Texts of many runs of ids, joined by Arrow: a byte of a character stands beside the others in its text as it is."""
        shown = ids.astype(np.int64)
        shown[starts[:-1][np.diff(starts) > 0]] += len(self.text)  # the first piece, without its space
        runs = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), self.spaced.take(pa.array(shown)))
        joined = pc.binary_join(runs, b"")
        # ids without a text, and marks made of bytes, are for the plain way
        if not (self.is_empty[ids].any() or pc.any(pc.match_substring(joined, MARK.encode())).as_py()):
            try:
                return joined.cast(pa.string())
            except pa.ArrowInvalid:  # bytes that are no character
                pass
        return pa.array([self.decode(ids[a:b].tolist()) for a, b in zip(starts, starts[1:])], pa.string())

    def decode(self, ids: Sequence[int]) -> str:
        if not len(ids):
            return ""
        if not self.is_byte[ids].any():
            joined = "".join(map(self.text.__getitem__, ids)).replace(MARK, " ")
            return joined[1:] if joined.startswith(" ") else joined
        out, held = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held = bytearray()
            out.append(self.text[i])
        if held:
            out.append(held.decode("utf-8", "replace"))
        joined = "".join(out).replace(MARK, " ")
        return joined[1:] if joined.startswith(" ") else joined


def _gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, used: np.ndarray) -> np.ndarray:
    """The shares of ``flat`` with the given numbers, one after another."""
    lengths = sizes[used]
    upto = np.cumsum(lengths)
    return flat[np.repeat(starts[used] - (upto - lengths), lengths) + np.arange(upto[-1] if len(upto) else 0)]


def encode_texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                 model: str | None = None) -> DataFrame:
    """(id, n_ids, ids, decoded, round_trip) of every row; ``round_trip`` says whether decoding gave the text back."""
    named = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("_text"))
    out = T.StructType([
        named.schema["id"], T.StructField("n_ids", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())),
        T.StructField("decoded", T.StringType()), T.StructField("round_trip", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in common.slices(batches, 500):
            texts = common.texts(batch.column("_text"))
            ids, starts = own.encode(texts)
            back = own.decode_all(ids, starts)
            yield common.with_columns(batch, ["id"], {
                "n_ids": pa.array(np.diff(starts)),
                "ids": pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids)),
                "decoded": back,
                "round_trip": pc.equal(pc.fill_null(batch.column("_text"), ""), back)})
        own.forget()  # the worker lives on and serves other stages

    return named.mapInArrow(run, out)
