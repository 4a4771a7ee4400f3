"""SentencePiece encoding and decoding, by a batched numpy Viterbi.

Words of equal length advance together: at each end position the hashes of all substrings ending there
probe the sorted piece keys, and a maximum over the candidates stores score and backpointer.

For a unigram model the maximised score is the sum of piece scores. A byte-pair model's result is
not the best sum of anything, but it is the one path on which every two neighbouring pieces are what
merging would leave of their joined text; so there an edge scores 0 if its piece may follow the
path's last piece, and minus infinity if not. That test undoes merges from the latest back, for all
candidates of a step at once. Both give the ids of the reference library.

The vocabulary is read once on the driver (``path`` is a parameter) and goes to the executors; its
size is that of the file. A word is a run of spaces and what follows to the next space, which no piece
crosses; a model with such a piece is refused. Characters outside the vocabulary become
bytes, or the unknown id where the model has no bytes. A null text encodes as null ids in
:func:`encode` and counts as no tokens; an empty text has none. Texts are never cut.

Words go through in parts of :data:`_PART`, and a worker remembers the words of late parts only: :data:`_KEPT` and those
of one part, and at most as many older ones. So its memory does not grow with the number of different words.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shards import runs, slices, trim

SPACE = "▁"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_KNOWN: dict[str, list[dict[str, bytes]]] = {}
_FILTER = 22
_TOP = np.uint64(64 - _FILTER)
_LONG = 48  # longer words go one by one, their steps are too many to share
_CELLS = 100_000  # characters of words of one length that advance together
_PART, _KEPT = 250_000, 80_000


def _hash(s: str) -> int:
    h = 0
    for c in s:
        h = (h * int(_BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
    return h


class Pieces:
    """A vocabulary, ready to encode: ``pieces``, ``scores``, ``kinds`` (n normal, b byte, u unknown, c control)."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: str, pairs: bool, prefix: bool):
        self.args = (pieces, scores, kinds, pairs, prefix)
        self.pieces, self.pairs, self.prefix = pieces, pairs, prefix
        normal = [i for i, k in enumerate(kinds) if k == "n"]
        if any(re.search(f"[^{SPACE}]{SPACE}", pieces[i]) for i in normal):
            raise ValueError("a piece crosses the end of a word")
        self.id = {pieces[i]: i for i in normal}
        self.size, self.unknown = len(pieces), kinds.find("u")
        self.byte = [self.id_of_byte(b) for b in range(256)] if "b" in kinds else None
        self.longest = max(map(len, self.id), default=1)
        keys = np.array([_hash(pieces[i]) for i in normal], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(normal, np.int64)[order]
        if len(np.unique(keys)) != len(keys):
            raise ValueError("two pieces share a hash")
        self.score = np.array(scores, float)
        self.power = np.array([pow(int(_BASE), k, 1 << 64) for k in range(self.longest + 1)], np.uint64)
        self.maybe = np.zeros(1 << _FILTER, bool)  # most probes end at this filter
        self.maybe[(self.keys >> _TOP).astype(np.int64)] = True
        name = hashlib.sha256("\0".join([*pieces, str(pairs), str(prefix)]).encode()).hexdigest()
        self.known = _KNOWN.setdefault(name, [{}, {}])  # a worker keeps words from task to task: late ones, and older ones
        if pairs:
            self._learn_merges(normal)
        self.text = [self._bytes(i, k) for i, k in enumerate(kinds)]

    def __reduce__(self):
        return Pieces, self.args

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        kinds = "".join("u" if m.is_unknown(i) else "c" if m.is_control(i) or m.is_unused(i) else "b" if m.is_byte(i) else "n" for i in range(n))
        shown = m.encode(" a  b", out_type=str)
        if "".join(shown).count(SPACE) not in (3, 4):
            raise ValueError("the model changes spaces; only identity normalisation is supported")
        prefix = "".join(m.encode("a", out_type=str)).startswith(SPACE)
        # the best sum of scores and the merges differ on some word unless the model is unigram
        with open(path, "rb") as f:
            pairs = _is_pair_model(f.read())
        return cls([m.id_to_piece(i) for i in range(n)], [m.get_score(i) for i in range(n)], kinds, pairs, prefix)

    def id_of_byte(self, b: int) -> int:
        return self.pieces.index(f"<0x{b:02X}>")

    def _bytes(self, i: int, kind: str) -> bytes:
        if kind == "b":
            return bytes([int(self.pieces[i][3:5], 16)])
        return b"" if kind == "c" else " ⁇ ".encode() if kind == "u" else self.pieces[i].replace(SPACE, " ").encode()

    # -- byte-pair models

    def _learn_merges(self, normal: list[int]) -> None:
        """When each piece is made (single characters: before all) and of which two."""
        n = self.size + 1
        made = np.full(n, -1, np.int64)
        many = [i for i in normal if len(self.pieces[i]) > 1]
        for t, i in enumerate(sorted(many, key=lambda i: -self.score[i])):
            made[i] = t
        self.made = made
        self.left, self.right = np.arange(n), np.arange(n)
        self.reached = np.zeros(n, bool)
        self.reached[[i for i in normal if len(self.pieces[i]) == 1]] = True
        when = made.tolist()
        for i in many:
            got = self._merge(self.pieces[i], when)
            if got:
                self.left[i], self.right[i] = got
                self.reached[i] = True

    def _merge(self, s: str, when: list[int]) -> tuple[int, int] | None:
        """The last two parts that merging ``s`` joins into one piece; None if it never becomes one."""
        parts, last = list(s), None
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.id.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or when[i] < best):
                    best, at = when[i], k
            if best is None:
                return None
            last = parts[at], parts[at + 1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return (self.id[last[0]], self.id[last[1]]) if last and all(x in self.id for x in last) else None

    def _joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Time at which the text of a and b would be merged to one piece; a huge number if never."""
        if not hasattr(self, "hash_of"):
            self.hash_of = np.zeros(self.size + 1, np.uint64)
            self.hash_of[self.ids] = self.keys
            self.len_of = np.array([len(p) for p in self.pieces] + [0])
        size = self.len_of[b]
        h = self.hash_of[a] * self.power[np.minimum(size, self.longest)] + self.hash_of[b]
        row, piece = self._probe(h)
        out = np.full(len(a), 1 << 40)
        out[row] = np.where(self.len_of[a[row]] + size[row] <= self.longest, self.made[piece], 1 << 40)
        return out

    def _probe(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are pieces', and which pieces."""
        row = np.flatnonzero(self.maybe[(h >> _TOP).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, h[row]), len(self.keys) - 1)
        hit = self.keys[at] == h[row]
        return row[hit], self.ids[at[hit]]

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the joined text of pieces a and b leaves them as they are.

        Walk back in time: of the two pieces at the seam the one made later is taken apart. A merge
        across the seam would have come first if it is due before that time, or at the same time
        further left.
        """
        out = np.ones(len(a), bool)
        live = np.flatnonzero((a < self.size) & (b < self.size))
        x, y = a[live], b[live]
        until = np.full(len(live), 1 << 39)
        while len(live):
            bad = self._joined(x, y) < until
            out[live[bad]] = False
            go = ~bad & ((self.made[x] >= 0) | (self.made[y] >= 0))
            live, x, y = live[go], x[go], y[go]
            on_left = self.made[x] > self.made[y]
            until = np.where(on_left, self.made[x], self.made[y] + 1)
            x, y = np.where(on_left, self.right[x], x), np.where(on_left, y, self.left[y])
        return out

    # -- Viterbi

    def _walk(self, words: list[str]) -> list[list[int]]:
        """Piece numbers of words of one length; ``size`` stands for a character outside the vocabulary."""
        m, n = len(words), len(words[0])
        chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(m, n).T.astype(np.uint64) + np.uint64(1)
        prefix = np.zeros((n + 1, m), np.uint64)
        for i in range(n):
            prefix[i + 1] = prefix[i] * _BASE + chars[i]
        best = np.full((n + 1, m), -np.inf)
        best[0] = 0
        last, back = np.full((n + 1, m), self.size, np.int64), np.zeros((n + 1, m), np.int64)
        lowest = float(self.score.min()) - 10
        for end in range(1, n + 1):
            low = max(0, end - self.longest)
            # substrings that end here, the shortest first
            h = prefix[end] - prefix[low:end][::-1] * self.power[1 : end - low + 1, None]
            at, piece = self._probe(h.ravel())
            start, row = end - 1 - at // m, at % m
            out = np.ones(m, bool)
            out[row[start == end - 1]] = False
            if out.any():  # outside the vocabulary: always a step of its own
                best[end, out] = best[end - 1, out] + (0 if self.pairs else lowest)
                back[end, out] = end - 1
            ok = best[start, row] > -np.inf
            if self.pairs:
                ok &= self.reached[piece]
            start, row, piece = start[ok], row[ok], piece[ok]
            if self.pairs:
                ok = self.may_follow(last[start, row], piece)
                start, row, piece = start[ok], row[ok], piece[ok]
                total = best[start, row]
                order = np.argsort(row, kind="stable")
            else:
                total = best[start, row] + self.score[piece]
                order = np.lexsort((-total, row))
            top = order[runs(row[order])]  # of equals the shorter piece
            top = top[total[top] > best[end, row[top]]]
            row = row[top]
            best[end, row], last[end, row], back[end, row] = total[top], piece[top], start[top]
        where, out = np.full(m, n), np.full((m, n), -1, np.int64)
        rows = np.arange(m)
        for k in range(n - 1, -1, -1):
            live = where > 0
            out[live, k] = last[where[live], rows[live]]
            where[live] = back[where[live], rows[live]]
            if not live.any():
                break
        return [r[r >= 0].tolist() for r in out]

    def _long(self, word: str) -> list[int]:
        """The same path for one long word; time and memory in proportion to its length."""
        last, back = [self.size] * (len(word) + 1), [0] * (len(word) + 1)
        best = [0.0] + [-np.inf] * len(word)
        seen: dict[tuple[int, int], bool] = {}
        lowest = float(self.score.min()) - 10
        for end in range(1, len(word) + 1):
            if word[end - 1] not in self.id:
                best[end], back[end], last[end] = best[end - 1] + (0 if self.pairs else lowest), end - 1, self.size
            for start in range(max(0, end - self.longest), end):
                piece = self.id.get(word[start:end])
                if piece is None:
                    continue
                if self.pairs:
                    if not self.reached[piece]:
                        continue
                    if start and last[start] < self.size:
                        key = last[start], piece
                        if key not in seen:
                            if len(seen) > 500_000:
                                seen.clear()
                            seen[key] = bool(self.may_follow(np.array([key[0]]), np.array([key[1]]))[0])
                        if not seen[key]:
                            continue
                    total = best[start]
                else:
                    total = best[start] + self.score[piece]
                if total > best[end]:
                    best[end], back[end], last[end] = total, start, piece
        out, at = [], len(word)
        while at:
            out.append(last[at])
            at = back[at]
        return out[::-1]

    def _ids(self, word: str, steps: list[int]) -> list[int]:
        if self.size not in steps:
            return steps
        out, at = [], 0
        for s in steps:
            if s < self.size:
                out.append(s)
                at += len(self.pieces[s])
            else:
                raw = word[at].encode("utf-8", "replace")
                out += [self.byte[b] for b in raw] if self.byte else [self.unknown]
                at += 1
        return out

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """Ids of the words; those that are not remembered are encoded, those of a length together."""
        if len(self.known[0]) > _KEPT:
            self.known[:] = {}, self.known[0]
        late, older = self.known
        by: dict[int, list[str]] = {}
        for w in words:
            if w not in late:
                got = older.get(w)
                if got is None:
                    by.setdefault(len(w), []).append(w)
                else:
                    late[w] = got
        for n, some in by.items():
            wide = max(1, _CELLS // n)
            for k in range(0, len(some), wide):
                part = some[k : k + wide]
                steps = [self._long(w) for w in part] if n > _LONG else self._walk(part)
                late.update((w, np.array(self._ids(w, s), "<i4").tobytes()) for w, s in zip(part, steps))
        return late

    def words(self, text: str) -> Iterator[list[str]]:
        """The words of a text, in parts."""
        text = (SPACE if self.prefix else "") + text.replace(" ", SPACE) if text else ""
        if len(text) <= _PART:
            yield _WORD.findall(text)
            return
        found = _WORD.finditer(text)
        while some := [m[0] for m in islice(found, _PART)]:
            yield some

    def encode_bytes(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each whole text as little-endian 32-bit numbers."""
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, list[str]]] = []
        size = 0

        def flush():
            ids = self.learn({w for _, some in held for w in some})
            for k, some in held:
                out[k].append(b"".join(map(ids.__getitem__, some)))

        for k, t in enumerate(texts):
            for some in self.words(t or ""):
                held.append((k, some))
                size += len(some)
                if size >= _PART:
                    flush()
                    held, size = [], 0
        flush()
        return [b"".join(x) for x in out]

    def encode(self, texts: list[str | None]) -> list[list[int] | None]:
        return [None if t is None else np.frombuffer(b, "<i4").tolist() for t, b in zip(texts, self.encode_bytes(texts))]

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(map(self.text.__getitem__, ids))
        return (raw[1:] if self.prefix and raw[:1] == b" " else raw).decode("utf-8", "replace")


def _is_pair_model(raw: bytes) -> bool:
    """Whether the trainer settings of a model file (field 2, in it field 3) say byte-pair encoding (2)."""

    def number(at):
        x = shift = 0
        while True:
            b = raw[at]
            x |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return x, at

    def fields(at, end):
        while at < end:
            tag, at = number(at)
            if tag & 7 == 2:
                size, at = number(at)
                yield tag >> 3, at, at + size
                at += size
            elif tag & 7 == 0:
                value, at = number(at)
                yield tag >> 3, value, None
            else:
                at += 8 if tag & 7 == 1 else 4

    for field, a, b in fields(0, len(raw)):
        if field == 2 and b is not None:
            return any(f == 3 and e is None and v == 2 for f, v, e in fields(a, b))
    return False


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with ``ids``, ``n_tokens`` and ``round_trip`` (decoding gives the text back)."""
    pieces = Pieces.load(path)
    names = docs.columns

    def run(batches):
        for batch in batches:
            for some in slices(batch, "text", 2 << 20):
                texts = some.column("text").to_pylist()
                ids = [None if t is None else np.frombuffer(b, "<i4") for t, b in zip(texts, pieces.encode_bytes(texts))]
                back = [t is None or pieces.decode(i.tolist()) == t for t, i in zip(texts, ids)]
                new = {"ids": pa.array(ids, pa.list_(pa.int32())), "n_tokens": pa.array([0 if i is None else len(i) for i in ids], pa.int64()), "round_trip": pa.array(back, pa.bool_())}
                yield pa.RecordBatch.from_pydict({n: some.column(n) for n in names} | new)
        trim()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, ids array<int>, n_tokens bigint, round_trip boolean")


def digest(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, round_trip)``; the hash is of the ids as little-endian 32-bit numbers."""
    pieces = Pieces.load(path)

    def run(batches):
        for batch in batches:
            for some in slices(batch, "t", 2 << 20):
                texts = [None if t is None else t.decode("utf-8", "replace") for t in some.column("t").to_pylist()]
                ids = pieces.encode_bytes(texts)
                back = [t is None or pieces.decode(np.frombuffer(b, "<i4").tolist()) == t for t, b in zip(texts, ids)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": some.column("doc_id"),
                        "n_tokens": pa.array([len(b) // 4 for b in ids], pa.int64()),
                        "ids_sha256": pa.array([hashlib.sha256(b).hexdigest() for b in ids], pa.string()),
                        "round_trip": pa.array(back, pa.bool_()),
                    }
                )
        trim()

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, round_trip boolean"
    return docs.select("doc_id", F.col("text").cast("binary").alias("t")).mapInArrow(run, schema)
