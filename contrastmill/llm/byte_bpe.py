"""Byte-level BPE encoding and decoding: speculate and verify.

Every distinct word of a stretch of text gets a proposal by greedy longest match. Then all pairs of
neighbouring tokens are tested at once. Merges happen in order of rank, so a token exists from its
own rank until the rank of the merge that takes it; two tokens at a boundary can only merge across
it while both exist. ``crossing`` walks back in time from two neighbours over the tokens that once
met at their boundary and looks whether one of these pairs is a merge that comes before either part
is taken. A word whose pairs are all free of such merges is what exact merging gives; only the
others are merged exactly. Tokens that merging never yields are found by the same test when the
vocabulary is loaded, and are not proposed.

Words are cut as the file's byte-level rule says. Whether a character is a letter, a number or a
space is asked of the library once per character, so that both follow one edition of Unicode.
Special strings become their ids, and each stretch between them is cut on its own. Texts are worked
on in stretches of ``WINDOW`` characters that end where a word must end, so that memory does not
depend on the length of a text (only on its ids, where these are asked for).

Null and empty texts have no tokens. Rows are independent: repeated rows, repeated or null ids give
a row each, an empty table an empty one. Other columns of the input do not matter.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 1 << 19
#: Distinct words whose tokens a task remembers; beyond it (or 16 tokens each), it begins again.
REMEMBERED = 1 << 18

LETTER, NUMBER, OTHER, SPACE, UNKNOWN = 0, 1, 2, 3, 255
NEVER = np.int64(1) << 40
NONE = 1 << 40
#: Bytes of a token's beginning by which its possible lengths are looked up.
PREFIX = 4
#: Words up to so many bytes are merged by scanning their ranks, longer ones with a heap.
SHORT = 64

TYPES = {
    "n_tokens": ("long", pa.int64()),
    "ids": ("array<int>", pa.list_(pa.int32())),
    "ids_sha256": ("string", pa.string()),
    "decoded": ("string", pa.large_string()),
    "decoded_sha256": ("string", pa.string()),
}


def _byte_of_character() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary.

    Printable bytes stand for themselves; the others, in order, for the characters from 256 on.
    """
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteBpe:
    """A vocabulary and its merges; raises ``ValueError`` for a file that the method does not cover."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._check(spec, path)
        self.cut = Tokenizer.from_file(path).pre_tokenizer
        bytes_of = _byte_of_character()
        vocab = spec["model"]["vocab"]
        size = 1 + max([*vocab.values(), *(a["id"] for a in spec["added_tokens"])])
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        spelled = [b""] * size
        for token, i in vocab.items():
            spelled[i] = bytes(bytes_of[c] for c in token)
        for token, i in self.special.items():
            spelled[i] = token.encode()
        self.known = np.array([bool(s) for s in spelled])
        self.lengths = np.array([len(s) for s in spelled], np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.spelling = np.frombuffer(b"".join(spelled), np.uint8)
        self.splitter = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.size = size
        self.birth = np.full(size, -1, np.int64)
        self.birth[made] = np.arange(len(made))
        self.left, self.right = np.arange(size), np.arange(size)
        self.left[made], self.right[made] = left, right
        rank = np.arange(len(made))
        if len(np.unique(made)) != len(made) or (self.lengths[made] < 2).any():
            raise ValueError(f"{path}: a token has more than one merge")
        if (self.birth[left] >= rank).any() or (self.birth[right] >= rank).any():
            raise ValueError(f"{path}: a merge comes before one of its parts")
        key = left * size + right
        order = np.argsort(key)
        self.keys, self.ranks = key[order], rank[order]
        self.rank_of = dict(zip(key.tolist(), rank.tolist()))
        self.made = made.tolist()
        single = {spelled[i]: i for i in vocab.values() if len(spelled[i]) == 1}
        self.single = [single[bytes([b])] for b in range(256)]

        # tokens that merging yields: both parts are, and nothing merges across them before
        valid = np.zeros(size, bool)
        valid[self.single] = True
        free = ~self.crossing(left, right, until=rank)
        for a, b, m, ok in zip(left.tolist(), right.tolist(), self.made, free.tolist()):
            valid[m] = ok and valid[a] and valid[b]
        self.valid = valid
        self.token = {spelled[i]: int(i) for i in np.flatnonzero(valid)}
        # lengths of the tokens with a certain beginning, longest first
        lengths: dict[bytes, set[int]] = {}
        for s in self.token:
            if len(s) >= PREFIX:
                lengths.setdefault(s[:PREFIX], set()).add(len(s))
        self.lengths_from = {k: sorted(v, reverse=True) for k, v in lengths.items()}
        self.kinds = np.full(0x110000, UNKNOWN, np.uint8)
        self.forget()

    @staticmethod
    def _check(spec: dict, path: str) -> None:
        model, cut = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model["type"] == "BPE" and not spec.get("normalizer") and not any(
            model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        )
        byte_level = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
        if not plain or not byte_level or (spec.get("decoder") or {}).get("type") != "ByteLevel":
            raise ValueError(f"{path}: not a plain byte-level BPE")
        if any(a["single_word"] or a["lstrip"] or a["rstrip"] for a in spec["added_tokens"]):
            raise ValueError(f"{path}: a special token takes its surroundings into account")

    # -- pairs ------------------------------------------------------------------------------

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER)

    def crossing(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether exact merging of ``a`` followed by ``b`` merges across their boundary.

        With ``until``, only merges of lower rank count. A merge of the same rank takes the
        leftmost pair first: the part of ``a`` is gone by then, the part of ``b`` is not.
        """
        bad = np.zeros(len(a), bool)
        at = np.arange(len(a))
        a, b = np.asarray(a, np.int64).copy(), np.asarray(b, np.int64).copy()
        end_a = np.full(len(a), NEVER - 1) if until is None else np.asarray(until, np.int64).copy()
        end_b = end_a.copy() if until is None else end_a - 1
        while len(at):
            rank = self._rank(a, b)
            hit = (rank < end_a) & (rank <= end_b)
            bad[at[hit]] = True
            younger_a = self.birth[a] > self.birth[b]
            born = np.where(younger_a, self.birth[a], self.birth[b])
            end_a, end_b = np.where(younger_a, born, end_a), np.where(younger_a, end_b, born)
            a, b = np.where(younger_a, self.right[a], a), np.where(younger_a, b, self.left[b])
            go = ~hit & (born >= 0)
            at, a, b, end_a, end_b = at[go], a[go], b[go], end_a[go], end_b[go]
        return bad

    # -- words ------------------------------------------------------------------------------

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        whole = self.token.get(word)
        if whole is not None:
            return [whole]
        out, i, n = [], 0, len(word)
        get, long = self.token.get, self.lengths_from.get
        while i < n:
            found = None
            for size in long(word[i : i + PREFIX], ()):
                if i + size <= n and (found := get(word[i : i + size])) is not None:
                    break
            else:
                for size in range(min(PREFIX - 1, n - i), 0, -1):
                    if (found := get(word[i : i + size])) is not None:
                        break
            out.append(found)
            i += size
        return out

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: always the pair of lowest rank, the leftmost of several."""
        if len(word) > SHORT:
            return self._merge_long(word)
        ids = [self.single[b] for b in word]
        get, size, made = self.rank_of.get, self.size, self.made
        ranks = [get(a * size + b, NONE) for a, b in zip(ids, ids[1:])]
        while ranks:
            rank = min(ranks)
            if rank == NONE:
                break
            i = ranks.index(rank)
            ids[i : i + 2] = [made[rank]]
            del ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] * size + ids[i], NONE)
            if i < len(ranks):
                ranks[i] = get(ids[i] * size + ids[i + 1], NONE)
        return ids

    def _merge_long(self, word: bytes) -> list[int]:
        ids = [self.single[b] for b in word]
        n = len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        rank_of, size = self.rank_of, self.size
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank_of.get(ids[i] * size + ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = self.made[rank], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := rank_of.get(ids[x] * size + ids[y])) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return [t for t in ids if t >= 0]

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Tokens of each word: proposals, of which the failing ones are merged exactly."""
        proposed = [self.propose(w) for w in words]
        counts = np.array([len(p) for p in proposed], np.int64)
        flat = np.fromiter((t for p in proposed for t in p), np.int64, int(counts.sum()))
        owner = np.repeat(np.arange(len(words)), counts)
        inside = owner[1:] == owner[:-1]
        pairs, back = np.unique(flat[:-1][inside] * self.size + flat[1:][inside], return_inverse=True)
        fails = self.crossing(pairs // self.size, pairs % self.size)[back]
        failing = np.unique(owner[:-1][inside][fails])
        for i in failing.tolist():
            proposed[i] = self.merge(words[i])
        self.proposals, self.failures = self.proposals + len(words), self.failures + len(failing)
        return proposed

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = np.zeros(0, np.int32)
        self.first = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.proposals = self.failures = 0

    def _learn(self, words: list[str]) -> None:
        found = self.encode_words([w.encode() for w in words])
        count = np.array([len(x) for x in found], np.int64)
        self.index.update(zip(words, range(len(self.index), len(self.index) + len(words))))
        self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.flat = np.concatenate([self.flat, np.fromiter((t for x in found for t in x), np.int32, int(count.sum()))])

    def tokens(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words in a row, and how many each word has."""
        if len(self.index) > REMEMBERED or len(self.flat) > 16 * REMEMBERED:
            self.forget()
        new = [w for w in dict.fromkeys(words) if w not in self.index]
        if new:
            self._learn(new)
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        count = self.count[at]
        step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        return self.flat[np.repeat(self.first[at], count) + step], count

    # -- texts ------------------------------------------------------------------------------

    def kinds_of(self, points: np.ndarray) -> np.ndarray:
        kinds = self.kinds[points]
        if (kinds == UNKNOWN).any():
            for p in np.unique(points[kinds == UNKNOWN]).tolist():
                together = lambda c: len(self.cut.pre_tokenize_str(c + chr(p))) == 1  # noqa: E731, B023
                self.kinds[p] = LETTER if together("a") else NUMBER if together("1") else OTHER if together("!") else SPACE
            kinds = self.kinds[points]
        return kinds

    def word_begins(self, points: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Where words begin in stretches put end to end (``starts``: where each stretch begins)."""
        n = len(points)
        kinds = self.kinds_of(points)
        new = np.ones(n, bool)
        new[1:] = kinds[1:] != kinds[:-1]
        new[starts] = True
        run = np.flatnonzero(new)
        end = np.append(run[1:], n)
        kind = kinds[run]
        opens = np.zeros(n + 1, bool)
        opens[starts] = True
        closes = opens[end] | (end == n)
        begins = np.zeros(n + 3, bool)
        begins[run] = True
        # the last space before something else stands alone, or with it if it is a blank
        parted = (kind == SPACE) & ~closes
        begins[end[parted] - 1] = True
        joined = end[parted & (points[end - 1] == 0x20)]
        begins[joined] = False
        # 's 't 'm 'd 're 've 'll, if nothing comes before the apostrophe in its word
        p = run[(kind == OTHER) & (end - run == 1) & (points[run] == 0x27) & ~closes]
        p = p[begins[p]]
        one = points[p + 1]
        two = np.where((p + 2 < n) & ~opens[np.minimum(p + 2, n)], points[np.minimum(p + 2, n - 1)], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        begins[p[short | long] + 1] = False
        begins[p[short] + 2] = True
        begins[p[long] + 3] = True
        return np.flatnonzero(begins[:n])

    def stretches(self, text: str, most: int) -> Iterator[str]:
        """The text in pieces of about ``most`` characters that end where a word must end."""
        begin, size = 0, most
        while len(text) - begin > size:
            points = np.frombuffer(text[begin : begin + size + 1].encode("utf-32-le"), np.uint32)
            kinds = self.kinds_of(points)
            safe = (kinds[1:] != kinds[:-1]) & (kinds[:-1] != SPACE) & (kinds[:-1] != OTHER)
            safe |= (kinds[1:] == SPACE) & (kinds[:-1] == OTHER)
            at = np.flatnonzero(safe)
            if not len(at):
                size *= 2
                continue
            cut = begin + int(at[-1]) + 1
            yield text[begin:cut]
            begin, size = cut, most
        yield text[begin:]

    def encode_stretches(self, stretches: list[str]) -> list[np.ndarray]:
        lengths = np.array([len(s) for s in stretches], np.int64)
        text = "".join(stretches)
        if not text:
            return [np.zeros(0, np.int32) for _ in stretches]
        starts = np.cumsum(lengths) - lengths
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        begins = self.word_begins(points, starts[lengths > 0])
        bounds = [*begins.tolist(), len(text)]
        ids, count = self.tokens([text[a:b] for a, b in zip(bounds, bounds[1:])])
        ends = np.append(0, np.cumsum(count))
        edges = ends[np.searchsorted(begins, np.append(starts, len(text)))]
        return [ids[a:b] for a, b in zip(edges[:-1], edges[1:])]

    def parts(self, text: str, most: int) -> Iterator[str | int]:
        """Stretches of a text and ids of special strings, in order."""
        for number, part in enumerate(self.splitter.split(text) if self.splitter else [text]):
            if number % 2:
                yield self.special[part]
            elif part:
                yield from self.stretches(part, most)

    def encoded(self, texts: Iterable[str | None], window: int = WINDOW) -> Iterator[tuple[int, np.ndarray]]:
        """Number of the text and ids of its next part, text by text."""
        held: list[tuple[int, str | int]] = []
        size = 0

        def flush():
            found = iter(self.encode_stretches([p for _, p in held if isinstance(p, str)]))
            for row, p in held:
                yield row, next(found) if isinstance(p, str) else np.array([p], np.int32)

        for row, text in enumerate(texts):
            for part in self.parts(text or "", window):
                held.append((row, part))
                size += len(part) if isinstance(part, str) else 1
                if size >= window:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The bytes behind ids; ids that the vocabulary does not have stand for nothing."""
        ids = ids[(ids >= 0) & (ids < self.size)].astype(np.int64)
        count = self.lengths[ids]
        step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        return self.spelling[np.repeat(self.begins[ids], count) + step].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


def _batch(model: ByteBpe, texts: list[str | None], columns: tuple[str, ...], window: int) -> dict[str, list]:
    n = len(texts)
    counts = [0] * n
    ids: list[list[np.ndarray]] = [[] for _ in range(n)] if {"ids", "decoded"} & set(columns) else []
    hashed = [hashlib.sha256() for _ in range(n)] if "ids_sha256" in columns else []
    restored = [hashlib.sha256() for _ in range(n)] if "decoded_sha256" in columns else []
    for row, part in model.encoded(texts, window):
        counts[row] += len(part)
        if ids:
            ids[row].append(part)
        if hashed:
            hashed[row].update(part.astype("<u4").tobytes())
        if restored:
            restored[row].update(model.decode(part).encode())
    whole = [np.concatenate(p) if p else np.zeros(0, np.int32) for p in ids]
    out = {
        "n_tokens": counts,
        "ids": whole,
        "ids_sha256": [h.hexdigest() for h in hashed],
        "decoded": [model.decode(p) for p in whole] if "decoded" in columns else [],
        "decoded_sha256": [h.hexdigest() for h in restored],
    }
    return {c: out[c] for c in columns}


def encode(docs: DataFrame, path: str, columns: tuple[str, ...] = ("n_tokens", "ids"), window: int = WINDOW) -> DataFrame:
    """``doc_id`` and the ``columns`` asked for of every row of ``docs`` (``doc_id``, ``text``).

    ``n_tokens``, ``ids``, ``ids_sha256`` (of the ids as little-endian unsigned 32-bit integers),
    ``decoded`` and ``decoded_sha256`` (of what the ids decode to, special tokens included).
    """
    unknown = set(columns) - set(TYPES)
    if unknown:
        raise ValueError(f"no such columns: {sorted(unknown)}")
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        model = ByteBpe(path)
        for batch in batches:
            found = _batch(model, batch.column("text").to_pylist(), columns, window)
            arrays = [pa.array(found[c], TYPES[c][1]) for c in columns]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", *columns])

    return docs.mapInArrow(run, ", ".join([f"doc_id {id_type}", *(f"{c} {TYPES[c][0]}" for c in columns)]))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` of rows of ``doc_id, ids``; null ids count as none."""
    rows = encoded.select("doc_id", F.coalesce(F.col("ids"), F.array().cast("array<int>")).alias("ids"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        model = ByteBpe(path)
        for batch in batches:
            texts = [model.decode(np.array(x, np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.large_string())], ["doc_id", "text"])

    return rows.mapInArrow(run, f"doc_id {id_type}, text string")
