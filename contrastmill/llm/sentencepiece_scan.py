"""SentencePiece encoding and decoding with a merge model, as a max-plus parallel scan.

The encoding of a text is what the library's merging gives: the pair whose piece has the best score
first, the leftmost of several. The scan finds it without merging. Two neighbouring pieces are
*compatible* if merging the text of both gives just these two; a segmentation whose neighbours are
all compatible is the encoding, and there is one. So a path has the sum of its pieces' scores, and
minus infinity if two neighbours are not compatible: in max-plus algebra the best path is the only
finite one. Compatibility is decided by walking back in time from the boundary over the pieces that
once met there; the pieces' merges, and which pieces merging yields at all, are found when the
model is loaded. A text is put behind one space, spaces count as the letter they stand for (and that letter as a space, as in the library), and a
character without a piece of its own is written as its bytes and costs ``UNKNOWN`` less than the
worst piece.

What does not depend on its neighbours is done once: no piece has a space after another character,
so there is a boundary where a space follows another character (and around characters that no piece
has). The stretches between such places are encoded by one vectorised forward pass over the distinct
stretches of a slice of text.

A giant text is cut at any byte into chunks that go to different tasks. The states at a cut are the
pieces that may cover the byte before it; both sides list them from the same bytes. A chunk yields
the matrix of best scores from each state at its beginning to each at its end; matrices combine
associatively, in rounds of ``FAN`` neighbours up and down again, which gives the state at each
cut, and every chunk is then traced back on its own.

Null and empty texts have no pieces. Repeated rows and repeated or null ids keep their own result
rows; an empty table gives an empty one. Other columns of the input do not matter.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrastmill.llm.arrow_text import BASE, INVERSE, powers, slices, utf8
from contrastmill.runtime import materialize

UNKNOWN = 10.0
GIANT = 1 << 17
CHUNK = 1 << 15
FAN = 64
#: Bytes of text that are encoded at once, and cells of one forward pass: a task's work space follows them.
SLICE = 2 << 20
CELLS = 1 << 21
NEVER = np.int64(1) << 40
SPACE = 0x20
SPACE_LETTER = "▁"


class Pieces:
    """The pieces of a model as bytes, in a table by hash; everything the encoder needs to know.

    Made once on the driver; its tables (a few MB, by the size of the vocabulary) go with the tasks.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        plain = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        texts = {i: model.id_to_piece(i).replace("▁", " ") for i in plain}
        self.text = {i: t.encode() for i, t in texts.items()}
        if any(" " in t.lstrip(" ") for t in texts.values()):
            raise ValueError(f"{path}: a piece has a space after another character")
        self.bytes = np.array([next((i for i in ids if model.is_byte(i) and model.id_to_piece(i) == f"<0x{b:02X}>"), -1) for b in range(256)])
        if (self.bytes < 0).any():
            raise ValueError(f"{path}: no pieces for single bytes")
        scores = np.array([model.get_score(i) for i in ids], np.float64)
        self.scores = scores
        self.unknown = min(scores[i] for i in plain) - UNKNOWN
        self.longest = max(map(len, self.text.values()))
        known = np.zeros(256, bool)
        known[list(set(b"".join(self.text.values())))] = True
        self.isolated = ~known  # bytes that no piece has
        self._learn_merges(path, texts)
        valid = [i for i in plain if self.valid[i]]
        # open addressing by the top bits of the hash, a quarter full at most
        self.bits = max(4, len(valid).bit_length() + 2)
        self.keys, self.ids = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
        lengths = np.array([len(self.text[i]) for i in valid])
        self.has_length = np.bincount(lengths, minlength=self.longest + 1) > 0
        for i in valid:
            h = hash_of(self.text[i])
            slot = h >> (64 - self.bits)
            while self.ids[slot] >= 0:
                slot = (slot + 1) & ((1 << self.bits) - 1)
            self.keys[slot], self.ids[slot] = h, i

    def _learn_merges(self, path: str, texts: dict[int, str]) -> None:
        """When and from which parts merging makes each piece, and all pairs that merge."""
        size = len(self.scores)
        many = [i for i, t in texts.items() if len(t) > 1]
        blank = {i for i, t in texts.items() if not t.strip(" ")}
        ranked = sorted(set(self.scores[many]), reverse=True)
        rank_of_score = {x: r for r, x in enumerate(ranked)}
        rank = {i: rank_of_score[self.scores[i]] for i in many}
        words = [i for i in many if i not in blank]
        if len({rank[i] for i in words}) != len(words) or any(texts[i].startswith("  ") for i in words):
            raise ValueError(f"{path}: pieces of letters with equal scores or several spaces")
        if words and min((rank[i] for i in many if i in blank), default=size) < max(rank[i] for i in words):
            raise ValueError(f"{path}: runs of spaces are not merged last")
        by_text = {t: i for i, t in texts.items()}

        def merged(text: str) -> tuple[list[str], tuple[str, str] | None]:
            """The pieces of a text, and the last merge."""
            parts, last = list(text), None
            while len(parts) > 1:
                found = [rank.get(by_text.get(x + y), size) for x, y in zip(parts, parts[1:])]
                best = min(found)
                if best == size:
                    break
                at = found.index(best)
                last = (parts[at], parts[at + 1])
                parts[at : at + 2] = ["".join(last)]
            return parts, last

        self.valid = np.zeros(size, bool)
        self.birth = np.full(size, -1, np.int64)
        self.left, self.right = np.arange(size), np.arange(size)
        for i, t in texts.items():
            if len(t) == 1:
                self.valid[i] = True
                continue
            parts, last = merged(t)
            if len(parts) == 1:
                self.valid[i] = True
                self.birth[i] = rank[i]
                self.left[i], self.right[i] = by_text[last[0]], by_text[last[1]]
        pairs = {}
        for i in many:
            t = texts[i]
            for cut in range(1, len(t)):
                x, y = by_text.get(t[:cut]), by_text.get(t[cut:])
                if x is not None and y is not None and self.valid[x] and self.valid[y]:
                    pairs[x * size + y] = max(rank[i], int(self.birth[x]), int(self.birth[y]))
        # open addressing, a quarter full at most
        self.pair_bits = max(4, len(pairs).bit_length() + 2)
        self.pair_keys = np.full(1 << self.pair_bits, -1, np.int64)
        self.pair_ranks = np.full(1 << self.pair_bits, NEVER, np.int64)
        keys = np.array(list(pairs), np.int64)
        for key, slot in zip(pairs, self._pair_slots(keys).tolist()):
            while self.pair_keys[slot] >= 0:
                slot = (slot + 1) & ((1 << self.pair_bits) - 1)
            self.pair_keys[slot], self.pair_ranks[slot] = key, pairs[key]
        # runs of spaces merge from the left, whatever their lengths
        runs = sorted(i for i in blank if self.valid[i])
        self.blank = np.zeros(size, bool)
        self.blank[runs] = True
        self.blank_pairs = np.array(
            [x * size + y for x in runs for y in runs if merged(texts[x] + texts[y])[0] == [texts[x], texts[y]]], np.int64
        )

    def _pair_slots(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(BASE)) >> np.uint64(64 - self.pair_bits)).astype(np.int64)

    def pair_rank(self, key: np.ndarray) -> np.ndarray:
        """When two neighbours merge, ``NEVER`` if they do not."""
        slot = self._pair_slots(key)
        there = self.pair_keys[slot]
        rank = np.where(there == key, self.pair_ranks[slot], NEVER)
        open_ = np.flatnonzero((there != key) & (there >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.pair_bits) - 1)
            here = slot[open_]
            there = self.pair_keys[here]
            hit = there == key[open_]
            rank[open_[hit]] = self.pair_ranks[here[hit]]
            open_ = open_[~hit & (there >= 0)]
        return rank

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves ``a`` and ``b`` side by side (ids; -1: a character without a piece)."""
        size = len(self.scores)
        out = np.ones(len(a), bool)
        at = np.flatnonzero((a >= 0) & (b >= 0))
        a, b = a[at].astype(np.int64), b[at].astype(np.int64)
        spaces = self.blank[a] & self.blank[b]
        if spaces.any():
            out[at[spaces]] = np.isin(a[spaces] * size + b[spaces], self.blank_pairs)
            at, a, b = at[~spaces], a[~spaces], b[~spaces]
        end_a, end_b = np.full(len(at), NEVER - 1), np.full(len(at), NEVER - 1)
        while len(at):
            rank = self.pair_rank(a * size + b)
            # the leftmost of equal merges comes first: the part of ``a`` is taken by then, that of ``b`` is not
            hit = (rank < end_a) & (rank <= end_b)
            out[at[hit]] = False
            birth_a, birth_b = self.birth[a], self.birth[b]
            back_a = birth_a > birth_b
            end_a, end_b = np.where(back_a, birth_a, end_a), np.where(back_a, end_b, birth_b)
            go = ~hit & ((birth_a >= 0) | (birth_b >= 0))
            a, b = np.where(back_a, self.right[a], a), np.where(back_a, b, self.left[b])
            at, a, b, end_a, end_b = at[go], a[go], b[go], end_a[go], end_b[go]
        return out

    def spelling(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the bytes of each id begin, how many they are, and the bytes of all."""
        of_byte = {int(i): bytes([b]) for b, i in enumerate(self.bytes)}
        spelled = [of_byte.get(i) or self.text.get(i, b"") for i in range(len(self.scores))]
        lengths = np.array([len(x) for x in spelled], np.int64)
        return np.cumsum(lengths) - lengths, lengths, np.frombuffer(b"".join(spelled), np.uint8)

    def find(self, h: np.ndarray) -> np.ndarray:
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.where(self.keys[slot] == h, self.ids[slot], -1)
        open_ = np.flatnonzero((self.keys[slot] != h) & (self.ids[slot] >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            here = slot[open_]
            hit = self.keys[here] == h[open_]
            out[open_[hit]] = self.ids[here[hit]]
            open_ = open_[~hit & (self.ids[here] >= 0)]
        return out


def scramble(h, length):
    return (h ^ (h >> 29)) * 0xBF58476D1CE4E5B9 + length


def hash_of(piece: bytes) -> int:
    mask, h, power = (1 << 64) - 1, 0, 1
    for b in piece:
        h = (h + (b + 1) * power) & mask
        power = power * BASE & mask
    return scramble(h, len(piece)) & mask


class Hashes:
    """Hashes of any part of some bytes."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.total = np.zeros(n + 1, np.uint64)
        # in blocks, whose powers are those of the first times one number
        own, some = self.total[1:], powers(BASE, min(n, 1 << 16))
        for first in range(0, n, 1 << 16):
            part = own[first : first + (1 << 16)]
            part[:] = data[first : first + (1 << 16)]
            part += np.uint64(1)
            part *= some[: len(part)]
            part *= np.uint64(pow(BASE, first, 1 << 64))
        np.cumsum(own, out=own)
        self.inverse = powers(INVERSE, n + 1)

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.total[end] - self.total[begin]) * self.inverse[begin]
        return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + (end - begin).astype(np.uint64)


def starts_character(data: np.ndarray) -> np.ndarray:
    return (data & 0xC0) != 0x80


def character_lengths(data: np.ndarray) -> np.ndarray:
    return np.select([data < 0x80, data < 0xE0, data < 0xF0], [1, 2, 3], 4)


def cuts(data: np.ndarray, isolated: np.ndarray) -> np.ndarray:
    """Where every segmentation has a boundary, beside the ends."""
    space, alone = data == SPACE, isolated[data]
    cut = np.zeros(len(data), bool)
    cut[1:] = (space[1:] & ~space[:-1]) | alone[1:] | alone[:-1]
    return cut & starts_character(data)


def segment(data: np.ndarray, begin: np.ndarray, end: np.ndarray, pieces: Pieces, hashes: Hashes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The one finite path through each of many stretches: ids of all, where each stretch's begin, how many, scores.

    Stretches of about the same length advance together, byte by byte.
    """
    scores, flat, done = np.zeros(len(begin)), [np.zeros(0, np.int32)], 0
    starts, counts = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
    size = end - begin
    order = np.argsort(size, kind="stable")
    first = 0
    while first < len(order):
        longest = max(8, int(size[order[first]] * 1.25))
        last = int(np.searchsorted(size[order], longest, "right"))
        last = min(last, first + max(1, CELLS // (longest + 1)))
        group = order[first:last]
        first = last
        b, n = begin[group], size[group]
        width = int(n.max(initial=0))
        best = np.full((width + 1, len(group)), -np.inf)
        best[0] = 0
        came, by = np.zeros((width + 1, len(group)), np.int32), np.full((width + 1, len(group)), -1, np.int32)
        for t in range(width):
            live = np.flatnonzero((n > t) & (best[t] > -np.inf))
            if not len(live):
                continue
            at = b[live] + t
            lead = character_lengths(data[at])
            single = np.zeros(len(live), bool)
            for length in range(1, min(pieces.longest, width - t) + 1):
                if not pieces.has_length[length]:
                    continue
                fits = n[live] >= t + length
                who, where = live[fits], at[fits]
                piece = pieces.find(hashes.of(where, where + length))
                hit = piece >= 0
                who, piece = who[hit], piece[hit]
                single[np.flatnonzero(fits)[hit]] |= lead[fits][hit] == length
                fits = pieces.compatible(by[t, who], piece) if t else np.ones(len(who), bool)
                who, piece = who[fits], piece[fits]
                value = best[t, who] + pieces.scores[piece]
                better = value > best[t + length, who]
                who, piece = who[better], piece[better]
                best[t + length, who], came[t + length, who], by[t + length, who] = value[better], length, piece
            lacking = np.flatnonzero(~single & (n[live] >= t + lead))
            if len(lacking):
                who, step = live[lacking], lead[lacking]
                value = best[t, who] + pieces.unknown
                better = value > best[t + step, who]
                who, step = who[better], step[better]
                best[t + step, who], came[t + step, who], by[t + step, who] = value[better], step, -1
        scores[group] = best[n, np.arange(len(group))]
        lane, at, steps = np.arange(len(group)), n.copy(), []
        while len(lane):
            length, piece = came[at, lane], by[at, lane]
            at = at - length
            steps.append((lane, b[lane] + at, piece, length))
            lane, at = lane[at > 0], at[at > 0]
        of, start, piece, length = (np.concatenate(x) for x in zip(*steps))
        path = np.lexsort((start, of))
        ids, count = with_bytes(data, start[path], piece[path], length[path], pieces)
        counts[group] = np.bincount(of[path], count, len(group))
        starts[group] = done + np.cumsum(counts[group]) - counts[group]
        flat.append(ids)
        done += len(ids)
    return np.concatenate(flat), starts, counts, scores


def with_bytes(data, start, piece, length, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ids of steps in order, and how many each step has: bytes one by one where there is no piece."""
    count = np.where(piece >= 0, 1, length).astype(np.int64)
    inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    whole = np.repeat(piece, count)
    return np.where(whole >= 0, whole, pieces.bytes[data[np.repeat(start, count) + inner]]).astype(np.int32), count


class Known:
    """Encodings of the stretches seen so far in a task; forgotten when there are too many."""

    def __init__(self, most: int = 400_000):
        self.most = most
        self.reset()

    def reset(self):
        self.codes, self.starts, self.lengths = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.scores, self.flat = np.zeros(0), np.zeros(0, np.int32)

    def places(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where codes are, and whether they are there."""
        if not len(self.codes):
            return np.zeros(len(codes), np.int64), np.zeros(len(codes), bool)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return at, self.codes[at] == codes

    def add(self, codes, ids, starts, lengths, scores) -> None:
        """Sorted codes that are not there yet, with what belongs to each."""
        starts = len(self.flat) + starts
        self.flat = np.concatenate([self.flat, ids])
        at = np.searchsorted(self.codes, codes)
        self.codes = np.insert(self.codes, at, codes)
        self.starts = np.insert(self.starts, at, starts)
        self.lengths = np.insert(self.lengths, at, lengths)
        self.scores = np.insert(self.scores, at, scores)


def encode_rows(data: np.ndarray, at: np.ndarray, pieces: Pieces, known: Known) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all rows, where each row's begin, and scores."""
    n = len(data)
    new = cuts(data, pieces.isolated)
    new[at[:-1][at[:-1] < n]] = True
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], n) if len(begin) else begin
    hashes = Hashes(data)
    distinct, example, which = np.unique(hashes.of(begin, end), return_index=True, return_inverse=True)
    if len(known.codes) > known.most:
        known.reset()
    _, there = known.places(distinct)
    fresh = example[~there]
    known.add(distinct[~there], *segment(data, begin[fresh], end[fresh], pieces, hashes))
    place, _ = known.places(distinct)
    place = place[which]
    count = known.lengths[place]
    total = np.concatenate([[0], np.cumsum(count)])
    inner = np.arange(total[-1]) - np.repeat(total[:-1], count)
    out = known.flat[np.repeat(known.starts[place], count) + inner]
    rows = np.searchsorted(begin, at)
    row = np.repeat(np.arange(len(at) - 1), np.diff(rows))
    return out, total[rows], np.bincount(row, known.scores[place], len(at) - 1)


def _encode(pieces: Pieces):
    def run(batches):
        known = Known()
        for batch in batches:
            data, at = utf8(batch.column("spaced"))
            for first, last in slices(at, SLICE):
                part, begin = data[at[first] : at[last]], at[first : last + 1] - at[first]
                ids, offsets, scores = encode_rows(part, begin, pieces, known)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[first:last], pa.ListArray.from_arrays(offsets.astype(np.int32), pa.array(ids, pa.int32())), pa.array(scores, pa.float64())],
                    ["doc_id", "ids", "score"],
                )

    return run


class Chunk:
    """What may happen in a chunk and at its cuts.

    ``data`` holds the ``lead`` bytes before the chunk, its ``size`` bytes and what follows, both as
    far as a piece can reach. An edge is a place where a piece may stand: begin, end, id (-1: bytes).
    """

    def __init__(self, data: np.ndarray, lead: int, size: int, pieces: Pieces):
        self.data, self.begin, self.end, self.pieces = data, lead, lead + size, pieces
        hashes, n = Hashes(data), len(data)
        at = np.flatnonzero(starts_character(data[: self.end]))
        wide = character_lengths(data[at])
        single = np.zeros(len(at), bool)
        found = []
        for length in np.flatnonzero(pieces.has_length).tolist():
            fits = np.flatnonzero(at + length <= n)
            piece = pieces.find(hashes.of(at[fits], at[fits] + length))
            fits, piece = fits[piece >= 0], piece[piece >= 0]
            single[fits] |= wide[fits] == length
            found.append((at[fits], at[fits] + length, piece))
        bare = ~single & (at + wide <= n)
        found.append((at[bare], at[bare] + wide[bare], np.full(int(bare.sum()), -1)))
        start, stop, piece = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((stop, start))
        self.start, self.stop, self.piece = start[order], stop[order], piece[order].astype(np.int64)
        self.entries = self.states(self.begin) if lead else np.array([-1])
        self.exits = self.states(self.end) if n > self.end else np.flatnonzero(self.stop == n)

    def states(self, cut: int) -> np.ndarray:
        """Edges that cover the byte before a cut, in an order that both sides of it share."""
        reach = self.pieces.longest
        return np.flatnonzero((self.start < cut) & (self.start >= cut - reach) & (self.stop >= cut))

    def walk(self, entries: np.ndarray):
        """Best scores from each of some entries to each edge, and the edges before each edge."""
        own = np.flatnonzero(self.start >= self.begin)
        by_stop = np.argsort(self.stop, kind="stable")
        stops = self.stop[by_stop]
        low, high = np.searchsorted(stops, self.start[own]), np.searchsorted(stops, self.start[own], "right")
        count = high - low
        after = np.repeat(own, count)
        inner = np.arange(len(after)) - np.repeat(np.cumsum(count) - count, count)
        before = by_stop[np.repeat(low, count) + inner]
        fits = self.pieces.compatible(self.piece[before], self.piece[after])
        before, after = before[fits], after[fits]
        first = np.searchsorted(after, own)
        last = np.searchsorted(after, own, "right")
        value: dict[int, np.ndarray] = {}
        for lane, edge in enumerate(entries.tolist()):
            if edge >= 0:
                value[edge] = np.where(np.arange(len(entries)) == lane, 0.0, -np.inf)
        cost = np.where(self.piece >= 0, self.pieces.scores[self.piece], self.pieces.unknown)
        came: dict[int, list[int]] = {}
        ends: dict[int, list[int]] = {}
        done = 0
        starts, before = self.start.tolist(), before.tolist()
        stop = self.stop.tolist()
        for edge, a, z in zip(own.tolist(), first.tolist(), last.tolist()):
            here = [p for p in before[a:z] if p in value]
            best = None
            for p in here:
                best = value[p] if best is None else np.maximum(best, value[p])
            if starts[edge] == 0 and entries[0] < 0:
                best = np.zeros(1)
            if best is not None and best.max() > -np.inf:
                value[edge], came[edge] = best + cost[edge], here
                ends.setdefault(stop[edge], []).append(edge)
            # what ends before this place, and is no state of the cut, is not needed any more
            while done < starts[edge] and len(entries) > 1:
                if done < self.end - 1:
                    for old in ends.pop(done, ()):
                        del value[old]
                done += 1
        return value, came

    def matrix(self) -> np.ndarray:
        value, _ = self.walk(self.entries)
        nothing = np.full(len(self.entries), -np.inf)
        return np.stack([value.get(e, nothing) for e in self.exits.tolist()], axis=1)

    def trace(self, enter: int, leave: int) -> np.ndarray:
        """Ids of the pieces that begin in the chunk on the path between two states."""
        entry = self.entries[enter : enter + 1]
        value, came = self.walk(entry)
        edge, out = int(self.exits[leave]), []
        while self.start[edge] >= self.begin:
            piece = int(self.piece[edge])
            spelled = self.data[self.start[edge] : self.stop[edge]]
            out += [piece] if piece >= 0 else self.pieces.bytes[spelled][::-1].tolist()
            if not came[edge]:
                break
            edge = max(came[edge], key=lambda p: value[p][0])
        return np.array(out[::-1], np.int32)


def packed(m: np.ndarray) -> bytes:
    return np.array(m.shape, np.int64).tobytes() + m.astype(np.float64).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    shape = np.frombuffer(raw[:16], np.int64)
    return np.frombuffer(raw[16:], np.float64).reshape(shape)


def _matrices(pieces: Pieces):
    def run(frames):
        for frame in frames:
            for r in frame.itertuples(index=False):
                m = Chunk(np.frombuffer(r.data, np.uint8), r.lead, r.size, pieces).matrix()
                yield pd.DataFrame({"key": [r.key], "number": [r.number], "matrix": [packed(m)]})

    return run


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product: the best way through two neighbouring parts."""
    return np.stack([(row[:, None] + b).max(axis=0) for row in a])


def _products(frame: pd.DataFrame) -> pd.DataFrame:
    """The product of up to ``FAN`` neighbouring matrices."""
    frame = frame.sort_values("number")
    total = None
    for raw in frame["matrix"]:
        total = unpacked(raw) if total is None else combine(total, unpacked(raw))
    return pd.DataFrame({"key": frame["key"][:1], "number": frame["number"][:1] // FAN, "matrix": [packed(total)]})


def _states(frame: pd.DataFrame) -> pd.DataFrame:
    """The states around each of up to ``FAN`` neighbours, from those around all of them."""
    frame = frame.sort_values("number")
    matrices = [unpacked(raw) for raw in frame["matrix"]]
    ahead = [matrices[0][int(frame["from"].iloc[0])]]
    for m in matrices[1:]:
        ahead.append((ahead[-1][:, None] + m).max(axis=0))
    state = int(frame["to"].iloc[0])
    leave = [state]
    for i in range(len(matrices) - 1, 0, -1):
        state = int(np.argmax(ahead[i - 1] + matrices[i][:, state]))
        leave.append(state)
    leave = leave[::-1]
    return pd.DataFrame({"key": frame["key"], "number": frame["number"], "enter": [int(frame["from"].iloc[0]), *leave[:-1]], "leave": leave})


def _whole(frames):
    """Of the matrix of a whole document its score and last state; no piece reaches beyond the end."""
    for frame in frames:
        ends = [unpacked(raw)[0] for raw in frame["matrix"]]
        yield pd.DataFrame({"key": frame["key"], "number": 0, "enter": 0, "leave": [int(e.argmax()) for e in ends], "score": [float(e.max()) for e in ends]})


def chunk_states(matrices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``key, number, enter, leave`` of every chunk and ``key, score`` of every document."""
    levels = [matrices]
    while levels[-1].agg(F.max("number")).first()[0] > 0:
        group = (F.col("number") / FAN).cast("long")
        levels.append(materialize(levels[-1].groupBy("key", group.alias("__group")).applyInPandas(_products, "key string, number long, matrix binary")))
    whole = materialize(levels[-1].mapInPandas(_whole, "key string, number long, enter int, leave int, score double"))
    states = whole.drop("score")
    for level in levels[-2::-1]:
        above = states.select("key", F.col("number").alias("__group"), F.col("enter").alias("from"), F.col("leave").alias("to"))
        inside = level.withColumn("__group", (F.col("number") / FAN).cast("long")).join(above, ["key", "__group"])
        states = materialize(inside.groupBy("key", "__group").applyInPandas(_states, "key string, number long, enter int, leave int"))
    return states, whole.select("key", "score")


def _trace_chunks(pieces: Pieces):
    def run(frames):
        for frame in frames:
            for r in frame.itertuples(index=False):
                ids = Chunk(np.frombuffer(r.data, np.uint8), r.lead, r.size, pieces).trace(r.enter, r.leave)
                yield pd.DataFrame({"key": [r.key], "number": [r.number], "ids": [ids]})

    return run


def _cut_chunks(longest: int, chunk: int):
    def run(frames):
        for frame in frames:
            for key, text in zip(frame["key"], frame["spaced"]):
                raw = text.encode()
                for number, begin in enumerate(range(0, len(raw), chunk)):
                    size, lead = min(chunk, len(raw) - begin), min(begin, longest)
                    data = raw[begin - lead : begin + size + longest]
                    yield pd.DataFrame({"key": [key], "number": [number], "lead": [lead], "size": [size], "data": [data]})

    return run


def encode(docs: DataFrame, model_path: str, giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """``doc_id, ids, score`` of every row of ``docs`` (``doc_id``, ``text``)."""
    pieces = Pieces(model_path)
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.replace(F.make_valid_utf8("text"), F.lit(SPACE_LETTER), F.lit(" "))
    spaced = F.when(F.length("text") > 0, F.concat(F.lit(" "), text)).otherwise("").alias("spaced")
    # the length as it is comes first: a text that is shorter than ``giant`` is not spaced to be told apart
    near, size = F.octet_length("text") >= giant, F.octet_length(spaced)
    small = docs.where(~near | (size <= giant)).select("doc_id", spaced)
    small = small.mapInArrow(_encode(pieces), f"doc_id {kind}, ids array<int>, score double")
    large = docs.where(near & (size > giant)).select("doc_id", spaced)
    large = large.select("doc_id", F.sha2("spaced", 256).alias("key"), "spaced")
    named = materialize(large.select("doc_id", "key"))
    if named.isEmpty():
        return small
    columns = "key string, number long, lead long, size long, data binary"
    chunks = large.select("key", "spaced").mapInPandas(_cut_chunks(pieces.longest, chunk), columns)
    chunks = materialize(chunks.dropDuplicates(["key", "number"]))
    matrices = materialize(chunks.mapInPandas(_matrices(pieces), "key string, number long, matrix binary"))
    states, scores = chunk_states(matrices)
    traced = chunks.join(states, ["key", "number"]).mapInPandas(_trace_chunks(pieces), "key string, number long, ids array<int>")
    whole = traced.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("number", "ids"))).alias("parts"))
    whole = whole.select("key", F.flatten(F.col("parts.ids")).alias("ids")).join(scores, "key")
    return small.unionByName(named.join(whole, "key").select("doc_id", "ids", "score"))


def decoded(ids: pa.ListArray, spelling: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.Array:
    """The text of each list of ids; null lists count as empty."""
    flat = ids.flatten().to_numpy()
    rows = np.concatenate([[0], np.cumsum(ids.value_lengths().fill_null(0).to_numpy().astype(np.int64))])
    starts, lengths, table = spelling
    flat = np.where((flat >= 0) & (flat < len(starts)), flat, 0)
    size = lengths[flat]
    total = np.concatenate([[0], np.cumsum(size)])
    inner = np.arange(total[-1]) - np.repeat(total[:-1], size)
    data = table[np.repeat(starts[flat], size) + inner]
    at = total[rows]
    # the space before each text
    first = at[:-1][(at[1:] > at[:-1])]
    keep = np.ones(len(data), bool)
    keep[first[data[first] == SPACE]] = False
    at = np.concatenate([[0], np.cumsum(keep)])[at]
    data = np.ascontiguousarray(data[keep])
    raw = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)])
    try:
        return raw.cast(pa.large_string()).cast(pa.string())
    except pa.ArrowInvalid:  # ids that are not from an encoder may break a character
        return pa.array([x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.string())


def _decode(spelling: tuple[np.ndarray, np.ndarray, np.ndarray]):
    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                yield pa.RecordBatch.from_arrays([*part.columns, decoded(part.column("ids"), spelling)], [*part.schema.names, "text"])

    return run


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """``encoded`` (``ids`` and any other columns but ``text``) with the ``text`` of every row."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(_decode(Pieces(model_path).spelling()), f"{schema}, text string")
