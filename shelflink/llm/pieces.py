"""SentencePiece encoding and decoding with the n best segmentations.

A vocabulary of pieces with log probabilities spans a lattice over the text.  Forward Viterbi
gives, for every position, the best score of any path to it; going backward from the end these
scores are exact heuristics, so A* search takes paths off its agenda in order of their total
score: the first is the best segmentation, the next the second best, and so on.

Whole texts stay affordable because no piece contains a word start behind other letters: the
lattice falls apart at word starts (and at letters that no longer piece holds) into units.  The
forward pass runs over all distinct units of a batch at once with NumPy: pieces are found by
walking a trie from every position, and the best and second best score of every position are
carried along.  A document's best path joins its units' best paths; of its n best, only the n - 1
places that lose least by their second best path can differ, so only those units are searched
backward, and the document's alternatives come from the same kind of search over these places.

Spaces are written as the word-start mark; what no piece covers (and the mark itself, if a text
has it) is spelled in byte pieces, so decoding gives back every text exactly.

Scores: unigram models bring log probabilities; for models that only rank their pieces, Zipf's law
over the rank stands in.  Of equal scores the path with fewer pieces comes first.  Edge cases: null
and empty texts have one segmentation, without pieces, of score 0; a text with fewer than n
segmentations returns those it has; repeated rows give equal rows; extra columns are ignored; texts
of any length are encoded whole.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
#: Stands before a mark that the text itself contains.
LITERAL = "\x00" + MARK
#: Letters encoded at a time (a longer text is a batch of its own), and rows whose texts are held as
#: Python strings at a time: a task's memory follows these, not the size of Spark's Arrow batches.
BATCH_LETTERS = 200_000
BATCH_ROWS = 256
#: Longer units (rare) are searched one by one.
LONG_UNIT = 64


class Vocabulary:
    """Pieces, scores and byte pieces of a model; small (one entry a piece), sent to every task."""

    def __init__(self, pieces: list[str | None], scores: list[float], bytes_at: list[int]):
        self.bytes_at, self.n_pieces = bytes_at, len(pieces)
        self.id_of = {p: k for k, p in enumerate(pieces) if p is not None}
        self.byte_score = min(scores, default=0.0) - 1.0
        inner = sorted({c for p in self.id_of if len(p) > 1 for c in p} - {MARK})
        # letters inside pieces that are no piece themselves: extra entries, spelled in bytes
        self.pieces, self.score = list(pieces), list(scores)
        for c in [MARK, *inner]:
            if c not in self.id_of:
                self.id_of[c] = len(self.pieces)
                self.pieces.append(c)
                self.score.append(self.byte_score * len(c.replace(MARK, " ").encode()))
        # which lengths begin with these two letters: most places are settled by one look
        lengths = defaultdict(set)
        for p in self.id_of:
            lengths[p[:2]].add(len(p))
        self.lengths = {k: sorted(v) for k, v in lengths.items()}
        self.longest = max(map(len, self.id_of), default=1)
        alone = re.escape("".join(inner))
        self.unit = re.compile(rf"{MARK}+[{alone}]*|[{alone}]+|[^{MARK}{alone}]" if inner else rf"{MARK}+|[^{MARK}]")
        self.inner = {MARK, *inner}
        self._arrays()

    def _arrays(self) -> None:
        """The trie and the spellings as arrays."""
        self.scores = np.array(self.score)
        self.letter = np.zeros(0x110000, dtype=np.int32)
        for k, c in enumerate(sorted(self.inner)):
            self.letter[ord(c)] = k + 1
        width = len(self.inner) + 1
        steps, piece = {}, [-1]
        for p, k in self.id_of.items():
            if not self.inner.issuperset(p):
                continue
            node = 0
            for c in p:
                key = node * width + int(self.letter[ord(c)])
                if key not in steps:
                    steps[key] = len(piece)
                    piece.append(-1)
                node = steps[key]
            piece[node] = k
        self.width, self.node_piece = width, np.array(piece, dtype=np.int32)
        self.shift = 64 - max(4, (4 * len(steps)).bit_length())
        size = 1 << (64 - self.shift)
        self.table_key, self.table_node = np.full(size, -1, dtype=np.int64), np.zeros(size, dtype=np.int32)
        for key, node in steps.items():
            slot = (key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> self.shift
            while self.table_key[slot] >= 0:
                slot = (slot + 1) & (size - 1)
            self.table_key[slot], self.table_node[slot] = key, node
        spelled = [self._spell(k) for k in range(self.n_pieces)]
        self.spelled = spelled
        self.spell_size = np.array([len(x) for x in spelled], dtype=np.int64)
        self.spell_start = np.cumsum(self.spell_size) - self.spell_size
        self.spell_bytes = np.frombuffer(b"".join(spelled), dtype=np.uint8)
        real = [self.real(k) for k in range(len(self.pieces))]
        self.real_size = np.array([len(x) for x in real], dtype=np.int64)
        self.real_start = np.cumsum(self.real_size) - self.real_size
        self.real_ids = np.array([x for ids in real for x in ids], dtype=np.int32)

    def real(self, k: int) -> list[int]:
        """Ids of the model for an entry: itself, or byte pieces."""
        return [k] if k < self.n_pieces else [self.bytes_at[b] for b in self.pieces[k].replace(MARK, " ").encode()]

    def step(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """Follow the trie; -1 where it ends."""
        key = node.astype(np.int64) * self.width + letter
        slot = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self.shift)).astype(np.int64)
        held = self.table_key[slot]
        out = np.where(held == key, self.table_node[slot], -1)
        open_ = np.flatnonzero((held != key) & (held >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.table_key) - 1)
            held = self.table_key[slot[open_]]
            hit = held == key[open_]
            out[open_[hit]] = self.table_node[slot[open_[hit]]]
            open_ = open_[~hit & (held >= 0)]
        return out

    def _spell(self, k: int) -> bytes:
        p = self.pieces[k]
        if p is not None:
            return p.replace(MARK, " ").encode()
        return bytes([self.bytes_at.index(k)]) if k in self.bytes_at else b""

    @staticmethod
    def load(model_file: str) -> "Vocabulary":
        """Read a model file (on the driver)."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces, scores, bytes_at = [], [], [0] * 256
        unigram = False
        for k in range(model.get_piece_size()):
            piece = model.id_to_piece(k)
            if model.is_byte(k):
                bytes_at[int(piece[3:5], 16)] = k
            normal = not (model.is_byte(k) or model.is_control(k) or model.is_unknown(k) or model.is_unused(k))
            pieces.append(piece if normal else None)
            scores.append(model.get_score(k))
            unigram = unigram or (normal and scores[-1] != int(scores[-1]))
        if not unigram:
            ranked = sorted((k for k, p in enumerate(pieces) if p is not None), key=lambda k: (-scores[k], k))
            total = math.log(sum(1.0 / (r + 1) for r in range(len(ranked))))
            for r, k in enumerate(ranked):
                scores[k] = -math.log(r + 1) - total
            least = min(scores[k] for k in ranked)
            scores = [s if p is not None else least - 1.0 for s, p in zip(scores, pieces)]
        return Vocabulary(pieces, scores, bytes_at)

    def units(self, text: str) -> list[str]:
        """The text in marks, cut where no piece can cross."""
        if not text:
            return []
        if MARK not in text:
            return self.unit.findall(MARK + text.replace(" ", MARK))
        # the mark itself stands alone, spelled in bytes
        first, *rest = text.split(MARK)
        out = self.unit.findall(MARK + first.replace(" ", MARK))
        for part in rest:
            out += [LITERAL, *self.unit.findall(part.replace(" ", MARK))]
        return out

    def edges(self, unit: str, start: int) -> list[tuple[int, int, float]]:
        """(end, entry, score) of what can follow at ``start``."""
        out = []
        for size in self.lengths.get(unit[start : start + 2], ()):
            found = self.id_of.get(unit[start : start + size]) if 1 < size <= len(unit) - start else None
            if found is not None:
                out.append((start + size, found, self.score[found]))
        one = self.id_of.get(unit[start], -1)
        out.append((start + 1, one, self.score[one] if one >= 0 else self.byte_score * len(unit[start].encode())))
        return out

    def search(self, unit: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best (score, ids) of a unit: forward Viterbi, then A* from the end."""
        if unit == LITERAL:
            return [(self.byte_score * 3, tuple(self.bytes_at[b] for b in MARK.encode()))]
        size = len(unit)
        best: list[tuple[float, int]] = [(0.0, 0)] + [(-math.inf, 0)] * size
        into: list[list[tuple[int, int, float]]] = [[] for _ in range(size + 1)]
        for at in range(size):
            score, count = best[at]
            for end, piece, gain in self.edges(unit, at):
                into[end].append((at, piece, gain))
                if (score + gain, -(count + 1)) > (best[end][0], -best[end][1]):
                    best[end] = (score + gain, count + 1)
        # agenda: (-(score behind + best score ahead), pieces, tie, place, score behind, pieces behind, path)
        agenda, found, tie = [(-best[size][0], best[size][1], 0, size, 0.0, 0, None)], [], 0
        while agenda and len(found) < n:
            _, _, _, at, behind, used, path = heapq.heappop(agenda)
            if at == 0:
                ids = []
                while path is not None:
                    piece, where, path = path
                    ids += self.real(piece) if piece >= 0 else [self.bytes_at[b] for b in unit[where].encode()]
                found.append((behind, tuple(ids)))
                continue
            for start, piece, gain in into[at]:
                tie += 1
                score = behind + gain
                heapq.heappush(agenda, (-(score + best[start][0]), used + 1 + best[start][1], tie, start, score, used + 1, (piece, start, path)))
        return found

    def forward(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Best and second best score of each unit, and the ids of the best path: (best, second,
        ids, first id, number of ids)."""
        plain = np.array([len(u) <= LONG_UNIT and u[0] in self.inner for u in units], dtype=bool)
        best, second = np.zeros(len(units)), np.full(len(units), -np.inf)
        begin, size = np.zeros(len(units), dtype=np.int64), np.zeros(len(units), dtype=np.int64)
        at = np.flatnonzero(plain)
        best[at], second[at], ids, begin[at], size[at] = self._viterbi([units[k] for k in at])
        more = []
        for k in np.flatnonzero(~plain):
            found = self.search(units[k], 2)
            best[k], begin[k], size[k] = found[0][0], len(ids) + len(more), len(found[0][1])
            second[k] = found[1][0] if len(found) > 1 else -np.inf
            more += found[0][1]
        return best, second, np.concatenate([ids, np.array(more, dtype=np.int32)]), begin, size

    def _viterbi(self, units: list[str]):
        size = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
        letters = self.letter[np.frombuffer("".join(units).encode("utf-32-le"), dtype=np.uint32)]
        begin = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(units)), size)
        place = np.arange(len(letters)) - begin[owner]
        left = size[owner] - place
        # one row a position and one more for each end; ``edges[l]``: pieces of l letters, by place
        edges, at, node = [], np.arange(len(letters)), np.zeros(len(letters), dtype=np.int32)
        for span in range(1, self.longest + 1):
            ok = left[at] >= span
            at, node = at[ok], node[ok]
            node = self.step(node, letters[at + span - 1])
            at, node = at[node >= 0], node[node >= 0]
            if not len(at):
                break
            piece = self.node_piece[node]
            held = piece >= 0
            where, piece = at[held], piece[held]
            order = np.argsort(place[where].astype(np.int16), kind="stable")
            where, piece = where[order], piece[order]
            edges.append((span, where + owner[where], piece, np.searchsorted(place[where], np.arange(LONG_UNIT + 1))))
        first = begin + np.arange(len(units))
        rows = len(letters) + len(units)
        top, next_, count = np.full(rows, -np.inf), np.full(rows, -np.inf), np.zeros(rows, dtype=np.int32)
        back, taken = np.zeros(rows, dtype=np.int32), np.zeros(rows, dtype=np.int32)
        top[first] = 0.0
        for k in range(int(size.max(initial=0))):
            for span, source, piece, cuts in edges:
                s, p = source[cuts[k] : cuts[k + 1]], piece[cuts[k] : cuts[k + 1]]
                if not len(s):
                    continue
                t, gain = s + span, self.scores[p]
                one, two, old, steps = top[s] + gain, next_[s] + gain, top[t], count[s] + 1
                wins = (one > old) | ((one == old) & (steps < count[t]))
                next_[t] = np.where(wins, np.maximum(old, two), np.maximum(next_[t], one))
                t, s, p = t[wins], s[wins], p[wins]
                top[t], count[t], back[t], taken[t] = one[wins], steps[wins], span, p
        end = first + size
        steps = count[end].astype(np.int64)
        start = np.cumsum(steps) - steps
        entries = np.zeros(int(steps.sum()), dtype=np.int32)
        cur, slot = end.copy(), start + steps - 1
        live = np.flatnonzero(cur > first)
        while len(live):
            c = cur[live]
            entries[slot[live]] = taken[c]
            cur[live] = c - back[c]
            slot[live] -= 1
            live = live[cur[live] > first[live]]
        best, second = top[end], next_[end]
        if len(entries) and entries.max() >= self.n_pieces:  # some letters are spelled in bytes
            grown = self.real_size[entries]
            total = np.concatenate([[0], np.cumsum(grown)])
            entries = self.real_ids[spread(self.real_start[entries], grown)]
            start, steps = total[start], total[start + steps] - total[start]
        return best, second, entries, start, steps


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... (``size`` numbers) for each entry, one after another."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _least_loss(options: list[list[float]]) -> Iterator[tuple[float, tuple[int, ...]]]:
    """Choices of one alternative each (losses ascending), in order of the sum of losses."""
    start = (0,) * len(options)
    agenda, seen = [(0.0, start)], {start}
    while agenda:
        lost, picks = heapq.heappop(agenda)
        yield lost, picks
        for k, option in enumerate(options):
            if picks[k] + 1 < len(option):
                more = (*picks[:k], picks[k] + 1, *picks[k + 1 :])
                if more not in seen:
                    seen.add(more)
                    heapq.heappush(agenda, (lost - option[picks[k]] + option[picks[k] + 1], more))


class Encoder:
    """Encodes batches of texts."""

    def __init__(self, vocabulary: Vocabulary, n: int):
        self.v, self.n = vocabulary, n
        self.searched: dict[str, list[tuple[float, tuple[int, ...]]]] = {}

    def _alternatives(self, unit: str) -> list[tuple[float, tuple[int, ...]]]:
        if len(self.searched) > 50_000:  # only saves time
            self.searched.clear()
        if unit not in self.searched:
            self.searched[unit] = self.v.search(unit, self.n)
        return self.searched[unit]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[list[tuple]]]:
        """Ids of all texts in a row, where each text begins (and the last ends), and for each
        text its n best as (score, number of pieces, changes against the best: (place, pieces
        dropped, ids put in))."""
        number: defaultdict[str, int] = defaultdict()
        number.default_factory = number.__len__
        cut = [np.fromiter(map(number.__getitem__, u), dtype=np.int64, count=len(u)) for u in (self.v.units(t or "") for t in texts)]
        names = list(number)
        best, second, flat, begin, size = self.v.forward(names)
        units = np.concatenate(cut) if cut else np.zeros(0, dtype=np.int64)
        ids = flat[spread(begin[units], size[units])]
        after = np.concatenate([[0], np.cumsum(size[units])])
        ends = np.concatenate([[0], np.cumsum([len(c) for c in cut], dtype=np.int64)])
        loss = best - second
        nbest = []
        for k, own in enumerate(cut):
            score, held = float(best[own].sum()), int(after[ends[k + 1]] - after[ends[k]])
            nbest.append([(score, held, [])])
            if self.n == 1 or not len(own):
                continue
            lost, want = loss[own], min(self.n - 1, len(own))
            close = np.flatnonzero(lost <= np.partition(lost, want - 1)[want - 1])
            places = np.sort(close[np.argsort(lost[close], kind="stable")][:want])
            options = [self._alternatives(names[own[x]]) for x in places]
            choices = _least_loss([[o[0][0] - s for s, _ in o] for o in options])
            for gone, picks in islice(choices, 1, self.n):
                changes, pieces = [], held
                for x, option, pick in zip(places, options, picks):
                    if pick:
                        drop, put = int(size[own[x]]), list(option[pick][1])
                        changes.append((int(after[ends[k] + x] - after[ends[k]]), drop, put))
                        pieces += len(put) - drop
                nbest[-1].append((score - gone, pieces, changes))
        return ids, after[ends], nbest

    def decoded(self, ids: np.ndarray) -> bytes:
        """The bytes that ids spell, word-start marks as spaces."""
        return self.v.spell_bytes[spread(self.v.spell_start[ids], self.v.spell_size[ids])].tobytes()


def expand(ids: list[int], changes: list) -> list[int]:
    """An alternative segmentation from the best one and its changes."""
    out, at = [], 0
    for place, drop, put in changes:
        out += [*ids[at:place], *put]
        at = place + drop
    return out + list(ids[at:])


def default_model() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


_CHANGE = pa.struct([("at", pa.int32()), ("drop", pa.int32()), ("put", pa.list_(pa.int32()))])
_PATH = pa.struct([("score", pa.float64()), ("n_pieces", pa.int32()), ("changes", pa.list_(_CHANGE))])
_NBEST = "array<struct<score: double, n_pieces: int, changes: array<struct<at: int, drop: int, put: array<int>>>>>"


def _batches(texts: list) -> Iterator[slice]:
    start, held = 0, 0
    for k, text in enumerate(texts):
        if held and held + len(text or "") > BATCH_LETTERS:
            yield slice(start, k)
            start, held = k, 0
        held += len(text or "")
    if start < len(texts):
        yield slice(start, len(texts))


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list]]:
    """Ids and texts of a batch, as many rows at a time as are encoded together."""
    for start in range(0, batch.num_rows, BATCH_ROWS):
        rows = batch.slice(start, BATCH_ROWS)
        texts = rows.column(1).to_pylist()
        for part in _batches(texts):
            yield rows.column(0).slice(part.start, part.stop - part.start), texts[part]


def encode(docs: DataFrame, model_file: str | None = None, n: int = 4) -> DataFrame:
    """One row a document: doc_id, ``ids`` of the best segmentation, ``n_pieces``, ``nbest`` (score,
    number of pieces and changes against the best, see ``expand``), and ``round_trip``: whether the
    ids decode to the text."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model_file or default_model()))
    schema = pa.schema([
        ("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("n_pieces", pa.int64()), ("nbest", pa.list_(_PATH)), ("round_trip", pa.bool_()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary.value, n)
        for batch in batches:
            for doc_ids, own in _parts(batch):
                ids, ends, nbest = encoder.encode(own)
                spelled = [b" " + t.encode() if t else b"" for t in own]
                exact = [True] * len(own)
                if encoder.decoded(ids) != b"".join(spelled):
                    exact = [encoder.decoded(ids[ends[k] : ends[k + 1]]) == x for k, x in enumerate(spelled)]
                paths = [[{"score": s, "n_pieces": c, "changes": [{"at": a, "drop": d, "put": p} for a, d, p in x]} for s, c, x in found] for found in nbest]
                yield pa.RecordBatch.from_arrays([
                    doc_ids, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids)),
                    pa.array(np.diff(ends), pa.int64()), pa.array(paths, schema[3].type), pa.array(exact),
                ], schema=schema)

    kinds = f"doc_id bigint, ids array<int>, n_pieces bigint, nbest {_NBEST}, round_trip boolean"
    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text").mapInArrow(run, kinds)


def decode(encoded: DataFrame, model_file: str | None = None) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""
    vocabulary = encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(model_file or default_model()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelled = vocabulary.value.spelled
        for batch in batches:
            texts = [None if ids is None else b"".join(map(spelled.__getitem__, ids))[1:].decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")
