"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

A vocabulary file gives pieces; a piece's log score follows its rank. The text
gets a leading space, spaces become the marker U+2581, and the best segmentation
maximises the sum of scores. A character that no piece covers costs ten less than
the worst piece and is written as its UTF-8 bytes.

When no piece of a vocabulary holds a marker after another character, no piece
crosses the start of a marked word; the best path of a text is then that of its
words one by one, and a worker remembers words. Otherwise the whole text is one
unit. Either way the result is that of Viterbi on the whole text.
"""

from __future__ import annotations

import re
from array import array
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewflow.session import ship_package

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_PENALTY = 10.0
REMEMBERED = 200_000  # words a worker remembers, of at most LONGEST characters
LONGEST = 64
BATCH = 8192  # new words segmented together
PART = 1 << 22  # characters of text encoded together


class DoubleArray:
    """A trie in two arrays: from state s, byte c leads to ``base[s] + c + 1`` if ``check`` there is s.

    Code 0 ends a piece; the state it leads to holds the piece number, negated.
    """

    def __init__(self, keys: list[bytes]):
        order = sorted(range(len(keys)), key=keys.__getitem__)
        self.base, self.check = array("i", [0]), array("i", [-2])
        self.free = 1  # no free state lies below
        pending = [(0, 0, len(order), 0)]
        while pending:
            state, low, high, depth = pending.pop()
            children: list[list[int]] = []
            for at in range(low, high):
                key = keys[order[at]]
                code = key[depth] + 1 if depth < len(key) else 0
                if children and children[-1][0] == code:
                    children[-1][2] = at + 1
                else:
                    children.append([code, at, at + 1])
            base = self._place([c[0] for c in children])
            self.base[state] = base
            for code, _, _ in children:
                self.check[base + code] = state
            for code, a, b in children:
                if code:
                    pending.append((base + code, a, b, depth + 1))
                else:
                    self.base[base] = -order[a] - 1

    def _place(self, codes: list[int]) -> int:
        """The least base at which all states of the codes are free."""
        at = max(self.free, codes[0] + 1)
        while True:
            base = at - codes[0]
            grow = base + 258 - len(self.check)
            if grow > 0:
                self.base.extend([0] * grow)
                self.check.extend([-1] * grow)
            if all(self.check[base + c] == -1 for c in codes):
                break
            at += 1
        while self.free < len(self.check) and self.check[self.free] != -1:
            self.free += 1
        return base


@dataclass
class Vocabulary:
    """Pieces by id with their scores; plain data that is sent to the workers once."""

    pieces: list[str]
    scores: list[float]
    byte_ids: list[int]  # id of each byte's piece
    special: set[int] = field(default_factory=set)
    base: list[int] = field(default_factory=list)
    check: list[int] = field(default_factory=list)

    def __post_init__(self):
        self.ids = [i for i in range(len(self.pieces)) if i not in self.special and self.pieces[i]]
        if not self.base:
            trie = DoubleArray([self.pieces[i].encode() for i in self.ids])
            self.base, self.check = trie.base.tolist(), trie.check.tolist()
        self.unknown = min((self.scores[i] for i in self.ids), default=0.0) - UNKNOWN_PENALTY
        long = "\n".join(p for i in self.ids if len(p := self.pieces[i]) > 1)
        crossing = any(re.search(f"[^{MARK}]{MARK}", self.pieces[i]) for i in self.ids)
        alone = "" if crossing else "".join(c for c in "\t\r" if c not in long)
        if not crossing and not any("\n" in self.pieces[i] for i in self.ids if len(self.pieces[i]) > 1):
            alone += "\n"
        self.words = None if crossing else re.compile(f"[{alone}]| *[^ {alone}]+| +" if alone else " *[^ ]+| +")


def load(path: str = MODEL) -> Vocabulary:
    """Read a vocabulary file on the driver.

    The public file ranks its pieces by merges and has no probabilities; a
    piece's log score is taken from its rank by Zipf's law.
    """
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    pieces = [model.id_to_piece(i) for i in range(n)]
    special = {i for i in range(n) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)}
    ranked = sorted((i for i in range(n) if i not in special), key=lambda i: (-model.get_score(i), i))
    scores, total = [0.0] * n, float(np.log(np.sum(1.0 / np.arange(1, len(ranked) + 1))))
    for rank, i in enumerate(ranked, 1):
        scores[i] = -float(np.log(rank)) - total
    byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    return Vocabulary(pieces, scores, byte_ids, special)


class Encoder:
    """Encodes and decodes with one vocabulary; keeps the words it has seen."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = v = vocabulary
        self.memory = _Memory(self)
        self.plain = [b"" if i in v.special else p.replace(MARK, " ").encode() for i, p in enumerate(v.pieces)]
        for byte, i in enumerate(v.byte_ids):
            self.plain[i] = bytes([byte])
        self.base, self.check = np.array(v.base, dtype=np.int64), np.array(v.check, dtype=np.int64)
        self.scores, self.ids = np.array(v.scores), np.array(v.ids, dtype=np.int64)
        self.is_byte = np.zeros(len(v.pieces), dtype=bool)
        self.is_byte[v.byte_ids] = True

    def viterbi(self, text: str) -> bytes:
        """The ids, as 32-bit integers, of the best segmentation; spaces stand for markers."""
        raw = text.replace(" ", MARK).encode()
        v, n = self.v, len(raw)
        base, check, scores, ids, states = v.base, v.check, v.scores, v.ids, len(v.check)
        best = array("d", [-np.inf]) * (n + 1)
        came, piece = array("q", [0]) * (n + 1), array("i", [-1]) * (n + 1)
        best[0] = 0.0
        at = 0
        while at < n:
            lead = raw[at]
            width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            here, state, end, single = best[at], 0, at, False
            while end < n:
                step = base[state] + raw[end] + 1
                if step >= states or check[step] != state:
                    break
                state, end = step, end + 1
                leaf = base[state]
                if leaf < states and check[leaf] == state and base[leaf] < 0:
                    i = ids[-base[leaf] - 1]
                    single |= end - at == width
                    if here + scores[i] > best[end]:
                        best[end], came[end], piece[end] = here + scores[i], at, i
            if not single and here + v.unknown > best[at + width]:
                best[at + width], came[at + width], piece[at + width] = here + v.unknown, at, -1
            at += width
        out, end = array("i"), n
        while end:
            start = came[end]
            if piece[end] >= 0:
                out.append(piece[end])
            else:
                out.extend(v.byte_ids[b] for b in reversed(raw[start:end]))
            end = start
        out.reverse()
        return out.tobytes()

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        text = " " + text.replace(MARK, " ")
        if self.v.words is None:
            return self.viterbi(text)
        memory = self.memory
        return b"".join([memory[w] for w in self.v.words.findall(text)])

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of several texts; new words are segmented together."""
        if self.v.words is None:
            return [self.encode(t or "") for t in texts]
        memory, split = self.memory, self.v.words.findall
        words = [split(" " + t.replace(MARK, " ")) if t else [] for t in texts]
        if len(memory) >= REMEMBERED:
            memory.clear()
        new = {w for found in words for w in found if w not in memory and len(w) <= LONGEST}
        by_length = sorted(new, key=len)
        for at in range(0, len(by_length), BATCH):
            part = by_length[at : at + BATCH]
            memory.update(zip(part, self.viterbi_many(part)))
        return [b"".join([memory[w] for w in found]) for found in words]

    def viterbi_many(self, words: list[str]) -> list[bytes]:
        """As :meth:`viterbi` for each word, one start position of all words at a time."""
        v, n = self.v, len(words)
        raw = [w.replace(" ", MARK).encode() for w in words]
        length = np.array([len(r) for r in raw])
        width = int(length.max())
        text = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in raw), dtype=np.uint8).reshape(n, width)
        best = np.full((n, width + 4), -np.inf)
        came, piece = np.zeros((n, width + 4), np.int16), np.full((n, width + 4), -1, np.int32)
        best[:, 0] = 0.0

        def offer(rows, score, start, ends, pieces):
            better = score > best[rows, ends]
            rows, ends = rows[better], ends[better]
            best[rows, ends], came[rows, ends] = score[better], start
            piece[rows, ends] = pieces if np.isscalar(pieces) else pieces[better]

        for start in range(width):
            rows = np.flatnonzero((best[:, start] > -np.inf) & (length > start))
            lead = text[rows, start]
            chars = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
            single = np.zeros(n, dtype=bool)
            wide = np.zeros(n, dtype=np.int64)
            wide[rows] = chars
            active, state = rows, np.zeros(len(rows), dtype=np.int64)
            for end in range(start, width):
                inside = length[active] > end
                active, state = active[inside], state[inside]
                step = self.base[state] + text[active, end] + 1
                step[step >= len(self.check)] = 0
                follows = self.check[step] == state
                active, state = active[follows], step[follows]
                if not len(active):
                    break
                leaf = np.minimum(self.base[state], len(self.check) - 1)
                ends = (self.check[leaf] == state) & (self.base[leaf] < 0)
                if ends.any():
                    found = self.ids[-self.base[leaf[ends]] - 1]
                    at = active[ends]
                    single[at] |= wide[at] == end + 1 - start
                    offer(at, best[at, start] + self.scores[found], start, np.full(len(at), end + 1), found)
            alone = rows[~single[rows]]
            offer(alone, best[alone, start] + v.unknown, start, start + wide[alone], -1)

        ids, at, left = np.zeros((n, width), np.int32), length.copy(), np.full(n, width)
        unknown = np.zeros(n, dtype=bool)
        rows = np.flatnonzero(at > 0)
        while len(rows):
            left[rows] -= 1
            ids[rows, left[rows]] = piece[rows, at[rows]]
            unknown[rows] |= piece[rows, at[rows]] < 0
            at[rows] = came[rows, at[rows]]
            rows = rows[at[rows] > 0]
        return [
            self.viterbi(w) if strange else row[start:].tobytes()
            for w, strange, row, start in zip(words, unknown.tolist(), ids, left.tolist())
        ]

    def decode(self, ids: list[int]) -> str:
        """The text of the ids without its leading space; bytes that are no UTF-8 become U+FFFD."""
        plain = self.plain
        text = b"".join([plain[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


class _Memory(dict):
    def __init__(self, encoder: Encoder):
        self.encoder = encoder

    def __missing__(self, word: str) -> bytes:
        found = self.encoder.viterbi(word)
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = found
        return found


_encoders: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    """One encoder per worker and vocabulary, kept between tasks."""
    if shared.bid not in _encoders:
        _encoders.clear()
        _encoders[shared.bid] = Encoder(shared.vocabulary.value)
    return _encoders[shared.bid]


@dataclass
class _Shared:
    bid: int
    vocabulary: object


def _runs(texts: list[str | None]):
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= PART:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _encode(shared: _Shared):
    def run(batches):
        encoder = _encoder(shared)
        for batch in batches:
            keys, column = batch.column(0), batch.column(1)
            for lo, hi in _runs(column.to_pylist()):
                texts = column.slice(lo, hi - lo).to_pylist()
                found = encoder.encode_all(texts)
                ends = np.concatenate([[0], np.cumsum([len(f) // 4 for f in found])]).astype(np.int64)
                ids = np.frombuffer(b"".join(found), dtype=np.int32)
                bytes_before = np.concatenate([[0], np.cumsum(encoder.is_byte[ids])])
                yield pa.RecordBatch.from_arrays([
                    keys.slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids)),
                    pa.array(np.diff(ends)), pa.array(bytes_before[ends[1:]] - bytes_before[ends[:-1]], pa.int64()),
                    pa.array([encoder.decode(ids[a:b].tolist()) == (t or "").replace(MARK, " ")
                              for t, a, b in zip(texts, ends[:-1].tolist(), ends[1:].tolist())]),
                ], names=["key", "ids", "n_pieces", "n_bytes", "round_trip"])

    return run


def _decode(shared: _Shared):
    def run(batches):
        encoder = _encoder(shared)
        for batch in batches:
            texts = [None if ids is None else encoder.decode([i for i in ids if i is not None]) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["key", "text"])

    return run


def _share(spark, model: str) -> _Shared:
    ship_package(spark)
    sent = spark.sparkContext.broadcast(load(model))  # bounded by the vocabulary file
    return _Shared(sent._jbroadcast.id(), sent)


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str = MODEL) -> DataFrame:
    """Per row: the key, ids, n_pieces, n_bytes (byte pieces) and whether decoding gives the text back.

    A null or empty text has no pieces. The marker U+2581 in a text counts as a
    space, as it does in the original scheme, and comes back as one. Rows are
    encoded each on its own; other columns are not read.
    """
    shared = _share(docs.sparkSession, model)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    found = rows.mapInArrow(_encode(shared), f"key {kind}, ids array<int>, n_pieces long, n_bytes long, round_trip boolean")
    return found.withColumnRenamed("key", key)


def decode(rows: DataFrame, key: str = "doc_id", ids: str = "ids", model: str = MODEL) -> DataFrame:
    """Per row: the key and the text of its ids; null ids give a null text."""
    shared = _share(rows.sparkSession, model)
    kind = rows.schema[key].dataType.simpleString()
    found = rows.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInArrow(_decode(shared), f"key {kind}, text string")
    return found.withColumnRenamed("key", key)
