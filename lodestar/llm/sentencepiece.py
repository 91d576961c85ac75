"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

The model file gives pieces, their kinds and scores; nothing is trained. A unigram model's scores
are log probabilities and are used as they are. A file of another kind holds merge ranks instead;
its pieces then get the log probabilities of Zipf's law over those ranks, log(1/(rank + 1)/H).

Encoding escapes blanks as U+2581, puts one in front (where the file says so), and picks the
segmentation with the largest sum of log scores; of equal sums, at each
end, the one with the longest last piece. A character that no piece of one character covers may also be taken alone
at the least score minus 10, and becomes its UTF-8 bytes (byte pieces) or the unknown piece.
No piece crosses from another character into U+2581, nor holds a line feed, so the best path of a
text is the best paths of its segments between those places; that is checked when a model is
loaded, and a model that breaks it is segmented as a whole. Segments repeat: each worker keeps
the paths of those it met, forgets them when there are many, and solves new ones in blocks, all
segments of a block at once, position by position.

Cases: a null text has no ids (an empty array) and decodes to null; an empty text has none and
decodes to ''. A literal U+2581 in a text comes back as a blank, as SentencePiece does; such
texts have ``same`` false. Rows are independent, so repeated rows and ties need no rule.
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.common import bounded, pieces

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
#: The file's numbers for kinds of pieces and models. Fixed values of the format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM = 1
UNKNOWN_PENALTY = 10.0
#: A worker forgets its segments beyond so many; blocks of new segments are this large in bytes.
CACHE, BLOCK = 600_000, 4_000_000
TEXTS = 1 << 20


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The (number, value) pairs of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        n = {1: 8, 5: 4}[kind] if kind != 2 else varint()
        yield key >> 3, data[at : at + n]
        at += n


@dataclass
class Model:
    """Pieces by id, log scores of the pieces that text can match, and the trie over their bytes."""

    pieces: list[str]
    kinds: list[int]
    scores: dict[int, float]
    prefix: bool = True
    unknown: int = 0
    base: np.ndarray = field(default=None)
    check: np.ndarray = field(default=None)
    value: np.ndarray = field(default=None)

    def __post_init__(self) -> None:
        self.least = min(self.scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.by_byte = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}
        self.fallback = len(self.by_byte) == 256
        keys = {self.pieces[i].encode(): i for i in sorted(self.scores, reverse=True)}
        self.base, self.check, self.value = double_array(keys)
        self.score = np.array([self.scores.get(i, 0.0) for i in range(len(self.pieces))])
        self.split = not any(BLANK in self.pieces[i].lstrip(BLANK) or "\n" in self.pieces[i] for i in self.scores)
        self.raw = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.encode() for p, k in zip(self.pieces, self.kinds)]


def load(path: str = MODEL) -> Model:
    """Read a SentencePiece model file; its normaliser must be the identity."""
    with open(path, "rb") as file:
        data = file.read()
    pieces, kinds, scores, kind, norm = [], [], [], UNIGRAM, {}
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            pieces.append(piece[1].decode())
            scores.append(struct.unpack("<f", piece[2])[0])
            kinds.append(piece.get(3, NORMAL))
        elif number == 2:
            kind = dict(_fields(value)).get(3, UNIGRAM)
        elif number == 3:
            norm = dict(_fields(value))
    if norm.get(2) or norm.get(4, 1):
        raise ValueError("only models whose normaliser keeps the text are read")
    usable = [i for i, k in enumerate(kinds) if k in (NORMAL, USER)]
    if kind == UNIGRAM:
        logs = {i: scores[i] for i in usable}
    else:
        order = sorted(usable, key=lambda i: (-scores[i], i))
        total = math.log(sum(1 / (r + 1) for r in range(len(order))))
        logs = {i: -math.log(r + 1) - total for r, i in enumerate(order)}
    return Model(pieces, kinds, logs, bool(norm.get(3, 1)), kinds.index(UNKNOWN) if UNKNOWN in kinds else 0)


def double_array(keys: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check, value of a trie over bytes: child c of node s is base[s] + c + 1 if check says s."""
    children: list[dict[int, int]] = [{}]
    ends: list[int] = [-1]
    for key, value in keys.items():
        at = 0
        for c in key:
            if c not in children[at]:
                children[at][c] = len(children)
                children.append({})
                ends.append(-1)
            at = children[at][c]
        ends[at] = value
    size = 2 * len(children) + 1024
    base, check, out = [0] * size, [-1] * size, [-1] * size
    place, queue, low = [0] * len(children), [0], 1
    check[0] = 0
    for node in queue:
        if kids := children[node]:
            codes = sorted(kids)
            slot, taken = max(low, codes[0] + 2), 0
            begun = slot
            while True:
                if slot + 260 >= len(check):
                    for table, fill in ((base, 0), (check, -1), (out, -1)):
                        table.extend([fill] * size)
                if check[slot] >= 0:
                    taken += 1
                elif all(check[slot - codes[0] + c] < 0 for c in codes):
                    break
                slot += 1
            # where nearly all slots were taken, later nodes needn't look again
            if taken >= 0.9 * (slot - begun + 1):
                low = max(low, slot)
            start = slot - codes[0] - 1
            base[place[node]] = start
            for c in codes:
                to = start + c + 1
                check[to], out[to], place[kids[c]] = place[node], ends[kids[c]], to
            queue.extend(kids[c] for c in codes)
    return np.array(base, np.int32), np.array(check, np.int32), np.array(out, np.int32)


def solve(model: Model, segments: list[bytes]) -> list[list[int]]:
    """The ids of the best path of each segment; byte fallback included."""
    sizes = np.array([len(s) for s in segments], np.int64)
    text = np.frombuffer(b"".join(segments) + b"\0", np.uint8)
    n = len(text) - 1
    ends = np.repeat(np.cumsum(sizes), sizes)
    first = (text[:n] & 0xC0) != 0x80
    starts = np.flatnonzero(first)
    width = np.diff(np.append(starts, n))
    # walk the trie from every character at once, one byte deeper each round
    at, node, depth = starts, np.zeros(len(starts), np.int32), 0
    edge_from, edge_to, edge_id = [], [], []
    alone = np.zeros(n + 1, bool)
    wide = np.zeros(n + 1, np.int64)
    wide[starts] = width
    while len(at):
        to = model.base[node].astype(np.int64) + text[at + depth] + 1
        to = np.minimum(to, len(model.check) - 1)
        ok = (model.check[to] == node) & (model.base[node] > 0)
        at, node = at[ok], to[ok].astype(np.int32)
        depth += 1
        found = model.value[node] >= 0
        edge_from.append(at[found])
        edge_to.append(at[found] + depth)
        edge_id.append(model.value[node[found]])
        alone[at[found & (wide[at] == depth)]] = True
        inside = at + depth < ends[at]
        at, node = at[inside], node[inside]
    lone = starts[~alone[starts]]
    edge_from.append(lone)
    edge_to.append(lone + wide[lone])
    edge_id.append(np.full(len(lone), -1, np.int32))
    edge_from, edge_to, edge_id = np.concatenate(edge_from), np.concatenate(edge_to), np.concatenate(edge_id)
    gain = np.where(edge_id >= 0, model.score[edge_id], model.least)
    # positions: one slot for each byte and one more for each segment's end
    which = np.repeat(np.arange(len(sizes)), sizes)
    zero = np.cumsum(sizes) - sizes
    slot_from = edge_from + which[edge_from]
    slot_to = edge_to + which[edge_from]
    local = edge_from - zero[which[edge_from]]
    order = np.argsort(local, kind="stable")
    best = np.full(n + len(sizes), -np.inf)
    back = np.full(n + len(sizes), -1, np.int64)
    best[zero + np.arange(len(sizes))] = 0.0
    cuts = np.flatnonzero(np.diff(local[order])) + 1
    for edges in np.split(order, cuts) if len(order) else []:
        score = best[slot_from[edges]] + gain[edges]
        better = score > best[slot_to[edges]]
        edges = edges[better]
        best[slot_to[edges]] = score[better]
        back[slot_to[edges]] = edges
    back_l, from_l, id_l = back.tolist(), slot_from.tolist(), edge_id.tolist()
    out = []
    for k, (start, size) in enumerate(zip((zero + np.arange(len(sizes))).tolist(), sizes.tolist())):
        ids, at = [], start + size
        while at > start:
            e = back_l[at]
            if id_l[e] >= 0:
                ids.append(id_l[e])
            elif model.fallback:
                lo = from_l[e] - start
                ids.extend(model.by_byte[c] for c in reversed(segments[k][lo : lo + at - from_l[e]]))
            else:
                ids.append(model.unknown)
            at = from_l[e]
        out.append(ids[::-1])
    return out


class Codec:
    """Encodes and decodes texts with one model; keeps the segments it has met."""

    def __init__(self, model: Model) -> None:
        self.model, self.known = model, {}
        self.parts = re.compile(f"{BLANK}+[^{BLANK}\n]*|[^{BLANK}\n]+|\n").findall if model.split else (lambda t: [t] if t else [])

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text, int32."""
        cut = [self.parts((BLANK if self.model.prefix else "") + t.replace(" ", BLANK)) if t else [] for t in texts]
        known, new = self.known, dict.fromkeys(s for parts in cut for s in parts if s not in self.known)
        if len(known) + len(new) > CACHE:
            known.clear()
            new = dict.fromkeys(s for parts in cut for s in parts)
        block, size = [], 0
        for s in new:
            block.append(s)
            size += len(s)
            if size >= BLOCK:
                self._add(block)
                block, size = [], 0
        self._add(block)
        return [np.frombuffer(b"".join(map(known.__getitem__, parts)), np.int32) for parts in cut]

    def _add(self, segments: list[str]) -> None:
        # short segments together: the number of rounds is the longest one's length
        for group in ([s for s in segments if len(s) <= 64], [s for s in segments if len(s) > 64]):
            if group:
                for s, ids in zip(group, solve(self.model, [s.encode("utf-8", "replace") for s in group])):
                    self.known[s] = np.array(ids, np.int32).tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: bytes joined, markers turned into blanks, the one in front dropped."""
        text = b"".join(map(self.model.raw.__getitem__, ids.tolist())).decode("utf-8", "replace").replace(BLANK, " ")
        return text[1:] if self.model.prefix and text[:1] == " " else text


#: A worker's codecs by the path of their model.
_CODECS: dict[str, Codec] = {}


def _codec(key: str, model: Model) -> Codec:
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(model)
    return _CODECS[key]


def encoded(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = MODEL) -> DataFrame:
    """key, ids, n_tokens, same (whether the ids decode to the text) for each row of ``docs``.

    The driver reads the model and sends it, some 2 MB, with the tasks.
    """
    model = docs.sparkSession.sparkContext.broadcast(load(path))
    rows = bounded(docs).select(key, text).toDF("key", "text")
    schema = T.StructType([T.StructField("key", rows.schema["key"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("same", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, model.value)
        for whole in batches:
            for batch in pieces(whole, 1, TEXTS):
                texts = batch.column(1).to_pylist()
                ids = codec.encode(texts)
                same = [None if t is None else codec.decode(x) == t for t, x in zip(texts, ids)]
                offsets = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                values = pa.array(np.concatenate([np.empty(0, np.int32), *ids]))
                lists = pa.ListArray.from_arrays(pa.array(offsets), values)
                yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array([len(x) for x in ids], pa.int64()), pa.array(same, pa.bool_())], names=["key", "ids", "n_tokens", "same"])

    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def decoded(rows: DataFrame, ids: str = "ids", path: str = MODEL) -> DataFrame:
    """``rows`` with the column text in place of ``ids``; null ids give a null text."""
    model = rows.sparkSession.sparkContext.broadcast(load(path))

    @F.pandas_udf("string")
    def back(column):  # noqa: ANN001, ANN202
        codec = _codec(path, model.value)
        return column.map(lambda x: None if x is None else codec.decode(np.asarray(x, np.int32)))

    return rows.withColumn("text", back(F.col(ids))).drop(*([ids] if ids != "text" else []))
