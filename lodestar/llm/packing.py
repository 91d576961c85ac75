"""Packing documents into sequences of at most 4,096 tokens, in order, by dynamic programming over places to cut.

The documents of a task follow each other as the table holds them, each as its ids and the end id. Windows of that
stream become sequences. A window may end at a document's end (free), at a sentence's or line's end, or inside a stretch
without either, at the end of a word where there is one; a cut inside a document is charged a penalty. A window costs
its padding: none if its length is a power of two, else what it lacks of 4,096. The least cost of all windows up to a
place is the least over the places at most 4,096 before it, a sliding minimum that a monotone queue keeps, or over the
places a power of two before it; of equal costs the one with fewer sequences. So the work is linear in the number of
places, and the best cut is found for each block of about ``BLOCK`` tokens; a block's last window is open, and what
follows its best cut goes to the next block. Tasks need nothing of each other: no row is shuffled, and the padding
of a task's end is chosen by the same rule.

Ids are the tokenizer's own. Its normaliser and its pattern never look across white space, nor does a piece reach from
an ASCII letter to ASCII punctuation, so a text is the sequence of the ids of such words, and a word's ids are kept for the
next time (up to about ``KEPT`` words in a worker; then anew).

Cases: a null or empty text is its end id alone; rows that repeat or share a doc_id, or have none, are documents of
their own; a text longer than a block is one stretch of the stream; an empty table gives no rows; other columns
aren't looked at. ``sequence_id`` is the task's number times 2^33 plus the sequence's place within it.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import WhitespaceSplit

from lodestar.llm.common import bounded, pieces

WINDOW, END = 4096, 2
#: What a cut costs, in tokens of padding: at a sentence's end, and inside a stretch without one.
SENTENCE, INSIDE = 4, 16
#: A stretch without a sentence's end may be cut about every so many tokens.
STRETCH = 64
#: So many tokens are cut together, or one piece of texts (``common.PIECE``) if that has more.
BLOCK = 1 << 20
#: So many words' ids are kept in a worker.
KEPT = 1_500_000
#: Longer words aren't kept.
LONG_WORD = 64
OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

#: Bytes that end a sentence, also before a closing mark, and the longer characters that do.
STOPS, CLOSERS, LONG_STOPS = b".!?", b"\"')]", ("…", "。", "！", "？")
#: ASCII punctuation that never is in one piece with a letter.
TAIL = b".,;:!?"


def _table(codes: bytes | list[int]) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(codes)] = True
    return out


_SPACE, _STOP, _CLOSER, _TAIL = _table(b"\t\n\x0b\x0c\r "), _table(STOPS), _table(CLOSERS), _table(TAIL)
_LETTER = _table([*range(65, 91), *range(97, 123)])


class Ids:
    """The ids of texts, by words."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        # Words of lower-case ASCII letters are pieces that no normaliser changes; each ends with an id of a word's end.
        self.letters = Tokenizer(self.tokenizer.model)
        self.letters.pre_tokenizer = WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}

    def _encode(self, words: list[str]) -> dict[str, bytes]:
        plain = [w for w in words if w.isascii() and w.isalpha() and w.islower()]
        ids = np.array(self.letters.encode_batch_fast([" ".join(plain)], add_special_tokens=False)[0].ids, "<u4")
        flat, ends = ids.tobytes(), (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
        out = dict(zip(plain, map(flat.__getitem__, map(slice, [0, *ends], ends))))
        odd = [w for w in words if w not in out]
        out.update(zip(odd, (np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(odd, add_special_tokens=False))))
        return out

    def words(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words."""
        found = list(map(self.known.get, words))
        if None in found:
            fresh = self._encode([w for w, ids in zip(words, found) if ids is None])
            found = [fresh[w] if ids is None else ids for w, ids in zip(words, found)]
            if len(self.known) > KEPT:
                self.known = {}
            self.known.update((w, ids) for w, ids in fresh.items() if len(w) <= LONG_WORD)
        return found

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The ids of texts, one after the other and each with the end id; where each text's words end among the ids;
        whether a sentence or line ends there; and where each text ends."""
        texts = pa.concat_arrays([texts.fill_null("").cast(pa.large_string())])
        edge = np.frombuffer(texts.buffers()[1], np.int64)[: len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[: edge[-1]]
        words, count, stop = _words(data, edge)
        coded = words.dictionary_encode()
        parts = self.words(coded.dictionary.to_pylist())
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        flat, first = np.frombuffer(b"".join(parts), "<u4"), np.cumsum(size) - size
        which = coded.indices.to_numpy()
        size = size[which]
        # An end id follows each text's last word.
        text = np.repeat(np.arange(len(count)), count)
        ends = np.cumsum(size) + text
        ids = np.full(int(size.sum()) + len(count), END, "<u4")
        own = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(count)])] + np.arange(len(count) + 1)
        to = np.ones(len(ids), bool)
        to[own[1:] - 1] = False
        ids[to] = flat[np.repeat(first[which] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        return ids, ends, stop, own[1:]


def _words(data: np.ndarray, edge: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of UTF-8 texts, how many each text has, and whether a sentence or line ends with each.

    Words are runs of bytes other than ASCII white space, cut also between an ASCII letter and ``TAIL``, where the tokenizer's
    pattern always cuts. Capitals are lower-cased as the tokenizer does, but for those that a later character may join
    with, and those beside a mark that could make the name of a special id.
    """
    space, letter, tail = _SPACE[data], _LETTER[data], _TAIL[data]
    filled = edge[:-1] < edge[1:]
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:], after[:-1] = space[:-1], space[1:]
    before[edge[:-1][filled]] = True
    after[edge[1:][filled] - 1] = True
    inner = letter[:-1] & tail[1:] | tail[:-1] & letter[1:]
    start = np.flatnonzero(~space & (before | np.append(False, inner)))
    end = np.flatnonzero(~space & (after | np.append(inner, False)))
    count = np.diff(np.searchsorted(end, edge))
    stop = _STOP[data[end]] | _CLOSER[data[end]] & _STOP[data[np.maximum(end - 1, 0)]]
    for mark in LONG_STOPS:
        code = mark.encode()
        stop |= np.logical_and.reduce([data[np.maximum(end - k, 0)] == code[-1 - k] for k in range(len(code))])
    stop &= after[end]
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    stop[:-1] |= lines[start[1:]] > lines[end[:-1]]
    stop[np.cumsum(count)[count > 0] - 1] = True
    capital = (data >= 65) & (data <= 90) & (np.append(data[1:], 0) < 128)
    size = end - start + 1
    if (data == 60).any():
        marked = np.add.reduceat(data == 60, start) > 0 if len(start) else np.empty(0, bool)
        capital[~space] &= ~np.repeat(marked, size)
    plain = np.where(capital, data | 32, data)
    words = pa.Array.from_buffers(pa.large_string(), len(end), [None, pa.py_buffer(np.append(0, np.cumsum(size)).astype(np.int64).tobytes()), pa.py_buffer(plain[~space].tobytes())])
    return words, count, stop


def places(ends: np.ndarray, stop: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a stream may be cut, and what each cut costs: at the ends of documents (``docs``, in tokens), of sentences (the
    ``ends`` of words that ``stop``), and of words in stretches without one."""
    sentence = ends[stop]
    at = np.concatenate([docs, sentence])
    cost = np.concatenate([np.zeros(len(docs), np.int64), np.full(len(sentence), SENTENCE)])
    edges = np.unique(np.append(at, 0))
    gap = np.diff(edges)
    fill = (gap - 1) // STRETCH
    if fill.any():
        step = np.arange(int(fill.sum())) - np.repeat(np.cumsum(fill) - fill, fill) + 1
        before = np.repeat(edges[:-1], fill)
        raw = before + step * STRETCH
        known = np.append(ends, 0)
        known.sort()
        word = known[np.searchsorted(known, raw, side="right") - 1]
        # The word's end before the place, unless another place lies between: then the place itself.
        raw = np.where((word > before) & (word > raw - STRETCH), word, raw)
        at, cost = np.append(at, raw), np.append(cost, np.full(len(raw), INSIDE))
    # The place before an end id leaves that id alone; the document's own end is next to it.
    keep = (at > 0) & ((cost == 0) | ~np.isin(at + 1, docs))
    at, cost = at[keep], cost[keep]
    order = np.lexsort((cost, at))
    at, cost = at[order], cost[order]
    first = np.append(True, at[1:] != at[:-1])
    return at[first], cost[first]


def cuts(at: np.ndarray, cost: np.ndarray, last: bool, window: int = WINDOW) -> list[int]:
    """The places, of increasing ``at`` with their costs, that end the windows with the least padding and penalties.
    Neighbouring places are at most ``window`` apart. If this isn't the ``last`` block, the windows end within ``window``
    of its end, where the cost up to there, with what the open window would lack if it ended with the block, is least."""
    place = np.concatenate([[0], at]).astype(np.int64)
    n = len(place)
    # Earlier places at a power of two before each place, as (place, earlier place) sorted by place.
    to, back = [], []
    index = np.full(int(place[-1]) + window + 1, -1, np.int32)
    index[place + window] = np.arange(n)
    for k in range(window.bit_length()):
        if 1 << k <= window:
            i = index[place + (window - (1 << k))]
            hit = np.flatnonzero(i >= 0)
            to.append(hit)
            back.append(i[hit])
    to, back = np.concatenate(to), np.concatenate(back)
    order = np.argsort(to, kind="stable")
    back = back[order].tolist()
    until = np.searchsorted(to[order], np.arange(n), side="right").tolist()
    where, costs = place.tolist(), [0, *cost.tolist()]
    # Costs are counted in parts of 2^-32 tokens, so that each sequence can add one: fewer win among equals.
    unit = 1 << 32
    best, come, rise = [0] * n, [0] * n, [0] * n  # rise: best + place
    queue, head, seen = [0], 0, until[0]  # places whose rise increases; those before head are too far back
    for j in range(1, n):
        p = where[j]
        while where[queue[head]] < p - window:
            head += 1
        i = queue[head]
        value = rise[i] + (window - p) * unit
        for b in back[seen : until[j]]:
            if best[b] < value:
                value, i = best[b], b
        seen = until[j]
        value += costs[j] * unit + 1
        best[j], come[j] = value, i
        value += p * unit
        rise[j] = value
        while len(queue) > head and rise[queue[-1]] >= value:
            queue.pop()
        queue.append(j)
    j = n - 1
    if not last:
        end = where[-1]
        j = min((k for k in range(n - 1, 0, -1) if where[k] >= end - window), key=lambda k: best[k] + ((window - end + where[k]) * unit if where[k] < end else 0))
    out = []
    while j:
        out.append(j - 1)
        j = come[j]
    return out[::-1]


class Packer:
    """Takes documents, gives pieces of them by sequence."""

    def __init__(self, first: int, block: int = BLOCK, window: int = WINDOW) -> None:
        self.sequence, self.block, self.window = first, block, window
        none = np.empty(0, np.int64)
        #: The stream so far: ids, cuts and their costs, documents' numbers, ends in the stream and lengths.
        self.ids, self.at, self.cost, self.names, self.ends, self.sizes = np.empty(0, "<u4"), none, none, [], none, none

    def add(self, names: list, ids: np.ndarray, at: np.ndarray, cost: np.ndarray, ends: np.ndarray) -> Iterator[tuple]:
        """Documents that follow each other; ``ends`` are theirs among ``ids``."""
        n = len(self.ids)
        self.ids, self.at, self.cost = np.append(self.ids, ids), np.append(self.at, at + n), np.append(self.cost, cost)
        self.names, self.ends, self.sizes = [*self.names, *names], np.append(self.ends, ends + n), np.append(self.sizes, np.diff(ends, prepend=0))
        if len(self.ids) >= self.block:
            yield from self.pack(False)

    def pack(self, last: bool = True) -> Iterator[tuple]:
        """Rows of ``OUT`` of what is held; unless ``last``, without what follows the last cut."""
        if not len(self.ids):
            return
        ends = self.at[cuts(self.at, self.cost, last, self.window)]
        done = int(ends[-1])
        edges = np.unique(np.concatenate([[0], ends, self.ends[self.ends <= done]]))
        begin, to = edges[:-1], edges[1:]
        doc, window = np.searchsorted(self.ends, to), np.searchsorted(ends, to)
        start = begin - (self.ends - self.sizes)[doc]
        offset = begin - np.append(0, ends)[window]
        raw = memoryview(np.ascontiguousarray(self.ids)).cast("B")
        for d, s, a, b, w, o in zip(doc.tolist(), start.tolist(), begin.tolist(), to.tolist(), window.tolist(), offset.tolist()):
            yield self.names[d], s, b - a, zlib.crc32(raw[4 * a : 4 * b]), int(self.sizes[d]), self.sequence + w, o
        self.sequence += len(ends)
        left = int(np.searchsorted(self.ends, done, side="right"))
        rest = self.at > done
        self.ids, self.at, self.cost = self.ids[done:].copy(), self.at[rest] - done, self.cost[rest]
        self.names, self.ends, self.sizes = self.names[left:], self.ends[left:] - done, self.sizes[left:]


_OPEN: dict[str, Ids] = {}


def tokenizer(path: str) -> Ids:
    """The tokenizer of a file, one for each worker process."""
    if path not in _OPEN:
        _OPEN[path] = Ids(path)
    return _OPEN[path]


def packed(df: DataFrame, path: str | None = None, make: Callable[[int], Packer] = Packer) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: the pieces of all documents."""
    file = path or public_tokenizers.path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = tokenizer(file)
        packer = make(TaskContext.get().partitionId() << 33)

        def whole(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=[c.split()[0] for c in OUT.split(", ")])

        for batch in batches:
            for part in pieces(batch, 1):
                ids, ends, stop, docs = ids_of.texts(part.column(1))
                rows = list(packer.add(part.column(0).to_pylist(), ids, *places(ends, stop, docs), docs))
                if rows:
                    yield whole(rows)
        rows = list(packer.pack())
        if rows:
            yield whole(rows)

    return bounded(df.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))).mapInArrow(run, OUT)
