"""SentencePiece encoding (BPE with byte fallback) and decoding by suffix-array matching.

Method: a batch's text is concatenated and indexed by a suffix array; every piece of the
vocabulary is binary-searched for its range of occurrences; the resulting edges (start,
length, piece) are sorted by position; and the edges are relaxed.  In a BPE model, relaxing
means taking, in every segment, the open edge that joins two neighbouring symbols and has
the best score (the leftmost of equals), until none is left.

No piece joins a character to a following space mark, so a text falls apart into segments
(space marks, then other characters) that are encoded alone.  A batch's text is its distinct
new segments; a worker keeps a bounded table of those it has met.  Suffixes are sorted by as
many characters as the longest piece has, which is all that matching needs.

Defined cases: a null or empty text gives no ids; a character that no piece covers gives the
ids of its UTF-8 bytes; the space mark U+2581 in a text is read as a space; repeated rows
are encoded alike; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import heapq
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame

from skein.llm.common import map_arrow

MARK = "▁"
#: Segments of a worker's table, characters indexed at once, and the longest segment that is relaxed in step with others.
CACHE_SEGMENTS, BATCH_CHARS, LONG = 600_000, 1 << 20, 40
_SEGMENT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_NONE = np.iinfo(np.int32).max


class Vocabulary:
    """A model file's normal pieces in order of their characters, with ranks by score, and its byte pieces."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        skip = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(size)]
        self.normal = [(model.id_to_piece(i), i, model.get_score(i)) for i in range(size) if not skip[i]]
        self.longest = max(len(p) for p, _, _ in self.normal)
        self.ids = np.array([i for _, i, _ in self.normal], np.int32)
        self.scores = np.array([s for _, _, s in self.normal])
        _, rank = np.unique(-self.scores, return_inverse=True)
        self.rank = rank.astype(np.int32)
        self.length = np.array([len(p) for p, _, _ in self.normal], np.int64)
        self.codes = np.zeros((len(self.normal), self.longest), np.int64)
        for k, (p, _, _) in enumerate(self.normal):
            self.codes[k, : len(p)] = [ord(c) for c in p]
        self.byte = {int(model.id_to_piece(i)[3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.unknown = model.unk_id()
        of = {i: p.replace(MARK, " ").encode() for p, i, _ in self.normal} | {i: bytes([b]) for b, i in self.byte.items()}
        self.bytes = [of.get(i, b" \xe2\x81\x87 " if i == self.unknown else b"") for i in range(size)]


def suffix_array(codes: np.ndarray, width: int) -> np.ndarray:
    """Positions of ``codes`` (0 ends a text) in order of their next ``width`` codes.

    As many codes as fit are packed into one number; ranks of spans are doubled from there.
    """
    n = len(codes)
    rank = np.cumsum(np.bincount(codes) > 0)[codes]
    bits = int(rank.max(initial=1)).bit_length()
    span, key = 1, rank.copy()
    while span < width and (span + 1) * bits <= 62:
        key <<= bits
        key[: max(0, n - span)] |= rank[span:]
        span += 1
    while span < width:
        _, rank = np.unique(key, return_inverse=True)
        key = (rank + 1) * (n + 2)
        key[: max(0, n - span)] += rank[span:] + 1
        span *= 2
    return np.argsort(key, kind="stable")


def occurrences(vocabulary: Vocabulary, codes: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each piece's range in the suffix array, by one binary search for all pieces at once.

    A suffix and a piece are compared over the piece's length; codes past a text's end are 0.
    """
    width, n = vocabulary.longest, len(codes)
    padded = np.concatenate([codes, np.zeros(width, codes.dtype)])
    inside = np.arange(width) < vocabulary.length[:, None]
    ends = []
    for right in (False, True):
        low, high = np.zeros(len(vocabulary.ids), np.int64), np.full(len(vocabulary.ids), n, np.int64)
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_]) // 2
            own = padded[order[middle][:, None] + np.arange(width)]
            gap = np.where(inside[open_], own - vocabulary.codes[open_], 0)
            first = (gap != 0).argmax(axis=1)
            sign = np.sign(gap[np.arange(len(open_)), first])
            before = sign < 0 if not right else sign <= 0
            low[open_[before]] = middle[before] + 1
            high[open_[~before]] = middle[~before]
        ends.append(low)
    return ends[0], ends[1]


def edges(vocabulary: Vocabulary, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All occurrences of pieces, sorted by position: row = start, column = length, values (rank, id)."""
    order = suffix_array(codes, vocabulary.longest)
    left, right = occurrences(vocabulary, codes, order)
    count = right - left
    piece = np.repeat(np.arange(len(count)), count)
    at = order[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(left, count)]
    cell = at * (vocabulary.longest + 1) + vocabulary.length[piece]
    rank = np.full(len(codes) * (vocabulary.longest + 1), _NONE, np.int32)
    ident = np.full(len(rank), -1, np.int32)
    rank[cell], ident[cell] = vocabulary.rank[piece], vocabulary.ids[piece]
    return rank, ident


def _relax(rank: np.ndarray, stride: int, start: np.ndarray, length: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols (start, length) of many short segments, all in step: a round takes each segment's best edge."""
    done_start, done_length = [], []
    while len(start):
        both = length[:-1] + length[1:]
        joins = np.full(len(start), _NONE, np.int32)
        may = np.flatnonzero((segment[:-1] == segment[1:]) & (both < stride))
        joins[may] = rank[start[may] * stride + both[may]]
        first = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
        best = np.minimum.reduceat(joins, first)
        number = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(start))))
        live = best[number] < _NONE
        if not live.all():
            done_start.append(start[~live])
            done_length.append(length[~live])
            start, length, segment, joins, number = start[live], length[live], segment[live], joins[live], number[live]
            if not len(start):
                break
        hit = np.flatnonzero(joins == best[number])
        hit = hit[np.concatenate([[True], number[hit[1:]] != number[hit[:-1]]])]  # the leftmost of each segment
        length[hit] += length[hit + 1]
        stay = np.ones(len(start), bool)
        stay[hit + 1] = False
        start, length, segment = start[stay], length[stay], segment[stay]
    return (np.concatenate(done_start), np.concatenate(done_length)) if done_start else (start, length)


def _relax_long(rank: np.ndarray, stride: int, begin: int, end: int) -> list[tuple[int, int]]:
    """The same for one long segment, by a heap of open edges."""
    after = {i: i + 1 for i in range(begin, end)}
    before = {i + 1: i for i in range(begin, end)}
    length = dict.fromkeys(range(begin, end), 1)
    heap: list[tuple[int, int, int]] = []

    def push(a: int) -> None:
        b = after.get(a, end)
        if b < end and (whole := length[a] + length[b]) < stride and (r := int(rank[a * stride + whole])) < _NONE:
            heapq.heappush(heap, (r, a, whole))

    for i in range(begin, end):
        push(i)
    while heap:
        _, a, whole = heapq.heappop(heap)
        b = after.get(a, end) if a in length else end
        if b >= end or length[a] + length[b] != whole:
            continue
        length[a] = whole
        del length[b]
        after[a] = nxt = after[b]
        before[nxt] = a
        push(a)
        if a > begin:
            push(before[a])
    return [(a, length[a]) for a in sorted(length)]


def encode_segments(vocabulary: Vocabulary, segments: list[str]) -> list[bytes]:
    """Ids of each segment as little-endian 32-bit integers."""
    joined = "\0".join(segments) + "\0"
    codes = np.frombuffer(joined.encode("utf-32-le"), "<u4").astype(np.int64)
    lengths = np.array([len(s) for s in segments])
    begins = np.cumsum(lengths + 1) - lengths - 1
    # the end mark is 0, so a text's own U+0000 becomes a code that no piece has
    body = np.ones(len(codes), bool)
    body[begins + lengths] = False
    codes[body & (codes == 0)] = 0x110000
    rank, ident = edges(vocabulary, codes)
    stride = vocabulary.longest + 1
    number = np.repeat(np.arange(len(segments)), lengths + 1)
    short = body & (lengths <= LONG)[number]
    where = np.flatnonzero(short)
    start, length = _relax(rank, stride, where, np.ones(len(where), np.int64), number[where])
    for k in np.flatnonzero(lengths > LONG).tolist():
        more = np.array(_relax_long(rank, stride, int(begins[k]), int(begins[k] + lengths[k])), np.int64)
        start, length = np.concatenate([start, more[:, 0]]), np.concatenate([length, more[:, 1]])
    order = np.argsort(start)
    start, length = start[order], length[order]
    ids = ident[start * stride + length]
    if (ids < 0).any():  # no piece: the character's bytes
        odd = np.flatnonzero(ids < 0)
        raw = [[vocabulary.byte.get(b, vocabulary.unknown) for b in joined[start[i]].encode("utf-8", "surrogatepass")] for i in odd.tolist()]
        repeat = np.ones(len(ids), np.int64)
        repeat[odd] = [len(b) for b in raw]
        start, ids = np.repeat(start, repeat), np.repeat(ids, repeat)
        ids[ids < 0] = [b for bs in raw for b in bs]
    cuts = (4 * np.searchsorted(start, np.append(begins, len(codes)))).tolist()
    data = ids.astype("<u4").tobytes()
    return [data[a:b] for a, b in zip(cuts, cuts[1:])]


class Encoder(dict):
    """Segment to ids; texts are encoded by looking up their segments, new ones being indexed together."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)

    def texts(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        split: list[list[str]] = []
        new: dict[str, None] = {}
        chars = 0

        def flush() -> None:
            if new:
                self.update(zip(new, encode_segments(self.vocabulary, list(new))))
            out.extend(b"".join(map(self.__getitem__, s)) for s in split)
            split.clear()
            new.clear()
            if len(self) > CACHE_SEGMENTS:
                short = {s: ids for s, ids in self.items() if len(s) <= 8}
                self.clear()
                self.update(short if len(short) <= CACHE_SEGMENTS // 2 else {})

        for text in texts:
            segments = _SEGMENT.findall(MARK + text.replace(" ", MARK)) if text else []
            for s in set(segments):
                if s not in self and s not in new:
                    new[s] = None
                    chars += len(s) + 1
            split.append(segments)
            if chars >= BATCH_CHARS:
                flush()
                chars = 0
        flush()
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids: pieces joined, byte pieces read as UTF-8, space marks as spaces, the first space dropped."""
        table = self.vocabulary.bytes
        text = b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@functools.cache
def encoder(path: str) -> Encoder:
    """One per worker and model file."""
    return Encoder(path)


def encode(docs: DataFrame, model: str, id_column: str = "doc_id") -> DataFrame:
    """``(id, ids)`` for every whole text of ``docs`` (id, text), without a shuffle."""

    def run(rows: dict) -> dict:
        return {id_column: rows["id"], "ids": [np.frombuffer(b, "<i4") for b in encoder(model).texts([t or "" for t in rows["text"]])]}

    kind = docs.schema[id_column].dataType.simpleString()
    return map_arrow(docs.selectExpr(f"`{id_column}` id", "cast(text as string) text"), run, f"`{id_column}` {kind}, ids array<int>")


def decode(encoded: DataFrame, model: str, id_column: str = "doc_id") -> DataFrame:
    """``(id, text)`` of rows ``(id, ids)``."""

    def run(rows: dict) -> dict:
        return {id_column: rows["id"], "text": [encoder(model).decode(np.asarray(i or [], "<u4").tobytes()) for i in rows["ids"]]}

    kind = encoded.schema[id_column].dataType.simpleString()
    return map_arrow(encoded.select(encoded[id_column].alias("id"), "ids"), run, f"`{id_column}` {kind}, text string")


def round_trip(docs: DataFrame, model: str, id_column: str = "doc_id") -> DataFrame:
    """Per row: number of ids, their crc32, how many are bytes, crc32 of the decoded text's UTF-8, whether it equals the text."""

    def run(rows: dict) -> dict:
        own = encoder(model)
        texts = [t or "" for t in rows["text"]]
        ids = own.texts(texts)
        back = [own.decode(i) for i in ids]
        low, high = min(own.vocabulary.byte.values()), max(own.vocabulary.byte.values())
        return {
            id_column: rows["id"], "n_ids": [len(i) // 4 for i in ids], "ids_crc32": [zlib.crc32(i) for i in ids],
            "n_byte_ids": [int(((a := np.frombuffer(i, "<u4")) >= low).sum() - (a > high).sum()) for i in ids],
            "text_crc32": [zlib.crc32(b.encode()) for b in back], "exact": [b == t.replace(MARK, " ") for b, t in zip(back, texts)],
        }

    kind = docs.schema[id_column].dataType.simpleString()
    return map_arrow(docs.selectExpr(f"`{id_column}` id", "cast(text as string) text"), run, f"`{id_column}` {kind}, n_ids long, ids_crc32 long, n_byte_ids long, text_crc32 long, exact boolean")
