"""Packing of tokenised documents into fixed-length training sequences.

Method: first-fit decreasing with a tournament tree over bin capacities, run
independently in randomised groups of documents.

One pass tokenises whole texts and leaves a small row per document: its number of tokens and
the checksums of the pieces that it can be cut into.  Those rows, not token ids, are dealt
at random over the whole corpus into groups of about ``group_tokens``, and every group is
packed by itself, so like documents that stand together in the input are spread.

A document is cut at multiples of ``length``; what is left, and a shorter document, goes
first-fit decreasing into a bin.  A bin with little room left is padded.  One with more than
1/``SLACK`` free (a few per group) is undone: its documents are cut into powers of two,
largest first, and those fill sequences whose sizes are the powers of two that add up to the
bin's content; such sequences need no padding.

Defined cases: a null or empty text gives one piece, the end token alone; repeated rows
are packed once each; ties in size keep the order of the rows; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import cut, slices

LENGTH = 4096
END = 2
#: Tokens of a group, words whose ids a task keeps.
GROUP_TOKENS, CACHE_WORDS = 4 << 20, 450_000
#: A bin with at most 1/SLACK free is padded as it is.
SLACK = 64


@functools.cache
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    _check_words(made)
    return made


def _check_words(tokenizer) -> None:
    """An error unless a text's ids are its words' ids in order, as ``WordIds`` takes for granted."""
    ids = lambda t: tokenizer.encode(t, add_special_tokens=False).ids
    words = ["a", "the", "The", "don't", "12.5", "x-y", ".", "...", "é", "日本", "👍🏽", "\u0301a", "(", "ing", "'s", "\xa0b"]
    words += [t.content for t in tokenizer.get_added_tokens_decoder().values() if t.content.split() == [t.content]]
    for space in (" ", "\n", "  ", "\t "):
        for a, b in zip(words, words[1:] + words[:1]):
            if ids(space + a + space + b + space) != ids(a) + ids(b):
                raise ValueError(f"the tokenizer's ids of {a!r} and {b!r} depend on white space")
    if any(t.content.split() != [t.content] for t in tokenizer.get_added_tokens_decoder().values()):
        raise ValueError("the tokenizer has tokens with white space")


class WordIds(dict):
    """Word (bytes without ASCII white space) to its ids as little-endian 32-bit integers.

    The tokenizer drops white space and never joins across it, so a text's ids are its
    words' ids in order.  New words are encoded many at a time, joined by spaces, and told
    apart by the offsets of their ids.  Beyond ``CACHE_WORDS`` words the long ones, which
    seldom come again, go first.
    """

    def __init__(self, path: str):
        self.encode = _tokenizer(path).encode_batch

    def add(self, words: list[bytes]) -> None:
        new = [w for w in words if w not in self]
        if len(self) + len(new) > CACHE_WORDS:
            words = set(words)
            kept = {w: ids for w, ids in self.items() if len(w) <= 8 or w in words}
            self.clear()
            self.update(kept if len(kept) + len(new) <= CACHE_WORDS else {w: ids for w, ids in kept.items() if w in words})
        parts = [[w.decode() for w in new[at : at + 256]] for at in range(0, len(new), 256)]
        for at in range(0, len(parts), 64):
            some = parts[at : at + 64]
            for part, e in zip(some, self.encode([" ".join(p) for p in some], add_special_tokens=False)):
                starts = np.cumsum([0] + [len(w) + 1 for w in part])
                ids, offsets = np.asarray(e.ids, "<u4"), e.offsets
                cuts = np.searchsorted([o[0] for o in offsets], starts).tolist()
                raw = ids.tobytes()
                self.update((w.encode(), raw[4 * a : 4 * b]) for w, a, b in zip(part, cuts, cuts[1:]))

    def texts(self, texts: list[bytes] | pa.Array) -> list[bytes]:
        """The ids of each text.

        Arrow splits the texts and numbers their distinct words; Python meets only those, and
        numpy puts the ids together.
        """
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        split = pc.ascii_split_whitespace(column.fill_null(""))
        coded = split.flatten().dictionary_encode()
        offsets = split.offsets.to_numpy()
        distinct = coded.dictionary.cast(pa.binary()).to_pylist()
        self[b""] = b""  # what is before white space at a text's start and after it at the end
        self.add(distinct)
        values = [self[w] for w in distinct]
        size = np.fromiter(map(len, values), np.int64, len(values)) // 4
        start = np.cumsum(size) - size
        index = coded.indices.to_numpy()
        own = size[index]
        ends = np.concatenate([[0], np.cumsum(own)])
        ids = np.frombuffer(b"".join(values), "<u4")[np.repeat(start[index] - ends[:-1], own) + np.arange(ends[-1])]
        cuts = (4 * ends[offsets - offsets[0]]).tolist()
        data = ids.tobytes()
        return [data[a:b] for a, b in zip(cuts, cuts[1:])]


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item (sizes from 1 to ``capacity``): first-fit decreasing, ties in item order.

    The tree's leaves are bins' free space and its inner nodes the larger of two children,
    so the leftmost bin that fits is found in log(bins) steps.
    """
    order = np.argsort(-sizes, kind="stable").tolist()
    leaves = 1 << max(0, int(len(order) - 1).bit_length())
    free = np.repeat(capacity, 2 * leaves).tolist()
    bins = np.empty(len(order), np.int64)
    size_of = sizes.tolist()
    for item in order:
        need, node = size_of[item], 1
        while node < leaves:
            node *= 2
            if free[node] < need:
                node += 1
        bins[item] = node - leaves
        free[node] -= need
        node //= 2
        while node:
            left, right = free[2 * node], free[2 * node + 1]
            most = left if left > right else right
            if free[node] == most:
                break
            free[node] = most
            node //= 2
    return bins


def powers(n: int) -> list[int]:
    """The powers of two that add up to ``n``, largest first."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


def pack_group(tokens: list[int], length: int = LENGTH) -> list[tuple[int, int, int, int, int, int]]:
    """Pieces (document, its piece's place in ``cuts``, start, length, sequence, offset) of one group; sequences count from 0."""
    pieces: list[tuple[int, int, int, int, int, int]] = []
    sequence = 0
    rest_doc, rest_size = [], []
    for doc, n in enumerate(tokens):
        for i in range(n // length):
            pieces.append((doc, i, i * length, length, sequence, 0))
            sequence += 1
        if n % length:
            rest_doc.append(doc)
            rest_size.append(n % length)
    if not rest_doc:
        return pieces
    bins = first_fit_decreasing(np.asarray(rest_size, np.int64), length)
    held: dict[int, list[int]] = {}
    for i, b in enumerate(bins.tolist()):
        held.setdefault(b, []).append(i)
    for b in sorted(held):
        fill, offset = sum(rest_size[i] for i in held[b]), 0
        if length - fill <= length // SLACK:
            for i in held[b]:
                n = tokens[rest_doc[i]]
                pieces.append((rest_doc[i], n // length, n - rest_size[i], rest_size[i], sequence, offset))
                offset += rest_size[i]
            sequence += 1
            continue
        small = []
        for i in held[b]:
            start = tokens[rest_doc[i]] - rest_size[i]
            for k, size in enumerate(powers(rest_size[i])):
                small.append((-size, rest_doc[i], tokens[rest_doc[i]] // length + 1 + k, start))
                start += size
        ends = powers(fill)  # powers of two in falling order fill falling powers of two exactly
        for size, doc, place, start in sorted(small):
            pieces.append((doc, place, start, -size, sequence, offset))
            offset -= size
            if offset == ends[0]:
                ends.pop(0)
                sequence, offset = sequence + 1, 0
    return pieces


def checksums(ids: bytes, length: int = LENGTH) -> list[int]:
    """crc32 of each full sequence of little-endian 32-bit ``ids``, of the rest, and of the rest's powers of two; no rest, no more."""
    view, n = memoryview(ids), len(ids) // 4
    full = n - n % length
    out = [zlib.crc32(view[4 * at : 4 * (at + length)]) for at in range(0, full, length)]
    if full < n:
        out.append(zlib.crc32(view[4 * full :]))
        at = full
        for size in powers(n - full):
            out.append(zlib.crc32(view[4 * at : 4 * (at + size)]))
            at += size
    return out


def lengths(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """``(doc_id, n, sums)`` for every whole text of ``docs``: its tokens (with the end token) and their ``checksums``."""
    tail = np.asarray([end], "<u4").tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(tokenizer)
        for batch in batches:
            for part in slices(batch, 4 << 20):
                ids = [i + tail for i in words.texts(part.column("text"))]
                sums = pa.array([checksums(i, length) for i in ids], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(i) // 4 for i in ids], pa.int64()), sums], names=["doc_id", "n", "sums"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, n long, sums array<long>")


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END, group_tokens: int = GROUP_TOKENS, seed: int = 11) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text); see the module's docstring.

    ``tokenizer`` is the path of a ``tokenizers`` file that every executor can read; ``length`` is
    a power of two.  The rows of ``lengths`` are numbered as they are written, once; the number
    decides a row's group, so a lost task's second run gives the same rows.  ``sequence_id`` is the group
    times 2^33 plus a count.
    """
    rows = cut(lengths(docs, tokenizer, length, end).withColumn("row", F.monotonically_increasing_id()))
    total = rows.agg(F.sum("n")).first()[0] or 0
    groups = max(1, round(total / group_tokens))

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("row")
        tokens, sums = rows["n"].to_pylist(), rows["sums"].combine_chunks()
        doc, place, start, size, sequence, offset = (np.array(c, np.int64) for c in zip(*pack_group(tokens, length)))
        values = sums.flatten().to_numpy()[(sums.offsets.to_numpy() - sums.offsets[0].as_py())[doc] + place]
        base = rows["group"][0].as_py() << 33
        columns = [rows["doc_id"].take(pa.array(doc)), start, size, values, np.array(tokens, np.int64)[doc], base + sequence, offset]
        return pa.table([c if isinstance(c, pa.ChunkedArray) else pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    dealt = rows.withColumn("group", F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(groups)))
    return dealt.groupBy("group").applyInArrow(run, SCHEMA)


#: Columns of the pieces.
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long"
