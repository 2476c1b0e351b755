"""Removal of repeated passages with prefix-partitioned suffix trees over words.

A suffix starts at each word with ``WINDOW`` words to go, and a tree is cut off at that depth: a node there is a passage that
occurs more than once. Only suffixes that may have such a node are put into trees:

1. Filter. Each suffix sends 32 bits of the hash of its window to a group of hashes. One that is alone there is a leaf that
   branches off above the cut; it needs no tree. Chance equals survive, and the trees tell them apart.
2. Passages. The survivors of a document that follow each other make up one passage, and passages of equal text are one,
   compared as text: all but the first of them (by doc_id, then start) go as a whole. The filter then runs over the distinct
   passages; suffixes that are alone among them are first occurrences.
3. Trees. What is left is split by prefixes of variable length: the shortest of ``DEPTHS`` words whose count fits a tree of
   ``TREE`` suffixes; what is too large even at full depth is dealt by its window. A tree is one task's: suffixes sorted word
   by word, with the longest common prefix of neighbours. Its nodes at the cut are runs of neighbours that share all
   ``WINDOW`` words; all occurrences but the first are covered by the removal. Neighbouring windows of a document make up the
   maximal repeats. Passages travel to mappers in order of their least window hash, so near copies meet in a chunk, which
   sends each window once.

Words are compared as themselves, so no hash decides what is removed. A mapper sends each window of a chunk of documents once,
so copies and passages found in many documents cost a group at most one leaf for each chunk. Documents are never grouped
by their content. What is found goes back by bucket of documents, one packed row for each group and bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm.common import discard, hashed_words, lean, only, slices, stored, text_batches, texts, trim, word_pieces, word_spans

WINDOW = 20
DEPTHS = (1, 2, 4, 8)
#: Suffixes of a group of the filter (some 40 bytes each while the task sorts them) and bytes of text for each of them.
GROUP = 2 << 20
WORD_BYTES = 6
#: Groups that a chunk deals to at most. More are dealt in two steps: to so many coarse groups, whose parts of about
#: ``PART_BYTES`` deal again, so that what travels is always a few thousand suffixes together and not single ones.
FAN = 512
PART_BYTES = 48 << 20
#: Suffixes of a tree (some 300 bytes each in its task).
TREE = 1 << 18
#: Cells in which prefixes are counted: four for each tree, between these bounds.
CELLS, MOST_CELLS = 1 << 12, 1 << 18
#: Bytes of text in a chunk of a mapper, of passages in a group, and of passages in a task that feeds trees.
CHUNK_BYTES = 6 << 20
PASSAGE_BYTES = 64 << 20
FEED_BYTES = 8 << 20
BASE = 0x9E3779B97F4A7C15
#: Ids of affected documents (16 bytes each) that are broadcast to select their texts; more are joined by a shuffle.
BROADCAST_IDS = 250_000
NULL_ID = -(1 << 63)
#: A document's entry in a blob of runs, and a passage's in a blob of passages.
HEAD = np.dtype([("id", np.int64), ("mark", np.int64), ("n", np.int64)])
PLACE = np.dtype([("id", np.int64), ("mark", np.int64), ("start", np.int64), ("size", np.int64)])


def path_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` word hashes: polynomial, built from runs of powers of two."""

    def power(n: int) -> np.uint64:
        return np.uint64(pow(BASE, n, 1 << 64))

    if len(h) < width:
        return np.zeros(0, np.uint64)
    runs, size = h, 1
    out, done = None, 0
    rest = width
    while True:
        if rest & 1:
            n = len(h) - done - size + 1
            out = runs[:n].copy() if out is None else out[:n] * power(size) + runs[done : done + n]
            done += size
        rest >>= 1
        if not rest:
            break
        runs = runs[: len(runs) - size] * power(size) + runs[size:]
        size *= 2
    out = out[: len(h) - width + 1]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def planes(values: np.ndarray) -> bytes:
    """Bytes of an integer array, all first bytes, then all second ones: runs of zeros compress in the shuffle."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def unplanes(data: memoryview, kind: str, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, n * size).reshape(size, n).T).view(kind).reshape(-1)


def heads(*keys: np.ndarray) -> np.ndarray:
    """Where a new value of the keys begins."""
    n = len(keys[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = False
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def runs_of(starts: np.ndarray) -> np.ndarray:
    """Ascending starts as pairs (first, last) of consecutive runs, flat."""
    cut = np.flatnonzero(np.diff(starts) != 1)
    first, last = starts[np.concatenate(([0], cut + 1))], starts[np.concatenate((cut, [len(starts) - 1]))]
    return np.stack([first, last], 1).reshape(-1).astype(np.int32)


def merged(runs: list[int] | np.ndarray) -> np.ndarray:
    """Runs of starts, in any order and overlapping, as longest runs (first, last)."""
    pairs = np.array(runs, np.int64).reshape(-1, 2)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    ends = np.maximum.accumulate(pairs[:, 1])
    new = np.concatenate(([True], pairs[1:, 0] > ends[:-1] + 1))
    at = np.flatnonzero(new)
    return np.stack([pairs[at, 0], ends[np.append(at[1:], len(pairs)) - 1]], 1)


def by_document(ids: np.ndarray, marks: np.ndarray, starts: np.ndarray) -> bytes:
    """Occurrences as a blob: (id, mark, number of run ends) for each document, then the runs."""
    if not len(starts):
        return b""
    order = np.lexsort((starts, marks, ids))
    ids, marks, starts = ids[order], marks[order], starts[order]
    own = heads(ids, marks, starts)
    ids, marks, starts = ids[own], marks[own], starts[own]
    cut = heads(ids, marks)
    runs = [runs_of(starts[a:b]) for a, b in zip(cut, np.append(cut[1:], len(starts)))]
    head = np.zeros(len(runs), HEAD)
    head["id"], head["mark"], head["n"] = ids[cut], marks[cut], [len(r) for r in runs]
    return packed(head, np.concatenate(runs))


def packed(head: np.ndarray, runs: np.ndarray) -> bytes:
    return len(head).to_bytes(8, "little") + head.tobytes() + runs.astype(np.int32).tobytes()


def opened(blobs: list) -> tuple[np.ndarray, np.ndarray]:
    """Heads of all documents' runs and the runs, ordered by document."""
    head, value = [np.zeros(0, HEAD)], [np.zeros(0, np.int32)]
    for data in map(memoryview, blobs):
        n = int.from_bytes(data[:8], "little")
        head.append(np.frombuffer(data, HEAD, n, 8))
        value.append(np.frombuffer(data, np.int32, -1, 8 + HEAD.itemsize * n))
    head, value = np.concatenate(head), np.concatenate(value)
    order = np.lexsort((head["mark"], head["id"]))
    first = np.cumsum(head["n"]) - head["n"]
    n = head["n"][order]
    at = np.repeat(first[order] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return head[order], value[at]


def dealt(blobs: list, buckets: int) -> tuple[list[int], list[bytes]]:
    """Runs of documents, one blob for each bucket of documents."""
    head, value = opened([b for b in blobs if len(b)])
    b = ((head["id"].astype(np.uint64) * np.uint64(BASE) ^ head["mark"].astype(np.uint64)) * np.uint64(BASE) >> np.uint64(24)).astype(np.int64) % buckets
    first = np.cumsum(head["n"]) - head["n"]
    order = np.argsort(b, kind="stable")
    cuts, out_b, out = heads(b[order]), [], []
    for i, j in zip(cuts, np.append(cuts[1:], len(b))):
        own = head[order[i:j]]
        at = np.repeat(first[order[i:j]] - (np.cumsum(own["n"]) - own["n"]), own["n"]) + np.arange(own["n"].sum())
        out_b.append(int(b[order[i]]))
        out.append(packed(own, value[at]))
    return out_b, out


class Chunk:
    """Texts of a mapper in order of (doc_id, mark, place of the first word), with the window hashes of their suffixes."""

    def __init__(self, docs: list[tuple[int, int, int, np.ndarray]], window: int):
        docs.sort(key=lambda d: d[:3])
        docs = [d for i, d in enumerate(docs) if (i == 0 or d[:3] != docs[i - 1][:3]) and len(d[3]) >= window]
        self.ids = np.array([d[0] for d in docs], np.int64)
        self.marks = np.array([d[1] for d in docs], np.int64)
        paths = [path_hashes(d[3], window) for d in docs]
        self.paths = np.concatenate([np.zeros(0, np.uint64), *paths])
        sizes = [len(p) for p in paths]
        self.doc = np.repeat(np.arange(len(docs), dtype=np.int32), sizes)
        self.start = np.concatenate([np.zeros(0, np.int64), *(np.arange(d[2], d[2] + n) for d, n in zip(docs, sizes))])

    def leaves(self, groups: int, whole: bool = False) -> Iterator[tuple[int, int, bytes]]:
        """(group, kind, blob): kind 0, the first occurrence of each window for its group; kind 1, windows that are here more than
        once. A blob has 32 bits of each window's hash, or all 64 if it will be dealt again."""
        if not len(self.paths):
            return
        order = np.argsort(self.paths, kind="stable")
        cut = heads(self.paths[order])
        n = np.diff(np.append(cut, len(order)))
        again = np.sort(order[np.repeat(n > 1, n)])
        if len(again):  # any group will do; chunks spread over all
            yield int(self.paths[0] % np.uint64(groups)), 1, by_document(self.ids[self.doc[again]], self.marks[self.doc[again]], self.start[again])
        once = np.sort(order[cut])
        yield from dealt_leaves(self.paths[once], self.doc[once], self.ids, self.marks, self.start[once], groups, whole)


def dealt_leaves(paths: np.ndarray, doc: np.ndarray, ids: np.ndarray, marks: np.ndarray, start: np.ndarray, groups: int, whole: bool) -> Iterator[tuple[int, int, bytes]]:
    """Suffixes in order of document and start, one blob for each group; ``ids`` and ``marks`` are those of the documents."""
    g = (((paths >> np.uint64(32)) * np.uint64(groups)) >> np.uint64(32)).astype(np.int64)
    by = np.argsort(g.astype(np.uint16) if groups < 65536 else g, kind="stable")
    cuts = heads(g[by])
    for a, b in zip(cuts, np.append(cuts[1:], len(by))):
        own = by[a:b]
        bits = paths[own] if whole else paths[own].astype(np.uint32)
        at = heads(doc[own])
        size, place = placed(doc[own], ids[doc[own][at]], marks[doc[own][at]], start[own])
        yield int(g[own[0]]), 0, size + bits.tobytes() + place


def dealt_again(kinds: list[int], blobs: list, groups: int) -> Iterator[tuple[int, int, bytes]]:
    """Blobs of one part of a coarse group, dealt to the groups."""
    paths, ids, marks, starts = [], [], [], []
    for kind, blob in zip(kinds, blobs):
        data = memoryview(blob)
        if kind:
            yield int(xxhash.xxh64_intdigest(data[:64]) % groups), 1, bytes(data)
            continue
        n, m = np.frombuffer(data, np.int64, 2).tolist()
        paths.append(np.frombuffer(data, np.uint64, n, 16))
        for x, into in zip(places(data[16 + 8 * n :], n, m), (ids, marks, starts)):
            into.append(x)
    if not paths:
        return
    path, doc_id, mark, start = (np.concatenate(x) for x in (paths, ids, marks, starts))
    order = np.lexsort((start, mark, doc_id))
    path, doc_id, mark, start = path[order], doc_id[order], mark[order], start[order]
    new = heads(doc_id, mark)
    doc = np.zeros(len(path), np.int32)
    doc[new[1:]] = 1
    yield from dealt_leaves(path, np.cumsum(doc), doc_id[new], mark[new], start, groups, False)


def placed(doc: np.ndarray, ids: np.ndarray, marks: np.ndarray, start: np.ndarray) -> tuple[bytes, bytes]:
    """Numbers of suffixes and documents, and then where the suffixes are: steps of starts, and ids and marks of documents.
    Suffixes are in order of ``doc``; ids and marks are those of its runs."""
    at = heads(doc)
    step = np.diff(start, prepend=0)
    step[at] = start[at]
    n = np.diff(np.append(at, len(start))).astype(np.uint32)
    return np.array([len(start), len(at)], np.int64).tobytes(), b"".join([planes(step.astype(np.uint32)), planes(np.diff(ids, prepend=0)), marks.tobytes(), planes(n)])


def places(data: memoryview, n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, mark, start) of each suffix, from what :func:`placed` made of them."""
    step = unplanes(data, "u4", n).astype(np.int64)
    at = 4 * n
    doc_ids = np.cumsum(unplanes(data[at:], "i8", m))
    own = np.frombuffer(data, np.int64, m, at + 8 * m)
    count = unplanes(data[at + 16 * m :], "u4", m).astype(np.int64)
    first = np.cumsum(count) - count
    total = np.cumsum(step)
    return np.repeat(doc_ids, count), np.repeat(own, count), total - np.repeat(total[first] - step[first], count)


def survivors(kinds: list[int], blobs: list, buckets: int) -> tuple[list[int], list[bytes]]:
    """The suffixes of a group whose 32 bits are not alone, and those that a chunk holds more than once, by bucket."""
    local, bits, starts, ids, marks = [], [], [], [], []
    for kind, blob in zip(kinds, blobs):
        data = memoryview(blob)
        if kind:
            local.append(data)
            continue
        n, m = np.frombuffer(data, np.int64, 2).tolist()
        bits.append(np.frombuffer(data, np.uint32, n, 16))
        for x, into in zip(places(data[16 + 4 * n :], n, m), (ids, marks, starts)):
            into.append(x)
    if bits:
        bit = np.concatenate(bits)
        order = np.argsort(bit)
        same = bit[order[1:]] == bit[order[:-1]]
        inner = np.sort(order[np.concatenate((same, [False])) | np.concatenate(([False], same))])
        local.append(by_document(np.concatenate(ids)[inner], np.concatenate(marks)[inner], np.concatenate(starts)[inner]))
    return dealt(local, buckets)


class Routes:
    """Tree of each suffix, from the counts of prefix cells by depth; the last row of counts is that of whole windows."""

    def __init__(self, counts: np.ndarray, group: int):
        self.cells = np.uint64(counts.shape[1])
        self.fits = counts[:-1] <= group
        sizes = np.where(self.fits, counts[:-1], 0).astype(np.float64)
        self.place = (np.cumsum(sizes.reshape(-1)) // group).astype(np.int64).reshape(sizes.shape)
        first = int(self.place.max(initial=-1)) + 1
        self.parts = np.maximum(1, -(-counts[-1] // group))
        fill = np.cumsum(np.where(self.parts > 1, 0, counts[-1])) // group
        own = np.cumsum(np.where(self.parts > 1, self.parts, 0))
        self.deep = np.where(self.parts > 1, first + int(fill.max(initial=0)) + 1 + own - self.parts, first + fill)

    def cell(self, paths: np.ndarray) -> np.ndarray:
        return (((paths >> np.uint64(32)) * self.cells) >> np.uint64(32)).astype(np.int64)

    def tree(self, prefixes: list[np.ndarray], paths: np.ndarray) -> np.ndarray:
        cell = self.cell(paths)
        out = self.deep[cell] + ((paths * np.uint64(BASE)) >> np.uint64(20)).astype(np.int64) % self.parts[cell]
        for d in range(len(prefixes) - 1, -1, -1):
            cell = self.cell(prefixes[d])
            out = np.where(self.fits[d][cell], self.place[d][cell], out)
        return out


class Passages:
    """Passages of a mapper as words of a dictionary, and those of their suffixes that ``runs`` name, in order of document and start."""

    def __init__(self, ids: np.ndarray, marks: np.ndarray, starts: np.ndarray, bodies: pa.Array, runs: list[np.ndarray], window: int):
        order = np.lexsort((starts, marks, ids))
        ids, marks, starts, bodies = ids[order], marks[order], starts[order], bodies.take(pa.array(order))
        split = pc.split_pattern(bodies, b" ")
        begin = split.offsets.to_numpy().astype(np.int64)
        last = begin[1:] - begin[:-1] - window
        coded = split.flatten().dictionary_encode()
        self.words, self.text = coded.dictionary, coded.indices.to_numpy().astype(np.uint32)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, self.words.to_pylist()), np.uint64, len(self.words))[self.text]
        doc, offset = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, k in enumerate(order.tolist()):
            pairs = merged(runs[k]) - starts[i]
            pairs = pairs[(pairs[:, 1] >= 0) & (pairs[:, 0] <= last[i])]
            at = [np.arange(max(a, 0), min(b, last[i]) + 1) for a, b in pairs.tolist()]
            offset += at
            doc.append(np.full(sum(map(len, at)), i))
        doc, offset = np.concatenate(doc), np.concatenate(offset)
        self.at = begin[doc] + offset
        self.ids, self.marks, self.starts = ids[doc], marks[doc], starts[doc] + offset
        # Suffixes of overlapping passages of a document, here twice, are one.
        new = heads(self.ids, self.marks, self.starts)
        self.at, self.ids, self.marks, self.starts = self.at[new], self.ids[new], self.marks[new], self.starts[new]
        whole = path_hashes(hashes, window)
        self.paths = whole[self.at] if len(self.at) else np.zeros(0, np.uint64)
        self.prefixes = [path_hashes(hashes, min(d, window))[self.at] if len(self.at) else self.paths for d in DEPTHS]
        self.window = window

    def matrix(self, own: np.ndarray) -> np.ndarray:
        return sliding_window_view(self.text, self.window)[self.at[own]]

    def first(self) -> tuple[np.ndarray, np.ndarray]:
        """The first of each window's suffixes, and the others."""
        order = np.argsort(self.paths, kind="stable")
        # Equal hashes are followed by a comparison of the words: a run ends where the words differ.
        new = np.ones(len(order), bool)
        may = np.flatnonzero(self.paths[order][1:] == self.paths[order][:-1]) + 1
        for a in range(0, len(may), 1 << 16):
            k = may[a : a + (1 << 16)]
            new[k] = (self.matrix(order[k]) != self.matrix(order[k - 1])).any(1)
        return np.sort(order[new]), np.sort(order[~new])

    def counts(self, cells: int) -> tuple[np.ndarray, np.ndarray]:
        once, _ = self.first()
        own = np.concatenate([np.bincount((((p[once] >> np.uint64(32)) * np.uint64(cells)) >> np.uint64(32)).astype(np.int64), minlength=cells) for p in [*self.prefixes, self.paths]])
        at = np.flatnonzero(own)
        return at, own[at]

    def leaves(self, routes: Routes) -> Iterator[tuple[int, int, bytes]]:
        """(tree, kind, blob): kind 0, the first suffix of each window with its words; kind 1, the others, which are known to repeat."""
        if not len(self.at):
            return
        once, later = self.first()
        tree = routes.tree([p[once] for p in self.prefixes], self.paths[once])
        if len(later):
            yield int(tree[0]), 1, by_document(self.ids[later], self.marks[later], self.starts[later])
        by = np.argsort(tree, kind="stable")
        cuts = heads(tree[by])
        used, number = np.zeros(len(self.words), bool), np.zeros(len(self.words), np.uint32)
        for a, b in zip(cuts, np.append(cuts[1:], len(by))):
            own = once[by[a:b]]
            m = self.matrix(own)
            used[:] = False
            used[m] = True
            held = np.flatnonzero(used)
            number[held] = np.arange(len(held))
            kind = np.uint16 if len(held) <= 1 << 16 else np.uint32
            text = b" ".join(self.words.take(pa.array(held)).to_pylist())
            ids, marks = self.ids[own], self.marks[own]
            at = heads(ids, marks)
            doc = np.zeros(len(own), np.int32)
            doc[at] = 1
            size, place = placed(np.cumsum(doc), ids[at], marks[at], self.starts[own])
            yield int(tree[by[a]]), 0, b"".join([np.array([len(text), np.dtype(kind).itemsize], np.int64).tobytes(), size, text, number[m].astype(kind).tobytes(), place])


def tree_of(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leaves of a tree in order, and how many words each has in common with the one before it."""
    wide = m.astype(">u4")
    order = np.argsort(np.ascontiguousarray(wide).view(f"S{4 * m.shape[1]}").reshape(-1), kind="stable")
    m = m[order]
    same = m[1:] == m[:-1]
    common = np.where(same.all(1), m.shape[1], same.argmin(1))
    return order, np.concatenate((np.zeros(min(1, len(m)), np.int64), common))


def later_in_tree(kinds: list[int], blobs: list, window: int, buckets: int) -> tuple[list[int], list[bytes]]:
    """Occurrences of the nodes at the cut of one tree, but for the first of each, by bucket."""
    found, words, ms, ids, marks, starts = [], [], [], [], [], []
    for kind, blob in zip(kinds, blobs):
        data = memoryview(blob)
        if kind:
            found.append(data)
            continue
        size, width, n, docs = np.frombuffer(data, np.int64, 4).tolist()
        at = 32 + size
        words.append(bytes(data[32:at]).split(b" "))
        ms.append(np.frombuffer(data, f"u{width}", n * window, at).reshape(n, window))
        for x, into in zip(places(data[at + n * window * width :], n, docs), (ids, marks, starts)):
            into.append(x)
    if ms:
        # One dictionary for all: equal words get equal numbers, from 1 on so that no number is a zero.
        known = pa.array([w for own in words for w in own], pa.binary()).dictionary_encode().indices.to_numpy().astype(np.uint32) + np.uint32(1)
        ends = np.cumsum([len(w) for w in words])
        m = np.concatenate([known[e - len(w) : e][x] for w, e, x in zip(words, ends, ms)])
        order, common = tree_of(m)
        doc_id, mark, start = (np.concatenate(x)[order] for x in (ids, marks, starts))
        node = np.cumsum(common < window)
        place = np.lexsort((start, mark, doc_id, node))
        first = np.zeros(len(place), bool)
        first[heads(node[place])] = True
        gone = place[~first]
        found.append(by_document(doc_id[gone], mark[gone], start[gone]))
    return dealt(found, buckets)


BLOBS = "bucket long, runs binary"


def removal_runs(rows: DataFrame, window: int, group: int, tree: int, chunk_bytes: int, fan: int) -> DataFrame:
    """(d, m, runs) with first and last starts of windows that also start earlier, from ``rows(doc_id, mark, text)``."""
    total = lambda df, c: df.agg(F.sum(F.octet_length(c))).first()[0] or 0
    size = total(rows, "text")
    buckets = max(1, -(-size // (WORD_BYTES * group)))
    batch_of = lambda rows, kinds, names: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
    sent, moved = ([pa.int64(), pa.int32(), pa.binary()], ["g", "kind", "leaves"]), "g long, kind int, leaves binary"

    def filtered(texts_of: DataFrame, size: int, name: str) -> DataFrame:
        """(d, m, runs): suffixes of ``texts_of(doc_id, mark, start, text)`` that may not be alone."""
        groups = max(1, -(-size // (WORD_BYTES * group)))
        coarse = min(groups, fan)
        parts = 1 if groups <= fan else max(1, -(-2 * size // (PART_BYTES * coarse)))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            docs, held = [], 0
            for batch in batches:
                own = [batch.column(c).to_pylist() for c in ("doc_id", "mark", "start")]
                for a, b in slices(batch, "text"):
                    for i, text in enumerate(texts(batch, "text", a, b), a):
                        docs.append((*(c[i] for c in own), hashed_words(text)))
                        held += len(text)
                        if held >= chunk_bytes:
                            if out := list(Chunk(docs, window).leaves(coarse, groups > fan)):
                                yield batch_of(out, *sent)
                            docs, held = [], 0
            if docs and (out := list(Chunk(docs, window).leaves(coarse, groups > fan))):
                yield batch_of(out, *sent)

        def deal(table: pa.Table) -> pa.Table:
            rows = list(dealt_again(*columns(table.select(["kind", "leaves"])), groups))
            trim()
            return pa.table([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 3, sent[0])], sent[1])

        leaves = texts_of.mapInArrow(lean(scan), moved)
        if groups > fan:
            leaves = leaves.groupBy("g", F.pmod(F.xxhash64("leaves"), F.lit(parts)).alias("part")).applyInArrow(deal, moved)
        leaves = leaves.select("g", "kind", "leaves").groupBy("g")
        return per_document(leaves.applyInArrow(lambda t: blobs(survivors(*columns(t), buckets)), BLOBS), name)

    def columns(table: pa.Table) -> tuple[list[int], list]:
        return table.column("kind").to_pylist(), [x.as_buffer() for x in table.column("leaves")]

    def blobs(found: tuple[list[int], list[bytes]]) -> pa.Table:
        trim()
        return pa.table({"bucket": pa.array(found[0], pa.int64()), "runs": pa.array(found[1], pa.binary())})

    def gathered(table: pa.Table) -> pa.Table:
        """A row for each document of a bucket."""
        head, value = opened([x.as_buffer() for x in table.column("runs")])
        cut = heads(head["id"], head["mark"])
        ends = np.concatenate(([0], np.cumsum(head["n"])))
        offsets = np.append(ends[cut], ends[-1]).astype(np.int32)
        ids = head["id"][cut]
        kinds = pa.schema([("d", pa.int64()), ("m", pa.int64()), ("runs", pa.list_(pa.int32()))])
        return pa.Table.from_arrays([pa.array(ids, mask=ids == NULL_ID), pa.array(head["mark"][cut]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(value))], schema=kinds)

    def per_document(found: DataFrame, name: str) -> DataFrame:
        return stored(found.groupBy("bucket").applyInArrow(lambda t: gathered(t.select(["runs"])), "d long, m long, runs array<int>"), name)

    whole = rows.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"), "mark", F.lit(0).cast("long").alias("start"), "text")
    alive = filtered(whole, size, "survivors")

    # Passages of survivors; those of equal text are one.
    passage_groups = max(1, -(-size // PASSAGE_BYTES))

    def local(places: list[tuple[int, int, int]], sizes: list[int]) -> bytes:
        """Whole passages as runs."""
        if not places:
            return b""
        head = np.zeros(len(places), HEAD)
        head["id"], head["mark"] = [p[0] for p in places], [p[1] for p in places]
        head["n"] = 2
        return packed(head, np.array([[p[2], p[2] + n - window] for p, n in zip(places, sizes)], np.int64).reshape(-1))

    def kept_first(found: dict, place: tuple[int, int, int], body: bytes, gone: list) -> None:
        first = found.get(body)
        if first is None or place < first:
            found[body] = place
            place = first
        if place is not None and place != found[body]:
            gone.append((place, body.count(b" ") + 1))

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, gone, held = {}, [], 0

        def out() -> pa.RecordBatch:
            rows = [(g, 0, blob) for g, blob in packed_passages(found)]
            if gone:
                rows.append((xxhash.xxh64_intdigest(repr(gone[0]).encode()) % passage_groups, 1, local(*zip(*gone))))
            return batch_of(rows, *sent)

        def packed_passages(found: dict) -> Iterator[tuple[int, bytes]]:
            by: dict[int, list] = {}
            for body, place in found.items():
                by.setdefault(xxhash.xxh64_intdigest(body) % passage_groups, []).append((place, body))
            for g, own in by.items():
                head = np.array([(*p, len(b)) for p, b in own], PLACE)
                yield g, len(own).to_bytes(8, "little") + head.tobytes() + b"".join(b for _, b in own)

        for batch in batches:
            ids, marks, runs = batch.column("doc_id").fill_null(NULL_ID).to_pylist(), batch.column("mark").to_pylist(), batch.column("runs")
            for a, b in slices(batch, "text"):
                for i, text in enumerate(texts(batch, "text", a, b), a):
                    for first, body in passages_of(text, merged(runs[i].values.to_numpy()), window):
                        kept_first(found, (ids[i], marks[i], first), body, gone)
                        held += len(body)
                    if held >= chunk_bytes:
                        yield out()
                        found, gone, held = {}, [], 0
        if found:
            yield out()

    def distinct(table: pa.Table) -> pa.Table:
        found, gone, known = {}, [], []
        for kind, blob in zip(*columns(table)):
            data = memoryview(blob)
            if kind:
                known.append(data)
                continue
            n = int.from_bytes(data[:8], "little")
            head, at = np.frombuffer(data, PLACE, n, 8), 8 + PLACE.itemsize * n
            for doc_id, mark, start, length in head.tolist():
                kept_first(found, (doc_id, mark, start), bytes(data[at : at + length]), gone)
                at += length
        b, runs = dealt([*known, local(*zip(*gone)) if gone else b""], buckets)
        places, none = list(found.values()), [None] * len(found)
        low = [int(path_hashes(hashed_words(body), window).view(np.int64).min()) for body in found]
        cols = [[*b, *none], [*runs, *none], *([*[None] * len(b), *(p[k] for p in places)] for k in range(3)), [*[None] * len(b), *found], [*[None] * len(b), *low]]
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
        trim()
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["bucket", "runs", "doc_id", "mark", "start", "text", "low"])

    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m"))
    held = joined_texts(rows, alive, same).mapInArrow(lean(passages), moved).groupBy("g")
    both = held.applyInArrow(lambda t: distinct(t.select(["kind", "leaves"])), BLOBS + ", doc_id long, mark long, start long, text binary, low long")
    both = stored(both, "passages")
    gone, firsts = both.filter("bucket IS NOT NULL").select("bucket", "runs"), both.filter("text IS NOT NULL").drop("bucket", "runs")
    discard(alive)
    alive = filtered(firsts.drop("low"), total(firsts, "text"), "survivors-of-passages")

    # Trees over the distinct passages. Those with the same least window hash are neighbours; a very common hash is cut by text.
    left = firsts.join(alive, (F.col("doc_id") == F.coalesce("d", F.lit(NULL_ID))) & (F.col("mark") == F.col("m"))).drop("d", "m")
    left = stored(left, "passages-left")
    words = total(left, "text")
    feed = stored(left.repartitionByRange(max(1, -(-words // FEED_BYTES)), "low", F.xxhash64("text")).sortWithinPartitions("low"), "passages-dealt")
    discard(alive, left)
    cells = min(MOST_CELLS, max(CELLS, 1 << (4 * words // (WORD_BYTES * tree) + 1).bit_length()))

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Passages]:
        for batch in batches:
            for a, b in slices(batch, "text"):
                part = batch.slice(a, b - a)
                own = (part.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "mark", "start"))
                yield Passages(*own, part.column("text"), [x.values.to_numpy() for x in part.column("runs")], window)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in chunk.counts(cells)], ["cell", "n"])

    table = feed.mapInArrow(lean(count), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(DEPTHS) + 1) * cells, np.int64)
    counts[table.column("cell").to_numpy()] = table.column("n").to_numpy()
    routes = Routes(counts.reshape(len(DEPTHS) + 1, cells), tree)

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            if out := list(chunk.leaves(routes)):
                yield batch_of(out, *sent)

    nodes = feed.mapInArrow(lean(grow), moved).groupBy("g")
    nodes = nodes.applyInArrow(lambda t: blobs(later_in_tree(*columns(t.select(["kind", "leaves"])), window, buckets)), BLOBS)
    runs = per_document(gone.unionByName(nodes), "runs")
    discard(both, feed)
    return runs


def passages_of(text: bytes, runs: np.ndarray, window: int) -> Iterator[tuple[int, bytes]]:
    """(start, words) of each run of suffixes."""
    first, end = word_spans(text)
    for a, b in runs.tolist():
        yield a, b" ".join(text[first[a] : end[b + window - 1]].split())


def joined_texts(rows: DataFrame, found: DataFrame, same) -> DataFrame:
    """(doc_id, mark, text, runs) of the documents that ``found(d, m, runs)`` names; only their texts are shuffled."""
    keys = found.select("d", "m")
    n = keys.count()
    hit = rows.join(F.broadcast(keys) if n <= BROADCAST_IDS else keys, same, "left_semi")
    return hit.join(found, same).select("doc_id", "mark", "text", "runs")


def keep_mask(n: int, runs: list[int], window: int) -> np.ndarray:
    """Words that no removed window covers."""
    edge = np.zeros(n + 1, np.int64)
    pairs = np.array(runs, np.int64).reshape(-1, 2)
    np.add.at(edge, pairs[:, 0], 1)
    np.add.at(edge, np.minimum(pairs[:, 1] + window, n), -1)
    return np.cumsum(edge[:n]) == 0


def remove_repeats(docs: DataFrame, window: int = WINDOW, group: int = GROUP, chunk_bytes: int = CHUNK_BYTES, keep_text: bool = False, tree: int = TREE, fan: int = FAN) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for each row of ``docs(doc_id, text)``; with ``keep_text`` also the kept ``text``.

    Words are runs of other than ASCII white space, unchanged. Null text has none. Rows that share a doc_id but not the text
    are separate documents in order of a 64-bit text hash; equal rows are one document, whose result each of them gets. A null
    doc_id comes before all others. An empty table gives no row; other columns play no part.
    """
    text_batches(docs.sparkSession)
    text = F.col("text").cast("string")
    rows = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    found = removal_runs(rows.filter("text IS NOT NULL"), window, group, tree, chunk_bytes, fan)
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m"))
    columns = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["text"] * keep_text
    schema = "doc_id long, mark long, n_words long, n_removed long, kept_sha256 string" + ", text string" * keep_text

    def kept(body: bytes, runs: list[int] | None) -> tuple:
        """(words, removed, digest, kept text)."""
        digest, lines, n, left, first = hashlib.sha256(), [], 0, 0, True
        mask = keep_mask(sum(map(len, word_pieces(body))), runs, window) if runs else None
        for words in word_pieces(body):
            own = words if mask is None else [words[k] for k in np.flatnonzero(mask[n : n + len(words)])]
            n, left = n + len(words), left + len(own)
            if own:
                line = (b"" if first else b" ") + b" ".join(own)
                digest.update(line)
                lines += [line] * keep_text
                first = False
        return n, n - left, digest.hexdigest(), *([b"".join(lines).decode("utf-8", "replace")] * keep_text)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = batch.column("runs").to_pylist() if "runs" in batch.schema.names else None
            for a, b in slices(batch, "text"):
                out = [kept(body, runs and runs[i]) for i, body in enumerate(texts(batch, "text", a, b), a)]
                kinds = [pa.int64(), pa.int64(), pa.string()] + [pa.string()] * keep_text
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("mark"), *(pa.array(c, k) for c, k in zip(zip(*out), kinds))], ["doc_id", "mark", *columns[1:]])

    if keep_text:
        return rows.join(found, same, "left").select("doc_id", "mark", "text", "runs").mapInArrow(lean(finish), schema).select(*columns)
    whole = stored(rows.mapInArrow(lean(finish), schema), "whole")
    untouched = whole.join(found.select("d", "m"), same, "left_anti")
    changed = joined_texts(rows, found, same).mapInArrow(lean(finish), schema)
    return untouched.select(*columns).unionByName(changed.select(*columns))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP10_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(text, '[^\x20\x09-\x0D]+') END AS w FROM documents),
s AS (SELECT rid, doc_id, w, unnest(range(1, len(w) - 18)) AS b FROM d WHERE len(w) >= 20),
h AS (SELECT rid, doc_id, b, sha256(array_to_string(list_slice(w, b, b + 19), ' ')) AS g FROM s),
later AS (SELECT rid, b FROM h QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, b) > 1),
gone AS (SELECT DISTINCT rid, unnest(range(b, b + 20)) AS p FROM later),
word AS (SELECT rid, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT rid, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS line FROM word ANTI JOIN gone USING (rid, p) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(line, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""
