"""Exact removal of repeated passages with a logarithmic family of suffix arrays.

A byte goes if a string of LENGTH bytes that covers it also starts somewhere else. Every such string (a window) has an
anchor: the leftmost place in it where a hash of GRAM bytes is least. Equal windows have equal anchors at equal places,
so windows are dealt out by anchor. The windows of one anchor in a text follow each other; their bytes are a piece.

1. Anchors and pieces are counted. A piece whose anchor occurs once goes nowhere. If an anchor always has the same
   piece, all of that piece is repeated.
2. Where pieces of one anchor differ, each distinct piece goes, with the others of its anchor, to one task. It holds a
   family of suffix arrays: each batch of pieces gets a suffix array of its windows (sorted by LENGTH bytes, as longer
   matches don't matter), which is merge-scanned against the arrays of all levels for equal windows; then it becomes a
   level itself, and levels of equal size merge, so that there are logarithmically many.
3. Anchors with so many bytes of different pieces that one task shouldn't hold them are dealt out by window: equal
   windows are counted by aggregation.

Repeated windows are joined back to the texts they occur in, and their union is cut from each text.

Texts are the largest thing that is dealt out. A Bloom filter of at most 4 MB tells which texts a join can need, so the
others stay where they are read; what it lets through by mistake costs work, never a result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm import textbytes as tb
from tessella.llm.common import drop_staged, guarded_join, modest_batches, staged, text_key

LENGTH = 200
GRAM = 48
#: Bytes of pieces that a task's family holds, about; tasks are as many as that takes.
FAMILY_BYTES = 4 << 20
#: An anchor with more bytes of different pieces than this is dealt out by window.
ANCHOR_BYTES = 1 << 20
#: Windows of a batch that gets a suffix array.
BATCH = 1 << 17
#: Windows of a level whose bytes are compared at once.
BLOCK = 1 << 15
#: log2 of the most bits of a Bloom filter (4 MB), at 16 bits a key or more. Beyond two million keys it lets more through: at
#: five million about 7 % of what has no key.
FILTER_BITS = 25
#: Bytes of one text that are looked at together.
_PART = 4 << 20


# ---- anchors ----


def _pieces(texts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, start, size, anchor's hash, piece's hash) of all pieces of some texts."""
    whole = b"".join(texts)
    sizes = np.array([len(t) for t in texts])
    data = np.frombuffer(whole, np.uint8)
    n = len(data) - length + 1
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    if n <= 0 or sizes.max() < length:
        return none
    up, down = tb.powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(tb._VALUE[data] * up[:-1], out=total[1:])
    grams = tb.mix((total[gram:] - total[:-gram]) * down[: len(data) - gram + 1])
    low = np.uint64((1 << 24) - 1)
    least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    span, have = length - gram + 1, 1
    while have < span:
        step = min(have, span - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    place = (least & low).astype(np.int64)
    # windows that start in a text and end in it
    ends = np.cumsum(sizes)
    inside = np.zeros(len(data) + 1, np.int32)
    fits = sizes >= length
    np.add.at(inside, ends[fits] - sizes[fits], 1)
    np.add.at(inside, ends[fits] - length + 1, -1)
    valid = np.cumsum(inside[:n]) > 0
    if not valid.any():
        return none
    new = np.empty(n, bool)
    new[0] = True
    new[1:] = (place[1:] != place[:-1]) | ~valid[:-1]
    new[(ends - sizes)[(ends - sizes) < n]] = True
    first = np.flatnonzero(new & valid)
    turn = np.flatnonzero(new | ~valid)
    after = np.append(turn, n)[np.searchsorted(turn, first, side="right")]
    size = after - first + length - 1
    owner = np.searchsorted(ends, first, side="right")
    anchor = place[first]
    ph = tb.mix((total[first + size] - total[first]) * down[first] + (size << 20).astype(np.uint64) + (anchor - first).astype(np.uint64))
    return owner, first - (ends - sizes)[owner], size, grams[anchor], ph


def pieces(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """_pieces, a long text by parts that share length - 1 bytes, so that each window is in one part."""
    if sum(map(len, texts)) <= 2 * _PART:
        return _pieces(texts, length, gram)
    out = []
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), _PART):
            owner, start, *rest = _pieces([text[at : at + _PART + length - 1]], length, gram)
            out.append((owner + i, start + at, *rest))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


# ---- the family ----


class Level:
    """Windows (starts in the family's bytes) in the order of their contents."""

    def __init__(self, order: np.ndarray, rank: int):
        self.order, self.rank = order, rank


class Family:
    """Suffix arrays of geometrically growing sizes over pieces that are added in batches."""

    def __init__(self, length: int = LENGTH, batch: int = BATCH):
        self.length, self.batch = length, batch
        self.data = np.zeros(1 << 20, np.uint8)
        self.size = 0
        self.repeated = np.zeros(1 << 20, bool)
        self.levels: list[Level] = []
        self.waiting: list[np.ndarray] = []
        self.n_waiting = 0

    def add(self, piece: bytes, known: bool) -> int:
        """Adds a piece and gives its place; known: all its windows are repeated already."""
        n = len(piece)
        while self.size + n > len(self.data):
            self.data = np.concatenate([self.data, np.zeros_like(self.data)])
            self.repeated = np.concatenate([self.repeated, np.zeros_like(self.repeated)])
        at = self.size
        self.data[at : at + n] = np.frombuffer(piece, np.uint8)
        windows = n - self.length + 1
        self.repeated[at : at + windows] = known
        self.size += n
        self.waiting.append(np.arange(at, at + windows))
        self.n_waiting += windows
        if self.n_waiting >= self.batch:
            self.flush()
        return at

    def keys(self, starts: np.ndarray) -> np.ndarray:
        view = np.lib.stride_tricks.sliding_window_view(self.data, self.length)
        return np.ascontiguousarray(view[starts]).view(f"S{self.length}").ravel()

    def flush(self) -> None:
        """The waiting windows get a suffix array, which is scanned against all levels and becomes one."""
        if not self.waiting:
            return
        starts = np.concatenate(self.waiting)
        self.waiting, self.n_waiting = [], 0
        for at in range(0, len(starts), self.batch):
            self._array(starts[at : at + self.batch])

    def _array(self, starts: np.ndarray) -> None:
        keys = self.keys(starts)
        order = np.argsort(keys, kind="stable")
        starts, keys = starts[order], keys[order]
        same = np.flatnonzero(keys[1:] == keys[:-1])
        self.repeated[starts[same]] = self.repeated[starts[same + 1]] = True
        # of equal windows one is enough for later scans; the others are known
        first = np.ones(len(starts), bool)
        first[same + 1] = False
        starts, keys = starts[first], keys[first]
        for level in self.levels:  # what a level has too is marked there and not kept again
            fresh = self.scan(level, starts, keys)
            starts, keys = starts[fresh], keys[fresh]
        if not len(starts):
            return
        new = Level(starts, 0)
        while self.levels and self.levels[-1].rank == new.rank:
            new = self.merged(self.levels.pop(), new)
        self.levels.append(new)

    def _blocks(self, level: Level, starts: np.ndarray, keys: np.ndarray) -> Iterator[tuple[slice, slice, np.ndarray]]:
        """Blocks of a level with the run of (sorted) windows that fall into each, and the block's keys."""
        size = BLOCK
        heads = self.keys(level.order[::size])
        cuts = np.searchsorted(keys, heads)
        cuts[0] = 0
        for i, (begin, end) in enumerate(zip(cuts, [*cuts[1:], len(keys)], strict=True)):
            block = slice(i * size, min((i + 1) * size, len(level.order)))
            yield block, slice(begin, end), self.keys(level.order[block]) if end > begin else np.zeros(0, keys.dtype)

    def scan(self, level: Level, starts: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Marks windows that are in the level too, and those of the level; True for the rest."""
        fresh = np.ones(len(starts), bool)
        if not len(starts):
            return fresh
        for block, run, own in self._blocks(level, starts, keys):
            if not len(own):
                continue
            at = np.minimum(np.searchsorted(own, keys[run]), len(own) - 1)
            equal = own[at] == keys[run]
            self.repeated[starts[run][equal]] = True
            self.repeated[level.order[block][at[equal]]] = True
            fresh[run][equal] = False
        return fresh

    def merged(self, old: Level, new: Level) -> Level:
        """Both levels' windows in order, which have none in common; the new level is taken in runs of a batch."""
        parts, rest = [], old.order
        for at in range(0, len(new.order), self.batch):
            run = new.order[at : at + self.batch]
            # of the old level, what comes before the next run
            cut = len(rest)
            if at + self.batch < len(new.order):
                cut = self._rank(rest, self.keys(new.order[at + self.batch : at + self.batch + 1])[0])
            parts.append(self._merge(Level(rest[:cut], 0), run, self.keys(run)))
            rest = rest[cut:]
        return Level(np.concatenate([*parts, rest]), old.rank + 1)

    def _rank(self, order: np.ndarray, key: bytes) -> int:
        low, high = 0, len(order)
        while low < high:
            mid = (low + high) // 2
            if self.keys(order[mid : mid + 1])[0] < key:
                low = mid + 1
            else:
                high = mid
        return low

    def _merge(self, old: Level, starts: np.ndarray, keys: np.ndarray) -> np.ndarray:
        if not len(old.order):
            return starts
        out = []
        for block, run, own in self._blocks(old, starts, keys):
            mine = old.order[block]
            if run.start == run.stop:
                out.append(mine)
                continue
            out.append(np.insert(mine, np.searchsorted(own, keys[run]), starts[run]))
        return np.concatenate(out)


def runs(flags: np.ndarray, length: int) -> tuple[list[int], list[int]]:
    """Starts and ends of the bytes covered by the flagged windows of a piece."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edges[::2].tolist(), (edges[1::2] + length - 1).tolist()


# ---- texts that a join can need ----


def _marks(key: Column, width: int) -> list[Column]:
    """Places of a 64-bit key in a filter of 2**width bits."""
    return [F.shiftright(key, by).bitwiseAND(F.lit((1 << width) - 1)) for by in (0, 32)]


class Filter:
    """A Bloom filter of a column of 64-bit hashes; a row of its bits is broadcast."""

    def __init__(self, keys: DataFrame, key: Column):
        self.width = min(FILTER_BITS, max(10, (16 * keys.count()).bit_length()))
        places = keys.select(F.explode(F.array(*_marks(key, self.width))).alias("at"))
        words = places.groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("b")).toArrow()
        bits = np.zeros(1 << (self.width - 6), np.int64)
        bits[words.column("w").to_numpy()] = words.column("b").to_numpy()
        offsets = pa.array([0, len(bits)], pa.int32())
        self.bits = keys.sparkSession.createDataFrame(pa.table({"filter_bits": pa.ListArray.from_arrays(offsets, pa.array(bits))}))

    def split(self, rows: DataFrame, key: Column, how: str = "left_semi") -> DataFrame:
        """The rows whose key the filter has, or seems to have; with left_anti the others."""
        first, second = (F.getbit(F.get("filter_bits", F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1 for at in _marks(key, self.width))
        return rows.join(F.broadcast(self.bits), first & second, how)


# ---- the operator ----


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, family_bytes: int = FAMILY_BYTES, anchor_bytes: int = ANCHOR_BYTES) -> DataFrame:
    """(t, spans), a stored table: for the key of each text that loses bytes, the covered runs (s, e), which may overlap."""
    rows = modest_batches(docs).select(F.col(doc_id).alias("doc_id"), text_key(text).alias("t"), F.col(text).alias("text")).filter(F.octet_length("text") >= length)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in tb.slices(batches):
            _, _, _, a, ph = pieces(texts, length, gram)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(ph.view(np.int64))], names=["a", "ph"])

    counted = rows.select("text").mapInArrow(count, "a long, ph long")
    shared = counted.groupBy("a").agg(F.count("*").alias("n"), F.min("ph").alias("p0"), F.max("ph").alias("p1"))
    shared = staged(shared.filter("n > 1").select("a", (F.col("p0") == F.col("p1")).alias("uniform")))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in tb.slices(batches):
            owner, start, size, a, ph = pieces(texts, length, gram)
            yield pa.RecordBatch.from_arrays(
                [part.column("t").take(pa.array(owner)), pa.array(start), pa.array(size.astype(np.int32)), pa.array(a.view(np.int64)), pa.array(ph.view(np.int64))], names=["t", "start", "size", "a", "ph"]
            )

    placed = rows.select("t", "text").mapInArrow(place, "t binary, start long, size int, a long, ph long")
    # copies of a text have the same pieces: uniform or not, the counts above have seen them all
    placed = guarded_join(placed, shared, "a")
    docs.sparkSession._jvm.System.gc()  # the shuffle files of the counts go before those of the places are written
    hits = staged(placed)
    drop_staged(shared)
    alike = hits.filter("uniform").select("t", F.col("start").alias("s"), (F.col("start") + F.col("size")).alias("e"))
    mixed = hits.filter("not uniform")

    # a place to read each distinct piece from
    distinct = mixed.groupBy("a", "ph").agg(F.min(F.struct("t", "start", "size")).alias("at"), (F.count("*") > 1).alias("known"))
    texts_at = rows.groupBy("t").agg(F.min("doc_id").alias("own_id"))
    wanted = distinct.select(F.col("at.t").alias("t"), F.struct(F.col("at.start").alias("start"), F.col("at.size").alias("size"), "a", "ph", "known").alias("p"))
    wanted = wanted.groupBy("t").agg(F.collect_list("p").alias("ps")).join(texts_at.hint("merge"), "t")
    wanted = staged(wanted.select(F.col("t").alias("t2"), "own_id", "ps"))
    # a row of wanted is as long as its list of pieces, so it isn't broadcast, however few there are
    sources = Filter(wanted, F.xxhash64("t2", "own_id")).split(rows.select("doc_id", F.col("t").alias("t2"), "text"), F.xxhash64("t2", "doc_id"))
    joined = sources.join(wanted.hint("merge"), "t2").filter(F.col("doc_id").eqNullSafe(F.col("own_id")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.column("text")[i].as_py().encode()
                ps = batch.column("ps")[i].values.flatten()
                start, size, a, ph, known = ps
                own = [one[s : s + n] for s, n in zip(start.to_pylist(), size.to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([a, ph, known, pa.array(own, pa.binary())], names=["a", "ph", "known", "piece"])

    contents = staged(joined.select("text", "ps").mapInArrow(cut, "a long, ph long, known boolean, piece binary"))
    drop_staged(wanted)
    sizes = contents.groupBy("a").agg(F.sum(F.length("piece").cast("long")).alias("bytes"))
    hot = staged(sizes.filter(F.col("bytes") > anchor_bytes).select("a"))
    some_hot = hot.limit(1).count() > 0
    total = contents.agg(F.sum(F.length("piece").cast("long"))).first()[0] or 0
    # each hot anchor stands for anchor_bytes, so there are few, and contents stay where they are
    cool = guarded_join(contents, hot, "a", "left_anti") if some_hot else contents

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, seen, places = Family(length), set(), []
        for batch in batches:
            for a, ph, known, piece in zip(*(batch.column(c).to_pylist() for c in ("a", "ph", "known", "piece")), strict=True):
                if (a, ph) not in seen:  # rows that repeat an id and a text bring their pieces again
                    seen.add((a, ph))
                    places.append((a, ph, len(piece), family.add(piece, known)))
        family.flush()
        for at in range(0, len(places), 10_000):
            out = [(a, ph, *runs(family.repeated[p : p + n - length + 1], length)) for a, ph, n, p in places[at : at + 10_000]]
            out = [r for r in out if r[2]]
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.int32())), pa.array(cols[3], pa.list_(pa.int32()))], names=["a", "ph", "rs", "re"])

    schema = "a long, ph long, rs array<int>, re array<int>"
    found, done = cool.repartition(max(1, -(-int(total) // family_bytes)), "a").mapInArrow(match, schema), [contents, hot]
    if some_hot:

        def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, ph, known, piece in zip(*(batch.column(c).to_pylist() for c in ("a", "ph", "known", "piece")), strict=True):
                    n = len(piece) - length + 1
                    own = [hashlib.blake2b(piece[i : i + length], digest_size=16).digest() for i in range(n)]
                    yield pa.RecordBatch.from_arrays([pa.array([a] * n, pa.int64()), pa.array([ph] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([known] * n, pa.bool_()), pa.array(own, pa.binary())], names=["a", "ph", "i", "known", "w"])

        each = staged(guarded_join(contents, hot, "a", "left_semi").distinct().mapInArrow(windows, "a long, ph long, i int, known boolean, w binary"))
        twice = staged(each.groupBy("w").agg((F.count("*") > 1).alias("many"), F.max("known").alias("any")).filter("many or any").select("w"))
        done += [each, twice]
        marked = each.join(twice.hint("merge"), "w").groupBy("a", "ph").agg(F.collect_set("i").alias("rs"))
        found = found.union(marked.select("a", "ph", "rs", F.transform("rs", lambda x: (x + F.lit(length)).cast("int")).alias("re")))
    found = staged(found)
    for one in done:
        drop_staged(one)
    back = mixed.join(found.hint("merge"), ["a", "ph"]).select("t", "start", F.explode(F.arrays_zip("rs", "re")).alias("r"))
    back = back.select("t", (F.col("start") + F.col("r.rs")).alias("s"), (F.col("start") + F.col("r.re")).alias("e"))
    spans = staged(alike.union(back).groupBy("t").agg(F.collect_set(F.struct("s", "e")).alias("spans")))
    for one in (hits, found):
        drop_staged(one)
    return spans


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, family_bytes: int = FAMILY_BYTES, anchor_bytes: int = ANCHOR_BYTES) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept (binary: the remaining bytes, joined).

    A null text counts as empty; it and texts shorter than length keep all. Rows that repeat a text, also under one id,
    count as other places, so such texts lose all that a window covers. An empty table gives no rows. A very long text
    is hashed in parts that share length - 1 bytes. Only doc_id and text are read, so further columns change nothing.
    docs is read several times and has to give the same rows each time.
    """
    spans = repeated_spans(docs, doc_id, text, length, gram, family_bytes, anchor_bytes)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), text_key(text).alias("t"))
    losing, key = Filter(spans, F.xxhash64("t")), F.xxhash64("t")
    joined = losing.split(rows, key).join(spans.hint("merge"), "t", "left").select("doc_id", "text", "spans")
    joined = joined.union(losing.split(rows, key, "left_anti").select("doc_id", "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans")))
    kind = docs.schema[doc_id].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in tb.slices(batches):
            out = []
            for one, own in zip(texts, part.column("spans"), strict=True):
                if not own.is_valid:
                    out.append((len(one), 0, 0, one))
                    continue
                s, e = (c.to_numpy() for c in own.values.flatten())
                depth = np.zeros(len(one) + 1, np.int32)
                np.add.at(depth, s, 1)
                np.add.at(depth, e, -1)
                gone = np.cumsum(depth[:-1]) > 0
                begins = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
                out.append((len(one), int(gone.sum()), begins, np.frombuffer(one, np.uint8)[~gone].tobytes()))
            n, r, k, kept = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(k, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
