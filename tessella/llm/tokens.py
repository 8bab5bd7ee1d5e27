"""Byte-level BPE encoding and decoding by DuckDB recursive queries in each partition.

A text is split at places where no match of the pattern can cross: between a character that isn't white space and a
space before another such character. A partition meets few distinct matches, so each is encoded once and remembered, up
to REMEMBER bytes: in two generations, of which the older one goes when the younger one is full, and what is used moves
to the younger one. New matches go, some thousands at a time, to a DuckDB table of (match, position, token) rows. A
recursive query joins neighbouring tokens with the merge table, contracts each match's leftmost pair of least rank and
repeats until no pair merges. Decoding joins ids with the vocabulary and puts the bytes together in the ids' order.

A match of more than SHORT bytes is contracted in parts, which are then joined two and two: the tokens next to the seam
are contracted anew, and where the outermost two of them come out as they were, the rest stays as it is, since a row of
tokens is what merging leaves if each two neighbours are. Otherwise twice as many are taken. Bytes taken anew that are
more than SHORT go to a second query, which contracts all occurrences of the pair in a round where no pair of a lesser
rank can come from them. So time grows almost in proportion to a match's length.

The vocabulary file's path is a parameter; the file must be readable at the same path on every executor (it is part of
an installed package there).
"""

from __future__ import annotations

import base64
import contextlib
import gc
import hashlib
import threading
import time
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import textbytes as tb
from tessella.llm.common import modest_batches

#: Distinct matches given to one recursive query: about 8 rows each, and fewer for every round.
WORDS_AT_ONCE = 20_000
#: Bytes of matches and ids (with what Python needs to hold them) that a worker remembers, half in either generation; what
#: the present slice has comes on top.
REMEMBER = 96 << 20
#: Seconds after which a worker that encodes and decodes nothing gives up what it remembers.
IDLE = 4.0
_HELD = 180  # bytes of a dictionary's entry besides its texts
#: Bytes of a match that is contracted in one go.
SHORT = 32
#: Bytes of texts that are put together from pieces at once, which takes about 20 times as many.
JOINED = 1 << 20

# place is word * 2**32 + position; positions stay dense, so a token's neighbour is at place + 1
_CONTRACT = """
WITH RECURSIVE step(round, place, token) AS (
  SELECT 0, place, token FROM start
  UNION ALL
  (
    WITH best AS (
      SELECT a.place >> 32 AS word, min(m.rank * 4294967296 + (a.place & 4294967295)) AS first
      FROM step a JOIN step b ON b.place = a.place + 1 JOIN merges m ON m.pair = a.token * 65536 + b.token GROUP BY 1
    )
    SELECT round + 1,
           CASE WHEN (place & 4294967295) > (first & 4294967295) THEN place - 1 ELSE place END,
           CASE WHEN (place & 4294967295) = (first & 4294967295) THEN first >> 32 ELSE token END
    FROM step JOIN best ON word = place >> 32 WHERE (place & 4294967295) <> (first & 4294967295) + 1
  )
), ended AS (SELECT place >> 32 AS word, max(round) AS round FROM step GROUP BY 1)
SELECT step.place, step.token FROM step JOIN ended ON step.round = ended.round AND step.place >> 32 = ended.word ORDER BY step.place
"""

# as above, with all occurrences of a word's pair: of a run of overlapping ones every other; alone: only the leftmost
_CONTRACT_RUNS = """
WITH RECURSIVE step(round, place, token) AS (
  SELECT 0, place, token FROM start
  UNION ALL
  (
    WITH pair AS (
      SELECT a.place, m.rank * 2 + m.alone AS made
      FROM step a JOIN step b ON b.place = a.place + 1 JOIN merges m ON m.pair = a.token * 65536 + b.token
    ), best AS (SELECT place >> 32 AS word, min(made) AS made FROM pair GROUP BY 1
    ), here AS (
      SELECT p.place, p.made, row_number() OVER (PARTITION BY p.place >> 32 ORDER BY p.place) AS nth
      FROM pair p JOIN best b ON b.word = p.place >> 32 AND b.made = p.made
    ), taken AS (
      SELECT place, made >> 1 AS token
      FROM (SELECT *, place - min(place) OVER (PARTITION BY place >> 32, place - nth) AS inside FROM here)
      WHERE inside % 2 = 0 AND (made % 2 = 0 OR nth = 1)
    )
    SELECT round + 1, ((s.place >> 32) << 32) + row_number() OVER (PARTITION BY s.place >> 32 ORDER BY s.place) - 1, coalesce(t.token, s.token)
    FROM step s JOIN best ON best.word = s.place >> 32 LEFT JOIN taken t ON t.place = s.place LEFT JOIN taken before ON before.place = s.place - 1
    WHERE before.place IS NULL
  )
), ended AS (SELECT place >> 32 AS word, max(round) AS round FROM step GROUP BY 1)
SELECT step.place, step.token FROM step JOIN ended ON step.round = ended.round AND step.place >> 32 = ended.word ORDER BY step.place
"""

_SPACES = [c for c in map(chr, range(0x3001)) if c.isspace()]

_DECODE = "SELECT v.token FROM given JOIN vocabulary v ON v.id = given.id ORDER BY given.pos"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


@contextlib.contextmanager
def _uncollected() -> Iterator[None]:
    """Without searches for cycles of garbage, which many lists made at once would set off again and again."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


class Codec:
    """Encodes and decodes with one DuckDB connection. Ranks must be below 2**31 and hold every single byte."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        self.ranks = read_ranks(path)
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.matches = regex.compile(pattern).findall
        self.rank_of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        # ids of pieces that are one match, and of other matches: those of the younger generation, and before them
        self.pieces_known: dict[str, bytes] = {}
        self.words_known: dict[str, bytes] = {}
        self.pieces_before: dict[str, bytes] = {}
        self.words_before: dict[str, bytes] = {}
        #: What a call of decode() has decoded, while it lasts.
        self.decoded_known: dict[bytes, bytes] = {}
        self.held, self.used, self.busy = 0, 0.0, 0
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "200MB"})
        # all ways to put a token together from two tokens: the rank of a pair is that of what it makes
        pairs, made = [], []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs.append(left * 65536 + right)
                    made.append(rank)
        if max(self.bytes_of) >= 65536:
            raise ValueError("ranks of 65536 and more aren't supported")
        pair, rank = np.array(pairs, np.int64), np.array(made, np.int64)
        # a token that can be part of one of a lesser rank is merged alone, as that would come next
        part, whole = np.concatenate([pair >> 16, pair & 65535]), np.concatenate([rank, rank])
        tables = {
            "merges": pa.table({"pair": pair, "rank": rank, "alone": np.isin(rank, part[whole < part]).astype(np.int64)}),
            "vocabulary": pa.table({"id": pa.array(list(self.bytes_of), pa.int64()), "token": pa.array(list(self.bytes_of.values()), pa.binary())}),
        }
        for name, rows in tables.items():
            self.db.register("rows_in", rows)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM rows_in")
            self.db.unregister("rows_in")
        del pairs, made, pair, rank, part, whole, tables, rows
        tb.release()

    def close(self) -> None:
        self.db.close()
        for known in (self.words_known, self.pieces_known, self.words_before, self.pieces_before, self.decoded_known):
            known.clear()
        self.held = 0

    def _remember(self, known: dict[str, bytes], new: list[str], ids: list[bytes]) -> None:
        known.update(zip(new, ids, strict=True))
        self.held += sum(map(len, new)) + sum(map(len, ids)) + _HELD * len(new)

    def _unknown(self, known: dict[str, bytes], before: dict[str, bytes], asked: Iterable[str]) -> list[str]:
        """What neither generation has of what is asked for; what the older one has moves to the younger one."""
        rest = [a for a in asked if a not in known]
        again = [a for a in rest if a in before]
        self._remember(known, again, [before[a] for a in again])
        return [a for a in rest if a not in before]

    def _merged(self, words: list[bytes], query: str) -> list[bytes]:
        """Little-endian ids of what merging leaves of each word."""
        found = [b""] * len(words)
        for part in _parts(list(range(len(words))), list(map(len, words))):
            lengths = np.array([len(words[i]) for i in part])
            starts = np.cumsum(lengths) - lengths
            tokens = self.rank_of_byte[np.frombuffer(b"".join([words[i] for i in part]), np.uint8)]
            place = (np.repeat(np.arange(len(part)), lengths) << 32) + np.arange(len(tokens)) - np.repeat(starts, lengths)
            self.db.register("start", pa.table({"place": place, "token": tokens}))
            got = self.db.execute(query).fetchnumpy()
            self.db.unregister("start")
            ids = np.asarray(got["token"], "<u4").tobytes()
            ends = 4 * np.searchsorted(np.asarray(got["place"]) >> 32, np.arange(len(part)), side="right")
            begin = 0
            for i, end in zip(part, ends.tolist(), strict=True):
                found[i] = ids[begin:end]
                begin = end
        return found

    def _joined(self, seams: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        """What merging leaves of each two neighbouring texts, from what it leaves of either."""
        done: list = [None] * len(seams)
        left, width = list(range(len(seams))), 4
        while left:
            own = {i: (seams[i][0][-width:], seams[i][1][:width]) for i in left}
            texts = [b"".join([self.bytes_of[t] for t in np.concatenate(own[i]).tolist()]) for i in left]
            short = [len(t) <= SHORT for t in texts]
            new: dict[int, bytes] = {}
            for few, query in ((True, _CONTRACT), (False, _CONTRACT_RUNS)):
                which = [k for k, s in enumerate(short) if s is few]
                new |= dict(zip(which, self._merged([texts[k] for k in which], query), strict=True))
            again = []
            for k, i in enumerate(left):
                (a, b), (x, y), ids = seams[i], own[i], np.frombuffer(new[k], "<u4")
                if (len(x) == len(a) or ids[0] == x[0]) and (len(y) == len(b) or ids[-1] == y[-1]):
                    done[i] = np.concatenate([a[: len(a) - len(x)], ids, b[len(y) :]])
                else:
                    again.append(i)
            left, width = again, 2 * width
        return done

    def contract(self, words: list[bytes]) -> list[bytes]:
        """Little-endian ids of each word: its own rank if it is a token, else what merging leaves."""
        found = [self.ranks[w].to_bytes(4, "little") if w in self.ranks else b"" for w in words]
        rest = [i for i, ids in enumerate(found) if not ids and 0 < len(words[i]) <= SHORT]
        for i, ids in zip(rest, self._merged([words[i] for i in rest], _CONTRACT), strict=True):
            found[i] = ids
        for i, ids in enumerate(found):
            if not ids and len(words[i]) > SHORT:
                word = words[i]
                parts = self._merged([word[at : at + SHORT] for at in range(0, len(word), SHORT)], _CONTRACT)
                rows = [np.frombuffer(p, "<u4") for p in parts]
                while len(rows) > 1:
                    odd = rows[len(rows) & ~1 :]
                    rows = self._joined(list(zip(rows[::2], rows[1::2], strict=False))) + odd
                found[i] = rows[0].tobytes()
        return found

    def learn(self, pieces: list[str]) -> list[bytes]:
        """Little-endian ids of each piece, each match of the pattern encoded separately."""
        if self.held > REMEMBER // 2:
            self.pieces_before, self.words_before = self.pieces_known, self.words_known
            self.pieces_known, self.words_known, self.held = {}, {}, 0
        known, words = self.pieces_known, self.words_known
        single, several = [], {}
        with _uncollected():
            for piece in self._unknown(known, self.pieces_before, pieces):
                found = self.matches(piece)
                if len(found) == 1 and found[0] == piece:
                    single.append(piece)
                else:
                    several[piece] = found
        # a piece that is one match has the ids of that match
        asked = set().union(*several.values()).difference(single)
        other = self._unknown(words, self.words_before, self._unknown(known, self.pieces_before, asked))
        ids = self.contract([w.encode() for w in single + other])
        self._remember(known, single, ids[: len(single)])
        self._remember(words, other, ids[len(single) :])
        made = {piece: b"".join([known[w] if w in known else words[w] for w in found]) for piece, found in several.items()}
        return [known[p] if p in known else made[p] for p in pieces]

    def decode(self, coded: list[bytes], distinct: bool = False) -> list[bytes]:
        """The bytes of each sequence of little-endian ids; those that repeat are decoded once, unless all are distinct."""
        if not distinct:
            known = self.decoded_known
            known.update(dict.fromkeys(coded, b""))
            known.update(zip(known, self.decode(list(known), True), strict=True))
            found = [known[c] for c in coded]
            known.clear()
            return found
        out: list[bytes] = []
        lengths = [len(c) // 4 for c in coded]
        for part, own in zip(_parts(coded, lengths), _parts(lengths, lengths), strict=True):
            ids = np.frombuffer(b"".join(part), "<u4").astype(np.int64)
            self.db.register("given", pa.table({"pos": np.arange(len(ids)), "id": ids}))
            found = self.db.sql(_DECODE).to_arrow_table().column("token").cast(pa.large_binary()).combine_chunks()
            self.db.unregister("given")
            if len(found) != len(ids):
                raise ValueError("ids outside the vocabulary")
            _, offsets, data = found.buffers()
            upto = np.frombuffer(offsets, np.int64)[found.offset :] if len(ids) else np.zeros(1, np.int64)
            ends = upto[np.cumsum(own)].tolist()
            every = data.to_pybytes() if data else b""
            out += [every[begin:end] for begin, end in zip([int(upto[0]), *ends], ends, strict=False)]
        return out


class Sequences:
    """Texts as sequences of pieces: the distinct pieces' bytes, which piece comes where, and where each text ends."""

    def __init__(self, pieces: list[bytes], order: np.ndarray, ends: np.ndarray):
        self.pieces, self.order, self.ends = pieces, order, ends

    def joined(self) -> list[bytes]:
        """Each text's pieces, concatenated; at most JOINED bytes are put together at once, or one text."""
        lengths = np.fromiter(map(len, self.pieces), np.int64, len(self.pieces))
        starts = np.cumsum(lengths) - lengths
        every = np.frombuffer(b"".join(self.pieces), np.uint8)
        upto = np.concatenate([[0], np.cumsum(lengths[self.order])])
        ends = upto[self.ends]  # in bytes
        out: list[bytes] = []
        while len(out) < len(ends):
            i, first = len(out), self.ends[len(out) - 1] if out else 0
            j = max(i + 1, int(np.searchsorted(ends, upto[first] + JOINED, side="right")))
            some = self.order[first : self.ends[j - 1]]
            own = lengths[some]
            at = np.repeat(starts[some] - (upto[first : first + len(some)] - upto[first]), own)
            at += np.arange(len(at))
            data = every[at].tobytes()
            cuts = (ends[i:j] - upto[first]).tolist()
            out += [data[begin:end] for begin, end in zip([0, *cuts], cuts, strict=False)]
        return out


def pieces_of(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct pieces of the texts, the order they come in, and where in it each text ends."""
    plain = [not odd_spaces(t) for t in texts]
    split = pc.split_pattern(pa.array([t if ok else "" for t, ok in zip(texts, plain, strict=True)], pa.large_string()), " ")
    n = np.diff(split.offsets.to_numpy())
    flat = split.flatten()
    first = np.zeros(len(flat), bool)
    first[split.offsets.to_numpy()[:-1] - split.offsets[0].as_py()] = True
    firsts, rests = (flat.filter(pa.array(m)).dictionary_encode() for m in (first, ~first))
    odd = [cut(t) for t, ok in zip(texts, plain, strict=True) if not ok]
    strange = pa.array([p for ps in odd for p in ps], pa.large_string()).dictionary_encode()
    a, b = len(firsts.dictionary), len(firsts.dictionary) + len(rests.dictionary)
    distinct = [*_strings(firsts.dictionary), *[" " + p for p in _strings(rests.dictionary)], *strange.dictionary.to_pylist()]
    order = np.empty(len(flat), np.int64)
    order[first] = firsts.indices.to_numpy()
    order[~first] = rests.indices.to_numpy() + a
    counts = n.copy()
    if odd:
        # the odd texts stand as one empty first piece in order; put theirs in its place
        counts[[i for i, ok in enumerate(plain) if not ok]] = list(map(len, odd))
        upto = np.cumsum(counts)
        whole = np.empty(upto[-1], np.int64)
        mine = np.repeat(np.array(plain), counts)
        whole[mine] = order[np.repeat(np.array(plain), n)]
        whole[~mine] = strange.indices.to_numpy() + b
        order = whole
    return distinct, order, np.cumsum(counts)


def _strings(words: pa.Array) -> list[str]:
    """words, which have no spaces, as a list: by one long string, which is faster than one by one."""
    if not len(words):
        return []
    own = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
    return pc.binary_join(own, pa.scalar(" ", pa.large_string()))[0].as_py().split(" ")


def _parts(items: list, sizes: list[int]) -> Iterator[list]:
    """items in runs of WORDS_AT_ONCE and 12 times as many tokens at most, but of one item at least."""
    at = size = 0
    for i, n in enumerate(sizes):
        if i > at and (i - at >= WORDS_AT_ONCE or size + n > 12 * WORDS_AT_ONCE):
            yield items[at:i]
            at, size = i, 0
        size += n
    if items[at:]:
        yield items[at:]


def odd_spaces(text: str) -> bool:
    """Whether a space stands at an end or beside other white space."""
    return text[:1] == " " or text[-1:] == " " or any(c in text and (f" {c}" in text or f"{c} " in text) for c in _SPACES)


def cut(text: str) -> list[str]:
    """Pieces of a text: cut before each space that follows and precedes a character that isn't white space."""
    out: list[str] = []
    for part in text.split(" "):
        if not out:
            out.append(part)
        elif part and out[-1] and not part[0].isspace() and not out[-1][-1].isspace():
            out.append(" " + part)
        else:
            out[-1] += " " + part
    return out


_open: dict[tuple[str, str], Codec] = {}
_lock = threading.Lock()


@contextlib.contextmanager
def codec(path: str, pattern: str) -> Iterator[Codec]:
    """One for each Python worker and vocabulary. Workers outlive their tasks, so one that isn't used for IDLE seconds
    goes with all that it remembers."""
    with _lock:
        own = _open.get((path, pattern))
        if own is None:
            own = _open[path, pattern] = Codec(path, pattern)
        own.busy += 1
    try:
        yield own
    finally:
        with _lock:
            own.busy -= 1
            own.used = time.monotonic()
        timer = threading.Timer(IDLE, _close_idle, (path, pattern))
        timer.daemon = True
        timer.start()


def _close_idle(path: str, pattern: str) -> None:
    with _lock:
        own = _open.get((path, pattern))
        if own is None or own.busy or time.monotonic() - own.used < 0.9 * IDLE:
            return
        del _open[path, pattern]
        own.close()
        del own
    tb.release()


#: Bytes of text taken through the codec at once.
_SLICE = 8 << 20


def _slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in batches:
        texts = [t or "" for t in batch.column(column).to_pylist()]
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size < _SLICE):
                size += len(texts[end])
                end += 1
            yield batch.slice(at, end - at), texts[at:end]
            at = end


def round_trip(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256 and decoded_sha256. Null counts as an empty text, which has no tokens.

    Rows are independent, so repeated ids, ties and extra columns change nothing; an empty table gives no rows. A very
    long text is held at once with its ids; a very long match is contracted in parts. pattern must be one of the family
    that cut() is right for: no match goes from a character that isn't white space over a space to another. Ranks of
    65,536 and more raise a ValueError.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with codec(path, pattern) as own:
            for rows, texts in _slices(batches, "text"):
                pieces, order, ends = pieces_of(texts)
                coded = own.learn(pieces)
                ids = Sequences(coded, order, ends).joined()
                back = Sequences(own.decode(coded, distinct=True), order, ends).joined()
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array([hashlib.sha256(i).hexdigest() for i in ids]), pa.array([hashlib.sha256(b).hexdigest() for b in back])],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    rows = modest_batches(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", into: str = "ids") -> DataFrame:
    """docs with a column of ids (array of int). A null or empty text gets an empty array; a column named into is
    replaced."""
    from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

    kept = modest_batches(docs).drop(into)
    schema = StructType([*kept.schema.fields, StructField(into, ArrayType(IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with codec(path, pattern) as own:
            for rows, texts in _slices(batches, text):
                pieces, order, ends = pieces_of(texts)
                ids = [np.frombuffer(coded, "<i4") for coded in Sequences(own.learn(pieces), order, ends).joined()]
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*rows.schema.names, into])

    return kept.mapInArrow(run, schema)


def decode(rows: DataFrame, path: str, pattern: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """rows with a binary column decoded from an array of ids. A null or empty array gives no bytes; an id that the
    vocabulary doesn't have raises."""
    from pyspark.sql.types import BinaryType, StructField, StructType

    kept = modest_batches(rows).drop(into)
    schema = StructType([*kept.schema.fields, StructField(into, BinaryType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with codec(path, pattern) as own:
            for batch in batches:
                given = batch.column(ids).to_pylist()
                if bad := [i for one in given for i in one or () if i not in own.bytes_of]:
                    raise ValueError(f"ids outside the vocabulary: {bad[:5]}")
                back = own.decode([np.array(one or [], "<u4").tobytes() for one in given])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(back, pa.binary())], names=[*batch.schema.names, into])

    return kept.mapInArrow(run, schema)
