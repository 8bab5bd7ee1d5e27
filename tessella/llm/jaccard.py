"""Jaccard join of word-shingle sets by token-combination prefixes.

Tokens are 64-bit hashes of shingles; equal sets are one class, and classes, not documents, are joined.

1. Sieve. At most floor((1-t) n) of a set's n tokens are missing in a similar one. A class lists its first tokens in
   hash order, by l more than that, where l is an eighth of n and 1. The first l tokens that two similar sets share are
   listed by both, with the lesser of their two l. So a class leaves, as it has no partner, unless as many listed
   tokens as the l of the least set that can be similar to it are listed by other classes too.
2. Order. Of the classes left, all tokens are counted. A token that one class alone has is dead: it is missing in every
   partner. Tokens are ordered by rising count, so dead and rare ones come first.
3. Extended prefixes. A rare token is a key of its own; of frequent ones, each pair inside a token class is (a hash of
   the token, about four tokens of a set in each class). A token class with m tokens in the prefix can lose m - 1 of
   them before no pair is left, so the prefix goes on until dead tokens, rare tokens and the (m - 1) of all token
   classes exceed the number of tokens that can be missing. As token classes depend on the size, a set is indexed at
   its own size level (a power of two) and, if a similar one can reach it, the next. Of two similar sets the smaller
   lacks at most floor((1-t)/(1+t) n) tokens; keys up to that number are marked, and a pair needs the mark of its
   smaller set.
4. Pairing. Inside a key, members are checked against one of them, by turns of a changing choice (first the one with
   the least share of dead tokens), and components are formed, until a turn merges few. Members still in different
   components are then paired, if sizes, dead tokens and the difference of two 512-bit parity maps (each differing bit
   is a differing token) leave similarity possible. All filters are exact bounds: none loses a pair.
5. Verification on the whole sets. Dead tokens count by number only.

Links found this way have the same components as all links; links(every=True) leaves the turns out and gives all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm import textbytes as tb
from tessella.llm.common import drop_staged, guarded_join, modest_batches, staged
from tessella.llm.components import components

WORDS = 5
#: Similarity in hundredths.
PERCENT = 75
#: Tokens of more classes are frequent.
FREQUENT = 3
#: A set lists one token, and one for every LISTED of its own, beyond those that can be missing.
LISTED = 8
#: log2 of the most bits of the Bloom filter (16 MB) that carries shared tokens to the listed ones, at 16 bits a token;
#: beyond that they are joined. A token that the filter takes for shared by mistake costs work, never a result.
FILTER_BITS = 27
#: Turns end when one merges less than a share of 1 / FEW of the classes that still meet others.
FEW = 50
_MAP = 8  # longs of a parity map


def shingles(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, ascending, and how many each has."""
    h, counts = tb.words(texts)
    ends = np.cumsum(counts)
    owner = np.repeat(np.arange(len(counts)), counts)
    odd = tb.mix(np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
    m = max(0, len(h) - words + 1)
    acc = np.zeros(m, np.uint64)
    for j in range(words):
        acc += h[j : j + m] * odd[j]
    inside = owner[:m] == owner[words - 1 : words - 1 + m] if m else np.zeros(0, bool)
    found, owners = [tb.mix(acc[inside])], [owner[:m][inside]]
    for c in range(1, words):  # the whole of a short text is one shingle
        short = np.flatnonzero(counts == c)
        one = np.full(len(short), c, np.uint64)
        for j in range(c):
            one += h[ends[short] - c + j] * odd[j]
        found.append(tb.mix(one))
        owners.append(short)
    f, o = np.concatenate(found), np.concatenate(owners)
    order = np.argsort(o, kind="stable")
    d, n, _ = tb.distinct(f[order], np.bincount(o, minlength=len(texts)))
    return d, n


def _place(n: np.ndarray) -> np.ndarray:
    """Number of each token inside its set."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _set_ids(tokens: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set; 0 and 0 for the empty one."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tb.mix(tokens))])
    other = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tb.mix(tokens ^ np.uint64(0xA5A5A5A5A5A5A5A5)))])
    ends = np.cumsum(n)
    a, b = (tb.mix(t[ends] - t[ends - n]) for t in (total, other))
    return np.where(n > 0, a, 0).astype(np.uint64), np.where(n > 0, b, 0).astype(np.uint64)


def _lists(values: np.ndarray, n: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(values.view(np.int64)))


def missing(n, percent: int = PERCENT):
    """How many of n tokens a similar set can lack, whatever its size."""
    return n - -(-percent * n // 100)


def missing_in_larger(n, percent: int = PERCENT):
    """How many of n tokens a similar set of n tokens or more can lack."""
    return n - -(-2 * percent * n // (100 + percent))


def needed(n, percent: int = PERCENT):
    """How many listed tokens of a set of n tokens other classes list if it has a partner."""
    return 1 + (n - missing(n, percent)) // LISTED


def combinations(tokens: np.ndarray, counts: np.ndarray, n: int, percent: int = PERCENT, frequent_over: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Keys of one set and whether each is marked, from its live tokens in the common order, how many classes have each
    and the size with dead tokens."""
    dead = n - len(tokens)
    most, marked = missing(n, percent) + 1 - dead, missing_in_larger(n, percent) + 1 - dead
    rare = tokens[counts <= frequent_over][: max(0, most)]
    keys, marks = [tb.mix(rare)], [np.arange(len(rare)) < marked]
    often = tokens[counts > frequent_over]
    if len(rare) < most and len(often):
        level = n.bit_length() - 1
        for at in (level, level + 1) if 100 * n >= percent << (level + 1) else (level,):
            salt = tb.mix(np.array([at], np.uint64))[0]
            group = tb.mix(often + salt) % np.uint64(max(1, (1 << at) // 4))
            order = np.lexsort((often, group))
            own, group = often[order], group[order]
            begins = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            used = len(rare)
            for begin, end in zip(begins, [*begins[1:], len(own)], strict=True):
                end = min(end, begin + 1 + most - used)  # the last token class is cut where enough is reached
                a, b = np.triu_indices(end - begin, 1)
                keys.append(tb.mix(tb.mix(own[begin + a] + salt) * np.uint64(3) + own[begin + b]))
                marks.append(used + b - 1 < marked)  # a pair is complete at its later token
                used += end - begin - 1
                if used >= most:
                    break
    return np.concatenate(keys), np.concatenate(marks)


def _signatures(docs: DataFrame, doc_id: str, text: str, words: int, percent: int) -> DataFrame:
    """Per row: doc_id, cid (its set), k2 (another hash of it), n and the listed tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in tb.slices(batches):
            tokens, n = shingles(texts, words)
            a, b = _set_ids(tokens, n)
            listed = np.minimum(n, missing(n, percent) + 1 + n // LISTED)
            prefix = tokens[_place(n) < np.repeat(listed, n)]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(n.astype(np.int64)), _lists(prefix, listed)], names=["doc_id", "cid", "k2", "n", "listed"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, cid long, k2 long, n long, listed array<long>")


def _marks(tokens: np.ndarray, width: int) -> list[np.ndarray]:
    """Places of each token in a filter of 2**width bits: the top bits of three hashes."""
    return [(tb.mix(tokens + np.uint64(k)) >> np.uint64(64 - width)).astype(np.int64) for k in (101, 202, 303)]


def _filter(tokens: DataFrame, width: int) -> np.ndarray:
    """A Bloom filter of a column of tokens, of 2**width bits, as 64-bit words; its bits are joined by Spark."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.concatenate(_marks(batch.column(0).to_numpy().view(np.uint64), width))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.left_shift(np.int64(1), at & 63))], names=["w", "b"])

    words = tokens.mapInArrow(places, "w long, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (width - 6), np.int64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return out


def _in(bits: np.ndarray, width: int, tokens: np.ndarray) -> np.ndarray:
    """Which tokens a filter has, or seems to have."""
    found = np.ones(len(tokens), bool)
    for at in _marks(tokens, width):
        found &= (bits[at >> 6] >> (at & 63)) & 1 == 1
    return found


def _sieved(rows: DataFrame, percent: int, most_bits: int) -> DataFrame:
    """cid of the classes that may have a partner, by the listed tokens that other classes list too."""
    listed = rows.filter("n > 0").select(F.explode("listed").alias("key"), "cid")
    shared = staged(listed.groupBy("key").agg(F.min("cid").alias("c0"), F.max("cid").alias("c1")).filter("c0 <> c1").select("key"))
    width = max(10, (16 * shared.count()).bit_length())
    if width <= most_bits:
        bits = rows.sparkSession.sparkContext.broadcast(_filter(shared, width))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists, n = batch.column("listed"), batch.column("n").to_numpy()
                many = lists.value_lengths().to_numpy()
                known = _in(bits.value, width, lists.flatten().to_numpy().view(np.uint64))
                upto = np.concatenate([[0], np.cumsum(known)])
                ends = np.cumsum(many)
                yield batch.select(["cid"]).filter(pa.array(upto[ends] - upto[ends - many] >= needed(n, percent)))

        found = staged(rows.filter("n > 0").select("cid", "n", "listed").mapInArrow(run, "cid long").distinct())
        bits.unpersist()
    else:
        hits = listed.join(shared.hint("merge"), "key", "left_semi").groupBy("cid").agg(F.count("*").alias("hits"))
        needs = F.expr(f"1 + (({percent} * n + 99) div 100) div {LISTED}")
        sizes = rows.filter("n > 0").groupBy("cid").agg(F.sum(needs).alias("needs"))  # over all copies, as hits are
        found = staged(hits.join(sizes.hint("merge"), "cid").filter("hits >= needs").select("cid"))
    drop_staged(shared)
    return found


def _sets(docs: DataFrame, doc_id: str, text: str, cids: DataFrame, words: int) -> DataFrame:
    """(cid, n, tokens): the sets of some classes (cid, k2, rep), read from the documents named by rep. A repeated id
    brings other texts too, which the join with the classes drops."""
    wanted = docs.select(F.col(doc_id).alias("rep"), F.col(text).alias("text"))
    own = guarded_join(wanted.filter("rep is not null"), staged(cids.filter("rep is not null").select("rep").distinct()), "rep", row_bytes=24).select("text")
    if cids.filter("rep is null").limit(1).count():
        own = own.union(wanted.filter("rep is null").select("text"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in tb.slices(batches):
            tokens, n = shingles(texts, words)
            a, b = (pa.array(h.view(np.int64)) for h in _set_ids(tokens, n))
            yield pa.RecordBatch.from_arrays([a, b, pa.array(n.astype(np.int64)), _lists(tokens, n)], names=["set", "k2", "n", "tokens"]).filter(pa.array(n > 0))

    found = own.mapInArrow(whole, "set long, k2 long, n long, tokens array<long>")
    known = staged(cids.select("cid", "set", "k2"))
    sets = staged(guarded_join(found, known, ["set", "k2"], row_bytes=40).select("cid", "n", "tokens"))
    if sets.count() > known.count():  # texts that repeat with their ids
        sets = staged(sets.dropDuplicates(["cid"]))
    return sets


def _ordered(sets: DataFrame, percent: int) -> DataFrame:
    """(cid, n, live): per class its live tokens and how many classes have each; classes with too few of them leave."""
    tokens = sets.select(F.explode("tokens").alias("key"), "cid", "n")
    counts = tokens.groupBy("key").agg(F.count("*").alias("many")).filter("many > 1")
    live = tokens.join(counts.hint("merge"), "key").groupBy("cid", "n").agg(F.collect_list(F.struct("many", "key")).alias("live"))
    return staged(live.filter(F.size("live") * 100 >= percent * F.col("n")))


def _traits(lists: DataFrame) -> DataFrame:
    """(cid, n, dead, m0..): size, number of dead tokens and the parity map of the live ones."""
    names = [f"m{i}" for i in range(_MAP)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("keys")
            many = keys.value_lengths().to_numpy()
            bit = (tb.mix(keys.flatten().to_numpy().view(np.uint64) + np.uint64(7)) >> np.uint64(64 - 9)).astype(np.int64)
            odd = np.bincount(np.repeat(np.arange(len(many)), many) * (64 * _MAP) + bit, minlength=len(many) * 64 * _MAP) & 1
            maps = np.packbits(odd.astype(bool).reshape(len(many), 64 * _MAP), axis=1).view(np.int64)
            dead = batch.column("n").to_numpy() - many
            yield pa.RecordBatch.from_arrays([batch.column("cid"), batch.column("n"), pa.array(dead), *[pa.array(np.ascontiguousarray(maps[:, i])) for i in range(_MAP)]], names=["cid", "n", "dead", *names])

    kind = "cid long, n long, dead long, " + ", ".join(f"{m} long" for m in names)
    return staged(lists.select("cid", "n", F.col("live.key").alias("keys")).mapInArrow(run, kind))


def _index(lists: DataFrame, percent: int, frequent_over: int) -> DataFrame:
    """(key, cid, mark) of all classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, counts = (batch.column(c).flatten().to_numpy() for c in ("keys", "counts"))
            many, sizes = batch.column("keys").value_lengths().to_numpy(), batch.column("n").to_pylist()
            ends = np.cumsum(many)
            cids = batch.column("cid").to_numpy()
            for i, (begin, end) in enumerate(zip((ends - many).tolist(), ends.tolist(), strict=True)):
                t, c = keys[begin:end].view(np.uint64), counts[begin:end]
                order = np.lexsort((t, c))
                found, marks = combinations(t[order], c[order], sizes[i], percent, frequent_over)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(np.full(len(found), cids[i])), pa.array(marks)], names=["key", "cid", "mark"])

    return lists.select("cid", "n", F.col("live.key").alias("keys"), F.col("live.many").alias("counts")).mapInArrow(run, "key long, cid long, mark boolean")


def _possible(percent: int) -> Column:
    """Whether two classes, with traits of suffixes _a and _b, may be similar: an upper bound of what they share."""
    n = F.col("n_a") + F.col("n_b")
    apart = F.col("dead_a") + F.col("dead_b")
    for i in range(_MAP):
        apart = apart + F.bit_count(F.col(f"m{i}_a").bitwiseXOR(F.col(f"m{i}_b")))
    live = F.least(F.col("n_a") - F.col("dead_a"), F.col("n_b") - F.col("dead_b"))
    # with s shared tokens of n in all, similarity is s / (n - s); twice s is n without those apart
    return ((100 + percent) * (n - apart) >= 2 * percent * n) & ((100 + percent) * live >= percent * n)


def _suffixed(traits: DataFrame, suffix: str, cid: str) -> DataFrame:
    return traits.select([F.col(c).alias(cid if c == "cid" else c + suffix) for c in traits.columns])


def _verified(pairs: DataFrame, lists: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose sets are similar."""
    sets = lists.select("cid", "n", F.col("live.key").alias("f"))
    left = pairs.join(sets.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("f").alias("fa")).hint("merge"), "a")
    both = left.join(sets.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("f").alias("fb")).hint("merge"), "b").select("a", "b", "na", "nb", "fa", "fb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
            common = [len(np.intersect1d(np.asarray(x.values), np.asarray(y.values), assume_unique=True)) for x, y in zip(batch.column("fa"), batch.column("fb"), strict=True)]
            common = np.array(common, np.int64)
            yield batch.select(["a", "b"]).filter(pa.array(100 * common >= percent * (n - common)))

    return both.mapInArrow(run, "a long, b long")


def _unsettled(index: DataFrame, known: DataFrame) -> tuple[DataFrame, int]:
    """Entries (key, cid, mark, root) of keys whose members are in different components, and how many classes have any."""
    rooted = index.select("key", "cid", "mark").join(known.select("cid", "root").hint("merge"), "cid")
    keys = rooted.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.max("mark").alias("some")).filter("r0 <> r1 and some").select("key")
    left = staged(guarded_join(rooted, staged(keys), "key", row_bytes=16))
    return left, left.select("cid").distinct().count()


def _turn(entries: DataFrame, known: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs (a, b) of each member with one of its key: in the first turn the one with the least share of dead tokens,
    later such a one of a component taken by its hash."""
    first = F.lit(0) if turn == 0 else F.xxhash64("root", F.lit(turn))
    rooted = entries.join(known.select("cid", (F.col("dead") / F.col("n")).alias("part")).hint("merge"), "cid")
    chosen = rooted.groupBy("key").agg(F.min(F.struct(first.alias("o"), "part", F.xxhash64("cid", F.lit(turn)).alias("h"), "cid", "root")).alias("c"))
    pairs = rooted.join(chosen.select("key", F.col("c.cid").alias("c"), F.col("c.root").alias("r")).hint("merge"), "key").filter("root <> r")
    pairs = pairs.select(F.least("cid", "c").alias("a"), F.greatest("cid", "c").alias("b")).distinct()
    traits = known.drop("root")
    both = pairs.join(_suffixed(traits, "_a", "a").hint("merge"), "a").join(_suffixed(traits, "_b", "b").hint("merge"), "b")
    return both.filter(_possible(percent)).select("a", "b")


def _rest(entries: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) of a key's members in different components that may be similar."""
    traits = known.drop("root")
    one, two = (entries.join(traits.hint("merge"), "cid") for _ in range(2))
    one, two = _suffixed(one, "_a", "a").withColumnRenamed("key_a", "key"), _suffixed(two, "_b", "b").withColumnRenamed("key_b", "key")
    smaller = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b")))
    marked = F.col("mark_a") | ((F.col("n_a") == F.col("n_b")) & F.col("mark_b"))
    pairs = one.join(two.hint("merge"), (one["key"] == two["key"]) & (F.col("root_a") != F.col("root_b")) & smaller & marked & _possible(percent))
    return pairs.select("a", "b").distinct()


def _untangled(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows with cid (from set) made different for different sets of one 64-bit hash, and the classes
    (cid, set, k2, rep). Such sets are told apart by their second hash, which becomes the id of all but one."""
    classes = staged(rows.filter("n > 0").groupBy("set", "k2").agg(F.min("doc_id").alias("rep")))
    twice = staged(classes.groupBy("set").agg(F.min("k2").alias("k0"), F.count("*").alias("many")).filter("many > 1").select("set", "k0"))
    if not twice.limit(1).count():
        return rows.withColumn("cid", F.col("set")), classes.withColumn("cid", F.col("set"))
    cid = F.when(F.col("k0").isNull() | (F.col("k0") == F.col("k2")), F.col("set")).otherwise(F.col("k2")).alias("cid")
    return tuple(guarded_join(t, twice, "set", "left", row_bytes=24).select(*t.columns, cid) for t in (rows, classes))


def links(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT,
    frequent_over: int = FREQUENT, filter_bits: int = FILTER_BITS, every: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, cid, n) and links (a, b) between classes whose components are those of all links; with every, all
    links. percent is at least 60: below, two-token combinations can miss pairs."""
    if percent < 60:
        raise ValueError("percent must be 60 or more")
    modest_batches(docs)
    signed = staged(_signatures(docs, doc_id, text, words, percent).withColumnRenamed("cid", "set"))
    rows, classes = _untangled(signed)
    sieved = _sieved(rows, percent, filter_bits)
    plain = staged(rows.select("doc_id", "cid", "n"))
    cids = staged(classes.join(sieved.hint("merge"), "cid"))
    drop_staged(signed)
    sets = _sets(docs, doc_id, text, cids, words)
    lists = _ordered(sets, percent)
    drop_staged(sets)
    traits = _traits(lists)
    index = staged(_index(lists, percent, frequent_over))
    found = docs.sparkSession.createDataFrame([], "a long, b long")
    known, merged, total, turn = traits.withColumn("root", F.col("cid")), 0, 0, 0
    while True:
        last, (index, meet) = index, _unsettled(index, known)
        drop_staged(last)
        if not meet:
            break
        final = every or (turn > 0 and FEW * merged < meet)
        pairs = staged(_rest(index, known, percent) if final else _turn(index, known, turn, percent))
        new = staged(_verified(pairs, lists, percent))
        drop_staged(pairs)
        found, before = staged(found.union(new).distinct()), found
        drop_staged(before)
        if final:
            break
        member = components(found)
        inner = member.filter("id <> root").count()
        merged, total, turn = inner - total, inner, turn + 1
        known = traits.join(member.withColumnRenamed("id", "cid").hint("merge"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    return plain, found


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT,
    frequent_over: int = FREQUENT, filter_bits: int = FILTER_BITS, count_links: bool = False,
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, cid; with count_links also n_links, the number of other
    rows linked directly.

    Words are [^\\x20\\x09-\\x0D]+ with A-Z in lower case. A text of fewer than words words is one shingle; one without
    words (or null) has none, is linked with nothing and is its own component. component_id is the least id of the
    component, whatever ids repeat; it is null where no row of the component has one. cid is equal for equal sets. An
    empty table gives no rows. Of docs, only doc_id and text are read, so further columns, whatever their names, change
    nothing. A very long text is hashed in parts, but its tokens (8 bytes a word) are held at once.
    """
    rows, found = links(docs, doc_id, text, words, percent, frequent_over, filter_bits, every=count_links)
    member = components(found)
    owned = rows.filter("n > 0").join(member.withColumnRenamed("id", "cid").hint("merge"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    if count_links:
        copies = staged(rows.filter("n > 0").groupBy("cid").agg(F.count("*").alias("copies")))
        both = found.union(found.select("b", "a")).withColumnRenamed("b", "cid")
        partners = both.join(copies.hint("merge"), "cid").groupBy(F.col("a").alias("cid")).agg(F.sum("copies").alias("others"))
        many = copies.join(partners.hint("merge"), "cid", "left").select("cid", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
        owned = owned.join(many.hint("merge"), "cid")
    owned = staged(owned)
    least = owned.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    more = ["n_links"] if count_links else []
    linked = owned.join(least.hint("merge"), "root").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "cid", *more)
    alone = rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "cid", *[F.lit(0).cast("long").alias(c) for c in more])
    return linked.union(alone)


#: The same by SQL, comparing all texts that share a shingle, which DuckDB affords on small tables.
ORACLE = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
sets AS MATERIALIZED (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                               ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM worded
),
tokens AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
),
reach(id, other) AS (SELECT doc_id, doc_id FROM sets UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other),
least AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id FROM sets JOIN least ON id = doc_id
"""
