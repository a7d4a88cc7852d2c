"""N-gram Jaccard join by T-occurrence search (DivideSkip).

A document's set are its distinct 5-word shingles, as 52-bit hashes. Equal sets are one
class. Two classes link when 100 * intersection >= 75 * union. The work runs in four steps.

1. *Inverted lists.* Every class sends its shingles to shards (hash ranges of about
   ``SHARD`` shingles). A shard sorts them, so each shingle's list and its length are known.
   Shingles in one class only cannot be shared and are left behind; the others go back to
   their class with the logarithm of their list's length.
2. *Survivors.* A link needs an overlap of at least 3/4 of either set, so a class with fewer
   shared shingles has no partner. The rest order their shared shingles by list length.
3. *Blocks.* If two classes link, they share one of the |shared| - T + 1 shingles with the
   shortest lists (T: least overlap). Classes that share such a shingle, directly or over others, form a
   component; components are dealt to blocks of about ``BLOCK`` shingles. One that is larger is
   cut in blocks by hash, twice with other salts, which ties a large group of copies together; what
   still shares a short list across unlinked parts is then searched in all pairs of its blocks.
   So no link is lost and no task holds more than two blocks.
4. *Search.* In a block, each class in order of size queries the inverted index of the larger
   ones: its short lists are merged by a heap, counting occurrences; classes that reach T - L are
   probed in the L long lists by binary search, and stay at an overlap of T. Classes already
   in one component are skipped, as only components are asked for.

Hash collisions: shingles are told apart by 40 bits and their shard (by 52 bits from 4096
shards), classes by 64 bits and their size.

Cases: a null text or one without words has an empty set and links with nothing; fewer than
five words are one shingle; equal texts, repeated rows and equal sets share a component; ties in
size are ordered by class; a null doc_id takes part, but names no component (a component of such rows alone
has a null id); texts are read whole; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.llm.components import components
from tillcast.llm.shared import columns, fresh, ship, table, written
from tillcast.llm.textbuf import LOWER, Chunk, chunks, mix, windows

WORDS = 5
SHARD = 8_000_000
BLOCK = 1_000_000
#: A shard is worked on in so many ranges of hashes, which bounds the memory of its task.
RANGES = 8
#: Shingles of a bucket that are put in order at once.
PART = 1_000_000
#: Shingles of a task that are sent on at once, and texts of a chunk (12 bits beside 52 of a shingle).
FLUSH = 2_000_000
ROWS = 4096
BITS = np.uint64(52)
MASK = np.uint64((1 << 52) - 1)
#: The weight of a binary probe against a merge step in the choice of L.
MU = 0.0085

HEAD = np.dtype([("cls", "<i8"), ("n", "<u4"), ("count", "<u4")])


def shingle_sets(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Text number and 52-bit hash of every distinct shingle, ordered by both."""
    starts, ends = chunk.words
    hashes, doc = chunk.hasher(LOWER)(starts, ends), chunk.word_doc
    size = np.diff(chunk.word_bounds)
    found, owner = [], []
    for n in range(1, WORDS + 1):
        keys, at = windows(hashes, doc, n)
        if n < WORDS:  # a text of n words is one shingle
            short = size[doc[at]] == n
            keys, at = keys[short], at[short]
        found.append(keys)
        owner.append(doc[at])
    both = np.concatenate(owner).astype(np.uint64) << BITS | np.concatenate(found) & MASK
    both = np.sort(both)
    both = both[np.concatenate(([True], both[1:] != both[:-1]))] if len(both) else both
    return (both >> BITS).astype(np.int64), both & MASK


def classes(doc: np.ndarray, token: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text its set size and a 64-bit digest of the set (0 for an empty one)."""
    at = np.searchsorted(doc, np.arange(n + 1))
    size = np.diff(at)
    total = np.zeros(len(token) + 1, np.uint64)
    np.cumsum(mix(token + np.uint64(1)), out=total[1:])
    digest = mix((total[at[1:]] - total[at[:-1]]) ^ mix(size.astype(np.uint64)))
    return size, np.where(size > 0, digest, 0).astype(np.uint64).view(np.int64)


def class_column(text: pa.Array) -> pa.Array:
    n, cls = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for chunk in chunks(text, rows=ROWS):
        size, digest = classes(*shingle_sets(chunk), chunk.n)
        n.append(size)
        cls.append(digest)
    return pa.StructArray.from_arrays([pa.array(np.concatenate(n)), pa.array(np.concatenate(cls))], ["n", "cls"])


def _heads(cls: np.ndarray, n: np.ndarray, rows: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The head of a run-length coded list of classes (rows: per item the class's number, in runs)."""
    first = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
    head = np.zeros(len(first), HEAD)
    head["cls"], head["n"] = cls[rows[first]], n[rows[first]]
    head["count"] = np.diff(np.append(first, len(rows)))
    return head.tobytes(), first


def _batch(columns: dict) -> pa.RecordBatch:
    kinds = {"shard": pa.int64(), "bucket": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.binary())) for k, v in columns.items()], list(columns))


def _split40(token: np.ndarray) -> tuple[bytes, bytes]:
    return (token & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(), (token >> np.uint64(32)).astype(np.uint8).tobytes()


def to_shards(shards: int):
    """texts -> (shard, head, low, high): the shingles of each class by hash range."""
    def flush(cls, n, rows, token):
        cls, n, rows, token = (np.concatenate(x) for x in (cls, n, rows, token))
        shard = ((token >> np.uint64(20)) * np.uint64(shards) >> np.uint64(32)).astype(np.uint32)
        order = np.argsort(shard, kind="stable")
        shard, rows, token = shard[order], rows[order], token[order]
        at = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1])))
        out = {"shard": [], "head": [], "low": [], "high": []}
        for a, b in zip(at, np.append(at[1:], len(shard))):
            out["shard"].append(int(shard[a]))
            out["head"].append(_heads(cls, n, rows[a:b])[0])
            low, high = _split40(token[a:b] & np.uint64((1 << 40) - 1))
            out["low"].append(low)
            out["high"].append(high)
        return _batch(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, seen, known = ([], [], [], []), 0, 0
        before: set[int] = set()
        for batch in batches:
            for chunk in chunks(batch.column(0), rows=ROWS):
                doc, token = shingle_sets(chunk)
                size, cls = classes(doc, token, chunk.n)
                new = np.zeros(chunk.n, bool)
                for i in np.flatnonzero(size).tolist():
                    if (c := int(cls[i])) not in before:
                        before.add(c)
                        new[i] = True
                number = np.cumsum(new) - 1 + known
                mine = new[doc]
                for parts, x in zip(kept, (cls[new], size[new], number[doc[mine]], token[mine])):
                    parts.append(x)
                known += int(new.sum())
                seen += int(mine.sum())
                if seen >= FLUSH:
                    yield flush(*kept)
                    kept, seen, known = ([], [], [], []), 0, 0
                    before.clear()
        if seen:
            yield flush(*kept)
    return run


def _views(batches: Iterator[pa.RecordBatch], **kinds) -> list[tuple[np.ndarray, ...]]:
    """The binary columns of every row as arrays that share its memory."""
    return [tuple(np.frombuffer(batch.column(name)[r].as_buffer(), kind) for name, kind in kinds.items())
            for batch in batches for r in range(batch.num_rows)]


def _shared_in_range(rows: list[tuple[np.ndarray, ...]], k: int):
    """Class number, shingle and rank of every shared shingle in the k-th range of a shard; rows are the numbers
    and counts of a row's classes, and its shingles."""
    token, owner = [], []
    for number, count, low, high in rows:
        here = np.flatnonzero(high // (256 // RANGES) == k)
        token.append(low[here].astype(np.uint64) | high[here].astype(np.uint64) << np.uint64(32))
        owner.append(number[np.searchsorted(np.cumsum(count), here, side="right")])
    token, owner = np.concatenate(token), np.concatenate(owner)
    ordered = np.sort(token)
    again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(again):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint8)
    at = np.minimum(np.searchsorted(again, token), len(again) - 1)
    twice = again[at] == token
    pair = np.unique(owner[twice].astype(np.int64) * len(again) + at[twice])  # a class once in a list
    owner, at = pair // len(again), pair % len(again)
    length = np.bincount(at, minlength=len(again))
    rank = np.minimum(255, np.floor(8 * np.log2(np.maximum(length, 1)))).astype(np.uint8)
    stay = length[at] > 1
    return owner[stay], again[at[stay]], rank[at[stay]]


def shared_shingles(buckets: int):
    """One shard -> (bucket, shard, head, low, high, rank), range by range: shingles of two or more classes, by
    class; rank is 8 times the logarithm of the list's length, the same for all classes."""
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = key[0].as_py()
        rows = _views(batches, head=HEAD, low="<u4", high=np.uint8)
        ids, number = np.unique(np.concatenate([head["cls"] for head, _, _ in rows]), return_inverse=True)
        n = np.zeros(len(ids), np.uint32)
        n[number] = np.concatenate([head["n"] for head, _, _ in rows])
        at = np.cumsum([0] + [len(head) for head, _, _ in rows])
        rows = [(number[a:b].astype(np.int32), head["count"], low, high) for (head, low, high), a, b in zip(rows, at[:-1], at[1:])]
        home = (ids.view(np.uint64) % np.uint64(buckets)).astype(np.int64)
        for k in range(RANGES):
            owner, token, rank = _shared_in_range(rows, k)
            if not len(owner):
                continue
            order = np.argsort(home[owner] * len(ids) + owner, kind="stable")
            owner, token, rank = owner[order], token[order], rank[order]
            bucket = home[owner]
            first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            out = {c: [] for c in ("bucket", "shard", "head", "low", "high", "rank")}
            for a, b in zip(first, np.append(first[1:], len(bucket))):
                low, high = _split40(token[a:b])
                for c, x in zip(out, (int(bucket[a]), shard, _heads(ids, n, owner[a:b])[0], low, high, rank[a:b].tobytes())):
                    out[c].append(x)
            yield _batch(out)
    return run


def least_overlap(n: int) -> int:
    """The least intersection of a set of n with any linked set."""
    return -(-3 * n // 4)


def survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bucket -> (cls, n, tokens): classes with enough shared shingles, shortest lists first. The classes are
    put in order some at a time, about ``PART`` shingles."""
    rows, shards = [], []
    for batch in batches:
        rows += _views([batch], head=HEAD, low="<u4", high=np.uint8, rank=np.uint8)
        shards += batch.column("shard").to_pylist()
    heads = np.concatenate([r[0] for r in rows])
    ids, number = np.unique(heads["cls"], return_inverse=True)
    n, size = np.zeros(len(ids), np.int64), np.bincount(number, weights=heads["count"]).astype(np.int64)
    n[number] = heads["n"]
    enough = 4 * size >= 3 * n
    part = np.where(enough, np.cumsum(size) // PART, -1)
    at = np.cumsum([0] + [len(r[0]) for r in rows])
    for p in np.unique(part[enough]).tolist():
        owner, token, rank = [], [], []
        for (head, low, high, length), shard, a, b in zip(rows, shards, at[:-1], at[1:]):
            mine = part[number[a:b]] == p
            if not mine.any():
                continue
            here = np.repeat(mine, head["count"])
            owner.append(np.repeat(number[a:b][mine], head["count"][mine]))
            token.append(low[here].astype(np.uint64) | high[here].astype(np.uint64) << np.uint64(32) | np.uint64(shard) << np.uint64(40))
            rank.append(length[here])
        owner, token, rank = (np.concatenate(x) for x in (owner, token, rank))
        order = np.lexsort((token, rank, owner))
        owner, token = owner[order], token[order]
        first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        cls = owner[first]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[cls]), pa.array(n[cls].astype(np.int32)),
             pa.array([token[a:b].tobytes() for a, b in zip(first, np.append(first[1:], len(owner)))], pa.binary())], ["cls", "n", "tokens"])


def short_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cls, n, tokens) -> (token, cls) of the shingles of which a partner shares one."""
    for batch in batches:
        cls, token = [], []
        for c, n, raw in zip(*(batch.column(k).to_pylist() for k in range(3))):
            tokens = np.frombuffer(raw, np.int64)
            token.append(tokens[:len(tokens) - least_overlap(n) + 1])
            cls.append(np.full(len(token[-1]), c))
        if cls:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(token)), pa.array(np.concatenate(cls))],
                                             ["token", "cls"])


class Block:
    """Classes of a block in order of size, with their inverted index and their components."""

    def __init__(self, n: np.ndarray, tokens: list[np.ndarray]):
        self.n, self.rows = n, len(tokens)
        size = np.array([len(x) for x in tokens], np.int64)
        self.at = np.concatenate(([0], np.cumsum(size)))
        _, self.lists = np.unique(np.concatenate(tokens), return_inverse=True)
        row = np.repeat(np.arange(self.rows), size)
        self.keys = np.sort(self.lists * self.rows + row)  # the lists, one after the other
        self.entry = self.keys % self.rows
        self.start = np.searchsorted(self.keys, np.arange(self.lists.max() + 2) * self.rows)
        self.label = np.arange(self.rows)

    def tie(self, a: int, b: int) -> None:
        x, y = sorted((self.label[a], self.label[b]))
        self.label[self.label == y] = x

    def query(self, r: int) -> list[int]:
        """The linked rows after r that were in other components; ties them."""
        lists, n = self.lists[self.at[r]:self.at[r + 1]], int(self.n[r])
        t = -(-6 * n // 7)  # the least overlap with a set that is not smaller
        if len(lists) < t:
            return []
        length = self.start[lists + 1] - self.start[lists]
        lists = lists[np.argsort(length, kind="stable")]
        long = min(t - 1, int(t / (MU * math.log2(max(2, int(length.max()))) + 1)))
        short, long_lists = lists[:len(lists) - long], lists[len(lists) - long:]
        stop = int(np.searchsorted(self.n, 4 * n // 3, side="right"))
        runs = []
        for k in short.tolist():
            run = self.entry[self.start[k]:self.start[k + 1]]
            run = run[(run > r) & (run < stop)]
            run = run[self.label[run] != self.label[r]]
            if len(run):
                runs.append(run)
        if not runs:
            return []
        if len(runs) == 1:
            candidate, count = runs[0], np.ones(len(runs[0]), np.int64)
        else:
            merged = np.fromiter(heapq.merge(*(x.tolist() for x in runs)), np.int64)
            edge = np.flatnonzero(np.concatenate(([True], merged[1:] != merged[:-1])))
            candidate, count = merged[edge], np.diff(np.append(edge, len(merged)))
        enough = count >= t - long
        out = []
        for c, m in zip(candidate[enough].tolist(), count[enough].tolist()):
            if self.label[c] == self.label[r]:
                continue
            probe = long_lists * self.rows + c
            place = np.minimum(np.searchsorted(self.keys, probe), len(self.keys) - 1)
            overlap = m + int((self.keys[place] == probe).sum())
            if 100 * overlap >= 75 * (n + int(self.n[c]) - overlap):
                self.tie(r, c)
                out.append(c)
        return out


def search(rows: pa.Table) -> pa.Table:
    """One block (cls, n, tokens) -> links (a, b) that tie its components."""
    n, cls = rows.column("n").to_numpy(), rows.column("cls").to_numpy()
    order = np.lexsort((cls, n))
    tokens = rows.column("tokens").take(pa.array(order)).to_pylist()
    n, cls = n[order].astype(np.int64), cls[order]
    block = Block(n, [np.frombuffer(x, np.int64) for x in tokens])
    links = [(r, c) for r in range(block.rows) for c in block.query(r)]
    a, b = np.array(links, np.int64).reshape(-1, 2).T
    return pa.table([pa.array(cls[a]), pa.array(cls[b])], names=["a", "b"])


def _mixed(lists: DataFrame) -> DataFrame:
    """(token, cls, part) -> the classes of shared tokens whose classes are not all of one part."""
    wide = lists.groupBy("token").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x <> y")
    return lists.join(wide.select("token"), "token", "left_semi").select("cls").distinct()


def class_links(sets: DataFrame) -> DataFrame:
    """Links (a, b) that tie the components of (cls, n, tokens)."""
    lists = sets.mapInArrow(short_lists, "token long, cls long")
    hubs = lists.groupBy("token").agg(F.min("cls").alias("hub"), F.count("*").alias("m")).where("m > 1")
    near = components(lists.join(hubs, "token").where("cls <> hub").select(F.col("cls").alias("a"), F.col("hub").alias("b")))
    group = near.union(near.select(F.col("root").alias("node"), "root").distinct())
    members = written(sets.join(group.withColumnRenamed("node", "cls"), "cls")
                      .select("cls", "n", "tokens", "root", F.expr("length(tokens) div 8").alias("m")))
    size = written(members.groupBy("root").agg(F.sum("m").alias("total"))
                   .select("root", "total", F.ceil(F.col("total") / BLOCK).alias("blocks")))
    total = size.agg(F.sum("total"), F.max("blocks")).first()
    bins = -(-(total[0] or 0) // BLOCK) or 1

    def searched(blocked: DataFrame) -> DataFrame:
        return blocked.groupBy("block").applyInArrow(search, "a long, b long")

    dealt = members.join(size.drop("total"), "root")
    whole = dealt.where("blocks = 1").withColumn("block", F.struct(F.pmod(F.xxhash64("root"), F.lit(bins)), F.lit(-1), F.lit(0)))
    keep = ["cls", "n", "tokens", "block"]
    links = searched(whole.select(*keep))
    if (total[1] or 1) == 1:
        return links
    large = dealt.where("blocks > 1")
    for salt in (1, 2):
        block = F.struct(F.col("root"), F.pmod(F.xxhash64("cls", F.lit(salt)), F.col("blocks")).cast("int"), F.lit(salt))
        links = links.union(searched(large.withColumn("block", block).select(*keep)))
    links = written(links)
    part = components(links)
    labelled = (lists.join(large.select("cls"), "cls", "left_semi")
                .join(part.select(F.col("node").alias("cls"), "root"), "cls", "left")
                .select("token", "cls", F.coalesce("root", "cls").alias("part")))
    rest = large.join(_mixed(labelled), "cls", "left_semi")
    own = F.pmod(F.xxhash64("cls", F.lit(3)), F.col("blocks")).cast("int")
    pairs = rest.withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0, int(blocks) - 1)")))
    block = F.struct(F.col("root"), F.least("own", "other"), F.greatest("own", "other"))
    return links.union(searched(pairs.withColumn("block", block).select(*keep)))


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: doc_id, version (hash of the text), n_shingles, component_id, and group, which
    is the same for all rows of a component (null for empty sets)."""
    ship(docs.sparkSession)
    c = F.arrow_udf(class_column, "struct<n:bigint,cls:bigint>")
    own = written(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("version"),
                              c(F.col(text)).alias("c")).select("doc_id", "version", "c.n", "c.cls"))
    shards = max(1, -(-(own.agg(F.sum("n")).first()[0] or 0) // SHARD))
    spread = docs.select(text).mapInArrow(to_shards(shards), "shard long, head binary, low binary, high binary")
    back = spread.groupBy("shard").applyInArrow(
        shared_shingles(shards), "bucket long, shard long, head binary, low binary, high binary, rank binary")
    sets = written(back.groupBy("bucket").applyInArrow(survivors, "cls long, n int, tokens binary"))
    root = components(class_links(sets)).withColumnRenamed("node", "cls")
    least = own.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("least")).join(root, "cls", "left").withColumn(
        "group", F.coalesce("root", "cls"))
    whole = least.groupBy("group").agg(F.min("least").alias("component_id"))
    # A table, so that both sides of the join by class are exchanges and a hot class can be split.
    of_class = written(least.join(whole, "group").select("cls", "group", "component_id"))
    return own.join(of_class, "cls", "left").select(
        "doc_id", "version", F.col("n").alias("n_shingles"), "group",
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without near copies: of each component the row with the least doc_id (then
    version; a null id comes last) stays, once; documents without words all stay."""
    found = written(join(docs, doc_id, text).where("group is not null"))
    rows = found.groupBy("group", "doc_id", "version").agg(F.count("*").alias("m"))
    first = rows.groupBy("group").agg(F.min(F.struct(
        F.col("doc_id").isNull(), "doc_id", "version", "m")).alias("first"))
    i, v, m = fresh(docs, "kept_id", "kept_version", "kept_rows")
    kept = written(first.select(F.col("first.doc_id").alias(i), F.col("first.version").alias(v), F.col("first.m").alias(m)))

    def among(keys: DataFrame, how: str) -> DataFrame:
        same = docs[doc_id].cast("long").eqNullSafe(keys[i]) & (F.xxhash64(docs[text]) == keys[v])
        return docs.join(keys, same, how)

    wordless = ~F.coalesce(F.col(text).rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    once = among(kept.where(F.col(m) == 1).drop(m).withColumn(m, F.lit(True)), "left").where(
        F.col(m).isNotNull() | wordless).select(*columns(docs))
    repeated = among(kept.where(F.col(m) > 1), "left_semi").dropDuplicates([doc_id, text])
    return once.unionByName(repeated)


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
