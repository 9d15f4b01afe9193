"""Near-duplicates of a similarity: SimHash proposes, exact sets decide, heads find the rest.

Texts are sets of word shingles.  SimHash fingerprints of the sets go through the
pigeonhole tables of ``simhash``; what is within a few bits is proposed and decided by the
exact Jaccard similarity of the two sets.  Fingerprints miss pairs, the more so the lower
the similarity, so a second search misses none: in one order of all shingles, two sets of
similarity ``t`` share one of their first ``n - ceil(t n) + 1`` shingles (``n``: a set's
own size), so only these heads are joined.  Any order will do; rare shingles first keeps few
pairs.  Before sets are compared there is a sieve that loses nothing: parities of the
hashes differ in no more bits than the sets in elements.

Only distinct sets are compared, so copies cost nothing.  Each key of the heads first
proposes the pairs with its most central set, the one most of whose first shingles others
have too; then those that are not yet in one component and pass the sieve, which is applied
where the sets of a key meet: a large group of near copies does not cost a row for each
pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, ready, row_slices, span_hashes, string_buffers, trim, whole_number, window_hashes, word_bounds
from .components import ONE_TASK, components, spread_join
from .simhash import hamming_links, majority

#: Sets of one key that one task compares; more are dealt out in chunks.
CHUNK = 2048
#: Texts from which frequent shingles are learnt, and their number: they order, nothing else.
ORDER_TEXTS, ORDER_SHINGLES = 5_000, 1 << 17
#: Sets to be compared whose ids are sent to all executors; of more, the texts are shuffled.
BROADCAST = 1 << 19
#: Pairs gathered before they are handed on.
_PAIRS = 1 << 18
_EPS = 1e-9
#: Bits of the parity that rows of a key carry; the full one has four or more an element.
_BITS = 512

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def shingle_sets(texts: pa.Array, size: int):
    """The sorted set of shingle hashes of each text: runs of ``size`` words, A-Z lower-cased.

    Fewer words than ``size`` are one shingle; a null or wordless text has none.
    """
    raw, offsets = string_buffers(texts)
    for i, j in row_slices(offsets):
        low = _LOWER[raw[offsets[i] : offsets[j]]]
        starts, ends, first = word_bounds(low, offsets[i : j + 1] - offsets[i])
        words = span_hashes(low, starts, ends)
        shingles = window_hashes(words, size)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            yield np.unique(shingles[a : b - size + 1] if b - a >= size else window_hashes(words[a:b], b - a))


def least_overlap(similarity: float, n: np.ndarray | int) -> np.ndarray:
    """Shingles that a set of ``n`` shares at least with one of the similarity."""
    return np.ceil(similarity * n - _EPS).astype(np.int64)


def _frequent(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, texts that hold it) of the most frequent shingles of some texts, by hash."""
    share = max(1, docs.count() // ORDER_TEXTS)
    some = docs.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(share)) == 0).dropDuplicates()

    def run(batches):
        for batch in batches:
            sets = [*shingle_sets(batch.column("text"), size), np.zeros(0, np.uint64)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], names=["h"])
        trim()

    rows = ready(some).mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).filter("n > 2")
    got = rows.orderBy(F.desc("n"), "h").limit(ORDER_SHINGLES).toArrow()
    h, n = np.asarray(got.column("h")).view(np.uint64), np.asarray(got.column("n"))
    order = np.argsort(h)
    return h[order], n[order]


def parity(s: np.ndarray) -> bytes:
    """A bit for each residue of the hashes: whether an odd number of them falls there."""
    width = max(_BITS, 1 << max(4 * len(s) - 1, 0).bit_length())
    odd = np.bincount((s & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(bits: bytes, size: int) -> np.ndarray:
    """A parity of fewer bits (``size`` bytes): widths are powers of two, so halves add up."""
    x = np.frombuffer(bits, np.uint64)
    while 8 * len(x) > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def may_be_similar(x: np.ndarray, y: np.ndarray, sizes: np.ndarray, similarity: float) -> np.ndarray:
    """False where two parities differ in more bits than similar sets in elements.

    ``x``, ``y``: rows of parities as 64-bit words; ``sizes``: the two sets' elements together.
    """
    apart = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
    return apart <= (1 - similarity) / (1 + similarity) * sizes + _EPS


def _digests(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, text_sha256, digest, sid, n, bits, few, fp): each text's set.

    Its digest, the digest's first eight bytes, size, parity, parity of fewer bits, and
    SimHash fingerprint.
    """

    def run(batches):
        for batch in batches:
            sets = [(xxhash.xxh3_128_digest(s.tobytes()), len(s), parity(s), majority(s.astype(">u8"))) for s in shingle_sets(batch.column("text"), size)]
            sid = np.frombuffer(b"".join(s[0] for s in sets), np.int64)[::2]
            digest, n, bits = (pa.array([s[i] for s in sets], kind) for i, kind in enumerate((pa.binary(), pa.int32(), pa.binary())))
            few = pa.array([folded(s[2], _BITS // 8).tobytes() for s in sets], pa.binary())
            fp = pa.array(np.array([s[3] for s in sets], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_sha256"), digest, pa.array(sid), n, bits, few, fp], names=["doc_id", "text_sha256", "digest", "sid", "n", "bits", "few", "fp"])
        trim()

    return ready(docs).mapInArrow(run, "doc_id long, text_sha256 string, digest binary, sid long, n int, bits binary, few binary, fp long")


def _heads(docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """(key, sid, n, pos, share): a row for each of a set's first shingles, its size and the place.

    ``share``: how many of 1000 of its first shingles were met among the texts that order them.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_frequent(docs, size))

    def run(batches):
        known, often = shared.value
        for batch in batches:
            sid, n, share, head = [], [], [], [np.zeros(0, np.uint64)]
            for s in shingle_sets(batch.column("text"), size):
                if not len(s):
                    continue
                seen = np.zeros(len(s), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    seen = np.where(known[at] == s, often[at], 0)
                sid.append(int.from_bytes(xxhash.xxh3_128_digest(s.tobytes())[:8], "little", signed=True))
                n.append(len(s))
                first = np.argsort(seen, kind="stable")[: len(s) - int(least_overlap(similarity, len(s))) + 1]
                head.append(s[first])
                share.append(1000 * int((seen[first] > 0).sum()) // len(first))
            many = np.array([len(h) for h in head[1:]], np.int64)
            key = np.concatenate(head).view(np.int64)
            pos = np.arange(len(key)) - np.repeat(np.cumsum(many) - many, many)
            cols = [key, np.repeat(np.array(sid, np.int64), many), np.repeat(np.array(n, np.int32), many), pos.astype(np.int32), np.repeat(np.array(share, np.int32), many)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "sid", "n", "pos", "share"])
        trim()

    return ready(docs.select("text")).mapInArrow(run, "key long, sid long, n int, pos int, share int")


def _words(col: pa.Array) -> np.ndarray:
    """Parities as rows of 64-bit words."""
    return np.frombuffer(b"".join(col.to_pylist()), np.uint64).reshape(len(col), _BITS // 64)


def _apart(held: DataFrame, similarity: float, chunk: int) -> DataFrame:
    """Pairs (a, b) of sets of a key in different components that sizes, places and parities allow.

    ``held`` has (key, sid, n, pos, met, c, bits): sets that hold the key, their component
    and parity.
    """
    cut = F.pmod(F.xxhash64(F.lit("chunk"), "sid"), F.col("s")).cast("int")
    rows = held.withColumn("s", F.ceil(F.col("met") / chunk).cast("int")).withColumn("part", F.when(F.col("s") > 1, cut).otherwise(0))
    # a hot key's rows go to every pair of chunks that holds theirs
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
    rows = rows.select(F.xxhash64("key", F.least("part", "o"), F.greatest("part", "o")).alias("key"), "n", "sid", "pos", "c", "part", (F.col("part") != F.col("o")).alias("cross"), "bits")
    dealt = rows.repartition("key").sortWithinPartitions("key", "n")
    names = ["key", "n", "sid", "pos", "c", "part"]

    def pairs(key, n, sid, pos, c, part, cross, bits):
        # a key of two chunks is told by any row of another chunk
        i, step, out, size = np.arange(len(key)), 0, [], 0
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        mixed = np.repeat(np.logical_or.reduceat(cross, edge), np.diff(np.append(edge, len(key))))
        while len(i):
            step += 1
            i = i[i + step < len(key)]
            j = i + step
            # sizes ascend within a key: what is too large now stays so
            go = (key[j] == key[i]) & (n[i] >= similarity * n[j] - _EPS)
            i, j = i[go], j[go]
            need = least_overlap(similarity / (1 + similarity), n[i] + n[j])
            ok = (c[i] != c[j]) & (~mixed[i] | (part[i] != part[j])) & (np.minimum(n[i] - pos[i], n[j] - pos[j]) >= need)
            x, y = i[ok], j[ok]
            for k in range(0, len(x), 1 << 14):
                u, v = x[k : k + (1 << 14)], y[k : k + (1 << 14)]
                near = may_be_similar(bits[u], bits[v], n[u] + n[v], similarity)
                a, b = sid[u[near]], sid[v[near]]
                out.append(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1))
                size += len(a)
            if size >= _PAIRS:
                yield np.unique(np.concatenate(out), axis=0)
                out, size = [], 0
        if size:
            yield np.unique(np.concatenate(out), axis=0)

    def run(batches):
        held: list[tuple[np.ndarray, ...]] = []

        def flush(cols):
            for p in pairs(*cols):
                yield pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], names=["a", "b"])

        for batch in batches:
            if not len(batch):
                continue
            cols = (*(np.asarray(batch.column(x)) for x in names), batch.column("cross").to_numpy(zero_copy_only=False), _words(batch.column("bits")))
            # the last key may go on in the next batch
            other = np.flatnonzero(cols[0] != cols[0][-1])
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                done = tuple(np.concatenate([h[i] for h in held] + [cols[i][:cut]]) for i in range(len(cols)))
                held = [tuple(x[cut:] for x in cols)]
                yield from flush(done)
            else:
                held.append(cols)
        if held:
            yield from flush(tuple(np.concatenate([h[i] for h in held]) for i in range(len(held[0]))))
        trim()

    return ready(dealt).mapInArrow(run, "a long, b long").distinct()


def _fingerprints(distinct: DataFrame, d: int) -> DataFrame:
    """Pairs (a, b) of sets whose fingerprints differ in at most ``d`` bits, enough to join them all."""
    same = checkpoint(distinct.groupBy("fp").agg(F.min("sid").alias("rep"), F.count("*").alias("n")))
    equal = spread_join(distinct.select("sid", "fp"), same, "fp", same.count()).filter("sid <> rep").select(F.col("rep").alias("a"), F.col("sid").alias("b"))
    links = hamming_links(same.select("fp", "rep"), d).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return equal.union(links)


def _stars(held: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b): each key's sets with its most central one, of sizes that allow it."""
    near = F.least("n", "low.n") >= similarity * F.greatest("n", "low.n") - _EPS
    return held.filter(F.col("sid") != F.col("low.sid")).filter(near).select(F.col("low.sid").alias("a"), F.col("sid").alias("b")).distinct()


def _possible(pairs: DataFrame, distinct: DataFrame, similarity: float) -> DataFrame:
    """The pairs that full parities allow."""
    sketch = distinct.select("sid", "n", "bits")
    pairs = pairs.join(sketch.toDF("a", "n_a", "bits_a"), "a").join(sketch.toDF("b", "n_b", "bits_b"), "b")

    def run(batches):
        for batch in batches:
            size = np.asarray(batch.column("n_a")).astype(np.int64) + np.asarray(batch.column("n_b"))
            ok = np.zeros(len(batch), bool)
            for i, (x, y) in enumerate(zip(batch.column("bits_a").to_pylist(), batch.column("bits_b").to_pylist(), strict=True)):
                least = min(len(x), len(y))
                ok[i] = may_be_similar(folded(x, least)[None], folded(y, least)[None], size[i : i + 1], similarity)[0]
            yield batch.select(["a", "b"]).filter(pa.array(ok))
        trim()

    # repeated names of a set (sid) give a pair more than once
    return ready(pairs).mapInArrow(run, "a long, b long").distinct()


def _similar(docs: DataFrame, distinct: DataFrame, pairs: DataFrame, size: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of sets that reach the similarity."""
    pairs = checkpoint(_possible(pairs, distinct, similarity))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    known = checkpoint(distinct.join(wanted, "sid").select("sid", "digest", "rep"))
    few = F.broadcast if known.count() <= BROADCAST else (lambda d: d)
    texts = docs.join(few(known.select(F.col("rep").alias("doc_id")).distinct()), "doc_id", "left_semi").select("doc_id", "text")

    def run(batches):
        for batch in batches:
            sets = [s.tobytes() for s in shingle_sets(batch.column("text"), size)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()), pa.array(sets, pa.binary())], names=["rep", "digest", "set"])
        trim()

    sets = ready(texts).mapInArrow(run, "rep long, digest binary, set binary")
    # an id on several rows may have other texts, or the same again
    sets = sets.join(few(known), ["digest", "rep"]).repartition("sid").dropDuplicates(["sid", "digest"]).select("sid", "set")
    both = pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")

    def check(batches):
        for batch in batches:
            keep = np.zeros(len(batch), bool)
            for i, (x, y) in enumerate(zip(batch.column("set_a"), batch.column("set_b"), strict=True)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = common >= similarity * (len(x) + len(y) - common) - _EPS
            yield batch.select(["a", "b"]).filter(pa.array(keep))
        trim()

    return checkpoint(both.mapInArrow(check, T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])))


def similar_documents(df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, similarity: float = 0.8, chunk: int = CHUNK, d: int = 3) -> DataFrame:
    """(doc_id, text_sha256, component_id, component_key): near-duplicates by the Jaccard similarity of shingle sets.

    Two texts are linked where, and only where, their sets of shingles of ``size`` words
    (A-Z lower-cased) have at least ``similarity``; ``component_id`` is the least id
    reachable over links, the row's own included.  Fewer words than ``size`` are one
    shingle; null and wordless texts are linked with each other.  Null ids get no
    component and link nothing; repeated rows each get theirs, and rows of one id with
    other texts are texts of their own, told by ``text_sha256`` (null: the empty text).  Such
    ids may name several components, which ``component_key`` tells apart.
    """
    ident = whole_number(df, doc_id)
    docs = df.select(ident.alias("doc_id"), df[text].alias("text"), F.sha2(F.coalesce(df[text], F.lit("")), 256).alias("text_sha256"))
    known = checkpoint(_digests(docs, size))
    distinct = checkpoint(known.filter("doc_id is not null").groupBy("digest", "sid").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("n", "bits", "few", "fp")]))
    rows = _heads(docs.filter("doc_id is not null"), size, similarity).repartition("key").dropDuplicates(["key", "sid"])
    every = Window.partitionBy("key")
    held = checkpoint(rows.withColumn("met", F.count("*").over(every)).withColumn("low", F.max(F.struct("share", "sid", "n")).over(every)).filter("met > 1").drop("share"))
    edges = _similar(docs, distinct, _fingerprints(distinct, d).union(_stars(held, similarity)), size, similarity)
    comp = components(edges, one_task=ONE_TASK)
    c = distinct.join(comp, distinct.sid == comp.node, "left").select("sid", F.coalesce("component", "sid").alias("c"), F.col("few").alias("bits"))
    rest = _apart(held.drop("low").join(c, "sid"), similarity, chunk)
    # what is joined up stays so: each set's link with its component stands for its edges
    edges = comp.select(F.col("node").alias("a"), F.col("component").alias("b")).union(_similar(docs, distinct, rest, size, similarity))
    comp = components(edges, one_task=ONE_TASK)
    sets = checkpoint(distinct.join(comp, distinct.sid == comp.node, "left").select("digest", "rep", "copies", F.coalesce("component", "sid").alias("c")))
    # a component is named by its least id
    least = sets.groupBy("c").agg(F.min("rep").alias("__c"), F.count("*").alias("n"))
    named = checkpoint(spread_join(sets, least, "c", sets.count()).select("digest", "__c", "c", F.col("copies").alias("n")))
    rows = known.filter("doc_id is not null").select("doc_id", "text_sha256", "digest")
    out = spread_join(rows, named, "digest", rows.count()).select("doc_id", "text_sha256", F.col("__c").alias("component_id"), F.col("c").alias("component_key"))
    none = F.lit(None).cast("long")
    return out.unionByName(known.filter("doc_id is null").select("doc_id", "text_sha256", none.alias("component_id"), none.alias("component_key")))


def one_of_each(df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``df`` without near-duplicates: one row of the least id of each component.

    Rows are told by their id and text.  Null ids stay, as no links are known for them; of
    rows with one id and text the first one Spark meets stays.
    """
    found = checkpoint(similar_documents(df, doc_id, text, size, similarity).filter("doc_id is not null"))
    copies = found.groupBy("doc_id", "text_sha256", "component_id", "component_key").agg(F.count("*").alias("__copies"))
    # of several texts of the least id in one component, the least digest stays
    heads = copies.filter("doc_id = component_id")
    first = heads.groupBy("component_key").agg(F.min("text_sha256").alias("__first"))
    heads = heads.join(first, "component_key").withColumn("__gone", F.col("text_sha256") != F.col("__first")).drop("__first")
    rest = copies.filter("doc_id <> component_id").withColumn("__gone", F.lit(True))
    marked = checkpoint(heads.unionByName(rest).filter("__gone or __copies > 1").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"), "__gone"))
    few = F.broadcast if marked.count() <= BROADCAST else (lambda d: d)
    sha = F.sha2(F.coalesce(df[text], F.lit("")), 256)

    def same(d: DataFrame):
        return (whole_number(df, doc_id) == d["__id"]) & (sha == d["__sha"])

    kept = df.join(few(marked), same(marked), "left_anti")
    twice = marked.filter("not __gone")
    if twice.isEmpty():
        return kept
    rows = df.join(few(twice), same(twice), "left_semi").withColumn("__sha", sha)
    return kept.unionByName(rows.dropDuplicates([doc_id, "__sha"]).drop("__sha"))
