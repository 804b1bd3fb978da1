"""MinHash near-dedup by BagMinHash.

A document is the multiset of its shingles of five words (lower-cased runs of other than white space; fewer words are
one shingle). For each shingle, Poisson processes run over its levels 0, 1, 2, ...: one each for [0, 1), [1, 2), [2, 4),
[4, 8), ... A process that yields a point is split there into its halves, down to single levels, so all documents see the
same points at the same levels, and a document takes those below the shingle's count. A point goes to one of the 96
registers; the least time in each is the signature. Two documents agree in a register as often as their weighted
Jaccard similarity says.

Signatures are banded (24 bands of 4: a pair of similarity 0.8 has no band in common once in 300,000). All members of a
bucket are compared with its most connected one, the one that shares most buckets with others: of copies of one text
that is the text, so a large group is linked in linear time. What such stars leave in different components is compared
within its buckets: blocks of a bounded size meet in pairs, each pair of documents in its first common band only, and
documents of the bucket's commonest component only with others. Pairs are verified by the exact similarity of the
multisets, after their sizes allow it, and verified pairs make the components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtext import release, runs
from .common import free_name, stage, table, unstage
from .components import components

SHINGLE, BANDS, ROWS, SIMILARITY = 5, 24, 4, 0.8
REGISTERS = BANDS * ROWS
BLOCK = 1 << 19  # bytes, or numbers, that are worked on at once
BITS, SEEN = 26, 1_000_000  # of a bitmap of hashes, as a power of 2 (8 MB); hashes that a task keeps
PART_BYTES, PART_ROWS = 4 << 20, 1024  # of multisets, and documents, of a block of a bucket
U = np.uint64
P = 0x9E3779B97F4A7C15
_ODD = [U(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def mix(x: np.ndarray) -> np.ndarray:
    """Scatters 64-bit numbers."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_powers: dict = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1), modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(n - 1, 1).bit_length()
        have = np.full(size, U(base))
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each word of some bytes."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, U)
    inner = ~_SPACE[data]
    edge = np.diff(np.concatenate([[0], inner.view(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.concatenate([np.zeros(1, U), np.cumsum((data.astype(U) + U(1)) * powers(P, len(data)))])
    own = (sums[end] - sums[start]) * powers(pow(P, -1, 1 << 64), len(data))[start]
    return start, mix(own + (end - start).astype(U))


def _pieces(data: bytes):
    """Bytes of a text in pieces of about BLOCK that end between words."""
    at = 0
    while at < len(data):
        stop = at + BLOCK
        if stop < len(data):
            found = max(data.rfind(b" ", at, stop), data.rfind(b"\n", at, stop))
            if found < 0:
                after = [x for x in (data.find(b" ", stop), data.find(b"\n", stop)) if x >= 0]
                found = min(after) if after else len(data)
            stop = found + 1
        yield np.frombuffer(data[at:stop], np.uint8)
        at = stop


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, number of words of each text)."""
    own = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(x) + 1 for x in own])
    if len(own) == 1 and sizes[0] > BLOCK:
        hashes = np.concatenate([_word_hashes(p)[1] for p in _pieces(own[0])])
        return hashes, np.array([len(hashes)])
    start, hashes = _word_hashes(np.frombuffer(b" ".join(own), np.uint8))
    return hashes, np.diff(np.searchsorted(start, np.concatenate([[0], np.cumsum(sizes)])))


def shingles_of(words: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each shingle, its text): of each text's words, n - 4 but one at least; none of a text without words."""
    count = np.where(n == 0, 0, np.maximum(n - SHINGLE + 1, 1))
    owner = np.repeat(np.arange(len(n)), count)
    first = np.cumsum(n) - n
    at = first[owner] + np.arange(len(owner)) - (np.cumsum(count) - count)[owner]
    padded = np.concatenate([words, np.zeros(SHINGLE, U)])
    left = n[owner] - (at - first[owner])  # words from here to the end
    total = np.zeros(len(at), U)
    for k in range(SHINGLE):
        total += np.where(left > k, padded[at + k], U(0)) * _ODD[k]
    return mix(total), owner


def identities(words: np.ndarray, n: np.ndarray) -> np.ndarray:
    """16 bytes of each text that stand for its sequence of words."""
    local = np.arange(len(words)) - np.repeat(np.cumsum(n) - n, n)
    most = int(n.max()) if len(n) else 0
    out = np.zeros((len(n), 2), U)
    some = np.flatnonzero(n)
    for k, base in enumerate((0xD1342543DE82EF95, 0xAF251AF3B0F025B5)):
        if len(some):
            out[some, k] = np.add.reduceat(words * powers(base, most)[local], (np.cumsum(n) - n)[some])
        out[:, k] = mix(out[:, k] + n.astype(U) * _ODD[k])
    return out


def multisets(hashes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(element of 44 bits, text, count). A run has fewer than 2**20 texts."""
    key = np.sort(((hashes >> U(20)) | (owner.astype(U) << U(44))) if n > 1 else hashes >> U(20))
    if not len(key):
        return key, np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    kinds = key[start]
    return kinds & U((1 << 44) - 1), (kinds >> U(44)).astype(np.int64), np.diff(np.append(start, len(key)))


def _points(x, doc, weight, limit):
    """All points below the limit of their text, as (doc, register, time). x, doc, weight: the elements."""
    found = []
    # Blocks of levels: [0, 1), then [2**(j-1), 2**j).
    lo, size, k = np.zeros(len(x), np.int64), np.ones(len(x), np.int64), 0
    items = [(x, doc, weight, lo, size)]
    while True:
        more = weight > (1 << k)
        if not more.any():
            break
        x, doc, weight = x[more], doc[more], weight[more]
        items.append((x, doc, weight, np.full(len(x), 1 << k), np.full(len(x), 1 << k)))
        k += 1
    x, doc, weight, lo, size = (np.concatenate(c) for c in zip(*items))
    t, turn = np.zeros(len(x)), np.zeros(len(x), np.int64)
    while len(x):
        seed = mix(x * _ODD[0] + lo.astype(U) * _ODD[1] + size.astype(U) * _ODD[2] + turn.astype(U) * _ODD[3])
        t = t - np.log(((seed >> U(11)).astype(np.float64) + 0.5) * 2.0**-53) / size
        ok = t <= limit[doc]
        x, doc, weight, lo, size, turn, t, seed = (c[ok] for c in (x, doc, weight, lo, size, turn, t, seed))
        if not len(x):
            break
        nexts = []
        while True:  # each point goes down to one level; the halves that it passes go on from its time
            wide = size > 1
            leaf = ~wide
            if leaf.any():
                s = mix(seed[leaf] + _ODD[4])
                register = ((s >> U(32)) * U(REGISTERS) >> U(32)).astype(np.int64)
                own = lo[leaf] < weight[leaf]
                found.append((doc[leaf][own], register[own], t[leaf][own]))
                nexts.append((x[leaf], doc[leaf], weight[leaf], lo[leaf], size[leaf], turn[leaf] + 1, t[leaf]))
            if not wide.any():
                break
            x, doc, weight, lo, size, turn, t, seed = (c[wide] for c in (x, doc, weight, lo, size, turn, t, seed))
            seed = mix(seed + size.astype(U) * _ODD[3] + _ODD[1])
            half, right = size >> 1, (seed >> U(63)).astype(bool)
            other = np.where(right, lo, lo + half)
            nexts.append((x, doc, weight, other, half, np.zeros(len(x), np.int64), t))
            lo, size, turn = np.where(right, lo + half, lo), half, np.zeros(len(x), np.int64)
        x, doc, weight, lo, size, turn, t = (np.concatenate(c) for c in zip(*nexts))
        ok = lo < weight
        x, doc, weight, lo, size, turn, t = (c[ok] for c in (x, doc, weight, lo, size, turn, t))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def signatures(x: np.ndarray, doc: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """(n, REGISTERS) least times. A text without shingles has infinite ones."""
    out = np.full((n, REGISTERS), np.inf)
    total = np.bincount(doc, weight, n)
    todo = np.flatnonzero(total > 0)
    reach = REGISTERS * (np.log(REGISTERS) + 6)  # points that fill all registers but once in 400 times
    while len(todo):
        pick = np.zeros(n, bool)
        pick[todo] = True
        own = pick[doc]
        d, r, t = _points(x[own], doc[own], weight[own], reach / np.maximum(total, 1))
        np.minimum.at(out.reshape(-1), d * REGISTERS + r, t)
        todo = todo[np.isinf(out[todo]).any(1)]
        reach *= 4
    return out


def bands_of(sig: np.ndarray) -> np.ndarray:
    bits = sig.view(U).reshape(len(sig), BANDS, ROWS)
    total = np.zeros((len(sig), BANDS), U)
    for k in range(ROWS):
        total = mix(total + bits[:, :, k] * _ODD[k] + _ODD[4])
    return total


def _fixed(rows: np.ndarray) -> pa.Array:
    """Rows of 16 bytes as a binary column."""
    data = np.ascontiguousarray(rows).tobytes()
    off = np.arange(len(rows) + 1, dtype=np.int32) * 16
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(data)])


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    off = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(values.view(np.int64)))


def _sign(batches):
    """(id, hash, text) -> (id, hash, node, size in shingles, bands)."""
    for batch in batches:
        texts = [t or "" for t in batch.column(2).to_pylist()]
        for i, j in runs(np.fromiter(map(len, texts), np.int64, len(texts)), BLOCK):
            words, n = words_of(texts[i:j])
            hashes, owner = shingles_of(words, n)
            bands = bands_of(signatures(*multisets(hashes, owner, j - i), j - i))
            part = batch.slice(i, j - i)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), _fixed(identities(words, n)), pa.array(np.bincount(owner, minlength=j - i)), _lists(bands.reshape(-1), np.full(j - i, BANDS))],
                ["id", "hash", "node", "size", "bands"],
            )
    release()


def wanted_bits(wanted: DataFrame, most: int = BITS) -> np.ndarray:
    """Bytes of a bitmap of the hashes of `wanted` by their first bits: 16 bits for each hash, 2**most in all at most."""
    rows = max(wanted.count(), 1)
    bits = min(max((16 * rows - 1).bit_length(), 15), most)
    place = wanted.select(F.shiftrightunsigned("hash", 64 - bits).alias("bit")).select((F.col("bit") % 32768).cast("long").alias("at"), F.expr("bit div 32768").alias("page"))
    # Places are shuffled, not bitmaps, of which each task would have one.
    pages = place.repartition("page").groupBy("page").agg(F.bitmap_construct_agg("at").alias("bits")).collect()
    out = np.zeros((1 << bits >> 15, 4096), np.uint8)
    for r in pages:
        out[r.page] = np.frombuffer(r.bits, np.uint8)
    return out.reshape(-1)


def _is_wanted(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes.view(U) >> U(61 - (len(bitmap).bit_length() - 1))
    return (bitmap[at >> U(3)] >> (at & U(7)).astype(np.uint8)) & 1 == 1


def _wanted_sets(shared):
    """(hash, text) -> (node, elements) of texts whose hash is in the bitmap; of a task's equal hashes of one."""

    def run(batches):
        bitmap, seen = shared.value, set()
        for batch in batches:
            own = batch.column(0).to_numpy()
            pick = []
            for k in np.flatnonzero(_is_wanted(bitmap, own)).tolist():
                if own[k] not in seen:
                    seen.add(own[k])
                    pick.append(k)
            if len(seen) > SEEN:
                seen.clear()
            if pick:
                yield from _sets([batch.select([1]).take(pa.array(pick))])
        release()

    return run


def _sets(batches):
    """(text) -> (node, elements): hashes of the shingles, the second of a kind with another hash than the first."""
    for batch in batches:
        texts = [t or "" for t in batch.column(0).to_pylist()]
        for i, j in runs(np.fromiter(map(len, texts), np.int64, len(texts)), BLOCK):
            words, n = words_of(texts[i:j])
            hashes, owner = shingles_of(words, n)
            order = np.lexsort((hashes, owner))
            hashes, owner = hashes[order], owner[order]
            new = np.ones(len(hashes), bool)
            new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
            start = np.maximum.accumulate(np.where(new, np.arange(len(hashes)), 0))
            nth = (np.arange(len(hashes)) - start).astype(U)
            values = np.where(nth > 0, mix(hashes + nth * _ODD[2]), hashes)
            yield pa.RecordBatch.from_arrays([_fixed(identities(words, n)), _lists(values, np.bincount(owner, minlength=j - i))], ["node", "elements"])


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Of pairs (a, b), those whose multisets are as similar."""
    left = sets.select(F.col("node").alias("a"), F.col("elements").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("elements").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(left, "a").join(right, "b").filter(both >= similarity * (F.size("x") + F.size("y") - both)).select("a", "b")


def links_of_block(node: list[bytes], root: np.ndarray, first: np.ndarray, second: np.ndarray, bands: np.ndarray, band: int, sets: list[np.ndarray], similarity: float):
    """Pairs (i, j) of similar documents whose roots (numbers) differ, whose first common band is this one, and of which
    one is in the first, one in the second block. Of documents that become connected here, further pairs are left out."""
    up = np.arange(int(root.max()) + 1 if len(root) else 0)

    def top(x):
        while up[x] != x:
            x = up[x] = up[up[x]]
        return x

    size = np.array([len(x) for x in sets], np.int64)
    major = root == np.bincount(root).argmax() if len(root) else root
    number = np.arange(len(root))
    for i in np.flatnonzero(~major):
        ok = (root != root[i]) & (major | (number > i)) & ((first[i] & second) | (second[i] & first))
        ok &= np.minimum(size, size[i]) >= similarity * np.maximum(size, size[i])
        others = np.flatnonzero(ok)
        others = others[(bands[others] == bands[i]).argmax(1) == band]
        if not len(others):
            continue
        flat, ends = np.concatenate([sets[j] for j in others]), np.cumsum(size[others])
        own = sets[i]
        hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
        both = np.diff(np.concatenate([[0], np.concatenate([[0], np.cumsum(hit)])[ends]]))
        for j in others[both >= similarity * (size[i] + size[others] - both)]:
            a, b = top(root[i]), top(root[j])
            if a != b:
                up[a] = b
                yield i, int(j)


def _rest(similarity: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        node = table.column("node").to_pylist()
        number = {x: k for k, x in enumerate(dict.fromkeys(table.column("root").to_pylist()))}
        root = np.array([number[x] for x in table.column("root").to_pylist()], np.int64)
        part = table.column("part").to_numpy()
        first, second = part == table.column("low")[0].as_py(), part == table.column("high")[0].as_py()
        flat = lambda c: c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        bands = flat(table.column("bands")).flatten().to_numpy(zero_copy_only=False).reshape(-1, BANDS)
        elements = flat(table.column("elements"))
        off, values = elements.offsets.to_numpy(), elements.values.to_numpy(zero_copy_only=False)
        sets = [np.sort(values[i:j]) for i, j in zip(off[:-1], off[1:])]
        pairs = list(links_of_block(node, root, first, second, bands, table.column("band")[0].as_py(), sets, similarity))
        return pa.table({"a": pa.array([node[i] for i, _ in pairs], pa.binary()), "b": pa.array([node[j] for _, j in pairs], pa.binary())})

    return run


def _rest_links(others: DataFrame, labels: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links between documents of a bucket that are in different components. others: all but the buckets' most connected
    ones, with which all pairs have been compared; so a bucket of two has nothing left."""
    own = others.join(labels, "node", "left").select("band", "value", "node", "size", "bands", F.coalesce("root", "node").alias("root"))
    own = stage(own, "near-own")
    mixed = own.groupBy("band", "value").agg(F.min("root").alias("r1"), F.max("root").alias("r2"), F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    parts = F.ceil(F.greatest(F.col("bytes") * 8 / PART_BYTES, F.col("n") / PART_ROWS)).cast("int")
    mixed = stage(mixed.filter("r1 <> r2").select("band", "value", F.greatest(parts, F.lit(1)).alias("parts")), "near-mixed")
    rows = own.join(mixed, ["band", "value"]).withColumn("part", F.expr("cast(pmod(xxhash64(node), parts) AS int)"))
    rows = rows.select("*", F.explode(F.expr("sequence(0, parts - 1)")).alias("other"))
    rows = rows.select("band", "value", "node", "root", "part", "bands", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))
    rows = rows.join(sets, "node")
    out = stage(rows.groupBy("band", "value", "low", "high").applyInArrow(_rest(similarity), "a binary, b binary"), "near-rest")
    unstage(own, mixed)
    return out


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of docs: id, hash (xxhash64 of the text), root: rows of one class have the same root.

    Documents are of a class if a chain of pairs as similar leads from one to the other; same words in the same order
    are one document from the start. Null and empty texts are alike, and a class of their own.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("id", F.xxhash64("text").alias("hash"), "text")
    added = [T.StructField("node", T.BinaryType()), T.StructField("size", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))]
    signed = stage(rows.mapInArrow(_sign, T.StructType([rows.schema["id"], rows.schema["hash"], *added])), "near-signatures")
    nodes = signed.groupBy("node").agg(F.min("hash").alias("hash"), F.max("size").alias("size"), F.min("bands").alias("bands"))
    nodes = stage(nodes, "near-nodes")
    member = nodes.select("node", F.posexplode("bands").alias("band", "value"))
    buckets = stage(member.groupBy("band", "value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "near-buckets")
    shared = stage(member.join(buckets, ["band", "value"]), "near-members")
    popular = stage(shared.groupBy("node").agg(F.sum("n").alias("meets")).join(nodes, "node"), "near-popular")
    hub = shared.join(popular.select("node", "meets", "size"), "node").groupBy("band", "value").agg(F.max(F.struct("meets", "node", "size")).alias("hub"))
    hub = stage(hub.select("band", "value", F.col("hub.node").alias("a"), F.col("hub.size").alias("hub_size")), "near-hubs")
    # Texts stay where they are: a bitmap of bounded size goes to them. What it lets through by chance goes in the join.
    shared_bits = docs.sparkSession.sparkContext.broadcast(wanted_bits(popular.select("hash")))
    sets = rows.select("hash", "text").mapInArrow(_wanted_sets(shared_bits), "node binary, elements array<long>")
    sets = stage(sets.dropDuplicates(["node"]).join(popular.select("node"), "node", "left_semi"), "near-sets")
    others = stage(shared.join(hub, ["band", "value"]).filter("node <> a"), "near-others")
    star = others.select("a", "hub_size", "node").distinct().join(popular.select("node", "size"), "node")
    star = star.filter(F.least("size", "hub_size") >= similarity * F.greatest("size", "hub_size")).select("a", F.col("node").alias("b"))
    star = stage(star, "near-stars")
    links = stage(_verified(star, sets, similarity), "near-links")
    labels = components(links, "near-stars")
    again = others.groupBy("band", "value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("band", "value")
    left = others.select("band", "value", "node").join(again, ["band", "value"], "left_semi")
    rest = _rest_links(left.join(popular.select("node", "size", "bands"), "node"), labels, sets, similarity)
    unstage(nodes, buckets, shared, popular, hub, others, sets, star)
    if not rest.isEmpty():
        unstage(labels)
        labels = components(links.unionByName(rest), "near")
    unstage(links, rest)
    return signed.select("id", "hash", "node").join(labels, "node", "left").select("id", "hash", F.coalesce("root", "node").alias("root"))


def near_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of docs: id_col, hash, class_id (the least id of the class), class_size, kept. Rows that repeat an
    id and a text are one document and share what is said of it; a class without any id has a null class_id, and its
    members are kept. An empty table gives an empty result; other columns are ignored."""
    classes = stage(near_classes(docs, id_col, text_col, similarity), "near-classes")
    size = classes.groupBy("root").agg(F.min(F.struct("id", "hash")).alias("least"), F.min("id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    first = classes.filter("id IS NOT NULL").groupBy("root").agg(F.min(F.struct("id", "hash")).alias("first"))
    size = stage(size.join(first, "root", "left").select("root", "class_id", "class_size", F.coalesce("first", "least").alias("keep")), "near-sizes")
    kept = F.struct("id", "hash").eqNullSafe(F.col("keep"))
    return classes.join(size, "root").select(F.col("id").alias(id_col), "hash", "class_id", "class_size", kept.alias("kept"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each class; columns as they were."""
    own, id_, hash_ = (free_name(f"__{n}", docs) for n in ("own", "id", "hash"))
    keep = near_report(docs, id_col, text_col, similarity).filter("kept").select(F.col(id_col).alias(id_), F.col("hash").alias(hash_)).distinct()
    rows = docs.withColumn(own, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    on = F.col(id_col).eqNullSafe(F.col(id_)) & (F.col(own) == F.col(hash_))
    return rows.join(keep, on, "left_semi").dropDuplicates([id_col, own]).select(*docs.columns)


def op7_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_report(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "kept")
