"""Near-duplicate documents by b-bit MinHash.

A document's set holds its distinct shingles of `WORDS` lower-cased words. Documents with equal sets form
one class; of 300 minima per class, 160 give 40 band keys of four minima each, and the low four bits of all
are its signature. Classes that share a band key are candidates; the number of equal fields, corrected for
chance collisions, estimates their similarity, and what may reach the threshold is confirmed on the full
sets. At the threshold a pair is missed by all bands with probability (1 - 0.75^4)^40 = 2.5e-7, and by the
estimate (5.7 standard deviations below) with less.

No bucket is expanded into all its pairs as rows. First its members meet its first and its last member; links
are merged into components, and buckets whose members have become one component are done. The members of the others
are dealt out in blocks, block against block, and compared there by their signatures; those with a possible
partner in another component meet once more with their full sets, and only the links that join components
come out. So every candidate pair is compared or already connected, and no task holds more than two blocks
of a bucket at a time.

Nulls: a NULL text, an empty text and one without words have the empty set and are linked with nothing.
Rows with a NULL id take part; a component's id is the smallest id that is not NULL. Repeated rows are
equal sets. An empty table gives an empty result. Other columns of the input are not touched, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstile.llm import common as C

WORDS, PERCENT = 5, 75
BANDS, ROWS = 40, 4
HASHES, BITS = 300, 4
#: Longs of a signature.
SIGNATURE = -(-HASHES * BITS // 64)
#: Least estimate to be confirmed; the estimate's standard deviation at the threshold is 0.026.
LEAST_ESTIMATE = 0.6
#: Members of a bucket that are compared with as many others at a time; pairs looked at in one go.
BLOCK, PAIRS = 512, 100_000

_ODD = np.random.RandomState(20).randint(0, 1 << 31, HASHES).astype(np.uint32) * np.uint32(2) + np.uint32(1)


def shingle_sets(column: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text, one text after the other, and len + 1 offsets."""
    w = C.Words(column, lower=True)
    h = w.hashes()
    g = C.grams(h, words)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(g[a : b - words + 1]))
        else:  # the whole sequence as one, or nothing
            out.append(C.grams(h[a:b], b - a) ^ np.uint64(b - a) if b > a else g[:0])
    off = np.concatenate(([0], np.cumsum([len(x) for x in out]))).astype(np.int64)
    return np.concatenate(out) if out else g[:0], off


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("id", pa.int64()), ("k", pa.int64()), ("n", pa.int64()), ("node", pa.binary()), ("sig", pa.list_(pa.int64())), ("bands", pa.list_(pa.int64()))])
    fields = np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS)
    for batch in batches:
        text = C.plain_text(batch.column(2))
        for a, b in C.chunks(text):
            sets, off = shingle_sets(text.slice(a, b - a))
            n = np.diff(off)
            full = np.flatnonzero(n)
            at = off[:-1][full]
            sums = [np.add.reduceat(C.mix(sets ^ np.uint64(c)), at) if len(at) else sets[:0] for c in (1, 2)]
            low = (sets >> np.uint64(32)).astype(np.uint32)
            minima = np.empty((HASHES, len(at)), np.uint32)
            for i in range(HASHES if len(at) else 0):
                np.minimum.reduceat(low * _ODD[i], at, out=minima[i])
            wide = C.mix(minima.astype(np.uint64))
            low_bits = np.zeros((SIGNATURE * len(fields), len(at)), np.uint64)
            low_bits[:HASHES] = wide & np.uint64((1 << BITS) - 1)
            sig = np.bitwise_or.reduce(low_bits.reshape(SIGNATURE, len(fields), -1) << fields[None, :, None], axis=1)
            bands = np.zeros((BANDS, len(at)), np.uint64)
            for r in range(ROWS):
                bands = C.mix(bands + wide[r : BANDS * ROWS : ROWS] + np.uint64(r))
            bands = C.mix(bands ^ np.arange(BANDS, dtype=np.uint64)[:, None])
            node = [None] * (b - a)
            for j, x in zip(full.tolist(), np.stack(sums, 1), strict=True):
                node[j] = x.tobytes()
            lists = []
            for values in (sig, bands):
                ends = np.zeros(b - a + 1, np.int32)
                ends[1:] = np.cumsum((n > 0) * len(values))
                lists.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(values.T.reshape(-1).view(np.int64))))
            cols = [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(n), pa.array(node, pa.binary()), *lists]
            yield pa.RecordBatch.from_arrays(cols, schema=schema)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, texts) whose full sets are similar enough."""
    for batch in batches:
        codes, sets = [], []
        for c in (2, 3):
            d = C.plain_text(batch.column(c)).dictionary_encode()
            codes.append(d.indices.to_numpy())
            own: list[np.ndarray] = []
            for a, b in C.chunks(d.dictionary):
                values, off = shingle_sets(d.dictionary.slice(a, b - a))
                own += np.split(values, off[1:-1])
            sets.append(own)
        keep = []
        for i, (x, y) in enumerate(zip(*(c.tolist() for c in codes), strict=True)):
            p, q = sets[0][x], sets[1][y]
            both = len(np.intersect1d(p, q, assume_unique=True))
            if 100 * both >= PERCENT * (len(p) + len(q) - both):
                keep.append(i)
        yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))


#: Equal fields that different minima have by chance, and the number of different fields of signatures sa, sb.
_CHANCE = 1 / (1 << BITS)
_DIFFERENT = " + ".join(
    f"bit_count(({x} | shiftrightunsigned({x}, 1) | shiftrightunsigned({x}, 2) | shiftrightunsigned({x}, 3)) & 1229782938247303441L)" for x in (f"(sa[{i}] ^ sb[{i}])" for i in range(SIGNATURE))
)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted rows (key, i, j, block, node, root, n, sig): those that have a partner in their group (key, i,
    j) of another component, and of the other block if the group has two, whose signature lets them link."""
    ones = np.uint64(0x1111111111111111)

    def solve(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        key, i, j, block, n = (rows.column(c).to_numpy() for c in ("key", "i", "j", "block", "n"))
        node, root = rows.column("node").combine_chunks(), rows.column("root").combine_chunks().dictionary_encode().indices.to_numpy()
        sig = rows.column("sig").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(key), SIGNATURE)
        new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))))
        end = np.repeat(np.append(new[1:], len(key)), np.diff(np.append(new, len(key))))
        later = end - np.arange(len(key)) - 1
        total, a, hit = np.cumsum(later), 0, np.zeros(len(key), bool)
        while a < len(key):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + PAIRS, "right")))
            x = np.repeat(np.arange(a, b), later[a:b])
            y = C.ranges(np.arange(a, b) + 1, later[a:b])
            a = b
            ok = (root[x] != root[y]) & ((i[x] == j[x]) | (block[x] != block[y])) & (100 * np.minimum(n[x], n[y]) >= PERCENT * np.maximum(n[x], n[y]))
            x, y = x[ok], y[ok]
            d = sig[x] ^ sig[y]
            d |= d >> np.uint64(1)
            d |= d >> np.uint64(2)
            equal = 1 - np.bitwise_count(d & ones).sum(1, dtype=np.int64) / HASHES
            ok = (equal - _CHANCE) / (1 - _CHANCE) >= LEAST_ESTIMATE
            hit[x[ok]] = hit[y[ok]] = True
        if hit.any():
            yield from rows.select(range(6)).filter(pa.array(hit)).combine_chunks().to_batches()

    yield from _groups(batches, solve)


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted rows (key, i, j, block, node, root, text): links (a, b) that connect the components of a group
    (key, i, j) as all its links do. Set sizes of all pairs come from a product of incidence matrices."""

    def solve(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        key, i, j, block = (rows.column(c).to_numpy() for c in ("key", "i", "j", "block"))
        root = rows.column("root").combine_chunks().dictionary_encode().indices.to_numpy()
        texts, sets = rows.column("text").combine_chunks().cast(pa.large_string()), []
        for a, b in C.chunks(texts):
            values, off = shingle_sets(texts.slice(a, b - a))
            sets += np.split(values, off[1:-1])
        new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))))
        found: list[tuple[int, int]] = []
        for a, b in zip(new.tolist(), [*new[1:].tolist(), len(key)], strict=True):
            size = np.array([len(x) for x in sets[a:b]])
            shingle, code = np.unique(np.concatenate(sets[a:b]), return_inverse=True)
            owner = np.repeat(np.arange(b - a), size)
            order = np.argsort(code, kind="stable")
            code, owner = code[order], owner[order]
            both = np.zeros((b - a, b - a), np.float32)  # whole numbers below 2^24
            for low in range(0, len(shingle), 4096):
                part = slice(*np.searchsorted(code, (low, low + 4096)))
                held = np.zeros((b - a, min(4096, len(shingle) - low)), np.float32)
                held[owner[part], code[part] - low] = 1
                both += held @ held.T
            linked = 100 * both >= PERCENT * (size[:, None] + size[None, :] - both)
            linked &= (root[a:b, None] != root[None, a:b]) & ((i[a] == j[a]) | (block[a:b, None] != block[None, a:b]))
            parent = {r: r for r in root[a:b].tolist()}

            def top(r, parent=parent):
                while parent[r] != r:
                    parent[r] = r = parent[parent[r]]
                return r

            for x, y in zip(*(z.tolist() for z in np.nonzero(np.triu(linked))), strict=True):
                p, q = top(int(root[a + x])), top(int(root[a + y]))
                if p != q:
                    parent[p] = q
                    found.append((a + x, a + y))
        if found:
            node = rows.column("node").combine_chunks()
            yield pa.RecordBatch.from_arrays([node.take(pa.array([f[k] for f in found])) for k in (0, 1)], ["a", "b"])

    yield from _groups(batches, solve)


def _groups(batches: Iterator[pa.RecordBatch], solve) -> Iterator[pa.RecordBatch]:
    """solve() of tables that hold whole groups of sorted (key, i, j)."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        # The last group may go on in the next batch.
        held.append(batch)
        table = pa.Table.from_batches(held)
        key, i, j = (table.column(c).to_numpy() for c in ("key", "i", "j"))
        last = np.flatnonzero((key != key[-1]) | (i != i[-1]) | (j != j[-1])) if len(key) else []
        if len(last):
            cut = int(last[-1]) + 1
            yield from solve(table.slice(0, cut))
            held = table.slice(cut).combine_chunks().to_batches()
    if held and (table := pa.Table.from_batches(held)).num_rows:
        yield from solve(table)


def _similar(pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Of the distinct pairs (a, b): those that estimate, sizes and at last the full sets let through."""
    side = lambda s: nodes.select(F.col("node").alias(s), F.col("n").alias(f"n{s}"), F.col("sig").alias(f"s{s}"))
    pairs = pairs.join(side("a"), "a").join(side("b"), "b")
    pairs = pairs.where(f"100 * least(na, nb) >= {PERCENT} * greatest(na, nb)")
    pairs = pairs.where(F.expr(f"(1 - ({_DIFFERENT}) / {HASHES}.0D - {_CHANCE}D) / {1 - _CHANCE}D >= {LEAST_ESTIMATE}D")).select("a", "b")
    text = lambda s: texts.select(F.col("node").alias(s), F.col("text").alias(f"t{s}"))
    return pairs.join(text("a"), "a").join(text("b"), "b").select("a", "b", "ta", "tb").mapInArrow(C.released(_confirm), "a binary, b binary")


def _merge(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots with the components joined that the links (a, b) connect."""
    of = lambda s: roots.select(F.col("node").alias(s), F.col("root").alias(f"r{s}"))
    links = C.store(links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")), "joined")
    merged = C.store(C.connected(links, "merged"), "merged").toDF("root", "to")
    old = roots.join(merged, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    new = merged.join(roots.select(F.col("node").alias("root")), "root", "left_anti")
    return C.store(old.union(new), "roots")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for every row of docs; id_col is an integer column."""
    return _components(docs, id_col, text_col).withColumnRenamed("id", id_col).drop("k", "root")


def _components(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """As components(), with k, the hash of the row's text, and root, NULL without words, one per component."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("k"), F.col(text_col).alias("text"))
    sketch = C.store(docs.mapInArrow(C.released(_sketch), "id long, k long, n long, node binary, sig array<long>, bands array<long>"), "sketch")
    # A class keeps the hash of one of its texts to fetch that text later.
    nodes = sketch.where("n > 0").groupBy("node").agg(F.min("n").alias("n"), F.min("k").alias("k"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    nodes = C.store(nodes, "classes")
    banded = nodes.select("node", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first <> last")
    members = C.store(banded.join(buckets, "key"), "buckets")
    wanted = nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", "k")
    near = C.flagged(docs.select("k", "text"), F.col("k"), wanted, "maybe").where("maybe")
    texts = near.join(wanted, "k").groupBy("node").agg(F.min("text").alias("text"))
    texts = C.store(texts, "texts")
    ends = [members.where(f"node <> {c}").select(F.greatest("node", c).alias("a"), F.least("node", c).alias("b")) for c in ("first", "last")]
    pairs = ends[0].union(ends[1]).distinct()
    links = C.store(_similar(pairs, nodes, texts), "links")
    roots = C.store(C.connected(links, "roots"), "roots")
    rooted = members.where("node <> first AND node <> last").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    open_ = rooted.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("c")).where("x <> y")
    live = rooted.join(open_.select("key", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks")), "key")
    live = live.join(nodes.select("node", "n", "sig"), "node").withColumn("block", F.pmod(F.hash("node"), F.col("blocks")))
    live = live.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    live = live.select("key", "i", "j", "block", "node", "root", "n", "sig").repartition(C.partitions(docs.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j")
    near = live.mapInArrow(C.released(_compare), "key long, i int, j int, block int, node binary, root binary")
    near = near.join(texts, "node").select("key", "i", "j", "block", "node", "root", "text")
    near = near.repartition(C.partitions(docs.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j")
    roots = _merge(roots, C.store(near.mapInArrow(C.released(_link), "a binary, b binary"), "links"))
    rows = sketch.select("id", "k", "n", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rows.where("root is not null").groupBy("root").agg(F.min("id").alias("c"))
    rows = rows.join(least, "root", "left").withColumn("c", F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("c")))
    return rows.select("id", "k", F.col("n").alias("n_shingles"), F.col("c").alias("component_id"), F.col("id").eqNullSafe(F.col("c")).alias("kept"), "root")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that are not the first of their component. Rows with the same id and text are
    the same document and stay or go together; so are rows with the same text and no id."""
    gone = _components(docs, id_col, text_col).where("not kept").select(F.col("id").alias("_gone"), "k").distinct()
    gone = C.store(gone, "gone")
    rows = docs.select(F.struct("*").alias("_row"), F.col(id_col).cast("long").alias("_id"), F.xxhash64(text_col).alias("_k"))
    rows = C.flagged(rows, F.col("_k"), gone, "_maybe")
    same = rows["_id"].eqNullSafe(gone["_gone"]) & (rows["_k"] == gone["k"])
    kept = rows.where("_maybe").join(gone, same, "left_anti")
    return rows.where("not _maybe").union(kept).select("_row.*")


def keep_one_row(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with exactly one row of each component: that with the least id that is not NULL, then the least hash
    of the text; of rows equal in both, the one with the least hash of all columns. Rows without words all stay."""
    members = _components(docs, id_col, text_col).where("root is not null").groupBy("root", "id", "k").agg(F.count("*").alias("c"))
    members = C.store(members, "members")
    first = members.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "k")).alias("first"))
    is_first = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("k") == F.col("first.k"))
    surplus = members.join(first, "root").where(~is_first | (F.col("c") > 1)).select(F.col("id").alias("_gone"), "k", is_first.alias("first"))
    surplus = C.store(surplus, "surplus")
    rows = docs.select(F.struct("*").alias("_row"), F.col(id_col).cast("long").alias("_id"), F.xxhash64(text_col).alias("_k"))
    same = lambda other: F.col("_id").eqNullSafe(other["_gone"]) & (F.col("_k") == other["k"])
    marked = C.flagged(rows, F.col("_k"), surplus, "_maybe")
    alone = marked.where("_maybe").join(surplus, same(surplus), "left_anti")
    # Copies are combined in every task before they are shuffled.
    several = surplus.where("first")
    copies = C.flagged(rows, F.col("_k"), several, "_maybe").where("_maybe")
    copies = copies.groupBy("_id", "_k").agg(F.min_by("_row", F.xxhash64(F.to_json("_row"))).alias("_row")).join(several, same(several), "left_semi")
    return marked.where("not _maybe").union(alone).select("_row").union(copies.select("_row")).select("_row.*")
