"""N-gram Jaccard join: which documents share almost all of their word n-grams.

The document by n-gram incidence matrix is never built whole:

1. Sketch. One pass counts n-grams in a table of fixed size (2**22 counters
   whatever the input). Its only use is the order "rare before frequent".
2. Rows. A second pass turns every text into its set of n-grams (64-bit
   hashes), the set's size, a hash of the set (its class: equal sets are one
   row of the matrix from here on) and its prefix: the ``n - ceil(t*n) + 1``
   first n-grams in that order. Two sets with a Jaccard similarity of ``t``
   share one n-gram of their prefixes, whatever the order is.
3. Product over the prefixes. The prefix entries are shuffled by n-gram, and a
   column's by size. A class that meets less than ``pair_limit`` classes before
   it with sizes within ``t`` becomes a product term with each; terms are added
   up per pair, and pairs whose overlap so far plus all that may follow stays
   under ``t/(1+t)*(|a|+|b|)`` go. Where more meet, the run of sizes yields one
   term per class instead (to its first class): it only says that these classes
   belong together.
   A family of near copies would give the same pairs in nearly every column, many
   times the input. So a large table's n-grams go in waves (by their last bits).
   After a wave, pairs that share half of their prefixes' n-grams so far stay for
   good, each class is labelled with the smallest of its partners and theirs, and
   the next wave leaves out pairs of one label: they belong together already.
4. Blocks. Connected components of what is left (ids only) are blocks whose
   classes cannot link to any class outside. Their whole sets are read in a
   third pass, and each block is multiplied exactly: overlaps are added up per
   pair over the block's shared n-grams, and pairs under the bound go. A block
   of more than ``tile_grams`` n-grams is cut into tiles, by size, one task unit
   per pair of tiles that may link, so the memory of a task is bounded. Where the units hold more
   than half as many n-grams as the table, they are sent in waves from the written
   texts of their classes, so what is on disk at once is bounded too.

No links are lost: steps 3 and 4 only drop pairs that the bounds rule out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tablelens.llm import words as W
from tablelens.llm.components import connected_components
from tablelens.llm.stage import Steps

SKETCH_BITS = 22
_SKETCH_ROWS = 16
#: Ids that may be broadcast: 8 MB of them; more are joined by a shuffle.
BROADCAST_IDS = 1 << 20
#: Prefix entries from which n-grams go in waves, and the ends of the waves in eighths.
WAVE_ENTRIES = 1 << 22
_WAVES = (1, 2, 4, 8)
#: N-grams of units that a wave holds at least.
WAVE_GRAMS = 1 << 24


def shingle_sets(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes of the n-grams of its words, A-Z folded).
    A text with fewer than n words has its whole sequence as one n-gram; a text
    without words, or a null, has none."""
    data, offsets = W.column_bytes(column)
    for i, j in W.text_groups(offsets):
        h, _, _, first = W.words_of_rows(data, offsets, i, j, lower=True)
        grams = W.window_hashes(h, n)
        for r in range(i, j):
            a, b = int(first[r - i]), int(first[r - i + 1])
            if b - a >= n:
                yield r, np.unique(grams[a:b - n + 1])
            elif b > a:
                yield r, W.window_hashes(h[a:b], b - a) ^ np.uint64(b - a)
            else:
                yield r, grams[:0]


def set_key(grams: np.ndarray) -> int:
    """A hash of a set of hashes, as a signed 64-bit integer."""
    x = W.mix(grams * np.uint64(0xD6E8FEB86659FD93) + np.uint64(len(grams)))
    low = int(np.bitwise_xor.reduce(x))
    total = int(np.add.reduce(grams * np.uint64(0xA0761D6478BD642F)))
    v = (low * 0x9E3779B97F4A7C15 + total) & 0xFFFFFFFFFFFFFFFF
    return v - (1 << 64) if v >> 63 else v


def _sketch_part(n: int, bits: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << bits, dtype=np.uint32)
        for batch in batches:
            data, offsets = W.column_bytes(batch.column(0))
            for i, j in W.text_groups(offsets):
                h, _, _, _ = W.words_of_rows(data, offsets, i, j, lower=True)
                # windows over the end of a row count too: this is only an order
                g = W.window_hashes(h, n) >> np.uint64(64 - bits)
                np.add.at(table, g.astype(np.int64), 1)
        # one byte a counter: 255 from one task is "frequent" already
        small = np.minimum(table, 255).astype(np.uint8).reshape(_SKETCH_ROWS, -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(_SKETCH_ROWS), pa.int32()), pa.array([x.tobytes() for x in small], pa.binary())],
            names=["part", "counts"])

    return count


def _sketch_sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
            x = np.frombuffer(counts.as_buffer(), dtype=np.uint8)
            if part in total:
                total[part] += x
            else:
                total[part] = x.astype(np.uint64)
    if total:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()),
             pa.array([np.minimum(x, 65535).astype(np.uint16).tobytes() for x in total.values()], pa.binary())],
            names=["part", "counts"])


def gram_sketch(docs: DataFrame, text: str, n: int, bits: int = SKETCH_BITS) -> np.ndarray:
    """Counts of n-gram hashes by their first ``bits`` bits, at most 65535
    each: 2**bits * 2 bytes on the driver, for an input of any size."""
    parts = docs.select(F.col(text).alias("text")).mapInArrow(_sketch_part(n, bits), "part int, counts binary")
    rows = parts.repartition(_SKETCH_ROWS, "part").mapInArrow(_sketch_sum, "part int, counts binary").collect()
    table = np.zeros((_SKETCH_ROWS, (1 << bits) // _SKETCH_ROWS), dtype=np.uint16)
    for r in rows:
        table[r["part"]] = np.frombuffer(r["counts"], dtype=np.uint16)
    return table.reshape(-1)


def _rows(n: int, num: int, den: int, sketch, bits: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = sketch.value
        shift = np.uint64(64 - bits)
        for batch in batches:
            ids = batch.column(0)
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            keys, sizes, prefixes = [], [], []
            for r, g in shingle_sets(batch.column(1), n):
                m = len(g)
                sizes.append(m)
                if m == 0 or not known[r]:
                    keys.append(None)
                    prefixes.append(g[:0].view(np.int64))
                    continue
                keys.append(set_key(g))
                p = m - -(-num * m // den) + 1
                weight = order[(g >> shift).astype(np.int64)].astype(np.uint64)
                # frequency first, then a hash of the n-gram: the same order everywhere
                rank = (weight << np.uint64(48)) | (W.mix(g) >> np.uint64(16))
                first = np.argpartition(rank, p - 1)[:p] if p < m else np.arange(m)
                first = first[np.argsort(rank[first], kind="stable")]
                prefixes.append(g[first].view(np.int64))
            lengths = np.fromiter((len(x) for x in prefixes), dtype=np.int32, count=len(prefixes))
            offsets = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64))).astype(np.int32)
            values = np.concatenate(prefixes) if prefixes else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))],
                names=["doc_id", "key", "n", "prefix"])

    return make


def _column_terms(num: int, den: int, limit: int):
    """Product terms of prefix columns; input sorted by (gram, n, key). With a
    fifth column, no terms of two classes that have the same label there."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("na", pa.int32()), ("nb", pa.int32()),
                        ("pa", pa.int32()), ("pb", pa.int32()), ("long_column", pa.bool_())])

    def emit(parts):
        if parts:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([p[k] for p in parts]), schema.field(k).type) for k in range(7)],
                schema=schema)

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of the column that a batch's end may cut: its last `limit` entries, and
        # the head of the crowded run of sizes that it is in
        gram, tail, head = None, None, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            g, key, n, pos = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            label = batch.column(4).to_numpy(zero_copy_only=False) if batch.num_columns > 4 else key
            parts = []
            edges = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1], [True])))
            lengths = np.diff(edges)
            # columns of one entry that lie inside the batch have no terms
            for k in np.flatnonzero((lengths > 1) | (edges[:-1] == 0) | (edges[1:] == len(g))):
                s, e = int(edges[k]), int(edges[k + 1])
                if g[s] != gram:
                    gram, tail, head = g[s], None, None
                ck, cn, cp, cl = key[s:e], n[s:e].astype(np.int64), pos[s:e], label[s:e]
                new = np.ones(len(ck), dtype=bool)  # copies: equal classes follow each other
                new[1:] = ck[1:] != ck[:-1]
                if tail is not None:
                    new[0] = ck[0] != tail[0][-1]
                ck, cn, cp, cl = ck[new], cn[new], cp[new], cl[new]
                if len(ck) == 0:
                    continue
                if tail is not None:
                    ak, an, ap, al = (np.concatenate(x) for x in zip(tail, (ck, cn, cp, cl)))
                else:
                    ak, an, ap, al = ck, cn, cp, cl
                old = len(ak) - len(ck)
                # compatible sizes before an entry are a run, as sizes ascend
                j = np.arange(old, len(ak))
                low = np.searchsorted(an * den, an[old:] * num)
                crowded = j - low >= limit
                pairs = np.where(crowded, 0, j - low)
                i = np.repeat(low - np.cumsum(pairs) + pairs, pairs) + np.arange(pairs.sum())
                j = np.repeat(j, pairs)
                ok = al[i] != al[j]
                i, j = i[ok], j[ok]
                if len(i):
                    parts.append((ak[i], ak[j], an[i], an[j], ap[i], ap[j], np.zeros(len(i), dtype=bool)))
                turns = np.flatnonzero(np.diff(np.concatenate(([False], crowded, [False]))))
                for x, y in zip(turns[::2] + old, turns[1::2] + old):
                    if x > old or head is None:  # the entry before is not crowded: all that it meets are kept
                        x = int(low[x - old])
                        head = ak[x], an[x], al[x]
                    take = np.flatnonzero(al[x:y] != head[2]) + x
                    if len(take):
                        z = np.zeros(len(take), dtype=np.int32)
                        parts.append((np.full(len(take), head[0]), ak[take], np.full(len(take), head[1]), an[take], z, z,
                                      np.ones(len(take), dtype=bool)))
                if not crowded[-1]:
                    head = None
                tail = tuple(v[-limit:] for v in (ak, an, ap, al))
            yield from emit(parts)

    return terms, schema


def _whole_sets(n: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # a class is read from the row of its first id that holds its set
            keys = batch.column(0).to_pylist()
            found = [(r, g.view(np.int64)) for r, g in shingle_sets(batch.column(1), n) if set_key(g) == keys[r]]
            batch = batch.take(pa.array([r for r, _ in found], pa.int64()))
            keys, sets = batch.column(0), [g for _, g in found]
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in sets], dtype=np.int64))).astype(np.int32)
            values = np.concatenate(sets) if sets else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [keys, *(batch.column(k) for k in range(2, batch.num_columns)),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))],
                names=["key", *batch.schema.names[2:], "grams"])

    return make


def block_links(keys: np.ndarray, copies: np.ndarray, side: np.ndarray, sets: list[np.ndarray],
                num: int, den: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Exact product of one block: (tree of its links as pairs of keys, linked
    documents per class). ``side`` 0 / 1: the tiles of a pair, of which only
    pairs across count; all 2: a tile with itself."""
    m = len(sets)
    sizes = np.fromiter((len(x) for x in sets), dtype=np.int64, count=m)
    linked = np.zeros(m, dtype=np.int64)
    root = np.arange(m)

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(m), sizes)
    order = np.argsort(column, kind="stable")
    by_column = row[order]
    ends = np.cumsum(np.bincount(column))
    starts = np.concatenate(([0], ends[:-1]))
    at = np.concatenate(([0], np.cumsum(sizes)))
    within = side[0] == 2
    for x in range(m):
        c = column[at[x]:at[x + 1]]
        c = c[ends[c] - starts[c] > 1]
        if len(c) == 0:
            continue
        length = ends[c] - starts[c]
        flat = np.repeat(starts[c] - np.concatenate(([0], np.cumsum(length)[:-1])), length) + np.arange(length.sum())
        overlap = np.bincount(by_column[flat], minlength=m)
        hit = np.flatnonzero(overlap * (num + den) >= num * (sizes + sizes[x]))
        hit = hit[hit > x]
        if not within:
            hit = hit[side[hit] != side[x]]
        if len(hit):
            linked[x] += int(copies[hit].sum())
            linked[hit] += copies[x]
            for y in hit:
                a, b = find(x), find(int(y))
                if a != b:
                    root[max(a, b)] = min(a, b)
    tree = [(int(keys[x]), int(keys[find(x)])) for x in range(m) if find(x) != x]
    return tree, linked


def _unit_links(num: int, den: int):
    """Blocks of a partition one after another; input sorted by unit."""
    schema = pa.schema([("key", pa.int64()), ("other", pa.int64()), ("linked", pa.int64())])

    def work(rows):
        keys = np.array([r[0] for r in rows], dtype=np.int64)
        copies = np.array([r[1] for r in rows], dtype=np.int64)
        side = np.array([r[2] for r in rows], dtype=np.int8)
        tree, linked = block_links(keys, copies, side, [r[3] for r in rows], num, den)
        return ([k for k, _ in tree] + list(keys[linked > 0]), [o for _, o in tree] + [None] * int((linked > 0).sum()),
                [0] * len(tree) + list(linked[linked > 0]))

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, rows, out = None, [], ([], [], [])

        def full():
            return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(out, schema)], schema=schema)

        for batch in batches:
            units = batch.column(0).to_pylist()
            keys, copies, side = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3))
            values = batch.column(4)
            flat = values.values.to_numpy(zero_copy_only=False).view(np.uint64)
            offsets = values.offsets.to_numpy()
            for r, u in enumerate(units):
                if u != unit:
                    if len(rows) > 1:
                        for whole, x in zip(out, work(rows)):
                            whole.extend(x)
                    unit, rows = u, []
                    if len(out[0]) > 50_000:
                        yield full()
                        out = ([], [], [])
                if rows and rows[-1][0] == keys[r]:
                    continue
                rows.append((keys[r], copies[r], side[r], flat[offsets[r]:offsets[r + 1]].copy()))
        if len(rows) > 1:
            for whole, x in zip(out, work(rows)):
                whole.extend(x)
        if out[0]:
            yield full()

    return links, "key long, other long, linked long"


def _candidate_pairs(rows: DataFrame, steps: Steps, num: int, den: int, limit: int, parts: int) -> DataFrame:
    """Step 3 of the module: (a, b), pairs of classes whose components are the blocks."""
    known = rows.where("key is not null")
    size = lambda n: n - F.ceil(n * num / den) + 1  # noqa: E731  of a prefix
    entries = known.agg(F.sum(size(F.col("n")))).first()[0] or 0
    work, _ = _column_terms(num, den, limit)
    rest = F.least(F.col("na") - 1 - F.col("pa"), F.col("nb") - 1 - F.col("pb"))
    possible = (F.col("overlap") + rest) * (num + den) >= (F.col("na") + F.col("nb")) * num
    pairs, labels, begin = None, None, 0
    ends = list(_WAVES) if entries > WAVE_ENTRIES else [8]
    while ends:
        end = ends.pop(0)
        label = [] if labels is None else [F.coalesce("label", "key").alias("label")]
        labelled = known if labels is None else known.join(labels, "key", "left")
        wave = (labelled.select("key", F.col("n").cast("int").alias("n"), *label, F.posexplode("prefix").alias("pos", "gram"))
                .select("gram", "key", "n", "pos", *(["label"] if label else [])))
        if end - begin < 8:
            eighth = F.col("gram").bitwiseAND(F.lit(7))
            wave = wave.where((eighth >= begin) & (eighth < end))
        terms = (wave.repartition(parts, "gram").sortWithinPartitions("gram", "n", "key")
                 .mapInArrow(work, "a long, b long, na int, nb int, pa int, pb int, long_column boolean"))
        terms = terms.select("a", "b", "na", "nb", "pa", "pb", F.lit(1).cast("long").alias("overlap"),
                             F.col("long_column").alias("kept"))
        # of a pair: sizes, last place in the prefixes, n-grams shared so far
        total = (terms if pairs is None else terms.union(pairs)).groupBy("a", "b").agg(
            F.max("na").alias("na"), F.max("nb").alias("nb"), F.max("pa").alias("pa"), F.max("pb").alias("pb"),
            F.sum("overlap").alias("overlap"), F.max("kept").alias("kept"))
        if end == 8:
            return total.where(F.col("kept") | possible).select("a", "b")
        half = (F.col("overlap") >= 2) & (F.col("overlap") * 16 >= F.least(size(F.col("na")), size(F.col("nb"))) * end)
        pairs = steps.write(f"pairs{end}", total.withColumn("kept", F.col("kept") | half))
        if begin:
            steps.drop(f"pairs{begin}")
        if (pairs.agg(F.sum("overlap")).first()[0] or 0) * 8 <= entries * end:
            ends, labels = [8], None  # few pairs: the rest at once
        else:
            kept = pairs.where("kept").select("a", "b")
            kept = kept.union(kept.select("b", "a"))
            low = kept.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("b"), F.least("a", "low").alias("low"))
            # and the smallest of the partners' partners: not all classes of a family have the same ones
            labels = kept.join(low, "b").groupBy(F.col("a").alias("key")).agg(F.min("low").alias("label"))
        begin = end


def _tiled(members: DataFrame, num: int, den: int, tile_grams: int) -> DataFrame:
    """Members of blocks with their tile and the tiles it meets, ``first`` to
    ``last``. The tiles of a block go by bands of sizes, of which only neighbours
    can link (a band is a little wider than the ratio of sizes)."""
    width = max(math.log(den / num), 0.01) * 1.0001
    whole = members.groupBy("block").agg(F.sum("n").alias("grams"))
    members = members.join(whole, "block").withColumn(
        "band", F.when(F.col("grams") > tile_grams, F.floor(F.log("n") / width)).otherwise(0))
    bands = members.groupBy("block", "band").agg(F.ceil(F.sum("n") / tile_grams).cast("int").alias("tiles"))
    by = Window.partitionBy("block").orderBy("band")
    next_to = lambda place, step: F.when(place("band").over(by) == F.col("band") + step, place("tiles").over(by)).otherwise(0)
    bands = bands.select(
        "block", "band", "tiles", (F.sum("tiles").over(by) - F.col("tiles")).cast("int").alias("start"),
        next_to(F.lag, -1).alias("before"), next_to(F.lead, 1).alias("after"))
    return members.join(bands, ["block", "band"]).select(
        "doc_id", "key", "copies", "n", "block",
        (F.col("start") + F.pmod(F.xxhash64("key", F.lit(7)), F.col("tiles"))).cast("int").alias("tile"),
        (F.col("start") - F.col("before")).alias("first"), (F.col("start") + F.col("tiles") - 1 + F.col("after")).alias("last"))


def _units(whole: DataFrame, n: int, wave: int, waves: int) -> DataFrame:
    """Sets of the units of one wave, once per unit: (unit, key, copies, side, grams)."""
    tile = F.col("tile")
    unit = lambda other: F.concat_ws("/", "block", F.least(tile, other), F.greatest(tile, other))
    others = F.sequence("first", "last")
    if waves > 1:
        others = F.filter(others, lambda other: F.pmod(F.xxhash64(unit(other)), F.lit(waves)) == wave)
    whole = whole.withColumn("others", others)
    if waves > 1:
        whole = whole.where(F.size("others") > 0)
    whole = whole.mapInArrow(_whole_sets(n), "key long, copies long, block long, tile int, first int, last int, others array<int>, "
                             "grams array<long>")
    other = F.col("other")
    return whole.withColumn("other", F.explode("others")).select(
        unit(other).alias("unit"), "key", "copies",
        F.when(tile == other, 2).when(tile < other, 0).otherwise(1).cast("byte").alias("side"), "grams")


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5,
                       threshold: tuple[int, int] = (4, 5), pair_limit: int = 24, tile_grams: int = 1 << 21,
                       sketch_bits: int = SKETCH_BITS) -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_shingles, n_links, component_id).

    Two documents link when ``den * |A n B| >= num * |A u B|`` for their sets of
    distinct word n-grams, ``threshold = (num, den)``. ``n_links`` counts the
    documents it links with (copies included), ``component_id`` is the smallest
    id reachable by links, its own included.

    Null or wordless texts: size 0, no link, their own component. Repeated rows
    link with each other as any copies do. A row without id keeps its size and
    links with nothing. Other columns are not read. An empty table gives an
    empty result.

    ``pair_limit``: prefix columns up to this many classes of like size are paired
    directly (longer ones go another, equally exact way, see the module). ``tile_grams``:
    n-grams that one tile of a block holds.
    """
    spark = docs.sparkSession
    num, den = threshold
    steps = Steps(spark)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    table = spark.sparkContext.broadcast(gram_sketch(source, "text", n, sketch_bits))
    rows = steps.write("rows", source.mapInArrow(_rows(n, num, den, table, sketch_bits),
                                                 "doc_id long, key long, n long, prefix array<long>"))
    table.unpersist()
    classes = steps.write("classes", rows.where("key is not null").groupBy("key").agg(
        F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.max("n").alias("n")))

    pairs = _candidate_pairs(rows, steps, num, den, pair_limit, parts)
    groups = steps.write("groups", connected_components(pairs, steps))
    steps.drop(*(f"pairs{end}" for end in _WAVES))

    members = groups.select(F.col("node").alias("key"), F.col("component").alias("block")).union(
        groups.select("component", "component").distinct())
    members = members.join(classes, "key")
    members = members.select(F.col("first_id").alias("doc_id"), "key", "copies", "n", "block")
    members = steps.write("members", _tiled(members, num, den, tile_grams))

    number, sent = members.agg(F.count(F.lit(1)), F.sum(F.col("n") * (F.col("last") - F.col("first") + 1))).first()
    grams = rows.agg(F.sum("n")).first()[0] or 0
    waves = 1 if (sent or 0) <= max(grams // 2, WAVE_GRAMS) else -(-sent // max(grams // 4, WAVE_GRAMS))
    chosen = members if number > BROADCAST_IDS else F.broadcast(members)
    whole = source.join(chosen, "doc_id").select("key", "text", "copies", "block", "tile", "first", "last")
    if waves > 1:
        whole = steps.write("texts", whole)
    work, schema = _unit_links(num, den)
    found = None
    for wave in range(waves):
        links = steps.write(f"links{wave}", _units(whole, n, wave, waves).repartition(parts, "unit")
                            .sortWithinPartitions("unit", "key").mapInArrow(work, schema))
        found = links if found is None else found.union(links)
    steps.drop("members", "groups", "texts")

    labels = connected_components(found.where("other is not null").select(F.col("key").alias("a"), F.col("other").alias("b")),
                                  steps)
    counts = found.groupBy("key").agg(F.sum("linked").alias("linked"))
    named = (classes.join(labels.select(F.col("node").alias("key"), F.col("component").alias("label")), "key", "left")
             .withColumn("label", F.coalesce("label", "key")))
    lowest = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    named = named.join(lowest, "label").join(counts, "key", "left").select(
        "key", "component_id", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = rows.select("doc_id", "key", F.col("n").alias("n_shingles")).join(named, "key", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      F.coalesce("component_id", "doc_id").alias("component_id"))
