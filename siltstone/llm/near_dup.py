"""Near-duplicate grouping by SuperMinHash, banding, verification and union-find.

1. Every text's set of word shingles gets a SuperMinHash signature: each element
   has a random permutation of the slots, and a slot's value is the least (rank of
   the slot in an element's permutation, random fraction).  Ranks are evaluated in
   layers over all elements, and a text stops at the first layer after which all
   its slots are taken, since later ranks are larger.
2. Texts with one set are one class; its least id stands for it.
3. Classes that share a band of the signature are candidates.  A first pass pairs
   each with the least id of the band's bucket; pairs whose sketches rule out the
   similarity are dropped, the rest are confirmed on full sets.
4. Buckets that still hold several components are compared in blocks, the members
   outside the bucket's largest component against all others, and what the
   sketches leave is confirmed too.  So no pair of a bucket is left out, and no
   group is expanded into its pairs.
5. Confirmed links are grouped by union-find within partitions and then by
   alternating star contraction between them.

A sketch is a byte of each slot and a set's parities: each element flips one of
2,048 bits.  Two sets differ in at least as many elements as their parities differ
in bits, which rules a pair out for certain.  With 32 bands of 4 slots a pair at the
similarity 0.8 shares no bucket with a probability of 5e-8, and has too few equal
slot bytes with one of 1e-8.

Defined cases: texts that are null or without words have no shingles and link with
nothing; null doc_id links with nothing; rows of one doc_id are one node and are
returned as often as they come; ties do not matter; other columns are not read.
``drop_near_duplicates`` takes every row for a document, whatever its id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm._hashing import GOLDEN, U64, mix, shingle_sets
from siltstone.llm._runtime import free_name, materialize, named, ship_package, shuffle_partitions, utf8_slices
from siltstone.llm._skew import HOT, bits_for, bitmap, flagged, only_keys, spread_join

SLOTS, BAND = 128, 4
SLICE_BYTES = 2_000_000
PARITY_BITS = 2048
#: Members of a hot text's chunk, members outside the main component of a block, members of a salted part.
CHUNK, BLOCK, SALT = 32, 256, 256
#: Links that one task groups by itself.
FEW_LINKS = 500_000


def superminhash(elements: np.ndarray, offs: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """Signatures (texts x slots) of sets of 64-bit elements; sets must not be empty."""
    n = len(offs) - 1
    owner = np.repeat(np.arange(n), np.diff(offs))
    values = np.full(n * slots, ~U64(0))

    def layer(j: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r = mix(h + U64((j + 1) * int(GOLDEN) & 0xFFFFFFFFFFFFFFFF))
        return j + ((r >> U64(32)) * U64(slots - j) >> U64(32)).astype(np.int64), U64(j) << U64(32) | r & U64(0xFFFFFFFF)

    place, value = layer(0, elements)
    np.minimum.at(values, owner * slots + place, value)
    grid = values.reshape(n, slots)
    active = np.flatnonzero(grid.max(axis=1) == ~U64(0))
    if len(active) == 0:
        return grid
    chosen = np.isin(owner, active) if len(active) < n else slice(None)
    h, own, first = elements[chosen], owner[chosen], place[chosen]
    order = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(h), 1))
    rows = np.arange(len(h))
    order[rows, first], order[:, 0] = 0, first
    for j in range(1, slots):
        place, value = layer(j, h)
        slot = order[rows, place]
        order[rows, place] = order[:, j]
        order[:, j] = slot
        np.minimum.at(values, own * slots + slot, value)
        still = grid[active].max(axis=1) == ~U64(0)
        if still.all():
            continue
        active = active[still]
        if len(active) == 0:
            break
        live = np.zeros(n, bool)
        live[active] = True
        keep = live[own]
        if keep.sum() < 0.7 * len(keep):
            h, own, order = h[keep], own[keep], order[keep]
            rows = np.arange(len(h))
    return grid


def sketch_bytes(signatures: np.ndarray) -> np.ndarray:
    return (mix(signatures) & U64(255)).astype(np.uint8)


def parity_bytes(elements: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Parities of each set: every element flips one of ``PARITY_BITS`` bits."""
    n = len(offs) - 1
    flips = np.zeros(n * PARITY_BITS, np.uint8)
    bit = (mix(elements ^ U64(0x5851F42D4C957F2D)) % U64(PARITY_BITS)).astype(np.int64)
    np.bitwise_xor.at(flips, np.repeat(np.arange(n), np.diff(offs)) * PARITY_BITS + bit, 1)
    return np.packbits(flips.reshape(n, PARITY_BITS), axis=1)


class Screen:
    """Whether sketches (slot bytes and parities) and sizes of two sets allow the similarity.

    Of sets of a and b elements at ``percent`` or more at most
    ``(100 - percent) * (a + b) / (100 + percent)`` elements are in one of them only.
    """

    def __init__(self, percent: int):
        share = percent / 100
        # Equal slot bytes that a pair of the similarity has but for one in a hundred million (5.6 standard deviations).
        self.least = int(SLOTS * share - 5.6 * (SLOTS * share * (1 - share)) ** 0.5)
        self.percent = percent

    def __call__(self, x: np.ndarray, a: np.ndarray, y: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rows of bytes x and y, which broadcast, of sets of a and b elements."""
        out = (x[..., :SLOTS] == y[..., :SLOTS]).sum(axis=-1) >= self.least
        flipped = np.bitwise_count(x[..., SLOTS:] ^ y[..., SLOTS:]).sum(axis=-1, dtype=np.int64)
        return out & (flipped * (100 + self.percent) <= (100 - self.percent) * (a + b)) & (100 * np.minimum(a, b) >= self.percent * np.maximum(a, b))


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band, the band's number within."""
    n, slots = signatures.shape
    parts = mix(signatures).reshape(n, slots // BAND, BAND)
    key = np.tile(np.arange(1, slots // BAND + 1, dtype=np.uint64) * GOLDEN, (n, 1))
    for k in range(BAND):
        key = mix(key + parts[:, :, k])
    return key.view(np.int64)


_SIGNED = "row bigint, doc_id bigint, n_shingles bigint, f1 bigint, f2 bigint, sketch binary, bands array<bigint>"


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """Number, set size, fingerprint, sketch and band keys of every row of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for lo, hi, data, offs in utf8_slices(batch.column(1), SLICE_BYTES):
                sets, at = shingle_sets(data, offs, width)
                sizes = np.diff(at)
                full = np.flatnonzero(sizes)
                prints = np.zeros((2, hi - lo), np.uint64)
                sketches, bands = [None] * (hi - lo), [None] * (hi - lo)
                if len(full):
                    starts = at[full]
                    prints[0, full] = np.add.reduceat(mix(sets), starts)
                    prints[1, full] = np.add.reduceat(mix(sets ^ GOLDEN), starts)
                    signed = superminhash(sets, np.append(starts, at[-1]))
                    sketched = np.hstack((sketch_bytes(signed), parity_bytes(sets, np.append(starts, at[-1]))))
                    for i, s, b in zip(full.tolist(), sketched, band_keys(signed)):
                        sketches[i], bands[i] = s.tobytes(), b
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + hi - lo)), batch.column(0).slice(lo, hi - lo), pa.array(sizes), *(pa.array(f.view(np.int64)) for f in prints), pa.array(sketches, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    ["row", "doc_id", "n_shingles", "f1", "f2", "sketch", "bands"],
                )
                row += hi - lo

    return docs.mapInArrow(run, _SIGNED)


def likely(pairs: DataFrame, sketches: DataFrame, screen: Screen) -> DataFrame:
    """Pairs (a, b) of a written table whose sketches allow the similarity.  ``sketches``: (doc_id, n_shingles, sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                x, y = (np.frombuffer(b"".join(part.column(k).to_pylist()), np.uint8).reshape(part.num_rows, -1) for k in (2, 3))
                a, b = (part.column(k).to_numpy(zero_copy_only=False) for k in (4, 5))
                yield part.select([0, 1]).filter(pa.array(screen(x, a, y, b)))

    near = only_keys(sketches, ["doc_id"], _ends(pairs), 2 * pairs.count())
    a = near.select(F.col("doc_id").alias("a"), F.col("sketch").alias("x"), F.col("n_shingles").alias("p"))
    b = near.select(F.col("doc_id").alias("b"), F.col("sketch").alias("y"), F.col("n_shingles").alias("q"))
    met = spread_join(pairs, a, ["a"], _frequent(pairs, "a"))
    return spread_join(met, b, ["b"], _frequent(pairs, "b")).select("a", "b", "x", "y", "p", "q").mapInArrow(run, "a bigint, b bigint").distinct()


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id")))


def _frequent(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > HOT).select(key)


def confirmed(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs of a written table with ``100 * intersection >= percent * union`` on their full sets.

    Every a's partners are split into chunks of about ``CHUNK``; a chunk streams a's
    text and then its partners', so nothing gathers a hot text's partners.  Only texts
    of pairs are shuffled.
    """
    spark = docs.sparkSession
    counts = pairs.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    dealt = spread_join(pairs, counts, ["a"], _frequent(pairs, "a")).select("a", "b", F.pmod(F.xxhash64("b"), F.col("chunks")).alias("chunk"))
    routes = dealt.select(F.col("a").alias("doc_id"), "a", "chunk", F.lit(0).alias("side")).distinct().unionByName(dealt.select(F.col("b").alias("doc_id"), "a", "chunk", F.lit(1).alias("side")))
    routes = materialize(routes, "routes")
    texts = only_keys(docs.where("doc_id IS NOT NULL"), ["doc_id"], routes.select("doc_id"), routes.count())
    rows = spread_join(routes, texts, ["doc_id"], _frequent(routes, "doc_id"))
    rows = rows.select("a", "chunk", "side", "doc_id", "text").repartition(shuffle_partitions(spark), "a", "chunk").sortWithinPartitions("a", "chunk", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, base = None, []
        for batch in batches:
            pairs = []
            heads = [batch.column(k).to_pylist() for k in range(4)]
            for lo, hi, data, offs in utf8_slices(batch.column(4), SLICE_BYTES):
                sets, at = shingle_sets(data, offs, width)
                for i in range(lo, hi):
                    a, chunk, side, doc = (h[i] for h in heads)
                    own = sets[at[i - lo] : at[i - lo + 1]]
                    if (a, chunk) != key:
                        key, base = (a, chunk), []
                    if side == 0:
                        base.append(own)
                        continue
                    for other in base:
                        common = _common(own, other)
                        if common and 100 * common >= percent * (len(own) + len(other) - common):
                            pairs.append((a, doc))
                            break
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*pairs)], ["a", "b"])

    return rows.mapInArrow(run, "a bigint, b bigint").distinct()


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    where = np.searchsorted(y, x)
    where[where == len(y)] = 0
    return int((y[where] == x).sum()) if len(y) else 0


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over a partition's links: a link from each node to its root."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p] if p in parent else p
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if parent[x] != x]
    for lo in range(0, len(nodes), 50_000):
        part = nodes[lo : lo + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())], ["u", "v"])


def components(links: DataFrame) -> DataFrame:
    """(doc_id, component): the least id that each linked id reaches.

    Links are first contracted by union-find within partitions.  While they are more
    than one task should hold, large and small stars alternate, until nothing changes
    or few are left; the number of rounds grows with the logarithm of the longest path.
    """
    edges = materialize(links.select(F.col("a").alias("u"), F.col("b").alias("v")).mapInArrow(_forest, "u bigint, v bigint"), "forest")
    state = None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        if now.n <= FEW_LINKS:
            edges = materialize(edges.repartition(1).mapInArrow(_forest, "u bigint, v bigint"), "forest")
            break
        state = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = materialize(spread_join(both, least, ["u"], _frequent(both, "u")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "stars")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = spread_join(large, least, ["u"], _frequent(large, "u")).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = materialize(small.select("e.u", "e.v").where("u <> v").distinct(), "stars")
    return edges.select(F.col("u").alias("doc_id"), F.col("v").alias("component"))


def leftover_pairs(buckets: DataFrame, found: DataFrame, sketches: DataFrame, screen: Screen) -> DataFrame:
    """Likely pairs of a bucket's members in different components, other than with its leader.

    ``buckets``: (key, doc_id, leader, size).  In each bucket the members outside its
    largest component, in blocks of about ``BLOCK``, meet all members, which are
    salted so that a large bucket spreads over tasks.
    """
    spark = buckets.sparkSession
    parts = F.ceil(F.col("size") / HOT).cast("int")
    members = buckets.where("size > 2 AND doc_id <> leader").join(found, "doc_id", "left")
    members = members.select("key", "doc_id", "size", F.coalesce("component", "doc_id").alias("component"), F.pmod(F.xxhash64("doc_id"), parts).cast("int").alias("part"))
    per = members.groupBy("key", "size", "component").agg(F.count("*").alias("n"))
    main = per.groupBy("key", "size").agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("main"), (F.sum("n") - F.max("n")).alias("minor")).where("minor > 0")
    # A bucket's members meet its main component by parts.
    main = main.select("key", "main", "minor", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    mixed = materialize(members.join(main, ["key", "part"]).drop("part"), "mixed")
    count = mixed.count()
    if not count:
        return spark.createDataFrame([], "a bigint, b bigint")
    near = only_keys(sketches, ["doc_id"], mixed.select("doc_id"), count)
    rows = mixed.join(near, "doc_id")
    blocks = F.ceil(F.col("minor") / BLOCK).cast("int")
    salts = F.ceil(F.col("size") / SALT).cast("int")
    own = lambda n: F.pmod(F.xxhash64("doc_id"), n).cast("int")
    every = lambda n: F.sequence(F.lit(0), n - 1)
    # A row goes once to every block of its bucket as one that is met, and if it is outside the main component once to every salt as one that asks.
    met = F.transform(every(blocks), lambda b: F.struct(b.alias("block"), own(salts).alias("salt"), F.lit(1).alias("side")))
    asks = F.transform(every(salts), lambda x: F.struct(own(blocks).alias("block"), x.alias("salt"), F.lit(0).alias("side")))
    places = F.when(F.col("component") == F.col("main"), met).otherwise(F.concat(met, asks))
    dealt = rows.select("key", F.inline(places), "doc_id", "component", "n_shingles", "sketch").repartition(shuffle_partitions(spark), "key", "block", "salt").sortWithinPartitions("key", "block", "salt", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, grid = None, [], []
        for batch in batches:
            pairs = []
            for k, block, salt, side, doc, component, size, sketch in zip(*(c.to_pylist() for c in batch.columns)):
                if (k, block, salt) != key:
                    key, ids, grid = (k, block, salt), [], []
                if side == 0:
                    ids.append((doc, component, size))
                    grid.append(np.frombuffer(sketch, np.uint8))
                    continue
                if not ids:
                    continue
                if isinstance(grid, list):
                    grid, asked = np.array(grid), np.array(ids, np.int64)
                near = np.flatnonzero(asked[:, 1] != component)
                near = near[screen(grid[near], asked[near, 2], np.frombuffer(sketch, np.uint8), size)]
                pairs += [(min(int(d), doc), max(int(d), doc)) for d in asked[near, 0]]
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*set(pairs))], ["a", "b"])

    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", unique: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row; kept is the component's least id.

    ``unique``: no id comes twice, so ids need not be searched for several texts.
    """
    ship_package(docs.sparkSession)
    screen = Screen(percent)
    source = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text"))
    signed = materialize(signatures(source, width), "signatures")
    real = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    same = ["n_shingles", "f1", "f2"]
    classes = real.groupBy(*same).agg(F.min(F.struct("doc_id", "row")).alias("first"), F.count("*").alias("members"))
    classes = materialize(classes.select(*same, F.col("first.doc_id").alias("rep"), F.col("first.row").alias("row"), "members"), "classes")
    banded = real.select("row", "doc_id", "bands").join(classes.select("row"), "row", "left_semi").select("doc_id", F.explode("bands").alias("key"))
    leaders = banded.groupBy("key").agg(F.min("doc_id").alias("leader"), F.count("*").alias("size")).where("size > 1")
    leaders = materialize(leaders, "leaders")
    # A plain join before a write: where a key is hot, adaptive execution splits its rows, and its leader is one row.
    buckets = materialize(banded.join(leaders, "key"), "buckets")
    sketches = real.select("doc_id", "n_shingles", "sketch")
    stars = materialize(buckets.where("doc_id <> leader").select(F.col("leader").alias("a"), F.col("doc_id").alias("b")).distinct(), "pairs")
    links = materialize(confirmed(materialize(likely(stars, sketches, screen), "likely"), source, width, percent), "links")
    # An id with several texts joins all their classes.
    ends = [f(c).alias(f"{name}_{c}") for c in same for f, name in ((F.min, "least"), (F.max, "most"))]
    differ = " OR ".join(f"least_{c} <> most_{c}" for c in same)
    several = signed.where("doc_id IS NOT NULL").groupBy("doc_id").agg(*ends).where(differ).select("doc_id")
    several = several.limit(0) if unique else materialize(several, "several")
    repeats = not unique and not several.isEmpty()
    if repeats:
        own = real.join(several, "doc_id", "left_semi").join(classes, same).where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct()
        links = materialize(links.select("a", "b").unionByName(own), "links")
    found = components(links)
    left = materialize(leftover_pairs(buckets, found, sketches, screen), "leftover")
    if not left.isEmpty():
        more = materialize(confirmed(left, source, width, percent), "links")
        if not more.isEmpty():
            found = components(links.unionByName(more.select(*links.columns)))
    member = classes.join(found.withColumnRenamed("doc_id", "rep"), "rep", "left").select(*same, F.coalesce("component", "rep").alias("component"))
    rows = spread_join(signed.select("row", "doc_id", *same), member, same, classes.where(F.col("members") > HOT).select(*same), "left")
    if repeats:
        # A row without shingles has no class, but its id may have one elsewhere.
        rows = rows.join(found.select("doc_id", F.col("component").alias("own")), "doc_id", "left").withColumn("component", F.coalesce("component", "own"))
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component", "doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, of one document of each group of linked ones.

    Every row is a document of its own, whatever its id, so only a row whose text is
    linked with that of a row which stays goes.  Of a group the row of the least id
    stays, null being the largest, and of that id the one whose text hashes least.
    """
    row = free_name(docs.columns, "row")
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = near_duplicates(numbered, width, percent, row, text_col, unique=True)
    ranks = numbered.select(F.col(row).alias("doc_id"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"))
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "hash", F.col("doc_id").alias("row"))
    groups = found.where("n_shingles > 0").select("doc_id", "component_id").join(ranks, "doc_id").select("doc_id", "component_id", rank.alias("rank"))
    groups = materialize(groups, "groups")
    first = groups.groupBy("component_id").agg(F.min("rank").alias("first"), F.count("*").alias("members")).where("members > 1")
    first = materialize(first, "groups")
    gone = spread_join(groups, first, ["component_id"], first.where(F.col("members") > HOT).select("component_id")).where("doc_id <> first.row").select(F.col("doc_id").alias(row))
    gone = materialize(gone, "gone")
    # Rows that are certainly not gone need no shuffle.
    bits, maybe = bits_for(gone.count()), free_name(numbered.columns, "maybe")
    rows = flagged(numbered, [row], bitmap(gone, [row], bits), bits, maybe)
    return rows.where(~F.col(maybe)).unionByName(rows.where(maybe).join(gone, row, "left_anti")).select(*named(docs.columns))
