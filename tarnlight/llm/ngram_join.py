"""N-gram Jaccard join over word shingles.

Documents become sets of hashed word shingles. Sets of equal content are one
node. Nodes enter tiles of a size band, so that any two that reach the threshold
meet in one; there are two kinds of tile keys.

``subsets``: in a band whose pairs differ by at most d shingles, the shingles are
dealt to d + 1 + spare classes by their hash. Two sets that differ by d or less
have spare + 1 classes alike, so each may leave out its ``spare`` most common ones:
a set enters the tiles of its d + 1 rarest classes. A class is the rarer, the more
shingles it has and the rarer they are (by whole numbers, so that equal classes
rank alike); empty ones come last. A key is the hash of a whole class, so texts
that are not near copies hardly ever meet, even if they share lines or phrases.

``prefix``: the key is one of a set's rarest shingles, as many as the threshold
leaves out, and one more. Fewer keys at low thresholds, but texts that share rare
shingles meet, in numbers that grow faster than the texts.

The order of rarity comes from a count sketch over all documents (``SLOTS`` counters,
so its broadcast has a fixed size); any order gives the same result.

Keys are dealt by ranges of (key, node), so a key that a third of all sets has is
spread over tasks, and only keys that two nodes share go on. Inside the tiles a
parity bitmap of hashed shingles bounds the overlap from above (the bits that
differ are no more than the shingles that differ); what passes is decided by
intersecting the sorted shingle arrays.

A tile's nodes are first compared with the tile's smallest and largest node, and
joined into components. In tiles of more than ``FEW`` nodes that still hold several
components, nodes meet their closest partner in a few of their tiles, in blocks of at
most ``BLOCK`` rows a side. Then smaller tiles list their pairs of different
components, without bitmaps, and each pair is compared once, however many tiles it
shares; in larger ones those outside a tile's largest component meet all others of the
tile, closest ones first, more of them in each round, until no pair that passes
the bound is left between two components. This keeps a group of thousands of near
copies linear and is still exact: two nodes of a tile are either compared or
already connected. No pair is verified twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NOT_SPACE, WordHashes, components, cut, fresh, grouped, lists, long_batches, map_batches, mix, small, swept, table, written

SLOTS = 1 << 20
#: Bits of the filter that picks texts to shingle again: so many an id, at most FILTER_BITS (64 MB). A denser filter
#: lets more texts through, which the join on the node then drops.
BITS_AN_ID, FILTER_BITS = 16, 1 << 29
BLOCK = 1024
#: Nodes of a tile up to which it lists its pairs; classes left out, as a share of the shingles that a pair may differ by.
FEW, LEFT_OUT = 64, 0.3
SEEN = 500_000
#: Rounds, and tiles of a node in each, of the closest-partner step; then partners of a node in a tile's first full round.
TURNS, KEYS_A_TURN, WIDTH = 2, 3, 2
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D, 0x94D049BB133111EB], np.uint64)


def shingles(text: str | None, words: int, hashes: WordHashes) -> np.ndarray:
    """64-bit hashes of the word shingles of ``text``, in order.

    A-Z are lower-cased; words are runs without ASCII white space. With fewer
    words than a shingle has, the whole sequence is the one shingle.
    """
    h = hashes.of(text.encode("utf-8", "surrogatepass").lower()) if text else ()
    n = len(h)
    if not n:
        return np.empty(0, np.uint64)
    width = min(words, n)
    out = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        out += h[i : n - width + 1 + i] * np.uint64(int(_ODD[i % 8]) * (2 * (i // 8) + 1) % 2**64)
    return mix(out)


def shingle_set(text: str | None, words: int, hashes: WordHashes) -> np.ndarray:
    """The distinct ones, sorted."""
    return np.unique(shingles(text, words, hashes))


def node_of(s: np.ndarray) -> int:
    """Signed 64-bit id of a shingle set."""
    with np.errstate(over="ignore"):
        x = mix(np.array([mix(s + _ODD[1]).sum(dtype=np.uint64) + np.uint64(len(s)) * _ODD[0]], np.uint64))
    return int(x.view(np.int64)[0])


def bitmap(s: np.ndarray) -> bytes:
    """Parity bitmap: bit i is the parity of the shingles whose hash ends in i; two to four bits a shingle."""
    bits = max(64, 1 << len(s).bit_length())
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def fold(b: np.ndarray, size: int) -> np.ndarray:
    """Bitmaps (rows of bytes) folded to ``size`` bytes; parity survives XOR of the halves."""
    while b.shape[-1] > size:
        half = b.shape[-1] // 2
        b = b[..., :half] ^ b[..., half:]
    return b


def bands(n: int, num: int, den: int) -> list[int]:
    """Size bands a set of n shingles enters: its own, and the next if a partner can be there.

    Bounds grow by (den / num)^2, rounded up, so partners are in one band or in
    two neighbouring ones, and half the sets enter one band only.
    """
    own, top = 0, 1
    while n > top:
        top = max(top + 1, -(-top * den * den // (num * num)))
        own += 1
    return [own, own + 1] if den * n >= num * (top + 1) else [own]


def prefix_size(n: int, num: int, den: int) -> int:
    return n - (num * n + den - 1) // den + 1


class Classes:
    """Bands of the smaller set of a pair, and the classes that shingles are dealt to in each."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den
        self.tops = [1]
        self.classes = [self._classes(1, 1)]

    def _classes(self, low: int, top: int) -> tuple[int, int]:
        """(classes, spare) of the band of sizes low to top; no classes where only equal sets can be partners."""
        apart = (top + top * self.den // self.num) * (self.den - self.num) // (self.den + self.num)
        if not apart:
            return 0, 0
        for spare in range(int(LEFT_OUT * apart), 3 * apart + 2):  # until a set hardly ever has more empty classes
            k = apart + 1 + spare
            empty = k * (1 - 1 / k) ** low
            if spare >= empty + 4 * empty**0.5:
                break
        return k, spare

    def of(self, n: int) -> range:
        """Bands where a set of n may meet a partner: those of n and of all smaller partners."""
        while self.tops[-1] < n:
            low = self.tops[-1] + 1
            self.tops.append(max(low, self.tops[-1] * self.den**2 // self.num**2))
            self.classes.append(self._classes(low, self.tops[-1]))
        return range(int(np.searchsorted(self.tops, -(-self.num * n // self.den))), int(np.searchsorted(self.tops, n)) + 1)

    def keys(self, s: np.ndarray, rarity: np.ndarray | None = None) -> np.ndarray:
        """Tile keys of a set; rarity: whole numbers from 1, by slot (none: all alike)."""
        out = [np.empty(0, np.uint64)]
        worth = np.ones(len(s)) if rarity is None else rarity[(s >> np.uint64(44)).astype(np.int64)]
        hashed = mix(s + _ODD[3])
        for band in self.of(len(s)):
            k, spare = self.classes[band]
            if not k:
                continue
            own = (s % np.uint64(k)).astype(np.int64)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashed[np.argsort(own, kind="stable")], dtype=np.uint64)])
            size = np.bincount(own, minlength=k)
            upto = np.cumsum(size)
            place = np.arange(k, dtype=np.uint64)
            key = mix(sums[upto] - sums[upto - size] + size.astype(np.uint64) * _ODD[0] + place * _ODD[1] + np.uint64((band + 1) * int(_ODD[2]) % 2**64))
            out.append(key[np.lexsort((key, -np.bincount(own, weights=worth, minlength=k)))[: k - spare]])
        return np.concatenate(out)


def rarities(counts: np.ndarray) -> np.ndarray:
    """Eighths of a bit by which the shingles of each slot are rarer than the most frequent ones, and 1."""
    if not counts.any():
        return np.ones(len(counts), np.int16)
    seen = np.maximum(counts, counts[counts > 0].min())
    return (1 + np.round(8 * np.log2(seen.max() / seen))).astype(np.int16)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
    for batch in batches:
        if batch.num_rows:
            yield batch, batch.column(1).to_pylist()


def slot_of(column: str, bits: int):
    """Bit of the filter that a value has; a null has one too."""
    return F.pmod(F.xxhash64(column), F.lit(bits))


def _sketch(words: int) -> Callable:
    def run(batches):
        hashes, counts, total = WordHashes(NOT_SPACE), np.zeros(SLOTS, np.int64), 0
        for _, texts in _texts(batches):
            sets = [shingles(t, words, hashes) for t in texts]
            if sets and (both := np.concatenate(sets)).size:
                counts += np.bincount((both >> np.uint64(44)).astype(np.int64), minlength=SLOTS)
                total += both.size
        # Slots that no frequent shingle has are left out: they only hold noise.
        slots = np.flatnonzero(counts >= max(8, 4 * total / SLOTS))
        yield pa.record_batch([pa.array(slots), pa.array(counts[slots])], names=["slot", "n"])

    return run


def _profiles(words: int, num: int, den: int, keyed: str, sketch) -> Callable:
    """Each text's node and size; for a node not seen in this task, its bitmap and keys too. sketch: counts or rarities
    by slot."""

    def run(batches):
        heavy = sketch.value
        hashes, seen, classes = WordHashes(NOT_SPACE), set(), Classes(num, den)
        for batch, texts in _texts(batches):
            nodes, sizes, maps, keys = [], [], [], []
            for t in texts:
                s = shingle_set(t, words, hashes)
                n = len(s)
                node = node_of(s) if n else None
                nodes.append(node)
                sizes.append(n)
                if node is None or node in seen:
                    maps.append(None)
                    keys.append(np.empty(0, np.int64))
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(node)
                if keyed == "subsets":
                    own = classes.keys(s, heavy)
                else:
                    freq = heavy[(s >> np.uint64(44)).astype(np.int64)]
                    p = prefix_size(n, num, den)
                    own = s[np.argsort(freq, kind="stable")[:p]] if freq.any() else s[:p]
                maps.append(bitmap(s))
                keys.append(own.view(np.int64))
            yield pa.record_batch(
                [*batch.columns[:1], *batch.columns[2:], pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(maps, pa.binary()), lists(keys)],
                names=["id", "mark", "node", "n", "bits", "keys"],
            )

    return run


def _shared(batches):
    """Of rows (key, node) sorted by both, those whose key the row before or behind has too, with another node. The
    first and the last key of a task may go on in another task, so they stay."""
    key, node, marked = np.empty(0, np.int64), np.empty(0, np.int64), True
    for batch in batches:
        if not batch.num_rows:
            continue
        key, node = (np.concatenate([held, batch.column(i).to_numpy()]) for i, held in enumerate((key, node)))
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        key, node = key[new], node[new]
        keep = np.zeros(len(key), bool)
        keep[1:] = key[1:] == key[:-1]
        keep[:-1] |= keep[1:]
        keep[0] |= marked
        done = np.flatnonzero(keep[:-1])
        if len(done):
            yield pa.record_batch([pa.array(key[done]), pa.array(node[done])], names=["key", "node"])
        key, node, marked = key[-1:], node[-1:], bool(keep[-1])
    if len(key):
        yield pa.record_batch([pa.array(key), pa.array(node)], names=["key", "node"])


def _banded(num: int, den: int) -> Callable:
    """Tile keys of (key, node, n): the key in each band that a set of n enters."""

    def run(batches):
        known: dict[int, list[int]] = {}
        for batch in batches:
            key, node, n = (batch.column(i).to_numpy() for i in range(3))
            own = [known[x] if x in known else known.setdefault(x, bands(x, num, den)) for x in n.tolist()]
            at = np.repeat(np.arange(len(n)), [len(x) for x in own])
            band = np.array([b for x in own for b in x], np.uint64)
            tile = mix(key[at].view(np.uint64) + (band + np.uint64(1)) * _ODD[2]).view(np.int64)
            yield pa.record_batch([pa.array(tile), pa.array(node[at])], names=["key", "node"])

    return run


def _arrays(words: int, marks) -> Callable:
    """Shingle arrays of the texts whose bit is set."""

    def run(batches):
        own = marks.value
        hashes, seen = WordHashes(NOT_SPACE), set()
        for batch in batches:
            slot = batch.column(0).to_numpy()
            wanted = np.flatnonzero(own[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
            nodes, arrays = [], []
            for t in batch.column(1).take(pa.array(wanted)).to_pylist():
                s = shingle_set(t, words, hashes)
                if not len(s) or (node := node_of(s)) in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(node)
                nodes.append(node)
                arrays.append(s.tobytes())
            if nodes:
                yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array(arrays, pa.binary())], names=["node", "arr"])

    return run


def _bounded(num: int, den: int) -> Callable:
    """Pairs whose bitmaps leave enough overlap."""

    def run(batches):
        for batch in batches:
            na, nb = (batch.column(i).to_numpy() for i in (2, 3))
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())):
                size = min(len(x), len(y))
                apart = int(np.bitwise_count(fold(np.frombuffer(x, np.uint8), size) ^ fold(np.frombuffer(y, np.uint8), size)).sum())
                total = int(na[i] + nb[i])
                keep.append(apart * (den + num) <= total * (den - num))
            yield pa.record_batch([batch.column(0).filter(pa.array(keep, pa.bool_())), batch.column(1).filter(pa.array(keep, pa.bool_()))], names=["a", "b"])

    return run


def _exact(num: int, den: int) -> Callable:
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.intersect1d(x, y, assume_unique=True).size
                keep.append(den * both >= num * (x.size + y.size - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.record_batch([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return run


def _listed(num: int, den: int) -> Callable:
    """Pairs of (key, node, root, n) sorted by key: those of one key with different roots whose sizes allow a link."""

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(i).to_numpy() for i in range(4)])
            rows = rows if held is None else np.concatenate([held, rows], axis=1)
            last = int(np.searchsorted(rows[0], rows[0, -1]))  # the last key may go on in the next batch
            held = rows[:, last:]
            yield from pairs(rows[:, :last])
        if held is not None:
            yield from pairs(held)

    def pairs(rows):
        key, node, root, n = rows
        found = [np.empty((2, 0), np.int64)]
        for step in range(1, len(key)):
            at = np.flatnonzero(key[step:] == key[:-step])
            if not len(at):
                break
            at = at[(root[at] != root[at + step]) & (den * n[at] >= num * n[at + step]) & (den * n[at + step] >= num * n[at])]
            found.append(np.sort(np.stack([node[at], node[at + step]]), axis=0))
        a, b = np.unique(np.concatenate(found, axis=1), axis=1)
        if len(a):
            yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def _tiles(num: int, den: int, width: int) -> Callable:
    """Pairs of different components inside each (key, block, chunk) tile that the bounds leave: for each row asked
    the ``width`` with the fewest differing bits. more: some that the bounds leave were left out."""

    def run(batches):
        for tile in grouped(batches, "tile"):
            rows = tile.select(["key", "block", "chunk", "node", "root", "n", "bits", "probe"]).to_pylist()
            parts: dict[tuple, tuple[list, list]] = {}
            for r in rows:  # the tile is a hash: take different keys that meet in it apart
                parts.setdefault((r["key"], r["block"], r["chunk"]), ([], []))[r["probe"]].append(r)
            a, b, more = [], [], []
            for base, probes in parts.values():
                probes = probes or base
                if not base:
                    continue
                size = min(len(r["bits"]) for r in (*base, *probes))
                bits, n, node, root = (
                    np.stack([fold(np.frombuffer(r["bits"], np.uint8), size) for r in base]),
                    *(np.array([r[c] for r in base], np.int64) for c in ("n", "node", "root")),
                )
                bits = bits.view(np.uint64)
                for r in probes:
                    near = np.flatnonzero((root != r["root"]) & (den * n >= num * r["n"]) & (den * r["n"] >= num * n))
                    if near.size:
                        own = fold(np.frombuffer(r["bits"], np.uint8), size).view(np.uint64)
                        apart = np.bitwise_count(bits[near] ^ own).sum(1, dtype=np.int64)
                        ok = apart * (den + num) <= (n[near] + r["n"]) * (den - num)
                        near, apart = near[ok], apart[ok]
                        left = near.size > width
                        if left:
                            near = near[np.lexsort((node[near], apart))[:width]]
                        a += np.minimum(node[near], r["node"]).tolist()
                        b += np.maximum(node[near], r["node"]).tolist()
                        more += [left] * near.size
            if a:
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(more)], names=["a", "b", "more"])

    return run


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 80, den: int = 100, keys: str = "subsets") -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (smallest id reachable by links).

    Two documents link when ``den * intersection >= num * union`` of their sets
    of ``words``-word shingles. Null and blank texts have the empty set, link
    with nothing and are their own component. Equal texts are one node. Other
    columns are ignored; an id of null gets the component of its text, or null.
    Rows repeated with one id get a row each, by their own text. An empty table
    gives an empty result; very long texts are read whole. ``keys`` is the kind of
    tile keys, ``prefix`` or ``subsets``; both give the same rows. Node ids and
    shingles are 64-bit hashes: two different sets are taken for one with a
    probability of about n^2 / 2^65 over n distinct sets.
    """
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return _linked(src, words, num, den, keys).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def _linked(src: DataFrame, words: int, num: int, den: int, keys: str) -> DataFrame:
    """id, mark (hash of the text), n, root (null for the empty set), component_id (null likewise) of each row of (id, text)."""
    if keys not in ("prefix", "subsets"):
        raise ValueError(f"no such keys: {keys}")
    spark = src.sparkSession
    src = src.select("id", "text", F.xxhash64("text").alias("mark"))
    id_kind = src.schema["id"].dataType.simpleString()

    counted = map_batches(src, _sketch(words), "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    heavy = np.zeros(SLOTS, np.int64)
    heavy[counted["slot"].to_numpy(np.int64)] = counted["n"].to_numpy(np.int64)
    sketch = spark.sparkContext.broadcast(rarities(heavy) if keys == "subsets" else np.minimum(heavy, 2**31 - 1).astype(np.int32))

    profile = map_batches(src, _profiles(words, num, den, keys, sketch), f"id {id_kind}, mark bigint, node bigint, n bigint, bits binary, keys array<bigint>")
    profile, remove = written(profile, "shingles")
    member = profile.select("id", "mark", "node", "n")

    dealt = profile.select(F.explode("keys").alias("key"), "node").repartitionByRange("key", "node").sortWithinPartitions("key", "node")
    with long_batches(spark):
        shared = cut(map_batches(dealt, _shared, "key bigint, node bigint"))
    near = shared.select("node").distinct()
    sig = profile.where("bits IS NOT NULL").select("node", "n", "bits").join(near, "node", "left_semi").groupBy("node").agg(F.first("n").alias("n"), F.first("bits").alias("bits"))
    sig = cut(sig)
    if keys == "prefix":
        with long_batches(spark):
            shared = cut(map_batches(shared.join(sig.select("node", "n"), "node").select("key", "node", "n"), _banded(num, den), "key bigint, node bigint"))
    ends = shared.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi")
    held = cut(shared.join(ends, "key").where("node <> lo").distinct())

    def bounded(pairs: DataFrame) -> DataFrame:
        """Pairs that sizes and bitmaps do not rule out."""
        a, b = (sig.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"bits{c}")) for c in "ab")
        sized = pairs.join(a, "a").join(b, "b").where(f"{den} * na >= {num} * nb AND {den} * nb >= {num} * na")
        return map_batches(sized.select("a", "b", "na", "nb", "bitsa", "bitsb"), _bounded(num, den), "a bigint, b bigint")

    def verified(pairs: DataFrame) -> DataFrame:
        """Those of some bounded pairs that link. Only texts whose id is in a filter over the pairs' ids are shingled again."""
        ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        ids = cut(member.join(ends, "node", "left_semi").groupBy("node").agg(F.min("id").alias("id")).select("id").distinct())
        bits = 1 << 16
        while bits < min(BITS_AN_ID * ids.count(), FILTER_BITS):
            bits *= 2
        words_of = ids.select(slot_of("id", bits).alias("s")).selectExpr("shiftright(s, 5) AS w", "shiftleft(1L, cast(pmod(s, 32L) AS int)) AS m")
        words_of = words_of.groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
        filled = np.zeros(bits // 32, np.uint32)
        filled[words_of.column("w").to_numpy()] = words_of.column("m").to_numpy().astype(np.uint32)
        marks = spark.sparkContext.broadcast(filled.view(np.uint8))
        arrays = map_batches(src.select(slot_of("id", bits).alias("slot"), "text"), _arrays(words, marks), "node bigint, arr binary")
        arrays = arrays.join(ends, "node", "left_semi").groupBy("node").agg(F.first("arr").alias("arr"))
        arrays, forget = written(arrays, "arrays")
        x, y = (arrays.select(F.col("node").alias(c), F.col("arr").alias(f"arr{c}")) for c in "ab")
        links = cut(map_batches(pairs.join(x, "a").join(y, "b").select("a", "b", "arra", "arrb"), _exact(num, den), "a bigint, b bigint"))
        forget()
        marks.destroy()
        return links

    def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
        """Pairs whose nodes are in different components."""
        x, y = (roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
        both = pairs.join(x, "a", "left").join(y, "b", "left")
        return both.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")

    links = tested = None

    def grown(roots: DataFrame | None, pairs: DataFrame) -> DataFrame:
        """Roots once the pairs that link are joined."""
        nonlocal links, tested
        tested = pairs if tested is None else tested.unionAll(pairs)
        more = verified(pairs)
        swept(spark)
        if roots is not None and more.isEmpty():
            return roots
        links = more if links is None else links.unionAll(more)
        return cut(components(links))

    def untested(pairs: DataFrame) -> DataFrame:
        return cut(pairs.join(tested, ["a", "b"], "left_anti"))

    first = held.select(F.col("lo").alias("a"), F.col("node").alias("b")).unionAll(
        held.where("node <> hi").select(F.col("node").alias("a"), F.col("hi").alias("b"))
    )
    first = cut(bounded(first.distinct()))
    # One partner for each node first: it connects most, so that few pairs are left to intersect.
    roots = grown(None, cut(first.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")))
    rest = untested(apart(first, roots))
    if not rest.isEmpty():
        roots = grown(roots, rest)

    # Tiles of three or more nodes that are not yet one component.
    inner = held.where("node <> hi")
    many = cut(inner.select("key", "node").unionAll(inner.select("key", F.explode(F.array("lo", "hi")).alias("node")).distinct()))
    cols = ["key", "node", "root", "n", "bits"]
    spot = lambda k: F.pmod(F.xxhash64("node"), F.col(k)).cast("int")
    every = lambda k: F.sequence(F.lit(0), F.col(k) - 1)

    sizes = many.groupBy("key").count()
    large = many.join(sizes.where(f"count > {FEW}"), "key", "left_semi")
    large, many = cut(large), cut(many.join(sizes.where(f"count <= {FEW}"), "key", "left_semi"))
    swept(spark)

    def still_open(roots: DataFrame) -> DataFrame:
        """Members of large tiles that hold several components, with the tile's largest one and its block counts."""
        own = large.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        shares = own.groupBy("key", "root").agg(F.count("*").alias("c"))
        open_keys = shares.groupBy("key").agg(F.sum("c").alias("m"), F.max_by("root", F.struct("c", "root")).alias("big"), F.max("c").alias("c"), F.count("*").alias("k")).where("k > 1")
        open_keys = open_keys.select("key", "big", F.ceil(F.col("m") / BLOCK).cast("int").alias("nb"), F.ceil((F.col("m") - F.col("c")) / BLOCK).cast("int").alias("nc"))
        return own.join(open_keys, "key")

    def met(tiles: DataFrame, width: int) -> DataFrame:
        tiles = tiles.withColumn("tile", F.xxhash64("key", "block", "chunk")).repartition(F.col("tile")).sortWithinPartitions("tile")
        return cut(map_batches(tiles, _tiles(num, den, width), "a bigint, b bigint, more boolean").groupBy("a", "b").agg(F.max("more").alias("more")))

    # Each node's closest partner in a few of its tiles: linear, and it connects most of a group of near copies.
    for turn in range(TURNS):
        few = F.row_number().over(Window.partitionBy("node").orderBy(F.xxhash64("key", F.lit(turn)))) <= KEYS_A_TURN
        some = still_open(roots).withColumn("few", few).where("few").join(sig, "node")
        found = met(some.select(*cols, spot("nb").alias("block"), F.lit(0).alias("chunk"), F.lit(0).alias("probe")), 1)
        found = untested(found.select("a", "b"))
        if found.isEmpty():
            break
        roots = grown(roots, found)

    # Small tiles: every pair of different components, once.
    own = many.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(sig.select("node", "n"), "node")
    own = own.select("key", "node", "root", "n").repartition(F.col("key")).sortWithinPartitions("key")
    with long_batches(spark):
        listed = cut(map_batches(own, _listed(num, den), "a bigint, b bigint").distinct())
    found = cut(bounded(untested(listed)))
    if not found.isEmpty():
        roots = grown(roots, found)

    # What is still apart is compared in full, closest partners first.
    width, left = WIDTH, True
    while left:
        todo = still_open(roots).join(sig, "node")
        base = todo.select(*cols, spot("nb").alias("block"), F.explode(every("nc")).alias("chunk"), F.lit(0).alias("probe"))
        probe = todo.where("root <> big").select(*cols, F.explode(every("nb")).alias("block"), spot("nc").alias("chunk"), F.lit(1).alias("probe"))
        found = met(base.unionAll(probe), width)
        left = not found.where("more").isEmpty()
        new = untested(found.select("a", "b"))
        if not new.isEmpty():
            roots = grown(roots, new)
        width *= 32

    smallest = member.where("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("id"))
    at = smallest.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = at.groupBy("root").agg(F.min("id").alias("component_id"))
    named = at.select("node", "root").join(least, "root")
    out = cut(member.join(named, "node", "left").select("id", "mark", "n", "root", "component_id"))
    remove()
    return out


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 80, den: int = 100, keys: str = "subsets") -> DataFrame:
    """The rows of ``docs``, of each component only one: that of the smallest id, a null id last, then of the smallest
    text hash.

    A component is made of rows, whatever their ids: rows repeated with one id and
    unrelated texts all stay, and copies without an id leave one. Rows equal in id
    and text leave one. Null and blank texts are no copies and all stay. Very long
    texts are read whole; an empty table stays empty; all columns are kept.
    """
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    own = _linked(src, words, num, den, keys).where("root IS NOT NULL").groupBy("root", "id", "mark").agg(F.count("*").alias("rows"))
    order = F.struct(F.col("id").isNull(), F.col("id"), F.col("mark"))
    best = own.groupBy("root").agg(F.min(order).alias("best"))
    own = cut(own.join(best, "root").select("id", "mark", "rows", (order == F.col("best")).alias("stays")))
    mark, i, m = fresh(docs, "mark"), fresh(docs, "i"), fresh(docs, "m")
    marked = docs.withColumn(mark, F.xxhash64(text_col))

    def rows_in(which: str, how: str) -> DataFrame:
        of = cut(own.where(which).select(F.col("id").alias(i), F.col("mark").alias(m)))
        return marked.join(small(of), F.col(id_col).eqNullSafe(F.col(i)) & (F.col(mark) == F.col(m)), how)

    # Few rows go, so they are listed. A null text has the hash of nothing, which no row of ``own`` has.
    out = rows_in("NOT stays OR rows > 1", "left_anti")
    if not own.where("stays AND rows > 1").isEmpty():
        out = out.unionAll(rows_in("stays AND rows > 1", "left_semi").dropDuplicates([id_col, mark]))
    return out.select(*docs.columns)


def op5_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), words=3, num=90, den=100, keys="subsets")
