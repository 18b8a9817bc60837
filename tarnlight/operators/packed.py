"""What tasks do with Arrow batches of texts and of packed rows: tokens, vectors, scores and the first rows of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

from ..functions.text import INDEX_STOP
from .lexical import K1, B

KINDS = "dl bigint, size bigint, terms array<string>, tfs array<int>, buckets array<int>, weights array<bigint>"
#: Bytes of text that are tokenized at once; rows and matched terms that a task ranks at once; cells of a score matrix.
TEXT_BYTES, TILE_ROWS, TILE_TERMS, CELLS = 32 << 20, 4096, 1 << 22, 1 << 21


def half_up(x: np.ndarray, places: int) -> np.ndarray:
    """Non-negative numbers as Spark rounds them: by their shortest decimal form, halves up. In units of the last place."""
    s = x * 10.0**places
    out = np.floor(s + 0.5)
    for i in np.flatnonzero(np.abs(s - np.floor(s) - 0.5) < 1e-6 + np.abs(s) * 1e-15):
        out[i] = float(Decimal(repr(float(x[i]))).scaleb(places).quantize(Decimal(1), ROUND_HALF_UP))
    return out


def lists(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Lengths and all values of a column of lists; null counts as empty."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return lengths, column.flatten()


def tokenized(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Row and token of the index tokens of texts: those of ``functions.text.index_tokens``."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    try:
        # The only letter that Java lowers to one of a-z and a mark.
        low = pc.utf8_lower(pc.replace_substring(texts, "İ", "i̇"))
    except pa.ArrowInvalid:  # bytes that are no text
        texts = pa.array([x.decode("utf-8", "replace") for x in texts.cast(pa.large_binary()).to_pylist()], pa.large_string())
        low = pc.utf8_lower(pc.replace_substring(texts, "İ", "i̇"))
    lengths, flat = lists(pc.split_pattern_regex(low, "[^a-z0-9가-힣]+"))
    good = pc.and_(pc.greater(pc.utf8_length(flat), 1), pc.invert(pc.is_in(flat, pa.array(INDEX_STOP, flat.type))))
    return np.repeat(np.arange(len(texts)), lengths)[good.to_numpy(zero_copy_only=False)], flat.filter(good)


def fnv(terms: pa.Array) -> np.ndarray:
    """32-bit FNV-1a over the characters of each term."""
    out = np.full(len(terms), 2166136261, np.uint32)
    lengths = pc.utf8_length(terms).to_numpy(zero_copy_only=False)
    short = np.flatnonzero(lengths <= 64)
    words = np.array(terms.take(pa.array(short)).to_pylist() or [""], "U64").view(np.uint32).reshape(-1, 64)
    for at in range(int(lengths[short].max()) if len(short) else 0):
        on = short[lengths[short] > at]
        out[on] = (out[on] ^ words[lengths[short] > at, at]) * np.uint32(16777619)
    for i in np.flatnonzero(lengths > 64):
        h = 2166136261
        for c in terms[int(i)].as_py():
            h = (h ^ ord(c)) * 16777619 % 2**32
        out[i] = h
    return out


def vectors(row: np.ndarray, hashes: np.ndarray, tf: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and weight in millionths of the hashed vectors, by row and bucket."""
    cell, at = np.unique(row * size + hashes.astype(np.int64) % size, return_inverse=True)
    n = np.bincount(at, tf, len(cell))
    own = cell // size
    norm = np.sqrt(np.bincount(own, n * n))
    return own, cell % size, half_up(n / norm[own], 6).astype(np.int64)


def listed(row: np.ndarray, rows: int, values: pa.Array, kind: pa.DataType) -> pa.Array:
    """Lists of values by row, which are in order."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(rows + 1)), pa.int32()), values.cast(kind))


def sliced(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``most`` bytes of a column of texts, a row at least."""
    for batch in batches:
        if batch.num_rows:
            size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(size) // most
            cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                yield batch.slice(a, b - a)


def packer(size: int) -> Callable:
    """Texts (last column ``_text``), or terms and their counts (last columns dl, size, terms, tfs), as packed rows."""

    def run(batches):
        batches = iter(batches)
        first = next(batches, None)
        if first is None:
            return
        raw = "_text" in first.schema.names
        every = (b for part in ([first], batches) for b in part)
        for batch in sliced(every, "_text", TEXT_BYTES) if raw else (b for b in every if b.num_rows):
            rows = batch.num_rows
            if raw:
                row, flat = tokenized(batch.column("_text"))
                coded = flat.dictionary_encode()
                words = max(1, len(coded.dictionary))
                cell, tf = np.unique(row * words + coded.indices.to_numpy(), return_counts=True)
                dl = total = np.bincount(row, minlength=rows)
                row, code, known = cell // words, cell % words, coded.dictionary
            else:
                n, flat = lists(batch.column("terms"))
                tf, row = lists(batch.column("tfs"))[1].to_numpy(), np.repeat(np.arange(rows), n)
                coded = flat.dictionary_encode()
                code, known = coded.indices.to_numpy(), coded.dictionary
                dl, total = batch.column("dl"), batch.column("size")
            own, bucket, weight = vectors(row, fnv(known)[code] if len(code) else np.zeros(0, np.uint32), tf, size)
            made = {
                "dl": pa.array(dl, pa.int64()) if raw else dl, "size": pa.array(total, pa.int64()) if raw else total, "terms": listed(row, rows, known.take(pa.array(code)), pa.string()), "tfs": listed(row, rows, pa.array(tf), pa.int32()),
                "buckets": listed(own, rows, pa.array(bucket), pa.int32()), "weights": listed(own, rows, pa.array(weight), pa.int64()),
            }
            rest = {c: batch.column(c) for c in batch.schema.names if c not in made and c != "_text"}
            yield pa.record_batch(rest | made)

    return run


class Asked:
    """A block of queries: their ids, terms, frequencies and, if ``size``, vectors."""

    def __init__(self, part: pa.Table, size: int) -> None:
        ids, terms = (part.column(c).combine_chunks().dictionary_encode(null_encoding="encode") for c in ("query_id", "term"))
        place, col = ids.indices.to_numpy(), terms.indices.to_numpy()
        order = np.lexsort((col, place))
        self.ids, self.terms = ids.dictionary, terms.dictionary.cast(pa.string())
        self.col, self.f = col[order], part.column("qtf").to_numpy()[order].astype(np.float64)
        self.ptr = np.searchsorted(place[order], np.arange(len(self.ids) + 1))
        self.nq = np.diff(self.ptr)
        self.idf = self.avgdl = None
        if size:
            own, bucket, weight = vectors(place[order], fnv(self.terms)[self.col], self.f, size)
            self.dense = np.zeros((len(self.ids), size))
            self.dense[own, bucket] = weight

    def weigh(self, terms, df, n: int, avgdl: float) -> None:
        """Statistics of the whole index; terms that it lacks weigh nothing."""
        df = np.asarray(df.to_numpy(), np.float64)
        at = pc.index_in(self.terms, pa.array(terms.to_pylist(), pa.string())).to_numpy(zero_copy_only=False)
        idf = np.zeros(len(self.terms))
        if len(df):
            known = ~np.isnan(np.asarray(at, float))
            d = df[np.asarray(at, float)[known].astype(np.int64)]
            idf[known] = np.log(1 + (n - d + 0.5) / (d + 0.5))
        self.idf, self.avgdl = idf[self.col], np.full(len(self.ids), float(avgdl))

    def count(self, counts: pa.Table) -> None:
        """Statistics over each query's own candidates: what is -1 for their number and length, or the place of a term."""
        place, what, c, s = (counts.column(x).to_numpy() for x in ("place", "what", "c", "s"))
        n, length, df = np.zeros(len(self.ids)), np.zeros(len(self.ids)), np.zeros(len(self.col))
        n[place[what < 0]], length[place[what < 0]] = c[what < 0], s[what < 0]
        df[what[what >= 0]] = c[what >= 0]
        each = np.repeat(n, self.nq)
        self.idf = np.log(1 + (each - df + 0.5) / (df + 0.5))
        mean = np.divide(length, n, out=np.zeros_like(n), where=n > 0)
        self.avgdl = np.where(mean == 0, 1.0, mean)


def packed_up(found: Asked) -> bytes:
    return cloudpickle.dumps(found)


@dataclass(frozen=True)
class How:
    """words: BM25 (without ``gain``, 0) and overlap; vectors: cosine; both: blended. most: rows a query; least: of the
    overlap; floor, strong: of the score and of a cosine without a word in common."""

    words: bool = False
    gain: bool = True
    vectors: bool = False
    most: int | None = None
    least: float = 0.0
    floor: float = 0.0
    strong: float = 0.55


class Tile:
    """Packed rows that are ranked at once: of their terms only those that are asked."""

    def __init__(self, batches: list[pa.RecordBatch], asked: Asked, how: How) -> None:
        whole = pa.Table.from_batches(batches)
        column = lambda c: whole.column(c).combine_chunks()
        names, self.rows, self.key = whole.schema.names, whole.num_rows, column(whole.schema.names[0])
        self.boost = column("boost").to_numpy(zero_copy_only=False) if "boost" in names else None
        if how.words:
            self.dl = column("dl").to_numpy().astype(np.float64)
            n, col = lists(column("cols"))
            row, col, tf = np.repeat(np.arange(self.rows), n), col.to_numpy(), column("tfs").flatten().to_numpy().astype(np.float64)
            order = np.argsort(col, kind="stable")
            self.row, self.tf = row[order], tf[order]
            self.ptr = np.searchsorted(col[order], np.arange(len(asked.terms) + 1))
        if "asks" in names:
            n, ids = lists(column("asks"))
            place = pc.index_in(ids, asked.ids).to_numpy(zero_copy_only=False).astype(np.int64)
            order = np.argsort(place, kind="stable")
            self.of, self.lift = np.repeat(np.arange(self.rows), n)[order], lists(column("lifts"))[1].to_numpy(zero_copy_only=False)[order]
            self.own = np.searchsorted(place[order], np.arange(len(asked.ids) + 1))
        if how.vectors:
            n, bucket = lists(column("buckets"))
            self.dense = np.zeros((self.rows, asked.dense.shape[1]))
            self.dense[np.repeat(np.arange(self.rows), n), bucket.to_numpy()] = column("weights").flatten().to_numpy()


def with_cols(batch: pa.RecordBatch, asked: Asked) -> pa.RecordBatch:
    """The batch with places among the asked terms instead of terms; those that no query asks for are left out."""
    if "terms" not in batch.schema.names:
        return batch
    n, flat = lists(batch.column("terms"))
    at = pc.index_in(flat, asked.terms)
    good = pc.is_valid(at)
    row = np.repeat(np.arange(batch.num_rows), n)[good.to_numpy(zero_copy_only=False)]
    made = {"cols": listed(row, batch.num_rows, at.filter(good), pa.int32()), "tfs": listed(row, batch.num_rows, batch.column("tfs").flatten().filter(good), pa.int32())}
    return pa.record_batch({c: batch.column(c) for c in batch.schema.names if c not in ("terms", "tfs")} | made)


def tiles(batches: Iterator[pa.RecordBatch], asked: Asked, how: How) -> Iterator[Tile]:
    held, rows, terms = [], 0, 0
    for batch in batches:
        for at in range(0, batch.num_rows, TILE_ROWS):
            part = with_cols(batch.slice(at, TILE_ROWS), asked)
            held, rows, terms = [*held, part], rows + part.num_rows, terms + (len(part.column("cols").flatten()) if how.words else 0)
            if rows >= TILE_ROWS or terms >= TILE_TERMS:
                yield Tile(held, asked, how)
                held, rows, terms = [], 0, 0
    if held:
        yield Tile(held, asked, how)


def pruner(sent) -> Callable:
    def run(batches):
        asked = cloudpickle.loads(sent.value)
        for batch in batches:
            if batch.num_rows:
                yield with_cols(batch, asked)

    return run


def counter(sent) -> Callable:
    """(place, what, c, s) of the candidates of each query: their number and length, and how many have each term."""

    def run(batches):
        asked = cloudpickle.loads(sent.value)
        n, length, df = np.zeros(len(asked.ids), np.int64), np.zeros(len(asked.ids), np.int64), np.zeros(len(asked.col), np.int64)
        for tile in tiles(batches, asked, How(words=True)):
            inside = np.zeros(tile.rows, np.int64)
            for q in range(len(asked.ids)):
                own = tile.of[tile.own[q] : tile.own[q + 1]]
                if len(own):
                    np.add.at(inside, own, 1)
                    n[q] += len(own)
                    length[q] += int(tile.dl[own].sum())
                    for k in range(asked.ptr[q], asked.ptr[q + 1]):
                        t = asked.col[k]
                        df[k] += inside[tile.row[tile.ptr[t] : tile.ptr[t + 1]]].sum()
                    inside[own] = 0
        p, k = np.flatnonzero(n), np.flatnonzero(df)
        place = np.repeat(np.arange(len(asked.ids)), asked.nq)
        yield pa.record_batch({"place": pa.array(np.concatenate([p, place[k]]), pa.int32()), "what": pa.array(np.concatenate([np.full(len(p), -1), k]), pa.int32()), "c": pa.array(np.concatenate([n[p], df[k]]), pa.int64()), "s": pa.array(np.concatenate([length[p], np.zeros(len(k), np.int64)]), pa.int64())})

    return run


class Best:
    """The first rows of each query so far, by score to so many places (null: as it is), ties to the smaller key."""

    def __init__(self, queries: int, most: int, places: int | None = None) -> None:
        self.most, self.places, self.low = most, places, np.full(queries, -np.inf)
        self.unit = 0.0 if places is None else 10.0**-places
        self.held: list[pa.Table] = []
        self.rows = 0

    def narrow(self, lo: int, score: np.ndarray, ok: np.ndarray) -> None:
        """Leave in ``ok`` what can be among the first rows of the queries from ``lo`` on."""
        low = self.low[lo : lo + len(score)]
        ok &= score >= low[:, None]
        many = np.flatnonzero(ok.sum(axis=1) > self.most)
        if len(many):
            few = np.where(ok[many], score[many], -np.inf)
            low[many] = np.maximum(low[many], -np.partition(-few, self.most - 1, axis=1)[:, self.most - 1] - 1.5 * self.unit)
            ok[many] = few >= low[many][:, None]

    def add(self, place: np.ndarray, score: np.ndarray, key: pa.Array, values: list[np.ndarray]) -> None:
        if len(place):
            order = -(score if self.places is None else half_up(score, self.places))
            self.held.append(pa.table({"place": pa.array(place), "order": pa.array(order), "key": key} | {f"v{i}": pa.array(v) for i, v in enumerate(values)}))
            self.rows += len(place)
            if self.rows > 3 * self.most * len(self.low) + (1 << 18):
                self.shrink()

    def shrink(self) -> None:
        rows = pa.concat_tables(self.held)
        rows = rows.take(pc.sort_indices(rows, [("place", "ascending"), ("order", "ascending"), ("key", "ascending")], null_placement="at_start"))
        place = rows.column("place").to_numpy()
        nth = np.arange(len(place)) - np.searchsorted(place, place)
        last = np.flatnonzero(nth == self.most - 1)
        score = -rows.column("order").to_numpy()[last] * (self.unit or 1.0)
        self.low[place[last]] = np.maximum(self.low[place[last]], score - 1.5 * self.unit)
        self.held = [rows.filter(pa.array(nth < self.most)).combine_chunks()]
        self.rows = self.held[0].num_rows

    def rows_of(self, ids: pa.Array) -> Iterator[pa.RecordBatch]:
        """(id, key, values) of the first rows."""
        if self.held:
            self.shrink()
            for x in self.held[0].to_batches(1 << 16):
                yield pa.record_batch([ids.take(x.column(0)), *x.columns[2:]], names=["id", *x.schema.names[2:]])


def ranker(sent, key: str, how: How) -> Callable:
    """Scores of a block of queries against packed rows."""
    both, places = how.words and how.vectors, 8 if how.words and how.vectors else 6

    def run(batches):
        asked = cloudpickle.loads(sent.value)
        names = ["query_id", key, *(["vector_score", "overlap"] if both else ["score", "overlap"] if how.words else ["score"])]
        best = Best(len(asked.ids), how.most, places) if how.most is not None else None
        gain = how.words and how.gain and not both
        shares = [half_up(np.arange(n + 1) / max(n, 1), 6) / 1e6 for n in asked.nq] if both else None
        for tile in tiles(batches, asked, how):
            norm, was = None, None
            step = max(1, CELLS // tile.rows)
            for lo in range(0, len(asked.ids), step):
                hi = min(lo + step, len(asked.ids))
                score = np.zeros((hi - lo, tile.rows))
                met = np.zeros((hi - lo, tile.rows), np.int32) if how.words and (both or best is None) else None
                if how.words:
                    for q in range(lo, hi):
                        own = None if not hasattr(tile, "own") else slice(tile.own[q], tile.own[q + 1])
                        if own is not None and own.start == own.stop:
                            continue
                        line, hits = score[q - lo], None if met is None else met[q - lo]
                        if gain and asked.avgdl[q] != was:
                            was = asked.avgdl[q]
                            norm = tile.tf * (K1 + 1) / (tile.tf + K1 * (1 - B + B * tile.dl[tile.row] / was))
                        for k in range(asked.ptr[q], asked.ptr[q + 1]):
                            a, b = tile.ptr[asked.col[k]], tile.ptr[asked.col[k] + 1]
                            if a < b:
                                rows = tile.row[a:b]
                                if gain:
                                    line[rows] += (asked.f[k] * asked.idf[k]) * norm[a:b]
                                if hits is not None:
                                    hits[rows] += 1
                        if own is not None:
                            inside = np.zeros(tile.rows)
                            inside[tile.of[own]] = tile.lift[own]
                            line *= inside
                        elif both:
                            line[:] = shares[q][hits]
                if both:
                    share, score = score, np.floor(asked.dense[lo:hi] @ tile.dense.T / 1_000_000) / 1e6
                    cosine = score
                    score = 0.75 * cosine + 0.25 * share
                    ok = (cosine > 0) & (score >= how.floor - 1e-9) & ((share > 0) | (cosine >= how.strong))
                elif how.vectors:
                    score = np.floor(asked.dense[lo:hi] @ tile.dense.T / 1_000_000) / 1e6
                    ok = (score > 0) & (score >= how.floor)
                else:
                    if tile.boost is not None:
                        score *= tile.boost[None, :]
                    ok = score > 0 if met is None or hasattr(tile, "own") else met > 0
                    if how.least > 0:
                        ok &= met / np.maximum(asked.nq[lo:hi], 1)[:, None] >= how.least
                if best is not None:
                    best.narrow(lo, score, ok)
                a, b = np.nonzero(ok)
                values = [cosine[a, b], share[a, b]] if both else [score[a, b]]
                if how.words and not both:
                    values.append(met[a, b] / asked.nq[lo + a] if met is not None else np.full(len(a), np.nan))
                if best is not None:
                    best.add(lo + a, score[a, b], tile.key.take(pa.array(b)), values)
                elif len(a):
                    yield pa.record_batch([asked.ids.take(pa.array(lo + a)), tile.key.take(pa.array(b)), *map(pa.array, values)], names=names)
        if best is not None:
            for x in best.rows_of(asked.ids):
                yield x.rename_columns(names)

    return run
