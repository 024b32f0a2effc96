"""Near-duplicate join on word shingles by parity sketches.

Every distinct shingle falls into one of `m` parts of a document's sketch and is XOR-ed into it.  A shingle that only one of
two documents has changes one part, so the number of differing parts is a lower bound of the symmetric difference; with
Jaccard similarity >= num/den that is at most D = (a + b)(den - num)/(den + num).  Sizes go into bands, a band fixes m > D,
and by the pigeonhole principle two linked documents agree on at least m - D parts: they meet by joining on (part, value).
A second, 1024-bit parity sketch (its Hamming distance bounds the same difference) thins the candidates before the sets
themselves are compared.

What keeps it exact: a document with z parts that hold no telling shingle agrees with any partner on a telling part as long as
z < m - D.  The few others (short, or mostly of very frequent shingles) publish all their parts.  What keeps it flat: parts,
not values, are dealt to buckets, so every bucket gets as many rows of every document, however alike the documents are; equal
sets count once; a value that many documents share yields comparisons with one of four pseudo-random members.  Members that
are still in different components after that are compared by their sketches, in blocks and without a row for each pair: first
each brings forward its closest, then a few more; where a member may have still more, the sets themselves are dealt to its
block's tasks, every pair that the sketches allow is verified there, and only a spanning forest of what holds leaves the task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzite.llm.common import arrow_batches, components, drop, materialize, new_path, width
from quartzite.llm.scan import U, give_back, mix, shingle_sets, text_chunks

RATIO = 1.5
SKETCH_BITS = 1024
#: Documents of a group that are compared with each other at once; larger groups go through leaders.
SMALL_GROUP = 8
#: Members of a group, and shingles of these, that one task compares with one another.
BLOCK, BLOCK_SHINGLES = 2048, 1 << 20
#: Partners that a member brings forward in a round, one after the other.
NEAREST = (1, 16, 256)
#: Groups that are broadcast at most; beyond that their members are joined by key and one of SALTS.
SENT_GROUPS, SALTS = 200_000, 32
#: A shingle in this share of all documents (and in MIN_HEAVY at least) doesn't make a part telling.
HEAVY_SHARE, MIN_HEAVY, MAX_HEAVY = 0.005, 64, 1 << 20
#: Signatures that one bucket may hold.
BUCKET_ROWS = 1 << 20
#: Members that one task compares, about.
DEALT_ROWS = 1 << 17
LINK = "a long, b long, ra long, rb long"


class Bands:
    """Size bands with their number of parts, for similarity num/den."""

    def __init__(self, num: int, den: int, top: int = 1 << 31):
        self.num, self.den = num, den
        lo, los, his = 1, [], []
        while lo <= top:
            hi = max(lo, int(lo * max(RATIO, den / num + 0.01)))
            los.append(lo)
            his.append(hi)
            lo = hi + 1
        self.lo, self.hi = np.array(los), np.array(his)
        d = 2 * self.hi * (den - num) // (den + num)
        self.m = d + 1 + np.where(d > 0, 2 + -(-6 * d // 100), 0)

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.lo, n, side="right") - 1

    def spare(self, n: np.ndarray, band: np.ndarray) -> np.ndarray:
        """How many parts may be without a telling shingle: m - D - 1."""
        partner = np.minimum(self.hi[band], n * self.den // self.num)
        return self.m[band] - (n + partner) * (self.den - self.num) // (self.den + self.num) - 1


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, shingles, document within ids) of runs of rows of a batch with columns id, text."""
    ids = batch.column(0)
    for i, j, raw, offs in text_chunks(batch.column(1)):
        yield ids.slice(i, j - i), *shingle_sets(raw, offs, k)


#: Shingles of one document that are worked on at once.
SLICE = 1 << 18


def _class(h: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The id of each document's set: equal sets, equal ids."""
    out = np.zeros(len(n), np.uint64)
    has = n > 0
    if len(n) == 1:
        out[0] = sum((int(mix(h[i : i + SLICE] + U(0x1234567)).sum(dtype=np.uint64)) for i in range(0, len(h), SLICE)), 0) & (1 << 64) - 1
    elif has.any():
        out[has] = np.add.reduceat(mix(h + U(0x1234567)), first[has])
    return mix(out + n.astype(np.uint64)).view(np.int64)


def _profile(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Per document: id, n, class, parity sketch.  Rows without sketch carry shingle counts: (shingle, documents)."""
    held, n_docs = [], 0

    def frequent() -> Iterator[pa.RecordBatch]:
        v, c = np.unique(np.concatenate(held), return_counts=True)
        often = c >= max(2, -(-n_docs // 1000))
        if often.any():
            yield pa.RecordBatch.from_arrays([pa.nulls(int(often.sum()), pa.int64()), pa.array(c[often].astype(np.int64)), pa.array(v[often].view(np.int64)), pa.nulls(int(often.sum()), pa.binary())], ["id", "n", "cls", "sketch"])

    for batch in batches:
        for ids, h, doc in _sets(batch, k):
            n = np.bincount(doc, minlength=len(ids))
            first = np.cumsum(n) - n
            bits = np.zeros(len(ids) * SKETCH_BITS, np.int64)
            for i in range(0, len(h), SLICE):
                bits += np.bincount(doc[i : i + SLICE] * SKETCH_BITS + (h[i : i + SLICE] & U(SKETCH_BITS - 1)).astype(np.int64), minlength=len(bits))
            bits &= 1
            packed = np.packbits(bits.astype(bool)).tobytes()
            w = SKETCH_BITS // 8
            yield pa.RecordBatch.from_arrays([ids, pa.array(n.astype(np.int64)), pa.array(_class(h, first, n)), pa.array([packed[i * w : i * w + w] for i in range(len(ids))], pa.binary())], ["id", "n", "cls", "sketch"])
            if len(h) < 1 << 19 or len(ids) > 1:  # one set has no shingle twice
                held.append(h)
                n_docs += len(ids)
            if sum(map(len, held)) > 1 << 19:
                yield from frequent()
                held, n_docs = [], 0
    if held:
        yield from frequent()


def _signatures(batches: Iterator[pa.RecordBatch], k: int, bands: Bands, heavy, layout: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, keys, classes, sizes): the telling parts of each document, packed by bucket."""
    heavy = heavy.value
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def flush() -> Iterator[pa.RecordBatch]:
        bucket, key, cls, n = (np.concatenate(x) for x in zip(*held, strict=True))
        names, place, which = np.unique(cls, return_index=True, return_inverse=True)
        sizes = n[place].astype(np.uint32)
        order = np.lexsort((key, bucket))
        bucket, key, which = bucket[order], key[order], which[order]
        same = np.zeros(len(key), bool)  # equal sets give equal rows: one is enough
        same[1:] = (bucket[1:] == bucket[:-1]) & (key[1:] == key[:-1]) & (which[1:] == which[:-1])
        bucket, key, which = bucket[~same], key[~same], which[~same].astype(np.uint32)
        at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        ends = np.append(at[1:], len(bucket))
        rows = []
        for i, j in zip(at, ends, strict=True):
            own, idx = np.unique(which[i:j], return_inverse=True)
            rows.append((int(bucket[i]), key[i:j].tobytes(), idx.astype(np.uint32 if len(own) > 65536 else np.uint16).tobytes(), names[own].tobytes(), sizes[own].tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32())] + [pa.array([r[c] for r in rows], pa.binary()) for c in (1, 2, 3, 4)], ["bucket", "keys", "idx", "classes", "sizes"])

    size = 0

    def hold(band: np.ndarray, p: np.ndarray, value: np.ndarray, cls: np.ndarray, n: np.ndarray) -> None:
        nonlocal size
        key = mix(value ^ mix((band.astype(np.uint64) << U(40)) + p.astype(np.uint64)))
        ranges, subs = layout["ranges"][band], layout["subs"][band].astype(np.uint64)
        bucket = layout["base"][band] + (p * ranges // bands.m[band]) * layout["subs"][band] + (key % subs).astype(np.int64)
        held.append((bucket, key, cls, n))
        size += len(key)

    for batch in batches:
        for ids, h, doc in _sets(batch, k):
            n = np.bincount(doc, minlength=len(ids))
            cls = _class(h, np.cumsum(n) - n, n)
            own = bands.of(np.maximum(n, 1))
            up = bands.of(np.maximum(n * bands.den // bands.num, 1))
            if len(ids) == 1 and len(h) > SLICE:
                del doc
                for band in range(int(own[0]), min(int(own[0]) + 1, int(up[0])) + 1):
                    for p, value in _long_parts(h, band, bands, heavy):
                        hold(np.full(len(p), band), p, value, np.full(len(p), cls[0]), np.full(len(p), n[0]))
                        yield from flush()
                        held, size = [], 0
                continue
            light = ~np.isin(h, heavy) if len(heavy) else np.ones(len(h), bool)
            for lift in (0, 1):
                docs = np.flatnonzero((n > 0) & (own + lift <= up))
                if not len(docs):
                    continue
                band = own[docs] + lift
                m = bands.m[band]
                local = np.full(len(ids), -1)
                local[docs] = np.arange(len(docs))
                use = local[doc] >= 0
                d, x, lit = local[doc][use], h[use], light[use]
                part = (((x >> U(16)) * m[d].astype(np.uint64)) >> U(48)).astype(np.int64)
                base = np.cumsum(m) - m
                slot = base[d] + part  # ascending, as x ascends within a document
                at = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
                value = np.bitwise_xor.reduceat(mix(x), at)
                telling = np.logical_or.reduceat(lit, at)
                z = m - np.bincount(d[at], weights=telling, minlength=len(docs)).astype(np.int64)
                bad = z > bands.spare(n[docs], band)
                keep = telling | bad[d[at]]
                s, v, who = slot[at][keep], value[keep], d[at][keep]
                if bad.any():  # their empty parts, too
                    every = np.concatenate([np.arange(base[q], base[q] + m[q]) for q in np.flatnonzero(bad)])
                    empty = every[~np.isin(every, slot[at])]
                    s, v, who = np.concatenate([s, empty]), np.concatenate([v, np.zeros(len(empty), np.uint64)]), np.concatenate([who, np.searchsorted(base, empty, side="right") - 1])
                hold(band[who], s - base[who], v, cls[docs][who], n[docs][who])
            if size > 1 << 19:
                yield from flush()
                held, size = [], 0
    if held:
        yield from flush()


def _long_parts(h: np.ndarray, band: int, bands: Bands, heavy: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(parts, values) that one very large set publishes, a slice of its shingles after the other; slices end where a part ends."""
    m = int(bands.m[band])
    # the smallest shingle of each slice's first part
    first = [-(-(p << 48) // m) << 16 for p in range(0, m, max(1, m * SLICE // len(h)))]
    cuts = [*np.searchsorted(h, np.array(first, np.uint64)).tolist(), len(h)]
    ends = [*((c >> 16) * m >> 48 for c in first[1:]), m]

    def slices() -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        low = 0
        for i, j, end in zip(cuts[:-1], cuts[1:], ends, strict=True):
            x = h[i:j]
            part = (((x >> U(16)) * U(m)) >> U(48)).astype(np.int64)
            at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(x) else np.zeros(0, np.int64)
            light = ~np.isin(x, heavy) if len(heavy) else np.ones(len(x), bool)
            yield low, end, part[at], np.bitwise_xor.reduceat(mix(x), at) if len(at) else np.zeros(0, np.uint64), np.logical_or.reduceat(light, at) if len(at) else np.zeros(0, bool)
            low = end

    bad = m - sum(int(t.sum()) for *_, t in slices()) > bands.spare(np.array([len(h)]), np.array([band]))[0]
    for low, end, part, value, telling in slices():
        if bad:  # all parts, the empty ones, too
            every = np.zeros(end - low, np.uint64)
            every[part - low] = value
            yield np.arange(low, end), every
        else:
            yield part[telling], value[telling]


def _pairs(key: np.ndarray, cls: np.ndarray, n: np.ndarray, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(a, b, False) for candidates whose sizes allow a link, (key, class, True) for the members of groups that went through leaders."""
    order = np.argsort(key)
    key = key[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    more = ~(new & np.append(new[1:], True))
    key, cls, n = key[more], cls[order][more], n[order][more]
    if not len(key):
        return
    rank = mix(cls.view(np.uint64) ^ mix(key & U(3)))  # four orders of the documents, by key
    order = np.lexsort((rank, key))
    key, cls, n = key[order], cls[order], n[order]
    fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])])
    key, cls, n = key[fresh], cls[fresh], n[fresh]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(at, len(key)))
    a, b = [], []

    def allow(x: np.ndarray, y: np.ndarray) -> None:
        p, q = n[x].astype(np.int64), n[y].astype(np.int64)
        fits = np.minimum(p, q) * den >= np.maximum(p, q) * num
        a.append(cls[x[fits]])
        b.append(cls[y[fits]])

    for s in range(2, SMALL_GROUP + 1):
        own = at[size == s]
        for i in range(s - 1):
            for j in range(i + 1, s):
                allow(own + i, own + j)
    big = np.repeat(size > SMALL_GROUP, size)
    if big.any():
        leader = np.repeat(at, size)
        rest = np.flatnonzero(big & (leader != np.arange(len(key))))
        allow(leader[rest], rest)
        yield key[big].view(np.int64), cls[big], True
    if a:
        a, b = np.concatenate(a), np.concatenate(b)
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        order = np.lexsort((hi, lo))
        lo, hi = lo[order], hi[order]
        one = np.concatenate([[True], (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])]) & (lo != hi) if len(lo) else np.zeros(0, bool)
        yield lo[one], hi[one], False


def _meet(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """The buckets of one partition, one after the other."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
    for batch in batches:
        for bucket, keys, idx, classes, sizes in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            own = np.frombuffer(classes, np.int64)
            idx = np.frombuffer(idx, np.uint32 if len(own) > 65536 else np.uint16)
            held.setdefault(bucket, []).append((np.frombuffer(keys, np.uint64), own[idx], np.frombuffer(sizes, np.uint32)[idx]))
    for bucket in list(held):
        key, cls, n = (np.concatenate(x) for x in zip(*held.pop(bucket), strict=True))
        for a, b, member in _pairs(key, cls, n, num, den):
            for i in range(0, len(a), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(a[i : i + (1 << 17)]), pa.array(b[i : i + (1 << 17)]), pa.array(np.full(len(a[i : i + (1 << 17)]), member))], ["a", "b", "member"])
    give_back()


def _hamming(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Pairs whose sizes and parity sketches allow the similarity."""
    for batch in batches:
        na, nb = (batch.column(i).to_numpy(zero_copy_only=False) for i in (4, 5))
        sa, sb = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(-1, SKETCH_BITS // 64) for i in (6, 7))
        apart = np.bitwise_count(sa ^ sb).sum(axis=1, dtype=np.int64)
        ok = (apart * (den + num) <= (na + nb) * (den - num)) & (np.minimum(na, nb) * den >= np.maximum(na, nb) * num)
        yield batch.select([0, 1, 2, 3]).filter(pa.array(ok))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list]]:
    """Rows sorted by the first two columns, group by group: these two, and the other columns as arrays."""
    rest = None
    for batch in batches:
        rest = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        key, cell = (rest.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        at = np.append(0, np.flatnonzero((key[1:] != key[:-1]) | (cell[1:] != cell[:-1])) + 1)
        for i, j in zip(at[:-1], at[1:], strict=True):
            yield int(key[i]), int(cell[i]), rest.slice(i, j - i).columns[2:]
        rest = rest.slice(at[-1])
    if rest is not None and rest.num_rows:
        yield rest.column(0)[0].as_py(), rest.column(1)[0].as_py(), rest.columns[2:]


def _distances(bits: np.ndarray, own: np.ndarray, right: np.ndarray) -> np.ndarray:
    far = np.zeros((len(own), len(right)), np.int64)
    for w in range(bits.shape[1]):
        far += np.bitwise_count(bits[own, w][:, None] ^ bits[right, w][None, :])
    return far


NEAR = "a long, b long, key long, cell long"


def _closest(batches: Iterator[pa.RecordBatch], num: int, den: int, most: int) -> Iterator[pa.RecordBatch]:
    """For each member of a group, the `most` closest of those in other components that sizes and sketches allow: (a, b); and (a, null, key, cell) where more do."""
    found: list[np.ndarray] = []
    more: list[tuple[int, int, int]] = []

    def out() -> pa.RecordBatch:
        x = np.unique(np.concatenate([np.zeros((2, 0), np.int64), *found], axis=1), axis=1)
        rest = np.array(more, np.int64).reshape(-1, 3)
        null = pa.nulls(x.shape[1], pa.int64())
        cols = ((x[0], rest[:, 0]), (x[1], pa.nulls(len(rest), pa.int64())), (null, rest[:, 1]), (null, rest[:, 2]))
        return pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in pair]) for pair in cols], ["a", "b", "key", "cell"])

    for key, cell, (blk, node, n, comp, sketch) in _groups(batches):
        blk, node, n, comp = (c.to_numpy(zero_copy_only=False) for c in (blk, node, n, comp))
        bits = np.frombuffer(b"".join(sketch.to_pylist()), np.uint64).reshape(len(node), -1)
        if (comp == comp[0]).all():
            continue
        left, right = (np.flatnonzero(blk == blk.min()), np.flatnonzero(blk == blk.max()))
        for i in range(0, len(left), 64):
            own = left[i : i + 64]
            far = _distances(bits, own, right)
            big, small = np.maximum(n[own][:, None], n[right][None, :]), np.minimum(n[own][:, None], n[right][None, :])
            ok = (comp[own][:, None] != comp[right][None, :]) & (far * (den + num) <= (big + small) * (den - num)) & (small * den >= big * num)
            far[~ok] = np.iinfo(np.int64).max
            count = ok.sum(axis=1)
            if most == 1:
                x = np.flatnonzero(count)
                y = far[x].argmin(axis=1)
            else:
                k = min(most, far.shape[1])
                y = np.argpartition(far, k - 1, axis=1)[:, :k]
                x, place = np.nonzero(np.take_along_axis(ok, y, axis=1))
                y = y[x, place]
                more += [(int(node[own[r]]), key, cell) for r in np.flatnonzero(count > most)]
            if len(x):
                a, b = node[own[x]], node[right[y]]
                found.append(np.stack([np.minimum(a, b), np.maximum(a, b)]))
        if sum(f.shape[1] for f in found) > 1 << 20:
            yield out()
            found, more = [], []
    if found or more:
        yield out()


def _settle(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Verified links between the components of each pair of blocks, as a forest: every pair that sizes and sketches allow is compared by its sets."""
    for _, _, (blk, node, n, comp, sketch, sets) in _groups(batches):
        blk, node, n, comp = (c.to_numpy(zero_copy_only=False) for c in (blk, node, n, comp))
        names, tree = np.unique(comp, return_inverse=True)
        if len(names) < 2:
            continue
        bits = np.frombuffer(b"".join(sketch.to_pylist()), np.uint64).reshape(len(node), -1)
        shingles = [np.frombuffer(x, np.uint64) for x in sets.to_pylist()]
        left, right = (np.flatnonzero(blk == blk.min()), np.flatnonzero(blk == blk.max()))
        a, b = [], []
        for i in left.tolist():
            big, small = np.maximum(n[i], n[right]), np.minimum(n[i], n[right])
            far = _distances(bits, np.array([i]), right)[0]
            maybe = right[(tree[right] != tree[i]) & (far * (den + num) <= (big + small) * (den - num)) & (small * den >= big * num)]
            if not len(maybe):
                continue
            values = np.concatenate([shingles[j] for j in maybe])
            at = np.minimum(np.searchsorted(shingles[i], values), len(shingles[i]) - 1)
            common = np.add.reduceat((shingles[i][at] == values).astype(np.int64), np.cumsum(n[maybe]) - n[maybe])
            for j in maybe[common * den >= num * (n[i] + n[maybe] - common)].tolist():
                if tree[j] != tree[i]:
                    tree[tree == tree[j]] = tree[i]
                    a.append(node[i])
                    b.append(node[j])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _shingles(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, h, doc in _sets(batch, k):
            n = np.bincount(doc, minlength=len(ids))
            ends = np.cumsum(n)
            yield pa.RecordBatch.from_arrays([pa.array(_class(h, ends - n, n)), pa.array([h[e - c : e].tobytes() for c, e in zip(n, ends, strict=True)], pa.binary())], ["cls", "shingles"])


def _verify(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = []
        for x, y in zip(batch.column(4), batch.column(5), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = np.sort(np.concatenate([x, y]))
            common = int((both[1:] == both[:-1]).sum())
            ok.append(common * den >= num * (len(x) + len(y) - common))
        yield batch.select([0, 1, 2, 3]).filter(pa.array(ok, pa.bool_()))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per document: (id, n_shingles, component_id), linked where the Jaccard similarity is >= num/den.

    Words are the runs of non-blank characters, A-Z lower-cased; a document's set is its distinct `k`-word shingles, or the
    whole sequence where it has fewer words.  Null, empty and blank texts have an empty set and are linked with nothing.
    Shingles and sets are compared by 64-bit hashes.  Repeated rows give repeated rows, and an id that stands at several texts has each
    text's links; a null id keeps its row and has component_id null unless its set has another id.  Long texts are read whole, an
    empty table gives no row, other columns are ignored whatever their names.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    bands = Bands(num, den)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    profile = materialize(src.mapInArrow(partial(_profile, k=k), "id long, n long, cls long, sketch binary"), "profile")
    per_doc = profile.where("sketch is not null")
    classes = materialize(per_doc.where("n > 0").groupBy("cls").agg(F.min("id").alias("rep"), F.min("n").alias("n"), F.min("sketch").alias("sketch")).where("rep is not null"), "classes")

    total = classes.count()
    often = max(MIN_HEAVY, int(HEAVY_SHARE * total))
    # at most (mean set size / HEAVY_SHARE) shingles can be that frequent; MAX_HEAVY bounds what is sent, not what is found
    heavy = profile.where("sketch is null").groupBy("cls").agg(F.sum("n").alias("n")).where(F.col("n") >= often).orderBy(F.desc("n")).limit(MAX_HEAVY)
    heavy = np.sort(np.array([r[0] for r in heavy.select("cls").toLocalIterator()], dtype=np.int64)).view(np.uint64)

    # how many signatures each band will get, and so its buckets: a few dozen bands at most
    size = profile.where("sketch is not null and n > 0").groupBy("n").count()
    edges = F.array(*[F.lit(int(x)) for x in bands.lo])
    band_of = lambda c: F.size(F.filter(edges, lambda e: e <= c)) - 1
    size = size.select(F.explode(F.array_distinct(F.array(band_of(F.col("n")), band_of(F.floor(F.col("n") * den / num))))).alias("band"), "count")
    load = np.zeros(len(bands.lo), np.int64)
    for band, c in size.groupBy("band").agg(F.sum("count")).collect():
        load[band] = c * int(bands.m[band])
    p = max(width(spark), -(-int(load.sum()) // BUCKET_ROWS))
    want = np.maximum(1, np.ceil(load * p / max(1, load.sum()))).astype(np.int64)
    ranges = np.minimum(want, bands.m)
    subs = np.maximum(1, -(-load // (ranges * BUCKET_ROWS)))
    count = np.where(load > 0, ranges * subs, 0)
    layout = {"ranges": ranges, "subs": subs, "base": np.cumsum(count) - count}

    sent = spark.sparkContext.broadcast(heavy)
    signs = src.mapInArrow(partial(_signatures, k=k, bands=bands, heavy=sent, layout=layout), "bucket int, keys binary, idx binary, classes binary, sizes binary")
    used: dict[str, list[str]] = {}

    def table(df: DataFrame, name: str) -> DataFrame:
        used.setdefault(name, []).append(new_path(spark, name))
        return materialize(df, name, used[name][-1])

    def done(*names: str, but: int = 0) -> None:
        """Delete all tables of these names but the last `but`."""
        drop(spark, *(p for n in names for p in used.get(n, [])[: len(used.get(n, [])) - but]))
        used.update({n: used.get(n, [])[len(used.get(n, [])) - but :] for n in names})

    met = table(signs.repartitionById(max(1, int(count.sum())), F.col("bucket")).mapInArrow(partial(_meet, num=num, den=den), "a long, b long, member boolean"), "met")
    done()  # the shuffle of the signatures is large

    def sets_of(nodes: DataFrame, name: str = "sets") -> DataFrame:
        """(cls, shingles) of the classes `nodes`, from the texts of their representatives."""
        ids = classes.join(nodes.select("cls").distinct(), "cls", "left_semi").select(F.col("rep").alias("id")).distinct()
        # a sort-merge join at every size: what it moves follows the input
        return table(src.join(ids.hint("merge"), "id", "left_semi").mapInArrow(partial(_shingles, k=k), "cls long, shingles binary").dropDuplicates(["cls"]), name)

    def linked(pairs: DataFrame, sets: DataFrame | None = None) -> DataFrame:
        """Of candidate pairs of classes (a, b), those that hold, with their representatives: (a, b, ra, rb)."""
        side = lambda x: classes.select(F.col("cls").alias(x), F.col("rep").alias(f"r{x}"), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
        thin = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ra", "rb", "na", "nb", "sa", "sb").mapInArrow(partial(_hamming, num=num, den=den), LINK)
        thin = table(thin, "pairs")
        if sets is None:
            sets = sets_of(thin.select(F.col("a").alias("cls")).unionByName(thin.select(F.col("b").alias("cls"))))
        set_of = lambda x: sets.select(F.col("cls").alias(x), F.col("shingles").alias(f"s{x}"))
        out = table(thin.join(set_of("a"), "a").join(set_of("b"), "b").select("a", "b", "ra", "rb", "sa", "sb").mapInArrow(partial(_verify, num=num, den=den), LINK), "links")
        done("pairs", "sets")
        return out

    # a node is (representative, class): its component's smallest node has the smallest id, and repeated ids stay apart
    node = lambda x: F.struct(F.col(f"r{x}").alias("rep"), F.col(x).alias("cls"))
    comp = table(components(linked(met.where("not member").select("a", "b").distinct()).select(node("a").alias("a"), node("b").alias("b"))), "comp")
    done("links")
    members = met.where("member").select(F.col("a").alias("key"), F.col("b").alias("cls")).join(classes.select("cls", "n"), "cls")
    def labelled(rows: DataFrame) -> DataFrame:
        """Members of groups with the component that each is in."""
        name = comp.select(F.col("node.cls").alias("cls"), F.col("component.cls").alias("at"))
        return rows.join(name, "cls", "left").withColumn("at", F.coalesce("at", "cls"))

    def cells(label: DataFrame) -> DataFrame:
        """Each member for all pairs of blocks of its group."""
        cut = label.withColumn("blk", F.pmod(F.xxhash64("cls"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        cut = cut.join(classes.select("cls", "sketch"), "cls").withColumn("cell", F.least("blk", "other") * F.col("blocks") + F.greatest("blk", "other"))
        return cut.select("key", "cell", "blk", "cls", "n", "at", "sketch")

    def dealt(cut: DataFrame, rows: int) -> DataFrame:
        parts = max(width(spark), -(-rows // DEALT_ROWS))
        return cut.repartition(parts, "key", "cell").sortWithinPartitions("key", "cell")

    def merged(links: DataFrame) -> DataFrame:
        """`comp` with new links (a, b, ra, rb): only the components that these join are looked at again."""
        was = lambda x: comp.select(F.col("node.cls").alias(x), F.col("component").alias(f"c{x}"))
        more = links.join(was("a"), "a", "left").join(was("b"), "b", "left")
        joined = components(more.select(F.coalesce("ca", node("a")).alias("a"), F.coalesce("cb", node("b")).alias("b"))).select(F.col("node").alias("was"), F.col("component").alias("now"))
        alone = joined.join(comp, F.col("was") == F.col("node"), "left_anti").select(F.col("was").alias("node"), F.col("now").alias("component"))
        out = comp.join(joined, F.col("component") == F.col("was"), "left").select("node", F.coalesce("now", "component").alias("component")).unionByName(alone)
        return table(out, "comp")

    # members of a group in different components: compare across these, by the closest first
    sets = None
    for most in NEAREST:
        label = labelled(members)
        size = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES))
        mixed = label.groupBy("key").agg(F.min("at").alias("lo"), F.max("at").alias("hi"), size.alias("blocks"), F.count("*").alias("size"), F.sum(F.xxhash64("cls").cast("decimal(20,0)")).alias("who")).where("lo < hi")
        # near copies meet in many parts: of groups with the same members one is enough
        mixed = table(mixed.groupBy("size", "who").agg(F.min("key").alias("key"), F.min("blocks").alias("blocks")).select("key", "blocks"), "mixed")
        groups = mixed.count()
        if not groups:
            break
        if groups <= SENT_GROUPS:
            label = label.join(F.broadcast(mixed), "key")
        else:  # a group may hold any share of the rows: its key alone would be one task
            salted = mixed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            label = label.withColumn("salt", F.pmod(F.hash("cls"), F.lit(SALTS))).join(salted, ["key", "salt"]).drop("salt")
        label = table(label, "members")
        done("met")
        done("members", "mixed", but=1)
        sets = sets_of(label, "own") if sets is None else sets  # of all members that may be compared from here on
        near = table(dealt(cells(label), label.count()).mapInArrow(partial(_closest, num=num, den=den, most=most), NEAR), "near")
        comp = merged(linked(near.where("b is not null").select("a", "b").distinct(), sets))
        done("links")
        done("comp", "near", but=1)
        members = label.select("key", "cls", "n")
        if most > 1 and near.where("b is null").isEmpty():
            break  # every pair that was possible has been verified
    else:
        # where a member may have more, all that the sketches allow, in the tasks that hold the sets
        open_cells = near.where("b is null").select("key", "cell").distinct()
        if not open_cells.isEmpty():
            cut = cells(labelled(label.drop("at"))).join(open_cells, ["key", "cell"], "left_semi")
            cut = cut.join(sets, "cls").select("key", "cell", "blk", "cls", "n", "at", "sketch", "shingles")
            rep = lambda x: classes.select(F.col("cls").alias(x), F.col("rep").alias(f"r{x}"))
            found = table(dealt(cut, label.count()).mapInArrow(partial(_settle, num=num, den=den), "a long, b long"), "links")
            comp = merged(found.join(rep("a"), "a").join(rep("b"), "b"))
            done("links")
            done("comp", but=1)
    done("met", "members", "mixed", "near", "own")
    found = comp.select(F.col("node.cls").alias("cls"), F.col("component.rep").alias("component_id"))
    found = classes.select("cls", "rep").join(found, "cls", "left").select("cls", F.coalesce("component_id", "rep").alias("component_id"))
    full = per_doc.where("n > 0").select("id", "n", "cls").join(found, "cls", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
    none = per_doc.where("n = 0").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    return full.unionByName(none)


def op9_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = {
    "op9_jaccard_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + least(len(w), 5) - 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM c LEFT JOIN n USING (doc_id)""",
}
