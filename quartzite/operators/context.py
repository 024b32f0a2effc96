"""Context models: counts of what followed a context before, and the probabilities and code lengths that come from them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzite.functions.arrow import map_bytes, spread
from quartzite.functions.columns import logit, squash
from quartzite.operators.entropy import BYTES, byte_histogram
from quartzite.sources.tables import table

MAX_ORDER = 16


def stable_order(key: np.ndarray) -> np.ndarray:
    """Stable argsort of whole numbers from 0 on: number and place in one word where they fit, which sorts faster."""
    bits = len(key).bit_length()
    if len(key) == 0 or int(key.max()) >= 1 << (62 - bits):
        return np.argsort(key, kind="stable")
    return np.sort((key.astype(np.int64) << bits) | np.arange(len(key))) & ((1 << bits) - 1)


def seen_before(key: np.ndarray) -> np.ndarray:
    """For each entry, how many equal ones are in front of it."""
    order = stable_order(key)
    s = key[order]
    at = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(at, np.arange(len(s)), 0)) if len(s) else np.zeros(0, np.int64)
    out = np.empty(len(s), np.int64)
    out[order] = np.arange(len(s)) - first
    return out


def contexts(x: np.ndarray, order: int) -> np.ndarray:
    """A number for the `order` bytes before each place from `order` on; equal numbers, equal bytes."""
    n = len(x) - order
    if n <= 0:
        return np.zeros(0, np.int64)
    key = np.zeros(n, np.int64)
    for k in range(order):  # joined in steps, so that the numbers stay small
        key = np.unique(key * 256 + x[k : k + n], return_inverse=True)[1]
    return key


def context_counts(x: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """From place `order` on: how often the context stood before, and how often with this byte after it."""
    c = contexts(x, order)
    return seen_before(c), seen_before(c * 256 + x[order:])


def repeated_contexts(x: np.ndarray, limit: int = MAX_ORDER):
    """For each order up to `limit`: (order, places, number of the context, how often it stood before), by context, then place.

    Places whose context stands only once are left out from there on: a longer one does so, too.
    """
    at, key = np.arange(len(x)), np.zeros(len(x), np.int64)
    for order in range(1, limit + 1):
        keep = at >= order
        at = at[keep]
        key = key[keep] * 256 + x[at - order]
        by = stable_order(key)
        s = key[by]
        new = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        many = np.diff(np.append(first, len(s)))[group] > 1
        before = (np.arange(len(s)) - first[group])[many]
        at, key = at[by[many]], group[many]
        yield order, at, key, before


def matched_order(x: np.ndarray, limit: int = MAX_ORDER) -> np.ndarray:
    """For each place, the longest context of up to `limit` bytes that stood before, all shorter ones having done so, too."""
    out = np.zeros(len(x), np.int64)
    for order, at, _, before in repeated_contexts(x, limit):
        out[at[before > 0]] = order
    return out


def unigram(x: np.ndarray) -> np.ndarray:
    """Adaptive probability of each byte: (1 + times seen) / (256 + place)."""
    return (1 + seen_before(x)) / (256 + np.arange(len(x)))


def repeat_cost(x: np.ndarray, order: int) -> int:
    """Bits if a byte costs 1 where it is the one that followed the same context last time, and 9 elsewhere."""
    c = contexts(x, order)
    at = np.argsort(c, kind="stable")
    s, y = c[at], x[order:][at]
    hit = (s[1:] == s[:-1]) & (y[1:] == y[:-1]) if len(s) else np.zeros(0, bool)
    return 9 * len(x) - 8 * int(hit.sum())


def blended(x: np.ndarray, limit: int = MAX_ORDER) -> float:
    """Bits of a text by the unigram, blended with the longest context of up to `limit` bytes that stood before at each place, the more so the longer it is.

    Probabilities are at least 1e-7 and not normalised again.
    """
    u = unigram(x)
    p = u.copy()
    for order, at, key, before in repeated_contexts(x, limit):
        hit = seen_before(key * 256 + x[at])
        known = before > 0
        at, hit, before = at[known], hit[known], before[known]
        conf = min(0.9999, 0.5 + 0.5 * order / limit)
        p[at] = np.maximum(1e-7, conf * hit / before + (1 - conf) * u[at])
    return float(-np.log2(p).sum())


def binary_counts(x: np.ndarray, step: int = 4, limit: int = 4000) -> tuple[int, int]:
    """Adaptive counts of the lowest bits, halved when they pass a limit: sequential by nature."""
    zero, one = 1, 1
    for b in (x & 1).tolist():
        zero, one = (zero, one + step) if b else (zero + step, one)
        if zero + one > limit:
            zero, one = max(1, zero >> 1), max(1, one >> 1)
    return zero, one


def adaptive_frequency(x: np.ndarray, step: int = 16, limit: int = 32_000) -> tuple[int, int]:
    """(total, largest) frequency after a text: each byte adds `step`, all are halved, 1 at least, when the total passes `limit`."""
    f = np.ones(256, np.int64)
    total = 256
    for b in x.tolist():
        f[b] += step
        total += step
        if total > limit:
            f = np.maximum(1, f >> 1)
            total = int(f.sum())
    return total, int(f.max())


def cumulative(hist: DataFrame) -> DataFrame:
    """Exclusive prefix sums of the frequencies of 256 symbols: a row for each symbol, so the array fits a row."""
    pairs = F.array_sort(F.collect_list(F.struct("b", "n")))
    all_rows = hist.groupBy().agg(pairs.alias("p")).select(F.posexplode("p").alias("i", "x"), "p")
    return all_rows.select("x.b", "x.n", F.aggregate(F.slice("p", 1, F.col("i")), F.lit(0).cast("long"), lambda a, v: a + v["n"]).alias("cum"))


def frequencies(hist: DataFrame, scale: int = 65_536) -> DataFrame:
    """Whole-number frequencies for a coder: at least 1, rounded half to even; with each symbol's code length."""
    total = hist.groupBy().agg(F.sum("n").alias("total"))
    p = hist.join(F.broadcast(total), F.lit(True)).withColumn("p", F.col("n") / F.col("total"))  # one row
    return p.select("b", F.greatest(F.lit(1.0), F.rint(F.col("p") * scale)).cast("long").alias("freq"), (-F.log2("p")).alias("bits"), "p")


def _docs(s, d, fn, out, many=False):
    return map_bytes(spread(table(s, d, "documents").select("doc_id", "text")), "text", fn, out, ["doc_id"], many)


def _matched(x: np.ndarray):
    o = matched_order(x)
    return len(x), int(o.sum()), int(o.max(initial=0))


def _counts(x: np.ndarray):
    for order, at, key, before in repeated_contexts(x):
        hit = seen_before(key * 256 + x[at])
        yield order, max(0, len(x) - order), int((before > 0).sum()), int(before.sum()), int((hit > 0).sum()), int(hit.sum())


def _hist(s, d):
    return byte_histogram(table(s, d, "documents")).select("b", "n")


def _window(x: np.ndarray):
    """Sum of the last 16 bytes before each place, times the place: the ring of recent context."""
    c = np.concatenate([[0], np.cumsum(x.astype(np.int64))])
    i = np.arange(len(x))
    return len(x), int(((c[i] - c[np.maximum(0, i - 16)]) * (i + 1)).sum())


QUERIES = {
    "q_ppm_counts_k": lambda s, d: _docs(s, d, _counts, "order int, n long, contexts_seen long, context_sum long, symbols_seen long, symbol_sum long", many=True),
    "q_ppm_matched_order": lambda s, d: _docs(s, d, _matched, "n long, order_sum long, longest int"),
    "q_unigram_prob": lambda s, d: _docs(s, d, lambda x: (len(x), round(float(-np.log2(unigram(x)).sum()), 3) + 0.0), "n long, bits double"),
    "q_repeat_cost": lambda s, d: _docs(s, d, lambda x: (repeat_cost(x, 1), repeat_cost(x, 2), repeat_cost(x, 4)), "bits1 long, bits2 long, bits4 long"),
    "q_ppm_blend": lambda s, d: _docs(s, d, lambda x: (round(blended(x), 3) + 0.0,), "bits double"),
    "q_context_ring": lambda s, d: _docs(s, d, _window, "n long, weighted_sum long"),
    # halving depends on the order of the bytes: no SQL
    "q_binary_counts": lambda s, d: _docs(s, d, binary_counts, "zero long, one long"),
    "q_adaptive_freq": lambda s, d: _docs(s, d, adaptive_frequency, "total long, largest long"),
    "q_cum_freq": lambda s, d: cumulative(_hist(s, d)),
    "q_freq_scale": lambda s, d: frequencies(_hist(s, d)).select("b", "freq"),
    "q_code_length": lambda s, d: frequencies(_hist(s, d)).select("b", F.round("bits", 6).alias("bits")),
    "q_logit": lambda s, d: frequencies(_hist(s, d)).select("b", F.round(logit(F.col("p")), 6).alias("stretched"), F.round(squash(logit(F.col("p"))), 6).alias("back")),
}

def _lags(k: int) -> str:
    return "concat(" + ", ".join(f"chr(256 + lag(b, {i}) OVER w)" for i in range(1, k + 1)) + ")"


def _ctx(k: int, key: str) -> str:
    return f"SELECT {key}, {k} AS k, pos, b, {_lags(k)} AS c FROM b WINDOW w AS (PARTITION BY {key} ORDER BY pos)"


_MATCH = ", ".join(f"c{k} AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id, c ORDER BY pos) > 1 AS hit FROM ({_ctx(k, 'doc_id')}) WHERE pos >= {k})" for k in range(1, MAX_ORDER + 1))
_ORDERS = " ".join(f"LEFT JOIN c{k} ON b.doc_id = c{k}.doc_id AND b.pos = c{k}.pos" for k in range(1, MAX_ORDER + 1))
_LONGEST = "CASE " + " ".join(f"WHEN NOT coalesce(c{k}.hit, false) THEN {k - 1}" for k in range(1, MAX_ORDER + 1)) + f" ELSE {MAX_ORDER} END"
_P = "WITH h AS (SELECT b, count(*) AS n FROM b GROUP BY b), p AS (SELECT b, n, n / CAST(sum(n) OVER () AS DOUBLE) AS p FROM h)"
_LOGIT = "ln(least(greatest(p, 1e-4), 0.9999) / (1 - least(greatest(p, 1e-4), 0.9999)))"
_RANKS = "SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id, c ORDER BY pos) - 1 AS n, row_number() OVER (PARTITION BY doc_id, c, b ORDER BY pos) - 1 AS m FROM ({rows}) WHERE pos >= {k}"
_SEEN = "SELECT doc_id, {k} AS k, count(*) AS n, count(CASE WHEN n > 0 THEN 1 END) AS a, sum(n) AS sa, count(CASE WHEN m > 0 THEN 1 END) AS e, sum(m) AS se FROM (" + _RANKS + ") GROUP BY doc_id"
_KNOWN = "SELECT doc_id, pos, {k} AS k, m / CAST(n AS DOUBLE) AS q FROM (" + _RANKS + ") WHERE n > 0"
ORACLE_SQL = {
    "q_ppm_counts_k": f"WITH {BYTES}, z AS ({' UNION ALL '.join(_SEEN.format(k=k, rows=_ctx(k, 'doc_id')) for k in range(1, MAX_ORDER + 1))}) SELECT doc_id, CAST(o.k AS INTEGER) AS \"order\", coalesce(n, 0) AS n, coalesce(a, 0) AS contexts_seen, CAST(coalesce(sa, 0) AS BIGINT) AS context_sum, coalesce(e, 0) AS symbols_seen, CAST(coalesce(se, 0) AS BIGINT) AS symbol_sum FROM (SELECT doc_id, unnest(range(1, {MAX_ORDER + 1})) AS k FROM documents) o LEFT JOIN z USING (doc_id, k)",
    "q_ppm_matched_order": f"WITH {BYTES}, {_MATCH}, m AS (SELECT b.doc_id, {_LONGEST} AS o FROM b {_ORDERS}) SELECT doc_id, count(o) AS n, CAST(coalesce(sum(o), 0) AS BIGINT) AS order_sum, CAST(coalesce(max(o), 0) AS INTEGER) AS longest FROM documents LEFT JOIN m USING (doc_id) GROUP BY doc_id",
    "q_unigram_prob": f"WITH {BYTES}, u AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id, b ORDER BY pos) / CAST(256 + pos AS DOUBLE) AS p FROM b) SELECT doc_id, count(p) AS n, round(coalesce(-sum(log2(p)), 0.0), 3) AS bits FROM documents LEFT JOIN u USING (doc_id) GROUP BY doc_id",
    "q_repeat_cost": f"WITH {BYTES}, " + ", ".join(f"r{k} AS (SELECT doc_id, sum(CASE WHEN lag_b = b THEN 1 ELSE 0 END) AS h FROM (SELECT doc_id, b, lag(b) OVER (PARTITION BY doc_id, c ORDER BY pos) AS lag_b FROM ({_ctx(k, 'doc_id')}) WHERE pos >= {k}) GROUP BY doc_id)" for k in (1, 2, 4)) + ", n AS (SELECT doc_id, count(*) AS n FROM b GROUP BY doc_id) SELECT doc_id, " + ", ".join(f"CAST(9 * coalesce(n, 0) - 8 * coalesce(r{k}.h, 0) AS BIGINT) AS bits{k}" for k in (1, 2, 4)) + " FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN r1 USING (doc_id) LEFT JOIN r2 USING (doc_id) LEFT JOIN r4 USING (doc_id)",
    "q_ppm_blend": f"WITH {BYTES}, u AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id, b ORDER BY pos) / CAST(256 + pos AS DOUBLE) AS p FROM b), x AS ({' UNION ALL '.join(_KNOWN.format(k=k, rows=_ctx(k, 'doc_id')) for k in range(1, MAX_ORDER + 1))}), l AS (SELECT doc_id, pos, max(k) AS k, arg_max(q, k) AS q FROM x GROUP BY doc_id, pos), y AS (SELECT u.doc_id, CASE WHEN k IS NULL THEN p ELSE greatest(1e-7, least(0.9999, 0.5 + 0.5 * k / {MAX_ORDER}.0) * q + (1 - least(0.9999, 0.5 + 0.5 * k / {MAX_ORDER}.0)) * p) END AS p FROM u LEFT JOIN l USING (doc_id, pos)) SELECT doc_id, round(coalesce(-sum(log2(p)), 0.0), 3) AS bits FROM documents LEFT JOIN y USING (doc_id) GROUP BY doc_id",
    "q_context_ring": f"WITH {BYTES}, w AS (SELECT doc_id, pos, coalesce(sum(b) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 16 PRECEDING AND 1 PRECEDING), 0) AS s FROM b) SELECT doc_id, count(s) AS n, CAST(coalesce(sum(s * (pos + 1)), 0) AS BIGINT) AS weighted_sum FROM documents LEFT JOIN w USING (doc_id) GROUP BY doc_id",
    "q_cum_freq": f"WITH {BYTES}, h AS (SELECT b, count(*) AS n FROM b GROUP BY b) SELECT b, n, CAST(coalesce(sum(n) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS cum FROM h",
    "q_freq_scale": f"{_P.replace('WITH ', f'WITH {BYTES}, ')} SELECT b, CAST(greatest(1.0, round_even(p * 65536, 0)) AS BIGINT) AS freq FROM p",
    "q_code_length": f"{_P.replace('WITH ', f'WITH {BYTES}, ')} SELECT b, round(-log2(p), 6) AS bits FROM p",
    "q_logit": f"{_P.replace('WITH ', f'WITH {BYTES}, ')} SELECT b, round({_LOGIT}, 6) AS stretched, round(1 / (1 + exp(-least(greatest({_LOGIT}, -12.0), 12.0))), 6) AS back FROM p",
}
