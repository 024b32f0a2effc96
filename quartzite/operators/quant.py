"""Quantised vectors: integers with a scale, masked floats, ternary weights in base 3, and two-of-four sparse weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartzite.functions.columns import mask_value
from quartzite.operators.entropy import FLOATS
from quartzite.sources.tables import table


def doubles(df: DataFrame, id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
    return df.select(id_col, F.transform(col, lambda x: x.cast("double")).alias("v")).where(F.size("v") > 0)


def affine(df: DataFrame, bits: int) -> DataFrame:
    """(id, v, scale, zero, q): each vector's range on 2**bits steps, rounded half to even; a constant vector is zeros with scale 1."""
    top = (1 << bits) - 1
    lo, hi = F.array_min("v"), F.array_max("v")
    out = df.withColumn("scale", F.when(hi > lo, (hi - lo) / top).otherwise(1.0)).withColumn("zero", F.when(hi > lo, F.rint(-lo / F.col("scale"))).otherwise(0.0))
    q = F.transform("v", lambda x: F.least(F.lit(float(top)), F.greatest(F.lit(0.0), F.rint(x / F.col("scale")) + F.col("zero"))))
    return out.withColumn("q", F.when(hi > lo, q).otherwise(F.transform("v", lambda x: F.lit(0.0))))


def dequantized(q: Column, scale: Column, zero: Column) -> Column:
    return F.transform(q, lambda x: (x - zero) * scale)


def mean_square(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x) / F.size(a)


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def packed_nibbles(q: Column) -> Column:
    """Sum over bytes of two four-bit numbers, the first one high; an odd length is padded with 0."""
    return F.aggregate(F.transform(q, lambda x, i: x * F.when(i % 2 == 0, 16).otherwise(1)), F.lit(0.0), lambda s, x: s + x).cast("long")


GROUP = 5


def ternary(df: DataFrame) -> DataFrame:
    """(id, v, scale, t): weights in units of their mean size, taken after padding to whole groups of five, to -1, 0 or 1."""
    n = F.size("v")
    padded = F.ceil(n / GROUP) * GROUP
    scale = F.greatest(total(F.transform("v", F.abs)) / padded, F.lit(1e-8))
    out = df.withColumn("scale", scale)
    return out.withColumn("t", F.transform("v", lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.rint(x / F.col("scale")))).cast("int")))


def base3(t: Column) -> Column:
    """Groups of five trits as numbers under 243; missing ones are 0."""
    groups = F.sequence(F.lit(0), F.ceil(F.size(t) / GROUP).cast("int") - 1)
    trit = lambda i: F.coalesce(F.get(t, i), F.lit(0)) + 1
    return F.transform(groups, lambda g: sum((trit(g * GROUP + k) * 3**k for k in range(1, GROUP)), trit(g * GROUP)))


def trits(b: Column) -> Column:
    return F.array(*((F.floor(b / 3**k) % 3 - 1).cast("int") for k in range(GROUP)))


PAIRS = ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3))


def sparse24(v: Column) -> Column:
    """For each four weights: which two are the largest (an entry of PAIRS; ties to the lower place), and their signs (a bit each, 1 for negative)."""
    x = lambda g, k: F.get(v, g * 4 + k)
    size = lambda g, k: F.abs(x(g, k))
    ahead = lambda g, a, b: (size(g, a) > size(g, b)) | ((size(g, a) == size(g, b)) & F.lit(a < b))
    among = lambda g, k: sum((F.when(ahead(g, j, k), 1).otherwise(0) for j in range(4) if j != k), F.lit(0)) < 2

    def block(g):
        combo = signs = None
        for c, (a, b) in enumerate(PAIRS):
            both = among(g, a) & among(g, b)
            s = F.when(x(g, a) < 0, 1).otherwise(0) + F.when(x(g, b) < 0, 2).otherwise(0)
            combo = F.when(both, c) if combo is None else combo.when(both, c)
            signs = F.when(both, s) if signs is None else signs.when(both, s)
        return F.struct(combo.alias("combo"), signs.alias("signs"))

    return F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / 4).cast("int") - 1), block)


def ternary_product(weights: DataFrame, inputs: DataFrame) -> DataFrame:
    """(weight id, input id, y): products of packed ternary rows with activations through a table of each group's 243 sums.

    The table has 243 rows for each group of five inputs and is built from the inputs; rows meet it by (group, byte).
    """
    groups = weights.select(F.col("vec_id").alias("w"), "scale", F.posexplode(base3(F.col("t"))).alias("g", "b"))
    acts = inputs.select(F.col("vec_id").alias("x"), F.posexplode(F.transform(F.sequence(F.lit(0), F.ceil(F.size("v") / GROUP).cast("int") - 1), lambda g: F.transform(F.sequence(F.lit(0), F.lit(GROUP - 1)), lambda k: F.coalesce(F.get("v", g * GROUP + k), F.lit(0.0))))).alias("g", "a"))
    lut = acts.select("*", F.explode(F.sequence(F.lit(0), F.lit(3**GROUP - 1))).alias("b"))
    lut = lut.select("x", "g", "b", F.aggregate(F.zip_with(trits(F.col("b")), "a", lambda t, a: t * a), F.lit(0.0), lambda s, v: s + v).alias("part"))
    return groups.join(lut, ["g", "b"]).groupBy("w", "x").agg((F.sum("part") * F.first("scale")).alias("y"))


def _embed(s, d):
    return doubles(table(s, d, "embeddings"))


def _quant(s, d, bits):
    x = affine(_embed(s, d), bits)
    size = F.ceil(F.size("q") * bits / 8).cast("long")
    packed = packed_nibbles(F.col("q")) if bits == 4 else total(F.col("q")).cast("long")
    return x.select("vec_id", F.round("scale", 9).alias("scale"), F.col("zero").cast("long").alias("zero_point"), packed.alias("packed_sum"), size.alias("n_bytes"))


def _mse(s, d):
    x = [affine(_embed(s, d), b).select("vec_id", mean_square(F.col("v"), dequantized(F.col("q"), F.col("scale"), F.col("zero"))).alias(f"m{b}")) for b in (8, 4)]
    return x[0].join(x[1], "vec_id").select("vec_id", F.round(F.col("m8") * 1e6, 4).alias("mse8_e6"), F.round(F.col("m4") * 1e6, 2).alias("mse4_e6"))


def _masked(s, d):
    x = table(s, d, "embeddings").select(F.explode("embedding").alias("x")).where("x is not null")
    levels = F.explode(F.array(*(F.struct(F.lit(k).alias("level"), mask_value(F.col("x"), k).alias("y")) for k in (1, 2, 3, 4))))
    return x.select("x", levels.alias("m")).select(F.col("m.level").alias("level"), F.col("x").cast("double").alias("x"), F.col("m.y").alias("y"))


def _matvec(s, d):
    w = ternary(_embed(s, d))
    inputs = s.range(2).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: (F.pmod(i * 7 + F.col("id") * 3, F.lit(11)) - 5).cast("double")).alias("v"))
    return ternary_product(w, inputs).select(F.col("w").alias("vec_id"), F.col("x").alias("input"), F.round("y", 6).alias("y"))


def sparse24_product(blocks: Column, activations: Column) -> Column:
    """Signed sum of the activations that each block's pair names: `blocks` as `sparse24` gives them, `activations` an array of doubles as long as the weights."""
    first, second = (F.array(*(F.lit(p[k]) for p in PAIRS)) for k in (0, 1))
    sign = lambda b, k: F.when(F.shiftright(b["signs"], k).bitwiseAND(F.lit(1)) == 1, -1.0).otherwise(1.0)
    one = lambda b, g, k, place: sign(b, k) * F.get(activations, g * 4 + F.get(place, b["combo"]))
    return total(F.transform(blocks, lambda b, g: one(b, g, 0, first) + one(b, g, 1, second)))


def _sparse_matvec(s, d):
    """The product with one vector of activations, times the mean size of the weights."""
    x = _embed(s, d).withColumn("blocks", sparse24(F.col("v"))).withColumn("scale", F.greatest(total(F.transform("v", F.abs)) / F.size("v"), F.lit(1e-8)))
    act = F.transform(F.sequence(F.lit(0), F.size("v") - 1), lambda i: (F.pmod(i * 7, F.lit(11)) - 5).cast("double"))
    return x.select("vec_id", F.round(sparse24_product(F.col("blocks"), act) * F.col("scale"), 6).alias("y"))


QUERIES = {
    "q_quant_int8": lambda s, d: _quant(s, d, 8),
    "q_quant_int4": lambda s, d: _quant(s, d, 4),
    "q_quant_mse": _mse,
    "q_mask_levels": lambda s, d: _masked(s, d).where("x <> 0").groupBy("level").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("x") - F.col("y")) / F.abs("x")), 9).alias("relative_error"), F.countDistinct("y").alias("n_distinct")),
    "q_mask_mse": lambda s, d: _masked(s, d).groupBy("level").agg(F.round(F.log10(F.avg((F.col("x") - F.col("y")) * (F.col("x") - F.col("y")))), 6).alias("log10_mse")),
    "q_ternary_scale": lambda s, d: ternary(_embed(s, d)).select("vec_id", F.round("scale", 9).alias("scale"), F.round(F.greatest(total(F.transform("v", F.abs)) / F.size("v"), F.lit(1e-8)), 9).alias("unpadded_scale")),
    "q_ternary_pack": lambda s, d: ternary(_embed(s, d)).select("vec_id", F.posexplode(base3(F.col("t"))).alias("chunk", "packed")),
    "q_ternary_decode": lambda s, d: s.range(243).select("id", *(trits(F.col("id"))[k].alias(f"t{k}") for k in range(GROUP))),
    "q_ternary_matvec": _matvec,
    "q_sparse24_pack": lambda s, d: _embed(s, d).select("vec_id", F.posexplode(sparse24(F.col("v"))).alias("block", "p")).select("vec_id", "block", F.col("p.combo").alias("combo"), F.col("p.signs").alias("signs")),
    "q_sparse24_matvec": _sparse_matvec,
    "q_bits_per_param": lambda s, d: _embed(s, d).agg(F.sum(F.size("v").cast("long")).alias("n_params"), F.sum(F.ceil(F.size("v") / 5)).alias("base3_bytes"), F.sum(F.floor(F.size("v") / 4) * 2).alias("sparse24_bytes")).select("*", F.round(F.col("base3_bytes") * 8 / F.col("n_params"), 4).alias("base3_bits"), F.round(F.col("sparse24_bytes") * 8 / F.col("n_params"), 4).alias("sparse24_bits")),
}

_E = f"WITH {FLOATS}"
_R = "r AS (SELECT vec_id, min(x) AS lo, max(x) AS hi, count(*) AS n, sum(abs(x)) AS a FROM f GROUP BY vec_id)"


def _q(bits: int) -> str:
    top = (1 << bits) - 1
    return f"s{bits} AS (SELECT *, CASE WHEN hi > lo THEN (hi - lo) / {top} ELSE 1.0 END AS scale FROM r), z{bits} AS (SELECT *, CASE WHEN hi > lo THEN round_even(-lo / scale, 0) ELSE 0.0 END AS zero FROM s{bits}), q{bits} AS (SELECT vec_id, i, x, scale, zero, CASE WHEN hi > lo THEN least({top}.0, greatest(0.0, round_even(x / scale, 0) + zero)) ELSE 0.0 END AS q FROM f JOIN z{bits} USING (vec_id))"


def _mask(level: int, bits: int) -> str:
    e = "floor(log2(abs(x)))"
    if bits == 24:
        v = f"pow(2.0, {e} - (({e} + 127) % 2))"
    else:
        v = f"floor(abs(x) / pow(2.0, {e} - {23 - bits})) * pow(2.0, {e} - {23 - bits})"
    return f"SELECT {level} AS level, x, CASE WHEN x = 0 THEN 0.0 ELSE sign(x) * {v} END AS y FROM f"


_M = "m AS (" + " UNION ALL ".join(_mask(level, bits) for level, bits in ((1, 8), (2, 16), (3, 23), (4, 24))) + ")"
_TERN = f"{_R}, t AS (SELECT vec_id, i, x, greatest(a / (ceil(n / 5.0) * 5), 1e-8) AS scale, CAST(greatest(-1, least(1, round_even(x / greatest(a / (ceil(n / 5.0) * 5), 1e-8), 0))) AS INTEGER) AS t FROM f JOIN r USING (vec_id))"
_SP = "k AS (SELECT vec_id, i // 4 AS block, i % 4 AS p, x, row_number() OVER (PARTITION BY vec_id, i // 4 ORDER BY abs(x) DESC, i) AS rk FROM f), g AS (SELECT vec_id, block, min(p) AS p1, max(p) AS p2, arg_min(x, p) AS x1, arg_max(x, p) AS x2 FROM k WHERE rk <= 2 GROUP BY vec_id, block)"
ORACLE_SQL = {
    "q_quant_int8": f"{_E}, {_R}, {_q(8)} SELECT vec_id, round(any_value(scale), 9) AS scale, CAST(any_value(zero) AS BIGINT) AS zero_point, CAST(sum(q) AS BIGINT) AS packed_sum, count(*) AS n_bytes FROM q8 GROUP BY vec_id",
    "q_quant_int4": f"{_E}, {_R}, {_q(4)} SELECT vec_id, round(any_value(scale), 9) AS scale, CAST(any_value(zero) AS BIGINT) AS zero_point, CAST(sum(q * CASE WHEN i % 2 = 0 THEN 16 ELSE 1 END) AS BIGINT) AS packed_sum, CAST(ceil(count(*) / 2.0) AS BIGINT) AS n_bytes FROM q4 GROUP BY vec_id",
    "q_quant_mse": f"{_E}, {_R}, {_q(8)}, {_q(4)}, a AS (SELECT vec_id, avg((x - (q - zero) * scale) * (x - (q - zero) * scale)) AS m FROM q8 GROUP BY vec_id), b AS (SELECT vec_id, avg((x - (q - zero) * scale) * (x - (q - zero) * scale)) AS m FROM q4 GROUP BY vec_id) SELECT vec_id, round(a.m * 1e6, 4) AS mse8_e6, round(b.m * 1e6, 2) AS mse4_e6 FROM a JOIN b USING (vec_id)",
    "q_mask_levels": f"{_E}, {_M} SELECT level, count(*) AS n, round(avg(abs(x - y) / abs(x)), 9) AS relative_error, count(DISTINCT y) AS n_distinct FROM m WHERE x <> 0 GROUP BY level",
    "q_mask_mse": f"{_E}, {_M} SELECT level, round(log10(avg((x - y) * (x - y))), 6) AS log10_mse FROM m GROUP BY level",
    "q_ternary_scale": f"{_E}, {_R} SELECT vec_id, round(greatest(a / (ceil(n / 5.0) * 5), 1e-8), 9) AS scale, round(greatest(a / n, 1e-8), 9) AS unpadded_scale FROM r",
    "q_ternary_pack": f"{_E}, {_TERN}, p AS (SELECT vec_id, i // 5 AS chunk, sum(CAST((t + 1) * pow(3, i % 5) AS BIGINT)) AS b, count(*) AS n FROM t GROUP BY vec_id, i // 5) SELECT vec_id, CAST(chunk AS INTEGER) AS chunk, CAST(b + CAST((CAST(pow(3, 5) AS BIGINT) - CAST(pow(3, n) AS BIGINT)) // 2 AS BIGINT) AS INTEGER) AS packed FROM p",
    "q_ternary_decode": "SELECT id, " + ", ".join(f"CAST(id // {3**k} % 3 - 1 AS INTEGER) AS t{k}" for k in range(5)) + " FROM range(243) t(id)",
    "q_ternary_matvec": f"{_E}, {_TERN}, y AS (SELECT vec_id, input, sum(t * ((i * 7 + input * 3) % 11 - 5)) * any_value(scale) AS y FROM t, range(2) r(input) GROUP BY vec_id, input) SELECT vec_id, input, round(y, 6) AS y FROM y",
    "q_sparse24_pack": f"{_E}, {_SP} SELECT vec_id, CAST(block AS INTEGER) AS block, CAST(CASE WHEN p1 = 0 THEN p2 - 1 WHEN p1 = 1 THEN p2 + 1 ELSE 5 END AS INTEGER) AS combo, CASE WHEN x1 < 0 THEN 1 ELSE 0 END + CASE WHEN x2 < 0 THEN 2 ELSE 0 END AS signs FROM g",
    "q_sparse24_matvec": f"{_E}, {_R}, {_SP}, y AS (SELECT vec_id, sum(CASE WHEN x1 < 0 THEN -1.0 ELSE 1.0 END * ((block * 4 + p1) * 7 % 11 - 5) + CASE WHEN x2 < 0 THEN -1.0 ELSE 1.0 END * ((block * 4 + p2) * 7 % 11 - 5)) AS y FROM g GROUP BY vec_id) SELECT vec_id, round(CAST(y AS DOUBLE) * greatest(a / n, 1e-8), 6) AS y FROM y JOIN r USING (vec_id)",
    "q_bits_per_param": "SELECT *, round(base3_bytes * 8 / CAST(n_params AS DOUBLE), 4) AS base3_bits, round(sparse24_bytes * 8 / CAST(n_params AS DOUBLE), 4) AS sparse24_bits FROM (SELECT CAST(sum(len(embedding)) AS BIGINT) AS n_params, CAST(sum(ceil(len(embedding) / 5.0)) AS BIGINT) AS base3_bytes, CAST(sum(len(embedding) // 4 * 2) AS BIGINT) AS sparse24_bytes FROM embeddings WHERE len(embedding) > 0)",
}
