"""URL filter: rules on host and path first, then logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quartzite.llm.common import arrow_batches
from quartzite.llm.scan import BYTE, U, mix, powers, text_chunks

BITS, SIZES = 16, (3, 4, 5)

#: The small labelled table: url, blocked.
LABELLED: tuple[tuple[str, int], ...] = (
    ("https://en.encyclopedia.org/wiki/Compression", 0), ("https://docs.library.org/en/latest/index.html", 0), ("http://www.university.edu/research/papers/17.pdf", 0),
    ("https://news.daily.com/2023/05/science/story.html", 0), ("https://blog.garden.net/en/1021", 0), ("https://www.museum.org/fr/collection/44", 0),
    ("https://m.weather.com/de/berlin", 0), ("https://forum.cooking.net/thread/4411?page=2", 0), ("https://www.health.gov/guides/sleep", 0),
    ("https://archive.history.org/en/letters/1848", 0), ("https://github.code.com/project/readme", 0), ("http://travel.example.org/es/7751", 0),
    ("https://www.court.gov/opinions/2019/12", 0), ("https://books.press.edu/chapter/3", 0), ("https://blog.math.org/en/proofs", 0),
    ("https://recipes.kitchen.com/fr/soupe/12.html", 0), ("https://www.school.edu/lessons/7", 0), ("https://support.software.com/en/articles/99", 0),
    ("http://casino-bonus.win/free-spins/jackpot", 1), ("https://xxx-videos.tube/watch/hot", 1), ("http://cheap-pills.shop/viagra/buy-now", 1),
    ("https://poker-slots.bet/casino/register?ref=1", 1), ("http://free-download-crack.ru/keygen.exe", 1), ("http://adult-cams.live/xxx/chat", 1),
    ("https://win-prize-click.info/claim/free-iphone", 1), ("http://payday-loans-fast.biz/apply-now", 1), ("https://sexy-dating.club/join-free", 1),
    ("http://torrent-warez.to/crack/serial", 1), ("https://slots-jackpot.casino/bonus/free-spins", 1), ("http://click-ads-track.xyz/redirect?u=spam", 1),
    ("https://replica-watches.shop/cheap/buy", 1), ("http://porn-tube.xxx/videos/99", 1), ("https://bet-win-casino.online/poker", 1),
    ("http://malware-cleaner.xyz/download/setup.exe", 1), ("https://cheap-viagra-pills.biz/order-now", 1), ("http://spam-offers.info/click/claim-prize", 1),
)

#: Rules (verdict, host/path); a rule fits its host and all subdomains if the path starts with the rule's.
RULES: tuple[tuple[str, str], ...] = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or where there is no ``://``."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host, path = (F.coalesce(F.regexp_extract(url, parts, i), F.lit("")) for i in (1, 2))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule = verdict = None
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1]), reverse=True):
        own, _, rest = text.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(f"/{rest}")
        rule = F.when(fits, F.lit(text)) if rule is None else rule.when(fits, F.lit(text))
        verdict = F.when(fits, F.lit(what)) if verdict is None else verdict.when(fits, F.lit(what))
    return (F.lit(None).cast("string"),) * 2 if rule is None else (rule, verdict)


def grams(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, row) of every n-gram of bytes of each row."""
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    places, rows = [], []
    for n in SIZES:
        m = len(raw) - n + 1
        if m <= 0:
            continue
        h = np.zeros(m, np.uint64)
        for i, p in enumerate(powers(n)):
            h += BYTE[raw[i : i + m]] * p
        ok = doc[:m] == doc[n - 1 :]
        places.append((mix(h + U(n)) >> U(64 - BITS)).astype(np.int64)[ok])
        rows.append(doc[:m][ok])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(places), np.concatenate(rows)


@dataclass
class UrlModel:
    weights: np.ndarray
    bias: float

    def probability(self, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """P(blocked) of each row; the n-grams' weights are averaged over the square root of their number."""
        place, row = grams(raw, offs)
        n = np.bincount(row, minlength=len(offs) - 1)
        s = np.bincount(row, weights=self.weights[place], minlength=len(offs) - 1) / np.sqrt(np.maximum(n, 1))
        return 1 / (1 + np.exp(-np.clip(s + self.bias, -60, 60)))


def marked(host: str, path: str) -> str:
    """The text whose n-grams count: host and path with their borders, so that the same letters differ in either."""
    return f"\x02{host}\x03{path}\x04"


def _parts(url: str) -> tuple[str, str]:
    _, sep, rest = url.partition("://")
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    path = rest[end:]
    return (rest[:end].lower(), path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]) if sep else ("", "")


def train(labelled: Sequence[tuple[str, int]] = LABELLED, rounds: int = 300, rate: float = 0.5, l2: float = 1e-3) -> UrlModel:
    """Logistic regression by gradient descent on a small labelled table (it is held by the driver)."""
    texts = [marked(*_parts(u)).encode() for u, _ in labelled]
    raw, offs = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    y = np.array([b for _, b in labelled], np.float64)
    place, row = grams(raw, offs)
    scale = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=len(y)), 1))
    w, bias = np.zeros(1 << BITS), 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(np.bincount(row, weights=w[place], minlength=len(y)) * scale + bias)))
        g = (p - y) / len(y)
        w -= rate * (np.bincount(place, weights=(g * scale)[row], minlength=1 << BITS) + l2 * w) * 10
        bias -= rate * g.sum()
    return UrlModel(w, bias)


def _score(batches: Iterator[pa.RecordBatch], model: Broadcast, place: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        p = [model.value.probability(raw, offs) for _, _, raw, offs in text_chunks(batch.column(place))]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(p) if p else np.zeros(0), pa.float64())], [*batch.schema.names, "_p"])


def filter_urls(pages: DataFrame, model: UrlModel | None = None, rules: Sequence[tuple[str, str]] = RULES, url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """`pages` with host, path, rule, p_block and verdict: the longest fitting rule's, else block where p_block >= `threshold`.

    A null or empty url, or one without ``://``, has empty host and path, no rule, and the model's verdict on these.  Repeated rows
    are judged each, long urls whole, an empty table stays empty.  Other columns pass through, of any type; input columns of the
    names host, path, rule, p_block and verdict are replaced.
    """
    spark = pages.sparkSession
    arrow_batches(spark, 10_000)
    model = model or train()
    names = {c: f"c{i}" for i, c in enumerate(pages.columns)}
    host, path = host_and_path(F.col(url_col))
    src = pages.select(*(F.col(c).alias(n) for c, n in names.items()), host.alias("_host"), path.alias("_path")).withColumn("_text", F.concat(F.lit("\x02"), "_host", F.lit("\x03"), "_path", F.lit("\x04")))
    schema = StructType([*src.schema.fields, StructField("_p", DoubleType())])
    out = src.mapInArrow(partial(_score, model=spark.sparkContext.broadcast(model), place=len(src.columns) - 1), schema)
    rule, verdict = longest_rule(F.col("_host"), F.col("_path"), rules)
    return out.select(*(F.col(n).alias(c) for c, n in names.items() if c not in ("host", "path", "rule", "p_block", "verdict")), F.col("_host").alias("host"), F.col("_path").alias("path"), rule.alias("rule"), F.col("_p").alias("p_block"), F.coalesce(verdict, F.when(F.col("_p") >= threshold, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    out = filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
    return out.select("page_id", "host", "path", "rule", "verdict", F.round("p_block", 6).alias("p_block"))
