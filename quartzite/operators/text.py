"""Words, identifiers, dictionaries, and the small scalar operators on texts, urls and events."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quartzite.functions import columns as C
from quartzite.functions import words as W
from quartzite.functions.arrow import bound_batches, map_batches, map_bytes, spread
from quartzite.functions.kernels import crc32c_rows
from quartzite.plans import route as R
from quartzite.sources.tables import table

VOCABULARY, LEAST = 8192, 4


def words(df: DataFrame, id_col: str = "doc_id", col: str = "text") -> DataFrame:
    """(id, pos, part): alternating runs of ASCII letters and the rest."""
    return df.select(id_col, F.posexplode(C.parts(F.coalesce(F.col(col).cast("string"), F.lit("")))).alias("pos", "part"))


def vocabulary(parts: DataFrame, size: int = VOCABULARY, least: int = LEAST) -> DataFrame:
    """(word, id): the most frequent lower-cased words of `least` letters or more, ties by word; at most `size` rows.  A column n of `parts` counts them."""
    w = parts.where(F.col("part").rlike("^[a-zA-Z]")).select(F.lower("part").alias("word"), *(c for c in ("n",) if c in parts.columns)).where(F.length("word") >= least)
    top = w.groupBy("word").agg((F.sum("n") if "n" in parts.columns else F.count("*")).alias("n")).orderBy(F.desc("n"), "word").limit(size)
    return top.select("word", (F.row_number().over(Window.orderBy(F.desc("n"), "word")) - 1).alias("id"))  # over at most `size` rows


def known_words(docs: DataFrame, col: str = "text") -> list[bytes]:
    """The vocabulary of all rows by id: VOCABULARY words at most."""
    return [r.word.encode() for r in vocabulary(words(docs.select(F.lit(0).alias("id"), col), "id", col)).orderBy("id").collect()]


#: Ids that are broadcast at most.
SENT_IDS = 100_000


def by_id(df: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame | None]:
    """(rows whose id no other row has, the others): what is asked of an id can be told from such a row alone.  None: no id repeats."""
    twice = df.groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1").select(F.col(id_col).alias("_id"))
    n = twice.limit(SENT_IDS + 1).count()
    if not n:
        return df, None
    twice = F.broadcast(twice) if n <= SENT_IDS else twice.hint("merge")
    same = F.col(id_col).eqNullSafe(F.col("_id"))
    return df.join(twice, same, "left_anti"), df.join(twice, same, "left_semi")


def token_sizes(docs: DataFrame, known: list[bytes], id_col: str = "doc_id", col: str = "text") -> DataFrame:
    """Per id that has a text: parts, tokens, bytes.  A known word in lower, upper or title case is a two-byte token, all else literal."""
    code = W.codes(known)
    rows = map_bytes(docs, col, lambda x: W.sizes(x.tobytes(), code), "n_parts long, n_tokens long, packed_bytes long", [id_col])
    return rows.where("n_parts > 0").groupBy(id_col).agg(*(F.sum(c).alias(c) for c in ("n_parts", "n_tokens", "packed_bytes")))


def _count_tokens(batches: Iterator[pa.RecordBatch], code: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """One row for each token of a task: how often, and in how many rows that have an id."""
    n, docs = np.zeros((2, 3 * W.MAX_WORDS), np.int64)
    for batch in batches:
        for key, x in zip(batch.column(0), batch.column(1), strict=True):
            got = W.counts(bytes(x.as_buffer() or b""), code) if x.is_valid else {}
            at = np.array([code[w] for w in got], np.int64)
            n[at] += np.array([*got.values()], np.int64)
            docs[at] += key.is_valid
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at]), pa.array(docs[at])], ["code", "n", "n_docs"])


def token_counts(docs: DataFrame, known: list[bytes], id_col: str = "doc_id", col: str = "text") -> DataFrame:
    """(id, kind, n, n_docs) of each token: its word, its case (0 lower, 1 upper, 2 title), how often, and at how many ids it stands."""
    code = W.codes(known)
    one, more = by_id(docs.select(id_col, F.encode(F.col(col).cast("string"), "UTF-8").alias("x")), id_col)
    bound_batches(docs)
    found = one.mapInArrow(partial(_count_tokens, code=code), "code int, n long, n_docs long")
    if more is not None:
        each = map_bytes(more, "x", lambda x: ((code[w], c) for w, c in W.counts(x.tobytes(), code).items()), "code int, n long", [id_col], many=True)
        each = each.groupBy("code", id_col).agg(F.sum("n").alias("n"))
        found = found.unionByName(each.groupBy("code").agg(F.sum("n").alias("n"), F.count(id_col).alias("n_docs")))
    found = found.groupBy("code").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))
    return found.select((F.col("code") % W.MAX_WORDS).cast("int").alias("id"), F.floor(F.col("code") / W.MAX_WORDS).cast("int").alias("kind"), "n", "n_docs")


def tokenize(docs: DataFrame, known: list[bytes], id_col: str = "doc_id", col: str = "text") -> DataFrame:
    """(id, ids, literals) of each row with a text: see `words.split`."""
    code = W.codes(known)
    return map_bytes(docs.where(F.length(col) > 0), col, lambda x: W.split(x.tobytes(), code), "ids binary, literals binary", [id_col])


def _join_tokens(batches: Iterator[pa.RecordBatch], form: list[bytes]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [W.joined(ids, literals, form).decode() for ids, literals in zip(*(batch.column(i).to_pylist() for i in (1, 2)), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [batch.schema.names[0], "text"])


def detokenize(tokens: DataFrame, known: list[bytes]) -> DataFrame:
    """Texts from the rows of `tokenize`."""
    form = [f(w) for f in (bytes, bytes.upper, bytes.capitalize) for w in [*known, *[b""] * (W.MAX_WORDS - len(known))]]
    bound_batches(tokens)
    return tokens.mapInArrow(partial(_join_tokens, form=form), StructType([tokens.schema[0], StructField("text", StringType())]))


def identifier_counts(df: DataFrame, id_col: str = "doc_id", col: str = "text") -> DataFrame:
    w = df.select(id_col, F.posexplode(C.identifiers(F.coalesce(F.col(col).cast("string"), F.lit("")))).alias("pos", "word"))
    return w.groupBy(id_col, "word").agg(F.count("*").alias("n"), F.min("pos").cast("long").alias("first"))


def top_identifiers(counts: DataFrame, k: int, id_col: str = "doc_id") -> DataFrame:
    """The k most frequent of each document, ties by first appearance."""
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("n"), "first"))).where(F.col("rank") <= k)


def dynamic_dictionary(counts: DataFrame, id_col: str = "doc_id", pool: int = 100, size: int = 16, least: int = 4, often: int = 3) -> DataFrame:
    """Of the `pool` most frequent identifiers, the first `size` that are long and frequent enough and no keywords."""
    top = top_identifiers(counts, pool, id_col).where((F.length("word") >= least) & (F.col("n") >= often) & ~F.col("word").isin(*C.KEYWORDS))
    return top.withColumn("slot", F.row_number().over(Window.partitionBy(id_col).orderBy("rank")) - 1).where(F.col("slot") < size)


def frequent_identifiers(df: DataFrame, k: int, id_col: str = "doc_id", col: str = "text") -> DataFrame:
    """`top_identifiers` of the texts: where no other row has the id, found in the row itself."""
    one, more = by_id(df.select(id_col, col), id_col)

    def own(x: np.ndarray):
        n, first = W.names(x.tobytes())
        for i, (w, c) in enumerate(n.most_common(k)):  # equal counts stay in order of first appearance
            yield i + 1, w.decode(), c, first[w]

    out = map_bytes(one, col, own, "rank int, word string, n long, first long", [id_col], many=True)
    return out if more is None else out.unionByName(top_identifiers(identifier_counts(more, id_col, col), k, id_col).select(*out.columns))


def dictionaries(df: DataFrame, id_col: str = "doc_id", col: str = "text", pool: int = 100, size: int = 16, least: int = 4, often: int = 3) -> DataFrame:
    """`dynamic_dictionary` of the texts: where no other row has the id, found in the row itself."""
    one, more = by_id(df.select(id_col, col), id_col)
    keywords = frozenset(k.encode() for k in C.KEYWORDS)

    def own(x: np.ndarray):
        top = W.names(x.tobytes())[0].most_common(pool)
        fit = [(w, c) for w, c in top if len(w) >= least and c >= often and w not in keywords]
        for i, (w, c) in enumerate(fit[:size]):
            yield i, w.decode(), c

    out = map_bytes(one, col, own, "slot int, word string, n long", [id_col], many=True)
    return out if more is None else out.unionByName(dynamic_dictionary(identifier_counts(more, id_col, col), id_col, pool, size, least, often).select(*out.columns))


def replace_keywords(text):
    """Keywords in list order, each by one character of a private range."""
    for i, w in enumerate(C.KEYWORDS):
        text = F.replace(text, F.lit(w), F.lit(chr(0xE000 + i)))
    return text


def indents(df: DataFrame, id_col: str, col: str) -> DataFrame:
    """(id, depth) of each line: blanks at the start, if they are four times 1 to 31 and the line has more; else null."""
    lines = df.select(id_col, F.explode(F.split(col, "\n", -1)).alias("line"))
    n = F.length(F.regexp_extract("line", "^ *", 0))
    ok = (n % 4 == 0) & (n / 4).between(1, 31) & (n < F.length("line"))
    return lines.select(id_col, F.when(ok, (n / 4).cast("int")).alias("depth"))


# --- code tokens ---------------------------------------------------------------------------------------------------

INDENT, KEYWORD, DYNAMIC = 0x80, 0xA0, 0xD0
_WORD = re.compile(rb"[a-zA-Z_][a-zA-Z0-9_]*")


def code_tokens(data: bytes) -> tuple[bytes, list[bytes]]:
    """ASCII code in fewer bytes: indents, keywords and the text's own frequent identifiers are single bytes over 0x7F.

    Returns the bytes and the dictionary.  Anything but ASCII comes back as it is, without a dictionary.
    """
    if not data.isascii():
        return data, []
    keys = [k.encode() for k in C.KEYWORDS]
    counts: dict[bytes, list[int]] = {}
    for i, m in enumerate(_WORD.finditer(data)):
        counts.setdefault(m[0], [0, i])[0] += 1
    top = sorted(counts, key=lambda w: (-counts[w][0], counts[w][1]))[:100]
    own = [w for w in top if len(w) >= 4 and counts[w][0] >= 3 and w not in keys][:16]
    code = {k: bytes([KEYWORD + i]) for i, k in enumerate(keys)} | {w: bytes([DYNAMIC + i]) for i, w in enumerate(own)}
    out = []
    for line in data.split(b"\n"):
        n = len(line) - len(line.lstrip(b" "))
        if n and n % 4 == 0 and n // 4 < 32 and n < len(line):
            out.append(bytes([INDENT + n // 4]) + _WORD.sub(lambda m: code.get(m[0], m[0]), line[n:]))
        else:
            out.append(_WORD.sub(lambda m: code.get(m[0], m[0]), line))
    return b"\n".join(out), own


def code_text(packed: bytes, own: list[bytes], ascii_only: bool = True) -> bytes:
    if not ascii_only:
        return packed
    table = {bytes([INDENT + d]): b" " * (4 * d) for d in range(1, 32)} | {bytes([KEYWORD + i]): k.encode() for i, k in enumerate(C.KEYWORDS)} | {bytes([DYNAMIC + i]): w for i, w in enumerate(own)}
    return re.sub(rb"[\x80-\xFF]", lambda m: table[m[0]], packed)


def _code(x: np.ndarray) -> tuple:
    data = x.tobytes()
    packed, own = code_tokens(data)
    return len(data), len(packed) + sum(len(w) + 1 for w in own), len(own), code_text(packed, own, data.isascii()) == data


#: Ordered prefixes: the first that fits is the tag.
PREFIXES = ("https://www.", "http://www.", "https://m.", "http://m.", "https://blog.", "http://blog.", "https://", "http://")
#: First bytes of known formats, in hex.
MAGIC = (("zip", "504B0304"), ("gzip", "1F8B"), ("zstd", "28B52FFD"), ("png", "89504E47"), ("pdf", "25504446"), ("html", "3C21444F4354595045"), ("html", "3C68746D6C"), ("json", "7B"), ("archive", "515A4131"))


def magic(data):
    """Name of the format whose first bytes a binary column has, else null."""
    out = None
    for name, head in MAGIC:
        fits = F.hex(F.substring(data, 1, len(head) // 2)) == head
        out = F.when(fits, name) if out is None else out.when(fits, name)
    return out


def _docs(s, d):
    return table(s, d, "documents")


def _texts(s, d):
    return spread(_docs(s, d).select("doc_id", "text"))


def _known(fn):
    """`fn` of the documents and their vocabulary."""

    def query(s, d):
        docs = _texts(s, d)
        return fn(docs, known_words(docs))

    return query


def _word_codec(docs, known):
    table_, meaning = W.forms(known), W.inverse(known)

    def both(x):
        y = W.encode(x.tobytes(), table_)
        return len(x), len(y), md5(W.decode(y, meaning)).hexdigest()

    return map_bytes(docs, "text", both, "n long, packed_bytes long, md5 string", ["doc_id"])


def _n():
    return F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")


#: Suffixes that routing is tried with, besides those that the urls have.
_SUFFIXES = ("", ".WAV", ".pt", ".bmp", ".zip", ".py", ".unknown", ".bin", ".jpg", ".h5", ".MD")
_ENDS = (".txt", ".dat", ".MD", ".csv.gz", ".py")


def _file():
    """A path for each document."""
    return F.concat("source", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.element_at(F.array(*map(F.lit, _ENDS)), (F.pmod("doc_id", F.lit(len(_ENDS))) + 1).cast("int")))


QUERIES = {
    "q_total_bytes": lambda s, d: _docs(s, d).agg(F.count("*").alias("n_docs"), F.sum(_n()).alias("total_bytes")),
    "q_sha256": lambda s, d: _docs(s, d).select("doc_id", F.sha2("text", 256).alias("sha256")),
    "q_crc32c": lambda s, d: map_batches(_docs(s, d), "text", lambda x, offs: (np.diff(offs), crc32c_rows(x, offs)), "n long, crc32c long", ["doc_id"]),
    "q_base64": lambda s, d: _docs(s, d).select("doc_id", F.md5(F.regexp_replace(F.base64(F.encode("text", "UTF-8")), "[\r\n]", "")).alias("base64_md5"), (F.decode(F.unbase64(F.base64(F.encode("text", "UTF-8"))), "UTF-8") == F.col("text")).alias("back")),
    "q_json_extract": lambda s, d: table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")),
    "q_varint_len": lambda s, d: _docs(s, d).select("doc_id", _n().alias("n"), C.varint_len(_n()).alias("varint_len"), C.varint_hex(_n()).alias("varint_hex")),
    "q_pack_descriptor": lambda s, d: s.range(4 * 4 * 8).select((F.col("id") % 4).cast("int").alias("pad"), F.when(F.floor(F.col("id") / 4) % 4 == 0, 1).when(F.floor(F.col("id") / 4) % 4 == 1, 2).when(F.floor(F.col("id") / 4) % 4 == 2, 4).otherwise(3).alias("elem"), F.floor(F.col("id") / 16).cast("int").alias("mode")).withColumn("packed", C.pack_descriptor(F.col("pad"), F.col("elem"), F.col("mode"))).withColumn("back", (C.unpack_descriptor(F.col("packed"))[0] == F.col("pad")) & (C.unpack_descriptor(F.col("packed"))[1] == F.col("elem")) & (C.unpack_descriptor(F.col("packed"))[2] == F.col("mode"))),
    "q_human_size": lambda s, d: _docs(s, d).select("doc_id", C.human_size(_n()).alias("size"), C.human_size(_n() * 1000000).alias("larger")),
    "q_url_ext": lambda s, d: table(s, d, "pages").select("page_id", C.extension(F.regexp_replace("url", "[?#].*$", "")).alias("ext")),
    "q_path_parts": lambda s, d: table(s, d, "pages").select("page_id", F.element_at(F.split(F.regexp_replace("url", "[?#].*$", ""), "/"), -1).alias("base"), F.regexp_extract("url", "^[a-z]+://([^/]*)", 1).alias("host"), F.size(F.split(F.regexp_replace("url", "[?#].*$", ""), "/")).cast("long").alias("depth")),
    "q_sniff_text": lambda s, d: _docs(s, d).select("doc_id", F.round(R.printable_share(F.encode("text", "UTF-8")), 6).alias("share"), (R.printable_share(F.encode("text", "UTF-8")) > R.TEXT_SHARE).alias("is_text")),
    "q_route_mode": lambda s, d: (lambda p: p.select("page_id", *(c.alias(a) for c, a in zip(R.route(F.col("path"), F.encode("html", "UTF-8"), F.pmod("page_id", F.lit(3)) == 1), ("mode", "elem"), strict=True))))(table(s, d, "pages").select("page_id", "html", F.concat(F.regexp_replace("url", "[?#].*$", ""), F.element_at(F.array(*map(F.lit, _SUFFIXES)), (F.pmod("page_id", F.lit(len(_SUFFIXES))) + 1).cast("int"))).alias("path"))),
    "q_dict_samples": lambda s, d: R.dictionary_samples(_docs(s, d), _file(), _n()).select("doc_id", _n().alias("n")),
    "q_dict_capacity": lambda s, d: _docs(s, d).where(R.sampled(_file(), _n())).groupBy("source").agg(F.count("*").alias("n"), F.sum(_n()).alias("total")).select("source", "n", "total", R.dictionary_capacity(F.col("n"), F.col("total")).alias("capacity")),
    "q_codec_eligibility": lambda s, d: _docs(s, d).select("doc_id", *(R.eligible(_n(), c).alias(c) for c in R.ELIGIBLE)),
    "q_codec_level": lambda s, d: _docs(s, d).select("doc_id", R.level(_n() * 4096).alias("normal"), R.level(_n() * 4096, best=True).alias("best"), R.level(_n(), fast=True).alias("fast")),
    "q_corpus_filter": lambda s, d: table(s, d, "pages").where(~F.col("url").rlike(r"/\.[^/]*/") & (F.octet_length("html") > 0) & (F.octet_length("html") <= 200 * R.MIB)).select("page_id"),
    "q_ascii_docs": lambda s, d: _docs(s, d).select("doc_id", C.is_ascii(F.col("text")).alias("is_ascii")),
    "q_concat_pad": lambda s, d: table(s, d, "benchmark").select("item_id", F.md5(F.concat(F.rpad(F.encode("text", "UTF-8"), 4096, F.unhex(F.lit("00"))), F.substring(F.encode("text", "UTF-8"), 3, 5))).alias("md5")),
    "q_regex_tokens": lambda s, d: words(_docs(s, d).select("lang", "text"), "lang").groupBy("lang").agg(F.count("*").alias("n"), F.countDistinct("part").alias("n_distinct")),
    "q_case_class": lambda s, d: words(_docs(s, d).select("lang", "text"), "lang").where(F.col("part").rlike("^[a-zA-Z]")).groupBy("lang", C.case_class(F.col("part")).alias("class")).agg(F.count("*").alias("n")),
    "q_word_tokens": _known(token_counts),
    "q_word_token_size": _known(token_sizes),
    "q_word_codec": _known(_word_codec),
    "q_detokenize": _known(lambda docs, known: detokenize(tokenize(docs, known), known).select("doc_id", F.md5("text").alias("md5"))),
    "q_keyword_hits": lambda s, d: table(s, d, "pages").select("page_id", F.length("html").cast("long").alias("n_chars"), F.length(replace_keywords(F.col("html"))).cast("long").alias("packed_chars")),
    "q_indent_depth": lambda s, d: indents(table(s, d, "pages").select("page_id", F.replace(F.col("html"), F.lit("<p>"), F.lit("\n    <p>")).alias("html")), "page_id", "html").groupBy("page_id").agg(F.count("*").alias("n_lines"), F.count("depth").alias("n_indented"), F.coalesce(F.sum(F.col("depth") * 4 - 1), F.lit(0)).cast("long").alias("saved")),
    "q_identifier_topk": lambda s, d: frequent_identifiers(_texts(s, d), 5),
    "q_dynamic_dictionary": lambda s, d: dictionaries(_texts(s, d)),
    "q_code_tokenize": lambda s, d: map_bytes(_docs(s, d), "text", _code, "n long, packed long, n_words int, back boolean", ["doc_id"]),
    "q_prefix_tags": lambda s, d: table(s, d, "pages").select("page_id", F.coalesce(*(F.when(F.col("url").startswith(p), i) for i, p in enumerate(PREFIXES)), F.lit(-1)).alias("tag")),
    "q_magic_sniff": lambda s, d: table(s, d, "pages").select("page_id", magic(F.encode("html", "UTF-8")).alias("magic"), magic(F.encode("url", "UTF-8")).alias("url_magic")),
    "q_metrics": lambda s, d: (lambda x: x.select("doc_id", "n", "packed", F.round(C.ratio(F.col("n"), F.col("packed")), 4).alias("ratio"), F.round(F.when(F.col("n") > 0, 100.0 * (F.col("n") - F.col("packed")) / F.col("n")).otherwise(0.0), 4).alias("saved_pct")))(_docs(s, d).select("doc_id", _n().alias("n"), F.floor(_n() / 3).alias("packed"))),
    "q_empty_guard": lambda s, d: _docs(s, d).select("doc_id", F.when(F.coalesce(F.length("text"), F.lit(0)) == 0, F.lit("empty")).otherwise("data").alias("state")),
}

def _class(w: str) -> str:
    return f"CASE WHEN {w} = lower({w}) THEN 0 WHEN {w} = upper({w}) THEN 1 WHEN {w} = upper(substr({w}, 1, 1)) || lower(substr({w}, 2)) THEN 2 ELSE 3 END"


_W = "w AS (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS part FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[a-zA-Z]+|[^a-zA-Z]+') AS l FROM documents))"
_V = f"v AS (SELECT word, row_number() OVER (ORDER BY n DESC, word) - 1 AS id FROM (SELECT lower(part) AS word, count(*) AS n FROM w WHERE regexp_matches(part, '^[a-zA-Z]') AND length(part) >= {LEAST} GROUP BY 1 ORDER BY n DESC, word LIMIT {VOCABULARY}))"
_T = f"t AS (SELECT w.*, CASE WHEN {_class('part')} < 3 THEN v.id END AS id, CASE WHEN v.id IS NOT NULL AND {_class('part')} < 3 THEN {_class('part')} END AS kind FROM w LEFT JOIN v ON lower(part) = word)"
_I = "i AS (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS word FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[a-zA-Z_][a-zA-Z0-9_]*') AS l FROM documents)), c AS (SELECT doc_id, word, count(*) AS n, CAST(min(pos) AS BIGINT) AS first FROM i GROUP BY doc_id, word), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS rank FROM c)"
_SIZE = "CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT)"
_PATH = "regexp_replace(url, '[?#].*$', '')"


def _human(n: str) -> str:
    return f"CASE WHEN {n} < 1024 THEN CAST({n} AS VARCHAR) || ' B' " + " ".join(f"WHEN {n} < {1 << (p + 10)} THEN format('{{:.2f}} {u}', round({n} / {float(1 << p)}, 2))" for u, p in (("KB", 10), ("MB", 20), ("GB", 30))) + f" ELSE format('{{:.2f}} TB', round({n} / {float(1 << 40)}, 2)) END"


def _replaced(x: str) -> str:
    for i, w in enumerate(C.KEYWORDS):
        x = f"replace({x}, '{w}', chr({0xE000 + i}))"
    return x


def _magic(col: str) -> str:
    return "CASE " + " ".join(f"WHEN starts_with(hex(encode({col})), '{h}') THEN '{n}'" for n, h in MAGIC) + " END"


_SHARE = f"len(list_filter(regexp_extract_all(substr(hex(encode(text)), 1, {2 * R.SNIFF_BYTES}), '..'), lambda p: (p >= '20' AND p <= '7E') OR p IN ('09', '0A', '0D'))) / (length(substr(hex(encode(text)), 1, {2 * R.SNIFF_BYTES})) / 2)"
_HTML_SHARE = _SHARE.replace("(text)", "(html)")
_in = lambda names: "(" + ", ".join(f"'{n}'" for n in names) + ")"
_FILE = f"SELECT doc_id, source, {_SIZE} AS n, source || '/' || lpad(CAST(doc_id AS VARCHAR), 9, '0') || [{', '.join(repr(x) for x in _ENDS)}][doc_id % {len(_ENDS)} + 1] AS path FROM documents"
_SAMPLED = f"lower(regexp_extract(path, '(\\.[^./]*)$', 1)) IN {_in(R.SAMPLED)} AND n > 0 AND n < 2097152"
ORACLE_SQL = {
    "q_total_bytes": f"SELECT count(*) AS n_docs, CAST(sum({_SIZE}) AS BIGINT) AS total_bytes FROM documents",
    "q_sha256": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "q_base64": "SELECT doc_id, md5(base64(encode(text))) AS base64_md5, decode(from_base64(base64(encode(text)))) = text AS back FROM documents",
    "q_json_extract": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "q_varint_len": f"SELECT doc_id, n, CASE WHEN n < 128 THEN 1 WHEN n < 16384 THEN 2 WHEN n < 2097152 THEN 3 ELSE 4 END AS varint_len, CASE WHEN n < 128 THEN format('{{:02X}}', n) WHEN n < 16384 THEN format('{{:02X}}{{:02X}}', n % 128 + 128, n // 128) WHEN n < 2097152 THEN format('{{:02X}}{{:02X}}{{:02X}}', n % 128 + 128, n // 128 % 128 + 128, n // 16384) END AS varint_hex FROM (SELECT doc_id, {_SIZE} AS n FROM documents)",
    "q_pack_descriptor": "SELECT CAST(id % 4 AS INTEGER) AS pad, CAST([1, 2, 4, 3][id // 4 % 4 + 1] AS INTEGER) AS elem, CAST(id // 16 AS INTEGER) AS mode, CAST(id % 4 + id // 4 % 4 * 4 + id // 16 * 32 AS INTEGER) AS packed, true AS back FROM range(128) t(id)",
    "q_human_size": f"SELECT doc_id, {_human('n')} AS size, {_human('(n * 1000000)')} AS larger FROM (SELECT doc_id, {_SIZE} AS n FROM documents)",
    "q_url_ext": f"SELECT page_id, lower(regexp_extract({_PATH}, '(\\.[^./]*)$', 1)) AS ext FROM pages",
    "q_path_parts": f"SELECT page_id, string_split({_PATH}, '/')[-1] AS base, regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS host, CAST(len(string_split({_PATH}, '/')) AS BIGINT) AS depth FROM pages",
    "q_sniff_text": f"SELECT doc_id, CASE WHEN text <> '' THEN round({_SHARE}, 6) END AS share, CASE WHEN text <> '' THEN {_SHARE} > {R.TEXT_SHARE} END AS is_text FROM documents",
    "q_route_mode": f"""WITH p AS (SELECT page_id, html <> '' AND {_HTML_SHARE} > {R.TEXT_SHARE} AS says, page_id % 3 = 1 AS lossy, lower(regexp_extract({_PATH} || [{', '.join(repr(x) for x in _SUFFIXES)}][page_id % {len(_SUFFIXES)} + 1], '(\\.[^./]*)$', 1)) AS ext FROM pages)
SELECT page_id, CASE WHEN ext IN {_in(R.TEXT)} THEN 2 WHEN ext IN {_in(R.TENSOR)} AND NOT (ext = '.bin' AND says AND NOT lossy) THEN 4 WHEN ext IN {_in((*R.AUDIO, *R.PHOTO))} THEN 4 WHEN ext IN {_in(R.IMAGE)} AND lossy THEN 4 WHEN ext IN {_in(R.PACKED)} THEN 5 WHEN says THEN 2 ELSE 0 END AS mode,
CASE WHEN ext IN {_in(R.TENSOR)} AND NOT (ext = '.bin' AND says AND NOT lossy) THEN 4 WHEN ext IN {_in(R.AUDIO)} AND lossy THEN 2 WHEN ext IN {_in(R.IMAGE)} AND lossy THEN 3 ELSE 1 END AS elem FROM p""",
    "q_dict_samples": f"SELECT doc_id, n FROM ({_FILE}) WHERE {_SAMPLED} ORDER BY path LIMIT {R.MAX_SAMPLES}",
    "q_dict_capacity": f"SELECT source, count(*) AS n, CAST(sum(n) AS BIGINT) AS total, CAST(CASE WHEN count(*) < 4 THEN 0 WHEN sum(n) < 5242880 THEN 32768 ELSE 114688 END AS BIGINT) AS capacity FROM ({_FILE}) WHERE {_SAMPLED} GROUP BY source",
    "q_codec_eligibility": f"SELECT doc_id, n < 52428800 AS brotli, n BETWEEN 4096 AND 1500000 AS bwt, n BETWEEN 256 AND 2097152 AS ppm_solid, n BETWEEN 256 AND 5242880 AS ppm_file FROM (SELECT doc_id, {_SIZE} AS n FROM documents)",
    "q_codec_level": f"SELECT doc_id, 9 AS normal, CASE WHEN n < 102400 THEN 22 WHEN n < 10485760 THEN 19 ELSE 12 END AS best, 1 AS fast FROM (SELECT doc_id, {_SIZE} * 4096 AS n FROM documents)",
    "q_corpus_filter": "SELECT page_id FROM pages WHERE NOT regexp_matches(url, '/\\.[^/]*/') AND octet_length(encode(html)) BETWEEN 1 AND 209715200",
    "q_ascii_docs": "SELECT doc_id, octet_length(encode(text)) = length(text) AS is_ascii FROM documents",
    "q_concat_pad": "SELECT item_id, md5(unhex(rpad(hex(encode(text)), 8192, '0') || substr(hex(encode(text)), 5, 10))) AS md5 FROM benchmark",
    "q_regex_tokens": f"WITH {_W} SELECT lang, count(*) AS n, count(DISTINCT part) AS n_distinct FROM w JOIN documents USING (doc_id) GROUP BY lang",
    "q_case_class": f"WITH {_W} SELECT lang, {_class('part')} AS class, count(*) AS n FROM w JOIN documents USING (doc_id) WHERE regexp_matches(part, '^[a-zA-Z]') GROUP BY ALL",
    "q_word_tokens": f"WITH {_W}, {_V}, {_T} SELECT CAST(id AS INTEGER) AS id, kind, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM t WHERE kind IS NOT NULL GROUP BY id, kind",
    "q_word_token_size": f"WITH {_W}, {_V}, {_T} SELECT doc_id, count(*) AS n_parts, count(kind) AS n_tokens, CAST(sum(CASE WHEN kind IS NOT NULL THEN 2 ELSE 2 * octet_length(encode(part)) - length(regexp_replace(part, '[^\\x00-\\x7F]', '', 'g')) END) AS BIGINT) AS packed_bytes FROM t GROUP BY doc_id",
    "q_word_codec": f"WITH {_W}, {_V}, {_T}, z AS (SELECT doc_id, CAST(sum(CASE WHEN kind IS NOT NULL THEN 2 ELSE 2 * octet_length(encode(part)) - length(regexp_replace(part, '[^\\x00-\\x7F]', '', 'g')) END) AS BIGINT) AS p FROM t GROUP BY doc_id) SELECT doc_id, {_SIZE} AS n, CAST(coalesce(p, 0) AS BIGINT) AS packed_bytes, md5(encode(coalesce(text, ''))) AS md5 FROM documents LEFT JOIN z USING (doc_id)",
    "q_detokenize": "SELECT doc_id, md5(text) AS md5 FROM documents WHERE text <> ''",
    "q_keyword_hits": f"SELECT page_id, length(html) AS n_chars, length({_replaced('html')}) AS packed_chars FROM pages",
    "q_indent_depth": "WITH l AS (SELECT page_id, unnest(string_split(replace(html, '<p>', chr(10) || '    <p>'), chr(10))) AS line FROM pages), n AS (SELECT page_id, line, length(regexp_extract(line, '^ *')) AS n FROM l), k AS (SELECT page_id, CASE WHEN n % 4 = 0 AND n BETWEEN 4 AND 124 AND n < length(line) THEN n - 1 END AS s FROM n) SELECT page_id, count(*) AS n_lines, count(s) AS n_indented, CAST(coalesce(sum(s), 0) AS BIGINT) AS saved FROM k GROUP BY page_id",
    "q_identifier_topk": f"WITH {_I} SELECT doc_id, CAST(rank AS INTEGER) AS rank, word, n, first FROM k WHERE rank <= 5",
    "q_dynamic_dictionary": f"WITH {_I} SELECT doc_id, CAST(slot AS INTEGER) AS slot, word, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rank) - 1 AS slot FROM k WHERE rank <= 100 AND length(word) >= 4 AND n >= 3 AND word NOT IN {_in(C.KEYWORDS)}) WHERE slot < 16",
    "q_prefix_tags": "SELECT page_id, CASE " + " ".join(f"WHEN starts_with(url, '{p}') THEN {i}" for i, p in enumerate(PREFIXES)) + " ELSE -1 END AS tag FROM pages",
    "q_magic_sniff": f"SELECT page_id, {_magic('html')} AS magic, {_magic('url')} AS url_magic FROM pages",
    "q_metrics": f"SELECT doc_id, n, packed, round(n / greatest(packed, 1), 4) AS ratio, round(CASE WHEN n > 0 THEN 100.0 * (n - packed) / CAST(n AS DOUBLE) ELSE 0 END, 4) AS saved_pct FROM (SELECT doc_id, {_SIZE} AS n, {_SIZE} // 3 AS packed FROM documents)",
    "q_empty_guard": "SELECT doc_id, CASE WHEN coalesce(length(text), 0) = 0 THEN 'empty' ELSE 'data' END AS state FROM documents",
}
