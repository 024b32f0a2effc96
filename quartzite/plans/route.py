"""Which treatment a file gets: by type, size and settings, as projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartzite.functions.columns import extension

#: Types by suffix, each in alphabetical order.
TEXT = (
    ".1", ".asciidoc", ".bat", ".c", ".cfg", ".cmake", ".conf", ".cpp", ".css", ".csv", ".dockerfile", ".editorconfig", ".env", ".eslintrc", ".gitignore", ".go", ".graphql", ".h", ".html", ".ini", ".java", ".js", ".json", ".kt", ".log", ".m", ".makefile", ".md",
    ".org", ".php", ".prettierrc", ".properties", ".proto", ".ps1", ".py", ".r", ".rb", ".rs", ".rst", ".scala", ".sh", ".sql", ".swift", ".tex", ".toml", ".ts", ".txt", ".xml", ".yaml", ".yml",
)
TENSOR = (".bin", ".ckpt", ".h5", ".onnx", ".pt", ".pth", ".safetensors", ".tflite")
AUDIO, IMAGE, PHOTO = (".wav",), (".bmp", ".raw_video", ".yuv"), (".jpeg", ".jpg")
PACKED = (
    ".7z", ".aac", ".avi", ".avif", ".br", ".bz2", ".flac", ".gif", ".gz", ".heic", ".lz4", ".mkv", ".mov", ".mp3", ".mp4", ".ogg", ".opus", ".png", ".rar", ".webm", ".webp", ".woff", ".woff2", ".xz", ".zip", ".zst",
)
#: Suffixes of files that a dictionary may be trained on.
SAMPLED = (".c", ".cpp", ".css", ".csv", ".h", ".html", ".ini", ".java", ".js", ".json", ".log", ".md", ".py", ".ts", ".txt", ".xml", ".yaml", ".yml")
#: Modes.
GENERIC, WORDS, PLANES, STORED = 0, 2, 4, 5
#: The sniff looks at so many bytes and takes more than this share of printable ones for text.
SNIFF_BYTES, TEXT_SHARE = 512, 0.85


def printable_share(data: Column) -> Column:
    """Share of printable ASCII, tab, line feed and carriage return in the first bytes of a binary column; null for none."""
    head = F.hex(F.substring(data, 1, SNIFF_BYTES))
    n = F.length(head) / 2
    # two hex digits a byte: pairs that stand for 20..7E, 09, 0A and 0D
    pairs = F.regexp_extract_all(head, F.lit(".."), F.lit(0))
    good = F.size(F.filter(pairs, lambda p: ((p >= "20") & (p <= "7E")) | p.isin("09", "0A", "0D")))
    return F.when(n > 0, good / n)


def route(path: Column, data: Column | None = None, lossy: Column | None = None) -> tuple[Column, Column]:
    """(mode, element size) by suffix: words for text; planes for tensors, audio, photos, and images that may lose bits; what is packed is stored.

    Any other file, and one that ends in .bin, is words if its first bytes are text.  `route_one` is the same for one file.
    """
    ext = extension(path)
    lossy = F.lit(False) if lossy is None else lossy
    text = F.lit(False) if data is None else F.coalesce(printable_share(data), F.lit(0.0)) > TEXT_SHARE
    planes = (lossy & ext.isin(*AUDIO, *IMAGE, *TENSOR)) | ext.isin(*AUDIO, *PHOTO) | (ext.isin(*TENSOR) & ~((ext == ".bin") & text))
    mode = F.when(ext.isin(*TEXT), WORDS).when(planes, PLANES).when(ext.isin(*PACKED), STORED).when(text, WORDS).otherwise(GENERIC)
    elem = F.when(~planes, 1).when(ext.isin(*TENSOR), 4).when(lossy & ext.isin(*AUDIO), 2).when(lossy & ext.isin(*IMAGE), 3).otherwise(1)
    return mode.cast("int"), elem.cast("int")


def suffix(path: str) -> str:
    name = path.rpartition("/")[2]
    return name[name.rindex(".") :].lower() if "." in name else ""


_PRINTABLE = bytes([9, 10, 13, *range(32, 127)])


def route_one(path: str, head: bytes, lossy: bool = False) -> tuple[int, int]:
    """`route` of one file by its path and first bytes."""
    ext, head = suffix(path), head[:SNIFF_BYTES]
    text = len(head) > 0 and (len(head) - len(head.translate(None, _PRINTABLE))) / len(head) > TEXT_SHARE
    if ext in TEXT:
        return WORDS, 1
    if lossy and ext in AUDIO:
        return PLANES, 2
    if lossy and ext in IMAGE:
        return PLANES, 3
    if ext in TENSOR and not (ext == ".bin" and text and not lossy):
        return PLANES, 4
    if ext in AUDIO + PHOTO:
        return PLANES, 1
    if ext in PACKED:
        return STORED, 1
    return (WORDS, 1) if text else (GENERIC, 1)


#: Sizes that a candidate takes.
MIB = 1 << 20
ELIGIBLE = {"brotli": (0, 50 * MIB - 1), "bwt": (4096, 1_500_000), "ppm_solid": (256, 2 * MIB), "ppm_file": (256, 5 * MIB)}


def eligible(n: Column, codec: str) -> Column:
    lo, hi = ELIGIBLE[codec]
    return n.between(lo, hi)


#: Zstd levels of one block of many files and of one file, for speed as it is, fast, best.
SOLID_LEVELS, FILE_LEVELS = {"normal": 19, "fast": 1, "best": 22}, {"normal": 9, "fast": 1, "best": 22}


def level(n: Column, fast: bool = False, best: bool = False) -> Column:
    """zstd level of one file by its size: at best, the larger the lower."""
    if fast or not best:
        return F.lit(1 if fast else 9)
    return F.when(n < 100 << 10, 22).when(n < 10 * MIB, 19).otherwise(12)


#: A dictionary is trained on so many samples at most, the first by path.
MAX_SAMPLES = 100


def sampled(path: Column, n: Column) -> Column:
    """Whether a dictionary may be trained on a file: text by suffix, not empty and under 2 MiB."""
    return extension(path).isin(*SAMPLED) & (n > 0) & (n < 2 * MIB)


def dictionary_samples(df: DataFrame, path: Column, n: Column, most: int = MAX_SAMPLES) -> DataFrame:
    """The rows that a dictionary is trained on: the first by path."""
    return df.where(sampled(path, n)).orderBy(path).limit(most)


def capacity_of(samples: int, total: int) -> int:
    """Bytes of a dictionary: none under four samples, 32 KiB for less than 5 MiB of text, else 112 KiB."""
    return 0 if samples < 4 else 32 << 10 if total < 5 * MIB else 112 << 10


def dictionary_capacity(samples: Column, total: Column) -> Column:
    """`capacity_of` columns."""
    return F.when(samples < 4, 0).when(total < 5 * MIB, 32 << 10).otherwise(112 << 10).cast("long")
