"""python -m quartzite.cli compress|decompress|info: archives from the command line, with JSON lines as progress."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quartzite import api


def say(**fields) -> None:
    print(json.dumps(fields), flush=True)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quartzite")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("compress", "decompress", "info"):
        c = sub.add_parser(name)
        c.add_argument("source")
        c.add_argument("--passphrase-file", help="a file with the passphrase of encrypted containers")
    c = sub.choices["compress"]
    c.add_argument("target")
    c.add_argument("--solid", dest="solid", action="store_true", default=True, help="pack files together (as it is)")
    c.add_argument("--files", dest="solid", action="store_false", help="pack each file alone")
    c.add_argument("--virtually-lossless", "--vl", dest="lossy", type=int, nargs="?", const=1, default=0, metavar="N", help="clear low bits of tensors, audio and images: level N, 1 if none is given")
    c.add_argument("--fast", dest="speed", action="store_const", const="fast", default="normal")
    c.add_argument("--best", dest="speed", action="store_const", const="best")
    c.add_argument("--ignore", nargs="*", default=(), metavar="FOLDER", help="names of folders to leave out")
    c = sub.choices["decompress"]
    c.add_argument("target", help="a folder that gets the files")
    c.add_argument("--table", action="store_true", help="write a Parquet table instead of files")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    say(status="started", command=a.command)
    try:
        passphrase = Path(a.passphrase_file).read_text().rstrip("\n") if a.passphrase_file else None
        if a.command == "compress":
            say(status="done", **api.compress(spark, a.source, a.target, a.solid, tuple(a.ignore), a.lossy, a.speed, passphrase))
        elif a.command == "decompress" and a.table:
            api.decompress(spark, a.source, passphrase).select("path", "content").write.parquet(a.target)
            say(status="done", files=spark.read.parquet(a.target).count())
        elif a.command == "decompress":
            say(status="done", **api.restore(spark, a.source, a.target, passphrase))
        else:
            rows = api.decompress(spark, a.source, passphrase).select("path", "mode", F.octet_length("content").alias("n"))
            for r in rows.orderBy("path").toLocalIterator():
                say(path=r.path, mode=r.mode, bytes=r.n)
    except Exception as e:
        say(status="error", message=str(e)[:500])
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
