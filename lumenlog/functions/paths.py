"""What transcript paths say: file and line of a source, session, home, project folder."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SRC = r"^(.*):L(\d+)$"


def parse_src(src: Column) -> Column:
    """Struct (file, line) of "<file>:L<line>", or null."""
    return F.when(src.rlike(_SRC), F.struct(F.regexp_extract(src, _SRC, 1).alias("file"), F.regexp_extract(src, _SRC, 2).cast("long").alias("line")))


def base_name(file: Column) -> Column:
    return F.regexp_extract(file, r"[^\\/]*$", 0)


def rollout_session(file: Column) -> Column:
    """The session id that ends a rollout's name."""
    return F.right(F.regexp_replace(base_name(file), r"\.jsonl(\.zst)?$", ""), F.lit(36))


def project_folder(cwd: Column) -> Column:
    return F.regexp_replace(cwd, "[^a-zA-Z0-9]", "-")


def home_of(file: Column, home: str) -> Column:
    """"~/<dot folder>" that a transcript below home lies in, or null."""
    below = home.rstrip("/") + "/"
    first = F.split_part(F.substring(file, len(below) + 1, 1 << 30), F.lit("/"), F.lit(1))
    return F.when(file.startswith(below) & first.rlike(r"^\.."), F.concat(F.lit("~/"), first))
