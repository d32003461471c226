"""Expressions for names, hashes, splits and label lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sanitized(name: Column) -> Column:
    """A class name of small letters, digits, dots and single underscores; `unknown` if nothing is left."""
    out = F.regexp_replace(F.translate(F.trim(name), "/-", "__"), r"\s+", "_")
    out = F.regexp_replace(F.regexp_replace(out, r"[^0-9A-Za-z_.]+", "_"), r"_+", "_")
    return F.coalesce(F.nullif(F.lower(F.btrim(out, F.lit("_"))), F.lit("")), F.lit("unknown"))


def md5_bucket(key: Column, buckets: int = 100) -> Column:
    """The 128-bit number of the key's md5, modulo buckets, from its four 32-bit parts."""
    digest = F.md5(key)
    out = F.lit(0).cast("bigint")
    for i in range(4):
        part = F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint")
        out = F.pmod(out * (2**32 % buckets) + part, F.lit(buckets))
    return out


def sha1_bucket(key: Column, buckets: int = 100) -> Column:
    return F.pmod(F.conv(F.substring(F.sha1(key), 1, 8), 16, 10).cast("bigint"), F.lit(buckets))


def split_of(bucket: Column, train: int, valid: int) -> Column:
    """train, valid or test by a bucket of a hundred."""
    return F.when(bucket < train, "train").when(bucket < train + valid, "valid").otherwise("test")


def short_stem(dataset: Column, split: Column, path: Column, stem: Column) -> Column:
    return F.concat_ws("_", F.substring(dataset, 1, 28), split, F.substring(F.sha1(path), 1, 12), F.substring(stem, 1, 48))


def circuit_of(name: Column) -> Column:
    """drafter<D>_c<C> of a picture's name drafter_D_cC_dN_pP; null for other names."""
    found = lambda i: F.regexp_extract(name, r"drafter_(\d+)_c_?(\d+)_d(\d+)_p(\d+)", i)
    return F.when(found(1) != "", F.concat(F.lit("drafter"), found(1), F.lit("_c"), found(2)))


def source_of(name: Column, sources: list[str]) -> Column:
    """The first of the prefixes that a name begins with; `other` if none."""
    out = F.lit("other")
    for x in reversed(sources):
        out = F.when(name.startswith(x), x).otherwise(out)
    return out


def source_before_split(name: Column) -> Column:
    """What a name has before its first _train_, _valid_ or _test_; null without one."""
    found = F.regexp_extract(name, r"^(.*?)_(?:train|valid|test)_", 1)
    return F.when(name.rlike(r"^.*?_(?:train|valid|test)_"), found)


def source_by_parts(name: Column, anywhere: list[str], prefixes: list[str]) -> Column:
    """By the name in small letters: the first of these texts that it holds anywhere, else the first that it begins with, else `other`."""
    low = F.lower(name)
    return F.coalesce(*[F.when(low.contains(x), x) for x in anywhere], *[F.when(low.startswith(x), x) for x in prefixes], F.lit("other"))


def yolo_line(cls: Column, x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """`cls cx cy w h` with six places, of a corner box clamped to the picture; null if nothing of it is left."""
    x0, y0 = F.greatest(x, F.lit(0.0)), F.greatest(y, F.lit(0.0))
    x1, y1 = F.least(x + w, width), F.least(y + h, height)
    text = F.format_string("%d %.6f %.6f %.6f %.6f", cls, (x0 + x1) / 2 / width, (y0 + y1) / 2 / height, (x1 - x0) / width, (y1 - y0) / height)
    return F.when((x1 > x0) & (y1 > y0), text)


def label_issue(line: Column, n_classes: int) -> Column:
    """The first thing wrong with a label line of five words: columns, parse, class, area, bounds; null if nothing is."""
    t = F.split(F.trim(line), r"\s+")
    v = [F.get(t, i).try_cast("double") for i in range(5)]
    outside = F.lit(False)
    for i in (1, 2, 3, 4):
        outside = outside | (v[i] < -0.01) | (v[i] > 1.01)
    bad = v[0].isNull() | v[1].isNull() | v[2].isNull() | v[3].isNull() | v[4].isNull()
    return F.when(F.size(t) != 5, "columns").when(bad, "parse").when((v[0] < 0) | (v[0] >= n_classes), "class").when((v[3] <= 0) | (v[4] <= 0), "area").when(outside, "bounds")


def clean_label(line: Column, n_classes: int) -> Column:
    """The struct cls, cx, cy, w, h of a line's first five words, clamped to 0..1; null for lines that can't be used."""
    t = F.split(F.trim(line), r"\s+")
    v = [F.get(t, i).try_cast("double") for i in range(5)]
    clamp = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    cls = v[0].cast("bigint")
    good = (F.size(t) >= 5) & cls.between(0, n_classes - 1) & v[1].isNotNull() & v[2].isNotNull() & (clamp(v[3]) >= 1e-4) & (clamp(v[4]) >= 1e-4)
    return F.when(good, F.struct(cls.alias("cls"), clamp(v[1]).alias("cx"), clamp(v[2]).alias("cy"), clamp(v[3]).alias("w"), clamp(v[4]).alias("h")))
