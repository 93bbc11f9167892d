"""Ids, names, prompts and labels as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def path_id(collection: Column | str, path: Column) -> Column:
    """SHA-1 of collection:path; null if either is."""
    c = F.lit(collection) if isinstance(collection, str) else collection
    return F.sha1(F.concat(c, F.lit(":"), path))


def pre_collection(collection: Column | str) -> Column | str:
    """The name of a collection of preprocessed crops, beside that of the whole images."""
    return f"{collection}_pre" if isinstance(collection, str) else F.concat(collection, F.lit("_pre"))


def content_id(content: Column) -> Column:
    """SHA-1 of the bytes, the same in every collection."""
    return F.sha1(content)


def crop_id(path: Column, j: Column) -> Column:
    return F.concat(path, F.lit(":"), j.cast("string"))


def source_path(ident: Column) -> Column:
    """What stands before the first colon of a crop id."""
    return F.split_part(ident, F.lit(":"), F.lit(1))


def crop_filename(ts: Column, j: Column) -> Column:
    return F.concat(F.replace(F.format_string("%.6f_%d", ts, j), F.lit("."), F.lit("_")), F.lit(".png"))


def terminated_prompt(text: Column) -> Column:
    """A prompt whose last visible character isn't a full stop gets one; any other stays as it is, with its trailing white space."""
    bare = F.regexp_replace(text, r"\s+$", "")
    return F.when(bare.endswith("."), text).otherwise(F.concat(bare, F.lit(" .")))


def two_places(x: Column) -> Column:
    """Two decimals; exact ties (odd eighths) go to the even digit."""
    x = x.cast("double")
    eighths = x * 8
    tie = (eighths == F.floor(eighths)) & (F.pmod(eighths, F.lit(2.0)) == 1)
    return F.format_string("%.2f", F.when(tie, F.bround(x.cast("decimal(20,3)"), 2).cast("double")).otherwise(x))


def label_text(label: Column, score: Column, most: int = 12) -> Column:
    return F.concat(F.substring(label, 1, most), F.lit(" "), two_places(score))


#: Fixed display colours (red, green, blue).
PALETTE = ((230, 60, 60), (60, 160, 230), (70, 200, 90), (240, 180, 40), (170, 90, 220), (60, 200, 200), (240, 120, 180), (140, 140, 140))


def palette(i: Column, colours: Sequence[tuple[int, int, int]] = PALETTE) -> Column:
    return F.element_at(F.array(*(F.array(*map(F.lit, c)) for c in colours)), F.pmod(i, F.lit(len(colours))).cast("int") + 1)


def text_anchor(x0: Column, y0: Column, dx: int = 3, up: int = 18) -> Column:
    return F.struct((x0 + dx).alias("x"), F.greatest(y0 - up, F.lit(0)).alias("y"))


def plural(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n != 1, F.lit("s")).otherwise(F.lit("")))
