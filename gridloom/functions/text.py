"""Names, stamps and maps: what scenes, checkpoints and maps are called by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def map_name(name: Column) -> Column:
    """A map's name without the mark of its layered variant."""
    return F.regexp_replace(name, "_Opt$", "")


def number_after(name: Column, mark: str = "_", place: int = 1) -> Column:
    """The part after the mark as a number; null where it isn't one."""
    return F.try_element_at(F.split(name, mark), F.lit(place + 1)).try_cast("long")


def padded(prefix: str, number: Column, digits: int = 6) -> Column:
    """prefix and the number with leading zeros; a longer number is whole."""
    text = number.cast("string")
    return F.concat(F.lit(prefix), F.repeat(F.lit("0"), F.greatest(F.lit(digits) - F.length(text), F.lit(0))), text)


def epoch_of(path: Column) -> Column:
    """The number of a checkpoint's file name; null where it has none."""
    return F.regexp_extract(path, r"epoch[_-]?(\d+)\.[A-Za-z]+$", 1).try_cast("long")


def run_stamp(t: Column) -> Column:
    return F.date_format(t, "yyyyMMdd-HHmmss")


def merged_maps(left: Column, right: Column) -> Column:
    """Entries of both maps; the right one's win."""
    return F.map_concat(F.map_filter(left, lambda k, v: ~F.map_contains_key(right, k)), right)


def latest(files: DataFrame, path: str) -> DataFrame:
    """(path, epoch) of the checkpoint with the greatest number, the last name of equal ones; no row without any."""
    found = files.select(path, epoch_of(F.col(path)).alias("epoch")).where("epoch is not null")
    return found.agg(F.max(F.struct("epoch", path)).alias("m")).where("m is not null").select(f"m.{path}", "m.epoch")


def next_number(names: DataFrame, name: str) -> DataFrame:
    """One row: the number after the greatest in the names, 0 without any."""
    return names.agg((F.coalesce(F.max(number_after(F.col(name))), F.lit(-1)) + 1).alias("next"))


def display_rank(name: Column, known: list[str]) -> Column:
    """Where a camera is shown; unknown ones are last, in their order."""
    place = F.array_position(F.array(*map(F.lit, known)), name)
    return F.when(place > 0, place - 1).otherwise(len(known)).cast("int")
