"""File names, paths and class names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from framescore.schema import CLASS_NAMES, RAW_CLASSES

# The endings that mark a variant of an image.
FLIPPED, TRANSPOSED, DAMAGED, NOISY = "_flipped", "_tr", "_damaged", "_noisy"
FLIPPED_PATTERN = r"_flipped(\.[^./]*)?$"
ROOT_PATTERN = r"(?:_tr\d*|_flipped|_damaged|_noisy)+(\.[^./]*)?$"
FRAME_FORMAT = "frame_%03d.jpg"


def with_ending(name: Column, ending: Column | str) -> Column:
    """Put ``ending`` before the last extension, whichever it is: ``a.jpg`` becomes ``a_flipped.jpg``."""
    end = ending if isinstance(ending, Column) else F.lit(ending)
    extension = F.regexp_extract(name, r"[^/](\.[^./]*)$", 1)
    return F.concat(F.substring(name, F.lit(1), F.length(name) - F.length(extension)), end, extension)


def with_variant(name: Column, variant: Column, prefix: str = "_tr") -> Column:
    """Name variant ``i`` of an image: ``a.jpg`` becomes ``a_tr{i}.jpg``, ``b.png`` becomes ``b_tr{i}.png``."""
    return with_ending(name, F.concat(F.lit(prefix), variant.cast("string")))


def root(name: Column) -> Column:
    """The name of the image that a variant was made from: all variant endings taken off."""
    return F.regexp_replace(name, ROOT_PATTERN, "$1")


def is_flipped(name: Column) -> Column:
    return name.rlike(FLIPPED_PATTERN)


def mount_path(path: Column, scheme: str) -> Column:
    """Turn ``scheme:/a/b`` into ``/scheme/a/b``."""
    return F.regexp_replace(path, f"^{scheme}:/", f"/{scheme}/")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """The base name without its last extension."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def frame_name(number: Column) -> Column:
    return F.format_string(FRAME_FORMAT, number)


def _lookup(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def class_name(label: Column) -> Column:
    """0 and 1 as words; any other id is null."""
    return F.try_element_at(_lookup(CLASS_NAMES), label)


def class_id(name: Column) -> Column:
    """The id of a class word or of a raw dataset class; any other word is null."""
    ids = {**{word: i for i, word in CLASS_NAMES.items()}, **RAW_CLASSES}
    return F.try_element_at(_lookup(ids), name)


def label_to_text(label: Column) -> Column:
    return label.cast("string")


def text_to_label(text: Column) -> Column:
    """The integer in ``text``, null where it holds none."""
    return text.try_cast("int")
