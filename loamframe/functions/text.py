"""Text functions: names, titles, keys, soil lists."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

from loamframe import codes

def _fold_table() -> tuple[str, str]:
    """Latin letters whose compatibility decomposition leaves exactly one ASCII character."""
    pairs = []
    for code in [*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)]:
        plain = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            pairs.append((chr(code), plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _fold_table()


def ascii_fold(text: Column) -> Column:
    """Replace accented Latin letters by their base letter and drop what is not ASCII."""
    return F.regexp_replace(F.translate(text, ACCENTED, PLAIN), r"[^\x00-\x7F]", "")


def fold_identifier(name: str) -> str:
    """Driver-side form for a column *name*: folded, lower case, ``_`` for space and hyphen."""
    plain = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode()
    return plain.strip().lower().replace(" ", "_").replace("-", "_")


def harmonize_name(text: Column, max_length: int = 50) -> Column:
    """Identifier form of a label; long ones end in six hex digits of their md5; blank → NULL."""
    clean = F.btrim(F.regexp_replace(F.lower(text), "[^0-9a-zA-Z_]+", "_"), F.lit("_"))
    short = F.concat(F.substring(clean, 1, max_length - 7), F.lit("_"), F.substring(F.md5(clean), 1, 6))
    named = F.when(F.length(clean) > max_length, short).otherwise(clean)
    return F.when(F.length(F.trim(text)) > 0, named)


def title(identifier: Column) -> Column:
    """Display title of a collection id."""
    return F.initcap(F.translate(identifier, "_", " "))


def parse_soil_list(text: Column) -> Column:
    """``"[TILL Bon, SABLE]"`` → array of trimmed, non-empty class names."""
    bare = F.regexp_replace(F.regexp_replace(text, r"^[\[\]]+|[\[\]]+$", ""), "'", "")
    items = F.transform(F.split(bare, ","), lambda item: F.trim(item))
    return F.filter(items, lambda item: item != "")


def valid_hydro_group(group: Column) -> Column:
    """The hydrologic group when it is one of the known ones, else NULL."""
    return F.when(group.isin(codes.HYDRO_GROUPS), group)


def year_of(identifier: Column, default_year: int | None = None) -> Column:
    """Year named by an item id: ``_an_YYYY``, else a delimited 20YY, else any 20YY."""
    found = F.coalesce(
        *[
            F.nullif(F.regexp_extract(identifier, pattern, 1), F.lit(""))
            for pattern in (r"_an_(\d{4})", r"[_-](20\d{2})[_-]", r"(20\d{2})")
        ]
    )
    fallback = F.lit(default_year) if default_year is not None else F.year(F.current_date())
    return F.coalesce(found.cast("int"), fallback.cast("int"))


def bbox_key(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """Corner coordinates at four decimals, joined by commas."""
    return F.concat_ws(",", *[F.format_string("%.4f", c) for c in (minx, miny, maxx, maxy)])


def geometry_id(key: Column, masked: bool = False) -> Column:
    """Eight hex digits naming a box; masked products get their own id."""
    short = F.substring(F.md5(key), 1, 8)
    return F.concat(short, F.lit("_scl")) if masked else short


def file_stem(path: Column) -> Column:
    """File name without folder and extension."""
    return F.regexp_extract(path, r"([^/\\]+?)(\.[^./\\]+)?/?$", 1)


def file_extension(path: Column) -> Column:
    """Lower-case extension with its dot, ``''`` when there is none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)/?$", 1))
