"""Arrow UDFs over the plain functions, and their names in SQL.

Spark has no Unicode normalisation, so what depends on it is a Python function per value, moved in Arrow batches. All else
is a Column expression in ``scalars``.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import inbox, names, titles, volumes
from .schema import ddl


def _scalar(f: Callable, kind: str) -> Callable:
    @F.pandas_udf(ddl(kind))
    def run(s: pd.Series) -> pd.Series:
        return s.map(f, na_action=None)

    return run


def _rows(f: Callable, kind: str) -> Callable:
    """A struct per row; Spark names the fields by ``kind``."""
    fields = [x.strip().split(" ")[0] for x in kind.split(",")]

    @F.pandas_udf(ddl(kind))
    def run(*columns: pd.Series) -> pd.DataFrame:
        none = lambda v: None if v is None or (isinstance(v, float) and v != v) else v
        known: dict[tuple, tuple] = {}  # rows that repeat in a batch are read once
        out = []
        for row in zip(*columns):
            row = tuple(map(none, row))
            if row not in known:
                known[row] = f(*row)
            out.append(known[row])
        frame = pd.DataFrame([tuple(r) for r in out], columns=fields) if out else pd.DataFrame(columns=fields)
        for name in (x.strip().split(" ")[0] for x in kind.split(",") if x.strip().endswith(" int")):
            frame[name] = frame[name].astype("Int32")
        return frame

    return run


FOUND = "lo int, hi int, unit string, start int, stop int"
NAME = "author string, title string, volume_from int, volume_to int, unit string, completed boolean, tags array<string>, tail string, part string, part_no int, ext string"
ENTRY = "folder string, author string, title string, completed boolean, file_title string, volume_from int, volume_to int, unit string, side_label string, volume_completed boolean, tags array<string>, part string, part_no int, ext string"
INBOX = "key string, label string, title string, author string, volume_from int, volume_to int, unit string"
ITEM = "series_key string, volume_from int, volume_to int, unit string"
TITLED = "base string, volume int"

_NONE = (None,) * 5

nfkc = _scalar(lambda s: None if s is None else volumes.nfkc(s), "string")
series_key = _scalar(volumes.series_key, "string")
inbox_key = _scalar(inbox.inbox_key, "string")
romaji = _scalar(inbox.romaji, "string")
tidy_author = _scalar(titles.tidy_author, "string")
title_keys = _scalar(titles.title_keys, "array<string>")
author_variants = _scalar(titles.author_variants, "array<string>")
sanitize = _scalar(names.sanitize, "string")
find_volume = _rows(lambda s: volumes.find_volume(s) or _NONE, FOUND)
split_filename = _rows(names.split_filename, "stem string, part string, part_no int, ext string")
parse_filename = _rows(names.parse_filename, NAME)
parse_library_entry = _rows(names.parse_library_entry, ENTRY)
parse_inbox_name = _rows(inbox.parse_inbox_name, INBOX)
parse_item = _rows(volumes.parse_item, ITEM)
split_title = _rows(titles.split_title, TITLED)
split_rakuten = _rows(titles.split_rakuten, TITLED)
split_google = _rows(titles.split_google, TITLED)


@F.pandas_udf(ddl("int"))
def ndl_volume(raw: pd.Series, title: pd.Series) -> pd.Series:
    return pd.Series([titles.ndl_volume_of(r, t) for r, t in zip(raw, title)], dtype="Int32")


@F.pandas_udf(ddl("string"))
def volume_name(author: pd.Series, title: pd.Series, lo: pd.Series, hi: pd.Series, unit: pd.Series, completed: pd.Series, tail: pd.Series) -> pd.Series:
    none = lambda v: None if v is None or v != v else v
    return pd.Series([None if none(a) is None else names.plan_volume_name(none(au), ti, int(a), int(b), u, bool(c), none(tl)) for au, ti, a, b, u, c, tl in zip(author, title, lo, hi, unit, completed, tail)], dtype="object")


@F.pandas_udf(ddl("string"))
def folder_name(author: pd.Series, title: pd.Series, completed: pd.Series) -> pd.Series:
    return pd.Series([names.plan_folder_name(a, t, bool(c)) for a, t, c in zip(author, title, completed)], dtype="object")


@F.pandas_udf(ddl("string"))
def side_name(author: pd.Series, title: pd.Series, rest: pd.Series) -> pd.Series:
    return pd.Series([None if r is None else names.plan_side_name(a, t, r) for a, t, r in zip(author, title, rest)], dtype="object")


@F.pandas_udf(ddl("string"))
def rest_after_folder(title: pd.Series, folder: pd.Series) -> pd.Series:
    return pd.Series([names.rest_after_folder(a, b) for a, b in zip(title, folder)], dtype="object")


new_stem = _rows(names.new_stem, "stem string, suffix string")
move_name = _rows(
    lambda name, author, title, lo, hi, unit, base: names.fit_path(base or "", names.plan_name(name, author, title, None if lo is None else int(lo), None if hi is None else int(hi), unit), author, title),
    "folder string, file string, keep_name boolean",
)

SQL = {
    "nfkc": nfkc, "series_key": series_key, "inbox_key": inbox_key, "romaji": romaji, "tidy_author": tidy_author, "title_keys": title_keys, "author_variants": author_variants,
    "sanitize_segment": sanitize, "find_volume": find_volume, "split_filename": split_filename, "parse_filename": parse_filename, "parse_library_entry": parse_library_entry,
    "parse_inbox_name": parse_inbox_name, "parse_item": parse_item, "split_candidate_title": split_title, "split_rakuten_title": split_rakuten, "split_google_title": split_google,
    "ndl_volume": ndl_volume, "plan_volume_name": volume_name, "plan_folder_name": folder_name, "plan_side_name": side_name, "rest_after_folder": rest_after_folder, "plan_move_name": move_name,
}


def register(spark: SparkSession) -> None:
    """Makes the functions known to SQL by name."""
    for name, f in SQL.items():
        spark.udf.register(name, f)
