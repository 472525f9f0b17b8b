"""What people and visits write into the catalogue: marks a scan never touches, names of folders, picks and stamps.

Each takes the table and a small table of changes and gives the next version of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keyed import first_per_key


def _changed(df: DataFrame, changes: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """df with the values, made from the change ``_c``, in the rows that a change names."""
    c = changes.select(*keys, F.struct(*(x for x in changes.columns if x not in keys), F.lit(True).alias("_")).alias("_c"))
    d = df.join(c, keys, "left")
    hit = F.col("_c").isNotNull()
    return d.select(*(F.when(hit, values[x]).otherwise(F.col(x)).alias(x) if x in values else F.col(x) for x in df.columns))


def override_completion(series: DataFrame, choices: DataFrame) -> DataFrame:
    """choices (id, completed_user): true, false, or null to go by the folder again."""
    return _changed(series, choices, ["id"], {"completed_user": F.col("_c.completed_user")})


def set_care(files: DataFrame, marks: DataFrame) -> DataFrame:
    """marks (id, care, note, keep_note): a note that is kept survives, also when the mark is cleared."""
    return _changed(files, marks, ["id"], {"care": F.col("_c.care"), "care_note": F.when(F.col("_c.keep_note"), F.col("care_note")).otherwise(F.col("_c.note"))})


def pick(picks: DataFrame, choices: DataFrame) -> DataFrame:
    """picks (series_id, query_id, group_key, picked_at): the last choice of each series; a null group clears it."""
    d = picks.unionByName(choices)
    return first_per_key(d, ["series_id"], [F.desc("picked_at"), F.col("group_key")]).where("group_key is not null")


def visit(df: DataFrame, due: DataFrame, column: str, at: Column, id_: str = "id") -> DataFrame:
    """Stamps the rows that are about to be tried, so that one that fails goes to the end of the queue as well."""
    return _changed(df, due.select(id_).distinct(), [id_], {column: at})


def rename_folders(series: DataFrame, renames: DataFrame) -> DataFrame:
    """renames (id, to_folder, title, author, series_key): the series keeps its id and with it all that refers to it."""
    new = {c: F.coalesce(F.col(f"_c.{c}"), F.col(c)) for c in ("title", "author", "series_key")}
    return _changed(series, renames, ["id"], {"folder": F.col("_c.to_folder")} | new)


def move_below(files: DataFrame, renames: DataFrame) -> DataFrame:
    """The paths of the files of renamed folders: renames (series_id, from_folder, to_folder). Names are taken literally."""
    tail = F.substr(F.col("rel_path"), F.length("_c.from_folder") + 1, F.lit(1 << 30))
    inside = F.startswith(F.col("rel_path"), F.concat("_c.from_folder", F.lit("/")))
    return _changed(files, renames, ["series_id"], {"rel_path": F.when(inside, F.concat(F.col("_c.to_folder"), tail)).otherwise(F.col("rel_path"))})


def move_files(files: DataFrame, moves: DataFrame) -> DataFrame:
    """moves (id, to_path): one row each."""
    return _changed(files, moves, ["id"], {"rel_path": F.col("_c.to_path")})
