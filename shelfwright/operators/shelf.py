"""What can be said about a series: whether it is complete, behind, caught up or unknown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def effective_completion(user: Column, folder: Column) -> Column:
    return F.coalesce(user, folder)


def completed_by(user: Column, folder: Column) -> Column:
    """``user`` or ``folder``: who says that the series is complete; null if it is not."""
    return F.when(user, "user").when(user.isNull() & folder, "folder")


def shelf_status(completed: Column, unchecked: Column, published_max: Column, ahead: Column) -> Column:
    """The owner's word first, then whether anything is known, then whether more has come out."""
    return (
        F.when(F.coalesce(completed, F.lit(False)), "owner-completed")
        .when(F.coalesce(unchecked, F.lit(True)) | published_max.isNull(), "unknown")
        .when(ahead > 0, "behind")
        .otherwise("caught-up")
    )


def shelf_label(status: Column, owned_max: Column, published_max: Column, missing: Column, latest_year: Column) -> Column:
    """The line to show; it never claims that nothing else exists."""
    owner = F.when(missing > 0, F.concat(F.lit("完結 — 未所持 "), missing, F.lit("巻"))).otherwise(F.lit("完結 — 揃っている"))
    sure = F.concat(F.lit("第"), published_max, F.lit("巻まで確認 — それ以降は不明"))
    return (
        F.when(status == "owner-completed", owner)
        .when(status == "unknown", F.lit("発行状況は未確認"))
        .when(status == "behind", F.concat(F.lit("続きが出ている — "), owned_max + 1, F.lit("〜"), published_max, F.lit("巻が未所持")))
        .otherwise(F.when(latest_year.isNotNull(), F.concat(latest_year, F.lit("年の"), sure)).otherwise(sure))
    )
