"""Joins between question and sheet tables (J1-J4) and key coverage (A2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizlens.plans.sizing import cut_lineage

# A folder list is a handful of names; anything above this is not a split list.
MAX_SPLIT_FOLDERS = 10_000


def semi_join_sheets(sheets: DataFrame, mcqs: DataFrame, id_col: str = "id") -> DataFrame:
    """Sheets whose id occurs among the questions.

    The ids are made distinct first: a semi join cannot split its right side,
    and a sheet that a third of all questions cite is then one row of it.
    """
    return sheets.join(mcqs.select(id_col).distinct(), id_col, "left_semi")


def semi_join_mcqs(mcqs: DataFrame, sheets: DataFrame, id_col: str = "id") -> DataFrame:
    """Questions whose id occurs among the sheets (J2); a hot id is on the left side, which AQE splits."""
    return mcqs.join(sheets.select(id_col), id_col, "left_semi")


def attach_sheet(mcqs: DataFrame, sheets: DataFrame, id_col: str = "id",
                 sheet_col: str = "content_gpt") -> DataFrame:
    """Left join bringing only the sheet text.

    Duplicate sheet ids multiply question rows, as a left merge does.  The
    strategy is left to Catalyst/AQE (broadcast when the sheet side turns out
    small at run time, sort-merge otherwise).
    """
    return mcqs.join(sheets.select(id_col, sheet_col), id_col, "left")


def _folder_names(folders: DataFrame, list_col: str) -> list[str] | None:
    """The split's folder names when there are at most MAX_SPLIT_FOLDERS, else None."""
    names = folders.select(F.col(list_col).alias("_folder")).distinct().limit(MAX_SPLIT_FOLDERS + 1).collect()
    if len(names) > MAX_SPLIT_FOLDERS:
        return None
    return sorted(r["_folder"] for r in names if r["_folder"] is not None)


def test_split(sheets: DataFrame, folders: DataFrame, folder_col: str = "folder",
               list_col: str = "folder") -> DataFrame:
    """Sheets whose folder is in the split list.

    A split list is a handful of names: read with a proven bound, it becomes a
    literal ``IN`` filter - pushed into the scan, and pruning whole folders
    when the sheets are stored partitioned by folder.  An oversized list falls
    back to a shuffle semi join.
    """
    names = _folder_names(folders, list_col)
    if names is not None:
        return sheets.where(F.col(folder_col).isin(names))
    side = cut_lineage(folders.select(F.col(list_col).alias("_folder")).distinct())
    return sheets.join(side, sheets[folder_col] == side["_folder"], "left_semi")


def train_split(sheets: DataFrame, folders: DataFrame, folder_col: str = "folder",
                list_col: str = "folder") -> DataFrame:
    """The complement of :func:`test_split`; a NULL folder is on the training side."""
    names = _folder_names(folders, list_col)
    if names is not None:
        return sheets.where(F.col(folder_col).isNull() | ~F.col(folder_col).isin(names))
    side = cut_lineage(folders.select(F.col(list_col).alias("_folder")).where(F.col("_folder").isNotNull()).distinct())
    return sheets.join(side, sheets[folder_col] == side["_folder"], "left_anti")


def key_coverage(mcqs: DataFrame, sheets: DataFrame, id_col: str = "id") -> DataFrame:
    """Replaces the equal-length check with a report of how ids match (A2).

    One row per measure: question rows, sheet rows, distinct ids on each side,
    question ids without a sheet, sheet ids cited by no question, and ids
    duplicated on the sheet side (those multiply rows in the left join).
    """
    q = mcqs.groupBy(id_col).agg(F.count(F.lit(1)).alias("q_rows"))
    s = sheets.groupBy(id_col).agg(F.count(F.lit(1)).alias("s_rows"))
    both = q.join(s, id_col, "full")
    wide = both.agg(
        F.coalesce(F.sum("q_rows"), F.lit(0)).alias("mcq_rows"),
        F.coalesce(F.sum("s_rows"), F.lit(0)).alias("sheet_rows"),
        F.count("q_rows").alias("mcq_ids"),
        F.count("s_rows").alias("sheet_ids"),
        F.count_if(F.col("s_rows").isNull()).alias("mcq_ids_without_sheet"),
        F.count_if(F.col("q_rows").isNull()).alias("sheet_ids_without_mcq"),
        F.count_if(F.col("s_rows") > 1).alias("duplicated_sheet_ids"),
    )
    names = wide.columns
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("measure"), F.col(n).cast("long").alias("value")) for n in names])))
