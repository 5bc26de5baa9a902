"""Label sources: CSV files with varying column names, and folders named after labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewell import constants as K
from gradewell.functions.labels import integer_label, normalise_text, text_label


def detect_column(columns: Sequence[str], candidates: Sequence[str], strip: bool = False, required: bool = False) -> str | None:
    """First candidate found among the columns, ignoring case (and outer blanks with ``strip``)."""
    known: dict[str, str] = {}
    for column in columns:
        known[(column.strip() if strip else column).lower()] = column
    for candidate in candidates:
        if candidate.lower() in known:
            return known[candidate.lower()]
    if required:
        raise ValueError(f"none of {list(candidates)} among the columns {list(columns)}")
    return None


def read_label_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header, every column as text: types are decided per column, not inferred by a scan."""
    return spark.read.csv(path, header=True, inferSchema=False)


def scan_labels(table: DataFrame, source: str, require_label: bool = True, named_labels: bool = False) -> DataFrame:
    """(id, label, source, label_ok) from a label table with any of the known column names."""
    id_column = detect_column(table.columns, K.ID_COLUMNS, required=True)
    label_column = detect_column(table.columns, K.LABEL_COLUMNS, required=require_label)
    if label_column is None:
        label = F.lit(None).cast("int")
    else:
        label = (text_label if named_labels else integer_label)(F.col(f"`{label_column}`").cast("string"))
    scanned = table.select(F.trim(F.col(f"`{id_column}`").cast("string")).alias("id"), label.alias("label"), F.lit(source).alias("source"))
    return scanned.withColumn("label_ok", F.col("label").isNotNull() if label_column else F.lit(True))


def scan_report(scanned: DataFrame, objects: DataFrame | None = None, preview: int = 20) -> DataFrame:
    """Per source: rows, valid rows, label counts as JSON, whether every label is valid."""
    per_label = scanned.groupBy("source", "label").agg(F.count(F.lit(1)).alias("n"), F.count_if("label_ok").alias("ok"))
    labelled = F.col("label").isNotNull()
    pairs = F.sort_array(F.collect_list(F.when(labelled, F.struct(F.col("label").cast("string").alias("k"), F.col("n").alias("v")))))
    return per_label.groupBy("source").agg(
        F.sum("n").alias("n_rows"), F.sum("ok").alias("n_valid"),
        F.to_json(F.map_from_entries(pairs)).alias("label_counts"), (F.sum("n") == F.sum("ok")).alias("all_valid"))


def normalise_layout(table: DataFrame, prefix: str = "train_images", extension: str = ".png") -> DataFrame:
    """(image_path, label) tables as they are; (id_code, diagnosis) tables with the path built from the id."""
    columns = {c.lower(): c for c in table.columns}
    if "image_path" in columns and "label" in columns:
        return table.select(F.col(columns["image_path"]).alias("image_path"), integer_label(F.col(columns["label"])).alias("label"))
    if "id_code" in columns and "diagnosis" in columns:
        path = F.concat_ws("/", F.lit(prefix), F.concat(F.col(columns["id_code"]).cast("string"), F.lit(extension)))
        return table.select(path.alias("image_path"), integer_label(F.col(columns["diagnosis"])).alias("label"))
    raise ValueError("expected (image_path, label) or (id_code, diagnosis) columns")


def folder_labels(paths: DataFrame, mapping: Mapping[str, int] = K.LABEL_SYNONYMS, path: str = "path",
                  split_names: Sequence[str] = ("train", "val", "test")) -> DataFrame:
    """(path, id, folder, split, label) from ``<root>[/<split>]/<folder>/<file>``; unknown folders have no label."""
    parts = F.split(F.col(path), "/")
    folder, above = F.try_element_at(parts, F.lit(-2)), F.lower(F.try_element_at(parts, F.lit(-3)))
    name = F.element_at(parts, -1)
    return paths.select(
        F.col(path).alias("path"), F.regexp_replace(name, r"\.[^.]*$", "").alias("id"), folder.alias("folder"),
        F.when(above.isin(*split_names), above).alias("split"), text_label(folder, mapping).alias("label"))


def scan_folder_labels(spark: SparkSession, root: str, mapping: Mapping[str, int] = K.LABEL_SYNONYMS,
                       extensions: Sequence[str] = K.EXTENSIONS) -> tuple[DataFrame, DataFrame]:
    """(labelled files, unclear files) under a root; file contents are not read."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    known = listing.filter(F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).isin(*extensions))
    labelled = folder_labels(known, mapping)
    unclear = labelled.filter("label is null").select(
        "path", "folder", F.lit("Unmapped folder name").alias("reason"))
    return labelled.filter("label is not null"), unclear
