"""Embedding shards on disk: Parquet files below ``train/``, two sidecar files, and a manifest.

A write puts its files into a folder of their own and lists them, with their rows
and bytes, in a table beside the data. Last of all the manifest, one small file that
names the folders in force, is renamed into place: a reader sees the whole old set
or the whole new one. Folders without a manifest are read by listing them.
"""

from __future__ import annotations

import json
import uuid
import warnings
from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom.session import exists, file_system, hadoop_path, read_text, replace_text, write_text

#: Rows per file (fixed value of the format).
ROWS_PER_SHARD = 100_000
METADATA = "metadata.json"
CARD = "README.md"
MANIFEST = "manifest.json"
FILES = "_files"


def _recursive(spark: SparkSession, path: str) -> DataFrame:
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
    return reader.schema(T.StructType([])).parquet(path)


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    """What the data set at ``path`` consists of, or ``None`` for a folder that was not written by ``write_shards``."""
    content = read_text(spark, f"{path.rstrip('/')}/{MANIFEST}")
    return None if content is None else json.loads(content)


def _file_table(spark: SparkSession, path: str, manifest: dict) -> DataFrame:
    """``shard, n_rows, n_bytes`` of a data set's files, from the tables beside the data."""
    root = path.rstrip("/")
    folders = [f"{root}/{FILES}/{v['name']}" for v in manifest["versions"]]
    found = spark.read.schema("name string, n_rows bigint, n_bytes bigint").parquet(*folders)
    return found.select(F.concat(F.lit(f"{root}/train/"), "name").alias("shard"), "n_rows", "n_bytes")


def list_shards(spark: SparkSession, paths: Sequence[str], limit_shards: int | None = None) -> list[str]:
    """The Parquet files of each data set, in path order, the first ``limit_shards`` of each."""
    found: list[str] = []
    for path in paths:
        manifest = read_manifest(spark, path)
        if manifest is None:
            files = sorted(unquote(name) for name in _recursive(spark, path).inputFiles())
            found.extend(files if limit_shards is None else files[:limit_shards])
            continue
        named = _file_table(spark, path, manifest).select("shard").orderBy("shard")
        found.extend(r[0] for r in (named if limit_shards is None else named.limit(limit_shards)).collect())  # a row per file
    return found


def read_shards(
    spark: SparkSession,
    paths: Sequence[str],
    limit_shards: int | None = None,
    columns: Sequence[str] = ("text", "embedding"),
) -> DataFrame:
    """The named columns of the shards of the data sets at ``paths``."""
    files = list_shards(spark, paths, limit_shards)
    if not files:
        raise FileNotFoundError(f"no Parquet files below {list(paths)}")
    return spark.read.parquet(*files).select(*columns)


def shard_row_count(spark: SparkSession, paths: Sequence[str], limit_shards: int | None = None) -> DataFrame:
    """Rows per shard: from the manifest, or from the file footers where there is none. No column is read."""
    parts = []
    for path in paths:
        manifest = read_manifest(spark, path)
        if manifest is not None:
            files = _file_table(spark, path, manifest).select("shard", "n_rows")
            parts.append(files if limit_shards is None else files.orderBy("shard").limit(limit_shards))
            continue
        rows = spark.read.schema(T.StructType([])).parquet(*list_shards(spark, [path], limit_shards))
        parts.append(rows.groupBy(F.col("_metadata.file_path").alias("shard")).agg(F.count("*").alias("n_rows")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def training_view(df: DataFrame, keep: Sequence[str] = ("sentence", "label")) -> DataFrame:
    """S3: ``text`` as ``sentence`` and ``embedding`` as ``label`` where those are kept; the rest goes."""
    renames = {"text": "sentence", "embedding": "label"}
    renamed = df.withColumnsRenamed({a: b for a, b in renames.items() if a in df.columns and b in keep})
    return renamed.select(*[c for c in renamed.columns if c in keep])


def _profile_columns(vector_col: str) -> list:
    size = F.size(vector_col)
    return [
        F.count(F.lit(1)).alias("n_rows"),
        F.min(size).cast("bigint").alias("min_dim"),
        F.max(size).cast("bigint").alias("max_dim"),
    ]


def _listed_columns(schema: T.StructType) -> str:
    return ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in schema.fields)


def _value_bytes(field: T.StructField):  # noqa: ANN202
    """The bytes of a column's values: of the text in UTF-8, of each number in its type's width; null has none."""
    col, kind = F.col(f"`{field.name}`"), field.dataType
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(col).cast("bigint"), F.lit(0))
    if isinstance(kind, T.ArrayType):
        width = {"double": 8, "bigint": 8, "float": 4, "int": 4}.get(kind.elementType.simpleString(), 0)
        return F.coalesce(F.when(F.size(col) >= 0, F.size(col) * F.lit(width)).cast("bigint"), F.lit(0))
    width = {"double": 8, "bigint": 8, "timestamp": 8, "float": 4, "int": 4, "date": 4, "smallint": 2, "tinyint": 1, "boolean": 1}
    return F.when(col.isNotNull(), F.lit(width.get(kind.simpleString(), 0))).otherwise(0).cast("bigint")


def dataset_profile(df: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """Rows, shortest and longest vector, bytes of all values, and the columns with their types."""
    size = sum((_value_bytes(f) for f in df.schema.fields), F.lit(0).cast("bigint"))
    counted = df.agg(*_profile_columns(vector_col), F.coalesce(F.sum(size), F.lit(0).cast("bigint")).alias("n_bytes"))
    return counted.withColumn("columns", F.lit(_listed_columns(df.schema)))


def dataset_facts(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Per written data set its names, files, rows, bytes on disk, vector length and columns, all from its manifest."""
    rows = []
    for path in paths:
        manifest = read_manifest(spark, path)
        if manifest is None:
            raise FileNotFoundError(f"no manifest at {path}")
        totals = [sum(v[k] for v in manifest["versions"]) for k in ("n_files", "n_rows", "n_bytes")]
        rows.append((path, manifest["model_name"], manifest["dataset_name"], *totals, manifest["dim"], manifest["columns"]))
    schema = "path string, model_name string, dataset_name string, n_files bigint, n_rows bigint, n_bytes bigint, dim bigint, columns string"
    return spark.createDataFrame(rows, schema)


def write_shards(
    df: DataFrame,
    out: str,
    rows_per_shard: int = ROWS_PER_SHARD,
    *,
    model_name: str,
    dataset_name: str,
    vector_col: str = "embedding",
    mode: str = "errorifexists",
    version: str | None = None,
) -> dict[str, int]:
    """Write files of at most ``rows_per_shard`` rows below ``out/train``, the two sidecars and the manifest.

    Vectors are stored as floats, every other column as a string. A vector that is
    missing or of another length than the first fails the job that writes; the row count
    is observed on the way. ``mode`` is ``errorifexists``, ``overwrite`` or ``append``;
    ``version`` names the folder of this write, and a version that the manifest has
    already is not written again. One writer at a time: an overwritten set's files stay
    until the next overwrite, for readers that are still at them.
    """
    if rows_per_shard < 1:
        raise ValueError("rows_per_shard must be positive")
    if mode not in ("errorifexists", "overwrite", "append"):
        raise ValueError(f"unknown mode {mode!r}")
    spark = df.sparkSession
    before = read_manifest(spark, out)
    if mode == "errorifexists" and (before is not None or exists(spark, f"{out}/train")):
        raise FileExistsError(f"there is a data set at {out}")
    versions = before["versions"] if before is not None else []
    if version is not None and any(v["name"] == version for v in versions):
        return {"n_rows": sum(v["n_rows"] for v in versions if v["name"] == version), "dim": before["dim"]}
    first = df.select(F.size(vector_col).alias("n")).first()
    if first is None:
        raise ValueError("no rows to write")
    dim = first["n"]
    if mode == "append" and versions and before["dim"] != dim:
        raise ValueError(f"the data set has vectors of length {before['dim']}, not {dim}")
    others = [F.col(c).cast("string").alias(c) for c in df.columns if c != vector_col]
    length = F.coalesce(F.size(vector_col), F.lit(-1))
    ragged = F.raise_error(F.concat(F.lit(f"ragged vectors: lengths {dim} and "), length.cast("string")))
    whole = F.when((length == dim) & (length >= 0), F.col(vector_col).cast("array<float>")).otherwise(ragged)
    rows = df.select(*others, whole.alias(vector_col))
    seen = Observation()
    observed = rows.observe(seen, *_profile_columns(vector_col))
    own = version or uuid.uuid4().hex
    observed.write.mode("overwrite").option("maxRecordsPerFile", rows_per_shard).parquet(f"{out}/train/{own}")
    facts = seen.get
    # The files as written: name, rows from the footers, bytes. A row per file, stored beside the data.
    written = spark.read.schema(T.StructType([])).parquet(f"{out}/train/{own}")
    name, size = F.regexp_extract("_metadata.file_path", "[^/]+/[^/]+$", 0), F.col("_metadata.file_size")
    files = written.groupBy(name.alias("name"), size.alias("n_bytes")).agg(F.count("*").alias("n_rows")).select("name", "n_rows", "n_bytes")
    files.coalesce(1).write.mode("overwrite").parquet(f"{out}/{FILES}/{own}")
    listed = spark.read.schema("name string, n_rows bigint, n_bytes bigint").parquet(f"{out}/{FILES}/{own}")
    totals = listed.agg(F.count("*").alias("n_files"), F.sum("n_rows").alias("n_rows"), F.sum("n_bytes").alias("n_bytes")).first().asDict()
    kept = versions if mode == "append" else []
    total_rows = sum(v["n_rows"] for v in kept) + facts["n_rows"]
    names = {"model_name": model_name, "dataset_name": dataset_name}
    write_text(spark, f"{out}/{METADATA}", json.dumps(names, indent=2, ensure_ascii=False))
    card = [
        "---",
        f"model_name: {model_name}",
        f"dataset_name: {dataset_name}",
        f"num_examples: {total_rows}",
        f"num_bytes: {sum(v['n_bytes'] for v in kept) + totals['n_bytes']}",
        f"length: {facts['max_dim']}",
        "---",
        "",
        f"{total_rows} rows of {dataset_name}, embedded with {model_name} ({facts['max_dim']} dimensions).",
        "",
    ]
    write_text(spark, f"{out}/{CARD}", "\n".join(card))
    manifest = names | {"dim": dim, "columns": _listed_columns(rows.schema), "versions": [*kept, {"name": own} | totals]}
    replace_text(spark, f"{out}/{MANIFEST}", json.dumps(manifest, indent=1, ensure_ascii=False))
    if mode == "overwrite":
        _drop_others(spark, out, {own, *(v["name"] for v in versions)})
    return {"n_rows": facts["n_rows"], "dim": facts["max_dim"]}


def _drop_others(spark: SparkSession, out: str, kept: set[str]) -> None:
    """Remove folders of this data set that are neither in force nor were until now: of earlier sets and of writes that failed."""
    for part in ("train", FILES):
        system = file_system(spark, f"{out}/{part}")
        for status in system.listStatus(hadoop_path(spark, f"{out}/{part}")):
            if status.isDirectory() and status.getPath().getName() not in kept:
                system.delete(status.getPath(), True)


def pair_by_position(
    texts: DataFrame, vectors: DataFrame, keys: Sequence[str] = ("shard", "row"), vector_col: str = "embedding"
) -> DataFrame:
    """Texts with the vectors of the same shard and row number.

    A text without a vector stops the job that reads the result: the check
    rides on the join instead of running it a second time.
    """
    if texts.isEmpty():
        raise ValueError("no texts found")
    joined = texts.join(vectors.select(*keys, F.col(vector_col).alias("__vector")), list(keys), "left")
    where = F.concat_ws(", ", *[F.concat(F.lit(f"{k} "), F.col(k).cast("string")) for k in keys])
    missing = F.raise_error(F.concat(F.lit("no vector for "), where))
    return joined.withColumn(vector_col, F.coalesce("__vector", missing)).drop("__vector")


def dataset_model_name(spark: SparkSession, paths: Sequence[str]) -> str | None:
    """The teacher named by the data sets' metadata; ``None`` if no one names it, an error if they differ.

    A data set without metadata beside one that has it gives a warning.
    """
    manifests = {p: read_manifest(spark, p) for p in paths}
    # A manifest says what is in force; a sidecar may already be the next set's.
    names = {m["model_name"] for m in manifests.values() if m is not None and m["model_name"]}
    files = [f"{p.rstrip('/')}/{METADATA}" for p, m in manifests.items() if m is None]
    present = [f for f in files if exists(spark, f)]
    if len(present) < len(files) < len(paths) or 0 < len(present) < len(files):
        warnings.warn(f"no metadata: {sorted(set(files) - set(present))}", stacklevel=2)
    if present:
        schema = "model_name string, dataset_name string"
        found = spark.read.schema(schema).option("multiLine", True).json(present)
        names |= {r[0] for r in found.filter(F.col("model_name") != "").select("model_name").distinct().limit(len(present)).collect()}
    if len(names) > 1:
        raise ValueError(f"several teacher models found: {sorted(names)}")
    return next(iter(names), None)


def write_vocabulary(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Save a vocabulary or a table of token counts."""
    df.write.mode(mode).parquet(path)


def read_vocabulary(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Load one or several saved tables; repeated tokens stay repeated."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    return reduce(lambda a, b: a.unionByName(b), [spark.read.parquet(p) for p in paths])
