"""Dataset readers and the registry run.

A dataset lives in a JSONL folder as ``{name}.jsonl`` (one split, read as
``train``) or ``{name}_{split}.jsonl`` (one per split). Each may be a file
or a folder of part files. All selected paths are read by one scan; the
split comes from the path, so the read is one parallel job.

``.schemas/{name}.json`` beside the datasets is their schema catalogue: whoever
writes a dataset leaves its schema there, and readers that are given none take
it from there instead of inferring it (an extra pass over the files).
"""

from __future__ import annotations

import logging
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from distillery import options as O
from distillery.sources import fs
from distillery.sources.fs import exists, list_names

log = logging.getLogger(__name__)

# split names that cannot be part of a folder's name as they are
NULL_SPLIT, EMPTY_SPLIT, ESCAPE = "~null", "~empty", "~"


def dir_name(dataset_name: str) -> str:
    """Directory-safe dataset name: ``/`` -> ``_``."""
    return dataset_name.replace("/", "_")


def read_jsonl(spark: SparkSession, path, schema: T.StructType | str | None = None,
               split: str = "train") -> DataFrame:
    """A1: a single-split JSONL dataset, with an explicit schema when given
    (inference only when ``schema`` is None)."""
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.json(path).withColumn("split", F.lit(split))


def split_folder(split: Column) -> Column:
    """A split's name inside a folder name: nulls and empty names have words
    of their own, names that begin like those are escaped."""
    c = split.cast("string")
    return (F.when(c.isNull(), NULL_SPLIT).when(c == "", EMPTY_SPLIT)
            .when(c.startswith(ESCAPE), F.concat(F.lit(ESCAPE), c)).otherwise(c))


def split_of_folder(name: Column) -> Column:
    """The inverse of ``split_folder``."""
    return (F.when(name == NULL_SPLIT, F.lit(None).cast("string")).when(name == EMPTY_SPLIT, "")
            .when(name.startswith(ESCAPE), F.substring(name, 2, 1 << 30)).otherwise(name))


def save_schema(spark: SparkSession, jsonl_dir: str, name: str, schema: T.StructType) -> None:
    """Enter a dataset's schema (without ``split``) into the catalogue."""
    kept = T.StructType([f for f in schema.fields if f.name != "split"])
    fs.write_text(spark, f"{jsonl_dir.rstrip('/')}/.schemas/{dir_name(name)}.json", kept.json())


def load_schema(spark: SparkSession, jsonl_dir: str, name: str) -> T.StructType | None:
    import json

    text = fs.read_text(spark, f"{jsonl_dir.rstrip('/')}/.schemas/{dir_name(name)}.json")
    return T.StructType.fromJson(json.loads(text)) if text else None


def dataset_files(names: list[str], name: str, registry: list[str] | None = None) -> dict[str, str]:
    """A2 file selection: ``{split: entry}`` for ``name.jsonl`` /
    ``name_<split>.jsonl``. With a registry, an entry that belongs to a
    longer registered name (``a_b_train.jsonl`` next to ``a``) is skipped.
    A lone ``name.jsonl`` is split ``train``."""
    others = sorted((r for r in (registry or []) if r != name and r.startswith(name)), key=len, reverse=True)
    picked: dict[str, str] = {}
    for n in sorted(names):
        if not n.endswith(".jsonl") or not n.startswith(name):
            continue
        if any(n.startswith(o) and (n == f"{o}.jsonl" or n.startswith(o + "_")) for o in others):
            continue
        rest = n[len(name):-len(".jsonl")]
        if rest and not rest.startswith("_"):
            continue
        picked[rest.lstrip("_")] = n
    if list(picked) == [""]:
        return {"train": picked[""]}
    return picked


def read_dataset(spark: SparkSession, jsonl_dir: str, name: str, schema: T.StructType | str | None = None,
                 registry: list[str] | None = None) -> DataFrame | None:
    """A2: every split of ``name`` in ``jsonl_dir`` with a ``split`` column,
    ordered by split name; None when there is no file, or when the files are
    those of an interrupted ``publish``. Without ``schema`` that of the
    catalogue is taken, and without that it is inferred."""
    stem = dir_name(name)
    files = dataset_files(list_names(spark, jsonl_dir), stem, [dir_name(r) for r in registry or []])
    base = jsonl_dir.rstrip("/")
    if not files or exists(spark, _publishing(base, stem)):
        return None
    schema = schema if schema is not None else load_schema(spark, base, stem)
    paths = [f"{base}/{files[s]}" for s in sorted(files)]
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    df = r.json(paths)
    if sorted(files) == ["train"] and files["train"] == f"{stem}.jsonl":
        return df.withColumn("split", F.lit("train"))
    # the split is in the file name, or in the folder holding the part files
    pat = r"^.*/" + re.escape(stem) + r"_?([^/]*)\.jsonl(?:/[^/]*)?$"
    return df.withColumn("split", split_of_folder(F.regexp_extract(F.col("_metadata.file_path"), pat, 1)))


def _publishing(jsonl_dir: str, stem: str) -> str:
    return f"{jsonl_dir}/.{stem}.publishing"


def publish(spark: SparkSession, df: DataFrame, jsonl_dir: str, name: str) -> None:
    """Save a resolved source as JSONL, one folder per split. A marker stands
    while the folders are moved into place: readers pass over them as long as
    it does, and the next resolve goes on with the splits that are missing."""
    from distillery.sources.sinks import write_jsonl_splits

    base, stem = jsonl_dir.rstrip("/"), dir_name(name)
    marker = _publishing(base, stem)
    fs.write_text(spark, marker, "")
    write_jsonl_splits(df, f"{base}/{stem}")
    fs.delete(spark, marker)


def resolve_source(spark: SparkSession, entry: O.RegistryEntry, jsonl_dir: str,
                   snapshot_dir: str | None = None, schema=None,
                   registry: list[str] | None = None, save: bool = True) -> DataFrame:
    """A3: JSONL folder -> Parquet snapshot -> external local path.

    What a snapshot or a local path gave is saved as JSONL (``publish``) and
    read back from there, so the next resolve finds it; ``save=False`` leaves
    it as it is. The remote hub download is not available: the error names
    the path to provide instead.
    """
    df = read_dataset(spark, jsonl_dir, entry.name, schema, registry)
    if df is not None:
        return df
    df = _elsewhere(spark, entry, jsonl_dir, snapshot_dir, schema)
    if not save:
        return df
    publish(spark, df, jsonl_dir, entry.name)
    saved = read_dataset(spark, jsonl_dir, entry.name, schema, registry)
    # a source without rows leaves no split behind
    return saved.select(*df.columns) if saved is not None else df


def _elsewhere(spark: SparkSession, entry: O.RegistryEntry, jsonl_dir: str, snapshot_dir: str | None, schema) -> DataFrame:
    stem = dir_name(entry.name)
    if snapshot_dir:
        snap = f"{snapshot_dir.rstrip('/')}/{stem}"
        if exists(spark, snap):
            d = spark.read.parquet(snap)
            return d if "split" in d.columns else d.withColumn("split", F.lit("train"))
    p = entry.external_local_path
    if p and exists(spark, p):
        kind = entry.external_format or ("parquet" if p.rstrip("/").endswith(".parquet") else "json")
        if kind not in ("parquet", "json"):
            raise ValueError(f"unknown format {kind!r} of dataset {entry.name!r}")
        r = spark.read.schema(schema) if schema is not None and kind == "json" else spark.read
        d = r.format(kind).load(p)
        return d if "split" in d.columns else d.withColumn("split", F.lit("train"))
    raise FileNotFoundError(
        f"dataset {entry.name!r} not found; provide {jsonl_dir.rstrip('/')}/{stem}.jsonl, "
        f"a snapshot or an external_local_path (remote download is not available)")


def version_catalog(spark: SparkSession) -> DataFrame:
    """The (kind, size) -> revision table."""
    return spark.createDataFrame(O.VERSION_MAP, "kind STRING, size STRING, revision STRING")


def pick_version(spark: SparkSession, kind: str, size: str) -> str:
    """The revision for a teacher kind and dataset size; ValueError on
    an unknown kind or size."""
    if kind not in {k for k, _, _ in O.VERSION_MAP}:
        raise ValueError(f"Unknown model type: {kind}")
    rows = version_catalog(spark).filter((F.col("kind") == kind) & (F.col("size") == size)).collect()
    if not rows:
        raise ValueError(f"Invalid download size: {size}")
    return rows[0]["revision"]


def registry_sources(spark: SparkSession, entries: list[O.RegistryEntry], jsonl_dir: str,
                     snapshot_dir: str | None = None, schemas: dict | None = None):
    """One corpus ``Source`` per registry entry (file order inside each
    split); entries without a key are skipped by the corpus (B7) and not even
    looked up. Schemas come from ``schemas`` by entry name, else from the
    catalogue; what had to be inferred is entered into it."""
    from distillery.operators.corpus import Source

    names = [e.name for e in entries]
    out = []
    for e in entries:
        if not e.key:
            log.warning("dataset %s has no key; it contributes no rows", e.name)
            continue
        schema = (schemas or {}).get(e.name)
        df = resolve_source(spark, e, jsonl_dir, snapshot_dir, schema, names)
        if schema is None and load_schema(spark, jsonl_dir, e.name) is None:
            save_schema(spark, jsonl_dir, e.name, df.schema)
        out.append(Source(e.name, df, key=e.key, split=F.col("split"), row_key=None))
    return out
