"""Files as tables: Parquet, CSV, NDJSON and JSON arrays, declared schemas, hive and positional partitions, one table per file of a glob."""

from __future__ import annotations

import glob as globbing
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.errors import EngineError
from tributary.sources.types import json_cell, spark_type, struct_of
from tributary.storage import local

# Formats by file ending.
_ENDINGS = {".parquet": "parquet", ".csv": "csv", ".json": "json", ".jsonl": "json", ".ndjson": "json"}
_REMOTE = re.compile(r"^(s3a?|gs|gcs|az|azure|abfss?|https?|hdfs)://")


def infer_format(path: str, remote: bool = False) -> str:
    """Format by ending, behind a compression ending too; a remote path without a known ending is Parquet."""
    p = re.sub(r"[?#].*$", "", path) if remote else path
    p = re.sub(r"\.(gz|zst|bz2)$", "", p)
    found = _ENDINGS.get(os.path.splitext(p)[1].lower())
    if not found:
        if remote:
            return "parquet"
        raise EngineError("BAD_FORMAT", f"can't tell the format of {path!r}; set format")
    return found


def spark_uri(path: str) -> str:
    """A path as Spark's connectors spell it."""
    for short, full in (("s3://", "s3a://"), ("gcs://", "gs://"), ("azure://", "abfss://"), ("az://", "abfss://")):
        if path.startswith(short):
            return full + path[len(short) :]
    return path


def credentials(spark: SparkSession, origin: str, storage: dict) -> dict[str, str]:
    """Hadoop settings of one bucket; secrets stay scoped to it. Returns what was set."""
    m = re.match(r"(\w+)://([^/]+)", spark_uri(origin))
    conf: dict[str, str] = {}
    if m and m[1] == "s3a":
        b = f"fs.s3a.bucket.{m[2]}."
        if storage.get("type") == "access_key":
            conf = {b + "access.key": storage["access_key_id"], b + "secret.key": storage["secret_access_key"]}
        elif storage.get("type") == "credential_chain":
            conf = {b + "aws.credentials.provider": "com.amazonaws.auth.DefaultAWSCredentialsProviderChain"}
        conf |= {b + k: storage[v] for k, v in (("endpoint", "endpoint"), ("endpoint.region", "region"), ("session.token", "session_token")) if v in storage}
    elif m and m[1] == "gs":
        if storage.get("type") == "service_account":
            conf = {"fs.gs.auth.type": "SERVICE_ACCOUNT_JSON_KEYFILE", "fs.gs.auth.service.account.json.keyfile": storage["key_file"]}
        elif storage.get("type") == "credential_chain":
            conf = {"fs.gs.auth.type": "APPLICATION_DEFAULT"}
    elif m and m[1] == "abfss":
        account = storage.get("account") or m[2].rpartition("@")[2].split(".")[0]
        host = f"{account}.dfs.core.windows.net"
        if storage.get("type") == "access_key":
            conf = {f"fs.azure.account.key.{host}": storage["account_key"]}
        elif storage.get("type") == "sas":
            conf = {f"fs.azure.account.auth.type.{host}": "SAS", f"fs.azure.sas.fixed.token.{host}": storage["sas_token"]}
        elif storage.get("type") == "service_principal":
            oauth = "org.apache.hadoop.fs.azurebfs.oauth2.ClientCredsTokenProvider"
            conf = {f"fs.azure.account.auth.type.{host}": "OAuth", f"fs.azure.account.oauth.provider.type.{host}": oauth, f"fs.azure.account.oauth2.client.id.{host}": storage["client_id"],
                    f"fs.azure.account.oauth2.client.secret.{host}": storage["client_secret"], f"fs.azure.account.oauth2.client.endpoint.{host}": f"https://login.microsoftonline.com/{storage['tenant_id']}/oauth2/token"}
    for k, v in conf.items():
        spark.sparkContext._jsc.hadoopConfiguration().set(k, str(v))
    return conf


def _first_byte(path: str) -> str:
    files = sorted(globbing.glob(path)) if globbing.has_magic(path) else [path]
    for f in files:
        if os.path.isdir(f):
            files += sorted(os.path.join(f, x) for x in os.listdir(f) if not x.startswith((".", "_")))
            continue
        with open(f, "rb") as h:
            head = h.read(65536).lstrip()
        if head:
            return chr(head[0])
    return ""


def _layout(path: str, given: str) -> str:
    if given in ("array", "ndjson"):
        return given
    if _REMOTE.match(path):
        return "ndjson"
    first = _first_byte(local(path) or path)
    if first not in ("[", "{", ""):
        raise EngineError("BAD_FORMAT", f"{path!r} holds neither JSON objects nor an array of them")
    return "array" if first == "[" else "ndjson"


def read_table(spark: SparkSession, path: str, spec: dict | None = None) -> DataFrame:
    """One table of ``path``, a file, directory or glob.

    spec: format, csv {header, delimiter, quote}, json {format: auto, array, ndjson}, schema [{name, type}], partition_cols [{name, type}] of hive
    directories or segments [{name, index}] of positional ones, storage credentials. Declared columns that a file lacks are null.
    """
    spec = spec or {}
    uri, remote = spark_uri(path), bool(_REMOTE.match(path))
    if path.startswith(("http://", "https://")) and globbing.has_magic(path):
        raise EngineError("BAD_FORMAT", "a glob over http has no listing to match")
    if spec.get("storage"):
        credentials(spark, path, spec["storage"])
    fmt = spec.get("format") or infer_format(path, remote)
    schema, hive, segments = spec.get("schema"), spec.get("partition_cols"), spec.get("segments")
    if hive and segments:
        raise EngineError("CONFIG_TABLE", "hive and positional partitions can't be mixed")
    read = spark.read
    if hive:
        read = read.option("basePath", _literal_base(uri))
    if fmt == "parquet":
        df = read.parquet(uri)
    elif fmt == "csv":
        o = spec.get("csv", {})
        sep = o.get("delimiter", ",").replace("\\t", "\t")
        read = read.option("header", o.get("header", True)).option("sep", sep).option("quote", o.get("quote", '"')).option("escape", o.get("quote", '"'))
        df = read.option("inferSchema", not schema).option("preferDate", True).csv(uri)
    elif fmt == "json":
        layout = _layout(path, spec.get("json", {}).get("format", "auto"))
        df = _declared_json(spark, uri, schema, layout) if schema else read.option("multiLine", layout == "array").json(uri)
    else:
        raise EngineError("BAD_FORMAT", f"unknown format {fmt!r}")
    if schema and fmt != "json":
        have = {c.lower(): c for c in df.columns}
        parts = {p["name"] for p in hive or []}
        df = df.select(*[(F.col(f"`{have[c['name'].lower()]}`").try_cast(spark_type(c["type"])) if c["name"].lower() in have else F.lit(None).cast(spark_type(c["type"]))).alias(c["name"]) for c in schema], *[p for p in parts if p in df.columns])
    for p in hive or []:
        if p["name"] not in df.columns:
            raise EngineError("CONFIG_TABLE", f"no partition column {p['name']!r} in the directories of {path!r}")
        df = df.withColumn(p["name"], F.col(f"`{p['name']}`").try_cast(spark_type(p.get("type", "varchar"))))
    if segments:
        base = _literal_base(path).rstrip("/")
        parts = F.split(F.regexp_replace(F.col("_metadata.file_path"), f"^(file:)?/*\\Q{base.lstrip('/')}\\E/?", ""), "/")
        df = df.withColumns({s["name"]: F.when(F.size(parts) - 1 > s["index"], F.url_decode(F.get(parts, F.lit(s["index"])))).otherwise(F.lit("")).cast(spark_type(s.get("type", "varchar"))) for s in segments})
    return df


def _literal_base(path: str) -> str:
    """The directories of a glob before its first pattern."""
    parts = path.split("/")
    for k, p in enumerate(parts):
        if globbing.has_magic(p):
            return "/".join(parts[:k]) or "/"
    return path


def _declared_json(spark: SparkSession, uri: str, schema: list[dict], layout: str) -> DataFrame:
    """Objects with declared columns, cell by cell: what doesn't fit is null, nothing fails."""
    if layout == "array":
        rows = spark.read.text(uri, wholetext=True).select(F.explode(F.from_json(F.concat(F.lit('{"a":'), "value", F.lit("}")), "a array<variant>")["a"]).alias("row"))
    else:
        rows = spark.read.text(uri).filter(F.trim("value") != "").select(F.try_parse_json("value").alias("row"))
    cells = [json_cell(F.try_variant_get("row", "$['" + c["name"].replace("'", "\\'") + "']", "variant"), c.get("type", "varchar")).alias(c["name"]) for c in schema]
    return rows.select(*cells).select(*[F.col(f.name).cast(f.dataType) for f in struct_of(schema)])


def discover(path: str) -> dict[str, str]:
    """table name: file, for each file of a glob, named by its stem; a glob without files is an error."""
    files = sorted(f for f in globbing.glob(path, recursive=True) if not os.path.basename(f).startswith((".", "_")))
    if not files:
        raise EngineError("SOURCE_REGISTRATION", f"no file matches {path!r}")
    return {re.sub(r"\.(gz|zst|bz2)$", "", os.path.basename(f)).split(".")[0]: f for f in files}


def tables(spark: SparkSession, config: dict) -> dict[str, DataFrame]:
    """Tables of a file source: the declared ``tables`` [{name, path, ...}], or one per file of ``path``."""
    if config.get("tables"):
        out = {}
        for t in config["tables"]:
            path = t.get("path", config.get("path"))
            out[t["name"]] = read_table(spark, os.path.join(config["base"], path) if config.get("base") and not _REMOTE.match(path) else path, {**config, **t})
        return out
    return {n: read_table(spark, f, config) for n, f in discover(config["path"]).items()}
