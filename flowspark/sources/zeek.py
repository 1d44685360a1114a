"""Zeek TSV logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from flowspark.functions.keys import col

# --- fixed values: log types in match order, and the known field sets -------------------
LOG_TYPES = (
    "conn", "dns", "http", "ssl", "x509", "notice", "weird", "files", "kerberos", "rdp", "smb_mapping",
    "smb_files", "ssh", "ftp", "mysql", "pe", "radius", "syslog", "tunnel",
)
KNOWN_FIELDS = {
    "conn": (
        "ts", "uid", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", "proto", "service", "duration",
        "orig_bytes", "resp_bytes", "conn_state", "local_orig", "local_resp", "missed_bytes", "history",
        "orig_pkts", "orig_ip_bytes", "resp_pkts", "resp_ip_bytes", "tunnel_parents",
    ),
    "dns": (
        "ts", "uid", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", "proto", "trans_id", "rtt", "query",
        "qclass", "qclass_name", "qtype", "qtype_name", "rcode", "rcode_name", "AA", "TC", "RD", "RA", "Z",
        "answers", "TTLs", "rejected",
    ),
    "http": (
        "ts", "uid", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", "proto", "trans_depth", "method",
        "host", "uri", "referrer", "version", "user_agent", "request_body_len", "response_body_len",
        "status_code", "status_msg", "info_code", "info_msg", "filename", "tags", "username", "password",
        "proxied", "orig_fuids", "orig_mime_types", "resp_fuids", "resp_mime_types",
    ),
    "ssl": (
        "ts", "uid", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", "proto", "version", "cipher", "curve",
        "server_name", "resumed", "established", "cert_chain_fuids", "client_cert_chain_fuids", "subject",
        "issuer", "validation_status", "ja3", "ja3s",
    ),
    "notice": (
        "ts", "uid", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", "proto", "note", "msg", "sub", "src",
        "dst", "p", "n", "peer_descr", "actions", "suppress_for", "dropped", "remote_location.country_code",
        "remote_location.region", "remote_location.city", "remote_location.latitude",
        "remote_location.longitude",
    ),
}


def zeek_log_type(path: str | Column, fields: str | Column) -> Column:
    """Type by file stem (first contained name wins), else by best header overlap of at least 3."""
    stem = F.lower(F.replace(F.replace(F.substring_index(col(path), "/", -1), F.lit(".log"), F.lit("")), F.lit(".gz"), F.lit("")))
    out = F.when(F.lit(False), F.lit("unknown"))
    for name in LOG_TYPES:
        out = out.when(F.contains(stem, F.lit(name)), name)
    overlap = {
        name: F.size(F.array_intersect(col(fields), F.array(*[F.lit(f) for f in known])))
        for name, known in KNOWN_FIELDS.items()
    }
    best = F.greatest(*overlap.values())
    by_header = F.when(F.coalesce(best, F.lit(0)) < 3, "unknown")
    for name, score in overlap.items():
        by_header = by_header.when(score == best, name)
    return out.otherwise(by_header)


def header_fields(line: str | Column) -> Column:
    """Field names of a ``#fields`` line."""
    names = F.split(F.rtrim(col(line)), "\t")
    return F.when(F.startswith(col(line), F.lit("#fields")), F.slice(names, 2, F.greatest(F.size(names) - 1, F.lit(0))))


def parse_zeek_lines(df: DataFrame, line: str = "line", fields: str = "header", path: str = "file_path") -> DataFrame:
    """Add ``fields_raw`` (name to text) and ``log_type``; comment lines are dropped.

    Short lines are padded with empty text, long ones cut.
    """
    values = F.split(F.col(line), "\t")
    n = F.size(fields)
    padded = F.slice(F.concat(values, F.array_repeat(F.lit(""), n)), F.lit(1), n)
    return df.filter(~F.startswith(F.col(line), F.lit("#"))).withColumns(
        {"fields_raw": F.map_from_arrays(fields, padded), "log_type": zeek_log_type(path, fields)}
    )


def read_zeek(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Log files as records with 1-based line numbers after the header.

    Lines are numbered inside each input split, and the splits' line counts (one row per
    split) give the offsets, so big files are read in parallel. Files without a ``#fields``
    line give no records.
    """
    lines = spark.read.text(paths, lineSep="\n").select(
        F.make_valid_utf8("value").alias("line"),
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"),
    )
    split = Window.partitionBy("file_path", "_block")
    numbered = lines.withColumn("_n", F.row_number().over(split.orderBy("_id")))
    counts = lines.groupBy("file_path", "_block").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy("file_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "file_path", "_block", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_offset")
    )
    placed = numbered.join(offsets, ["file_path", "_block"]).withColumn("_at", F.col("_n") + F.col("_offset"))
    headers = (
        placed.filter(F.startswith("line", F.lit("#fields")))
        .groupBy("file_path")
        .agg(F.min_by("line", "_at").alias("_header"), F.min("_at").alias("_header_at"))
        .withColumn("header", header_fields("_header"))
    )
    rows = placed.join(headers, "file_path").filter(F.col("_at") > F.col("_header_at"))
    parsed = parse_zeek_lines(rows)
    return parsed.select(
        "log_type", "fields_raw", F.col("line").alias("raw_line"), "file_path",
        (F.col("_at") - F.col("_header_at")).alias("line_number"),
    )


_VALUE = "STRUCT<kind: STRING, s: STRING, i: BIGINT, d: DOUBLE, b: BOOLEAN, arr: ARRAY<STRING>>"
_INT = r"^\s*[+-]?\d+\s*$"
_FLOAT = r"^\s*[+-]?(\d+\.\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def zeek_value(value: Column, name: Column) -> Column:
    """Typed form of one field: null, bool, list, double, int or text."""

    def typed(kind: str, **field: Column) -> Column:
        parts = {"s": "string", "i": "bigint", "d": "double", "b": "boolean", "arr": "array<string>"}
        return F.struct(
            F.lit(kind).alias("kind"),
            *[field.get(n, F.lit(None)).cast(t).alias(n) for n, t in parts.items()],
        )

    items = F.transform(F.split(value, ","), lambda v: F.trim(v))
    return (
        F.when((value == "-") | (value == ""), F.lit(None).cast(_VALUE))
        .when(value == "T", typed("bool", b=F.lit(True)))
        .when(value == "F", typed("bool", b=F.lit(False)))
        .when(F.contains(value, F.lit(",")) & (name != "ts"), typed("list", arr=items))
        .when(value.rlike(_FLOAT), typed("double", d=value.try_cast("double")))
        .when(value.rlike(_INT) & value.try_cast("bigint").isNotNull(), typed("int", i=value.try_cast("bigint")))
        .otherwise(typed("string", s=value))
    )


def zeek_field(name: str, fields_raw: str | Column = "fields_raw") -> Column:
    """Typed form of the one field ``name``, as ``fields`` holds it; the other fields of the record stay text."""
    value = col(fields_raw)[name]
    return F.when(value.isNotNull(), zeek_value(value, F.lit(name)))


def normalize_zeek(df: DataFrame) -> DataFrame:
    """Add ``fields`` (typed values) and ``timestamp`` (0 when ``ts`` is not a number)."""
    raw_ts = F.col("fields_raw")["ts"]
    number = F.when(raw_ts.rlike(_FLOAT) | raw_ts.rlike(_INT), raw_ts.try_cast("double"))
    return df.withColumns(
        {
            "fields": F.transform_values("fields_raw", lambda k, v: zeek_value(v, k)),
            "timestamp": F.coalesce(number, F.lit(0.0)),
        }
    )


def zeek_flow_key(fields_raw: str | Column = "fields_raw") -> Column:
    """Directed key when all five connection fields are present, else null."""
    f = col(fields_raw)
    return F.concat(
        f["id.orig_h"], F.lit(":"), f["id.orig_p"], F.lit("->"),
        f["id.resp_h"], F.lit(":"), f["id.resp_p"], F.lit("/"), f["proto"],
    )


def zeek_uid(fields_raw: str | Column = "fields_raw") -> Column:
    return col(fields_raw)["uid"]
