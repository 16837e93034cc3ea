"""Documents out of JSON, CSV and XML payloads. Every function takes a DataFrame with one payload
a row and returns a row per record, ``id, content, metadata`` after the columns in ``keep``.

Null and malformed payloads give no rows; absent and empty ids and contents fall back to the
record's number in its payload and to the record itself; a record without type gets ``content``."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import texts


def json_path(path: str) -> str:
    """``a.b[0].c`` and ``a.0.c`` as a JSON path; a number is a place in an array."""
    steps = []
    for part in path.split("."):
        m = re.fullmatch(r"(\w+)\[(\d+)\]", part)
        steps.append(f".{m[1]}[{m[2]}]" if m else f"[{part}]" if part.isdigit() else f".{part}")
    return "$" + "".join(steps)


def field(payload: Column, path: str) -> Column:
    """The value at a dotted path as text; null where any step is missing."""
    return F.get_json_object(payload, json_path(path))


def dollar_items(payload: Column, path: str) -> Column:
    """Elements (as JSON) of the array at ``$.a.b[*]``. What follows the first ``[*]`` is ignored; a path
    without ``$.`` stands for the payload itself; anything but an array there is an error."""
    if not path.startswith("$."):
        return F.from_json(payload, "array<string>")
    at = F.get_json_object(payload, path.split("[*]")[0])
    items = F.when(F.substring(F.ltrim(at), 1, 1) == "[", F.from_json(at, "array<string>"))
    return F.when(items.isNull() & payload.isNotNull(), F.raise_error(F.lit(f"no array at {path}"))).otherwise(items) if "[*]" in path else F.array(at)


def _items(payload: Column, document_path: str | None) -> Column:
    at = field(payload, document_path) if document_path else payload
    return F.when(F.substring(F.ltrim(at), 1, 1) == "[", F.from_json(at, "array<string>")).when(at.isNotNull(), F.array(at))


def _documents(records: DataFrame, mapping: dict[str, str], constants: dict[str, str], keep: list[str], default_type: str | None) -> DataFrame:
    item, own = F.col("_item"), lambda f: field(F.col("_item"), mapping.get(f, f))
    meta = {k: field(item, v) for k, v in mapping.items() if k not in ("id", "content")} | {k: F.lit(v) for k, v in constants.items()}
    kind = F.coalesce(F.nullif(meta.pop("type", F.lit(None).cast("string")), F.lit("")), F.lit(default_type)) if default_type else meta.pop("type", None)
    pairs = [x for k, v in (meta | ({"type": kind} if kind is not None else {})).items() for x in (F.lit(k), v)]
    return records.select(
        *keep,
        F.coalesce(F.nullif(own("id"), F.lit("")), F.concat(F.lit("doc-"), F.col("_pos").cast("string"))).alias("id"),
        F.coalesce(F.nullif(own("content"), F.lit("")), item).alias("content"),
        (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("metadata"),
    )


def json_documents(df: DataFrame, payload: str, mapping: dict[str, str] | None = None, document_path: str | None = None, constants: dict[str, str] | None = None, keep: list[str] = (), default_type: str | None = "content") -> DataFrame:
    """Documents of JSON payloads; a payload, or what lies at ``document_path``, that is no array is one record."""
    rows = df.select(*keep, F.posexplode(_items(F.col(payload), document_path)).alias("_pos", "_item"))
    return _documents(rows, mapping or {}, constants or {}, list(keep), default_type)


def csv_cells(line: Column) -> Column:
    """Cells of one line: commas between quotes do not separate, quotes are dropped, cells trimmed."""
    return F.transform(F.split(line, r',(?=(?:[^"]*"[^"]*")*[^"]*$)'), lambda c: texts.trim(F.replace(c, F.lit('"'), F.lit(""))))


def csv_records(df: DataFrame, payload: str, keep: list[str] = (), quoted: bool = True) -> DataFrame:
    """``_pos, _item``: the lines below the header as JSON objects of text, missing cells empty;
    without ``quoted`` every comma separates. Payloads of fewer than two lines have none."""
    cells = csv_cells if quoted else lambda line: F.transform(F.split(line, ","), lambda c: texts.trim(c))
    lines = F.split(F.regexp_replace(F.col(payload), r"^\s+|\s+$", ""), "\n")
    rows = df.select(*keep, cells(lines[0]).alias("_head"), F.posexplode(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))).alias("_pos", "_line")).withColumn("_cells", cells(F.col("_line")))
    values = F.transform("_head", lambda h, i: F.coalesce(F.get("_cells", i), F.lit("")))
    return rows.select(*keep, "_pos", F.to_json(F.map_from_arrays("_head", values)).alias("_item"))


def csv_documents(df: DataFrame, payload: str, mapping: dict[str, str] | None = None, keep: list[str] = (), quoted: bool = True) -> DataFrame:
    return _documents(csv_records(df, payload, keep, quoted), mapping or {}, {}, list(keep), "content")


def xml_documents(df: DataFrame, payload: str, mapping: dict[str, str] | None = None, tag: str = "item", keep: list[str] = ()) -> DataFrame:
    """Documents of the elements ``tag``; their leaves are the fields, of equal names the last one."""
    inner = F.regexp_extract_all(F.col(payload), F.lit(rf"(?is)<{tag}[^>]*>(.*?)</{tag}>"), 1)
    rows = df.select(*keep, F.posexplode(inner).alias("_pos", "_xml"))
    leaf = r"<(\w+)[^>]*>([^<]*)</\1>"
    names, values = F.regexp_extract_all("_xml", F.lit(leaf), 1), F.regexp_extract_all("_xml", F.lit(leaf), 2)
    entries = F.transform(F.arrays_zip(names.alias("k"), values.alias("v")), lambda e: F.struct(e["k"].alias("k"), texts.trim(e["v"]).alias("v")))
    rows = rows.withColumn("_entries", entries).withColumn("_entries", F.filter("_entries", lambda e, i: ~F.exists(F.slice(F.col("_entries"), i + 2, F.size("_entries")), lambda later: later["k"] == e["k"])))
    return _documents(rows.select(*keep, "_pos", F.to_json(F.map_from_entries("_entries")).alias("_item")), mapping or {}, {}, list(keep), "content")


def with_origin(documents: DataFrame, url: Column | str, fetched_at: Column, extra: dict[str, str] | None = None) -> DataFrame:
    """Adds where and when documents were fetched, and the caller's own entries, to their metadata."""
    more = F.create_map(F.lit("sourceUrl"), F.col(url) if isinstance(url, str) else url, F.lit("fetchedAt"), F.date_format(fetched_at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), *(F.lit(x) for kv in (extra or {}).items() for x in kv))
    return documents.withColumn("metadata", F.map_concat("metadata", more))


def auth_headers(kind: Column, token: Column, user: Column, password: Column, name: Column, value: Column) -> Column:
    """Header line for bearer, basic, api-key and custom access; null where what it needs is missing."""
    return (
        F.when((kind == "bearer") & (token != ""), F.concat(F.lit("Authorization: Bearer "), token))
        .when((kind == "basic") & (user != "") & (password != ""), F.concat(F.lit("Authorization: Basic "), F.base64(F.encode(F.concat(user, F.lit(":"), password), "UTF-8"))))
        .when((kind == "api-key") & (token != ""), F.concat(F.coalesce(F.nullif(name, F.lit("")), F.lit("X-API-Key")), F.lit(": "), token))
        .when((kind == "custom") & (name != "") & (value != ""), F.concat(name, F.lit(": "), value))
    )


def portable_text(blocks: Column) -> Column:
    """Text of an array of structs ``_type, children(text)``: the blocks apart by a blank line, null as nothing."""
    kept = F.filter(blocks, lambda b: b["_type"] == "block")
    return F.coalesce(F.array_join(F.transform(kept, lambda b: F.coalesce(F.array_join(F.transform(b["children"], lambda c: F.coalesce(c["text"], F.lit(""))), ""), F.lit(""))), "\n\n"), F.lit(""))
