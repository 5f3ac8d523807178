"""Sources: catalogues in CSV, JSON synonyms, pages of an API, archives of documents."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ArrayType, MapType, StringType, StructField, StructType

from quillmill.functions import text as X
from quillmill.operators.match import holding
from quillmill.operators.rows import first_wins


def read_catalogue_csv(spark: SparkSession, path: str, columns: list[str], required: list[str], keys: list[str], encoding: str = "UTF-8") -> DataFrame:
    """Header CSV as text columns, a byte-order mark ignored; rows with a blank required field go; first of equal keys wins.

    Input order is the files' by path and in each the lines', kept in ``ord``,
    however Spark splits and deals them.
    """
    raw = spark.read.option("header", True).option("encoding", encoding).schema(StructType([StructField(c, StringType()) for c in columns])).option("enforceSchema", True).csv(path)
    # numbers grow within a split of a file
    place = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("number"))
    rows = raw.select(*[X.blank_to_null(F.regexp_replace(F.col(c), "^﻿", "")).alias(c) for c in columns], place.alias("ord"))
    return first_wins(rows.na.drop(subset=required), [F.col(k) for k in keys], [F.col("ord")])


#: Encodings that a catalogue may have, in the order they are tried.
ENCODINGS = ("utf-8-sig", "utf-8", "cp949", "euc-kr")


def read_csv_any_encoding(spark: SparkSession, path: str, columns: list[str], encodings: tuple[str, ...] = ENCODINGS) -> DataFrame:
    """Header CSV files, each in the first encoding that decodes it, as text columns by name.

    A file is decoded as a whole by one task: catalogues are small. Columns
    that a file lacks are null; blanks are null.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                for e in encodings:
                    try:
                        text = content.decode(e)
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    raise ValueError(f"none of the encodings {encodings} fits {name}")
                rows = list(csv.DictReader(io.StringIO(text)))
                yield pd.DataFrame([[(r.get(c) or "").strip() or None for c in columns] for r in rows], columns=columns, dtype=object)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, ", ".join(f"`{c}` string" for c in columns))


def positional(df: DataFrame, names: dict[int, str], least: int = 19) -> DataFrame:
    """S3: columns by position; a table of fewer than ``least`` columns is refused."""
    if len(df.columns) < least:
        raise ValueError(f"{len(df.columns)} columns, at least {least} are needed")
    return df.select(*[X.blank_to_null(F.col(f"`{df.columns[i]}`")).alias(n) for i, n in names.items()])


def build_index(df: DataFrame, path: str, code: str, fingerprint: str) -> bool:
    """Write the catalogue by 6-digit code prefix unless ``path`` holds this fingerprint; whether it was written."""
    spark = df.sparkSession
    mark = f"{path}/fingerprint={fingerprint}"
    files = spark._jvm.org.apache.hadoop.fs.Path(mark)
    if files.getFileSystem(spark._jsc.hadoopConfiguration()).exists(files):
        return False
    df.withColumn("code6", F.substring(code, 1, 6)).repartition("code6").sortWithinPartitions(code).write.partitionBy("code6").mode("overwrite").parquet(mark)
    return True


def read_synonyms(spark: SparkSession, path: str) -> DataFrame:
    """A JSON file of two maps (by code, by name) to (kind, key, alias) rows."""
    maps = MapType(StringType(), ArrayType(StringType()))
    raw = spark.read.schema(StructType([StructField("by_code_no", maps), StructField("by_name", maps)])).json(path, multiLine=True)
    parts = [raw.select(F.lit(kind).alias("kind"), F.explode(kind).alias("key", "aliases")) for kind in ("by_code_no", "by_name")]
    return parts[0].unionByName(parts[1]).select("kind", "key", F.explode("aliases").alias("alias")).filter(X.blank_to_null(F.col("alias")).isNotNull())


def decode_page(body: Column, item: StructType, content_type: Column) -> Column:
    """Rows of one page body, JSON or XML; a single object counts as a list of one."""
    many = StructType([StructField("totalCount", StringType()), StructField("items", StructType([StructField("item", ArrayType(item))]))])
    one = StructType([StructField("totalCount", StringType()), StructField("items", StructType([StructField("item", item)]))])
    as_list = F.from_json(body, many)["items"]["item"]
    single = F.from_json(body, one)["items"]["item"]
    from_json = F.coalesce(F.when(F.size(as_list) > 0, as_list), F.when(single.isNotNull(), F.array(single)))
    fields = [F.xpath(body, F.lit(f"//items/item/{f.name}/text()")) for f in item.fields]
    zipped = F.transform(F.arrays_zip(*[c.alias(f.name) for c, f in zip(fields, item.fields)]), lambda x: F.struct(*[x[f.name].alias(f.name) for f in item.fields]))
    return F.when(content_type.contains("xml"), zipped).otherwise(F.coalesce(from_json, F.array().cast(ArrayType(item))))


class PagePartition(InputPartition):
    def __init__(self, page: int):
        self.page = page


class PagedReader(DataSourceReader):
    """Reads numbered pages; a partition is a range that starts at its page and stops at the first empty one."""

    def __init__(self, schema: StructType, options: dict[str, str]):
        self.folder, self.pages = options["path"], int(options.get("pages", "1"))

    def partitions(self) -> list[PagePartition]:
        return [PagePartition(p) for p in range(1, self.pages + 1)]

    def read(self, partition: PagePartition) -> Iterator[tuple]:
        import os

        path = os.path.join(self.folder, f"page-{partition.page}.txt")
        if os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                kind, _, body = f.read().partition("\n")
            yield partition.page, kind, body


class PagedSource(DataSource):
    """Captured pages of an API as (page, content_type, body); register with ``spark.dataSource.register``."""

    @classmethod
    def name(cls) -> str:
        return "captured_pages"

    def schema(self) -> str:
        return "page int, content_type string, body string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagedReader(schema, self.options)


def until_empty(pages: DataFrame, page: str, rows: str, total: str | None = None) -> DataFrame:
    """Pages up to the first without rows, or until ``total`` rows are reached."""
    first = pages.filter(F.coalesce(F.size(rows), F.lit(0)) <= 0).agg(F.min(page).alias("__end"))
    kept = pages.crossJoin(F.broadcast(first)).filter(F.col("__end").isNull() | (F.col(page) < F.col("__end"))).drop("__end")
    if total is None:
        return kept
    sizes = kept.select(page, F.size(rows).alias("__n"), F.col(total).cast("long").alias("__total"))
    before = sizes.alias("a").join(sizes.alias("b"), F.col("b." + page) < F.col("a." + page), "left").groupBy(F.col("a." + page).alias(page)).agg(F.coalesce(F.sum("b.__n"), F.lit(0)).alias("__before"), F.max("a.__total").alias("__total"))
    return kept.join(before.filter(F.col("__total").isNull() | (F.col("__before") < F.col("__total"))), page, "left_semi")


def read_archives(spark: SparkSession, path: str, members: int = 12, most_bytes: int = 20_000_000) -> DataFrame:
    """Text members of ZIP and text files: (file, member, content, warning).

    Beyond ``members`` members or ``most_bytes`` a member is listed with a
    warning instead of its content, as are encrypted and unreadable ones.
    """

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content in zip(batch["path"], batch["content"]):
                if not zipfile.is_zipfile(io.BytesIO(content)):
                    rows.append((name, "", _decoded(content), None))
                    continue
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for i, m in enumerate(x for x in z.infolist() if not x.is_dir()):
                        warning = "too_many_members" if i >= members else "too_large" if m.file_size > most_bytes else "encrypted" if m.flag_bits & 1 else None
                        text = None if warning else _decoded(z.read(m))
                        rows.append((name, m.filename, text, warning or (None if text is not None else "not_text")))
            yield pd.DataFrame(rows, columns=["file", "member", "content", "warning"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(unpack, "file string, member string, content string, warning string")


def _decoded(content: bytes) -> str | None:
    for e in ("utf-8-sig", "cp949"):
        try:
            return content.decode(e)
        except UnicodeDecodeError:
            continue
    return None


def decode_rpc(body: Column) -> Column:
    """(result, error) of a captured JSON-RPC body, plain or as server-sent events.

    The last of the body and its ``data:`` lines (``[DONE]`` apart) that is a
    JSON object counts. ``result`` is its result as JSON, one that is no object
    under ``value``; an error gives its message; a body without an object is
    unreadable.
    """
    body = X.text_or_empty(body)
    data = F.filter(F.split(body, r"\r?\n"), lambda x: x.startswith("data:"))
    events = F.filter(F.transform(data, lambda x: F.trim(F.substr(x, F.lit(6)))), lambda x: x != "[DONE]")
    whole = F.transform(F.concat(F.array(F.trim(body)), events), lambda x: F.get_json_object(x, "$"))
    said = F.element_at(F.filter(whole, lambda x: x.startswith("{")), -1)
    last = F.when(F.exists(whole, lambda x: F.coalesce(x.startswith("{"), F.lit(False))), said)
    error = F.get_json_object(last, "$.error")
    failed = ~F.coalesce(error, F.lit("")).isin("", "false", "0", "{}", "[]")
    message = F.when(last.isNull(), "unreadable response").when(failed, F.coalesce(F.get_json_object(last, "$.error.message"), error))
    result = F.get_json_object(last, "$.result")
    # a bare string comes without its quotes
    quoted = F.when(result.rlike(r"^[\[{]|^-?[0-9.eE+-]+$|^(true|false)$"), result).otherwise(F.to_json(F.array(result)).substr(F.lit(2), F.length(F.to_json(F.array(result))) - 2))
    shaped = F.when(result.startswith("{"), result).otherwise(F.concat(F.lit('{"value":'), F.coalesce(quoted, F.lit("null")), F.lit("}")))
    return F.struct(F.when(message.isNull(), shaped).alias("result"), message.alias("error"))


def newest_files(spark: SparkSession, path: str, pattern: str, limit: int) -> DataFrame:
    """Files whose name fits the pattern, by the number in it, then by name, descending."""
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "path", "length")
    number = F.regexp_extract("name", r"([0-9]+)", 1).try_cast("long")
    return files.filter(F.col("name").rlike(pattern)).orderBy(F.desc_nulls_last(number), F.desc("name")).limit(limit)


def navigate(classes: DataFrame, keys: list[str], local: DataFrame, remote: DataFrame, unit: str, order: str) -> DataFrame:
    """Units of the classes from the local catalogue, from the remote one for classes that have none there; first of equal codes."""
    near = classes.join(local, keys).withColumn("origin", F.lit("local"))
    far = classes.join(near.select(*keys).distinct(), keys, "left_anti").join(remote, keys).withColumn("origin", F.lit("remote"))
    return first_wins(near.unionByName(far), [F.col(unit)], [F.col(order)])


def search(terms: DataFrame, term: str, term_order: str, catalogue: DataFrame, code: str, texts: list[str], order: str, most_terms: int = 10, most: int = 50) -> DataFrame:
    """Rows found by exact code (0.9) or holding a term of two characters or more (0.7), first of equal codes in (term, catalogue) order."""
    asked = terms.orderBy(term_order).limit(most_terms).select(F.lower(F.trim(term)).alias("__w"), F.col(term_order).alias("__t"))
    stock = catalogue.withColumn("__code", F.lower(F.col(code).cast("string"))).withColumn("__text", F.lower(F.concat_ws(" ", *texts)))
    exact = asked.join(stock, F.col("__w") == F.col("__code")).withColumn("score", F.lit(0.9))
    held = holding(stock, "__text", asked, "__w").withColumn("score", F.lit(0.7))
    hits = exact.unionByName(held).drop("__code", "__text")
    return first_wins(hits, [F.col(code)], [F.col("__t"), F.desc("score"), F.col(order)]).orderBy("__t", order).limit(most).drop("__w", "__t")
