"""Readers and the catalogue import: CSV rows, validation, all-or-nothing upsert; gold labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..config import CATEGORIES
from ..functions.core import blank_to_null, first_reason
from ..functions.text import import_price, pack_grams

IMPORT_COLUMNS = ["name", "brand", "sku", "category", "pack_size", "regular_price", "promo_price", "promo_type", "buy_quantity", "free_quantity"]


def read_catalogue_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, every column as text, with ``source_file``, ``line`` (the record's number in its file, header and all but blank lines counted) and ``file_line``.

    Files are read by blocks. A line's place in its file is its place in its block after the lines of earlier blocks; it begins a
    record if an even number of quotes stands before it. An unclosed quote makes the rest of its file one record.
    """
    names = [c.lstrip("\ufeff") for c in spark.read.csv(path, header=True, multiLine=True, escape='"').columns]
    block = ["source_file", "_block"]
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("_block"))
    lines = lines.withColumns({"_id": F.monotonically_increasing_id(), "_one": F.lit(1), "_quotes": F.length("value") - F.length(F.translate("value", '"', ""))})
    counted = _running(_running(lines, block, "_one", "file_line"), block, "_quotes", "_so_far")
    begins = (F.col("_so_far") - F.col("_quotes")) % 2 == 0
    counted = counted.withColumn("_begins", (begins & (F.col("value") != "")).cast("int")).filter(~begins | (F.col("value") != ""))
    numbered = _running(counted, block, "_begins", "line")
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("file_line", "value"))), lambda x: x["value"]), "\n")
    records = numbered.groupBy("source_file", "line").agg(F.min("file_line").alias("file_line"), whole.alias("_text")).filter("line > 1")
    fields = F.from_csv("_text", ", ".join(f"c{i} string" for i in range(len(names))), {"escape": '"'})
    return records.select("source_file", "line", "file_line", fields.alias("_r")).select(*[F.col(f"_r.c{i}").alias(n) for i, n in enumerate(names)], "source_file", "line", "file_line")


def _running(lines: DataFrame, block: list[str], value: str, name: str) -> DataFrame:
    """``lines`` with the sum of ``value`` from their file's start: over their block in one window, over earlier blocks by one row a block."""
    own = F.sum(value).over(W.partitionBy(*block).orderBy("_id"))
    sums = lines.groupBy(*block).agg(F.sum(value).alias("_sum"))
    earlier = sums.select(*block, F.coalesce(F.sum("_sum").over(W.partitionBy(block[0]).orderBy(block[1]).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_earlier"))
    return lines.withColumn(name, own).join(earlier, block).withColumn(name, F.col(name) + F.col("_earlier")).drop("_earlier")


def parse_catalogue(rows: DataFrame) -> DataFrame:
    """Typed catalogue rows with ``error`` (null = valid). Header case and blanks do not matter; blank rows are dropped."""
    given = {c.strip().lower(): c for c in rows.columns}
    missing = [c for c in ("name", "regular_price") if c not in given]
    if missing:
        raise ValueError(f"CSV must have at least the columns: name, regular_price (missing {', '.join(missing)}).")
    text = lambda c, *more: F.coalesce(*[blank_to_null(F.col(f"`{given[k]}`")) for k in (c, *more) if k in given], F.lit(None).cast("string"))
    places = [F.col(c) for c in ("source_file", "file_line") if c in rows.columns]
    df = rows.select(*places, F.col(given.get("line", "line")).cast("bigint").alias("line"), *[text(c).alias(c) for c in ("name", "brand", "sku", "pack_size")],
                     F.upper(F.coalesce(text("category"), F.lit("BISCUIT"))).alias("category"), text("regular_price").alias("_regular"), text("promo_price").alias("_promo"),
                     F.upper(F.coalesce(text("promo_type"), F.lit("REGULAR"))).alias("promo_type"),
                     text("buy_quantity", "buy_x").alias("_buy"), text("free_quantity", "get_y").alias("_free"))
    filled = F.coalesce("name", "brand", "sku", "pack_size", "_regular", "_promo").isNotNull()
    df = df.filter(filled).withColumns({"regular_price": import_price("_regular"), "promo_price": import_price("_promo"), "pack_grams": pack_grams("pack_size"),
                                        "buy_quantity": F.col("_buy").try_cast("int"), "free_quantity": F.col("_free").try_cast("int")})
    error = first_reason(
        (F.col("_regular").isNull(), "price is empty"), (F.col("regular_price").isNull(), "price must be greater than 0 and below 10,000,000"),
        (F.col("_promo").isNotNull() & F.col("promo_price").isNull(), "promo price must be greater than 0 and below 10,000,000"),
        (F.col("name").isNull(), "name is missing"), (~F.col("category").isin(*CATEGORIES), "category is not in the list"),
        ((F.col("_buy").isNotNull() & F.col("buy_quantity").isNull()) | (F.col("_free").isNotNull() & F.col("free_quantity").isNull()), "quantities must be whole numbers"))
    return df.withColumn("error", error).drop("_regular", "_promo", "_buy", "_free")


def import_errors(parsed: DataFrame) -> DataFrame:
    places = [c for c in ("source_file", "line", "file_line") if c in parsed.columns]
    return parsed.filter(F.col("error").isNotNull()).select(*places, "error").orderBy(*places)


def upsert(parsed: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Catalogue after the import, with ``operation`` created / updated / kept.

    All or nothing: one invalid row leaves every product as it was. The last row
    of a repeated SKU wins.
    """
    blocked = parsed.agg(F.count(F.when(F.col("error").isNotNull(), 1))).scalar()
    keyed = parsed.filter(F.col("sku").isNotNull() & (blocked == 0)).groupBy("sku").agg(F.max_by(F.struct(*[c for c in parsed.columns if c != "sku"]), F.struct(*[c for c in ("source_file", "line") if c in parsed.columns])).alias("n"))
    plain = parsed.filter(F.col("sku").isNull() & (blocked == 0)).select(F.lit(None).cast("string").alias("sku"), F.struct(*[c for c in parsed.columns if c != "sku"]).alias("n"))
    fields = [c for c in IMPORT_COLUMNS + ["pack_grams"] if c != "sku" and c in catalogue.columns and c in parsed.columns]
    old = catalogue.select("own_id", "sku", F.struct(*fields).alias("o"))
    joined = old.join(keyed, "sku", "full_outer").unionByName(plain.withColumns({"own_id": F.lit(None).cast(catalogue.schema["own_id"].dataType), "o": F.lit(None).cast(old.schema["o"].dataType)}))
    operation = F.when(F.col("n").isNull(), "kept").when(F.col("own_id").isNull(), "created").otherwise("updated")
    value = lambda f: F.when(F.col("n").isNotNull(), F.col(f"n.{f}")).otherwise(F.col(f"o.{f}")).alias(f)
    return joined.select("own_id", "sku", *[value(f) for f in fields], operation.alias("operation"))


def read_gold_labels(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(texts, labels) of paired .txt / .json example files, joined later on ``doc`` (the file stem)."""
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+)\.[a-z]+$", 1)
    texts = spark.read.text(f"{folder}/*.txt", wholetext=True).select(stem.alias("doc"), F.col("value").alias("text"))
    fields = "product_name string, regular_price double, promo_price double, discount_percentage double, promotion_type string"
    raw = spark.read.schema(fields).json(f"{folder}/*.json", multiLine=True).withColumn("doc", stem)
    return texts, raw
