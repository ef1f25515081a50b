"""License scans by diagonal voting.

Every rolling pair of words of every text is hashed and joined to the places where
that pair stands in the templates. A hit votes for a diagonal: its place in the text
less its place in the template. Votes are counted per diagonal; a phrase that stands
in the text in whole has all its votes on one diagonal.

Base templates are short phrases. They count where all pairs vote on one diagonal.
License templates are sentences of well-known notices. Diagonals that lie close to
each other are merged, which lets a few words be put in or left out, and the merged
span is verified: the share of the template's different pairs it holds must reach
``VERIFIED``.

Everything is DataFrame functions. The templates are a fixed list and are broadcast.

Defined results: a null or empty text, and one without words, has no words and no
places. Rows equal in id and text count once in the votes and get equal results each:
what is counted are different places, so copies do not add up. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The phrases that the base labels stand for.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Sentences by which well-known licenses are recognised.
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the mit license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("proprietary", "all rights reserved no part of this publication may be reproduced"),
)
GRAM = 2
NEAR = 3
VERIFIED = 0.8
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The only character outside A-Z whose lower case is one of a-z; put aside by one that is its own lower case.
KELVIN, ASIDE = "\u212a", "\u00df"


def words(text):
    """The words of a text column with A-Z lower-cased. Other letters may change case too, which no template holds."""
    plain = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit(KELVIN), F.lit(ASIDE)))
    return F.regexp_extract_all(plain, F.lit(WORD), F.lit(0))


def grams(own):
    """Hash of each pair of neighbouring words, by place."""
    pairs = F.greatest(F.size(own) - 1, F.lit(0))
    return F.zip_with(F.slice(own, F.lit(1), pairs), F.slice(own, F.lit(2), pairs), lambda a, b: F.xxhash64(a, b))


def templates(spark: SparkSession) -> DataFrame:
    """(gram, template, offset): the places of each pair in the templates, and what the template is."""
    rows = [(i, label, phrase, True) for i, (phrase, label) in enumerate(BASE)] + [(100 + i, label, phrase, False) for i, (label, phrase) in enumerate(NOTICES)]
    listed = F.array(*(F.struct(*(F.lit(v).alias(name) for v, name in zip(row, ("template", "label", "phrase", "base")))) for row in rows))
    frame = spark.range(1).select(F.inline(listed))
    return (frame.withColumn("own", words(F.col("phrase"))).withColumn("n_grams", F.size("own") - GRAM + 1)
            .select("template", "label", "base", "n_grams", F.posexplode(grams(F.col("own"))).alias("offset", "gram")))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", near: int = NEAR, verified: float = VERIFIED) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and ``spans`` (template, start, stop, share) as verified."""
    read = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    keyed = read.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("text_key"), words(F.col("text")).alias("own"))
    hits = (keyed.select("doc_id", "text_key", F.posexplode(grams(F.col("own"))).alias("place", "gram"))
            .join(F.broadcast(templates(docs.sparkSession)), "gram")
            .select("doc_id", "text_key", "template", "label", "base", "n_grams", "offset", (F.col("place") - F.col("offset")).alias("diagonal")))
    # One bit per template place: a vote counts once, and votes of copies fall together before the shuffle.
    votes = hits.groupBy("doc_id", "text_key", "template", "label", "base", "n_grams", "diagonal").agg(F.bit_or(F.expr("shiftleft(1L, offset)")).alias("bits"))
    base = (votes.filter(F.col("base") & (F.bit_count("bits") == F.col("n_grams"))).groupBy("doc_id", "text_key")
            .agg(F.count("*").alias("n_base"), F.min("diagonal").alias("first_word"), F.max("diagonal").alias("last_word"), F.collect_set("label").alias("base_set")))
    along = Window.partitionBy("doc_id", "text_key", "template").orderBy("diagonal")
    merged = (votes.filter(~F.col("base")).withColumn("opens", F.when(F.col("diagonal") - F.lag("diagonal").over(along) <= near, 0).otherwise(1))
              .withColumn("span", F.sum("opens").over(along))
              .groupBy("doc_id", "text_key", "template", "label", "n_grams", "span")
              .agg(F.bit_or("bits").alias("bits"), F.min("diagonal").alias("start"), F.max("diagonal").alias("last")))
    share = F.bit_count("bits") / F.col("n_grams")
    notices = (merged.withColumn("share", share).filter(F.col("share") >= verified).groupBy("doc_id", "text_key")
               .agg(F.collect_set("label").alias("notice_set"), F.max("share").alias("best"),
                    F.sort_array(F.collect_list(F.struct("start", "template", (F.col("last") + F.col("n_grams") + GRAM - 1).alias("stop"), "share"))).alias("spans")))
    found = _both(base, notices)
    narrow = keyed.select("doc_id", "text_key", F.size("own").cast("bigint").alias("n_words"))
    same = narrow["doc_id"].eqNullSafe(found["id_"]) & (narrow["text_key"] == found["key_"])
    none = F.array().cast("array<string>")
    base_set, notice_set = F.coalesce("base_set", none), F.coalesce("notice_set", none)
    return narrow.join(found, same, "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("bigint").alias("n_base"), F.col("first_word").cast("bigint").alias("first_word"),
        F.col("last_word").cast("bigint").alias("last_word"), F.array_join(F.array_sort(base_set), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_set, notice_set)), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"), "spans")


def _both(base: DataFrame, notices: DataFrame) -> DataFrame:
    """Base places and verified notices of a row side by side; ids may be null, so the key names them with their text."""
    rows = (base.select("doc_id", "text_key", "n_base", "first_word", "last_word", "base_set")
            .unionByName(notices.select("doc_id", "text_key", "notice_set", "best", "spans"), allowMissingColumns=True))
    return rows.groupBy(F.col("doc_id").alias("id_"), F.col("text_key").alias("key_")).agg(
        *(F.first(c, ignorenulls=True).alias(c) for c in ("n_base", "first_word", "last_word", "base_set", "notice_set", "best", "spans")))
