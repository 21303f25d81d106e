"""License scans by diagonal voting, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words of a gram.
K = 3
#: Diagonals at most this far apart are one span: a few words were put in or left out.
DRIFT = 3
#: Share of a template's grams that a span must have, and how much longer than the template it may be.
COVERAGE = 0.7
STRETCH = 1.5
#: Grams of all templates together, at most: the table is broadcast.
MOST_GRAMS = 200_000

#: Phrases whose exact places are counted, and their labels. Fixed values.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Notices as licence texts themselves word them, and their labels. Fixed values.
NOTICES = (
    ("the mit license", "mit"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "apache-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this work is licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "gpl-3"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "lgpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)


def words(text: Column) -> Column:
    """Words of ASCII letters and digits and all characters beyond ASCII, with A-Z lower-cased.

    lower() also turns the Kelvin sign and the dotted capital I into ASCII letters; they are replaced before, by
    another word character. What it does to other characters cannot matter to ASCII templates.
    """
    plain = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("µ")), F.lit("İ"), F.lit("µ"))
    return F.array_remove(F.split(F.lower(plain), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def gram(of: Column, at: Column) -> Column:
    return F.xxhash64(*(F.get(of, at + k) for k in range(K)))


def template_grams(spark: SparkSession, phrases: tuple = PHRASES, notices: tuple = NOTICES) -> DataFrame:
    """One row per gram of each template; its size is checked before it is broadcast."""
    every = [(t, label, True) for t, label in phrases] + [(t, label, False) for t, label in notices]
    if min(len(t.split()) for t, _, _ in every) < K or sum(len(t.split()) for t, _, _ in every) > MOST_GRAMS:
        raise ValueError(f"templates have {K} words at least and {MOST_GRAMS} together at most")
    rows = F.array(*(F.struct(F.lit(k).alias("template"), F.split(F.lit(t), " ").alias("w"), F.lit(label).alias("label"), F.lit(base).alias("base")) for k, (t, label, base) in enumerate(every)))
    t = spark.range(1).select(F.inline(rows)).withColumn("grams", F.size("w") - K + 1)
    t = t.select("template", "label", "base", "grams", "w", F.explode(F.sequence(F.lit(0), F.col("grams") - 1)).alias("j"))
    return t.select(gram(F.col("w"), F.col("j")).alias("h"), "template", "label", "base", "grams", "j")


def license_scan(docs: DataFrame, phrases: tuple = PHRASES, notices: tuple = NOTICES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row of docs.

    All rolling grams of K words meet the templates' gram table by hash; votes gather on (document, template,
    diagonal = place in the document less place in the template). A phrase stands wherever its own diagonal has all its
    grams. For notices, neighbouring diagonals merge, and the merged span is verified: the share of the template's
    different grams it holds, and its length; one that stands verbatim on a diagonal is accepted however often it is repeated. score is the largest such share among accepted spans, 0 without.

    A null or empty text has no words; repeated rows are answered alike, a null doc_id too; an empty table gives no
    rows; other columns are ignored. Only hits are shuffled, and each hit's group lies within one document.
    """
    key = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    d = docs.select("doc_id", key.alias("_text"), words(F.col("text").cast("string")).alias("_w"))
    d = d.withColumn("_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    places = d.where(F.size("_w") >= K).select("_id", "_text", "_w", F.explode(F.sequence(F.lit(0), F.size("_w") - K)).alias("i"))
    hits = places.select("_id", "_text", "i", gram(F.col("_w"), F.col("i")).alias("h")).join(F.broadcast(template_grams(docs.sparkSession, phrases, notices)), "h")
    keys = ["_id", "_text", "template", "label", "base", "grams"]
    diagonals = hits.groupBy(*keys, (F.col("i") - F.col("j")).alias("diagonal")).agg(F.collect_set("j").alias("js"), F.min("i").alias("lo"), F.max("i").alias("hi"))
    base = diagonals.where(F.col("base") & (F.size("js") == F.col("grams")))
    base = base.groupBy("_id", "_text").agg(
        F.count("*").alias("n_base"), F.min("diagonal").cast("bigint").alias("first_word"), F.max("diagonal").cast("bigint").alias("last_word"), F.collect_set("label").alias("base_set")
    )
    along = Window.partitionBy(*keys).orderBy("diagonal")
    merged = diagonals.where(~F.col("base"))
    merged = merged.withColumn("new", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(along) > DRIFT).cast("int"), F.lit(1)))
    merged = merged.withColumn("span", F.sum("new").over(along)).groupBy(*keys, "span").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("js")))).alias("held"), (F.max("hi") - F.min("lo") + K).alias("length"), F.max(F.size("js") == F.col("grams")).alias("verbatim")
    )
    share = F.col("held") / F.col("grams")
    spans = merged.where(F.col("verbatim") | (share >= COVERAGE) & (F.col("length") <= STRETCH * (F.col("grams") + K - 1)))
    spans = spans.groupBy("_id", "_text").agg(F.collect_set("label").alias("span_set"), F.max(share).alias("best"))
    none = F.array().cast("array<string>")
    found = base.join(spans, ["_id", "_text"], "full")
    out = d.select("doc_id", "_id", "_text", F.size("_w").cast("bigint").alias("n_words")).join(found, ["_id", "_text"], "left")
    joined = lambda *sets: F.array_join(F.array_sort(F.array_distinct(F.concat(*(F.coalesce(s, none) for s in sets)))), ",")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("bigint").alias("n_base"), "first_word", "last_word", joined(F.col("base_set")).alias("base_labels"),
        joined(F.col("base_set"), F.col("span_set")).alias("labels"), F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
