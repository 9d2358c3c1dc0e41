"""License scans by diagonal voting: rolling hashes of k words are joined with the places they have in license templates; a
hit at word i of a document and word j of a template votes for the diagonal i - j. Votes are summed by diagonal,
neighbouring diagonals (a few words put in or left out) are merged, and what they cover of the template is verified.
Phrases that name a license are counted beside that, at every place where their words stand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import lower_ascii, words
from .decontaminate import _candidates

#: Words in a rolling hash.
K = 4
#: Diagonals at most this far apart are of one span.
GAP = 3
#: More rolling hashes than this are not broadcast: they are joined by a shuffle, with the same result.
MAX_BROADCAST_GRAMS = 100_000
#: A span is verified if it covers this share of its template's words, or this many of them.
LEAST_SHARE, LEAST_WORDS = 0.6, 40

# Phrases with their labels, and public license texts (notices, and the parts that are quoted most).
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
]


def template_grams(spark: SparkSession, templates: list[tuple[str, str]], k: int = K) -> DataFrame:
    """(template, label, n_template, at, window): the k words at each place of each template."""
    t = spark.createDataFrame([(i, label, text) for i, (label, text) in enumerate(templates)], "template int, label string, text string")
    t = t.select("template", "label", words(F.col("text")).alias("w")).filter(F.size("w") >= k)
    at = F.explode(F.sequence(F.lit(0), F.size("w") - k))
    return t.select("template", "label", F.size("w").alias("n_template"), at.alias("at"), "w").select(
        "template", "label", "n_template", "at", F.array_join(F.slice("w", F.col("at") + 1, k), " ").alias("window")
    )


def spans(documents: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, k: int = K) -> DataFrame:
    """(doc_id, text_key, label, template, first, past, share): verified spans of templates in documents, words from first to
    before past. text_key is a hash of the text; rows that share it and doc_id have the same spans, and get them once."""
    grams = template_grams(documents.sparkSession, templates, k)
    hashed = grams.select(F.split("window", " ").alias("w")).select(F.xxhash64("w").alias("whole"), F.xxhash64(*[F.get("w", F.lit(j)) for j in range(min(k, 3))]).alias("head"))
    few = grams.count() <= MAX_BROADCAST_GRAMS
    sets = {"whole": None, "head": None}
    if few:
        sets = hashed.agg(F.collect_set("whole").alias("whole"), F.collect_set("head").alias("head")).first()
        if not sets["whole"]:
            sets = {"whole": [0], "head": [0]}
    spread = documents.select("doc_id", F.xxhash64("text").alias("text_key"), words(F.col("text")).alias("w"))
    hits = spread.select("doc_id", "text_key", F.explode(_candidates("w", k, sets["head"], sets["whole"])).alias("c")).select("doc_id", "text_key", "c.pos", "c.window")
    key = ["doc_id", "text_key", "template", "label", "n_template"]
    votes = hits.join(F.broadcast(grams) if few else grams, "window").groupBy(*key, (F.col("pos") - F.col("at")).alias("diagonal")).agg(
        F.collect_set("at").alias("places"), F.min("pos").alias("first"), (F.max("pos") + k).alias("past")
    )
    order = Window.partitionBy("doc_id", "text_key", "template").orderBy("diagonal")
    near = F.col("diagonal") - F.lag("diagonal").over(order) <= GAP
    merged = votes.withColumn("span", F.sum(F.when(near, 0).otherwise(1)).over(order)).groupBy(*key, "span").agg(
        F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), F.min("first").alias("first"), F.max("past").alias("past")
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + (k - 1))))))
    share = covered / F.col("n_template")
    return merged.filter((share >= LEAST_SHARE) | (covered >= LEAST_WORDS)).select("doc_id", "text_key", "label", "template", "first", "past", F.least(share, F.lit(1.0)).alias("share"))


def _phrase_places(w: str, phrase: str) -> Column:
    parts = phrase.split()
    stands = " AND ".join(f"get({w}, i + {j}) = '{p}'" if j else f"{w}[i] = '{p}'" for j, p in enumerate(parts))
    return F.expr(f"filter(CASE WHEN size({w}) >= {len(parts)} THEN sequence(0, size({w}) - {len(parts)}) ELSE cast(array() AS array<int>) END, i -> {stands})")


def scan(documents: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """Of each row: doc_id, n_words, n_base (places of all phrases), first_word and last_word (their smallest and largest
    start, null if none), base_labels, labels (the templates' too; both distinct, sorted, comma-joined) and score (1 where a
    phrase stands, else the largest share of a template that a verified span covers, else 0).

    Null and empty texts have no words. Rows that repeat give a row each; null ids are like any other; further columns are
    not looked at.
    """
    found = spans(documents, templates).groupBy(F.col("doc_id").alias("hit_id"), F.col("text_key").alias("hit_key")).agg(
        F.collect_set("label").alias("more"), F.max("share").alias("share")
    )
    none = F.array().cast("array<int>")
    text = lower_ascii(F.coalesce("text", F.lit("")))
    base = documents.select("doc_id", F.xxhash64("text").alias("text_key"), words(F.col("text")).alias("w"), text.alias("low"))
    # A text without a phrase's last word has no place of it: this spares most texts the scan.
    places = [F.when(F.contains("low", F.lit(p.split()[-1])), _phrase_places("w", p)).otherwise(none) for p in phrases]
    base = base.select("doc_id", "text_key", F.size("w").cast("long").alias("n_words"), *[p.alias(f"p{i}") for i, p in enumerate(places)])
    every = F.concat(*[F.col(f"p{i}") for i in range(len(phrases))])
    labels = F.array_sort(F.array_distinct(F.concat(*[F.when(F.size(f"p{i}") > 0, F.array(F.lit(v))).otherwise(F.array().cast("array<string>")) for i, v in enumerate(phrases.values())])))
    base = base.select("doc_id", "text_key", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"), labels.alias("base"))
    joined = base.join(found, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_key") == F.col("hit_key")), "left")
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
