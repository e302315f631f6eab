"""License scans by diagonal voting.

All rolling word k-gram hashes of all texts are joined to the positions of the same k-grams in
license templates. A place where a template stands gives hits on one diagonal (document position
minus template position); a reworded one gives hits on neighbouring diagonals. Hits are counted
by diagonal, neighbouring diagonals merged, and the merged spans verified by how much of the
template they cover. Spans that cover too little, as of a text with words inserted in between, are chained where
they follow each other in document and template, and verified by what they cover together. k-grams are compared word by word in the join, so equal hashes don't count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K = 3
SHIFT = 4

# Phrases that name a license, each with its label.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Opening passages of well-known licenses and notices.
TEMPLATES = {
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ],
    "apache-2": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "gpl-3": [
        "the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "gpl-2": [
        "the GNU General Public License, version 2",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ],
    "mpl-2": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    ],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-sa": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "proprietary": ["All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means"],
}

_SEPARATORS = "".join(chr(c) for c in range(128) if not (48 <= c <= 57 or 97 <= c <= 122))


def words_of(text: Column) -> Column:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lower-cased."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    rest = "".join(c for c in _SEPARATORS if c not in upper)
    # translate() can't name NUL next to the others in one literal, so that one goes by replace().
    clean = F.translate(F.replace(text, F.expr("chr(0)"), F.lit(" ")), upper + rest[1:], lower + " " * len(rest[1:]))
    return F.array_remove(F.split(clean, " "), "")


def template_words(text: str) -> list[str]:
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def template_positions(spark: SparkSession, phrases: dict[str, str], templates: dict[str, list[str]], k: int) -> tuple[DataFrame, int]:
    """One row for each k-gram of each template, with its length in k-grams."""
    rows, number = [], 0
    for exact, named in ((True, [(p, label) for p, label in phrases.items()]), (False, [(t, label) for label, ts in templates.items() for t in ts])):
        for text, label in named:
            ws = template_words(text)
            if len(ws) < k:
                raise ValueError(f"shorter than {k} words: {text}")
            rows += [(number, label, exact, len(ws) - k + 1, p, ws[p : p + k]) for p in range(len(ws) - k + 1)]
            number += 1
    schema = "template int, label string, exact boolean, grams int, at int, gram array<string>"
    df = spark.createDataFrame(rows, schema)
    return df.withColumn("h", F.xxhash64(*[F.get("gram", i) for i in range(k)])), len(rows)


CHAIN = "struct<covered:bigint,first:bigint,end:bigint,hi:bigint>"


def chained(parts: Column, grams: Column, k: int, least: float) -> Column:
    """Chains of parts of one template (structs of first, end, lo, hi, covered) that together cover ``least`` of it.

    Parts come in the order of the document; of the chains that end at the same position of the template the one that
    covers most is kept, so there are at most as many as positions. A chain that covers enough is closed when a part
    behind it begins the template, or a piece of it, again.
    """
    best = lambda chains: F.array_max(F.filter(chains, lambda c: c["covered"] >= least * grams))

    def step(a: Column, part: Column) -> Column:
        top = best(a["open"])
        over = F.coalesce((part["lo"] <= top["hi"]) & (part["first"] > top["end"] - k), F.lit(False))
        kept = F.when(over, F.array().cast(f"array<{CHAIN}>")).otherwise(a["open"])
        prior = F.array_max(F.filter(kept, lambda c: (c["hi"] < part["lo"]) & (c["end"] - k < part["first"])))
        longer = F.struct((part["covered"] + F.coalesce(prior["covered"], F.lit(0))).alias("covered"), F.coalesce(prior["first"], part["first"]).alias("first"), part["end"].alias("end"), part["hi"].alias("hi")).cast(CHAIN)
        now = F.array_append(F.filter(kept, lambda c: c["hi"] != part["hi"]), F.array_max(F.array_append(F.filter(kept, lambda c: c["hi"] == part["hi"]), longer)))
        return F.struct(now.alias("open"), F.when(over, F.array_append(a["closed"], top)).otherwise(a["closed"]).alias("closed"))

    none = F.array().cast(f"array<{CHAIN}>")
    return F.aggregate(F.sort_array(parts), F.struct(none.alias("open"), none.alias("closed")), step, lambda a: F.array_compact(F.array_append(a["closed"], best(a["open"]))))


def scan(docs: DataFrame, *, phrases: dict[str, str] = PHRASES, templates: dict[str, list[str]] = TEMPLATES, k: int = K, shift: int = SHIFT, least: float = 0.6) -> DataFrame:
    """doc_id, n_words and spans of every row.

    A span is (label, exact, first, end, score) in words: an exact one is a phrase whose words
    stand consecutively; others are templates of which hits within ``shift`` words of the same
    diagonal, or chains of such hits with other words in between, cover at least ``least``. Null texts count as empty and have no spans, like texts
    of fewer than k words. Rows that share a doc_id, null ones too, are scanned each on its own;
    other columns are ignored. Broadcast are the templates' k-grams, some hundreds of rows that
    don't depend on the documents; shuffled are hits, counted by diagonal first.
    """
    table, _ = template_positions(docs.sparkSession, phrases, templates, k)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.explode(F.array(words_of(text))).alias("w"))
    n = F.size("w")
    at = F.when(n >= k, F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    grams = F.transform(at, lambda i: F.xxhash64(*[F.element_at(F.col("w"), i + j) for j in range(k)]))
    # The last element stands for the document itself: position n, matched by the one row without a template.
    hashed = rows.select("doc_id", "row", "w", F.posexplode(F.array_append(grams, F.lit(0).cast("long"))).alias("pos", "h"))
    own = F.lit(None)
    probes = table.select("h", "template", "label", "exact", "grams", "at", "gram").unionByName(docs.sparkSession.range(1).select(F.lit(0).cast("long").alias("h"), own.cast("int").alias("template"), own.cast("string").alias("label"), own.cast("boolean").alias("exact"), own.cast("int").alias("grams"), own.cast("int").alias("at"), own.cast("array<string>").alias("gram")))
    same = F.col("gram").isNull() | (F.slice("w", F.col("pos") + 1, k) == F.col("gram"))
    last = F.col("pos") == F.greatest(F.size("w") - k + 1, F.lit(0))
    hits = hashed.join(F.broadcast(probes), "h").filter(same & (F.col("gram").isNotNull() | last))
    hits = hits.select("doc_id", "row", F.when(F.col("gram").isNull(), F.size("w")).alias("n"), "template", "label", "exact", "grams", "pos", "at")
    diagonals = hits.groupBy("row", "doc_id", "template", "label", "exact", "grams", (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.max("n").alias("n"), F.min("at").alias("lo"), F.max("at").alias("hi"), F.collect_list("at").alias("places"))
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    # An exact phrase needs all votes on its own diagonal; other templates merge with the diagonal before.
    near = (~F.col("exact")) & (F.col("diagonal") - F.lag("diagonal").over(order) <= shift)
    marked = diagonals.withColumn("new", F.when(F.coalesce(near, F.lit(False)), 0).otherwise(1))
    # A run of neighbours is cut into bands of 4 * shift diagonals, so that repeated phrases can't chain without end.
    begin = F.max(F.when(F.col("new") == 1, F.col("diagonal"))).over(order)
    banded = marked.select("*", F.sum("new").over(order).alias("cluster"), F.floor((F.col("diagonal") - begin) / (4 * shift)).alias("band"))
    merged = banded.groupBy("row", "doc_id", "template", "label", "exact", "grams", "cluster", "band").agg(
        F.max("n").alias("n"), F.min(F.col("diagonal") + F.col("lo")).alias("first"), (F.max(F.col("diagonal") + F.col("hi")) + k).alias("end"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("covered")
    )
    # Votes elect the diagonals; what counts in the end is how many positions of the template they cover, each once.
    score = F.col("covered") / F.col("grams")
    # Short notices must stand whole: one word may name another license or version.
    good = F.when(F.col("exact") | (F.col("grams") < 10), F.col("covered") >= F.col("grams")).otherwise(score >= least)
    span = F.when(F.col("template").isNotNull() & good, F.struct("label", "exact", F.col("first").cast("long").alias("first"), F.col("end").cast("long").alias("end"), score.alias("score")))
    part = F.when(~F.col("exact") & (F.col("grams") >= 10) & ~good, F.struct(*[F.col(c).cast("long").alias(c) for c in ("first", "end", "lo", "hi", "covered")]))
    each = merged.groupBy("row", "doc_id", "template", "label", "exact", "grams").agg(F.max("n").alias("n"), F.collect_list(span).alias("spans"), F.collect_list(part).alias("parts"))
    joint = F.transform(chained(F.col("parts"), F.col("grams"), k, least), lambda c: F.struct(F.col("label"), F.col("exact"), c["first"].alias("first"), c["end"].alias("end"), F.least(c["covered"] / F.col("grams"), F.lit(1.0)).alias("score")))
    each = each.withColumn("spans", F.when(F.size("parts") > 1, F.concat("spans", joint)).otherwise(F.col("spans")))
    return each.groupBy("row", "doc_id").agg(F.max("n").cast("long").alias("n_words"), F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans")).drop("row")


def summary(found: DataFrame) -> DataFrame:
    """Counts, places and labels of scan()'s rows."""
    exact = F.filter("spans", lambda s: s["exact"])
    joined = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    starts = F.transform(exact, lambda s: s["first"])
    best = F.coalesce(F.array_max(F.transform(F.col("spans"), lambda s: s["score"])), F.lit(0.0))
    return found.select(
        "doc_id", "n_words", F.size(exact).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(exact).alias("base_labels"), joined(F.col("spans")).alias("labels"), best.alias("score"),
    )
