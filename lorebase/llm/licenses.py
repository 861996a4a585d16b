"""License scans, with DataFrame functions only.

Two parts. Phrases: every place where a phrase's words stand consecutively. Templates: an exact
set-similarity join between license notices and text blocks (paragraphs, which blank lines part),
which finds every block that contains at least the threshold's share of a notice's distinct words.
Tokens are ordered by how few documents hold them, over the whole corpus; a notice of n tokens
that must share o of them has a prefix of n - o + 1, and a block without any prefix token can't
match. Candidates must also be long enough (o tokens) and, from the place of their first common
token on, leave enough tokens on either side. What remains is verified on full sets.

Scale: texts are read once and never move; what one scan finds in them (places, and which tokens of notices a
block holds, for blocks that hold enough) is written and serves the token counts and the join. The notices are
constants of this module (or a parameter), so the table broadcast to the join has a fixed size; per document only labels
are shuffled. Token counts come back as one number per notice token.

Edge cases: null text is empty: no words, no labels, null places, score 0. Rows with null or repeated ids
are rows of their own, each labelled by its own text. Very long texts are read whole. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, tune

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction",
    "apache-2": "licensed under the apache license version 2 0 you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "lgpl": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "mpl-2": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one",
    "cc-by": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc-by-nc": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software",
}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def _needed(n: int, threshold: float) -> int:
    return max(1, -int(-(n * threshold - 1e-9) // 1))


def scan_licenses(docs: DataFrame, phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None, threshold: float = 0.8) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every document."""
    phrases, templates = PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates
    spark = docs.sparkSession
    tune(spark)
    sets = {label: sorted(set(text.split())) for label, text in templates.items()}
    needs = {label: _needed(len(tokens), threshold) for label, tokens in sets.items()}
    vocabulary = sorted({t for s in sets.values() for t in s})
    words = lambda c: F.when(c == "", F.lit(0)).otherwise(_spaces(c) + 1)

    # one scan of the texts: normalised blocks, the phrases in all of them, and what blocks hold of the notices
    lowered = F.translate(F.coalesce(F.col("text"), F.lit("")), _UPPER, _LOWER)
    norm = F.transform(F.split(lowered, r"\n[ \t\r]*\n"), lambda c: F.trim(F.regexp_replace(c, GAP, " ")))
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.filter(norm, lambda c: c != "").alias("blocks"))
    rows = rows.select("doc_id", "text_hash", "blocks", F.array_join("blocks", " ").alias("norm")).select("doc_id", "text_hash", "blocks", F.concat(F.lit(" "), "norm", F.lit(" ")).alias("t"), words(F.col("norm")).alias("n_words"))
    counts, firsts, lasts, names = [], [], [], []
    for phrase, label in phrases.items():
        p, k = f" {phrase} ", len(phrase.split())
        has = F.contains("t", F.lit(p))
        counts.append(F.when(has, F.regexp_count("t", F.lit(f"(?=\\Q{p}\\E)"))).otherwise(F.lit(0)))  # places may overlap
        firsts.append(F.when(has, _spaces(F.substring("t", F.lit(1), F.locate(p, F.col("t")))) - 1))
        back = F.reverse("t")
        lasts.append(F.when(has, F.col("n_words") - k - (_spaces(F.substring(back, F.lit(1), F.locate(p[::-1], back))) - 1)))
        names.append(F.when(has, F.lit(label)))
    pick = lambda f, xs: xs[0] if len(xs) == 1 else f(*xs)
    notice = F.array(*map(F.lit, vocabulary))
    least = min(needs.values(), default=0)
    held = F.transform("blocks", lambda c: F.struct(F.array_intersect(notice, F.split(c, " ")).alias("tokens"), F.size(F.array_distinct(F.split(c, " "))).alias("n")))
    rows = rows.select(
        "doc_id",
        "text_hash",
        F.col("n_words").cast("long").alias("n_words"),
        sum(counts[1:], counts[0]).cast("long").alias("n_base"),
        pick(F.least, firsts).cast("long").alias("first_word"),
        pick(F.greatest, lasts).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(F.array_compact(F.array(*names)))).alias("base"),
        held.alias("held"),
    )
    # frequencies count every document's tokens; of the blocks only those that could reach some notice's share go on
    rows = rows.select("*", F.array_distinct(F.flatten(F.transform("held", lambda h: h["tokens"]))).alias("tokens"), F.filter("held", lambda h: F.size(h["tokens"]) >= least).alias("near")).drop("held")
    rows = materialize(rows, "licenses")

    # templates: the vocabulary in order of rarity
    often = {r["token"]: r["n"] for r in rows.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n")).collect()}  # at most one number for each notice token
    rank = {t: i for i, t in enumerate(sorted(vocabulary, key=lambda t: (often.get(t, 0), t)))}
    index = []
    for label, tokens in sets.items():
        tokens = sorted(tokens, key=rank.__getitem__)
        index += [(token, i, label, tokens, len(tokens), needs[label]) for i, token in enumerate(tokens[: len(tokens) - needs[label] + 1])]
    small = F.broadcast(spark.createDataFrame(index, "token string, t_at int, label string, t_tokens array<string>, t_n int, need int"))
    order = F.array(*[F.lit(t) for t in sorted(vocabulary, key=rank.__getitem__)])

    # a block's notice tokens in rarity order; tokens of no notice would stand before or between them and can't match
    blocks = rows.select("doc_id", "text_hash", F.posexplode("near").alias("block", "b")).select("doc_id", "text_hash", "block", F.array_intersect(order, F.col("b.tokens")).alias("b_tokens"), F.col("b.n").alias("b_n"))
    probes = blocks.select("*", F.posexplode("b_tokens").alias("b_at", "token"))
    found = probes.join(small, "token").where(F.col("b_n") >= F.col("need"))
    # positional filter: the first common token leaves at most this many
    reach = F.least(F.col("t_n") - F.col("t_at"), F.size("b_tokens") - F.col("b_at"))
    found = found.where(reach >= F.col("need"))
    shared = F.size(F.array_intersect("b_tokens", "t_tokens"))
    found = found.withColumn("shared", shared).where(F.col("shared") >= F.col("need"))
    # rows that have id and text alike have labels alike
    hits = found.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("label")).alias("found"), F.max(F.col("shared") / F.col("t_n")).alias("best")).withColumnsRenamed({"doc_id": "hit_id", "text_hash": "hit_hash"})

    out = rows.join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_hash") == F.col("hit_hash")), "left")
    none = F.array().cast("array<string>")
    labels = F.array_sort(F.array_union("base", F.coalesce("found", none)))
    score = F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0)))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))


def oracle(threshold: float = 0.8) -> str:
    gap = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    norm = "trim(regexp_replace(translate(coalesce({0}, ''), '" + _UPPER + "', '" + _LOWER + "'), '" + gap + "', ' ', 'g'))"
    rows = ", ".join(f"('{label}', {sorted(set(t.split()))!r})" for label, t in TEMPLATES.items())
    phrase = " UNION ALL ".join(f"SELECT {p.split()!r} AS ws, '{label}' AS label" for p, label in PHRASES.items())
    return f"""
WITH k AS (SELECT row_number() OVER () AS k, doc_id, text FROM documents),
d AS (SELECT k, doc_id, CASE WHEN n = '' THEN [] ELSE string_split(n, ' ') END AS w FROM (SELECT k, doc_id, {norm.format("text")} AS n FROM k)),
ph AS ({phrase}),
pos AS (SELECT k, label, i - 1 AS place FROM (SELECT k, w, label, ws, unnest(range(1, len(w) - len(ws) + 2)) AS i FROM d, ph WHERE list_has_all(w, ws)) WHERE w[i:i + len(ws) - 1] = ws),
b AS (SELECT k, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list_sort(list_distinct(list(label))) AS base FROM pos GROUP BY 1),
bl AS (SELECT k, list_distinct(string_split({norm.format("raw")}, ' ')) AS ws FROM (SELECT k, unnest(regexp_split_to_array(coalesce(text, ''), '\\n[ \\t\\r]*\\n')) AS raw FROM k)),
te AS (SELECT * FROM (VALUES {rows}) AS t(label, tokens)),
m AS (SELECT k, label, len(list_intersect(ws, tokens)) AS shared, len(tokens) AS n FROM bl, te),
h AS (SELECT k, list(DISTINCT label) AS found, max(shared::DOUBLE / n) AS best FROM m WHERE shared >= ceil(n * {threshold} - 1e-9) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
array_to_string(coalesce(base, []), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(found, [])))), ',') AS labels,
CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN b ON d.k = b.k LEFT JOIN h ON d.k = h.k
"""
