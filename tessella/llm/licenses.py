"""Operator 4: license texts by an exact set-similarity join with templates, in DataFrame functions only.

A template is the set of words of a notice; a block is at most SLACK times as many words in a row as the notice has; it
meets the template if it holds at least the threshold of its words, and those that must stand in it. Words are ordered
by how many documents hold them, rarest first, counted over all documents. Of n words a block may miss n - ceil(t n), so
it holds one of the first n - ceil(t n) + 1 of the order (the prefix). Documents meet templates through an index of
prefix words; only then are a template's words sought in the document, and of these each may begin a block. A block is
passed over, before anything is counted, if fewer words of the template than are needed stand in it (length), or if the
rarest word in it stands at a place in the order after which too few follow (position). What remains is counted exactly.

Index and templates are literals of the plan, a row of a table each: neither rows nor operators grow with templates.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Base phrases with their labels (fixed values of the query).
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notices of public licenses: label, words that must stand in a block, the notice in words (fixed values). A notice that
#: extends another one, as a lesser or affero license does, gets the labels of both.
TEMPLATES = (
    ("mit", "mit", "released under the mit license"),
    ("mit", "permission", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("apache-2", "apache 2", "licensed under the apache license version 2 0"),
    ("apache-2", "", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("cc-by-nc", "nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "noncommercial", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa", "sharealike", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by", "attribution", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc0", "waived", "to the extent possible under law the person who associated cc0 with this work has waived all copyright and related or neighboring rights to this work"),
    ("gpl-3", "gnu 3", "licensed under the gnu general public license version 3"),
    ("gpl-3", "gnu 3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-2", "gnu 2", "licensed under the gnu general public license version 2"),
    ("gpl-2", "gnu 2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("lgpl", "lesser", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl-3", "affero", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl-2", "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
)
#: A block has at most so many times the words of a notice, so that words may be put in.
SLACK = 1.5
_APART = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _lower(text: Column) -> Column:
    """A-Z in lower case, nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    """Words of a text: runs of letters, digits and signs beyond ASCII."""
    return F.filter(F.split(_lower(text), _APART), lambda w: w != "")


def word_frequencies(docs: DataFrame, vocabulary: list[str], text_col: str = "text") -> dict[str, int]:
    """Documents that hold each word of a short vocabulary, over all documents; one row a word comes to the driver."""
    seen = docs.select(F.array_intersect(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), _APART), F.array(*map(F.lit, vocabulary))).alias("w"))
    counted = seen.select(F.explode("w").alias("w")).groupBy("w").count().collect()
    return {w: 0 for w in vocabulary} | {r["w"]: r["count"] for r in counted}


def _let(x: Column, f) -> Column:
    """f of x, x being worked out once."""
    return F.transform(F.array(x), f)[0]


class Templates:
    """Templates in the global order, as literals: their table, and the index of prefix words."""

    def __init__(self, listed, threshold: float, slack: float, order: dict[str, int]) -> None:
        self.rows, self.index = [], {}
        for label, must, notice in listed:
            words = notice.split()
            tokens = sorted(set(words), key=lambda w: (order[w], w))
            n, least = len(tokens), math.ceil(threshold * len(set(words)) - 1e-9)
            if not set(must.split()) <= set(words):
                raise ValueError(f"words that must stand in a block are none of the notice: {must}")
            for w in tokens[: n - least + 1]:
                self.index.setdefault(w, []).append(len(self.rows))
            self.rows.append((label, tokens, must.split(), n, least, math.ceil(slack * len(words) - 1e-9)))
        self.vocabulary = sorted({w for r in self.rows for w in r[1]})

    def _table(self) -> Column:
        lit = lambda x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
        return F.array(*(F.struct(F.lit(a).alias("label"), lit(b).alias("tokens"), lit(c).alias("must"), F.lit(d).alias("n"), F.lit(e).alias("least"), F.lit(f).alias("span")) for a, b, c, d, e, f in self.rows))

    def met(self, ws: Column) -> Column:
        """label and share of each template that a block of the words meets, share being the largest of its blocks."""
        index = F.map_from_arrays(F.array(*map(F.lit, self.index)), F.array(*(F.array(*map(F.lit, v)) for v in self.index.values())))
        rare = F.filter(F.array_distinct(ws), lambda w: w.isin(*self.index))
        due = F.array_distinct(F.flatten(F.transform(rare, lambda w: F.element_at(index, w))))
        events = F.filter(F.transform(ws, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda e: e["w"].isin(*self.vocabulary))

        def best(t: Column, every: Column) -> Column:
            """The largest share of template t over blocks that begin with one of its words."""
            own = F.transform(F.filter(every, lambda e: F.array_contains(t["tokens"], e["w"])), lambda e: F.struct(e["i"].alias("i"), (F.array_position(t["tokens"], e["w"]) - 1).alias("k")))

            def over(e: Column) -> Column:
                last = F.size(e) - t["least"]
                starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
                reach = lambda s: F.element_at(e, s + 1)["i"] + t["span"]
                # length: the last of the words needed stands within reach
                enough = F.filter(starts, lambda s: F.element_at(e, s + t["least"])["i"] < reach(s))
                blocks = F.transform(enough, lambda s: F.transform(F.filter(F.slice(e, s + 1, t["span"]), lambda x: x["i"] < reach(s)), lambda x: x["k"]))
                # position: after the rarest word of a block at most n - k words follow
                blocks = F.filter(blocks, lambda b: t["n"] - F.array_min(b) >= t["least"])
                held = F.transform(blocks, lambda b: F.array_distinct(b))
                must = F.transform(t["must"], lambda w: F.array_position(t["tokens"], w) - 1)
                good = F.filter(held, lambda b: (F.size(b) >= t["least"]) & (F.size(F.array_except(must, b)) == 0))
                return F.array_max(F.transform(good, lambda b: F.size(b) / t["n"]))

            return _let(own, over)

        shares = _let(events, lambda every: F.transform(due, lambda k: _let(F.element_at(self._table(), k + 1), lambda t: F.struct(t["label"].alias("label"), best(t, every).alias("share")))))
        return F.filter(shares, lambda s: s["share"].isNotNull())


def _starts(ws: Column, phrase: str) -> Column:
    """Places where the words of a phrase stand in a row."""
    own = phrase.split()
    goal = F.array(*map(F.lit, own))
    last = F.size(ws) - len(own)
    every = F.when((last >= 0) & F.array_contains(ws, own[0]) & F.array_contains(ws, own[-1]), F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.filter(every, lambda i: (F.element_at(ws, i + 1) == own[0]) & (F.slice(ws, i + 1, len(own)) == goal))


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates=TEMPLATES, threshold: float = 0.8, slack: float = SLACK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row.

    n_base counts all places of all phrases, first_word and last_word are their least and greatest start; labels adds to
    the base labels those of templates that some block meets; score is the largest share of a template held by a block
    that meets it, 1 where a phrase stands, else 0. templates lists (label, words that must stand in a block, notice).
    Null and empty texts have no words and no label; null ids and repeated rows stay; other columns are not read; an empty
    table gives no row.
    """
    order = word_frequencies(docs, sorted({w for _, _, t in templates for w in t.split()}), text_col)
    found = Templates(templates, threshold, slack, order)
    rare = sorted(set(found.index) | {p.split()[0] for p in phrases})
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # lower() takes more letters down than A-Z, so it finds all candidates and parts words at the same places
    rows = rows.withColumn("low", F.split(F.lower("text"), _APART))
    held = F.arrays_overlap("low", F.array(*map(F.lit, rare)))
    rows = rows.select("doc_id", F.size(F.array_remove("low", "")).cast("long").alias("n_words"), F.when(held, F.col("text")).alias("t"))
    rows = rows.withColumn("ws", F.when(F.col("t").isNotNull(), words(F.col("t")))).drop("t")
    some = F.col("ws").isNotNull()
    rows = rows.select(
        "doc_id",
        "n_words",
        F.when(some, F.flatten(F.array(*(_starts(F.col("ws"), p) for p in phrases)))).alias("at"),
        F.when(some, F.array(*(F.when(F.size(_starts(F.col("ws"), p)) > 0, F.lit(label)) for p, label in phrases.items()))).alias("base"),
        F.when(some, found.met(F.col("ws"))).alias("shares"),
    )
    base = F.array_sort(F.array_distinct(F.array_compact("base")))
    met = F.transform("shares", lambda s: s["label"])
    best = F.array_max(F.transform("shares", lambda s: s["share"]))
    return rows.select(
        "doc_id",
        "n_words",
        F.when(F.col("at").isNull(), 0).otherwise(F.size("at")).cast("long").alias("n_base"),
        F.array_min("at").cast("long").alias("first_word"),
        F.array_max("at").cast("long").alias("last_word"),
        F.coalesce(F.array_join(base, ","), F.lit("")).alias("base_labels"),
        F.coalesce(F.array_join(F.array_sort(F.array_distinct(F.concat(base, met))), ","), F.lit("")).alias("labels"),
        F.when(F.size("at") > 0, F.lit(1.0)).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"),
    )


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents against the base phrases and the notices of public licenses, threshold 0.8."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
