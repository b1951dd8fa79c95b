"""Licence notices in texts: Dice coefficient over word bigrams, candidates pruned by size.

All in DataFrame functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import settled

#: Short public licence notices by SPDX name.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, "
                    "are permitted provided that the following conditions are met:",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or "
               "neighboring rights to this work.",
}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normal(text: Column) -> Column:
    """Lower-case words of ASCII letters and digits, one blank between; line feeds stay."""
    plain = F.regexp_replace(F.translate(text, UPPER, LOWER), "[^a-z0-9\n]+", " ")
    return F.regexp_replace(plain, " *\n *", "\n")


def units(text: Column) -> Column:
    """Distinct lines, paragraphs (between empty lines) and the whole of a normal text, without line feeds."""
    flat = lambda part: F.trim(F.translate(part, "\n", " "))
    whole = F.array(F.regexp_replace(text, "\n+", " "))
    return F.array_distinct(F.transform(
        F.concat(F.split(text, "\n"), F.split(text, "\n\n+"), whole), flat))


def bigrams(unit: Column) -> Column:
    """Distinct pairs of neighbouring words; a single word stands for itself."""
    words = F.split(unit, " ")
    pairs = F.transform(F.sequence(F.lit(1), F.size(words) - 1),
                        lambda i: F.concat_ws(" ", F.element_at(words, i), F.element_at(words, i + 1)))
    return F.when(F.size(words) > 1, F.array_distinct(pairs)).otherwise(words)


def n_bigrams(unit: Column) -> Column:
    """Bigrams of a unit, repeats counted: its blanks, or 1 for a single word."""
    return F.greatest(F.length(unit) - F.length(F.translate(unit, " ", "")), F.lit(1))


def anchors(listed: list[tuple[str, list[str], int]], least: float) -> str:
    """A pattern that every text matches which can hold a template: a bigram it can't do without.

    A unit that reaches ``least`` has at least ``need`` of a template's bigrams, so it has one of any
    others' number and one more; the longest are taken, which few other texts hold.
    """
    chosen = set()
    for _, pairs, n in listed:
        need = math.ceil(least / (2 - least) * n - 1e-9)
        chosen.update(sorted(set(pairs), key=lambda b: (-len(b), b))[:max(len(set(pairs)) - need + 1, 1)])
    # Words are ASCII letters and digits: nothing in them is part of a pattern's language.
    return "(?i)" + "|".join(b.replace(" ", "[^a-z0-9]+") for b in sorted(chosen))


def windows(docs: DataFrame, listed: list[tuple[str, list[str], int]], least: float) -> DataFrame:
    """Runs of a notice's own length, at any word, that reach ``least``: ``doc_id``, ``unit``, ``license``, ``dice``.

    A text can only hold a notice if enough of its bigrams occur, which is asked first. A run loses
    nothing if it is moved until it begins or ends with a bigram of the notice, so only those places
    are tried, both, as one of them may stand clear of a neighbour. Runs are taken by greatest Dice, of equals the first license by name, of
    its runs the first; one that overlaps a run taken before it is not.
    """
    text = lambda value: F.lit(value)
    every = F.array(*[F.struct(text(name).alias("license"), F.array(*map(text, t)).alias("t"), F.lit(tn).alias("tn"))
                      for name, t, tn in listed])
    flat = docs.where("text is not null").select("doc_id", F.trim(F.translate(normal(F.col("text")), "\n", " ")).alias("s"))

    def held(df: DataFrame, name: str, column: Column) -> DataFrame:
        """Add a column that is worked out once: a generator is not folded into what reads it."""
        return df.select("*", F.explode(F.array(column)).alias(name))

    flat = held(flat, "padded", F.concat(F.lit(" "), F.regexp_replace("s", " +", " "), F.lit(" "))).drop("s")
    able = lambda x: F.size(F.filter(x["t"], lambda b: F.contains("padded", F.concat(F.lit(" "), b, F.lit(" "))))) >= (
        F.ceil(F.lit(least) * x["tn"] - 1e-9))
    met = held(flat, "able", F.filter(every, able)).where(F.size("able") > 0)
    met = held(met, "w", F.split(F.trim("padded"), " ")).drop("padded")
    pairs = F.when(F.size("w") > 1, F.transform(
        F.sequence(F.lit(1), F.size("w") - 1),
        lambda i: F.concat_ws(" ", F.element_at("w", i), F.element_at("w", i + 1)))).otherwise(F.col("w"))
    placed = held(met, "p", F.transform(pairs, lambda b, i: F.struct(i.alias("at"), b.alias("b"))))
    placed = held(placed, "tried", F.transform("able", lambda x: F.struct(
        x["license"].alias("license"), x["tn"].alias("tn"), (F.size("p") - x["tn"]).alias("last"),
        F.filter("p", lambda q: F.array_contains(x["t"], q["b"])).alias("hits")))).drop("able", "p")

    def runs(x):
        def run(low, k):
            near = F.filter(F.slice(x["hits"], F.greatest(k + 2 - x["tn"], F.lit(1)), 2 * x["tn"]),
                            lambda q: (q["at"] >= low) & (q["at"] < low + x["tn"]))
            common = F.size(F.array_distinct(F.transform(near, lambda q: q["b"])))
            return F.struct((2.0 * common / (x["tn"] + x["tn"])).alias("dice"), x["license"].alias("license"),
                            low.alias("low"), (low + x["tn"] - 1).alias("high"))

        def both(a, k):
            return F.array(run(F.least(a["at"], x["last"]), k), run(F.greatest(a["at"] - x["tn"] + 1, F.lit(0)), k))

        every_run = F.array_distinct(F.flatten(F.transform(x["hits"], both)))
        return F.when(x["last"] >= 0, F.filter(every_run, lambda r: r["dice"] >= least)).otherwise(F.array())

    found = held(placed, "runs", F.flatten(F.transform("tried", runs))).where(F.size("runs") > 0)
    ordered = F.array_sort(F.transform("runs", lambda r: F.struct(
        (-r["dice"]).alias("minus"), r["license"].alias("license"), r["low"].alias("low"), r["high"].alias("high"),
        r["dice"].alias("dice"))))
    apart = lambda r, o: (o["low"] > r["high"] + 1) | (r["low"] > o["high"] + 1)
    best = F.aggregate(ordered, F.filter(ordered, lambda r: F.lit(False)), lambda taken, r: F.when(
        F.forall(taken, lambda o: apart(r, o)), F.concat(taken, F.array(r))).otherwise(taken))
    return found.select("doc_id", "w", F.explode(best).alias("r")).select(
        "doc_id", F.concat_ws(" ", F.slice("w", F.col("r.low") + 1, F.col("r.high") - F.col("r.low") + 2)).alias("unit"),
        "r.license", "r.dice")


def scan(docs: DataFrame, templates: DataFrame, least: float = 0.8) -> DataFrame:
    """Notices found: ``doc_id``, ``license``, ``dice`` (of its best unit), ``n_units`` (distinct units that match).

    Units are lines, paragraphs and the whole text. A notice that none of them shows, as it stands
    within a longer line or is wrapped in a longer paragraph, is looked for at every word
    (:func:`windows`); its runs of words are then its units.

    ``docs`` has ``doc_id`` and ``text``; ``templates``, a short list, ``license`` and ``notice``; other
    columns are left out. Dice is twice the distinct bigrams in common over the bigrams of both.
    A unit that reaches ``least`` goes to its most similar template, of equals to the first by
    name. A unit meets only templates whose number of bigrams lets it reach ``least``: the two are
    joined on that number, before any bigram is built. Null and empty texts have no unit;
    repeated documents count a unit once; empty tables give no row.
    """
    notice = F.trim(F.translate(normal(F.col("notice")), "\n", " "))
    known = templates.where("notice is not null").select("license", notice.alias("unit")).where("unit <> ''")
    known = known.select("license", bigrams(F.col("unit")).alias("t"), n_bigrams(F.col("unit")).alias("tn"))
    # A short list, held in the plan.
    listed = [(r["license"], r["t"], r["tn"]) for r in known.collect()]
    if not listed:
        return docs.sparkSession.createDataFrame([], docs.select("doc_id").schema).select(
            "doc_id", F.lit("").alias("license"), F.lit(0.0).alias("dice"), F.lit(0).cast("long").alias("n_units"))
    # Few texts hold any of these words next to each other; the others are read once and no more.
    docs = settled(docs.select("doc_id", "text").where(F.col("text").rlike(anchors(listed, least))))
    low = F.ceil(F.lit(least) / (2 - least) * F.col("tn") - 1e-9).cast("int")
    high = F.floor((2 - F.lit(least)) / least * F.col("tn") + 1e-9).cast("int")
    # A row per template and size that it can match: as many as the templates have words.
    sized = known.withColumn("n", F.explode(F.sequence(low, high)))
    parts = (docs.where("text is not null")
             .select("doc_id", F.explode(units(normal(F.col("text")))).alias("unit")).where("unit <> ''"))
    met = parts.withColumn("n", n_bigrams(F.col("unit"))).join(F.broadcast(sized), "n")
    common = F.size(F.array_intersect(bigrams(F.col("unit")), F.col("t")))
    hits = met.select("doc_id", "unit", "license", (2.0 * common / (F.col("n") + F.col("tn"))).alias("dice"))
    best = hits.where(F.col("dice") >= least).groupBy("doc_id", "unit").agg(
        F.min(F.struct((-F.col("dice")).alias("minus"), "license")).alias("best"))
    whole = best.select("doc_id", "unit", "best.license", (-F.col("best.minus")).alias("dice"), F.lit(1).alias("_whole"))
    inner = windows(docs, listed, least).select("doc_id", "unit", "license", "dice", F.lit(0).alias("_whole")).distinct()
    # A license that a line, paragraph or text shows is told by those alone.
    one = lambda i: F.col("_whole") == i
    return whole.unionByName(inner).groupBy("doc_id", "license").agg(
        F.coalesce(F.max(F.when(one(1), F.col("dice"))), F.max("dice")).alias("dice"),
        F.when(F.max("_whole") == 1, F.count(F.when(one(1), 1))).otherwise(F.count("*")).alias("n_units"))


def oracle_sql(least: float = 0.8) -> str:
    """The same scan of ``documents`` for :data:`NOTICES`, in DuckDB's SQL."""
    plain = "regexp_replace(regexp_replace(translate({0}, '" + UPPER + "', '" + LOWER + "'), '[^a-z0-9\n]+', ' ', 'g'), ' *\n *', '\n', 'g')"
    count = "greatest(length({0}) - length(replace({0}, ' ', '')), 1)"
    pairs = ("CASE WHEN contains({0}, ' ') THEN list_distinct(list_transform(generate_series(1, len(string_split({0}, ' ')) - 1), "
             "lambda i: string_split({0}, ' ')[i] || ' ' || string_split({0}, ' ')[i + 1])) ELSE [{0}] END")
    listed = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in NOTICES.items())
    return f"""
WITH notices AS (SELECT license, trim(replace({plain.format('notice')}, chr(10), ' ')) AS unit FROM (VALUES {listed}) t(license, notice)),
known AS (SELECT license, {pairs.format('unit')} AS t, {count.format('unit')} AS tn FROM notices),
plain AS (SELECT doc_id, {plain.format('text')} AS s FROM documents WHERE text IS NOT NULL),
units AS (
  SELECT DISTINCT doc_id, trim(replace(unit, chr(10), ' ')) AS unit FROM (
    SELECT doc_id, unnest(list_concat(string_split(s, chr(10)), regexp_split_to_array(s, '\n\n+'),
                                      [regexp_replace(s, '\n+', ' ', 'g')])) AS unit FROM plain)),
sized AS (SELECT doc_id, unit, {count.format('unit')} AS n FROM units WHERE unit <> ''),
met AS (
  SELECT doc_id, unit, license,
         2.0::DOUBLE * len(list_intersect({pairs.format('unit')}, t)) / (n + tn) AS dice
  FROM sized JOIN known ON n BETWEEN ceil({least} / (2 - {least}) * tn - 1e-9) AND floor((2 - {least}) / {least} * tn + 1e-9)),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, unit ORDER BY dice DESC, license) AS r FROM met WHERE dice >= {least})
SELECT doc_id, license, max(dice) AS dice, count(*) AS n_units FROM best WHERE r = 1 GROUP BY doc_id, license"""
