"""License scan: TF-IDF cosine of lines, windows and licence files to templates, and inheritance from directories.

Only terms of the templates need a document frequency; it is counted over all files. Other terms have the
weight of a term that occurs nowhere. A part of a text can only reach the threshold if it holds one of a
template's heavy terms, so files without any are left out before they are cut into terms. Nor can it if the
terms that it shares with the template have less than the threshold's square of the template's squared length,
so only parts with as much are counted term by term.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formlake.llm.common import distinct_names, sized, store

THRESHOLD = 0.8
TERM = r"[a-z0-9]+"


@dataclass(frozen=True)
class Template:
    license: str
    text: str


# Licence notices as they are put into headers, and opening sentences of licence files.
TEMPLATES = (
    Template("MIT", "Released under the MIT License."),
    Template("MIT", "Licensed under the MIT License."),
    Template("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                    "associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    Template("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    Template("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
                           "except in compliance with the License."),
    Template("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    Template("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the "
                        "GNU General Public License as published by the Free Software Foundation, either version 3 of the "
                        "License, or (at your option) any later version."),
    Template("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    Template("CC-BY-4.0", "Licensed under CC BY 4.0."),
    Template("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are "
                             "permitted provided that the following conditions are met"),
    Template("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)

LICENSE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice)[^/]*$"


def terms(text: str) -> Counter:
    return Counter(re.findall(TERM, re.sub("[A-Z]", lambda m: m[0].lower(), text)))


def _lower(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(_lower(text), F.lit(TERM), F.lit(0))


class Weights:
    """Inverse document frequencies, and the templates under them."""

    def __init__(self, templates: Sequence[Template], n_files: int, frequency: dict[str, int], threshold: float):
        self.n_files = n_files
        self.vocabulary = sorted({t for x in templates for t in terms(x.text)})
        self.idf = {t: self.of(frequency.get(t, 0)) for t in self.vocabulary}
        self.rows: list[tuple[int, str, str, float]] = []
        heavy = set()
        #: Of each template: number of terms, heavy terms, and the share of each term in the squared length.
        self.shapes: list[tuple[int, list[str], dict[str, float]]] = []
        for i, x in enumerate(templates):
            own = {t: n * self.idf[t] for t, n in terms(x.text).items()}
            norm = math.sqrt(sum(w * w for w in own.values()))
            rest, first = norm * norm, []
            for t, w in sorted(own.items(), key=lambda tw: (-tw[1], tw[0])):
                # The cosine of a line with none of the terms so far is at most the length of the rest.
                if math.sqrt(max(rest, 0)) < 0.999 * threshold * norm:
                    break
                first.append(t)
                rest -= w * w
            heavy.update(first)
            self.shapes.append((sum(terms(x.text).values()), first, {t: (w / norm) ** 2 for t, w in own.items()}))
            self.rows += [(i, x.license, t, w / norm) for t, w in own.items()]
        self.heavy = sorted(heavy)

    def of(self, frequency: int) -> float:
        return math.log((self.n_files + 1) / (frequency + 1)) + 1


def _weights(files: DataFrame, templates: Sequence[Template], threshold: float) -> Weights:
    """Counts, over all files, in how many each term of the templates occurs: at most one row a term."""
    vocabulary = sorted({t for x in templates for t in terms(x.text)})
    found = F.array_intersect(_terms(F.coalesce("text", F.lit(""))), F.array(*map(F.lit, vocabulary)))
    counted = files.select(F.explode(F.array_append(found, F.lit(""))).alias("term")).groupBy("term").count().collect()
    frequency = {r["term"]: r["count"] for r in counted}
    return Weights(templates, frequency.pop("", 0), frequency, threshold)


def _parts(weights: Weights, threshold: float) -> Column:
    """Of a text (whole, lines, words), the arrays of terms that can reach the threshold."""
    least = (0.999 * threshold) ** 2
    templates = F.array(*[
        F.struct(F.lit(n).alias("n"), F.array(*map(F.lit, heavy)).alias("heavy"), F.array(*map(F.lit, share)).alias("names"),
                 F.create_map(*[F.lit(v) for tw in share.items() for v in tw]).alias("share"))
        for n, heavy, share in weights.shapes if share])

    def near(part: Column, template: Column) -> Column:
        shared = F.array_intersect(part, template["names"])
        return F.aggregate(shared, F.lit(0.0), lambda acc, t: acc + F.element_at(template["share"], t)) >= least

    def any_near(part: Column) -> Column:
        heavy = F.array(*map(F.lit, weights.heavy))
        return F.arrays_overlap(part, heavy) & F.exists(templates, lambda t: near(part, t))

    def windows(template: Column) -> Column:
        size, words = template["n"], F.col("words")
        marked = F.transform(words, lambda w, i: F.when(F.array_contains(template["heavy"], w), i))
        last = F.greatest(F.size(words) - size, F.lit(0))
        # Every place where a run can start that holds one of the heavy terms.
        starts = F.array_distinct(F.flatten(F.transform(F.filter(marked, lambda i: i.isNotNull()), lambda i: F.sequence(
            F.greatest(i - size + 1, F.lit(0)), F.least(i, last)))))
        starts = F.filter(starts, lambda s: near(F.slice(words, s + 1, size), template))
        return F.transform(starts, lambda s: F.slice(words, s + 1, size))

    runs = F.flatten(F.transform(F.filter(templates, lambda t: near(F.col("words"), t)), windows))
    whole = F.filter(F.array("words"), lambda w: F.col("whole") & any_near(w))
    return F.concat(F.filter("lines", any_near), whole, runs)


def license_notices(
    files: DataFrame, templates: Sequence[Template] = TEMPLATES, threshold: float = THRESHOLD
) -> DataFrame:
    """(file, license, similarity) of each stored row of ``files`` (file, path, text) that has a notice of its own.

    Candidates are every line of every file, every run of as many terms as a template has, wherever lines
    end, and the whole text of a licence file; the best cosine counts, ties go to the first name.
    """
    spark = files.sparkSession
    weights = _weights(files, templates, threshold)
    if not weights.heavy:
        return spark.createDataFrame([], "file long, license string, similarity double")
    texts = files.where(_lower(F.col("text")).rlike("|".join(weights.heavy))).select(
        "file", F.coalesce(F.col("path").rlike(LICENSE_FILE), F.lit(False)).alias("whole"),
        F.transform(F.split("text", "\n", -1), _terms).alias("lines"))
    texts = texts.select("file", "whole", "lines", F.flatten("lines").alias("words"))
    lines = store(texts.select("file", F.posexplode(_parts(weights, threshold)).alias("line", "terms")), "parts")
    counts = lines.select("file", "line", F.explode("terms").alias("term")).groupBy("file", "line", "term").agg(
        F.count(F.lit(1)).alias("n"))
    # Tables of the templates' terms: their size is that of the templates.
    idf = F.broadcast(spark.createDataFrame(list(weights.idf.items()), "term string, idf double"))
    model = F.broadcast(spark.createDataFrame(weights.rows, "template int, license string, term string, weight double"))
    weighed = counts.join(idf, "term", "left").withColumn(
        "w", F.col("n") * F.coalesce("idf", F.lit(weights.of(0))))
    norms = weighed.groupBy("file", "line").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighed.join(model, "term").groupBy("file", "line", "template", "license").agg(
        F.sum(F.col("w") * F.col("weight")).alias("dot"))
    close = dots.join(norms, ["file", "line"]).withColumn("similarity", F.col("dot") / F.col("norm"))
    close = close.where(F.col("similarity") >= threshold)
    # Equal cosines differ in their last digits, as sums are added in any order.
    close = close.withColumn("similarity", F.round("similarity", 6))
    best = close.groupBy("file").agg(F.max("similarity").alias("similarity"))
    return close.join(best, ["file", "similarity"]).groupBy("file", "similarity").agg(
        F.min("license").alias("license")).select("file", "license", "similarity")


def directory(path: Column) -> Column:
    """All before the last slash, '' for a file at the top."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def inherited(files: DataFrame, notices: DataFrame) -> DataFrame:
    """(dir, license, from_dir): each directory with the licence file of its nearest ancestor, itself included.

    Of several licence files in a directory the most similar counts, then the first licence name.
    """
    own = files.where(F.col("path").rlike(LICENSE_FILE)).select("file", "dir").join(notices, "file")
    best = own.groupBy("dir").agg(F.max("similarity").alias("similarity"))
    own = own.join(best, ["dir", "similarity"]).groupBy("dir").agg(F.min("license").alias("license"))
    dirs = files.select("dir").where("dir is not null").distinct()
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    chain = dirs.select("dir", F.posexplode(above).alias("level", "from_dir"))
    found = chain.join(own.withColumnRenamed("dir", "from_dir"), "from_dir")
    nearest = found.groupBy("dir").agg(F.max("level").alias("level"))
    return found.join(nearest, ["dir", "level"]).groupBy("dir").agg(
        F.min("license").alias("dir_license"), F.min("from_dir").alias("from_dir"))


def license_scan(
    df: DataFrame, path_col: str = "path", text_col: str = "text", id_col: str | None = None,
    templates: Sequence[Template] = TEMPLATES, threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per input row: doc_id (if ``id_col`` is given), path, license, origin, from_dir, similarity.

    origin is 'notice' where a line or run of terms of the file itself is close to a template, 'directory' where the nearest
    ancestor directory with a licence file gives the license, else null with a null license. Null and
    empty texts have no notice; a null path has no directory. Repeated rows are judged each. An empty table gives
    an empty table. Extra columns are ignored.
    """
    files = distinct_names(df, doc_id=id_col, path=path_col, text=text_col).withColumn(
        "file", F.monotonically_increasing_id())
    names = store(files.select("file", "doc_id", "path", directory(F.col("path")).alias("dir")), "files")
    notices = store(license_notices(files, templates, threshold), "notices")
    above = store(inherited(names, notices), "directories")
    out = names.join(sized(notices), "file", "left").join(sized(above), "dir", "left")
    own = F.col("license").isNotNull()
    origin = F.when(own, "notice").when(F.col("dir_license").isNotNull(), "directory")
    columns = ["doc_id"] if id_col else []
    return out.select(
        *columns, "path", F.coalesce("license", "dir_license").alias("license"), origin.alias("origin"),
        F.when(~own, F.col("from_dir")).alias("from_dir"), F.round("similarity", 3).alias("similarity"),
    )


def document_files(documents: DataFrame) -> DataFrame:
    """Documents as files: source/lang/group of 1000/name. Short ones are their directory's notices."""
    short = F.when(F.col("n_chars") <= 300, "NOTICE").otherwise("document")
    name = F.concat_ws("-", short, F.col("doc_id").cast("string"))
    group = F.concat(F.lit("g"), F.expr("doc_id div 1000").cast("string"))
    return documents.select("doc_id", F.concat_ws("/", "source", "lang", group, name).alias("path"), "text")


def license_sql(templates: Sequence[Template] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """``license_scan`` of ``document_files`` in DuckDB's SQL.

    Parts are the lines of every text, the whole text of notice files, and every run of as many terms as a template
    has, at each place of a text, that shares enough of that template; all are scored against all templates.
    """
    least = (0.999 * threshold) ** 2
    values = ", ".join(
        f"({i}, '{x.license}', '{t}', {n})" for i, x in enumerate(templates) for t, n in terms(x.text).items())
    return f"""WITH files AS (
  SELECT doc_id, text, source || '/' || lang || '/g' || (doc_id // 1000)::VARCHAR AS dir,
         CASE WHEN n_chars <= 300 THEN 'NOTICE' ELSE 'document' END || '-' || doc_id::VARCHAR AS name, n_chars FROM documents
), template(template, license, term, n) AS (VALUES {values}
), total AS (SELECT count(*) AS n FROM files
), frequency AS (
  SELECT term, count(DISTINCT doc_id) AS df
  FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{TERM}')) AS term FROM files)
  WHERE term IN (SELECT term FROM template) GROUP BY term
), idf AS (
  SELECT t.term, ln((SELECT n + 1 FROM total)::DOUBLE / (coalesce(df, 0) + 1)) + 1 AS idf
  FROM (SELECT DISTINCT term FROM template) t LEFT JOIN frequency f ON t.term = f.term
), model AS (
  SELECT template, license, t.term, n * idf AS w, sqrt(sum(n * idf * n * idf) OVER (PARTITION BY template)) AS norm
  FROM template t JOIN idf i ON t.term = i.term
), words AS (
  SELECT doc_id, generate_subscripts(all_terms, 1) - 1 AS pos, unnest(all_terms) AS term
  FROM (SELECT doc_id, regexp_extract_all(lower(text), '{TERM}') AS all_terms FROM files)
), able AS (
  SELECT doc_id, template FROM (SELECT DISTINCT doc_id, term FROM words) d JOIN model m ON d.term = m.term
  GROUP BY ALL HAVING sum(m.w * m.w / m.norm / m.norm) >= {least}
), starts AS (
  SELECT a.doc_id, a.template, size, unnest(range(0, greatest(n_words - size, 0) + 1)) AS start
  FROM able a JOIN (SELECT template, sum(n)::BIGINT AS size FROM template GROUP BY template) t ON a.template = t.template
  JOIN (SELECT doc_id, count(*) AS n_words FROM words GROUP BY doc_id) n ON a.doc_id = n.doc_id
), runs AS (
  SELECT p.doc_id, p.template, p.start, w.term, count(*) AS n
  FROM (SELECT doc_id, template, start, start + unnest(range(0, size)) AS pos FROM starts) p
  JOIN words w ON p.doc_id = w.doc_id AND p.pos = w.pos GROUP BY ALL
), near AS (
  SELECT doc_id, r.template, start FROM runs r JOIN model m ON r.template = m.template AND r.term = m.term
  GROUP BY ALL HAVING sum(m.w * m.w / m.norm / m.norm) >= {least}
), lines AS (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line, unnest(string_split(text, chr(10))) AS part
  FROM files
), counts AS (
  SELECT doc_id, 'line ' || line::VARCHAR AS line, term, count(*) AS n
  FROM (SELECT doc_id, line, unnest(regexp_extract_all(lower(part), '{TERM}')) AS term FROM lines) GROUP BY ALL
  UNION ALL
  SELECT w.doc_id, 'whole' AS line, term, count(*) AS n FROM words w JOIN files f ON w.doc_id = f.doc_id
  WHERE n_chars <= 300 GROUP BY ALL
  UNION ALL
  SELECT doc_id, 'run ' || template::VARCHAR || ' ' || start::VARCHAR AS line, term, n
  FROM runs SEMI JOIN near USING (doc_id, template, start)
), weighed AS (
  SELECT c.doc_id, line, c.term, c.n * coalesce(idf, ln((SELECT n + 1 FROM total)::DOUBLE) + 1) AS w
  FROM counts c LEFT JOIN idf i ON c.term = i.term
), norms AS (SELECT doc_id, line, sqrt(sum(w * w)) AS norm FROM weighed GROUP BY ALL
), close AS (
  SELECT w.doc_id, m.license, round(sum(w.w * m.w) / any_value(m.norm) / any_value(s.norm), 6) AS similarity
  FROM weighed w JOIN model m ON w.term = m.term JOIN norms s ON w.doc_id = s.doc_id AND w.line = s.line
  GROUP BY w.doc_id, w.line, m.template, m.license HAVING similarity >= {threshold}
), notices AS (
  SELECT doc_id, license, similarity FROM close
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY similarity DESC, license) = 1
), own AS (
  SELECT dir, license FROM files f JOIN notices n ON f.doc_id = n.doc_id WHERE n_chars <= 300
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY similarity DESC, license) = 1
)
SELECT f.doc_id, f.dir || '/' || name AS path, coalesce(n.license, o.license) AS license,
       CASE WHEN n.license IS NOT NULL THEN 'notice' WHEN o.license IS NOT NULL THEN 'directory' END AS origin,
       CASE WHEN n.license IS NULL AND o.license IS NOT NULL THEN o.dir END AS from_dir, round(n.similarity, 3) AS similarity
FROM files f LEFT JOIN notices n ON f.doc_id = n.doc_id LEFT JOIN own o ON f.dir = o.dir"""
