"""License scan by diagonal voting, in DataFrame expressions only.

Every two neighbouring words of a text are joined with the places where templates hold the same two words. A text
place less a template place is a diagonal; a copied template votes for one diagonal again and again, and a copy with
words put in or left out for a few neighbouring ones. The votes of a diagonal and its neighbours are merged, and the span
they stand for is verified: the template places that the text holds in the order of the template, each counted once, have
to be a large share of all of them, and words that no other license has must be among them.

A template has at most ``LONGEST`` pairs of words, so its places are the bits of a long. Whole license texts are taken
as a table and cut into sections of that length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import quoted

# fixed values: characters that words consist of, and base phrases with their labels
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
# fixed values: notices in the words of the published licenses
TEMPLATES = [
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2.0"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl-2.0"),
]


def words(text: Column) -> Column:
    """The words of a text with A-Z lower-cased; the one other sign whose small form is an ASCII letter is kept apart."""
    return F.regexp_extract_all(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit(chr(0x212A)), F.lit(chr(0xE9)))), F.lit(WORD), 0)


LONGEST = 60  # pairs of words in a template
SHORTEST = 8  # words in the last section of a license text
OWN = "^[a-z]{3,}$"  # words that can tell one license from another


def listed(spark: SparkSession, base=BASE, templates=TEMPLATES) -> DataFrame:
    """Phrases and notices as a table: base, label, said (words)."""
    rows = []
    for number, (phrase, label) in enumerate([*base, *templates]):
        if not 2 <= len(phrase.split()) <= LONGEST + 1:
            raise ValueError(f"a template of {len(phrase.split())} words; 2 to {LONGEST + 1} are possible: {phrase}")
        if phrase + label != (phrase + label).translate({39: None, 92: None}):
            raise ValueError(f"quote or backslash in a template: {phrase}")
        rows.append(f"({str(number < len(base)).lower()}, '{label}', '{phrase}')")
    values = ", ".join(rows) or "(true, '', '')"
    return spark.sql(f"SELECT base, label, split(phrase, ' ') AS said FROM VALUES {values} AS t(base, label, phrase) WHERE phrase != ''")


def sections(texts: DataFrame, label: str = "label", text: str = "text") -> DataFrame:
    """Templates out of a table of whole license texts: sections of ``LONGEST + 1`` words, each from the last word of
    the one before. A last section under ``SHORTEST`` words is left out, if it isn't the only one; a missing label or
    text and a text of one word give none."""
    said = texts.select(F.col(quoted(label)).cast("string").alias("label"), words(F.col(quoted(text))).alias("w")).where("label IS NOT NULL AND size(w) > 1")
    cut = said.selectExpr("false AS base", "label", f"explode(transform(sequence(1, size(w) - 1, {LONGEST}), i -> struct(i AS i, slice(w, i, {LONGEST + 1}) AS said))) AS s")
    return cut.select("base", "label", "s.*").where(f"size(said) >= {SHORTEST} OR i = 1").select("base", "label", "said").distinct()


def positions(templates: DataFrame) -> DataFrame:
    """Two neighbouring template words and where they stand; ``marks`` are the places of words of one label only."""
    rows = templates.selectExpr("base", "label", "said", "xxhash64(base, label, array_join(said, ' ')) AS template").dropDuplicates(["template"])
    word = rows.where("NOT base").select("template", "label", F.posexplode("said").alias("i", "w")).where(F.col("w").rlike(OWN))
    alone = word.groupBy("w").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a = b")
    marks = word.join(alone.select("w"), "w", "left_semi").groupBy("template").agg(F.array_sort(F.collect_list("i")).alias("marks"))
    pairs = "transform(sequence(1, size(said) - 1), i -> struct(said[i - 1] AS t1, said[i] AS t2))"
    placed = rows.join(marks, "template", "left").selectExpr("template", "label", "base", "size(said) - 1 AS pairs", "marks", f"posexplode({pairs}) AS (place, p)")
    return placed.selectExpr("template", "label", "base", "pairs", "marks", "place", "p.t1", "p.t2", "xxhash64(p.t1, p.t2) AS gram")


#: The template places held on a diagonal and those near it, as bits.
COVERED = "aggregate(near, 0L, (m, e) -> m | e.places)"
#: Half of the words that tell the license from others stand in a pair that is held.
TOLD = "marks IS NULL OR 2 * size(filter(marks, i -> covered & if(i = 0, 1L, shiftleft(3L, i - 1)) != 0)) >= size(marks)"
FIRST = "array_min(transform(near, e -> e.diagonal + bit_count((e.places & -e.places) - 1)))"
LAST = "array_max(transform(near, e -> e.diagonal + length(bin(e.places))))"
#: For each text place of the span, the template places it is hit at.
MATCHES = (
    "transform(sequence(first, last - 1), pos -> aggregate(near, 0L, (m, e) ->"
    " m | if(pos >= e.diagonal AND pos < e.diagonal + pairs, e.places & shiftleft(1L, pos - e.diagonal), 0L)))"
)
#: Places held in the template's order. The longest common subsequence in its bit form: zeros of ``v`` are places found
#: so far, and the sum carries past those that a later match cannot use.
FULL = "(shiftleft(1L, pairs) - 1)"
ORDERED = f"(pairs - bit_count(aggregate({MATCHES}, {FULL}, (v, m) -> ((v + (v & m)) | (v - (v & m))) & {FULL})))"


def license_spans(
    docs: DataFrame,
    base=BASE,
    templates=TEMPLATES,
    texts: DataFrame | None = None,
    share: float = 0.7,
    weak: float = 0.1,
    gap: int = 3,
    keys: tuple[str, ...] = ("doc_id",),
    text: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: keys, n_words, spans.

    ``spans`` holds (base, label, first, last, score): word numbers from 0, in order. Base phrases are found
    where all their words stand in a row (score 1). A template is found around a diagonal if ``share`` of its places
    are held, in the template's order, on diagonals at most ``gap`` away with at least ``weak`` of its places each, and
    half of the words that only templates of its label have; the score is the share held. Of neighbouring diagonals
    that stand for one span the best is given. ``texts`` (label, text) adds whole license texts, see :func:`sections`.

    A missing or empty text has no words and no spans, a very long one is scanned whole, repeated rows are scanned each, an
    empty table gives no rows; other columns are not read.
    """
    given = listed(docs.sparkSession, base, templates)
    # the built-in templates are as large as they stand here; of a table Spark knows the size
    places = F.broadcast(positions(given)) if texts is None else positions(given.unionByName(sections(texts)))
    rows = docs.select(*[F.col(quoted(k)).alias(f"_k{i}") for i, k in enumerate(keys)], F.monotonically_increasing_id().alias("_row"), words(F.col(quoted(text))).alias("_words"))
    own = ["_row", *[f"_k{i}" for i in range(len(keys))], "n_words"]
    rows = rows.withColumn("n_words", F.size("_words").cast("long"))
    pairs = F.arrays_zip(F.col("_words").alias("a"), F.slice("_words", F.lit(2), F.greatest(F.size("_words"), F.lit(1))).alias("b"))
    # each word with the next one; the last word has none, and is the row's own entry
    grams = rows.select(*own, F.posexplode_outer(pairs).alias("pos", "gram")).select(*own, "pos", F.col("gram.a").alias("w1"), F.col("gram.b").alias("w2"))
    same = (F.xxhash64("w1", "w2") == F.col("gram")) & (F.col("w1") == F.col("t1")) & (F.col("w2") == F.col("t2"))
    hits = grams.join(places, same, "left").where("template IS NOT NULL OR w2 IS NULL")
    hits = hits.select(*own, "place", "template", "pairs", "label", "base", "marks", (F.col("pos") - F.col("place")).alias("diagonal")).repartition("_row")

    by = [*own, "template", "pairs", "label", "base", "marks"]
    # on one diagonal a place is hit once, so its bits count its votes
    lines = hits.groupBy(*by, "diagonal").agg(F.expr("bit_or(shiftleft(1L, place)) AS places"))
    lines = lines.where(f"template IS NULL OR bit_count(places) >= if(base, pairs, ceil(pairs * {weak}D))")
    near = f"collect_list(struct(diagonal, places)) OVER (PARTITION BY _row, template ORDER BY diagonal RANGE BETWEEN {gap} PRECEDING AND {gap} FOLLOWING)"
    lines = lines.selectExpr(*by, "diagonal", f"if(base, array(struct(diagonal, places)), {near}) AS near")
    lines = lines.selectExpr("*", f"{COVERED} AS covered", f"{FIRST} AS first", f"{LAST} AS last")
    lines = lines.where(f"template IS NULL OR bit_count(covered) >= {share}D * pairs AND ({TOLD})")
    lines = lines.selectExpr(*own, "template", "label", "base", "diagonal", "first", "last", f"if(base, 1D, {ORDERED} / pairs) AS score")
    lines = lines.where(f"template IS NULL OR score >= {share}D")

    along = Window.partitionBy("_row", "template").orderBy("diagonal")
    new = F.col("base") | (F.col("diagonal") - F.lag("diagonal").over(along) > 2 * gap)
    lines = lines.withColumn("_new", F.coalesce(new, F.lit(True)).cast("int")).withColumn("_group", F.sum("_new").over(along))
    span = "struct(base, label, bigint(first) AS first, bigint(last) AS last, score)"
    best = f"max_by(if(template IS NULL, NULL, {span}), struct(score, -diagonal))"
    merged = lines.groupBy(*own, "template", "_group").agg(F.expr(f"{best} AS span"))
    out = merged.groupBy(*own).agg(F.array_sort(F.collect_list("span")).alias("spans"))
    return out.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], "n_words", "spans")


def scan_digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts, ends and labels of the spans of every row."""
    base = F.filter("spans", lambda s: s["base"])
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    return found.select(
        key,
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda s: s["first"])).alias("first_word"),
        F.array_max(F.transform(base, lambda s: s["first"])).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("score"),
    )


def scan_sql(base=BASE, templates=TEMPLATES, share: float = 0.7, weak: float = 0.1, gap: int = 3) -> str:
    """The same scan as SQL over the table documents, for rows with distinct keys.

    Spans are found another way here: chains of hits that rise in text and template are grown hit by hit.
    """
    said = ", ".join(f"({i}, '{phrase}', '{label}', {str(i < len(base)).lower()})" for i, (phrase, label) in enumerate([*base, *templates]))
    pattern = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    return f"""
WITH RECURSIVE template(id, phrase, label, base) AS (VALUES {said}),
said AS (SELECT id, label, base, string_split(phrase, ' ') AS w FROM template),
word AS (SELECT id, label, unnest(w) AS t, unnest(range(len(w))) AS i FROM said WHERE NOT base),
own AS (
    SELECT id, i FROM word WHERE regexp_full_match(t, '[a-z]{{3,}}')
      AND t NOT IN (SELECT a.t FROM word a JOIN word b ON a.t = b.t AND a.label <> b.label)
),
place AS (SELECT id, label, base, len(w) - 1 AS pairs, unnest(range(1, len(w))) AS i, w FROM said),
doc AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{pattern}') AS w
    FROM documents
),
gram AS (SELECT doc_id, unnest(range(1, len(w))) AS i, w FROM doc),
hit AS MATERIALIZED (
    SELECT doc_id, id, label, base, pairs, g.i - 1 AS pos, p.i - 1 AS place, g.i - p.i AS diagonal
    FROM (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b FROM gram) g JOIN (SELECT *, w[i] AS a, w[i + 1] AS b FROM place) p USING (a, b)
),
line AS (
    SELECT doc_id, id, label, base, pairs, diagonal, min(pos) AS lo FROM hit GROUP BY ALL
    HAVING CASE WHEN base THEN count(*) = pairs ELSE count(*) >= ceil(pairs * {weak}::DOUBLE) END
),
strong AS (SELECT h.* FROM hit h SEMI JOIN line l USING (doc_id, id, diagonal) WHERE NOT h.base),
near AS MATERIALIZED (
    SELECT c.doc_id, c.id, c.label, c.pairs, c.diagonal AS centre, s.pos, s.place
    FROM line c JOIN strong s ON s.doc_id = c.doc_id AND s.id = c.id AND s.diagonal BETWEEN c.diagonal - {gap} AND c.diagonal + {gap}
),
centre AS (
    SELECT doc_id, id, centre FROM near n GROUP BY doc_id, id, centre, pairs
    HAVING count(DISTINCT place) >= {share}::DOUBLE * pairs
       AND 2 * (SELECT count(*) FROM own o WHERE o.id = n.id AND (list_contains(list(n.place), o.i) OR list_contains(list(n.place), o.i - 1)))
           >= (SELECT count(*) FROM own o WHERE o.id = n.id)
),
open AS (SELECT n.* FROM near n SEMI JOIN centre USING (doc_id, id, centre)),
chain(doc_id, id, centre, pos, place, size) AS (
    SELECT doc_id, id, centre, pos, place, 1 FROM open
    UNION
    SELECT o.doc_id, o.id, o.centre, o.pos, o.place, size + 1
    FROM chain c JOIN open o ON o.doc_id = c.doc_id AND o.id = c.id AND o.centre = c.centre AND o.pos > c.pos AND o.place > c.place
),
longest AS (SELECT doc_id, id, centre, max(size) AS size FROM chain GROUP BY ALL),
found AS (
    SELECT doc_id, label, true AS base, lo, 1.0::DOUBLE AS score FROM line WHERE base
    UNION ALL
    SELECT l.doc_id, t.label, false, NULL, l.size::DOUBLE / (len(s.w) - 1) FROM longest l JOIN template t ON t.id = l.id JOIN said s ON s.id = l.id
    WHERE l.size::DOUBLE / (len(s.w) - 1) >= {share}::DOUBLE
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, count(*) FILTER (WHERE base) AS n_base,
       min(lo) FILTER (WHERE base) AS first_word, max(lo) FILTER (WHERE base) AS last_word,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base), '') AS base_labels,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, coalesce(max(score), 0.0)::DOUBLE AS score
FROM doc d LEFT JOIN found m ON m.doc_id = d.doc_id
GROUP BY d.doc_id, d.w
"""
