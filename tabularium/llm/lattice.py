"""The lattice of pieces as Spark relations: the form of :mod:`.sentencepiece` without any Python in the tasks.

The distinct stretches of all texts are exploded to their substrings of bounded length; an equi-join with the piece table
leaves those that are pieces, the edges of a lattice per stretch; edges are grouped by stretch and folded by the
higher-order ``aggregate``:

* unigram vocabularies: Viterbi, one step per sign, the best sum of scores that ends there and the piece it ends with;
* BPE vocabularies: one step per merge, the neighbouring pair of the highest score whose union is an edge, the leftmost of
  equals.

The ids of a stretch are then joined back to the places where texts have it. These are as many rows as the texts have
words, moved twice: see the README for what that costs, and why the query takes the other form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sentencepiece import MARK, Pieces
from .storage import quoted

#: Substrings of a stretch of n signs: (i, k, sub), for starts i from 0 and k signs.
SUBSTRINGS = "flatten(transform(sequence(0, n - 1), i -> transform(sequence(1, least({longest}, n - i)), k -> struct(i AS i, k AS k, substring(stretch, i + 1, k) AS sub))))"
#: A fold's look-up: the score of the edge from i over k signs, missing where there is none.
SCORE = "element_at(scores, {i} * {wide} + {k})"


def merges(wide: int) -> str:
    """Starts of the symbols left by BPE, with the end of the stretch last."""
    union = SCORE.format(i="s[j]", k="(s[j + 2] - s[j])", wide=wide)
    pairs = f"filter(transform(sequence(0, size(s) - 3), j -> struct(-{union} AS cost, j AS j)), p -> p.cost IS NOT NULL)"
    joined = "concat(slice(s, 1, p.j + 1), slice(s, p.j + 3, size(s)))"
    step = f"if(size(s) < 3, s, coalesce(transform(array(array_min({pairs})), p -> if(p IS NULL, NULL, {joined}))[0], s))"
    return f"aggregate(sequence(1, n), sequence(0, n), (s, t) -> {step})"


def viterbi(wide: int, low: float) -> str:
    """Starts of the pieces of the best path, with the end of the stretch last."""
    edge = SCORE.format(i="i", k="(e - i)", wide=wide)
    # a single sign without a piece costs as an unknown one
    worth = f"coalesce({edge}, if(e - i = 1, {low}F, NULL))"
    ways = f"filter(transform(sequence(greatest(0, e - {wide}), e - 1), i -> struct(double(b[i].total + {worth}) AS total, -i AS back)), w -> w.total IS NOT NULL)"
    start = "array(struct(double(0) AS total, 0 AS back))"
    best = f"aggregate(sequence(1, n), {start}, (b, e) -> concat(b, array(array_max({ways}))))"
    walk = "aggregate(sequence(1, n), array(n), (s, t) -> if(s[0] = 0, s, concat(array(-best[s[0]].back), s)))"
    return f"transform(array({best}), best -> {walk})[0]"


def encode(docs: DataFrame, model: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and ids (array of int) of every row of ``docs``, as :func:`.sentencepiece.encode` gives them.

    A missing or empty text has no ids; rows without a key and repeated rows are encoded each; an empty table gives no rows.
    A stretch of n signs takes a fold of n steps over up to n pairs, so very long stretches are slow here.
    """
    pieces, spark = Pieces.read(model), docs.sparkSession
    wide = pieces.longest + 1
    listed = [(name, i, float(pieces.scores[i])) for name, i in pieces.ids.items()]
    kinds = T.StructType([T.StructField("sub", T.StringType()), T.StructField("id", T.IntegerType()), T.StructField("score", T.FloatType())])
    known = F.broadcast(spark.createDataFrame(listed, kinds))  # the piece table has the size of the model
    rows = docs.select(F.col(quoted(key)).alias("key"), F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(quoted(text)).cast("string"), F.lit("")).alias("text"))
    marked = F.replace("text", F.lit(" "), F.lit(MARK))
    marked = F.when(F.col("text") == "", F.lit("")).otherwise(F.concat(F.lit(MARK * pieces.prefix), marked))
    words = rows.select("row", "key", F.posexplode_outer(F.regexp_extract_all(marked, F.lit(pieces.stretch.pattern), F.lit(0))).alias("pos", "stretch"))

    distinct = words.where("stretch IS NOT NULL").select("stretch").distinct().withColumn("n", F.length("stretch"))
    subs = distinct.select("stretch", "n", F.explode(F.expr(SUBSTRINGS.format(longest=pieces.longest))).alias("s")).select("stretch", "s.*")
    edges = subs.join(known, "sub", "left").where("id IS NOT NULL OR k = 1")
    place = F.expr(f"i * {wide} + k")
    entries = F.collect_list(F.when(F.col("id").isNotNull(), F.struct(place.alias("at"), F.struct("id", "score").alias("piece"))))
    lattice = edges.groupBy("stretch").agg(entries.alias("entries")).withColumn("n", F.length("stretch"))
    lattice = lattice.select(
        "stretch", "n",
        F.expr("map_from_entries(transform(entries, e -> struct(e.at AS at, e.piece.id AS id)))").alias("ids"),
        F.expr("map_from_entries(transform(entries, e -> struct(e.at AS at, e.piece.score AS score)))").alias("scores"),
    )
    cut = lattice.withColumn("s", F.expr(viterbi(wide, float(pieces.low)) if pieces.unigram else merges(wide)))
    # signs without a piece become byte pieces
    spelt = F.array(*[F.lit(b) for b in pieces.bytes])
    one = "element_at(ids, s[j] * {wide} + s[j + 1] - s[j])".format(wide=wide)
    raw = "transform(sequence(0, octet_length(sub) - 1), b -> bytes[int(conv(substring(hex(sub), 2 * b + 1, 2), 16, 10))])"
    piece = f"transform(array(struct({one} AS id, substring(stretch, s[j] + 1, s[j + 1] - s[j]) AS sub)), p -> if(p.id IS NOT NULL, array(p.id), transform(array(encode(p.sub, 'UTF-8')), sub -> {raw})[0]))[0]"
    folded = cut.withColumn("bytes", spelt).select("stretch", F.expr(f"flatten(transform(sequence(0, size(s) - 2), j -> {piece}))").alias("ids"))
    found = words.join(folded, "stretch", "left").groupBy("row", "key").agg(F.array_sort(F.collect_list(F.struct("pos", "ids"))).alias("found"))
    ids = F.flatten(F.filter(F.col("found.ids"), lambda x: x.isNotNull()))
    return found.select(F.col("key").alias(key), ids.alias("ids"))
