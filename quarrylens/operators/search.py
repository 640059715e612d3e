"""Substring search over names by an inverted index of their three-character pieces (grams).

The index is written once, in folders by a hash of the gram: posting lists (gram, n, ids), where a frequent gram has
many lists of about LIST ids each, and a dictionary (gram, n, shard). Names are folded to lower case and end with two marks, so that a
query of one or two characters is a prefix of grams. A batch of queries takes from the dictionary the MEET rarest grams of
each query, intersects their lists, and looks at the names that are left.

Equal names are one in the index, by their least id. What is found goes from name to ids as lists, which are multiplied out in
the last step: rows of the result are not shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SIZE, MEET = 3, 2
LIST = 8_192
SHARDS = 16
#: Queries of one name that are multiplied out together, on average at most.
ASKED = 1_024
END = "\x01"


def fold(c) -> Column:
    return F.lower(c)


def grams(text: Column) -> Column:
    """Distinct grams of a text of SIZE or more characters."""
    n = F.char_length(text)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), n - (SIZE - 1)), lambda i: F.substring(text, i, F.lit(SIZE))))


def postings(names: DataFrame, list_size: int = LIST) -> DataFrame:
    """gram, n (names that hold it), ids (a part of them). names: id, name."""
    each = names.filter("name <> ''").select("id", F.explode(grams(F.concat(fold("name"), F.lit(END * 2)))).alias("gram"))
    sizes = each.groupBy("gram").agg(F.count("*").alias("n"))
    split = each.join(sizes, "gram").withColumn("part", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / list_size)).cast("int"))
    return split.groupBy("gram", "part").agg(F.first("n").alias("n"), F.array_sort(F.collect_list("id")).alias("ids")).drop("part")


def distinct_names(names: DataFrame) -> DataFrame:
    """id (the least), name, n (ids) of each name that can be found."""
    return names.filter("name <> ''").groupBy("name").agg(F.min("id").alias("id"), F.count("*").alias("n")).select("id", "name", "n")


def build(names: DataFrame, path: str, list_size: int = LIST, shards: int = SHARDS) -> None:
    """Write the index of names (id, name) under the path; ids are any one type, each names one row."""
    names = distinct_names(names)
    shard = F.pmod(F.xxhash64("gram"), F.lit(shards)).cast("int")
    postings(names, list_size).withColumn("shard", shard).repartition("shard", F.xxhash64("gram", F.element_at("ids", 1))).write.mode("overwrite").partitionBy("shard").parquet(f"{path}/lists")
    _lists(names, path).select("gram", "n", "shard").distinct().write.mode("overwrite").parquet(f"{path}/dictionary")


def _lists(names: DataFrame, path: str) -> DataFrame:
    """The written lists; without names there are no folders to take a schema from."""
    return names.sparkSession.read.schema(f"gram string, n long, ids array<{names.schema['id'].dataType.simpleString()}>, shard int").parquet(f"{path}/lists")


def chosen(queries: DataFrame, dictionary: DataFrame, meet: int = MEET) -> DataFrame:
    """query, folded, gram, shard, need: the rarest grams of long queries (all `need` must hold), every gram that a short one begins (one must)."""
    q = queries.select("query").filter("query <> ''").distinct().withColumn("folded", fold("query"))
    long_ = q.filter(F.char_length("folded") >= SIZE).withColumn("gram", F.explode(grams(F.col("folded"))))
    known = long_.join(dictionary, "gram", "left")  # a gram that no name holds is the rarest
    rare = Window.partitionBy("query").orderBy(F.coalesce("n", F.lit(0)), "gram")
    first = known.withColumn("r", F.row_number().over(rare)).filter(F.col("r") <= meet)
    need = F.least(F.size(grams(F.col("folded"))), F.lit(meet))
    out = first.select("query", "folded", "gram", "shard", need.alias("need"))
    for size in range(1, SIZE):
        heads = dictionary.select(F.substring("gram", 1, size).alias("folded"), "gram", "shard")
        out = out.unionByName(q.filter(F.char_length("folded") == size).join(heads, "folded").select("query", "folded", "gram", "shard", F.lit(1).alias("need")))
    return out


def lookup(spark: SparkSession, path: str, queries: DataFrame, names: DataFrame, meet: int = MEET) -> DataFrame:
    """(query, id, name) of all names that hold a query, in any case. queries: query; names: those the index was built of.

    An empty query holds in every name and is not looked up here; null queries and names find nothing.
    """
    lists, dictionary = _lists(names, path), spark.read.parquet(f"{path}/dictionary")
    hits = chosen(queries, dictionary, meet).join(lists.select("shard", "gram", "ids"), ["shard", "gram"]).select("query", "folded", "need", F.explode("ids").alias("id"))
    met = hits.groupBy("query", "id").agg(F.count("*").alias("c"), F.first("folded").alias("folded"), F.first("need").alias("need")).filter(F.col("c") >= F.col("need"))
    once = distinct_names(names)
    found = met.join(once, "id").filter(F.contains(fold("name"), F.col("folded"))).select("query", "name")
    some = max(1, -(-queries.distinct().count() // ASKED))
    asked = found.groupBy("name", F.pmod(F.xxhash64("query"), F.lit(some)).alias("q")).agg(F.collect_list("query").alias("queries"))
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / LIST)).alias("part")
    ids = names.select("id", "name").join(once.select("name", "n"), "name").groupBy("name", part).agg(F.collect_list("id").alias("ids"))
    # a frequent name has many lists, which are dealt to tasks of their own; a number, as few bytes become many rows
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lists = asked.join(ids, "name").repartition(parts, "name", "part", "q")
    return lists.select("name", "ids", F.explode("queries").alias("query")).select("query", F.explode("ids").alias("id"), "name")
