"""Join patterns beyond a plain equality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.sources.payload import written


#: Members of a class, or entities that it meets, in one block: a pair of blocks gives about its square of rows, all of which
#: Spark's generated code holds until the pair is done, so they should stay in a core's cache; smaller ones shuffle more.
BLOCK = 128
#: Pairs of blocks that a task expands.
BLOCKS_A_TASK = 2048


def fuzzy_name_join(roster: DataFrame, names: DataFrame, gram: int = 3) -> DataFrame:
    """(roster_id, entity_id, ..), each pair once: names equal, or the entity's name holds the roster name's last word, ignoring case.

    `roster` (roster_id, roster_name), `names` (entity_id, name, and columns that come along). A name that equals a roster
    name holds its last word; a blank name has no word and only equals. For the substring, names are an inverted index of
    their grams of 1 to `gram` characters; a word is looked up by the one of its longest grams that fewest names hold, and
    what it finds is verified. A word of `gram` characters or fewer is its own gram, so its postings are its matches. Only
    grams that some word asks for are kept of the index, so a gram that all names share is no key unless a word has no other.

    Roster ids with the same words are a class, and only classes meet entities; the pairs come last, from blocks of members
    and blocks of entities dealt evenly to tasks, so no row of the result is shuffled and no task has a class."""
    r = roster.select("roster_id", F.lower("roster_name").alias("rn")).withColumn("needle", F.split_part(F.btrim("rn"), F.lit(" "), F.lit(-1)))
    blank = F.concat(F.lit(" "), "rn")  # a word has no space
    members = written(r.filter("needle IS NOT NULL").groupBy("roster_id").agg(F.array_sort(F.collect_set(F.when(F.col("needle") == "", blank).otherwise(F.col("needle")))).alias("class")), "parquet")
    n = names.withColumn("nm", F.lower("name")).drop("name")
    asked_of = members.select("class").distinct().select("class", F.explode("class").alias("needle"))
    words = asked_of.filter("needle NOT LIKE ' %'").select("needle").distinct()
    asked = written(words.select("needle", F.explode(_grams("needle", F.least(F.length("needle"), F.lit(gram)))).alias("g")), "parquet")
    sizes = asked.select(F.length("g").alias("k")).distinct().count()
    held = F.array_distinct(F.flatten(F.array(*(_grams("nm", F.lit(k)) for k in range(1, gram + 1))))) if sizes > 1 or gram == 1 else _grams("nm", F.lit(gram))
    postings = n.withColumn("g", F.explode(held)).join(asked.select("g").distinct(), "g", "left_semi")
    frequency = postings.groupBy("g").agg(F.count("*").alias("df"))
    rarest = asked.join(frequency, "g", "left").groupBy("needle").agg(F.min_by("g", F.struct(F.coalesce("df", F.lit(0)), "g")).alias("g"))
    found = rarest.join(postings, "g").filter(F.contains("nm", "needle")).drop("g", "nm")
    equal = asked_of.filter("needle LIKE ' %'").select("needle").distinct().join(n, F.col("needle") == F.concat(F.lit(" "), "nm")).drop("nm")
    met = written(asked_of.join(found.unionByName(equal), "needle").drop("needle").distinct(), "parquet")
    return _expanded(members, met)


def _expanded(members: DataFrame, met: DataFrame) -> DataFrame:
    """`members` (roster_id, class) with each row of `met` (class, ..) of their class."""
    pairs = _block_pairs(members, met)
    return pairs.select("_e", F.explode("_m").alias("m")).select("m.roster_id", F.explode("_e").alias("e")).select("roster_id", "e.*")


def _block_pairs(members: DataFrame, met: DataFrame) -> DataFrame:
    """(_m, _e): each block of a class's members beside each block of what the class meets, dealt evenly."""
    count = lambda df, c: df.groupBy("class").agg(F.count("*").alias(c))
    sizes = written(count(members, "n_members").join(count(met, "n_met"), "class"), "parquet")
    blocks = F.ceil(F.col("n_members") / BLOCK) * F.ceil(F.col("n_met") / BLOCK)
    n = sizes.agg(F.coalesce(F.sum(blocks), F.lit(0)).alias("n")).first().n
    parts = max(int(met.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(n) // BLOCKS_A_TASK))

    def blocked(df: DataFrame, item: Column, out: str, size: str) -> DataFrame:
        block = F.pmod(F.xxhash64(item), F.ceil(F.col(size) / BLOCK))
        return df.join(sizes, "class").groupBy("class", block.alias("_b")).agg(F.collect_list(item).alias(out)).drop("_b")

    rest = [c for c in met.columns if c != "class"]
    return blocked(members, F.struct("roster_id"), "_m", "n_members").join(blocked(met, F.struct(*rest), "_e", "n_met"), "class").drop("class").repartition(parts)


def _grams(text: str, size: Column) -> Column:
    """Distinct grams of `size` characters; none of a shorter text."""
    whole = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1))), lambda i: F.substring(F.col(text), i, size))
    return F.array_distinct(F.filter(whole, lambda g: F.length(g) == size))


def next_period(rows: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Each row beside the same key's row of the next period."""
    after = rows.select(*keys, (F.col("period") - 1).alias("period"), *(F.col(c).alias(f"next_{c}") for c in cols))
    return rows.select(*keys, "period", *cols).join(after, [*keys, "period"])


def attach(rows: DataFrame, table: DataFrame, on: list[str], cols: list[str], how: str = "inner") -> DataFrame:
    """`rows` with `cols` of `table`."""
    return rows.join(table.select(*on, *cols), on, how)


def without_match(rows: DataFrame, known: DataFrame, key: str, known_key: str) -> DataFrame:
    """Rows whose key `known` lacks; a null key has no match."""
    return rows.join(known.select(F.col(known_key).alias("_known")), F.col(key) == F.col("_known"), "left_anti")


def of_largest(rows: DataFrame, weight: str, key: str = "entity_id", k: int = 1) -> DataFrame:
    """Rows of the k keys with the largest sum of `weight`."""
    top = rows.groupBy(key).agg(F.sum(weight).alias("_w")).orderBy(F.desc("_w"), key).limit(k).select(key)
    return rows.join(F.broadcast(top), key, "left_semi")  # k rows


def side_by_side(left: DataFrame, right: DataFrame, value: str, names: tuple[str, str], key: str = "entity_id") -> DataFrame:
    """Every key of either table with both values."""
    return left.select(key, F.col(value).alias(names[0])).join(right.select(key, F.col(value).alias(names[1])), key, "full")


def pick_list(wanted: list[int], have: DataFrame, key: str = "entity_id") -> DataFrame:
    """(wanted, found) for each id of a user's list."""
    asked = have.sparkSession.createDataFrame([(i,) for i in wanted], "wanted long")
    got = have.join(F.broadcast(asked), F.col(key) == F.col("wanted"), "left_semi").select(key).distinct()  # as many as asked
    return asked.join(got, F.col("wanted") == F.col(key), "left").select("wanted", F.col(key).isNotNull().alias("found"))


def ids_of(*columns: tuple[DataFrame, str]) -> list[DataFrame]:
    return [df.select(F.col(c).cast("long").alias("id")) for df, c in columns]


def union_ids(*columns: tuple[DataFrame, str]) -> DataFrame:
    first, *rest = ids_of(*columns)
    for df in rest:
        first = first.union(df)
    return first.distinct()


def difference_ids(left: tuple[DataFrame, str], right: tuple[DataFrame, str]) -> DataFrame:
    a, b = ids_of(left, right)
    return a.subtract(b)


def common_ids(left: tuple[DataFrame, str], right: tuple[DataFrame, str]) -> DataFrame:
    a, b = ids_of(left, right)
    return a.intersect(b)
