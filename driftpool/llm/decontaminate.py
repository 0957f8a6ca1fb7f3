"""Benchmark decontamination over a distributed positional inverted index; DataFrame functions only."""

from pyspark.sql import DataFrame, Window, functions as F

from driftpool.llm.bounds import measured
from driftpool.session import staged

WINDOW = 10
# what separates words; A-Z are lower-cased after the cut, which gives the same words
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lowered(word):
    # lower() is exact for plain ASCII; elsewhere only A-Z may change
    plain = F.octet_length(word) == F.length(word)
    return F.when(plain, F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def words(df: DataFrame, text_col: str, *keep: str) -> DataFrame:
    """(keep..., n_words, pos, word): one row a word, and one with null pos for each row of ``df``.

    Null and empty texts have no words and one row.
    """
    cut = F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), SEPARATORS)
    rows = df.select(*keep, cut.alias("cut"))
    first, last = F.element_at("cut", 1) == "", F.element_at("cut", -1) == ""
    rows = rows.select(*keep, "cut", first.cast("int").alias("skip"),
                       F.when((F.size("cut") == 1) & first, 0)
                       .otherwise(F.size("cut") - first.cast("int") - last.cast("int")).alias("n_words"))
    # the empty string put behind is the row of the text itself
    rows = rows.select(*keep, "skip", "n_words", F.size("cut").alias("end"),
                       F.posexplode(F.concat("cut", F.array(F.lit("")))).alias("at", "raw"))
    rows = rows.filter((F.col("raw") != "") | (F.col("at") == F.col("end")))
    return rows.select(*keep, "n_words", F.when(F.col("at") < F.col("end"), F.col("at") - F.col("skip")).alias("pos"),
                       _lowered(F.col("raw")).alias("word"))


class Index:
    """Postings of the test terms.

    ``postings``: (id, mark, n_words, pos, tid), a row with null tid for every document. ``mark`` is a hash of the
    text that tells rows of one id apart. ``terms``: (item, item_id, n, j, tid, seen) for every word of every item,
    ``seen`` counts the postings of the term in all documents.
    """

    def __init__(self, postings, terms, window):
        self.postings, self.terms, self.window = postings, terms, window

    @property
    def documents(self):
        return self.postings.filter("tid IS NULL").select("id", "mark", "n_words")


def build(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> Index:
    """Read the documents once and keep where the words of the items stand in them."""
    listed = staged(items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")))
    numbered = staged(listed.withColumn("item", F.monotonically_increasing_id()))
    spread = staged(words(numbered, "text", "item", "item_id").filter("pos IS NOT NULL")
                    .select("item", "item_id", F.col("n_words").alias("n"), F.col("pos").alias("j"), "word"))
    known = measured(spread.select("word").distinct().withColumn("tid", F.monotonically_increasing_id()))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("mark", F.xxhash64("text"))
    found = words(rows, "text", "id", "mark").join(known, "word", "left")
    postings = staged(found.filter("tid IS NOT NULL OR pos IS NULL").select(
        "id", "mark", "n_words", "pos", F.when(F.col("pos").isNotNull(), F.col("tid")).alias("tid")))
    seen = postings.filter("tid IS NOT NULL").groupBy("tid").agg(F.count("*").alias("seen"))
    terms = staged(spread.join(known, "word").join(measured(seen), "tid", "left")
                   .select("item", "item_id", "n", "j", "tid", F.coalesce("seen", F.lit(0)).alias("seen")))
    return Index(postings, terms, window)


def anchors(index: Index) -> DataFrame:
    """(item, j, tid, low, high): for every window its rarest word, first of equals, and what its windows span.

    A window with a word that no document has cannot occur and is left out. Items shorter than a window are one
    window.
    """
    ahead = Window.partitionBy("item").orderBy("j").rowsBetween(0, index.window - 1)
    rows = index.terms.withColumn("rare", F.min(F.struct("seen", "j", "tid")).over(ahead))
    rows = rows.filter(F.col("j") <= F.greatest(F.col("n") - index.window, F.lit(0))).filter("rare.seen > 0")
    return rows.groupBy("item", F.col("rare.j").alias("a"), F.col("rare.tid").alias("tid")).agg(
        F.min("j").alias("low"), F.least(F.max(F.col("j") + index.window), F.max("n")).alias("high"))


def aligned(index: Index, slop: int = 0) -> DataFrame:
    """(id, mark, item, shift, j, pos): item words found at their place beside a posting of a rarest word.

    ``shift`` is the offset between document and item. From the lists of the rarest words it goes on to the lists of
    the other words of their windows, in documents that are still possible. With ``slop`` a word may stand that many
    places off.
    """
    rare = measured(anchors(index))
    start = staged(index.postings.filter("tid IS NOT NULL").join(rare, "tid").select(
        "id", "mark", "item", "a", "low", "high", (F.col("pos") - F.col("a")).alias("shift")))
    expected = index.terms.select("item", "j", F.col("tid").alias("want"))
    possible = measured(start.select("id", "mark").distinct())
    left = index.postings.filter("tid IS NOT NULL").join(
        possible.select(F.col("id").alias("i"), F.col("mark").alias("m")),
        F.col("id").eqNullSafe(F.col("i")) & (F.col("mark") == F.col("m")), "left_semi")
    wanted = (start.join(measured(expected), "item").filter("j >= low AND j < high")
              .select("id", "mark", "item", "shift", "j", "want").distinct())
    if slop:
        wanted = wanted.withColumn("off", F.explode(F.sequence(F.lit(-slop), F.lit(slop))))
    else:
        wanted = wanted.withColumn("off", F.lit(0))
    wanted = wanted.withColumn("at", F.col("shift") + F.col("j") + F.col("off"))
    # postings take few bytes in files and many as rows: their size must not decide on a broadcast
    lists = left.select(F.col("id").alias("i"), F.col("mark").alias("m"), "pos", "tid").hint("merge")
    return wanted.join(lists, F.col("id").eqNullSafe(F.col("i")) & (F.col("mark") == F.col("m"))
                       & (F.col("at") == F.col("pos")) & (F.col("want") == F.col("tid"))).select(
        "id", "mark", "item", "shift", "j", "pos").distinct()


def phrases(index: Index) -> DataFrame:
    """(id, mark, item, item_id, first, last): runs of document words in which every window is one of the item."""
    order = Window.partitionBy("id", "mark", "item", "shift").orderBy("j")
    runs = (aligned(index).withColumn("run", F.col("j") - F.row_number().over(order))
            .groupBy("id", "mark", "item", "shift", "run").agg(F.min("pos").alias("first"), F.max("pos").alias("last")))
    names = measured(index.terms.select("item", "item_id", "n").distinct())
    return (runs.join(names, "item").filter(F.col("last") - F.col("first") + 1 >= F.least("n", F.lit(index.window)))
            .select("id", "mark", "item", "item_id", "first", "last"))


def near(index: Index, slop: int = 3, share: float = 0.8) -> DataFrame:
    """(id, mark, item, item_id, words): items of which so large a share of the words stands near its place.

    A place is ``shift`` + j for one shift of the whole item, near it is within ``slop``. Where the share is met, one
    of any n - share * n + 1 words of the item is: lists of the rarest ones, as many as that, give the shifts.
    """
    names = measured(index.terms.select("item", "item_id", "n").distinct())
    rarest = Window.partitionBy("item").orderBy("seen", "j")
    many = F.col("n") - F.ceil(F.col("n") * share - 1e-9) + 1
    rare = measured(index.terms.withColumn("rank", F.row_number().over(rarest)).filter(F.col("rank") <= many)
                    .filter("seen > 0").select("item", F.col("j").alias("a"), "tid"))
    lists = index.postings.filter("tid IS NOT NULL").select("id", "mark", "pos", "tid")
    offs = F.explode(F.sequence(F.lit(-slop), F.lit(slop)))
    start = staged(lists.join(rare, "tid").select("id", "mark", "item", (F.col("pos") - F.col("a")).alias("s"),
                                                  offs.alias("off"))
                   .select("id", "mark", "item", (F.col("s") + F.col("off")).alias("shift")).distinct())
    expected = measured(index.terms.select("item", "j", F.col("tid").alias("want")))
    wanted = start.join(expected, "item").select("*", offs.alias("off")).withColumn(
        "at", F.col("shift") + F.col("j") + F.col("off"))
    left = lists.select(F.col("id").alias("i"), F.col("mark").alias("m"), "pos", "tid")
    counts = wanted.join(left, F.col("id").eqNullSafe(F.col("i")) & (F.col("mark") == F.col("m"))
                         & (F.col("at") == F.col("pos")) & (F.col("want") == F.col("tid"))).groupBy(
        "id", "mark", "item", "shift").agg(F.countDistinct("j").alias("words"))
    best = counts.groupBy("id", "mark", "item").agg(F.max("words").alias("words"))
    return best.join(names, "item").filter(F.col("words") >= share * F.col("n")).select(
        "id", "mark", "item", "item_id", "words")


def audited(index: Index) -> DataFrame:
    """(id, mark, n_words, n_hit, items) of every document row; items: ids with an occurring window, sorted as strings.

    Null and empty texts have no words and no hits. Repeated document rows are each returned; repeated items count
    once by their id. A null item id is not listed, its words are hit all the same.
    """
    found = staged(phrases(index).select("id", "mark", "item_id", "first", "last").distinct())
    hit = (found.select("id", "mark", F.explode(F.sequence("first", "last")).alias("pos")).distinct()
           .groupBy("id", "mark").agg(F.count("*").alias("n_hit")))
    listed = found.groupBy("id", "mark").agg(
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    both = hit.join(listed, hit["id"].eqNullSafe(listed["id"]) & (hit["mark"] == listed["mark"])).select(
        hit["id"].alias("i"), hit["mark"].alias("m"), "n_hit", "items")
    return index.documents.join(both, F.col("id").eqNullSafe(F.col("i")) & (F.col("mark") == F.col("m")), "left").select(
        "id", "mark", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def cleaned(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` in which no window of an item occurs, all columns."""
    found = phrases(build(docs, items, id_col, text_col, **settings)).select("id", "mark").distinct()
    names = {c.lower() for c in docs.columns}
    prefix = "k"
    while f"{prefix}_id" in names or f"{prefix}_mark" in names:
        prefix += "k"
    gone = measured(found.select(F.col("id").alias(f"{prefix}_id"), F.col("mark").alias(f"{prefix}_mark")))
    return docs.join(gone, F.col(f"`{id_col}`").eqNullSafe(F.col(f"{prefix}_id"))
                     & (F.xxhash64(F.col(f"`{text_col}`").cast("string")) == F.col(f"{prefix}_mark")), "left_anti")
