"""Personal data: base patterns, and more of it found by bootstrapped context patterns; DataFrame functions only."""

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from driftpool.llm.bounds import measured
from driftpool.session import staged

KINDS = ("email", "ip", "card", "phone")
# the base patterns; the look-behinds and possessive repeats find the same leftmost matches in linear time
LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # what may be an identifier: a word between white space with a digit or an at sign, plain or spelled in brackets
    "word": r"(?<!\S)(?:[^\s0-9@(\[]|[(\[](?!at[)\]]))*+(?:[0-9@]|[(\[]at[)\]])\S*+",
    # and digits in groups
    "run": r"(?<![\w.+(-])[+(]{0,2}[0-9]++(?:[\x20().-]{1,2}[0-9]++)++",
}
PART = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]?)?"     # of what is all digits
# what a discovered identifier of a kind has to look like
SHAPES = {
    "email": r"^[^\s@]+(?:@|\(at\)|\[at\])[^\s@]+$",
    "ip": r"^[0-9A-Fa-f]+(?:[.:][0-9A-Fa-f]*){2,7}$",
    "card": r"^(?:[0-9][ -]?){12,19}$",
    "phone": r"^\+?\(?[0-9](?:[().-]*[0-9]|[ ().-]{1,2}[0-9]){6,14}$",
}
ROUNDS = 3
MIN_DIGITS = 7      # of a run with spaces
NEIGHBOURS = 4      # matches of a kind that a context may reach over
MIN_SEEDS = 5
CONFIDENCE = 0.8


def _occurrences(text, kind):
    """Expressions (matches, their records): gap before, match, context on both sides."""
    pattern = F.lit(PATTERNS[kind])
    mark = {"email": "@", "phone": "+"}.get(kind)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    if mark:
        found = F.when(F.instr(text, mark) > 0, found)
    return found


def _records(kind):
    m, g = f"m_{kind}", f"g_{kind}"
    before = ", ".join(f"right(get({g}, k - {i}), 48)" for i in range(NEIGHBOURS, -1, -1))
    after = ", ".join(f"left(get({g}, k + {i}), 24)" for i in range(1, NEIGHBOURS + 2))
    return F.expr(f"""transform(sequence(0, size({m}) - 1), k -> named_struct(
        'kind', '{kind}', 'k', k, 'gap', length({g}[k]), 'value', {m}[k],
        'left', right(concat_ws(' ', {before}), 48), 'right', left(concat_ws(' ', {after}), 24)))""")


def occurrences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Staged rows (row, id, mark, kind, start, end, value, left, right), one with null kind for every document.

    Offsets are code points, end exclusive. A null text is empty. Contexts reach over matches of the same kind.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), text.alias("text"))
    rows = rows.select("row", "id", F.xxhash64("text").alias("mark"), "text",
                       *[_occurrences(F.col("text"), k).alias(f"m_{k}") for k in PATTERNS])
    rows = rows.select("row", "id", "mark", *[f"m_{k}" for k in PATTERNS],
                       *[F.when(F.size(f"m_{k}") > 0, F.split("text", PATTERNS[k], -1)).alias(f"g_{k}")
                         for k in PATTERNS])
    empty = "cast(array() as array<struct<kind:string,k:int,gap:int,value:string,left:string,right:string>>)"
    lists = [F.when(F.size(f"m_{k}") > 0, _records(k)).otherwise(F.expr(empty)) for k in PATTERNS]
    flat = rows.select("row", "id", "mark", F.explode_outer(F.concat(*lists)).alias("x"))
    flat = staged(flat.select("row", "id", "mark", "x.*"))
    before = Window.partitionBy("row", "kind").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("value")).over(before)
    marks = flat.select("row", "id", "mark").distinct().select("row", "id", "mark", *[
        F.lit(None).cast(t).alias(n) for n, t in (("kind", "string"), ("start", "long"), ("end", "long"),
                                                  ("value", "string"), ("left", "string"), ("right", "string"))])
    placed = flat.filter("kind IS NOT NULL").withColumn("end", end)
    return marks.unionAll(placed.select("row", "id", "mark", "kind", (F.col("end") - F.length("value")).alias("start"),
                                        "end", "value", "left", "right"))


def _valid():
    digits = F.regexp_replace("value", "[^0-9]", "")
    luhn = F.expr("""aggregate(sequence(1, length(digits)), 0, (total, i) -> total + CASE
        WHEN i % 2 = 1 THEN ascii(substring(digits, -i, 1)) - 48
        WHEN ascii(substring(digits, -i, 1)) - 48 < 5 THEN 2 * (ascii(substring(digits, -i, 1)) - 48)
        ELSE 2 * (ascii(substring(digits, -i, 1)) - 48) - 9 END) % 10 = 0""")
    ip = F.col("value").rlike(rf"^{PART}\.{PART}\.{PART}\.{PART}$")
    size = F.length("digits")
    return digits, (F.when(F.col("kind") == "email", True).when(F.col("kind") == "ip", ip)
                    .when((F.col("kind") == "card") & size.between(16, 19), luhn)
                    .when(F.col("kind") == "phone", size.between(8, 15)).otherwise(False))


def base(placed: DataFrame) -> DataFrame:
    """The occurrences of the four kinds that hold."""
    digits, valid = _valid()
    return placed.filter(F.col("kind").isin(*KINDS)).withColumn("digits", digits).filter(valid).drop("digits")


def candidates(placed: DataFrame, found: DataFrame) -> DataFrame:
    """Identifier-like words, bared of punctuation around them, and runs of digit groups with spaces.

    None touches a base span of its document; a word inside such a run is no candidate of its own.
    """
    rest = placed.filter("kind IN ('word', 'run')")
    word = F.col("kind") == "word"
    lead = F.when(word, F.length(F.regexp_extract("value", r"^[\"'(\[{<,;:=]*+", 0))).otherwise(0)
    bare = F.when(word, F.regexp_extract("value", r"^[\"'(\[{<,;:=]*+(.*?)[\"')\]}>.,;:!?]*$", 1)).otherwise(F.col("value"))
    rest = rest.select("row", "id", "mark", "kind", (F.col("start") + lead).alias("start"), bare.alias("value"),
                       "left", "right")
    digits = F.length(F.regexp_replace("value", "[^0-9]", ""))
    rest = rest.withColumn("end", F.col("start") + F.length("value")).filter(F.length("value").between(6, 64)).filter(
        word | ((F.instr("value", " ") > 0) & (digits >= MIN_DIGITS)))
    both = rest.select("row", "id", "mark", "kind", "start", "end", "value", "left", "right").unionAll(
        found.select("row", "id", "mark", "kind", "start", "end", "value", "left", "right"))
    order = Window.partitionBy("row").orderBy("start", F.desc("end"), "kind")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    is_base = F.col("kind").isin(*KINDS)
    ended = F.max(F.when(is_base, F.col("end"))).over(before)
    begins = F.min(F.when(is_base, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    both = both.withColumn("ended", ended).withColumn("begins", begins)
    free = both.filter(~is_base).filter("coalesce(ended, 0) <= start AND coalesce(begins, end) >= end")
    free = free.withColumn("ended", F.max(F.when(F.col("kind") == "run", F.col("end"))).over(before))
    return free.filter("kind = 'run' OR coalesce(ended, 0) <= start").drop("ended", "begins").withColumn(
        "kind", F.lit("word"))


def _patterns(rows):
    """One row for each lexical pattern around an occurrence: word before, two words before, words on both sides.

    Words with a digit or an at sign are neighbouring identifiers and no part of a pattern.
    """
    lexical = lambda c: F.filter(c, lambda t: ~t.rlike("[0-9@]"))
    left = lexical(F.split(F.lower(F.trim(F.regexp_replace("left", r"[\s\"'(\[{<]+", " "))), " "))
    right = F.get(lexical(F.split(F.lower(F.trim(F.regexp_replace("right", r"[\s\"')\]}>.,;!?]+", " "))), " ")), F.lit(0))
    rows = rows.withColumn("l", left).withColumn("r", right)
    one, two = (F.get("l", F.size("l") - 1), F.get("l", F.size("l") - 2))
    shapes = F.array(F.concat(F.lit("1 "), one), F.concat(F.lit("2 "), two, F.lit(" "), one),
                     F.concat(F.lit("3 "), one, F.lit(" _ "), F.col("r")))
    return (rows.withColumn("pattern", F.explode(F.filter(shapes, lambda s: s.isNotNull())))
            .filter(one != "").drop("l", "r"))


def discovered(found: DataFrame, words: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS,
               confidence: float = CONFIDENCE) -> DataFrame:
    """Candidates (row, id, mark, kind, start, end) that confident patterns of a kind point to.

    Base spans are the seeds of their kind. A pattern's score for a kind is the summed score of the distinct
    identifiers of that kind it stands by, over the number of all distinct identifiers it stands by; it counts
    from ``min_seeds`` identifiers and ``confidence`` on. A candidate takes the best kind that its shape allows,
    with 1 - (1 - s1)(1 - s2)... over its patterns. Each of the ``rounds`` scores patterns and then identifiers.
    """
    shaped = reduce(lambda c, k: c.when(F.col("seed") == k, F.col("value").rlike(SHAPES[k])), KINDS[1:],
                    F.when(F.col("seed") == KINDS[0], F.col("value").rlike(SHAPES[KINDS[0]])))
    seeds = found.select("kind", "value", "left", "right")
    graph = staged(_patterns(seeds.unionAll(words.select("kind", "value", "left", "right")))
                   .groupBy("pattern", "kind", "value").agg(F.count("*").alias("n")))
    graph = graph.select("pattern", "kind", "value")
    totals = staged(graph.groupBy("pattern").agg(F.count("*").alias("total")))
    open_ = graph.filter("kind = 'word'").select("pattern", "value")
    instances = graph.filter("kind != 'word'").select("pattern", F.col("kind").alias("seed"), F.lit(1.0).alias("score"))
    scores = None
    for _ in range(rounds):
        sums = instances.groupBy("pattern", "seed").agg(F.sum("score").alias("score"), F.count("*").alias("n"))
        sure = (sums.filter(F.col("n") >= min_seeds).join(totals, "pattern")
                .select("pattern", "seed", F.least(F.col("score") / F.col("total"), F.lit(0.999)).alias("trust"))
                .filter(F.col("trust") >= confidence))
        sure = measured(sure)
        scores = staged(open_.join(sure, "pattern").filter(shaped).groupBy("value", "seed").agg(
            (1 - F.exp(F.sum(F.log(1 - F.col("trust"))))).alias("score")))
        more = open_.join(scores, "value").select("pattern", "seed", "score")
        instances = staged(graph.filter("kind != 'word'")
                           .select("pattern", F.col("kind").alias("seed"), F.lit(1.0).alias("score")).unionAll(more))
    hits = _patterns(words).join(sure, "pattern").filter(shaped)
    best = hits.join(scores, ["value", "seed"]).groupBy("row", "id", "mark", "start", "end").agg(
        F.max_by("seed", F.struct("score", "seed")).alias("kind"))
    return best.select("row", "id", "mark", "kind", "start", "end")


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS,
          min_seeds: int = MIN_SEEDS, confidence: float = CONFIDENCE) -> DataFrame:
    """Staged (row, id, mark, kind, start, end, is_base), one row with null kind for every document row.

    ``row`` numbers the document rows, so repeated rows and repeated or null ids stay apart; ``mark`` is a hash of
    the text. Null and empty texts have no spans.
    """
    placed = staged(occurrences(docs, id_col, text_col))
    found = staged(base(placed))
    words = staged(candidates(placed, found))
    more = discovered(found, words, rounds, min_seeds, confidence)
    marks = placed.filter("kind IS NULL").select("row", "id", "mark", "kind", "start", "end", F.lit(True).alias("is_base"))
    return staged(marks.unionAll(found.select("row", "id", "mark", "kind", "start", "end", F.lit(True)))
                  .unionAll(more.select("row", "id", "mark", "kind", "start", "end", F.lit(False))))


def _joined(condition):
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    rows = F.collect_list(F.when(condition, F.struct(order.alias("o"), "start", "end", "kind")))
    return F.array_join(F.transform(F.array_sort(rows), lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def summary(found: DataFrame) -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base, spans) of every document row; counts and ``base`` of base spans."""
    counts = [F.sum(F.when(F.col("is_base") & (F.col("kind") == k), 1).otherwise(0)).alias(f"n_{k}") for k in KINDS]
    return found.groupBy("row", "id").agg(
        *counts, _joined(F.col("is_base") & F.col("kind").isNotNull()).alias("base"),
        _joined(F.col("kind").isNotNull()).alias("spans")).drop("row")


def redacted(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; spans that overlap become one."""
    one = found.filter("kind IS NOT NULL").groupBy("id", "mark").agg(F.min("row").alias("row"))
    one = one.select(F.col("id").alias("i"), F.col("mark").alias("m"), F.col("row").alias("r"))
    own = found.filter("kind IS NOT NULL").join(one, F.col("row") == F.col("r"), "left_semi")
    order = Window.partitionBy("row").orderBy("start", F.desc("end"), "kind")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("apart", (F.col("start") >= F.coalesce(F.max("end").over(before), F.lit(0))).cast("int"))
    own = own.withColumn("island", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    own = own.groupBy("row", "id", "mark", "island").agg(
        F.min("start").alias("start"), F.max("end").alias("end"),
        F.min_by("kind", F.struct("start", -F.col("end"), "kind")).alias("kind"))
    own = own.withColumn("from", F.coalesce(F.lag("end").over(Window.partitionBy("row").orderBy("start")), F.lit(0)))
    lists = own.groupBy(F.col("id").alias("i"), F.col("mark").alias("m")).agg(
        F.array_sort(F.collect_list(F.struct("start", "end", "from", "kind"))).alias("found"))
    names = {c.lower() for c in docs.columns}
    prefix = "p"
    while any(f"{prefix}_{n}" in names for n in ("i", "m", "found")):
        prefix += "p"
    lists = measured(lists.select(*[F.col(n).alias(f"{prefix}_{n}") for n in ("i", "m", "found")]))
    i, m, spans_ = (F.col(f"{prefix}_{n}") for n in ("i", "m", "found"))
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    met = docs.join(lists, F.col(f"`{id_col}`").eqNullSafe(i) & (F.xxhash64(text) == m), "left")
    pieces = F.transform(spans_, lambda s: F.concat(
        F.substring(text, s["from"].cast("int") + 1, (s["start"] - s["from"]).cast("int")), F.lit("<"),
        F.upper(s["kind"]), F.lit(">")))
    clean = F.concat(F.array_join(pieces, ""), F.substring(text, F.element_at(spans_, -1)["end"].cast("int") + 1,
                                                           F.lit(2147483647)))
    new = F.when(spans_.isNotNull(), clean).otherwise(F.col(f"`{text_col}`"))
    change = F.aggregate(spans_, F.lit(0).cast("bigint"),
                         lambda n, s: n + F.length(s["kind"]) + 2 - (s["end"] - s["start"]))
    columns = {text_col: new}
    if length_col in docs.columns:
        kind = docs.schema[length_col].dataType
        columns[length_col] = F.when(spans_.isNotNull(), (F.length(text) + change).cast(kind)).otherwise(F.col(f"`{length_col}`"))
    return met.select(*[columns.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])
