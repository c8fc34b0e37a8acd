"""Spelling variants grouped around their common forms, found by pivotal bigrams.

Bigrams have one global order, rare ones first. The prefix of a word are its first three bigrams in that order, and all
that equal the third. Three bigrams hold two that don't overlap; of such pairs in the prefix dynamic programming picks the
one that is rarest in sum: the word's pivots. One edit changes at most one of two disjoint bigrams, and moves the other by
one place at most, as many as the lengths differ by. So of two words one edit apart, the one whose prefix ends first in the order has
a pivot in the other's prefix, at a place and in a length that can be listed beforehand: both become part of
the join key. Distances of all that meet are then computed.
"""

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize

EVERY = 199  # one in so many runs loses a letter
LEAST_LENGTH = 6
LEAST_COUNT = 5
FACTOR = 5
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PREFIX = 3  # bigrams that one edit can change, and one more
LETTERS = 26 + 64  # a-z and U+00C0-U+00FF: capitals among the latter stay


def runs_of(docs: DataFrame) -> DataFrame:
    """All words of at least LEAST_LENGTH code points, one row per occurrence."""
    pattern = f"[A-Za-zÀ-ÿ]{{{LEAST_LENGTH},}}"  # shorter runs give no word
    run = F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("run")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), run).select("id", F.translate("run", UPPER, UPPER.lower()).alias("run"))
    hashed = rows.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    place = F.pmod(F.col("h"), F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), place), F.substring("run", place + 2, F.length("run")))
    return hashed.select(F.when(F.col("h") % EVERY == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= LEAST_LENGTH)


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): all words that occur LEAST_COUNT times or more."""
    return runs_of(docs).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _letter(c: Column) -> Column:
    code = F.ascii(c)
    return F.when(code >= 0xC0, code - 0xC0 + 26).otherwise(code - ord("a"))


def _codes(word: Column) -> Column:
    """The bigrams of a word as numbers below LETTERS ** 2."""
    return F.transform(
        F.sequence(F.lit(1), F.length(word) - 1),
        lambda i: _letter(F.substring(word, i, F.lit(1))) * LETTERS + _letter(F.substring(word, i + 1, F.lit(1))),
    )


def signatures(words: DataFrame) -> DataFrame:
    """word, n, len, last, prefix and pivots: arrays of (gram, pos), grams as ranks in the global order."""
    coded = words.select("word", "n", F.length("word").alias("len"), _codes(F.col("word")).alias("codes"))
    # one row per bigram of the alphabet, LETTERS ** 2 = 8,100 at most
    counted = coded.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("c")).collect()
    rank, cost = [0] * LETTERS**2, [0] * LETTERS**2
    for i, r in enumerate(sorted(counted, key=lambda r: (r["c"], r["code"]))):
        rank[r["code"]], cost[r["code"]] = i, r["c"]
    ranks, costs = F.lit(rank), F.lit([float(c) for c in cost])
    grams = F.transform("codes", lambda g, i: F.struct(F.get(ranks, g).alias("gram"), i.alias("pos"), F.get(costs, g).alias("cost")))
    ordered = coded.withColumn("grams", F.array_sort(grams))
    ordered = ordered.withColumn("last", F.get("grams", F.lit(PREFIX - 1))["gram"])
    ordered = ordered.withColumn("prefix", F.filter("grams", lambda g: g["gram"] <= F.col("last")))
    return ordered.withColumn("pivots", _pivots(F.col("prefix"))).select("word", "n", "len", "last", "prefix", "pivots")


def _pivots(prefix: Column) -> Column:
    """The two disjoint bigrams of least cost, by one pass over the places.

    `one`: the best bigram that ends before the last one seen begins anew; `held`: the last one seen; `two`: the best pair.
    """
    by_place = F.array_sort(F.transform(prefix, lambda g: F.struct(g["pos"].alias("pos"), g["cost"].alias("cost"), g["gram"].alias("gram"))))
    gram = lambda cost, pos, gram: F.struct(cost.alias("cost"), pos.alias("pos"), gram.alias("gram"))
    never = gram(F.lit(float("inf")), F.lit(-9), F.lit(0))
    pair = lambda cost, a, b: F.struct(cost.alias("cost"), a.alias("a"), b.alias("b"))

    def step(s, g):
        g = gram(g["cost"], g["pos"], g["gram"])
        free = F.when(s["held"]["pos"] <= g["pos"] - 2, F.least(s["one"], s["held"])).otherwise(s["one"])
        two = F.least(s["two"], pair(free["cost"] + g["cost"], free, g))
        return F.struct(F.least(s["one"], s["held"]).alias("one"), g.alias("held"), two.alias("two"))

    start = F.struct(never.alias("one"), never.alias("held"), pair(F.lit(float("inf")), never, never).alias("two"))
    return F.aggregate(by_place, start, step, lambda s: F.array(s["two"]["a"], s["two"]["b"]))


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): all pairs of words exactly one edit apart, a before b."""
    signed = materialize(signatures(words))
    pivots = signed.select("word", "n", "last", "len", F.explode("pivots").alias("g")).select("word", "n", "last", "len", "g.gram", "g.pos")
    # where a pivot of a word that is as long, longer or shorter by one can stand
    spots = lambda g: F.array(*[
        F.struct((F.col("len") + longer).alias("len"), g["gram"].alias("gram"), (g["pos"] + moved).alias("pos"))
        for longer, moves in ((0, (0,)), (1, (0, 1)), (-1, (0, -1))) for moved in moves
    ])
    listed = signed.select(F.col("word").alias("other"), F.col("n").alias("other_n"), F.col("last").alias("other_last"), F.explode(F.flatten(F.transform("prefix", spots))).alias("s"))
    listed = listed.select("other", "other_n", "other_last", "s.len", "s.gram", "s.pos")
    met = pivots.join(listed, ["len", "gram", "pos"]).where((F.col("last") <= F.col("other_last")) & (F.col("word") != F.col("other")))
    one = met.where(F.levenshtein("word", "other", 1) == 1)
    first = F.col("word") < F.col("other")
    return one.select(
        F.when(first, F.col("word")).otherwise(F.col("other")).alias("a"), F.when(first, F.col("n")).otherwise(F.col("other_n")).alias("a_n"),
        F.when(first, F.col("other")).otherwise(F.col("word")).alias("b"), F.when(first, F.col("other_n")).otherwise(F.col("n")).alias("b_n"),
    ).distinct()


def roots_of(forms: DataFrame) -> DataFrame:
    """(word, root): the end of each chain of `forms` (word, form); counts grow along a chain, so it ends."""
    roots = forms.select("word", F.col("form").alias("root"))
    while True:
        up = roots.select(F.col("word").alias("root"), F.col("root").alias("up"))
        roots = materialize(roots.join(up, "root", "left").select("word", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")))
        done = roots.where("moved").isEmpty()
        roots = roots.drop("moved")
        if done:
            return roots


def group_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of `docs` (doc_id, text).

    Null texts hold no word; a null id counts as an empty one where letters are dropped; repeated rows count again.
    """
    words = materialize(vocabulary(docs))
    pairs = materialize(near_pairs(words))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n"))
    )
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best"))
    named = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(-F.col("best.m") >= FACTOR * F.col("n"), F.struct(F.col("best.near").alias("form"), (-F.col("best.m")).alias("form_n"))).alias("f"),
    )
    named = materialize(named.select("word", "n", "n_near", "f.form", "f.form_n"))
    roots = roots_of(named.where("form is not null").select("word", "form"))
    return named.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
