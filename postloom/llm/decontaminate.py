"""Benchmark items found in texts.

An item is found in a text if a window of the item's length has a weighted Jaccard similarity
to it of 0.75 or more: shingles of five words (fewer for shorter items), each weighing as often as it
occurs. A text shorter than the item is one window.

Which windows can be best: slide a window to the left until its last shingle is one of an item's; that drops no shared
shingle. So it is enough to look at windows that end in a shared shingle, in whatever order the item's parts stand. A
window with fewer shared shingles than three quarters of the item's can't reach the similarity and is not opened.

Each window gets a SimHash fingerprint of 64 bits. Fingerprints at a distance of up to 23 agree in one of eight
blocks of eight bits up to two bits, so the items' blocks are listed with all variants up to two bits,
and a window meets each item within the radius for certain. At similarity 0.75 the distance is 11 on average,
with a deviation of 3. Exact similarity then decides.
"""

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import let
from ..session import materialize
from .joins import counted

SHINGLE = 5
PERCENT = 75
BLOCKS, WIDTH, NEAR = 8, 8, 2
LANE = 21  # bits of a counter
RADIUS = BLOCKS * (NEAR + 1) - 1
MASKS = [sum(1 << b for b in bits) for n in range(NEAR + 1) for bits in combinations(range(WIDTH), n)]


def words_of(text: Column) -> Column:
    """Lower-case words between spaces and 0x09-0x0D."""
    flat = F.replace(text, F.lit("\n"), F.lit(" "))
    # one plain delimiter: a pattern would be compiled anew for each text
    even = F.when(flat.rlike(r"[\t\r\x0b\x0c]"), F.translate(flat, "\t\r\x0b\x0c", "    ")).otherwise(flat)
    return F.array_remove(F.split(F.lower(even), " "), "")


def shingles(words: Column, k: Column | int) -> Column:
    """Hashes of k neighbouring words."""
    k = F.lit(k) if isinstance(k, int) else k
    last = F.size(words) - k + 1
    at = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.slice(words, i, k)))


def fingerprint(hashes: Column) -> Column:
    """SimHash: a bit is set if more than half of the shingles, counted as often as they occur, have it.

    One pass with all counters: three of 21 bits in each number, so up to 2,097,151 shingles.
    """
    spread = F.lit([sum(((v >> i) & 1) << (LANE * i) for i in range(3)) for v in range(8)])
    parts = range(0, 64, 3)
    zero = F.struct(*[F.lit(0).cast("long").alias(f"c{b}") for b in parts])
    add = lambda s, h: F.struct(*[
        (s[f"c{b}"] + F.get(spread, F.shiftrightunsigned(h, b).bitwiseAND(F.lit(7)).cast("int")).cast("long")).alias(f"c{b}") for b in parts
    ])
    count = lambda s, b: F.shiftright(s[f"c{b - b % 3}"], LANE * (b % 3)).bitwiseAND(F.lit((1 << LANE) - 1))

    def done(s):
        bits = [F.when(2 * count(s, b) > F.size(hashes), F.lit((1 << b) - (1 << 64 if b == 63 else 0))).otherwise(0) for b in range(64)]
        return reduce(lambda x, y: x.bitwiseOR(y), [b.cast("long") for b in bits])

    return F.aggregate(hashes, zero, add, done)


def _block(f: Column, i: int) -> Column:
    return F.shiftright(f, i * WIDTH).bitwiseAND(F.lit((1 << WIDTH) - 1))


def similarity(a: Column, b: Column) -> Column:
    """Shared weight over joint weight of two shingle lists."""
    count = lambda x, h: F.size(F.filter(x, lambda y: y == h))
    common = F.array_intersect(a, b)
    # where no shingle is repeated, each common one weighs one
    plain = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    both = F.when(plain, F.size(common)).otherwise(F.aggregate(common, F.lit(0), lambda n, h: n + F.least(count(a, h), count(b, h))))
    return both / (F.size(a) + F.size(b) - both)


def find_items(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, item_id, similarity: the greatest over windows, for every pair that reaches `percent`.

    Null and empty texts and items match nothing. Rows with one id are reported together.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tid"), "text")
    want = (
        items.where("text is not null")
        .select("item_id", words_of(F.col("text")).alias("w"))
        .where("size(w) > 0")
        .select("item_id", F.size("w").alias("n"), F.least(F.size("w"), F.lit(SHINGLE)).alias("k"), "w")
        .withColumn("want", shingles(F.col("w"), F.col("k")))
        .withColumn("print", fingerprint(F.col("want")))
        .drop("w")
    )
    want = materialize(want)
    sizes = [r["k"] for r in want.select("k").distinct().collect()]  # five values at most
    sought = materialize(want.select("k", "n", F.explode("want").alias("h")).distinct())
    sought = counted(sought)
    hits = None
    for k in sizes or [SHINGLE]:
        own = keyed.select("doc_id", "tid", words_of(F.col("text")).alias("w"))
        own = own.select("doc_id", "tid", F.posexplode(shingles(F.col("w"), k)).alias("p", "h"))
        found = own.join(sought.where(F.col("k") == k), "h").select("doc_id", "tid", "k", "n", "p")
        hits = found if hits is None else hits.unionByName(found)
    ends = hits.groupBy("doc_id", "tid", "k", "n").agg(F.sort_array(F.collect_set("p")).alias("at"))
    # enough shared shingles between the window's first place and its last one
    least = F.ceil((F.col("n") - F.col("k") + 1) * percent / F.lit(100)).cast("int")
    first = lambda p: p - (F.col("n") - F.col("k"))
    fit = F.filter("at", lambda p, i: (i >= least - 1) & (F.get("at", F.greatest(i - least + 1, F.lit(0))) >= first(p)))
    starts = F.array_distinct(F.transform(fit, lambda p: F.greatest(first(p), F.lit(0))))
    opened = ends.select("doc_id", "tid", "k", "n", starts.alias("starts")).where(F.size("starts") > 0)
    places = opened.groupBy("doc_id", "tid", "k").agg(F.flatten(F.collect_list(F.transform("starts", lambda s: F.struct("n", s.alias("start"))))).alias("places"))
    places = materialize(places.toDF("p_id", "p_tid", "k", "places"))
    same = F.col("doc_id").eqNullSafe(F.col("p_id")) & (F.col("tid") == F.col("p_tid"))
    # words and shingles of a text are bound to names, as they would be made anew for each window
    cut = lambda hashes: F.transform("places", lambda x: F.struct(x["n"].alias("n"), F.slice(hashes, x["start"] + 1, x["n"] - F.col("k") + 1).alias("have")))
    windows = let(words_of(F.col("text")), lambda w: let(shingles(w, F.col("k")), cut))
    windows = (
        keyed.join(counted(places, F.size("places") * 2 + 4), same)
        .select("doc_id", "k", F.explode(windows).alias("x"))
        .select("doc_id", "k", "x.n", "x.have")
        .where(F.size("have") > 0)
        .distinct()
        .withColumn("print", fingerprint(F.col("have")))
    )
    blocks = F.array(*[_block(F.col("print"), i) for i in range(BLOCKS)])
    near = F.transform(blocks, lambda v: F.transform(F.array(*[F.lit(m).cast("long") for m in MASKS]), lambda m: v.bitwiseXOR(m)))
    listed = want.select("item_id", "n", "want", F.col("print").alias("other"), F.posexplode(near).alias("block", "vs")).select(
        "item_id", "n", "want", "other", "block", F.explode("vs").alias("v")
    )
    listed = counted(materialize(listed), F.size("want") + 8)
    probes = windows.select("doc_id", "n", "have", "print", F.posexplode(blocks).alias("block", "v"))
    met = probes.join(listed, ["n", "block", "v"]).where(F.bit_count(F.col("print").bitwiseXOR(F.col("other"))) <= RADIUS)
    met = met.where(2 * 100 * F.least(F.size("have"), F.size("want")) >= 2 * percent * F.greatest(F.size("have"), F.size("want")))
    met = met.select("doc_id", "item_id", "have", "want").withColumn("similarity", similarity(F.col("have"), F.col("want")))
    return met.where(F.col("similarity") * 100 >= percent - 1e-9).groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"))


def decontaminate(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """`docs` without the rows whose text holds an item; all columns stay."""
    plain = docs.select(F.xxhash64("doc_id", "text").alias("doc_id"), "text")
    hit = materialize(find_items(plain, items, percent).select(F.col("doc_id").alias("_llm_key")).distinct())
    return docs.withColumn("_llm_key", F.xxhash64("doc_id", "text")).join(counted(hit), "_llm_key", "left_anti").select(*docs.columns)
