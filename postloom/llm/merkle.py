"""A manifest of a dataset: one Merkle tree per language, and one over their roots.

Every row is a leaf, the hash of its fields. Leaves of a language ascend by doc_id; while several nodes
remain, every `FANOUT` consecutive ones become the hash of their concatenated hex digests. What remains is the
language's subroot; subroots, ordered by language, become the root likewise.

The built levels are stored as rows: a run of siblings, with the place of their parent in the run above.
A recursive query climbs from the leaves: each step appends the siblings to the proof and folds the
hash into that of the parent, until a parent has no run above. The leaves of a block, the two lowest levels of a
subtree, share all siblings above it, so they climb together: an array of hashes beside one proof. Within its
block each leaf is folded before. Untampered leaves of a block have one hash from its top on, so it
climbs once. Runs near the root are met by very many climbers; they are listed under several salts, so that none
of them is a hot key.
"""

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from .joins import counted
from .ranks import ranked

FANOUT = 8
BLOCK = FANOUT**2
TOP = -1  # the tree over the subroots; languages are numbered from 0
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    """A value with its length in bytes in front; `-` for null."""
    value = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf(text: Column | None = None) -> Column:
    """Hash of a row's fields, with another text if one is given."""
    return digest(F.concat(*[field(text if c == "text" and text is not None else F.col(c)) for c in FIELDS]))


def tampered_rows(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 0, F.lit(False))


def _levels(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """All runs of the trees of `nodes` (t, idx, h, n: nodes of the tree), level by level, and (t, h) of what remains."""
    runs, ends = [], []
    level = 0
    widest = nodes.agg(F.max("n")).head()[0] or 0
    while True:
        ends.append(nodes.where("n = 1").select("t", "h"))
        if widest <= 1:
            break
        grouped = nodes.where("n > 1").groupBy("t", F.floor(F.col("idx") / FANOUT).alias("idx"), F.ceil(F.col("n") / FANOUT).alias("n"))
        run = grouped.agg(F.sort_array(F.collect_list(F.struct("idx", "h"))).alias("run"))
        run = materialize(run.select("t", F.lit(level).alias("level"), "idx", "n", F.col("run.h").alias("run")))
        runs.append(run)
        nodes = run.select("t", "idx", digest(F.array_join("run", "")).alias("h"), "n")
        widest = -(-widest // FANOUT)
        level += 1
    left = ends[0]
    for e in ends[1:]:
        left = left.unionByName(e)
    return runs, materialize(left)


def _union(frames: list[DataFrame], schema_of: DataFrame) -> DataFrame:
    out = schema_of.limit(0)
    for f in frames:
        out = out.unionByName(f)
    return out


def _lower_hex(value: Column) -> Column:
    return F.lower(F.hex(value))


def _joined(hashes: Column | str, begin: Column, length: Column | int) -> Column:
    return F.array_join(F.slice(hashes, begin, F.lit(length) if isinstance(length, int) else length), "")


class Manifest:
    """Leaves, runs and roots of `docs` (doc_id, source, lang, n_chars, text; other columns play no part).

    Rows with equal ids follow each other by leaf; equal rows are leaves of their own. Null ids and the null
    language come first. An empty table has no root.
    """

    def __init__(self, docs: DataFrame):
        spark = docs.sparkSession
        lowered = F.translate("text", UPPER, UPPER.lower())
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", "n_chars", "text").select(
            "doc_id", "lang", F.unhex(leaf()).alias("leaf"), F.when(tampered_rows(), F.unhex(leaf(lowered))).alias("other")
        )
        rows = materialize(rows)
        langs = materialize(ranked(rows.groupBy("lang").agg(F.count("*").alias("n")), ["lang"], out="t"))
        count = langs.count()
        self.alone = count <= 1
        named = langs.toDF("_lang", "n", "t")  # as many rows as there are languages
        placed = ranked(rows, ["doc_id", "leaf"], ["lang"]).join(counted(named), F.col("lang").eqNullSafe(F.col("_lang")))
        members = F.sort_array(F.collect_list(F.struct("idx", "doc_id", "leaf", "other")))
        blocks = placed.groupBy("t", F.floor(F.col("idx") / BLOCK).alias("block"), "n").agg(members.alias("members"))
        self.blocks = materialize(blocks.select("t", "block", "n", F.transform("members", lambda m: m.dropFields("idx")).alias("members")))

        tops = self._within().select("t", F.col("block").alias("idx"), F.col("top").alias("h"), F.ceil(F.col("n") / BLOCK).alias("n"))
        runs, self.subroots = _levels(materialize(tops))
        over = self.subroots.select(F.lit(TOP).cast("long").alias("t"), F.col("t").alias("idx"), "h", F.lit(count).cast("long").alias("n"))
        above, top = _levels(over)
        self.root = top.select(F.col("h").alias("root"))
        every = _union([*runs, *above], spark.createDataFrame([], "t long, level int, idx long, n long, run array<string>"))
        # a run's parent is the next level's child; a subroot is a child of the tree above; the root is nobody's
        last = F.col("n") == 1
        self.runs = materialize(
            every.select(
                "t", "level", "idx", "run",
                F.when(~last, F.col("t")).when((F.col("t") == TOP) | F.lit(self.alone), F.lit(None)).otherwise(F.lit(TOP)).cast("long").alias("up_t"),
                F.when(~last, F.col("level") + 1).otherwise(0).alias("up_level"),
                F.when(~last, F.col("idx")).otherwise(F.col("t")).alias("up_place"),
            )
        )

    def _within(self) -> DataFrame:
        """Blocks with `low`, the hex digests of their leaves, `high`, those of the runs of these, and `top`, what the block becomes."""
        low = self.blocks.withColumn("low", F.transform("members", lambda m: _lower_hex(m["leaf"])))
        runs = F.sequence(F.lit(0), F.floor((F.size("low") - 1) / FANOUT).cast("int"))
        high = low.withColumn("high", F.transform(runs, lambda k: digest(_joined("low", k * FANOUT + 1, FANOUT))))
        top = F.when(F.col("n") == 1, F.get("low", F.lit(0))).when(F.col("n") <= FANOUT, F.get("high", F.lit(0)))
        return high.withColumn("top", top.otherwise(digest(F.array_join("high", ""))))

    @staticmethod
    def _fold(i: Column, own: Column) -> Column:
        """Member i's own hash folded up to the top of its block."""
        k, p = F.floor(i / FANOUT).cast("int"), F.pmod(i, F.lit(FANOUT))
        once = digest(F.concat(_joined("low", k * FANOUT + 1, p), own, _joined("low", i + 2, F.lit(FANOUT - 1) - p)))
        twice = digest(F.concat(_joined("high", F.lit(1), k), once, _joined("high", k + 2, FANOUT)))
        return F.when(F.col("n") == 1, own).when(F.col("n") <= FANOUT, once).otherwise(twice)

    @staticmethod
    def _siblings(i: Column) -> Column:
        """The others of member i's run, and those of its run's run, left to right."""
        k, p = F.floor(i / FANOUT).cast("int"), F.pmod(i, F.lit(FANOUT))
        near = F.concat(_joined("low", k * FANOUT + 1, p), _joined("low", i + 2, F.lit(FANOUT - 1) - p))
        far = F.concat(_joined("high", F.lit(1), k), _joined("high", k + 2, FANOUT))
        return F.when(F.col("n") <= FANOUT, near).otherwise(F.concat(near, far))

    def climb(self) -> DataFrame:
        """Per block (t, block): `folded`, the hashes its climbers have at the root, first that of the untampered leaves,
        then those of the tampered ones in order; `tail`, the proof above the block."""
        spark = self.blocks.sparkSession
        own = F.transform("members", lambda m, i: F.when(m["other"].isNotNull(), self._fold(i, _lower_hex(m["other"]))))
        small = F.col("n") <= BLOCK  # the block's top is the subroot
        starts = self._within().select(
            "t", "block", F.xxhash64("t", "block").alias("who"),
            F.when(small, F.lit(None if self.alone else TOP)).otherwise(F.col("t")).cast("long").alias("up_t"),
            F.lit(0).alias("up_level"),
            F.when(small, F.col("t")).otherwise(F.col("block")).alias("up_place"),
            F.transform(F.concat(F.array("top"), F.filter(own, lambda h: h.isNotNull())), F.unhex).alias("folded"),
        )
        salts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
        spread = f"CASE WHEN {{t}} = {TOP} THEN {salts}L ELSE least(CAST(pow({FANOUT}, {{level}} + 1) AS BIGINT), {salts}L) END"
        listed = self.runs.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(spread.format(t="t", level="level")) - 1)))
        names = {v: f"_merkle_{v}_{uuid.uuid4().hex}" for v in ("starts", "runs")}
        materialize(starts).createOrReplaceTempView(names["starts"])
        listed.createOrReplaceTempView(names["runs"])
        lower = f"array_join(slice(n.run, 1, CAST(c.up_place % {FANOUT} AS INT)), '')"
        upper = f"array_join(slice(n.run, CAST(c.up_place % {FANOUT} AS INT) + 2, {FANOUT}), '')"
        climb = f"""
            WITH RECURSIVE climb(t, block, who, up_t, up_level, up_place, folded, tail) AS (
                SELECT t, block, who, up_t, up_level, up_place, folded, CAST('' AS BINARY) FROM {names["starts"]}
                UNION ALL
                SELECT c.t, c.block, c.who, n.up_t, n.up_level, n.up_place,
                       transform(c.folded, h -> unhex(sha2(CAST(concat({lower}, lower(hex(h)), {upper}) AS BINARY), 256))),
                       concat(c.tail, unhex(concat({lower}, {upper})))
                FROM climb c JOIN {names["runs"]} n
                  ON n.t = c.up_t AND n.level = c.up_level AND n.idx = c.up_place DIV {FANOUT}
                 AND n.salt = pmod(c.who, {spread.format(t="c.up_t", level="c.up_level")})
            )
            SELECT t, block, folded, tail FROM climb WHERE up_t IS NULL"""
        limit = "spark.sql.cteRecursionRowLimit"
        before = spark.conf.get(limit, None)
        spark.conf.set(limit, "-1")
        try:
            return materialize(spark.sql(climb))
        finally:
            spark.conf.unset(limit) if before is None else spark.conf.set(limit, before)
            for v in names.values():
                spark.catalog.dropTempView(v)

    def proofs(self) -> DataFrame:
        """Per row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
        root = self.root.head()
        whole = F.lit(root["root"] if root else None).cast("string")
        both = self._within().join(self.climb(), ["t", "block"]).withColumn("above", _lower_hex(F.col("tail")))
        # tampered members are numbered in order; the others share the first hash
        nth = F.aggregate(
            "members", F.array(F.lit(0)), lambda a, m: F.concat(a, F.array(F.element_at(a, -1) + m["other"].isNotNull().cast("int")))
        )
        both = both.withColumn("nth", nth)
        each = F.transform(
            "members",
            lambda m, i: F.struct(
                m["doc_id"].alias("doc_id"), F.get("low", i).alias("leaf"), digest(F.concat(self._siblings(i), F.col("above"))).alias("proof"),
                _lower_hex(F.get("folded", F.when(m["other"].isNull(), 0).otherwise(F.get("nth", i) + 1))).alias("folded"),
            ),
        )
        rows = both.select("t", F.explode(each).alias("x")).join(counted(self.subroots.select("t", F.col("h").alias("subroot"))), "t")
        return rows.select(
            "x.doc_id", "x.leaf", "subroot", whole.alias("root"), F.col("x.proof").alias("proof_sha256"),
            F.col("x.folded").alias("folded_root"), (F.col("x.folded") == whole).alias("verified"),
        )
