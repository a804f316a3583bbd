"""Merkle manifest of a dataset: a tree per part, a tree over the parts, and proofs per row.

A leaf is the hash of a row's fields. The leaves of a part (here a language) ascend by id and
are hashed in runs of two, level by level, to the part's subroot; the subroots likewise give the
root. The built levels are stored as node rows that name their parent; one node row holds
``RUNGS`` levels, so that a leaf climbs that many at a step. A recursive query then takes each
leaf up, appending the digests beside its way and folding its own, perhaps tampered, hash.

Results per row:

* a null field counts as ``-``; a part whose name is null is a part of its own, the first;
* an empty text is ``0:``, a very long one is hashed whole;
* rows that share an id stand beside each other, in the order of their leaves, so repeated rows
  are leaves of their own and each gets a row of the result;
* the only leaf of a part is its subroot, and the only subroot is the root;
* an empty table gives no rows; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratacart.llm.common import Steps, set_while, shuffle_partitions

#: Levels in one node row: it holds the digests of at most 2 ** RUNGS nodes and of those above,
#: some 80 KB. Each step of the climb shuffles all leaves, so there should be few.
RUNGS = 10
#: Rows that one task may put in order, and leaves that climb through one copy of a node row.
ONE_TASK = 1 << 16

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

#: The tree over the subroots; those of the parts go by the position of their first leaf.
TOP_TREE = -1


def digest(content: Column) -> Column:
    return F.unhex(F.sha2(content, 256))


def shown(value: Column) -> Column:
    """A digest as hex text."""
    return F.lower(F.hex(value))


def leaf_hash(values: Sequence[Column]) -> Column:
    """The digest of fields, each with its length before it, so that no two rows look alike."""
    texts = [v.cast("string") for v in values]
    marked = [
        F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-"))
        for t in texts
    ]
    return digest(F.concat(*marked))


def numbered(df: DataFrame, order: Sequence[str], steps: Steps, name: str) -> DataFrame:
    """``df`` stored in order, with its rows counted from 0 in ``position``.

    Rows are dealt into ranges; only the number of rows of each range reaches the driver.
    """
    spark = df.sparkSession
    place = F.monotonically_increasing_id()
    dealt = (
        df.repartitionByRange(shuffle_partitions(spark), *order)
        .sortWithinPartitions(*order)
        .withColumns(
            {
                "_range": F.spark_partition_id(),
                "_place": place - F.shiftleft(F.shiftright(place, 33), 33),
            }
        )
    )
    ranges = steps.store(dealt, name)
    counts = {r["_range"]: r["count"] for r in ranges.groupBy("_range").count().collect()}
    known = sorted(counts)
    before = accumulate((counts[n] for n in known), initial=0)
    starts = spark.createDataFrame(
        list(zip(known, before, strict=False)), "_range int, _start long"
    )
    return (
        ranges.join(F.broadcast(starts), "_range")
        .withColumn("position", F.col("_start") + F.col("_place"))
        .drop("_range", "_place", "_start")
    )


def numbered_few(df: DataFrame, order: Sequence[str], steps: Steps, name: str) -> DataFrame:
    """The same for a stored frame that mostly fits one task."""
    if df.count() > ONE_TASK:
        return numbered(df, order, steps, name)
    return df.withColumn("position", F.row_number().over(Window.orderBy(*order)) - F.lit(1))


def node_name(tree: Column, height: int, number: Column) -> Column:
    return F.concat_ws("/", tree, F.lit(height), number)


#: From the digests of one level to those of all levels of a node row, by runs of two.
_LEVELS = """
aggregate(
    if(rungs > 0, sequence(1, rungs), array()),
    array(digests),
    (levels, rung) -> concat(levels, array(transform(
        sequence(0, (size(element_at(levels, -1)) - 1) div 2),
        i -> unhex(sha2(concat(
            lower(hex(element_at(levels, -1)[2 * i])),
            coalesce(lower(hex(get(element_at(levels, -1), 2 * i + 1))), '')
        ), 256))
    )))
)
"""


def _climbed(leaves: DataFrame, sizes: DataFrame, height: int, rungs: int) -> DataFrame:
    """Node rows of one height: node, the digests of each of its levels, and its top.

    leaves: tree, number, digest; sizes: tree and how many nodes it has at this height.
    """
    row = F.shiftright("number", rungs)
    gathered = leaves.groupBy("tree", row.alias("row")).agg(
        F.sort_array(F.collect_list(F.struct("number", "digest"))).alias("nodes")
    )
    more = F.least(F.col("size"), F.lit(1 << rungs))
    built = (
        gathered.join(sizes, "tree")
        .withColumn("digests", F.col("nodes.digest"))
        .withColumn("rungs", F.when(more > 1, F.length(F.bin(more - 1))).otherwise(0))
        .withColumn("levels", F.expr(_LEVELS))
    )
    return built.select(
        "tree",
        "row",
        "size",
        node_name(F.col("tree"), height, F.col("row")).alias("node"),
        F.slice("levels", 1, F.col("rungs")).alias("beside"),
        F.element_at(F.element_at("levels", -1), 1).alias("top"),
    )


class Trees:
    """Node rows of all heights of several trees, and the last digest of each tree."""

    def __init__(self, leaves: DataFrame, sizes: DataFrame, steps: Steps, rungs: int) -> None:
        """leaves: tree, number, digest; sizes: tree, size."""
        self.rungs = rungs
        self.heights: list[DataFrame] = []
        largest = sizes.agg(F.max("size")).head()[0] or 0
        height = 0
        while not self.heights or largest > 1:
            rows = steps.store(_climbed(leaves, sizes, height, rungs), f"nodes-{height}")
            self.heights.append(rows)
            open_trees = rows.where(F.col("size") > 1 << rungs)
            leaves = open_trees.select(
                "tree", F.col("row").alias("number"), F.col("top").alias("digest")
            )
            above = F.shiftright(F.col("size") + ((1 << rungs) - 1), rungs).alias("size")
            sizes = sizes.where(F.col("size") > 1 << rungs).select("tree", above)
            largest = -(-largest >> rungs) if largest > 1 << rungs else 1
            height += 1

    def tops(self) -> DataFrame:
        """tree, top: one row per tree."""
        last = [h.where(F.col("size") <= 1 << self.rungs) for h in self.heights]
        return reduce(DataFrame.union, last).select("tree", "top")

    def nodes(self, above: DataFrame | None, n_leaves: int) -> DataFrame:
        """Parent-linked rows: node, parent, its copies, place in it, the digests of the levels.

        above: the number of each tree among the leaves of the top tree; None for that itself.
        All leaves of a tree climb through its last rows, so a row that more than ``ONE_TASK``
        of ``n_leaves`` may pass stands in copies, between which these are dealt.
        """
        low = (1 << self.rungs) - 1
        parts = []

        def below(height: int) -> int:
            return n_leaves if above is None else min(n_leaves, 1 << self.rungs * (height + 1))

        for height, rows in enumerate(self.heights):
            copies = F.explode(F.sequence(F.lit(0), F.lit(_copies(below(height)) - 1)))
            if above is not None and not height:
                rows = rows.withColumn("name", F.col("node"))
            else:
                rows = rows.withColumn("copy", copies)
                rows = rows.withColumn("name", F.concat_ws("#", "node", "copy"))
            up = node_name(F.col("tree"), height + 1, F.shiftright("row", self.rungs))
            done = F.col("size") <= 1 << self.rungs
            inner = rows.where(~done).select(
                F.col("name").alias("node"),
                up.alias("parent"),
                F.lit(_copies(below(height + 1))).alias("copies"),
                F.col("row").bitwiseAND(low).alias("place"),
                "beside",
            )
            last = rows.where(done)
            if above is None:
                parent = F.lit(None).cast("string")
                place = F.lit(None).cast("long")
            else:
                last = last.join(above, "tree")
                parent = node_name(F.lit(TOP_TREE), 0, F.shiftright("above", self.rungs))
                place = F.col("above").bitwiseAND(low).cast("long")
            outer = last.select(
                F.col("name").alias("node"),
                parent.alias("parent"),
                F.lit(_copies(n_leaves)).alias("copies"),
                place.alias("place"),
                "beside",
            )
            parts += [inner, outer]
        return reduce(DataFrame.union, parts)


def _copies(n_leaves: int) -> int:
    return max(1, -(-n_leaves // ONE_TASK))


#: One step up: the digests beside the way from ``place``, and the hash folded with them. At
#: each level the other of the run stands at the place whose last bit differs, if it is there.
_OTHER = "coalesce(get(n.beside[rung], cast(way.place ^ 1 AS INT)), x'')"
_STEP = f"""
aggregate(
    if(size(n.beside) > 0, sequence(0, size(n.beside) - 1), array()),
    named_struct('place', c.place, 'folded', c.folded, 'siblings', c.siblings),
    (way, rung) -> named_struct(
        'place', shiftright(way.place, 1),
        'folded', unhex(sha2(if(way.place % 2 = 0,
            concat(lower(hex(way.folded)), lower(hex({_OTHER}))),
            concat(lower(hex({_OTHER})), lower(hex(way.folded)))
        ), 256)),
        'siblings', concat(way.siblings, {_OTHER})
    )
)
"""


#: For a recursive query over all leaves. Spark stops such a query at a number of rows, which
#: would be a limit on the dataset; the steps are few, far below its limit on these. Between
#: steps it deals all rows out anew, evenly, and has no need to cut the pieces smaller.
_RECURSION = {
    "spark.sql.cteRecursionRowLimit": "-1",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "false",
    "spark.sql.adaptive.localShuffleReader.enabled": "false",
}


def climb(leaves: DataFrame, nodes: DataFrame, steps: Steps) -> DataFrame:
    """The last row of each leaf: key, tree, leaf, folded, siblings.

    leaves: leaf_no, key, tree, leaf, node, place, folded; nodes as of ``Trees.nodes``. The
    query runs here.
    """
    climbed = leaves.sparkSession.sql(
        f"""
        WITH RECURSIVE climb (leaf_no, key, tree, leaf, node, place, folded, siblings) AS (
            SELECT leaf_no, key, tree, leaf, node, place, folded, x'' FROM {{leaves}}
            UNION ALL
            SELECT leaf_no, key, tree, leaf, parent, parent_place, way.folded, way.siblings FROM (
                SELECT c.leaf_no, c.key, c.tree, c.leaf, n.place AS parent_place, {_STEP} AS way,
                       n.parent || '#' || pmod(xxhash64(c.leaf_no), n.copies) AS parent
                FROM climb c JOIN {{nodes}} n ON c.node = n.node
            )
        )
        SELECT key, tree, leaf, folded, siblings FROM climb WHERE node IS NULL
        """,
        leaves=leaves,
        nodes=nodes,
    )
    with set_while(leaves.sparkSession, _RECURSION):
        return steps.store(climbed, "climbed")


def manifest(
    docs: DataFrame,
    tampered: Column,
    fields: Sequence[str] = FIELDS,
    part: str = "lang",
    key: str = "doc_id",
    changed: str = "n_chars",
    rungs: int = RUNGS,
) -> DataFrame:
    """key, part, leaf, subroot, root, siblings (digests one after another, as hex), folded_root.

    folded_root is what the row gives with its siblings if ``tampered``, an expression over the
    fields, stands in place of the field ``changed``.
    """
    steps = Steps(docs.sparkSession)
    plain = [F.col(f) for f in fields]
    altered = [tampered if f == changed else F.col(f) for f in fields]
    hashed = docs.select(
        F.col(key).alias("key"),
        F.col(part).alias("part"),
        leaf_hash(plain).alias("leaf"),
        F.when(~tampered.eqNullSafe(F.col(changed)), leaf_hash(altered)).alias("other"),
    )
    leaves = numbered(hashed, ("part", "key", "leaf"), steps, "leaves")
    parts = steps.store(
        leaves.groupBy(F.col("part").alias("its_part")).agg(
            F.min("position").alias("tree"), F.count(F.lit(1)).alias("size")
        ),
        "parts",
    )
    placed = leaves.join(parts, F.col("part").eqNullSafe(F.col("its_part"))).withColumn(
        "number", F.col("position") - F.col("tree")
    )

    trees = Trees(
        placed.select("tree", "number", F.col("leaf").alias("digest")),
        parts.select("tree", "size"),
        steps,
        rungs,
    )
    # Trees go by their first leaves, and so in the order of their parts.
    subroots = numbered_few(steps.store(trees.tops(), "subroots"), ("tree",), steps, "roots")
    above = subroots.select("tree", F.col("position").cast("long").alias("above"))
    roots = subroots.select(
        F.lit(TOP_TREE).cast("long").alias("tree"),
        F.col("position").cast("long").alias("number"),
        F.col("top").alias("digest"),
    )
    top = Trees(roots, roots.groupBy("tree").agg(F.count(F.lit(1)).alias("size")), steps, rungs)
    last = top.tops().head()
    n_leaves = parts.agg(F.sum("size")).head()[0] or 0

    ways = climb(
        placed.select(
            F.col("position").alias("leaf_no"),
            "key",
            "tree",
            "leaf",
            node_name(F.col("tree"), 0, F.shiftright("number", rungs)).alias("node"),
            F.col("number").bitwiseAND((1 << rungs) - 1).alias("place"),
            F.coalesce("other", "leaf").alias("folded"),
        ),
        trees.nodes(above, n_leaves).union(top.nodes(None, n_leaves)),
        steps,
    )
    return (
        ways.join(parts, "tree")
        .join(subroots, "tree")
        .select(
            F.col("key").alias(key),
            F.col("its_part").alias(part),
            shown(F.col("leaf")).alias("leaf"),
            shown(F.col("top")).alias("subroot"),
            F.lit(last["top"].hex() if last else None).cast("string").alias("root"),
            shown(F.col("siblings")).alias("siblings"),
            shown(F.col("folded")).alias("folded_root"),
        )
    )
