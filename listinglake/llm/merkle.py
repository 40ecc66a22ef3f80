"""Operator 11: a Merkle manifest of a dataset and proofs by a recursive climb.

Every row is a leaf. The leaves of a source, in the order of their ids, are hashed in threes, level by level, up to the
source's subroot, and the subroots likewise up to the root. What is built is stored as node rows that name their
parent; a recursive query climbs from every leaf along these links, appends the siblings that it passes and folds its
own, perhaps tampered, hash with them. Where the fold ends in the root the leaf is as it was.

Hashes are texts of hexadecimal digits where they are hashed and bytes where they are stored.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listinglake.llm.common import table, written
from listinglake.operators.order import numbered

#: Nodes hashed into one.
ARITY = 3
#: Levels that one stored link spans, and nodes below it. A block is so many neighbouring leaves.
SPAN = 5
BLOCK = ARITY**SPAN

#: A climb's next rows: the hash is folded with the siblings of every level that the link spans, from below.
CLIMB = """
WITH RECURSIVE climb AS (
  SELECT at, tree, block, up, 0 AS step, path, folded FROM {leaves}
  UNION ALL
  SELECT c.at, c.tree, c.block, n.up, n.step, n.path,
         aggregate(n.path, c.folded, (h, s) -> unhex(sha2(concat(lower(hex(s.left)), lower(hex(h)), lower(hex(s.right))), 256)))
  FROM climb c JOIN {nodes} n ON n.tree = c.tree AND n.block = c.block AND n.step = c.up
)
SELECT at, step, path, folded FROM climb
"""


def field(c: Column) -> Column:
    """A value as it enters a leaf's hash: its length in bytes, a colon and its text; a dash for null."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, columns)), 256)


def text_of(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def fold(path: Column, start: Column) -> Column:
    return F.aggregate(path, start, lambda h, s: F.unhex(F.sha2(F.concat(text_of(s["left"]), text_of(h), text_of(s["right"])), 256)))


@contextmanager
def unlimited_recursion(spark: SparkSession) -> Iterator[None]:
    """Recursive queries stop at a million rows by default; a climb has a few for every row of the data."""
    setting = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, "-1")
    try:
        yield
    finally:
        spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)


def grown(nodes: DataFrame, *carried: str) -> DataFrame:
    """Of nodes (tree, idx, n, hash) every block: tree, block, n, top (the hash SPAN levels up, or the tree's last one) and members (idx, hash, path, …).

    n: nodes of the tree on this level. A tree of at most BLOCK nodes ends in its block. A member's path holds the
    siblings left and right of it on each level. A block has BLOCK members at most, whatever its source.
    """
    held = nodes.groupBy("tree", F.floor(F.col("idx") / BLOCK).alias("block"), "n").agg(F.array_sort(F.collect_list(F.struct("idx", "hash", *carried))).alias("m"))
    height = F.lit(SPAN)
    for k in range(SPAN - 1, -1, -1):
        height = F.when(F.col("n") <= ARITY**k, k).otherwise(height)
    held = held.withColumn("height", height)

    def above(level: Column) -> Column:
        runs = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / ARITY).cast("int"))
        return F.transform(runs, lambda r: F.sha2(F.array_join(F.slice(level, r * ARITY + 1, ARITY), ""), 256))

    bottom = F.array(F.transform("m", lambda x: text_of(x["hash"])))
    steps = F.filter(F.sequence(F.lit(0), F.lit(SPAN - 1)), lambda k: k < F.col("height"))
    built = F.aggregate(steps, bottom, lambda levels, _: F.concat(levels, F.array(above(F.element_at(levels, -1)))))
    held = held.withColumn("levels", built)

    def beside(level: Column, place: Column) -> Column:
        run = place % ARITY
        joined = lambda start, n: F.unhex(F.array_join(F.slice(level, start, n), ""))
        return F.struct(joined(place - run + 1, run).alias("left"), joined(place + 2, F.lit(ARITY - 1) - run).alias("right"))

    def path(place: Column) -> Column:
        wide = F.array(*[F.lit(ARITY**k) for k in range(SPAN)])
        return F.transform(steps, lambda k: beside(F.element_at("levels", k + 1), F.floor(place / F.get(wide, k)).cast("int")))

    members = F.transform("m", lambda x, k: F.struct(x["idx"].alias("idx"), x["hash"].alias("hash"), *[x[c].alias(c) for c in carried], path(k).alias("path")))
    return held.select("tree", "block", "n", F.unhex(F.element_at(F.element_at("levels", -1), 1)).alias("top"), members.alias("members"))


def parents(n: Column) -> Column:
    return F.ceil(n / BLOCK)


def manifest(docs: DataFrame, columns: list[str], *, id_col: str = "doc_id", group_col: str = "source", tampered: dict[str, Column] | None = None, when: Column | None = None) -> DataFrame:
    """One row per row of docs: id_col, leaf, subroot, root, proof_sha256, folded_root and verified.

    ``columns`` enter the leaf's hash in this order. ``tampered``: what stands in for some of them in the rows that
    fulfil ``when``; without it the rows are as they were and all are verified. ``proof_sha256``: hash of all siblings
    on the way to the root, from below and from left to right, as texts.

    Nulls are hashed as such; a null group is a source of its own, the first. Rows of one id are ordered by their
    hash, equal rows give equal results but for their places. An empty table gives no rows. Other columns are not read.

    Rows are numbered along one order over the cluster, so a source that holds a third of them is spread over many
    tasks. Blocks have 243 nodes at most. The links above the first are stored once for each block of leaves below
    them, so that no node is sought by more than 243 rows. The row limit of recursive queries is lifted while the
    climb runs. The number of levels and one hash, the root, reach the driver.
    """
    own = {c: F.col(f"`{c}`") for c in columns}
    leaf = leaf_hash([*own.values()])
    changed = F.when(when, leaf_hash([(tampered or {}).get(c, own[c]) for c in columns])).otherwise(leaf) if when is not None else leaf
    hashed = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{group_col}`").cast("string").alias("source"), F.unhex(leaf).alias("hash"), F.unhex(changed).alias("changed"))
    placed = numbered(written(hashed), ["source", "id", "hash"])
    trees = numbered(written(placed.groupBy("source").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))), ["source"]).withColumnRenamed("at", "tree")
    trees = written(trees)
    spark, (most, n_trees) = docs.sparkSession, trees.agg(F.max("n"), F.count(F.lit(1))).first()
    base = trees.select("tree", F.col("source").alias("of"), "first", "n")
    leaves = placed.join(base, F.col("source").eqNullSafe(F.col("of"))).select("tree", (F.col("at") - F.col("first")).alias("idx"), "n", "hash", "at", "id", "changed")

    ground = written(grown(leaves, "at", "id", "changed"))
    start = ground.select("tree", "block", "n", F.inline("members")).select(
        "at", "tree", "block", F.when(F.col("n") > BLOCK, 1).otherwise(-1).alias("up"), "path", fold(F.col("path"), F.col("changed")).alias("folded"), "id", "hash"
    )
    links, tops, step = [], [ground.where(F.col("n") <= BLOCK).select("tree", "top")], 1
    level, left = ground, -(-(most or 0) // BLOCK)
    blocks = base.select(F.col("tree").alias("t"), parents(F.col("n")).alias("blocks"))
    while left > 1:
        above = level.where(F.col("n") > BLOCK).select("tree", F.col("block").alias("idx"), parents(F.col("n")).alias("n"), F.col("top").alias("hash"))
        level = written(grown(above))
        below = BLOCK ** (step - 1)
        link = level.select("tree", "n", F.inline("members")).join(blocks, F.col("tree") == F.col("t"))
        covered = F.sequence(F.col("idx") * below, F.least((F.col("idx") + 1) * below, F.col("blocks")) - 1)
        links.append(link.select("tree", F.explode(covered).alias("block"), F.lit(step).alias("step"), F.when(F.col("n") > BLOCK, step + 1).otherwise(-1).alias("up"), "path"))
        tops.append(level.where(F.col("n") <= BLOCK).select("tree", "top"))
        step, left = step + 1, -(-left // BLOCK)

    subroots = tops[0]
    for t in tops[1:]:
        subroots = subroots.union(t)
    subroots = written(subroots)
    level = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(n_trees).cast("long").alias("n"), F.col("top").alias("hash"))
    left, depth = n_trees, 0
    while True:
        level = written(grown(level))
        below = BLOCK**depth
        link = level.select("n", F.inline("members"))
        covered = F.sequence(F.col("idx") * below, F.least((F.col("idx") + 1) * below, F.lit(n_trees)) - 1)
        link = link.select(F.explode(covered).alias("tree"), "path", F.when(F.col("n") > BLOCK, -depth - 2).otherwise(0).alias("up"))
        link = link.join(blocks, F.col("tree") == F.col("t"))
        links.append(link.select("tree", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(-depth - 1).alias("step"), "up", "path"))
        if left <= BLOCK:
            break
        level = level.select("tree", F.col("block").alias("idx"), parents(F.col("n")).alias("n"), F.col("top").alias("hash"))
        left, depth = -(-left // BLOCK), depth + 1
    top = level.select("top").first()
    root = F.lit(bytes(top[0]) if top else None).cast("binary")

    nodes = links[0]
    for more in links[1:]:
        nodes = nodes.union(more)
    nodes = written(nodes)
    climbed = spark.sql(CLIMB, leaves=start, nodes=nodes)
    # Steps in the order of the climb: 0, 1, 2 … within the source, then -1, -2 … among the sources.
    order = F.when(F.col("step") >= 0, F.col("step")).otherwise(1_000_000 - F.col("step"))
    ways = climbed.withColumn("step", order).groupBy("at").agg(F.array_sort(F.collect_list(F.struct("step", "path"))).alias("ways"), F.max(F.struct("step", "folded"))["folded"].alias("folded"))
    siblings = F.transform(F.flatten(F.transform("ways", lambda w: w["path"])), lambda s: F.concat(text_of(s["left"]), text_of(s["right"])))
    proved = ways.select("at", F.sha2(F.array_join(siblings, ""), 256).alias("proof_sha256"), "folded")
    with unlimited_recursion(spark):
        proved = written(proved)
    named = start.select("at", "tree", "id", "hash").join(proved, "at").join(subroots, "tree")
    return named.select(
        F.col("id").alias(id_col), text_of(F.col("hash")).alias("leaf"), text_of(F.col("top")).alias("subroot"), text_of(root).alias("root"), "proof_sha256",
        text_of(F.col("folded")).alias("folded_root"), (F.col("folded") == root).alias("verified"),
    )


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's proof; of every second document by the checksum of its id the line ends were removed."""
    docs = table(spark, sf_dir, "documents")
    odd = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], tampered={"text": F.replace(F.col("text"), F.lit("\n"), F.lit(""))}, when=F.coalesce(odd, F.lit(False)))


def oracle() -> str:
    """The same in SQL: levels and climbs as recursive queries, the checksum of an id bit by bit."""
    number = lambda c: f"coalesce(concat(strlen(CAST({c} AS VARCHAR)), ':', {c}), '-')"
    leaf = lambda text: f"sha256(concat({', '.join(map(number, ('doc_id', 'source', 'lang', 'n_chars', text)))}))"
    byte = "CASE WHEN i % 8 = 0 THEN ascii(substr(CAST(doc_id AS VARCHAR), CAST(i // 8 + 1 AS BIGINT), 1)) ELSE 0 END"

    def levels(name: str, bottom: str) -> str:
        return f"""{name} AS (SELECT * FROM {bottom}
          UNION ALL SELECT tree, level + 1, idx // 3, sha256(string_agg(hash, '' ORDER BY idx)), (n + 2) // 3 FROM {name} WHERE n > 1 GROUP BY tree, level, idx // 3, n)"""

    def sides(name: str, nodes: str) -> str:
        run = "string_agg(hash, '') OVER (PARTITION BY tree, level, idx // 3 ORDER BY idx ROWS BETWEEN"
        return f"""{name} AS (SELECT tree, level, idx, coalesce({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
          coalesce({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {nodes} WHERE n > 1)"""

    def climb(name: str, start: str, nodes: str) -> str:
        return f"""{name} AS (SELECT * FROM {start} UNION ALL SELECT place, c.tree, c.level + 1, c.idx // 3, concat(proof, l, r), sha256(concat(l, folded, r))
          FROM {name} c JOIN {nodes} s ON s.tree = c.tree AND s.level = c.level AND s.idx = c.idx)"""

    return f"""
    WITH RECURSIVE docs AS (SELECT *, {leaf("text")} AS leaf, {leaf("replace(text, chr(10), '')")} AS bare,
      list_reduce(list_concat([4294967295], range(8 * strlen(CAST(doc_id AS VARCHAR)))), lambda c, i:
        CASE WHEN xor(c, {byte}) % 2 = 1 THEN xor(xor(c, {byte}) >> 1, 3988292384) ELSE xor(c, {byte}) >> 1 END) AS crc FROM documents),
    leaves AS (SELECT doc_id, leaf, CASE WHEN xor(crc, 4294967295) % 2 = 0 THEN bare ELSE leaf END AS changed, row_number() OVER () AS place,
      dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM docs),
    ground AS (SELECT tree, CAST(0 AS BIGINT) AS level, idx, leaf AS hash, n FROM leaves),
    {levels("nodes", "ground")},
    top AS (SELECT CAST(0 AS BIGINT) AS tree, CAST(0 AS BIGINT) AS level, tree AS idx, hash, count(*) OVER () AS n FROM nodes WHERE n = 1),
    {levels("high", "top")},
    {sides("runs", "nodes")},
    {sides("high_runs", "high")},
    start AS (SELECT place, tree, CAST(0 AS BIGINT) AS level, idx, '' AS proof, changed AS folded FROM leaves),
    {climb("climb", "start", "runs")},
    done AS (SELECT place, tree AS own, proof, folded, row_number() OVER (PARTITION BY place ORDER BY level DESC) AS k FROM climb),
    again AS (SELECT place, CAST(0 AS BIGINT) AS tree, CAST(0 AS BIGINT) AS level, own AS idx, proof, folded FROM done WHERE k = 1),
    {climb("ascent", "again", "high_runs")},
    ended AS (SELECT place, proof, folded, row_number() OVER (PARTITION BY place ORDER BY level DESC) AS k FROM ascent),
    roots AS (SELECT hash AS root FROM high WHERE n = 1)
    SELECT doc_id, leaf, t.hash AS subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
    FROM leaves JOIN ended USING (place) JOIN top t ON t.idx = leaves.tree, roots WHERE k = 1"""
