"""A Merkle manifest of a table: subtrees by language, proofs, and a check of each row.

The children of a parent are spread into as many columns as a parent has children at most,
by conditional aggregates. The columns concatenated and hashed are the parent; the columns
without a child's own are what its proof needs. Leaves are numbered by one sort over the
cluster, written once, so that a language with any share of the rows spreads over tasks.
Proofs go down from the root: parents hand their children the siblings of all levels above.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.llm.common import ascii_lower, written

FANOUT = 8
# A row's number as Spark generates it: the partition above, the place in it below.
PLACE_BITS = 33
NODE = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts, nulls left out."""
    return F.sha2(F.concat_ws("", *parts), 256)


def framed(value: Column) -> Column:
    """A value with its length in UTF-8 bytes before it; a null is a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame, columns: list[str], id_col: str, group_col: str, text_col: str, tampered: Column) -> DataFrame:
    """id, grp, leaf, other: the digest of each row, and that of the row with its text in
    lower case where it is tampered with (else null). Texts are read in one pass, and nothing of
    them but digests goes on."""
    known = {name: docs[name] for name in columns}
    altered = {**known, text_col: ascii_lower(docs[text_col].cast("string"))}
    return docs.select(
        docs[id_col].cast("long").alias("id"),
        docs[group_col].cast("string").alias("grp"),
        digest(*[framed(c) for c in known.values()]).alias("leaf"),
        F.when(tampered, digest(*[framed(c) for c in altered.values()])).alias("other"),
    )


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """The rows with ``idx``, their place from 0 within their group, and ``size``, its rows.

    Sorted by range over the cluster and written. A row's place in its partition, less that
    of its group's first row there, plus the group's rows in earlier partitions, is its
    place. The window runs over one row per group and partition.
    """
    keys = ["grp", *order]
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("number", F.monotonically_increasing_id())
    placed = written(
        placed.select(
            *rows.columns,
            F.shiftright("number", PLACE_BITS).alias("part"),
            F.col("number").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).alias("place"),
        ),
        "merkle-leaves",
    )
    pieces = placed.groupBy("grp", "part").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    of_group = Window.partitionBy("grp")
    earlier = of_group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("n").over(earlier), F.lit(0).cast("long")) - F.col("first")
    offsets = pieces.select(
        F.col("grp").alias("of"), F.col("part").alias("of_part"), offset.alias("offset"), F.sum("n").over(of_group).alias("size")
    )
    same = placed["grp"].eqNullSafe(offsets["of"]) & (placed["part"] == offsets["of_part"])
    joined = placed.join(offsets, same)
    return joined.select(*rows.columns, (F.col("place") + F.col("offset")).alias("idx"), "size")


def parents(nodes: DataFrame, payload: Column) -> DataFrame:
    """grp, idx, size, c0 .. c7, digest: every run of children as one row.

    ``payload`` is what a column holds of a child, a struct that starts with its digest. A
    group's only node has no parent and must not be here.
    """
    slot = F.col("idx") % FANOUT
    up = F.floor(F.col("idx") / FANOUT).alias("idx")
    columns = [F.max(F.when(slot == k, payload)).alias(f"c{k}") for k in range(FANOUT)]
    run = nodes.groupBy("grp", up).agg(F.max("size").alias("size"), *columns)
    children = digest(*[F.col(f"c{k}.digest") for k in range(FANOUT)])
    return run.withColumns({"digest": children, "size": F.ceil(F.col("size") / FANOUT)})


def _children(run: DataFrame, above: Column, keep: list[str]) -> DataFrame:
    """The children of every run: their fields, and the siblings of their own level before
    those of the levels ``above``."""
    rows = []
    for k in range(FANOUT):
        left = F.concat_ws("", *[F.col(f"c{j}.digest") for j in range(k)])
        right = F.concat_ws("", *[F.col(f"c{j}.digest") for j in range(k + 1, FANOUT)])
        step = F.array(F.struct(left.alias("left"), right.alias("right")))
        rows.append(
            F.when(
                F.col(f"c{k}").isNotNull(),
                F.struct(
                    (F.col("idx") * FANOUT + k).alias("idx"),
                    *[F.col(f"c{k}.{name}").alias(name) for name in keep],
                    F.concat(step, above).alias("path"),
                ),
            )
        )
    some = run.select(F.col("grp"), F.explode(F.array(*rows)).alias("child")).where(F.col("child").isNotNull())
    return some.select("grp", "child.*")


def _levels(nodes: DataFrame, payload: Column, most: int, purpose: str) -> tuple[list[DataFrame], DataFrame]:
    """The runs of every level, upwards, and the roots (grp, digest) of groups.

    ``most`` is the largest group's size, from which the number of levels follows. A group
    that is down to one node stays as it is. Each level is written: it is read once for the
    level above and once for proofs.
    """
    levels, roots = [], [nodes.where(F.col("size") == 1).select("grp", payload.getField("digest").alias("digest"))]
    while most > 1:
        run = written(parents(nodes.where(F.col("size") > 1), payload), purpose)
        levels.append(run)
        nodes, payload = run, F.struct("digest")
        roots.append(nodes.where(F.col("size") == 1).select("grp", "digest"))
        most = -(-most // FANOUT)
    whole = roots[0]
    for more in roots[1:]:
        whole = whole.unionByName(more)
    return levels, whole


def _same(left: DataFrame, right: DataFrame, *names: str) -> Column:
    condition = F.lit(True)
    for name in names:
        condition = condition & left[name].eqNullSafe(right[f"of_{name}"])
    return condition


def _proofs(levels: list[DataFrame], top: DataFrame, keep: list[str]) -> DataFrame:
    """grp, the kept fields of the lowest nodes, and their path: the siblings level by level.

    ``top`` (of_grp, above, ...) holds the siblings above a group's root. Groups end at
    different levels: where a run is its group's root, its path is that of the group.
    """
    paths = None
    for level, run in reversed(list(enumerate(levels))):
        joined = run.join(top.select("of_grp", "above"), run["grp"].eqNullSafe(top["of_grp"]))
        if paths is None:
            runs = joined.withColumn("up", F.col("above"))
        else:
            of = paths.select(F.col("grp").alias("of2_grp"), F.col("idx").alias("of2_idx"), F.col("path"))
            hit = joined["grp"].eqNullSafe(of["of2_grp"]) & (joined["idx"] == of["of2_idx"])
            runs = joined.join(of, hit, "left").withColumn("up", F.coalesce("path", "above"))
        fields = keep if level == 0 else []
        paths = _children(runs.select("grp", "idx", *[f"c{k}" for k in range(FANOUT)], "up"), F.col("up"), fields)
    return paths


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def manifest(
    docs: DataFrame,
    tampered: Column,
    columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    id_col: str = "doc_id",
    group_col: str = "lang",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: every row's proof.

    A leaf is the digest of the row's ``columns``. Leaves of a group (a language; null is one)
    ascend by id and are hashed in runs of eight, level by level, down to the group's root;
    these roots, ordered by group (null first, by UTF-8 bytes), give the table's root in the
    same way. ``tampered`` tells which rows have A-Z of their text in lower case when they are
    checked. A null id comes first, rows of one id follow each other by their leaf, so equal
    rows are leaves of their own. A null text, id or other value is a dash in its leaf; a text of
    any length is hashed whole and read once. An empty table gives no rows. Other columns are
    not read, whatever their names. Groups may be many: their roots go up like leaves.
    """
    rows = leaves(docs, list(columns), id_col, group_col, text_col, F.coalesce(tampered, F.lit(False)))
    # Written, as sorting by range looks at its rows twice.
    nodes = numbered(written(rows, "merkle-rows"), ["id", "leaf"])
    # A single row for each level's size.
    most = nodes.agg(F.max("size").alias("n")).first().n or 0
    child = F.struct(F.col("leaf").alias("digest"), "id", "other")
    levels, roots = _levels(nodes, child, most, "merkle-level")
    roots = written(roots.withColumnRenamed("digest", "subroot"), "merkle-subroots")

    groups = roots.select(F.col("grp").alias("name"), "subroot", F.lit(0).alias("grp"))
    upper = numbered(groups, ["name"])
    count = roots.count()
    above, top = _levels(upper, F.struct(F.col("subroot").alias("digest"), "name"), count, "merkle-top")
    [root] = [row.digest for row in top.collect()] or [None]
    nothing = F.array().cast(NODE)
    if above:
        start = docs.sparkSession.range(1).select(F.lit(0).alias("of_grp"), nothing.alias("above"))
        handed = _proofs(above, start, ["digest", "name"]).select(
            F.col("name").alias("of_grp"), F.col("digest").alias("subroot"), F.col("path").alias("above")
        )
    else:
        handed = roots.select(F.col("grp").alias("of_grp"), "subroot", nothing.alias("above"))
    handed = written(handed, "merkle-handed")

    fields = ["digest", "id", "other"]
    single = nodes.where(F.col("size") == 1).select("grp", F.col("leaf").alias("digest"), "id", "other")
    proofs = single.join(handed, single["grp"].eqNullSafe(handed["of_grp"])).select("grp", *fields, F.col("above").alias("path"))
    if levels:
        proofs = proofs.unionByName(_proofs(levels, handed, fields).select("grp", *fields, "path"))
    subroots = handed.select("of_grp", "subroot")
    done = proofs.join(subroots, proofs["grp"].eqNullSafe(subroots["of_grp"]))
    checked = folded(F.coalesce("other", "digest"), F.col("path"))
    return done.select(
        F.col("id").alias("doc_id"),
        F.col("digest").alias("leaf"),
        "subroot",
        F.lit(root).alias("root"),
        proof_digest(F.col("path")).alias("proof_sha256"),
        checked.alias("folded_root"),
        (checked == F.lit(root)).alias("verified"),
    )
