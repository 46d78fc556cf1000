"""A Merkle manifest of a dataset, with a proof for every row by pointer jumping.

Rows are leaves of one tree for each group; the groups' roots are the leaves of one more
tree. A node first knows the siblings between itself and its parent. Then every node asks
the node it points to for what that one knows: the siblings of both, one after the other,
lead twice as far. After log2(depth) such self-joins each leaf knows its way to the root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlens.llm.common import only_result, stored, table
from tenderlens.operators.selection import layout_positions

FAN = 3
# So many ancestors with their siblings (some tens of MB) may be broadcast; more of them are joined by a shuffle.
LISTED = 20_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_ABOVE = -1  # the tree over the groups


def field_text(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digest(*values: Column) -> Column:
    """Lowercase hex sha256 over the values of a row."""
    return F.sha2(F.concat(*[field_text(v) for v in values]), 256)


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _node(tree: Column | int, level: Column | int, pos: Column) -> Column:
    as_long = [c.cast("long") if isinstance(c, Column) else F.lit(c).cast("long") for c in (tree, level, pos)]
    return F.struct(*[c.alias(n) for c, n in zip(as_long, ("tree", "level", "pos"))])


def _levels(leaves: DataFrame, largest: int, above: Column) -> tuple[list[DataFrame], list[DataFrame]]:
    """(links, tops) of trees over ``leaves``: tree, n (leaves of the tree), pos, digest, doc.

    A link is a node, the node it points to and its path so far; ``above`` is where the
    children of a top point. A level is one aggregation over runs of at most FAN nodes, a
    third the size of the one below it. ``largest`` is the largest n, which ends the loop.
    """
    links, tops, nodes, level = [], [leaves.filter("n = 1").select("tree", "digest")], leaves, 0
    while largest > 1:
        member = F.struct("pos", "digest", "doc")
        runs = stored(
            nodes.filter("n > 1").groupBy("tree", "n", F.floor(F.col("pos") / FAN).alias("up"))
            .agg(F.array_sort(F.collect_list(member)).alias("members"))
        )
        digests = F.transform("members", lambda m: m["digest"])
        child = runs.select("tree", "n", "up", digests.alias("digests"), F.posexplode("members").alias("at", "m"))

        def joined(first: Column, count: Column) -> Column:
            return F.aggregate(F.slice("digests", first, count), F.lit(b""), lambda a, d: F.concat(a, d))

        step = F.struct(joined(F.lit(1), F.col("at")).alias("before"), joined(F.col("at") + 2, F.lit(FAN)).alias("after"))
        pointer = F.when(F.col("n") > FAN, _node(F.col("tree"), level + 1, F.col("up"))).otherwise(above)
        links.append(child.select(
            _node(F.col("tree"), level, F.col("m.pos")).alias("node"), pointer.alias("up"), F.array(step).alias("path"), F.col("m.doc").alias("doc")
        ))
        parent = F.sha2(F.array_join(F.transform(digests, _hex), ""), 256)
        nodes = runs.select(
            "tree", F.ceil(F.col("n") / FAN).alias("n"), F.col("up").alias("pos"), F.unhex(parent).alias("digest"), F.lit(None).cast(leaves.schema["doc"].dataType).alias("doc")
        )
        tops.append(nodes.filter("n = 1").select("tree", "digest"))
        largest, level = -(-largest // FAN), level + 1
    return links, tops


def _union(parts: list[DataFrame]) -> DataFrame:
    first, *rest = parts
    for p in rest:
        first = first.unionByName(p)
    return first


def _jump(state: DataFrame) -> DataFrame:
    """Every node's path to the root: rounds in which each open node takes over the path of the node it points to."""
    distance = 1
    while True:
        waiting = state.filter("up IS NOT NULL")
        if waiting.isEmpty():
            return state
        # Nothing that is pointed to lies lower than the distance covered, but for the tops of small trees.
        asked = state.filter((F.col("doc").isNull()) & ((F.col("node.level") >= distance) | (F.col("node.tree") == _ABOVE)))
        asked = asked.select(F.col("node").alias("_node"), F.col("up").alias("_up"), F.col("path").alias("_path"))
        few = asked.limit(LISTED + 1).count() <= LISTED
        joined = waiting.join(F.broadcast(asked) if few else asked, F.col("up") == F.col("_node")).select(
            "node", F.col("_up").alias("up"), F.concat("path", "_path").alias("path"), "doc"
        )
        state = stored(joined.unionByName(state.filter("up IS NULL")))
        distance *= 2


def manifest(rows: DataFrame, group: Column, order: Column, digest: Column, **carried: Column) -> DataFrame:
    """One row per input row: group, order, the carried columns, leaf, subroot, root and path.

    ``digest`` is a row's leaf in hex. In each group leaves ascend by ``order`` (null first,
    equal ones by leaf); while a group has several nodes, every three consecutive ones become
    the digest of their hex digests, a shorter last run too, even of one node. The groups'
    roots (``subroot``), ordered by group (null first, by UTF-8 bytes), become ``root``
    likewise. ``path`` has a step for each level: the digests (binary) before and after the
    node in its run. No row is read but through the given columns. An empty table has no
    rows, a single row is its own root.
    """
    leaves = rows.select(group.alias("group"), order.alias("order"), F.unhex(digest).alias("leaf"), *[c.alias(n) for n, c in carried.items()])
    placed = stored(layout_positions(leaves, ["group"], [F.col("order").asc_nulls_first(), F.col("leaf")], "pos"))
    sizes = placed.groupBy("group").agg(F.count("*").alias("n"))
    groups = stored(layout_positions(sizes, [], [F.col("group").asc_nulls_first()], "tree"))
    many, largest = groups.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    doc = F.struct("group", "order", "leaf", *carried)
    named = groups.withColumnsRenamed({"group": "_group"})
    nodes = placed.join(named, F.col("group").eqNullSafe(F.col("_group"))).select("tree", "n", "pos", F.col("leaf").alias("digest"), doc.alias("doc"))
    nothing = F.lit(None).cast("struct<tree: bigint, level: bigint, pos: bigint>")
    above = _node(_ABOVE, 0, F.col("tree")) if many > 1 else nothing
    links, tops = _levels(nodes, largest, above)
    subroots = stored(_union(tops))
    crowns = subroots.select(F.lit(_ABOVE).cast("long").alias("tree"), F.lit(many).alias("n"), F.col("tree").alias("pos"), "digest", F.lit(None).cast(nodes.schema["doc"].dataType).alias("doc"))
    upper, root = _levels(crowns, many, nothing)
    empty = F.lit(None).cast("array<struct<before: binary, after: binary>>")
    lone = nodes.filter("n = 1").select(
        _node(F.col("tree"), 0, F.col("pos")).alias("node"), above.alias("up"), F.coalesce(empty, F.array().cast("array<struct<before: binary, after: binary>>")).alias("path"), "doc"
    )
    known = _jump(stored(_union([*links, *upper, lone])))
    top = _union(root).first()
    return (
        known.filter("doc IS NOT NULL").select(F.col("node.tree").alias("tree"), "doc.*", "path")
        .join(subroots.withColumnRenamed("digest", "subroot"), "tree")
        .select("group", "order", *carried, "leaf", "subroot", F.lit(bytes(top["digest"]) if top else None).cast("binary").alias("root"), "path")
    )


def siblings_digest(path: Column) -> Column:
    """sha256 of all siblings on the way, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(_hex(s["before"]), _hex(s["after"]))), ""), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root (hex) that a leaf (hex) gives with the siblings of a path."""
    return F.aggregate(path, leaf, lambda a, s: F.sha2(F.concat(_hex(s["before"]), a, _hex(s["after"])), 256))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of the documents by source; where 2 divides the crc32 of the doc_id, a text has lost its line feeds.

    A null doc_id has no crc32: its row is verified as it is.
    """
    docs = table(spark, sf_dir, "documents")
    fields = {name: F.col(name) for name in FIELDS}
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    altered = row_digest(*(fields | {"text": F.replace("text", F.lit("\n"), F.lit(""))}).values())
    leaf = row_digest(*fields.values())

    def build() -> DataFrame:
        proofs = manifest(docs, F.col("source"), F.col("doc_id"), leaf, altered=F.when(tampered, F.unhex(altered)))
        found = proofs.select(
            F.col("order").alias("doc_id"), *[_hex(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")],
            siblings_digest(F.col("path")).alias("proof_sha256"),
            fold(_hex(F.coalesce("altered", "leaf")), F.col("path")).alias("folded_root"),
        )
        return found.withColumn("verified", F.col("folded_root") == F.col("root"))

    return only_result(spark, build)


_CRC_STEPS = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0]::ubigint[], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))"
_CRC = f"list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ord(c)::ubigint)), lambda a, b: {_CRC_STEPS})"


def _leaf_sql(text: str) -> str:
    parts = [f"coalesce(strlen({e}::varchar) || ':' || {e}::varchar, '-')" for e in (*FIELDS[:-1], text)]
    return f"sha256({' || '.join(parts)})"


# The bits of the reduction are those of the crc32 before its last xor with ones: 2 divides the crc32 where its low bit is 1.
OP12_SQL = f"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, {_leaf_sql('text')} AS leaf,
    CASE WHEN ({_CRC}) % 2 = 1 THEN {_leaf_sql("replace(text, chr(10), '')")} ELSE {_leaf_sql('text')} END AS given,
    dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS grp, source
  FROM documents),
leaves AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM d),
tree(grp, level, pos, n, digest) AS (
  SELECT grp, 0, pos, n, leaf FROM leaves
  UNION ALL
  SELECT grp, level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM tree WHERE n > 1 GROUP BY grp, level, pos // 3, n),
subroots AS MATERIALIZED (SELECT grp, level AS depth, digest AS subroot FROM tree WHERE n = 1),
crown(level, pos, n, digest) AS (
  SELECT 0, grp, (SELECT count(*) FROM subroots), subroot FROM subroots
  UNION ALL
  SELECT level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM crown WHERE n > 1 GROUP BY level, pos // 3, n),
steps AS MATERIALIZED (
  SELECT a.grp, a.level, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS before,
    coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS after
  FROM tree a JOIN tree b ON a.grp = b.grp AND a.level = b.level AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY ALL
  UNION ALL
  SELECT -1, a.level, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), ''),
    coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '')
  FROM crown a JOIN crown b ON a.level = b.level AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY ALL),
walk(doc_id, leaf, grp, lvl, pos, own, siblings, folded) AS (
  SELECT doc_id, leaf, CASE WHEN n = 1 THEN -1 ELSE grp END, 0, CASE WHEN n = 1 THEN grp ELSE pos END, grp, '', given FROM leaves
  UNION ALL
  SELECT doc_id, leaf, CASE WHEN top THEN -1 ELSE grp END, CASE WHEN top THEN 0 ELSE lvl + 1 END, CASE WHEN top THEN own ELSE pos // 3 END, own,
    siblings || before || after, sha256(before || folded || after)
  FROM (SELECT w.*, s.before, s.after, w.grp >= 0 AND w.lvl + 1 = u.depth AS top
    FROM walk w JOIN steps s ON s.grp = w.grp AND s.level = w.lvl AND s.pos = w.pos JOIN subroots u ON u.grp = w.own)),
ends AS (SELECT *, row_number() OVER (PARTITION BY doc_id, leaf ORDER BY strlen(siblings) DESC, grp, lvl DESC) AS k FROM walk)
SELECT e.doc_id, e.leaf, u.subroot, r.digest AS root, sha256(e.siblings) AS proof_sha256, e.folded AS folded_root, e.folded = r.digest AS verified
FROM ends e JOIN subroots u ON u.grp = e.own, (SELECT digest FROM crown WHERE n = 1) r WHERE e.k = 1
"""
