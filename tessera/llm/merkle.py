"""Merkle manifest of a table, with versions made by path copying.

A row's leaf is a digest of its columns. The leaves of a group, in the order of their
keys, are the lowest level of the group's tree; every two neighbours have one parent (an
odd last node has a parent of its own) until one is left. The groups' tops, in the
order of the groups, are the leaves of one more such tree.

The tree is built in aligned blocks of ``2 ** HEIGHT`` nodes, each a row of a
written table, so no task holds more than a block of any group: a block turns into its top,
the tops are the nodes of the next blocks, until every group has one node. Then the
way back: every block learns the siblings on the way from its top to the root.

The tree is persistent: a version in which one leaf changed shares all nodes
that are not above it. ``Block.version`` copies only the ancestors inside the block; the
version goes on from the block's top with the siblings that came down, wherever the block is,
so versions are as spread as the leaves, whatever block or group has most of them.
What a version owns are its ``copied`` nodes, lowest first, root last.

Null values have a digest form of their own, null groups are a group (the first) and null
keys stand first in their group; empty and very long texts are hashed whole. Rows that
share a key are leaves of their own, in the order of their digests. An empty table gives
an empty result. Only the named columns are read, whatever other columns there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import boundary
from tessera.plans import prefix
from tessera.plans.joins import join_checked

HEIGHT = 10  # levels of a block: 1,024 nodes
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(columns: list[Column]) -> Column:
    """SHA-256 over all values, each with its length; null is a sign of its own."""
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c.cast("string")), F.lit(":"), c.cast("string")), F.lit("-"))
                             for c in columns]), 256)


def digest(*nodes: str) -> str:
    return hashlib.sha256("".join(nodes).encode("ascii")).hexdigest()


class Block:
    """Nodes of a block by level, and versions that share them. ``total``: nodes of
    the whole level that the block is a part of."""

    def __init__(self, nodes: list[str], total: int, height: int = HEIGHT):
        self.levels = [nodes]
        for _ in range(levels_of(total, height)):
            low = self.levels[-1]
            self.levels.append([digest(*low[i:i + 2]) for i in range(0, len(low), 2)])
        self.top = self.levels[-1][0]

    def siblings(self, i: int) -> list[str | None]:
        """What stands beside the way up from node ``i``; None where nothing does."""
        out = []
        for level in self.levels[:-1]:
            out.append(level[i ^ 1] if i ^ 1 < len(level) else None)
            i >>= 1
        return out

    def version(self, i: int, node: str) -> list[str]:
        """The copied ancestors of node ``i`` after it became ``node``; all else is shared."""
        return climb(i, node, self.siblings(i))


def levels_of(total: int, height: int) -> int:
    """Levels that a block of a level of ``total`` nodes adds: all, or up to the one node left."""
    return min(height, (total - 1).bit_length())


def climb(i: int, node: str, siblings: list[str | None]) -> list[str]:
    """Ancestors of ``node``, the ``i``-th of its level, lowest first."""
    out = []
    for beside in siblings:
        node = digest(node) if beside is None else digest(beside, node) if i & 1 else digest(node, beside)
        out.append(node)
        i >>= 1
    return out


def _blocks(nodes: DataFrame, height: int, member: list[str]) -> DataFrame:
    """One row per block of ``(g, pos, n, node, ...)``, with its members in order and its top."""
    packed = (nodes.groupBy("g", F.shiftright("pos", height).alias("block"), "n")
              .agg(F.sort_array(F.collect_list(F.struct("pos", "node", *member))).alias("members")))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tops = [Block(_nodes(m), n, height).top
                    for m, n in zip(batch.column("members"), batch.column("n").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tops, pa.string())], [*batch.schema.names, "top"])

    return boundary(packed.mapInArrow(add, T.StructType([*packed.schema.fields, T.StructField("top", T.StringType())])))


def _nodes(members: pa.Scalar) -> list[str]:
    return members.values.field("node").to_pylist()


def _levels(nodes: DataFrame, height: int, member: list[str]) -> list[DataFrame]:
    """Block tables from the leaves up, until every group has one block."""
    out = []
    while True:
        out.append(_blocks(nodes, height, [] if out else member))
        most = out[-1].agg(F.max("block")).first()[0]
        if not most:
            return out
        count = F.ceil(F.col("n") / (1 << height)).cast("long")
        nodes = out[-1].select("g", F.col("block").alias("pos"), count.alias("n"), F.col("top").alias("node"))


PATH = "g string, block long, path array<string>, turns array<boolean>"


def _down(levels: list[DataFrame], tops: DataFrame, height: int) -> DataFrame:
    """The way to the root from the top of every block of the lowest level: siblings, and
    whether the way comes from the right. ``tops``: that of each group's last block."""
    paths = tops
    for level in reversed(levels[1:]):
        paths = boundary(_members(level.select("g", "block", "n", "members"), paths, height))
    return paths


def _members(blocks: DataFrame, paths: DataFrame, height: int) -> DataFrame:
    """``PATH`` rows of the members of ``blocks``, whose own ways are ``paths``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g, at, path, turns = [], [], [], []
            for row in range(batch.num_rows):
                x = {c: batch.column(c)[row] for c in batch.schema.names}
                block, upper, from_right = Block(_nodes(x["members"]), x["n"].as_py(), height), x["path"].as_py(), x["turns"].as_py()
                for i, pos in enumerate(x["members"].values.field("pos").to_pylist()):
                    own = block.siblings(i)
                    g.append(x["g"].as_py())
                    at.append(pos)
                    path.append(own + upper)
                    turns.append([bool(i >> j & 1) for j in range(len(own))] + from_right)
            yield pa.RecordBatch.from_arrays(
                [pa.array(g, pa.string()), pa.array(at, pa.int64()), pa.array(path, pa.list_(pa.string())),
                 pa.array(turns, pa.list_(pa.bool_()))], ["g", "block", "path", "turns"])

    return blocks.join(paths, ["g", "block"]).mapInArrow(run, PATH)


def manifest(df: DataFrame, key: str = "doc_id", group: str = "lang", columns: tuple[str, ...] = COLUMNS,
             changed: dict[str, Column] | None = None, where: Column | None = None, height: int = HEIGHT) -> DataFrame:
    """One row per row of ``df``: its ``key``, ``leaf``, the group's top ``subroot``, the
    ``root``, its ``siblings`` up to the root (null where there is none) and ``turns``
    (whether the way comes from the right). With ``changed`` columns, rows that match
    ``where`` also have the version in which they changed: ``changed_leaf`` and the
    ``copied`` nodes, root last."""
    own = [F.col(c) for c in columns]
    other = [(changed or {}).get(c, F.col(c)) for c in columns]
    hit = F.coalesce(where, F.lit(False)) if where is not None else F.lit(False)
    # "0" is the null group, so that it stands first; strings are ordered by their bytes
    named = F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0"))
    leaves = boundary(df.select(named.alias("g"), F.col(key).alias("key"), leaf(own).alias("node"),
                                F.when(hit, leaf(other)).alias("other")))
    order = ["g", F.asc_nulls_first("key"), "node"]
    numbered = boundary(prefix.row_number(leaves, order, "at"))
    groups = numbered.groupBy("g").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    placed = join_checked(numbered, groups, ["g"]).withColumn("pos", F.col("at") - F.col("first"))
    levels = _levels(placed, height, ["key", "other"])
    subroots = levels[-1].select("g", F.col("top").alias("node"))
    ranked = boundary(prefix.row_number(subroots, ["g"], "pos").withColumnRenamed("g", "member"))
    count = ranked.count()
    above = _levels(ranked.select(F.lit("").alias("g"), "pos", F.lit(count).cast("long").alias("n"), "node"), height, [])
    root = above[-1].select("top").first()
    spark = df.sparkSession
    last = spark.createDataFrame([("", 0, [], [])], PATH)
    ways = _down([None, *above], last, height)
    tops = ways.select(F.col("block").alias("pos"), "path", "turns").join(ranked, "pos").select(
        F.col("member").alias("g"), F.lit(0).cast("long").alias("block"), "path", "turns", F.col("node").alias("subroot"))
    paths = _down(levels, tops.select("g", "block", "path", "turns"), height)
    with_top = levels[0].select("g", "block", "n", "members").join(paths, ["g", "block"])
    with_top = join_checked(with_top, tops.select("g", "subroot"), ["g"])
    kind = T.StructType([
        T.StructField("key", df.schema[key].dataType),
        *T._parse_datatype_string("leaf string, subroot string, root string, siblings array<string>, turns array<boolean>, "
                                  "changed_leaf string, copied array<string>").fields])
    top = root[0] if root else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                x = {c: batch.column(c)[row] for c in batch.schema.names}
                members, size = x["members"].values, len(x["members"])
                nodes, others = members.field("node"), members.field("other")
                block = Block(nodes.to_pylist(), x["n"].as_py(), height)
                upper, from_right, at = x["path"].as_py(), x["turns"].as_py(), x["block"].as_py()
                siblings, turns, copied = [], [], []
                # the number of a node above the block, from the turns that its way takes
                place = sum(t << j for j, t in enumerate(from_right))
                for i, new in enumerate(others.to_pylist()):
                    beside = block.siblings(i)
                    siblings.append(beside + upper)
                    turns.append([bool(i >> j & 1) for j in range(len(beside))] + from_right)
                    if new is None:
                        copied.append(None)
                    else:
                        low = block.version(i, new)
                        copied.append(low + climb(place, low[-1] if low else new, upper))
                yield pa.RecordBatch.from_arrays(
                    [members.field("key"), nodes, pa.array([x["subroot"].as_py()] * size, pa.string()),
                     pa.array([top] * size, pa.string()), pa.array(siblings, pa.list_(pa.string())),
                     pa.array(turns, pa.list_(pa.bool_())), others, pa.array(copied, pa.list_(pa.string()))],
                    kind.names)

    return with_top.mapInArrow(run, kind).withColumnRenamed("key", key)


def fold(leaf: Column, siblings: Column, turns: Column) -> Column:
    """The root that ``leaf`` leads to with its siblings, as a column expression."""
    steps = F.arrays_zip(siblings.alias("s"), turns.alias("t"))
    return F.aggregate(steps, leaf, lambda node, x: F.sha2(
        F.when(x["s"].isNull(), node).when(x["t"], F.concat(x["s"], node)).otherwise(F.concat(node, x["s"])), 256))


def proofs(built: DataFrame, key: str = "doc_id") -> DataFrame:
    """Digest columns of ``manifest``: every row's changed leaf, or else its own, is
    folded with the original siblings and compared with the root."""
    siblings = F.filter("siblings", lambda s: s.isNotNull())
    folded = fold(F.coalesce("changed_leaf", "leaf"), F.col("siblings"), F.col("turns"))
    return (built.withColumn("folded_root", F.coalesce(F.get("copied", F.size("copied") - 1), folded))
            .select(key, "leaf", "subroot", "root", F.sha2(F.array_join(siblings, ""), 256).alias("proof_sha256"),
                    "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")))


def _sql_leaf(values: list[str]) -> str:
    return "sha256(" + " || ".join(
        f"coalesce(strlen({v}::VARCHAR)::VARCHAR || ':' || {v}::VARCHAR, '-')" for v in values) + ")"


def _sql_tree(name: str, leaves: str, levels: int) -> str:
    """Level tables ``name0`` to ``name<levels>`` of ``leaves`` (g, p, h)."""
    out = [f"{name}0 AS MATERIALIZED (SELECT g, p, h FROM {leaves})"]
    out += [f"""{name}{k + 1} AS MATERIALIZED (
  SELECT g, p // 2 AS p, CASE WHEN max(c) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY p)) END AS h
  FROM (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM {name}{k}) GROUP BY g, p // 2)""" for k in range(levels)]
    return ",\n".join(out)


def _sql_fold(name: str, rows: str, tree: str, levels: int) -> str:
    """``name<levels>``: ``rows`` (rid, g, p, n, f, s) with ``f`` folded up the tree and its siblings added to ``s``."""
    out = [f"{name}0 AS (SELECT rid, g, p, n, f, s FROM {rows})"]
    out += [f"""{name}{k + 1} AS (SELECT rid, r.g, r.p, n, CASE WHEN ((n - 1) >> {k}) = 0 THEN f WHEN x.h IS NULL THEN sha256(f)
  WHEN (r.p >> {k}) & 1 = 1 THEN sha256(x.h || f) ELSE sha256(f || x.h) END AS f, s || coalesce(x.h, '') AS s
  FROM {name}{k} r LEFT JOIN {tree}{k} x ON x.g = r.g AND x.p = xor(r.p >> {k}, 1))""" for k in range(levels)]
    return ",\n".join(out)


_DOWN, _ACROSS = 24, 8  # levels: as many as 2 ** 24 rows of a group and 2 ** 8 groups need
_CRC = """xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda a, b:
  list_reduce(list_transform(range(8), lambda i: i::BIGINT), lambda x, i: CASE WHEN x & 1 = 1
    THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END, xor(a, b)), 4294967295::BIGINT), 4294967295::BIGINT)"""
SQL = f"""
WITH base AS MATERIALIZED (
  SELECT rid, doc_id, g, leaf, CASE WHEN crc % 7 = 0 THEN other ELSE leaf END AS f,
         row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY g) AS n
  FROM (SELECT row_number() OVER () AS rid, doc_id, coalesce('1' || lang, '0') AS g, {_sql_leaf(list(COLUMNS))} AS leaf,
               {_sql_leaf(["(n_chars + 1)" if c == "n_chars" else c for c in COLUMNS])} AS other, {_CRC} AS crc FROM documents)),
leaves AS (SELECT g, p, leaf AS h FROM base),
{_sql_tree("t", "leaves", _DOWN)},
tops AS MATERIALIZED (SELECT '' AS g, row_number() OVER (ORDER BY t.g) - 1 AS p, t.h, t.g AS own, count(*) OVER () AS n
                      FROM t{_DOWN} t),
{_sql_tree("u", "tops", _ACROSS)},
start AS (SELECT rid, g, p, n, f, '' AS s FROM base),
{_sql_fold("r", "start", "t", _DOWN)},
across AS (SELECT r.rid, tops.g, tops.p, tops.n, r.f, r.s FROM r{_DOWN} r JOIN tops ON r.g = tops.own),
{_sql_fold("v", "across", "u", _ACROSS)}
SELECT doc_id, leaf, tops.h AS subroot, u.h AS root, sha256(v.s) AS proof_sha256, v.f AS folded_root, v.f = u.h AS verified
FROM base JOIN v{_ACROSS} v USING (rid) JOIN tops ON base.g = tops.own, u{_ACROSS} u
"""
