"""Mixing sources to target weights by iterative proportional fitting.

Token totals of the cells (source, language, topic) are raked until their sums
by source, by language and by topic are the target shares. Each document is
then kept with the probability of its cell, by a hash of its id, so the draw
is the same on every run and in every task.

Targets name the values of a dimension. All other values, nulls too, are one
class ``*`` that keeps its share of the corpus; the named targets share the
rest in proportion, among the values that hold tokens. The cells are at most
the product of the targets' sizes, whatever the data, which bounds what the
driver rakes and what every task holds.

The cells are one partial aggregate over a scan (a hot source is one row per
cell and task) and the draw is a join with the broadcast cells: no row is shuffled. Margins
that no weights can meet leave a gap, which is warned of; the cells then are as the last round left them.

``p = min(1, rate * factor)`` where ``factor`` is target over corpus tokens of
the cell and ``rate`` makes the expected tokens ``fraction`` of the corpus. Cells
that would need more than they have are kept whole; ``weight = rate * factor / p``
is the weight a kept document needs for the marginals to hold (1 elsewhere).

Null and empty texts have no tokens and are never kept; very long ones count whole. Rows
with a null id are drawn by their text, rows that share an id are kept or left together. An
empty table gives an empty result. Columns named ``_tokens``, ``_weight``, ``_prob`` and
``_sampled`` are replaced; a column ``topic`` is taken as the topic; all others are untouched.
"""

from __future__ import annotations

import functools
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import free_names

REST = "*"
TOLERANCE = 1e-12
PATIENCE = 50  # rounds without a smaller gap after which the margins are taken to conflict
BROADCAST_CELLS = 200_000  # some 50 bytes each
SQL_ROUNDS = 60  # unrolled in the SQL twin, enough for the registered targets
WORD = r"[^\x20\x09-\x0D]+"


def tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def topic_by_size(n_tokens: Column) -> Column:
    """The driver tables name no topic; the size class stands in for one."""
    return F.when(n_tokens < 100, "short").when(n_tokens < 800, "article").otherwise("long")


def _key(value: Column, names) -> Column:
    return F.when(value.isin(list(names)), value).otherwise(REST) if names else F.lit(REST)


def shares(targets: dict[str, float], present: dict[str, float]) -> dict[str, float]:
    """Target share of every present value; ``present`` are corpus tokens."""
    total = sum(present.values())
    rest = present.get(REST, 0) / total if total else 0.0
    named = {k: targets[k] for k, n in present.items() if k != REST and n > 0 and targets[k] > 0}
    whole = sum(named.values())
    if not whole:
        return {REST: 1.0 if present.get(REST) else 0.0}
    return {REST: rest, **{k: v / whole * (1 - rest) for k, v in named.items()}}


def rake(cells: list[tuple], targets: list[dict[str, float]]) -> tuple[np.ndarray, float]:
    """Token share of every cell ``(key, ..., tokens)`` after raking, and the largest gap left
    to a margin. Rounds go on until that is ``TOLERANCE``, or has not fallen for ``PATIENCE``
    rounds: then no weights of these cells meet all margins."""
    n = np.array([c[-1] for c in cells], np.float64)
    if not n.sum():
        return np.zeros(len(cells)), 0.0
    w = n / n.sum()
    margins = []
    for d, wanted in enumerate(targets):
        keys = [c[d] for c in cells]
        place = {k: i for i, k in enumerate(sorted(set(keys)))}
        at = np.array([place[k] for k in keys])
        sums = np.bincount(at, n)
        goal = shares(wanted, {k: sums[i] for k, i in place.items()})
        margins.append((at, np.array([goal.get(k, 0.0) for k in sorted(place)])))
    least, stale = np.inf, 0
    while True:
        gap = 0.0
        for at, goal in margins:
            now = np.bincount(at, w, minlength=len(goal))
            gap = max(gap, float(np.abs(now - goal).max()))
            w = w * np.divide(goal, now, out=np.zeros_like(goal), where=now > 0)[at]
        stale = 0 if gap < least * (1 - 1e-6) else stale + 1
        least = min(least, gap)
        if gap < TOLERANCE or stale >= PATIENCE:
            return w, gap


def probabilities(n: np.ndarray, w: np.ndarray, fraction: float) -> tuple[np.ndarray, np.ndarray]:
    """Keeping probability and weight of every cell."""
    total = n.sum()
    factor = np.divide(w * total, n, out=np.zeros(len(n)), where=n > 0)
    order = np.argsort(-factor, kind="stable")
    budget = fraction * total
    # the largest factors are kept whole until the rate leaves the next one below 1
    whole = np.concatenate([[0.0], np.cumsum(n[order])])
    left = np.concatenate([np.cumsum((n * factor)[order][::-1])[::-1], [0.0]])
    rate = 0.0
    for j in range(len(n)):
        if left[j] <= 0:
            break
        rate = (budget - whole[j]) / left[j]
        if rate * factor[order[j]] <= 1:
            break
    p = np.minimum(1.0, rate * factor)
    return p, np.divide(rate * factor, p, out=np.ones(len(n)), where=p > 0)


def uniform(id_col: Column, text: Column, seed: int) -> Column:
    """A number in [0, 1) from the id (from the text where it is null)."""
    key = F.coalesce(id_col.cast("string"), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 8), 16, 10).cast("double") / float(1 << 32)


def mix(df: DataFrame, targets: dict[str, dict[str, float]], fraction: float, id_col: str = "doc_id",
        text: str = "text", seed: int = 42) -> DataFrame:
    """``df`` with ``_tokens``, ``_weight``, ``_prob`` and ``_sampled`` (columns of
    these names in ``df`` are replaced).

    ``targets``: by column name, the wanted share of its values. Every document
    of a cell without tokens (empty texts) has the probability 0."""
    dims = list(targets)
    keyed = df.withColumn("_tokens", tokens(F.col(text)))
    keys = free_names(df, *[f"_k_{d}" for d in dims])
    (cell,) = free_names(df, "_cell")
    for k, d in zip(keys, dims):
        keyed = keyed.withColumn(k, _key(F.col(d), targets[d]))
    cells = [tuple(r) for r in keyed.groupBy(*keys).agg(F.sum("_tokens").alias("n")).orderBy(*keys).collect()]
    n = np.array([c[-1] for c in cells], np.float64)
    w, gap = rake(cells, list(targets.values()))
    if gap > 1e-6:
        warnings.warn(f"the targets conflict: a margin is missed by {gap:.3g} of the tokens", stacklevel=2)
    p, weight = probabilities(n, w, fraction)
    named = free_names(keyed, *[f"_c{i}" for i in range(len(keys))])
    table = df.sparkSession.createDataFrame(
        [(*c[:-1], (float(a), float(b))) for c, a, b in zip(cells, p, weight)],
        ", ".join(f"`{c}` string" for c in named) + f", `{cell}` struct<p: double, w: double>")
    # one row per cell; the cells are at most the product of the targets' sizes
    small = F.broadcast(table) if len(cells) <= BROADCAST_CELLS else table
    same = functools.reduce(lambda x, y: x & y, [keyed[k] == small[c] for k, c in zip(keys, named)])
    keyed = keyed.join(small, same, "left").drop(*named)
    out = (keyed.withColumn("_prob", F.coalesce(F.col(cell)["p"], F.lit(0.0)))
           .withColumn("_weight", F.coalesce(F.col(cell)["w"], F.lit(1.0))))
    drawn = uniform(F.col(id_col), F.col(text), seed) < F.col("_prob")
    return out.withColumn("_sampled", drawn).drop(cell, *keys)


# The targets of the registered query and of the pipeline.
TARGETS = {
    "source": {f"src{i}": 0.24 if i == 0 else 0.04 for i in range(20)},
    "lang": {"en": 0.5, "de": 0.2, "fr": 0.18, "es": 0.12},
    "topic": {"short": 0.02, "article": 0.68, "long": 0.3},
}
FRACTION = 0.6


def mixed_documents(docs: DataFrame, targets: dict = TARGETS, fraction: float = FRACTION) -> DataFrame:
    """Documents mixed to ``targets``, with their size class as ``topic`` unless they have one."""
    if "topic" not in docs.columns:
        docs = docs.withColumn("topic", topic_by_size(tokens(F.col("text"))))
    return mix(docs, targets, fraction)


def _sql() -> str:
    dims = ("source", "lang", "topic")

    def key(d: str) -> str:
        names = ", ".join(f"'{v}'" for v in TARGETS[d])
        return f"CASE WHEN {d} IN ({names}) THEN {d} ELSE '{REST}' END AS k_{d}"

    def goal(d: str) -> str:
        rows = ", ".join(f"('{k}', {v})" for k, v in TARGETS[d].items())
        return f"""
goal_{d} AS (SELECT k_{d}, CASE WHEN k_{d} = '{REST}' THEN share
             ELSE coalesce(v, 0) / sum(v) OVER () * (1 - coalesce(sum(share) FILTER (k_{d} = '{REST}') OVER (), 0)) END AS goal
             FROM (SELECT k_{d}, sum(n) / (SELECT sum(n) FROM cells) AS share FROM cells GROUP BY k_{d} HAVING sum(n) > 0)
             LEFT JOIN (VALUES {rows}) AS t(k_{d}, v) USING (k_{d}))"""

    steps, last = [], "start"
    for i in range(SQL_ROUNDS):
        for d in dims:
            steps.append(f"w{i}_{d} AS MATERIALIZED (SELECT {', '.join(f'k_{x}, goal_{x}' for x in dims)}, n, "
                         f"w * goal_{d} / sum(w) OVER (PARTITION BY k_{d}) AS w FROM {last})")
            last = f"w{i}_{d}"
    join = " ".join(f"JOIN (SELECT k_{d}, goal AS goal_{d} FROM goal_{d}) USING (k_{d})" for d in dims)
    keys = ", ".join(f"k_{d}" for d in dims)
    return f"""
WITH sized AS (SELECT doc_id, source, lang, coalesce(text, '') AS t,
               len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS n FROM documents),
docs AS (SELECT *, CASE WHEN n < 100 THEN 'short' WHEN n < 800 THEN 'article' ELSE 'long' END AS topic FROM sized),
keyed AS (SELECT *, {", ".join(map(key, dims))} FROM docs),
cells AS (SELECT {keys}, sum(n)::DOUBLE AS n FROM keyed GROUP BY ALL),
{",".join(map(goal, dims))},
start AS (SELECT {', '.join(f'k_{x}, goal_{x}' for x in dims)}, n, n / sum(n) OVER () AS w FROM cells {join} WHERE n > 0),
{", ".join(steps)},
factors AS (SELECT {keys}, n, w * sum(n) OVER () / n AS f, sum(n) OVER () AS total FROM {last}),
ranked AS (SELECT *, coalesce(sum(n) OVER (ORDER BY f DESC, {keys} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS whole,
           sum(n * f) OVER (ORDER BY f DESC, {keys} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM factors),
rates AS (SELECT *, ({FRACTION} * total - whole) / rest AS rate FROM ranked WHERE rest > 0),
rate AS (SELECT max_by(rate, f) AS rate FROM rates WHERE rate * f <= 1),
probs AS (SELECT {keys}, least(1, rate * f) AS p, greatest(1, rate * f) AS w FROM factors, rate),
joined AS (SELECT doc_id, source, lang, topic, keyed.n, coalesce(p, 0) AS p, coalesce(w, 1) AS w,
           ('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, md5(t))), 1, 8))::BIGINT / 4294967296.0 AS u
           FROM keyed LEFT JOIN probs USING ({keys}))
SELECT doc_id, source, lang, topic, n::BIGINT AS n_tokens, round(w, 6) AS weight, round(p, 6) AS prob,
       u::DOUBLE < p AS sampled FROM joined
"""


SQL = _sql()
