"""Mixing sources to target weights by hierarchical budgets.

The token budget is divided down a tree domain -> language -> source. At every node the children share the node's budget
in proportion to their weights, but none gets more than its subtree can supply; what a short child leaves goes to its
siblings, and only what all siblings together cannot use is missing one level up, where the node itself is short. A
leaf's supply is its tokens times ``epochs``. Its stream is the seeded order of epoch 1, then of epoch 2, and so on; the
leaf takes the longest prefix of whole documents within its budget.

At scale: token counts are one map-side aggregation per (leaf, hash bucket); the cut of each leaf's last epoch is found
first among its ``BUCKETS`` hash buckets, then among those of the one bucket it falls into, and so on until that holds
``EDGE_ROWS`` rows at most, so no leaf is ever sorted whole, however large. The selection is then a filter by cut, without
a shuffle of texts while the table of leaves is small (its size is checked).

The levels of the tree are a parameter. By default they are ``domain`` (the column of that name; without one the letters
that the source's name begins with), ``lang_key`` (the language) and ``source_key`` (the source).

Defined cases: a null level value is a node of its own (''); null or empty text has no tokens and is taken with its prefix;
a leaf without tokens is taken in every epoch; repeated ids are ordered by text; weights not named count as 1; an empty
table gives none; input columns with the name of a level, ``epoch`` or ``n_tokens`` are kept as ``in_<name>``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import make_room, table, written

LEVELS = ("domain", "lang_key", "source_key")
DIGITS = 2
BUCKETS = 16**DIGITS
EDGE_ROWS = 200_000
BROADCAST_LEAVES = 20_000
#: The query's mix: half the corpus' tokens, German and French above their share, long-named sources half the weight. The
#: given tables have no domain, so the query takes the length of the source's name for one.
WEIGHTS = {"domain": {"d4": 2, "d5": 1}, "lang_key": {"en": 4, "de": 3, "fr": 3, "es": 2}, "source_key": {"src0": 3}}
SHARE = (1, 2)
EPOCHS = 2
SEED = "mix-1"

_WORD = "[^\\x20\\x09-\\x0D]+"


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def default_levels(docs: DataFrame) -> dict[str, Column]:
    source = F.coalesce(F.col("source"), F.lit(""))
    domain = F.col("domain") if "domain" in docs.columns else F.regexp_extract(source, "^[A-Za-z]*", 0)
    return dict(zip(LEVELS, (domain, F.col("lang"), source), strict=True))


def _order(seed: str, epoch: Column) -> Column:
    """Seeded place of a document in an epoch: hex digits, so that a prefix of them is a bucket."""
    return F.md5(F.concat_ws(":", F.lit(seed), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def _weight(level: str, weights: Mapping[str, Mapping[str, int]]) -> Column:
    own = weights.get(level, {})
    out = F.lit(1)
    for name, w in own.items():
        out = F.when(F.col(level) == name, w).otherwise(out)
    return out.cast("long")


def share_out(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Add ``quota``: each parent's ``budget`` shared by ``weight`` with no child above ``cap``; whole tokens.

    The children in order of cap / weight are filled to their cap as long as the even level exceeds it; the others share
    what is left. A parent is one group: its size is the number of children of a tree node, not of documents.
    """
    order = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("weight"), name)
    before, upward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    spent, rest = F.coalesce(F.sum("cap").over(before), F.lit(0)), F.sum("weight").over(upward)
    steps = nodes.withColumns({"spent": spent, "rest": rest})
    full = F.col("cap") * F.col("rest") <= F.col("weight") * (F.col("budget") - F.col("spent"))
    steps = steps.withColumn("full", F.min(F.when(full, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    first = Window.partitionBy(*parent)
    level = steps.withColumns({"pool": F.max(F.when(~F.col("full"), F.col("budget") - F.col("spent"))).over(first), "open_weight": F.max(F.when(~F.col("full"), F.col("rest"))).over(first)})
    return level.withColumn("quota", F.when(F.col("full"), F.col("cap")).otherwise(F.least("cap", F.expr("(weight * pool) div open_weight")))).drop("spent", "rest", "full", "pool", "open_weight")


def leaf_quotas(leaves: DataFrame, budget: DataFrame, epochs: int, weights: Mapping[str, Mapping[str, int]], levels: Sequence[str] = LEVELS) -> DataFrame:
    """(levels, tokens, quota) from (levels, tokens); ``budget`` is one row with column budget."""
    plan = leaves.withColumn("supply", F.col("tokens") * epochs)
    top = budget
    parent: list[str] = []
    for level in levels:
        keys = [*parent, level]
        nodes = plan.groupBy(*keys).agg(F.sum("supply").alias("cap")).withColumn("weight", _weight(level, weights))
        nodes = nodes.join(top, parent) if parent else nodes.withColumn("root", F.lit(0)).crossJoin(F.broadcast(top))
        top = share_out(nodes, parent or ["root"], level).select(*keys, F.col("quota").alias("budget"))
        parent = keys
    return leaves.join(top, list(levels)).withColumnRenamed("budget", "quota")


def _cuts(placed: DataFrame, quotas: DataFrame, keys: list[str], side: Callable[[DataFrame], DataFrame], edge_rows: int) -> DataFrame:
    """(levels, stop): the first row (place, doc_id, text_hash) of each leaf that its last epoch doesn't take."""
    edge = quotas.select(*keys, "rest", F.lit(0).cast("long").alias("before"), F.lit("").alias("prefix"))
    for depth in range(0, 30, DIGITS):  # places have 32 digits
        near = placed.join(side(edge), keys).where(F.col("place").startswith(F.col("prefix")))
        sums = near.groupBy(*keys, "rest", "before", "prefix", F.substring("place", depth + 1, DIGITS).alias("bucket")).agg(F.sum("tokens").alias("sum"), F.count("*").alias("rows"))
        upto = F.coalesce(F.sum("sum").over(Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        # the bucket in which the prefix ends: whole buckets before it fit, this one does not
        sums = sums.withColumn("before", F.col("before") + upto).where("before <= rest and before + sum > rest")
        edge = written(sums.select(*keys, "rest", "before", F.concat("prefix", "bucket").alias("prefix"), "rows"), "edges")
        if (edge.agg(F.max("rows")).first()[0] or 0) <= edge_rows:
            break
    near = placed.join(side(edge.drop("rows")), keys).where(F.col("place").startswith(F.col("prefix")))
    run = F.col("before") + F.sum("tokens").over(Window.partitionBy(*keys).orderBy("place", "doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, 0))
    return near.withColumn("run", run).where("run > rest").groupBy(*keys).agg(F.min(F.struct("place", "doc_id", "text_hash")).alias("stop"))


def select_mix(
    docs: DataFrame,
    weights: Mapping[str, Mapping[str, int]] = WEIGHTS,
    share: tuple[int, int] = SHARE,
    epochs: int = EPOCHS,
    seed: str = SEED,
    levels: Mapping[str, Column] | None = None,
    edge_rows: int = EDGE_ROWS,
) -> DataFrame:
    """``docs`` with ``epoch``, ``n_tokens`` and the leaf's levels added, one row for every epoch in which a document is
    taken. ``levels``: name and expression over ``docs`` of each level from the root down; ``weights``: by level and value."""
    levels = levels or default_levels(docs)
    keys = list(levels)
    private = {f"__{k}": F.coalesce(v.cast("string"), F.lit("")) for k, v in levels.items()}
    keyed = make_room(docs.withColumns(private | {"__tokens": token_count(F.col("text"))}), *keys, "epoch", "n_tokens").withColumnsRenamed({f"__{k}": k for k in keys})
    text_hash = F.xxhash64("text").alias("text_hash")
    slim = keyed.select("doc_id", *keys, F.col("__tokens").alias("tokens"), text_hash)
    leaves = written(slim.groupBy(*keys).agg(F.sum("tokens").alias("tokens")), "leaves")
    budget = leaves.agg(F.expr(f"coalesce(sum(tokens), 0) * {share[0]} div {share[1]}").alias("budget"))
    quotas = leaf_quotas(leaves, budget, epochs, weights, keys)
    # whole epochs, then a prefix of the next one
    quotas = written(quotas.withColumns({"whole": F.when(F.col("tokens") > 0, F.expr("quota div greatest(tokens, 1)")).otherwise(epochs), "rest": F.when(F.col("tokens") > 0, F.expr("quota % greatest(tokens, 1)")).otherwise(0)}), "quotas")
    few = quotas.count() <= BROADCAST_LEAVES
    side = F.broadcast if few else lambda df: df
    placed = slim.join(side(quotas.select(*keys, "whole")), keys).withColumn("place", _order(seed, F.col("whole") + 1))
    stops = _cuts(placed, quotas, keys, side, edge_rows)
    final = written(quotas.join(stops, keys, "left").select(*keys, F.col("whole").alias("__whole"), F.col("stop").alias("__stop")), "cuts")
    out = keyed.join(side(final), keys)
    whole = F.col("__whole")
    place = F.struct(_order(seed, whole + 1).alias("place"), F.col("doc_id"), text_hash)
    # a leaf whose next epoch fits whole has no stop; that is only so for one without tokens or with a full supply
    partial = F.when(whole >= epochs, F.lit(False)).otherwise(F.coalesce(place < F.col("__stop"), F.lit(True)))
    taken = F.when(partial, whole + 1).otherwise(whole).cast("int")
    out = out.withColumn("__taken", taken).where("__taken > 0").withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("__taken"))))
    return out.withColumnRenamed("__tokens", "n_tokens").drop("__whole", "__stop", "__taken")


def query_levels() -> dict[str, Column]:
    source = F.coalesce(F.col("source"), F.lit(""))
    return dict(zip(LEVELS, (F.concat(F.lit("d"), F.length(source)), F.col("lang"), source), strict=True))


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    mix = select_mix(table(spark, sf_dir, "documents"), levels=query_levels())
    return mix.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("epoch").cast("long").alias("epoch"), "domain", F.col("lang_key").alias("lang"), F.col("source_key").alias("source"), "n_tokens")


def _level_sql(level: str, keys: list[str], parent: list[str], weights: Mapping[str, int]) -> str:
    case = "".join(f" WHEN {level} = '{k}' THEN {w}" for k, w in weights.items())
    weight = f"CASE{case} ELSE 1 END" if case else "1"
    on = " AND ".join(f"n.{k} = p.{k}" for k in parent) or "true"
    above = {0: "root", 1: "b_domain", 2: "b_lang_key"}[len(parent)]
    part = f"PARTITION BY {', '.join(parent)}" if parent else ""
    return f"""
n_{level} AS (SELECT {', '.join(f'n.{k}' for k in keys)}, n.cap, n.weight, p.budget FROM
  (SELECT {', '.join(keys)}, CAST(sum(supply) AS HUGEINT) AS cap, {weight} AS weight FROM leaves GROUP BY {', '.join(keys)}) n JOIN {above} p ON {on}),
s_{level} AS (SELECT *, coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent, sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM n_{level} WINDOW w AS ({part} ORDER BY cap / weight, {level})),
f_{level} AS (SELECT *, min(CASE WHEN cap * rest <= weight * (budget - spent) THEN 1 ELSE 0 END) OVER ({part} ORDER BY cap / weight, {level} ROWS UNBOUNDED PRECEDING) = 1 AS filled FROM s_{level}),
q_{level} AS (SELECT *, max(CASE WHEN NOT filled THEN budget - spent END) OVER ({part}) AS l, max(CASE WHEN NOT filled THEN rest END) OVER ({part}) AS o FROM f_{level}),
b_{level} AS (SELECT {', '.join(keys)}, CAST(CASE WHEN filled THEN cap ELSE least(cap, (weight * l) // o) END AS HUGEINT) AS budget FROM q_{level})"""


def _op2_sql() -> str:
    levels, parts = [], []
    for level in LEVELS:
        parts.append(_level_sql(level, [*levels, level], list(levels), WEIGHTS.get(level, {})))
        levels.append(level)
    return f"""
WITH docs AS (SELECT doc_id, 'd' || length(coalesce(source, '')) AS domain, coalesce(lang, '') AS lang_key, coalesce(source, '') AS source_key,
  CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS tokens FROM documents),
leaves AS (SELECT domain, lang_key, source_key, sum(tokens) AS tokens, sum(tokens) * {EPOCHS} AS supply FROM docs GROUP BY ALL),
root AS (SELECT CAST(sum(tokens) * {SHARE[0]} // {SHARE[1]} AS HUGEINT) AS budget FROM leaves),{','.join(parts)},
streamed AS (SELECT d.*, e.epoch, b.budget, sum(d.tokens) OVER (PARTITION BY domain, lang_key, source_key ORDER BY e.epoch, md5('{SEED}:' || e.epoch || ':' || d.doc_id), d.doc_id ROWS UNBOUNDED PRECEDING) AS run
  FROM docs d JOIN b_source_key b USING (domain, lang_key, source_key) CROSS JOIN (SELECT unnest(range(1, {EPOCHS} + 1)) AS epoch) e)
SELECT doc_id, CAST(epoch AS BIGINT) AS epoch, domain, lang_key AS lang, source_key AS source, tokens AS n_tokens FROM streamed WHERE run <= budget
"""


OP2_SQL = _op2_sql()
