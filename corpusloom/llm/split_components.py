"""Splits that keep related records together: random-mate contraction in SQL joins, then components by weight.

Groups and normalised source keys are the vertices of a bipartite graph whose edges are the rows of group_sources, so a
key shared by a third of all groups is a star and never a clique. In each round every vertex draws a coin, a hash of its
id and the round; a vertex whose coin is beaten by a neighbour's is selected and collapses into the neighbour of the
smallest coin, edges are relabelled and made distinct, self-loops vanish. A star is gone after two rounds, and the
number of rounds grows with the logarithm of the largest component. When no edge is left, labels are unwound backwards
through the rounds. Choosing a neighbour is a min aggregate (combined map-side); relabelling joins the edges with one
row per vertex, and adaptive execution splits the skewed side at a hot vertex. Each round is written to the shared
folder, so the lineage stays one round long.

The split assigns whole components. Each part has room for its proportion of the rows and of the spam. Components of more
than a hundredth of all rows, of which there can be at most a hundred, are placed one by one where most room is left for
their majority label. The others are ordered by a hash: those with spam are cut by their cumulative spam rows at the room
left for spam, those without fill up the rows, so the label shares agree even if one component holds most of the spam.
Cumulative weights are computed per hash bucket with offsets, so no task sees all components. A language that a part
lacks gets there by moving the smallest component of the part that has most components of it.

Defined cases: NULL, blank and placeholder keys tie nothing; NULL group ids are ignored; repeated rows are one edge;
groups without any key are components of their own in the split and no rows of `components`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.prefix import running_total
from corpusloom.runtime import cut

PLACEHOLDERS = ("", "unknown", "na", "none", "null", "nan")
HEAVY = 0.01
BUCKET_ROWS = 20_000
SHARES = (("train", 0.64), ("validation", 0.16), ("test", 0.20))


def normal_key(key: Column) -> Column:
    """A source key without case, blanks and separators; NULL for placeholders."""
    k = F.lower(F.regexp_replace(key, r"[^\p{L}\p{N}]+", ""))
    return F.when(~k.isin(*PLACEHOLDERS), k)


def edges_of(sources: DataFrame) -> DataFrame:
    """Distinct edges (a, b) between group vertices and key vertices: groups are even numbers' strings of the id, keys
    carry a prefix, so the two never meet."""
    k = sources.select("group_id", normal_key(F.col("source_key")).alias("key")).where("group_id is not null and key is not null")
    return k.select(F.concat(F.lit("g"), F.col("group_id").cast("string")).alias("a"), F.concat(F.lit("k"), "key").alias("b")).distinct()


def contract(edges: DataFrame, seed: int = 7, max_rounds: int = 100) -> DataFrame:
    """vertex, root of every vertex of the edge list: the connected components, named by an arbitrary vertex."""
    now, moves = cut(edges.select("a", "b")), []
    for r in range(max_rounds):
        if now.isEmpty():
            break
        coin = lambda c, r=r: F.xxhash64(F.col(c), F.lit(seed + r))
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(F.struct(coin("b").alias("coin"), F.col("b").alias("mate"))).alias("m"))
        into = F.when(F.col("m.coin") < coin("a"), F.col("m.mate")).otherwise(F.col("a"))
        move = cut(best.select(F.col("a").alias("vertex"), into.alias("into")))
        moves.append(move)
        of = lambda c, move=move: move.select(F.col("vertex").alias(c), F.col("into").alias(f"{c}2"))
        moved = now.join(of("a"), "a").join(of("b"), "b").where("a2 <> b2")
        now = cut(moved.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct())
    else:
        raise RuntimeError(f"edges are left after {max_rounds} rounds")
    if not moves:
        return now.select(F.col("a").alias("vertex"), F.col("b").alias("root"))
    # Each round maps its vertices to those of the next; a vertex that the next round doesn't have is a root.
    known = moves[-1].select("vertex", F.col("into").alias("root"))
    for move in reversed(moves[:-1]):
        later = known.select(F.col("vertex").alias("into"), F.col("root").alias("then"))
        known = move.join(later, "into", "left").select("vertex", F.coalesce("then", "into").alias("root"))
    return known


def components(sources: DataFrame, seed: int = 7) -> DataFrame:
    """group_id, component_id (the smallest group id of its set) of every group with a usable key."""
    of = cut(contract(edges_of(sources), seed).where(F.col("vertex").startswith("g")).select(F.expr("cast(substr(vertex, 2) as bigint)").alias("group_id"), "root"))
    names = of.groupBy("root").agg(F.min("group_id").alias("component_id"))
    return of.join(names, "root").select("component_id", "group_id")


def tied(sources: DataFrame) -> DataFrame:
    """component_id, group_id of every group that belongs together with one of smaller id."""
    return components(sources).where("group_id > component_id")


def _covered(parts: DataFrame, spoken: DataFrame, shares: tuple[tuple[str, float], ...], rounds: int = 3) -> DataFrame:
    """parts (component_id, w, part) with every language of three components or more in every part, where spoken is
    component_id, lang. Only counts per language and part and the components to be moved come to the driver."""
    for _ in range(rounds):
        here = spoken.join(parts, "component_id").groupBy("lang", "part").agg(F.count("*").alias("n"), F.min(F.struct("w", "component_id")).alias("least"))
        table: dict[str, dict[str, tuple[int, int]]] = {}
        for r in here.collect():
            table.setdefault(r["lang"], {})[r["part"]] = (r["n"], r["least"]["component_id"])
        moves = {}
        for own in table.values():
            for name, _share in shares:
                giver = max(own, key=lambda k: (own[k][0], k))
                if name not in own and own[giver][0] > 1 and sum(n for n, _ in own.values()) >= len(shares):
                    moves.setdefault(own[giver][1], name)
        if not moves:
            return parts
        to = parts.sparkSession.createDataFrame(list(moves.items()), "component_id bigint, new string")
        parts = cut(parts.join(F.broadcast(to), "component_id", "left").select("component_id", "w", F.coalesce("new", "part").alias("part")))
    return parts


def splits(messages: DataFrame, sources: DataFrame, shares: tuple[tuple[str, float], ...] = SHARES, seed: int = 7, language: str = "language_column") -> DataFrame:
    """group_id, component_id, n_rows, part of every group of messages. NULL labels count as not spam; languages are told
    apart without case and blanks, NULL is none."""
    spark = messages.sparkSession
    of = components(sources, seed).select("group_id", F.col("component_id").alias("known"))
    rows = messages.where("group_id is not null")
    groups = rows.groupBy("group_id").agg(F.count("*").alias("n_rows"), F.count_if(F.col("label") == 1).alias("n_spam"))
    groups = cut(groups.join(of, "group_id", "left").select("group_id", "n_rows", "n_spam", F.coalesce("known", "group_id").alias("component_id")))
    comps = groups.groupBy("component_id").agg(F.sum("n_rows").alias("w"), F.sum("n_spam").alias("n_spam"))
    comps = cut(comps.withColumn("spam", F.col("n_spam") > 0).withColumn("own", F.when(F.col("spam"), F.col("n_spam")).otherwise(F.col("w"))))
    sums = comps.agg(F.sum("w").alias("w"), F.sum("n_spam").alias("n_spam"), F.count("*").alias("n")).first()
    total, n_spam = sums["w"] or 0, sums["n_spam"] or 0
    heavy = comps.where(F.col("w") > HEAVY * total).orderBy(F.desc("w"), "component_id").collect()  # at most 1 / HEAVY rows
    names = [name for name, _ in shares]
    room = {(name, kind): share * (n_spam if kind == "n_spam" else total) for name, share in shares for kind in ("w", "n_spam")}
    placed = []
    for c in heavy:
        best = max(names, key=lambda n: (room[n, "n_spam" if 2 * c["n_spam"] > c["w"] else "w"], n))
        for kind in ("w", "n_spam"):
            room[best, kind] -= c[kind]
        placed.append((c["component_id"], c["w"], best))
    light = comps.where(F.col("w") <= HEAVY * total).withColumn("h", F.xxhash64("component_id", F.lit(seed)))
    at = running_total(light, ["spam"], ["h", "component_id"], F.pmod("h", F.lit(64 + sums["n"] // BUCKET_ROWS)), "own", "before", "all")
    at = at.withColumn("u", (F.col("before") + F.col("own") / 2) / F.greatest(F.col("all"), F.lit(1)))
    # Components with spam are cut at the room for spam; the others fill up the rows.
    left = {name: max(0.0, room[name, "n_spam"]) for name in names}
    mixed = light.where("spam").agg(F.sum("w")).first()[0] or 0
    open_ = {name: max(0.0, room[name, "w"] - mixed * left[name] / (sum(left.values()) or 1.0)) for name in names}

    def cut_at(sizes: dict[str, float]) -> Column:
        whole, edge, out = sum(sizes.values()) or 1.0, 0.0, None
        for name in names:
            edge += sizes[name] / whole
            out = F.when(F.col("u") < edge, name) if out is None else out.when(F.col("u") < edge, name)
        return out.otherwise(max(names, key=lambda n: sizes[n]))

    part = F.when(F.col("spam"), cut_at(left)).otherwise(cut_at(open_))
    parts = cut(at.select("component_id", "w", part.alias("part")).unionByName(spark.createDataFrame(placed, "component_id bigint, w bigint, part string")))
    if language in messages.columns:
        spoken = rows.select("group_id", F.lower(F.trim(language)).alias("lang")).where("lang is not null").distinct()
        spoken = spoken.join(groups.select("group_id", "component_id"), "group_id").select("component_id", "lang").distinct()
        parts = _covered(parts, spoken, shares)
    return groups.select("group_id", "component_id", "n_rows").join(parts.select("component_id", "part"), "component_id").select("group_id", "component_id", "n_rows", "part")
