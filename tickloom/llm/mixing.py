"""Operator 9, mixing sources to target weights: entropy balancing.

Targets share a budget by source weights, none above twice its source's size, the excess reshared by weight. Document
rates minimise the entropy divergence from taking each document once, subject to token constraints: every source gives
its target, and every class of document sizes (powers of two) keeps the tokens that the source targets imply, so that a
tilt favours neither long nor short texts. Rates are at most ``CAP``. The dual is convex and its solution tilts every
document on its own: rate = min(CAP, exp(size * (source's multiplier + class's multiplier))).

Newton iterations solve the dual. Tokens taken and curvatures are grouped sums over (source, size) in Spark. Sources
meet only through the few size classes, so each step solves the classes' Schur complement (at most 64 x 64) and then
every source's multiplier by itself, in Spark; a backtracking search along the step keeps the dual falling. Documents at
the cap have no curvature, so a class or source that stands there whole gets theirs as if the rate went on, or no step
would bring it back; a second step that counts all of them so is searched as well, and the lower dual is taken. After a
step, multipliers of such a class or source are cut back to the edge of the cap, from where that curvature is right.
Where rates are near nothing the dual is flat, so the search lengthens steps as well.

Rates become whole copies by error diffusion: within a source the sizes are passed from the largest down, each
takes the copies that bring the tokens taken closest to the tokens due, so that only the smallest documents' rounding
is left at the end. Within a size the documents first in a hash order get the odd copies; a size of many documents
is cut by hash and the odd copies are dealt to the parts in proportion, so no size meets in one task.

Defined results: null and blank texts have size 0 and take nothing. A null source is a source of its own, last in
order. A source of size 0 has target 0. Repeated rows are rows of their own. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, small_enough, staged, unstage, whole_row_key, word_array

WEIGHTS = (5.0, 2.0, 1.0)
BUDGET = 1.5
CAP = 2.0
#: Newton steps at most, the largest relative miss of a constraint at which they end, halvings and doublings of a step.
ROUNDS = 60
TOLERANCE = 1e-7
HALVINGS, DOUBLINGS = 12, 8
#: A class or source is held at the cap when less than this part of its curvature is below it.
HELD = 1e-6
#: Relative error of a constraint that is no solution any more, if the rounds end before the tolerance is reached.
LOOSE = 1e-3
#: Documents of one source and size that a task ranks.
PART = 50_000


def targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, cap: float = CAP) -> DataFrame:
    """(skey, source, source_size, target) by weighted shares under the cap; a few numbers a source.

    Sources ordered by cap over weight: those first in the order stop at their cap, the rest share what is left.
    """
    s = sizes.groupBy("skey", "source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    s = s.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(rank, F.lit(len(weights)))))
    s = s.withColumn("most", cap * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("weight"))
    everyone = Window.partitionBy()
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("budget", budget * F.sum("source_size").over(everyone)).withColumn("all_w", F.sum("weight").over(everyone))
    left = F.col("budget") - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    left_w = F.col("all_w") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    s = s.withColumn("level", left / left_w)
    s = s.withColumn("free_level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everyone)["level"])
    return s.select("skey", "source", "source_size", F.least("most", F.coalesce(F.col("weight") * F.col("free_level"), F.col("most"))).alias("target"))


def size_class(size: Column) -> Column:
    return F.floor(F.log2(F.greatest(size, F.lit(1)))).cast("int")


def tilt(multiplier: Column, mu: dict[int, float], size: Column) -> Column:
    """The exponent of a document's rate."""
    by_class = F.create_map(*[F.lit(x) for c, m in mu.items() for x in (c, float(m))])
    return size * (multiplier + F.coalesce(F.try_element_at(by_class, size_class(size)), F.lit(0.0)))


def newton(classes: DataFrame, goal: DataFrame, cap: float = CAP, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """(skey, size, n, rate) at the dual's solution; classes: (skey, size, n), goal: (skey, source_size, target).

    Sources whose target is all that the cap allows take every document ``cap`` times and leave the system.
    """
    full = F.col("target") >= cap * F.col("source_size") * (1 - 1e-12)
    free = goal.filter((F.col("source_size") > 0) & ~full)
    few = F.broadcast if small_enough(goal) else lambda df: df
    c = staged(classes.filter("size > 0").join(few(free), "skey").select("skey", "size", "n", size_class(F.col("size")).alias("cls"), "target", "source_size"), "free-classes")
    due = {r["cls"]: r["due"] for r in c.groupBy("cls").agg(F.sum(F.col("n") * F.col("size") / F.col("source_size") * F.col("target")).alias("due")).collect()}
    order = sorted(due)
    want, place = np.array([due[k] for k in order]), {k: i for i, k in enumerate(order)}
    mu = np.zeros(len(order))
    state = staged(free.select("skey", "target", F.lit(0.0).alias("lam")), "multipliers")
    top = math.log(cap)

    def named(values) -> dict[int, float]:
        return dict(zip(order, values))

    worst = math.inf if order else 0.0
    for _ in range(rounds if order else 0):
        u = tilt(F.col("lam"), named(mu), F.col("size"))
        now = c.drop("target").join(few(state), "skey").withColumn("u", u).withColumn("rate", F.exp(F.least(F.col("u"), F.lit(top))))
        bend = F.col("n") * F.col("size") * F.col("size") * F.col("rate")
        now = now.groupBy("skey", "target", "lam", "cls").agg(
            F.sum(F.col("n") * F.col("size") * F.col("rate")).alias("taken"),
            F.sum(F.when(F.col("u") < top, bend).otherwise(0.0)).alias("h"), F.sum(F.when(F.col("u") < top, 0.0).otherwise(bend)).alias("beyond"),
            (top / F.min("size")).alias("reach"))
        now = now.groupBy("skey", "target", "lam").agg(
            (F.sum("taken") - F.first("target")).alias("g"), (F.sum("h") < HELD * F.sum("beyond")).alias("held"),
            F.collect_list(F.struct("cls", "taken", "h", "beyond", "reach")).alias("by"))
        now = staged(now, "newton")
        seen = now.select("target", "g", F.explode("by").alias("x")).groupBy(F.col("x.cls").alias("cls")).agg(
            F.sum("x.taken").alias("taken"), F.sum("x.h").alias("h"), F.sum("x.beyond").alias("beyond"), F.max(F.abs("g") / F.col("target")).alias("off")).collect()
        gap = np.array([r["taken"] for r in sorted(seen, key=lambda r: r["cls"])]) - want
        worst = max(*(r["off"] for r in seen), float(np.max(np.abs(gap) / want)))
        if worst <= tolerance:
            unstage(now)
            break
        held = [r["cls"] for r in seen if r["h"] < HELD * r["beyond"]]
        ways = []  # of each step: the classes' part and the sources'
        for whole in (False, True):
            curve = lambda x: x["h"] + (x["beyond"] if whole else F.when(F.col("held") | x["cls"].isin(held), x["beyond"]).otherwise(0.0))  # noqa: E731, B023
            total = F.aggregate("by", F.lit(0.0), lambda a, x: a + curve(x)) + 1e-9 * F.col("target")  # noqa: B023
            d = now.select("g", total.alias("hs"), F.transform("by", lambda x: F.struct(x["cls"].alias("cls"), curve(x).alias("h"))).alias("by"))  # noqa: B023
            pair = d.select("g", "hs", F.explode("by").alias("x"), "by").select("g", "hs", "x", F.explode("by").alias("y"))
            cross = pair.groupBy(F.col("x.cls").alias("a"), F.col("y.cls").alias("b")).agg(
                F.sum(F.col("x.h") * F.col("y.h") / F.col("hs")).alias("s"), F.sum(F.col("x.h") * F.col("g") / F.col("hs")).alias("r"), F.sum("x.h").alias("h")).collect()
            schur, right, scale = np.zeros((len(order), len(order))), np.zeros(len(order)), 1e-9 * want
            for r in cross:
                i, j = place[r["a"]], place[r["b"]]
                schur[i, j] -= r["s"]
                if i == j:
                    schur[i, i] += r["h"]
                    right[i] -= r["r"]
                    scale[i] += r["h"]
            # classes' curvatures lie many powers of ten apart, so they are scaled to one
            scale = 1 / np.sqrt(scale)
            step = scale * np.linalg.lstsq(schur * scale[:, None] * scale, -scale * (gap + right), rcond=1e-11)[0]
            by_step = F.create_map(*[F.lit(v) for k, m in named(step).items() for v in (k, float(m))])
            moved = F.aggregate("by", F.lit(0.0), lambda a, x: a + curve(x) * F.coalesce(F.try_element_at(by_step, x["cls"]), F.lit(0.0)))  # noqa: B023
            ways.append((step, (-(F.col("g") + moved) / total).alias(f"dl{len(ways)}")))
        reach = F.transform("by", lambda x: F.struct(x["cls"].alias("cls"), x["reach"].alias("reach"))).alias("reach")
        ahead = staged(now.select("skey", "target", "lam", reach, *[dl for _, dl in ways]), "steps")
        # the dual along the steps; its value beyond the cap goes on as a straight line
        tried = [(w, 0.5 ** k) for w in range(len(ways)) for k in [*range(HALVINGS), *range(-1, -DOUBLINGS - 1, -1)]]
        at = c.drop("target").join(few(ahead), "skey").select(
            "n", tilt(F.col("lam"), named(mu), F.col("size")).alias("u"), F.array(*[tilt(F.col(f"dl{w}"), named(step), F.col("size")) for w, (step, _) in enumerate(ways)]).alias("du"))
        at = at.select("n", "u", "du", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w).alias("w"), F.lit(t).alias("t")) for k, (w, t) in enumerate(tried)])).alias("x"))
        at = at.select("n", F.col("x.k").alias("k"), (F.col("u") + F.col("x.t") * F.get("du", F.col("x.w"))).alias("v"))
        value = F.sum(F.col("n") * (F.exp(F.least("v", F.lit(top))) + cap * F.greatest(F.col("v") - top, F.lit(0.0))))
        grown = {r["k"]: r["value"] for r in at.groupBy("k").agg(value.alias("value")).collect()}
        lines = ahead.agg(F.sum(F.col("target") * F.col("lam")), *[F.sum(F.col("target") * F.col(f"dl{w}")) for w in range(len(ways))]).first()
        values = np.array([grown[k] - lines[0] - t * lines[1 + w] - float(want @ (mu + t * ways[w][0])) for k, (w, t) in enumerate(tried)])
        w, t = tried[int(np.flatnonzero(values <= values.min() + 1e-12 * abs(values.min()))[0])]
        # a multiplier that took all its documents past the cap goes back to where the last one reaches it: the dual is
        # a rising line from there on, along which no later step would find its way back
        moved = ahead.select("skey", "target", (F.col("lam") + t * F.col(f"dl{w}")).alias("lam"), "reach")
        edge = moved.select("lam", F.explode("reach").alias("x")).groupBy(F.col("x.cls").alias("cls")).agg(F.max(F.col("x.reach") - F.col("lam")).alias("edge")).collect()
        mu = np.minimum(mu + t * ways[w][0], [r["edge"] for r in sorted(edge, key=lambda r: r["cls"])])
        past = F.array_max(F.transform("reach", lambda x: x["reach"] - F.element_at(F.create_map(*[F.lit(v) for k, m in named(mu).items() for v in (k, float(m))]), x["cls"])))
        after = staged(moved.select("skey", "target", F.least("lam", past).alias("lam")), "multipliers")
        for old in (state, now, ahead):
            unstage(old)
        state = after
    if worst > LOOSE:
        raise ValueError(f"the mix has not converged: a constraint is off by {worst:.3g} of its target after {rounds} rounds")
    rate = F.when(full, cap).when(F.col("lam").isNotNull(), F.exp(F.least(tilt(F.col("lam"), named(mu), F.col("size")), F.lit(top)))).otherwise(0.0)
    known = goal.join(state.select("skey", "lam"), "skey", "left")
    return classes.join(few(known), "skey").select("skey", "size", "n", F.when(F.col("size") > 0, rate).otherwise(0.0).alias("rate"))


def diffuse(classes: DataFrame) -> DataFrame:
    """Adds copies, the whole copies that a class takes; classes: (skey, size, n, rate). A source's rows are its distinct sizes."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size", ascending=False)
        copies, due = [], 0.0
        for size, n, rate in zip(group["size"].tolist(), group["n"].tolist(), group["rate"].tolist()):
            due += n * rate * size
            take = min(max(round(due / size), 0), int(CAP) * n) if size else 0
            due -= take * size
            copies.append(take)
        return group.assign(copies=copies)[["skey", "size", "n", "rate", "copies"]]

    return classes.groupBy("skey").applyInPandas(run, "skey string, size bigint, n bigint, rate double, copies bigint")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS,
        budget: float = BUDGET, part: int = PART) -> DataFrame:
    """(doc_id, key, size, source_size, target, rate, copies, taken) of every document."""
    sizes = staged(docs.select(
        F.col(id_col).alias("doc_id"), whole_row_key(docs).alias("key"), F.col(source_col).alias("source"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("")).alias("skey"),
        F.size(word_array(F.col(text_col))).cast("bigint").alias("size"),
    ), "sizes")
    goal = staged(targets(sizes, weights, budget), "targets")
    classes = staged(sizes.groupBy("skey", "size").agg(F.count("*").alias("n")), "classes")
    taken = staged(diffuse(newton(classes, goal)), "copies")
    hashed = F.xxhash64("key", F.lit(11))
    parts = sizes.join(small(taken), ["skey", "size"]).withColumn("h", hashed).withColumn(
        "part", F.pmod(hashed, F.ceil(F.col("n") / part)).cast("int"))
    dealt = parts.groupBy("skey", "size", "n", "copies", "part").agg(F.count("*").alias("m"))
    upto = Window.partitionBy("skey", "size").orderBy("part")
    odd = F.col("copies") % F.col("n")
    share = lambda rows: F.floor(odd * rows / F.col("n"))
    dealt = dealt.withColumn("upto", F.sum("m").over(upto)).select(
        "skey", "size", "part", (share(F.col("upto")) - share(F.col("upto") - F.col("m"))).alias("odd"))
    ranked = parts.withColumn("at", F.row_number().over(Window.partitionBy("skey", "size", "part").orderBy("h", "doc_id")))
    ranked = ranked.join(small(dealt), ["skey", "size", "part"]).join(small(goal.select("skey", "source_size", "target")), "skey")
    copies = F.floor(F.col("copies") / F.col("n")) + F.when(F.col("at") <= F.col("odd"), 1).otherwise(0)
    return ranked.select(
        "doc_id", "key", "size", "source_size", "target", "rate", copies.cast("bigint").alias("copies"),
        (copies * F.col("size")).cast("bigint").alias("taken"))


def take_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: every document as many times as it is copied, in the input's columns. Only rows that are equal in
    every column are interchangeable."""
    copies = mix(docs, id_col, text_col, source_col).groupBy("key").agg(F.sum("copies").alias("copies"), F.count("*").alias("n"))
    copies = staged(copies.filter("copies <> 1 or n > 1"), "mix-copies")
    kept = docs.select(F.struct(*docs.columns).alias("row"), whole_row_key(docs).alias("key"))
    kept = kept.join(small(copies), "key", "left")
    once = kept.filter(F.coalesce("n", F.lit(1)) == 1).select("row", "copies")
    again = kept.filter("n > 1").dropDuplicates(["key"]).select("row", "copies")  # rows that are equal in every column
    return once.union(again).filter(F.coalesce("copies", F.lit(1)) > 0).select(
        "row", F.explode(F.sequence(F.lit(1), F.coalesce("copies", F.lit(1)))).alias("copy")).select("row.*")
