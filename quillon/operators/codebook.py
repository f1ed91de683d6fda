"""Per-key vector quantisation: assignment, moving averages of centres, ids over all keys, and quality of clusters.

points has (key, a row id, vector); a codebook has one row per (key, cid) with its centre and state.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.clean import safe_key, stable_hash
from quillon.operators.geometry import exact_quantiles
from quillon.operators.joins import nearest_center, square_distance
from quillon.plans.cut import cut

LEAST_COUNT = 1e-5


def normalized(v: Column, eps: float = 1e-12) -> Column:
    """An array by its length; NaN counts as 0."""
    clean = F.transform(v, lambda x: F.when(F.isnan(x), 0e0).otherwise(x.cast("double")))
    length = F.sqrt(F.aggregate(clean, F.lit(0e0), lambda s, x: s + x * x))
    return F.transform(clean, lambda x: x / F.greatest(length, F.lit(eps)))


def first_centers(points: DataFrame, key: str, order: str, vector: str, k: int) -> DataFrame:
    """(key, cid, center): the first k vectors of each key, as doubles."""
    w = Window.partitionBy(key).orderBy(order)
    ranked = points.withColumn("cid", F.row_number().over(w) - 1).where(F.col("cid") < k)
    return ranked.select(key, "cid", F.col(vector).cast("array<double>").alias("center"))


def assign(points: DataFrame, codebook: DataFrame, key: str, vector: str) -> DataFrame:
    """points with cid and similarity of the nearest centre of their key; points of unknown keys go (see assign_all)."""
    return nearest_center(points, codebook.select(key, "cid", "center"), key, vector, "center", "cid")


def assign_all(points: DataFrame, codebook: DataFrame, key: str, vector: str, row: str) -> DataFrame:
    """As assign; points of unknown keys stay, with cid -1."""
    found = assign(points, codebook, key, vector).select(row, "cid")
    return points.join(found, row, "left").withColumn("cid", F.coalesce("cid", F.lit(-1)))


def batch_sums(assigned: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, cid, n, sums): per centre the number of points and the sum of their vectors."""
    parts = assigned.select(key, "cid", F.posexplode(F.col(vector).cast("array<double>")).alias("pos", "x")).groupBy(key, "cid", "pos").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    return parts.groupBy(key, "cid").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda p: p["s"]).alias("sums"))


def start_state(codebook: DataFrame, count: float = 1.0) -> DataFrame:
    """The state of new centres: cs, ea, ue, ever, last_ep and cooldown."""
    return codebook.select("*", F.lit(count).alias("cs"), F.transform("center", lambda x: x * count).alias("ea"), F.lit(0e0).alias("ue"), F.lit(0).alias("ever"), F.lit(-1).alias("last_ep"), F.lit(0).alias("cooldown"))


def ema_step(state: DataFrame, sums: DataFrame, key: str, gamma: float = 0.8, usage: float = 0.97, epoch: int = 0) -> DataFrame:
    """The state after a batch.

    cs and ea are moving averages of counts and sums; the centre is ea / cs on the unit sphere, or stays where the batch has no point. ea is then set to
    centre times cs, so that the two agree. ue is the moving average of counts, ever and last_ep tell when a centre was used.
    """
    joined = state.join(sums, [key, "cid"], "left")
    n, active = F.coalesce("n", F.lit(0)), F.coalesce(F.col("n") > 0, F.lit(False))
    cs = gamma * F.col("cs") + (1 - gamma) * n
    mixed = F.zip_with("ea", "sums", lambda a, s: gamma * a + (1 - gamma) * s)
    joined = joined.withColumn("_cs", cs).withColumn("_center", F.when(active, normalized(F.transform(mixed, lambda x: x / F.greatest(F.col("_cs"), F.lit(LEAST_COUNT))))).otherwise(F.col("center")))
    return joined.select(
        key,
        "cid",
        F.col("_center").alias("center"),
        F.col("_cs").alias("cs"),
        F.transform("_center", lambda x: x * F.greatest(F.col("_cs"), F.lit(LEAST_COUNT))).alias("ea"),
        (usage * F.col("ue") + (1 - usage) * n).alias("ue"),
        F.when(active, 1).otherwise(F.col("ever")).alias("ever"),
        F.when(active, epoch).otherwise(F.col("last_ep")).alias("last_ep"),
        F.greatest(F.lit(0), F.col("cooldown") - 1).alias("cooldown"),
    )


def kmeans(points: DataFrame, centers: DataFrame, key: str, vector: str, iterations: int, cosine: bool = True) -> DataFrame:
    """(key, cid, center) after some of Lloyd's iterations; centres without points stay. Each round is checkpointed."""
    now = centers.select(key, "cid", "center")
    for _ in range(iterations):
        assigned = nearest_center(points, now, key, vector, "center", "cid", cosine)
        means = batch_sums(assigned, key, vector)
        mean = F.transform("sums", lambda s: s / F.col("n"))
        now = cut(now.join(means, [key, "cid"], "left").select(key, "cid", F.when(F.col("n").isNull(), F.col("center")).otherwise(normalized(mean) if cosine else mean).alias("center")))
    return now


def global_ids(codebook: DataFrame, key: str) -> DataFrame:
    """(key, safe, k, offset): first id of each key, over the safe keys in order; a row per key."""
    sizes = codebook.groupBy(key).agg(F.count("*").alias("k")).withColumn("safe", safe_key(F.col(key).cast("string")))
    w = Window.orderBy("safe").rowsBetween(Window.unboundedPreceding, 0)
    return sizes.select(key, "safe", "k", (F.sum("k").over(w) - F.col("k")).alias("offset"))


def wcss(assigned: DataFrame, codebook: DataFrame, key: str, vector: str) -> DataFrame:
    """Per key: n, the sum of square distances to the centres, and the mean square error per component."""
    joined = assigned.join(codebook.select(key, "cid", "center"), [key, "cid"]).withColumn("_d", square_distance(F.col(vector), F.col("center")))
    return joined.groupBy(key).agg(F.count("*").alias("n"), F.sum("_d").alias("wcss"), (F.sum("_d") / F.sum(F.size(vector))).alias("mse"))


def commitment(assigned: DataFrame, codebook: DataFrame, key: str, vector: str, beta: float = 0.25) -> DataFrame:
    """One row: beta times the mean over keys of the mean square error, weighted by points."""
    return wcss(assigned, codebook, key, vector).agg((beta * F.sum(F.col("mse") * F.col("n")) / F.sum("n")).alias("commitment"))


def max_share(state: DataFrame, key: str, alpha: float = 0.5) -> DataFrame:
    """Per key: the largest share of a centre, of cs and ue mixed."""
    of = Window.partitionBy(key)
    share = lambda c: F.when(F.sum(c).over(of) > 0, F.col(c) / F.sum(c).over(of)).otherwise(0e0)
    return state.select(key, ((1 - alpha) * share("cs") + alpha * share("ue")).alias("_p")).groupBy(key).agg(F.max("_p").alias("max_share"))


def silhouette(points: DataFrame, key: str, cluster: str, vector: str, row: str, sample: int | None = None, block: int = 2048) -> DataFrame:
    """Per key: n and the mean silhouette; a point alone in its cluster has a = 0, and without another cluster the value is 0. row is unique in a key.

    Every chunk of a key's points meets every block of them in one task, as matrices; a block holds whole clusters, or a part of one that is larger than it. So a task gives, for
    each point, sums over its own and over parted clusters, and of the whole ones the least mean only. Work grows with the square of a key's points; `sample` (chosen by a
    hash) bounds it for large keys.
    """
    p = points.select(F.col(key).alias("k"), F.col(cluster).alias("c"), F.col(vector).alias("v"), F.col(row).alias("i"))
    if sample is not None:
        p = p.withColumn("_rn", F.row_number().over(Window.partitionBy("k").orderBy(F.xxhash64("i"), "i"))).where(F.col("_rn") <= sample).drop("_rn")
    p = cut(p)  # read four times
    sizes = p.groupBy("k", "c").agg(F.count("*").alias("n"))
    of = Window.partitionBy("k")  # over the clusters of a key
    before = F.sum("n").over(of.orderBy("c")) - F.col("n")
    dealt = p.join(sizes.select("k", "c", F.floor(before / block).alias("b"), F.ceil(F.col("n") / block).alias("parts"), F.ceil(F.sum("n").over(of) / block).alias("chunks")), ["k", "c"])
    blocks = F.struct("b", F.when(F.col("parts") > 1, F.col("c").cast("string")).alias("of"), F.pmod(F.xxhash64("i"), F.col("parts")).alias("part"))
    right = dealt.withColumn("block", F.when(F.col("parts") > 1, F.xxhash64("c", blocks["part"])).otherwise(F.xxhash64("b")))
    right = right.select("k", "block", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "c", "v", "i", (F.col("parts") > 1).alias("parted"))
    known = right.select("k", "block").distinct()
    left = dealt.select("k", "c", "v", "i", F.pmod(F.xxhash64(F.lit("chunk"), "i"), F.col("chunks")).alias("chunk")).join(known, "k")
    kinds = {n: p.schema[n].dataType.simpleString() for n in "kic"}

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"k": [], "i": [], "c": [], "kind": [], "s": [], "n": []})
        x, y = (np.array(t["v"].to_list(), np.float64) for t in (a, b))
        d = np.sqrt(np.maximum(0.0, (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * x @ y.T))
        d[a["i"].to_numpy()[:, None] == b["i"].to_numpy()[None, :]] = 0.0
        names, code = np.unique(b["c"].to_numpy(), return_inverse=True)
        order = np.argsort(code, kind="stable")
        first = np.searchsorted(code[order], np.arange(len(names)))
        sums, count = np.add.reduceat(d[:, order], first, axis=1), np.bincount(code)
        parted = np.zeros(len(names), bool)
        parted[code[b["parted"].to_numpy()]] = True
        own = a["c"].to_numpy()[:, None] == names[None, :]
        out = [pd.DataFrame({"i": a["i"].to_numpy()[r], "c": names[c], "kind": 0, "s": sums[r, c], "n": count[c]}) for r, c in [np.nonzero(own)]]
        out += [pd.DataFrame({"i": a["i"].to_numpy()[r], "c": names[c], "kind": 1, "s": sums[r, c], "n": count[c]}) for r, c in [np.nonzero(~own & parted)]]
        whole = np.where(own | parted, np.inf, sums / count)
        least = whole.min(axis=1)
        at = np.isfinite(least)
        out.append(pd.DataFrame({"i": a["i"].to_numpy()[at], "c": names[whole.argmin(axis=1)[at]], "kind": 2, "s": least[at], "n": 1}))
        found = pd.concat(out)
        found.insert(0, "k", a["k"].iloc[0])
        return found

    other = right.select(*[F.col(n).alias(f"{n}_2") for n in ("k", "chunk", "block")], *[F.col(n).alias(n) for n in ("c", "v", "i", "parted")])  # one lineage, two names
    met = left.groupBy("k", "chunk", "block").cogroup(other.groupBy("k_2", "chunk_2", "block_2")).applyInPandas(meet, f"k {kinds['k']}, i {kinds['i']}, c {kinds['c']}, kind int, s double, n long")
    means = met.groupBy("k", "i", "c", "kind").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.min("s").alias("least"))
    company = F.col("n") > 1  # the point itself is one of its cluster, at distance 0
    a = F.coalesce(F.max(F.when((F.col("kind") == 0) & company, F.col("s") / (F.col("n") - 1))), F.lit(0e0))
    b = F.min(F.when(F.col("kind") == 1, F.col("s") / F.col("n")).when(F.col("kind") == 2, F.col("least")))
    per_point = means.groupBy("k", "i").agg(a.alias("a"), b.alias("b"))
    s = F.when(F.col("b").isNull() | (F.greatest("a", "b") == 0), 0e0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return per_point.groupBy(F.col("k").alias(key)).agg(F.count("*").alias("n"), F.avg(s).alias("silhouette"))


# What needs a key's centres and points together: the same functions of numpy arrays serve batches and streams.


def seeds(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Rows to start from: the first by chance, then with a weight of the square of (square distance - its least), which favours far points more than k-means++ does."""
    rng = np.random.default_rng(seed)
    chosen = [int(rng.integers(len(x)))]
    nearest = ((x - x[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < min(k, len(x)):
        weight = (nearest - nearest.min() + 1e-12) ** 2
        weight[chosen] = 0.0
        chosen.append(int(rng.choice(len(x), p=weight / weight.sum())))
        nearest = np.minimum(nearest, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return np.array(chosen)


def split_threshold(n: float) -> float:
    """The share from which a centre is too large, by the number of points."""
    return 0.05 if n >= 1e6 else 0.08 if n >= 2e5 else 0.12 if n >= 5e4 else 0.20


def main_axis(second: np.ndarray, mean: np.ndarray, n: int) -> tuple[np.ndarray, float]:
    """The axis along which n points vary most, and their deviation along it, from the sums of their outer products and their mean; 0 where they are equal."""
    values, axes = np.linalg.eigh(second / n - np.outer(mean, mean))
    axis = axes[:, -1] * np.sign(axes[np.abs(axes[:, -1]).argmax(), -1])
    return axis, float(np.sqrt(values[-1])) if values[-1] > 1e-14 * np.trace(second) / n else 0.0


def mixed_share(cs: np.ndarray, ue: np.ndarray, alpha: float = 0.5) -> float:
    """The largest share of a centre, of cs and ue mixed."""
    return float(((1 - alpha) * cs / max(cs.sum(), 1e-8) + alpha * ue / max(ue.sum(), 1e-8)).max())


def winner_of(ue: np.ndarray, cooldown: np.ndarray) -> int:
    """The place of the most used centre that doesn't rest."""
    return int(np.where(cooldown <= 0, ue, -1.0).argmax())


def donor_of(ue: np.ndarray, cooldown: np.ndarray, winner: int, low: float = 0.005) -> int:
    """The place of the least used other centre that doesn't rest, one below the low share first; -1 without any."""
    able = cooldown <= 0
    able[winner] = False
    rare = able & (ue / ue.sum() < low)
    return int(np.where(rare if rare.any() else able, ue, np.inf).argmin()) if able.any() else -1


def split_by_moments(
    center: np.ndarray, cs: np.ndarray, ue: np.ndarray, cooldown: np.ndarray, n: int, n_own: int, shift: np.ndarray, second: np.ndarray, previous: float = 0.0, seed: int = 0, least: int = 32, rest: int = 2000, growth: float = 0.02
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As split_winner, from the number of all points and, of the winner's, the number and the sums of what they are away from its centre and of the outer products of that."""
    center, cs, ue, cooldown = center.copy(), cs.astype(float).copy(), ue.astype(float).copy(), cooldown.copy()
    same = center, cs, ue, cooldown
    share = mixed_share(cs, ue)
    if len(cs) < 3 or n < 200 or ue.sum() <= 0 or not (share > split_threshold(n) or share > previous + growth):
        return same
    winner = winner_of(ue, cooldown)
    if cooldown[winner] > 0 or ue[winner] / ue.sum() <= split_threshold(n) or n_own < least:
        return same
    donor = donor_of(ue, cooldown, winner)
    if donor < 0:
        return same
    away = shift / n_own
    axis, deviation = main_axis(second, away, n_own)
    mean = center[winner] + away
    move = 0.5 * deviation * axis if deviation > 0 else 1e-3 * np.random.default_rng(seed).normal(size=center.shape[1])
    center[winner], center[donor] = mean + move, mean - move
    center[[winner, donor]] /= np.maximum(np.linalg.norm(center[[winner, donor]], axis=1, keepdims=True), 1e-12)
    for held in (cs, ue):
        held[[winner, donor]] = held[winner] / 2
    cooldown[[winner, donor]] = rest
    return center, cs, ue, cooldown


def split_winner(center: np.ndarray, cs: np.ndarray, ue: np.ndarray, cooldown: np.ndarray, x: np.ndarray, cid: np.ndarray, previous: float = 0.0, seed: int = 0, least: int = 32, rest: int = 2000) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Centres, counts, usage and cooldowns after the most used centre that doesn't rest, if its share is too large, has shared its points with the least used: both move half
    a deviation along the points' main axis.

    The key has to have three centres and 200 points, and a largest mixed share that is above the threshold for its number of points, or has grown by more than 0.02 since
    `previous` (0 before the first step).
    """
    away = x[cid == (winner := winner_of(ue, cooldown))] - center[winner]
    return split_by_moments(center, cs, ue, cooldown, len(x), len(away), away.sum(axis=0), away.T @ away, previous, seed, least, rest)


def revive(center: np.ndarray, cs: np.ndarray, ue: np.ndarray, x: np.ndarray, seed: int = 0, dead: float = 0.10, most: int = 512, fresh: float = 32.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Dead centres start anew from points of the batch."""
    center, cs, ue = center.copy(), cs.astype(float).copy(), ue.astype(float).copy()
    gone = np.nonzero(cs < dead)[0][:most]
    if len(gone) and len(x):
        rng = np.random.default_rng(seed)
        picked = x[rng.choice(len(x), len(gone), replace=len(gone) > len(x))]
        center[gone] = picked / np.maximum(np.linalg.norm(picked, axis=1, keepdims=True), 1e-12)
        cs[gone] = ue[gone] = fresh
    return center, cs, ue


def prune(last_ep: np.ndarray, epoch: int, age: int = 3) -> np.ndarray:
    """Which centres have not been used for so many epochs."""
    return epoch - last_ep >= age


def per_key_seeds(points: DataFrame, key: str, row: str, vector: str, k: int, seed: int = 0, sample: int = 50_000) -> DataFrame:
    """(key, cid, center): seeds for each key, from at most `sample` of its points, chosen by a hash; only points whose hash is below a bound that about twice as many pass are
    ranked, so that no task gets a whole key."""
    named = points.select(F.col(key).alias("key"), F.col(row).alias("row"), F.col(vector).cast("array<double>").alias("v"))
    sizes = named.groupBy("key").agg(F.count("*").alias("n"))
    near = named.join(sizes, "key").where(F.xxhash64("row") / F.lit(2.0**64) + F.lit(0.5) <= (2.0 * sample + 100) / F.col("n")).drop("n")
    bounded = near.withColumn("_rn", F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("row"), "row"))).where(F.col("_rn") <= sample)
    kind = points.schema[key].dataType.simpleString()

    def start(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_rn")
        x = np.stack(rows["v"].to_numpy())
        chosen = seeds(x, k, seed)
        return pd.DataFrame({"key": rows["key"].iloc[0], "cid": np.arange(len(chosen)), "center": list(x[chosen])})

    return bounded.groupBy("key").applyInPandas(start, f"key {kind}, cid int, center array<double>").withColumnRenamed("key", key)


def winner_moments(state: DataFrame, assigned: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, n_own, shift, second) of the winner's points of each key, over all of them: partial sums in every task, then one sum a key."""
    ready = F.when(F.col("cooldown") <= 0, F.col("ue")).otherwise(-1e0)
    winner = state.groupBy(F.col(key).alias("key")).agg(F.min(F.struct((-ready).alias("less"), "cid", "center")).alias("_w")).select("key", F.col("_w.cid").alias("_cid"), F.col("_w.center").alias("_center"))
    own = assigned.select(F.col(key).alias("key"), "cid", F.col(vector).cast("array<double>").alias("v"))
    away = own.join(winner, (own["key"] == winner["key"]) & (own["cid"] == winner["_cid"])).select(own["key"], F.zip_with("v", "_center", lambda x, c: x - c).alias("away"))
    schema = f"key {state.schema[key].dataType.simpleString()}, n_own long, shift array<double>, second array<double>"

    def partial(batches):
        for batch in batches:
            for name, rows in batch.groupby("key"):
                x = np.stack(rows["away"].to_numpy())
                yield pd.DataFrame({"key": [name], "n_own": [len(x)], "shift": [x.sum(axis=0)], "second": [(x.T @ x).ravel()]})

    parts = away.mapInPandas(partial, schema)
    salted = parts.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(16)))

    def total(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"key": rows["key"].iloc[:1], "n_own": [rows["n_own"].sum()], "shift": [np.sum(rows["shift"].to_list(), axis=0)], "second": [np.sum(rows["second"].to_list(), axis=0)]})

    return salted.groupBy("key", "_salt").applyInPandas(total, schema).groupBy("key").applyInPandas(total, schema)


def reshaped(state: DataFrame, assigned: DataFrame, key: str, vector: str, epoch: int, seed: int = 0, sample: int = 50_000, previous: DataFrame | None = None) -> DataFrame:
    """The state after splitting, reviving and pruning, in this order, key by key. previous has (key, max_share) of the step before; a key that it lacks counts as 0.

    The split goes by all points of a key: their number, and the moments of the winner's. At most `sample` points of each key, chosen by a hash, are those
    that dead centres may start anew from; only points whose hash is below a bound that about twice as many pass are ranked.
    """
    p = assigned.select(F.col(key).alias("key"), F.lit(1).alias("kind"), "cid", F.col(vector).cast("array<double>").alias("v"))
    sizes = cut(p.groupBy("key").agg(F.count("*").alias("n"), F.min(F.xxhash64("v")).alias("_least")))
    moments = winner_moments(state, assigned, key, vector)
    unit = (F.xxhash64("v") / F.lit(2.0**64)) + F.lit(0.5)
    p = p.join(sizes, "key").where((unit <= 2.0 * sample / F.col("n")) | (F.xxhash64("v") == F.col("_least"))).drop("n", "_least")
    p = p.withColumn("_rn", F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("v"), "cid"))).where(F.col("_rn") <= sample).drop("_rn")
    nothing = [F.lit(0e0).alias("cs"), F.lit(0e0).alias("ue"), F.lit(0).alias("ever"), F.lit(0).alias("last_ep"), F.lit(0).alias("cooldown")]
    unknown = [F.lit(None).cast(t).alias(c) for c, t in (("n", "long"), ("n_own", "long"), ("shift", "array<double>"), ("second", "array<double>"), ("previous", "double"))]
    s = state.select(F.col(key).alias("key"), F.lit(0).alias("kind"), "cid", F.col("center").alias("v"), "cs", "ue", "ever", "last_ep", "cooldown")
    least = state.groupBy(F.col(key).alias("key")).agg(F.min("cid").alias("cid"))
    totals = least.join(sizes.select("key", "n"), "key", "left").join(moments, "key", "left")
    shares = previous.select(F.col(key).alias("key"), F.col("max_share").alias("previous")) if previous is not None else sizes.select("key", F.lit(0e0).alias("previous"))
    totals = totals.join(shares, "key", "left")
    s = s.join(totals, ["key", "cid"], "left")  # one row of each key bears its totals
    kind = state.schema[key].dataType.simpleString()
    schema = f"key {kind}, cid int, center array<double>, cs double, ea array<double>, ue double, ever int, last_ep int, cooldown int"

    def step(rows: pd.DataFrame) -> pd.DataFrame:
        own = rows[rows["kind"] == 0].sort_values("cid")
        if own.empty:
            return pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})
        batch = rows[rows["kind"] == 1]
        center = np.stack(own["v"].to_numpy())
        x = np.stack(batch["v"].to_numpy()) if len(batch) else np.zeros((0, center.shape[1]))
        cs, ue, cooldown, last = (own[c].to_numpy().copy() for c in ("cs", "ue", "cooldown", "last_ep"))
        of = own.iloc[0]
        if pd.notna(of["n_own"]):
            second = np.array(of["second"]).reshape(center.shape[1], center.shape[1])
            before = float(of["previous"]) if pd.notna(of["previous"]) else 0.0
            center, cs, ue, cooldown = split_by_moments(center, cs, ue, cooldown, int(of["n"]), int(of["n_own"]), np.array(of["shift"]), second, before, seed)
        center, cs, ue = revive(center, cs, ue, x, seed)
        old = prune(last, epoch)
        center, cs_new, ue_new = revive(center, np.where(old, 0.0, cs), np.where(old, 0.0, ue), x, seed + 1)
        last = np.where(old & (cs_new > 0), epoch, last)
        return pd.DataFrame({"key": own["key"].iloc[0], "cid": own["cid"].to_numpy(), "center": list(center), "cs": cs_new, "ea": list(center * np.maximum(cs_new, LEAST_COUNT)[:, None]), "ue": ue_new, "ever": own["ever"].to_numpy(), "last_ep": last, "cooldown": cooldown})

    return s.unionByName(p.select("*", *nothing, *unknown)).groupBy("key").applyInPandas(step, schema).withColumnRenamed("key", key)


def share_report(shares: DataFrame, share: str = "max_share") -> DataFrame:
    """One row over the keys: n_keys, mean, population deviation, five quantiles and the largest of their shares."""
    q = [F.percentile(share, F.lit(p)).alias(f"p{round(100 * p)}") for p in (0.5, 0.75, 0.9, 0.95, 0.99)]
    return shares.agg(F.count("*").alias("n_keys"), F.avg(share).alias("mean"), F.stddev_pop(share).alias("std"), *q, F.max(share).alias("most"))


def worst_keys(shares: DataFrame, key: str, share: str = "max_share", n: int = 20) -> DataFrame:
    """The keys with the largest shares: a report."""
    return shares.orderBy(F.desc(share), key).limit(n)


def dead_report(state: DataFrame, key: str, dead: float = 1e-3, near: float = 0.1) -> DataFrame:
    """Per key: k, the centres that are dead or nearly, as counts and shares, and those that were ever used."""
    n = lambda c: F.count(F.when(c, 1))
    found = state.groupBy(key).agg(F.count("*").alias("k"), n(F.col("cs") < dead).alias("dead"), n(F.col("cs") < near).alias("near_dead"), n(F.col("ever") > 0).alias("ever_used"))
    return found.withColumn("dead_share", F.col("dead") / F.col("k")).withColumn("near_dead_share", F.col("near_dead") / F.col("k"))


def means_of(points: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, n, mean): the mean vector of each key."""
    sums = batch_sums(points.withColumn("cid", F.lit(0)), key, vector)
    return sums.select(key, "n", F.transform("sums", lambda s: s / F.col("n")).alias("mean"))


def median_deviation(points: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, n, sigma): the median distance of a key's points from their mean."""
    away = points.join(means_of(points, key, vector).select(key, "mean"), key).select(F.col(key).alias("g"), F.sqrt(square_distance(F.col(vector), F.col("mean"))).alias("d"))
    most = away.groupBy("g").agg(F.max("d").alias("_most"))
    return exact_quantiles(away.join(most, "g"), (0.5,)).select(F.col("g").alias(key), "n", F.col("q50").alias("sigma"))


def compacted(codebook: DataFrame, key: str, n: str = "n") -> DataFrame:
    """Centres with points, numbered anew from 0 in the order of their ids."""
    w = Window.partitionBy(key).orderBy("cid")
    return codebook.where(F.col(n) > 0).withColumn("cid", (F.row_number().over(w) - 1).cast("int"))


def filled(codebook: DataFrame, key: str, k: int, mode: str = "repeat", points: DataFrame | None = None, row: str | None = None, vector: str | None = None, seed: int = 0) -> DataFrame:
    """(key, cid, center) with k centres for each key: lacking ones repeat the others in turn, or copy the first, or are points of the key chosen by a hash."""
    sizes = codebook.groupBy(key).agg(F.count("*").cast("int").alias("_n"))
    lacking = sizes.where(F.col("_n") < k).select(key, "_n", F.explode(F.sequence(F.col("_n"), F.lit(k - 1))).alias("cid"))
    known = codebook.select(key, "cid", "center")
    if mode == "data":
        chosen = stable_hash(F.col(row).cast("string"), seed)
        most = points.groupBy(key).agg(F.count("*").alias("_all"))
        near = points.join(most, key).where(chosen / F.lit(16.0**15) <= (4.0 * k + 100) / F.col("_all"))  # enough of them, whatever their number
        w = Window.partitionBy(key).orderBy(chosen, row)
        ranked = near.select(key, (F.row_number().over(w) - 1).alias("_rn"), F.col(vector).cast("array<double>").alias("center"))
        have = ranked.groupBy(key).agg(F.count("*").alias("_have"))
        wanted = lacking.join(have, key).withColumn("_rn", (F.col("cid") - F.col("_n")) % F.col("_have"))
        return known.unionByName(wanted.join(ranked, [key, "_rn"]).select(key, "cid", "center"))
    source = F.col("cid") % F.col("_n") if mode == "repeat" else F.lit(0)
    from_ = lacking.withColumn("_from", source.cast("int")).join(known.withColumnRenamed("cid", "_from"), [key, "_from"])
    return known.unionByName(from_.select(key, "cid", "center"))


def init_codebook(points: DataFrame, key: str, row: str, vector: str, k: int, iterations: int = 3, seed: int = 0) -> DataFrame:
    """(key, cid, center, padded) with k centres for each key: seeds, some of Lloyd's iterations, and for a key with fewer points than k its mean with a little noise, a
    hundredth of the median deviation long at most in each component."""
    start = cut(per_key_seeds(points, key, row, vector, k, seed))
    now = kmeans(points, start, key, vector, iterations, cosine=False)
    sizes = now.groupBy(key).agg(F.count("*").cast("int").alias("_n"))
    spread = means_of(points, key, vector).drop("n").join(median_deviation(points, key, vector).drop("n"), key)
    lacking = sizes.where(F.col("_n") < k).select(key, F.explode(F.sequence(F.col("_n"), F.lit(k - 1))).alias("cid")).join(spread, key)
    noise = lambda i: (F.xxhash64(F.lit(seed), key, "cid", i) / F.lit(2.0**63)) * F.col("sigma") * 0.01
    pads = lacking.select(key, "cid", F.transform("mean", lambda m, i: m + noise(i)).alias("center"), F.lit(True).alias("padded"))
    return now.withColumn("padded", F.lit(False)).unionByName(pads)


def codes_of(rows: DataFrame, codebook: DataFrame, key: str) -> DataFrame:
    """rows with (key, cid), and the centre that they stand for; null for unknown ones."""
    return rows.join(codebook.select(key, "cid", "center"), [key, "cid"], "left")


def quantized(points: DataFrame, assigned: DataFrame, codebook: DataFrame, key: str, row: str, vector: str) -> DataFrame:
    """(row, out): each point's centre, or the point itself where no key is known."""
    found = codes_of(assigned.select(row, key, "cid"), codebook, key).select(row, F.col("center").alias("_c"))
    return points.join(found, row, "left").select(row, F.coalesce("_c", F.col(vector).cast("array<double>")).alias("out"))


def existing_key(keys: DataFrame, known: DataFrame, mapping: DataFrame) -> DataFrame:
    """(key, safe) for every key: what the mapping (key, safe) gives if it is known (safe), else the key by rule if that is known, else null."""
    there = known.select(F.col("safe").alias("_k")).distinct()
    mapped = keys.join(mapping.select("key", F.col("safe").alias("_m")), "key", "left").withColumn("_r", safe_key(F.col("key")))
    both = mapped.join(there.withColumnRenamed("_k", "_k1"), F.col("_m") == F.col("_k1"), "left").join(there.withColumnRenamed("_k", "_k2"), F.col("_r") == F.col("_k2"), "left")
    return both.groupBy("key").agg(F.coalesce(F.min("_k1"), F.min("_k2")).alias("safe"))


def split_largest(assigned: DataFrame, key: str, row: str, vector: str, target: int, least: int = 5) -> DataFrame:
    """(key, row, cid) after the largest clusters of each key, in order of size, have been halved until `target` are in use: points further from the mean than the median go to a new id."""
    sizes = assigned.groupBy(key, "cid").agg(F.count("*").alias("n"))
    of = Window.partitionBy(key)  # over the clusters of a key
    ranked = sizes.withColumn("_used", F.count("*").over(of)).withColumn("_top", F.max("cid").over(of)).withColumn("_rn", F.row_number().over(of.orderBy(F.desc("n"), "cid")))
    chosen = ranked.where((F.col("n") > least) & (F.col("_rn") <= target - F.col("_used"))).select(key, "cid", (F.col("_top") + F.col("_rn")).alias("_new"))
    name = F.struct(key, "cid")
    inside = assigned.join(chosen, [key, "cid"]).withColumn("_g", name)
    middle = median_deviation(inside, "_g", vector)
    mean = means_of(inside, "_g", vector)
    far = inside.join(mean.select("_g", "mean"), "_g").join(middle.select("_g", "sigma"), "_g").where(F.sqrt(square_distance(F.col(vector), F.col("mean"))) > F.col("sigma"))
    moved = far.select(F.col(row).alias("_row"), "_new")
    return assigned.join(moved, F.col(row) == F.col("_row"), "left").select(key, row, F.coalesce("_new", "cid").cast("int").alias("cid"))


def equivalence_agreement(rows: DataFrame, group: str, code: str) -> DataFrame:
    """One row: the mean, over groups of two or more, of the mean distance between all ordered pairs of their codes. From counts per code; no pairs are formed."""
    counts = rows.groupBy(group, code).agg(F.count("*").alias("n"))
    of = Window.partitionBy(group)  # over the codes of a group
    sums = counts.select(group, code, "n", F.sum("n").over(of).alias("_all"), (F.sum("n").over(of.orderBy(code)) - F.col("n")).alias("_before"))
    apart = F.sum(2e0 * F.col("n") * F.col(code) * (2 * F.col("_before") + F.col("n") - F.col("_all")))
    per_group = sums.where("_all > 1").groupBy(group).agg((apart / (F.max("_all") * F.max("_all"))).alias("_d"))
    return per_group.agg(F.count("*").alias("groups"), (F.sum("_d") / (F.count("*") + F.lit(1e-6))).alias("loss"))


#: Of a pair loss: blocks of a task on each side at most, and the least number of parts from which they grow.
SIDE, SPREAD = 8, 16


def same_type_loss(points: DataFrame, kind: str, row: str, vector: str, block: int = 2048, batch: str | None = None) -> DataFrame:
    """Over all ordered pairs, a point with itself too, the mean of d^2 + 1 for equal kinds and exp(-d^2) for others, by 10000; one row, or with batch a row (batch, loss) for each batch, whose points meet only
    one another. Blocks meet as matrices, each two parts once, so the work is half that of the pairs of a batch; a null batch is none."""
    key = F.lit(0) if batch is None else F.col(batch)
    p = points.select(key.alias("k"), F.col(kind).alias("t"), F.col(row).alias("i"), F.col(vector).alias("v")).where("k IS NOT NULL")
    counts = p.groupBy("k").agg(F.count("*").alias("n"))
    blocks = F.ceil(F.col("n") / F.lit(block))
    side = F.greatest(F.lit(1), F.least(F.lit(SIDE), F.floor(blocks / SPREAD)))  # blocks that a task has on each side
    dealt = p.join(counts.select("k", F.ceil(blocks / side).cast("int").alias("parts")), "k").withColumn("b", F.pmod(F.xxhash64("i"), F.col("parts")).cast("int"))
    left = dealt.select("k", "t", "v", F.col("b").alias("a"), F.explode(F.sequence(F.col("b"), F.col("parts") - 1)).alias("b"))
    right = dealt.select("k", "t", "v", F.explode(F.sequence(F.lit(0), F.col("b"))).alias("a"), "b")

    def meet(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        """The sum over pairs of two parts; those of different parts count in both orders."""
        if a.empty or b.empty:
            return pd.DataFrame({"k": [key[0]], "s": [0.0]})
        (x, t), (y, u) = ((np.array(z["v"].to_list(), np.float64), z["t"].to_numpy()) for z in (a, b))
        total, xx, yy = 0.0, (x * x).sum(axis=1), (y * y).sum(axis=1)
        for i in range(0, len(x), block):
            for j in range(0, len(y), block):
                m, n = slice(i, i + block), slice(j, j + block)
                d = np.maximum(0.0, xx[m, None] + yy[None, n] - 2 * x[m] @ y[n].T)
                total += float(np.where(t[m, None] == u[None, n], d + 1, np.exp(-d)).sum())
        return pd.DataFrame({"k": [key[0]], "s": [total * (1 if key[1] == key[2] else 2)]})

    other = right.select(F.col("k").alias("k_2"), F.col("t").alias("t"), F.col("v").alias("v"), F.col("a").alias("a_2"), F.col("b").alias("b_2"))  # one lineage, two names
    met = left.groupBy("k", "a", "b").cogroup(other.groupBy("k_2", "a_2", "b_2")).applyInPandas(meet, f"k {p.schema['k'].dataType.simpleString()}, s double")
    found = met.groupBy("k").agg(F.sum("s").alias("s")).join(counts, "k").select(F.col("k").alias(batch or "k"), (F.col("s") / (F.col("n").cast("double") * F.col("n")) / 10000).alias("loss"))
    return found if batch else found.agg(F.max("loss").alias("loss"))


def gaussian_mixture(points: DataFrame, row: str, vector: str, k: int, seed: int = 0) -> DataFrame:
    """(row, cid): the likeliest of k Gaussians, fitted by Spark's own expectation maximisation, whose start depends on the seed and the partitions."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.functions import array_to_vector

    rows = points.select(row, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    model = GaussianMixture(k=k, seed=seed, featuresCol="features", predictionCol="cid").fit(rows)
    return model.transform(rows).select(row, "cid")


def mini_batches(points: DataFrame, centers: DataFrame, key: str, row: str, vector: str, batches: int, seed: int = 0) -> DataFrame:
    """(key, cid, center) after one pass of k-means in mini-batches, dealt by a hash: a centre moves to the mean of all points that it has got so far."""
    now = centers.select(key, "cid", "center", F.lit(0e0).alias("_n"))
    for b in range(batches):
        part = points.where(F.pmod(F.xxhash64(F.lit(seed), row), F.lit(batches)) == b)  # one batch of several, which together are all points
        sums = batch_sums(nearest_center(part, now.select(key, "cid", "center"), key, vector, "center", "cid", cosine=False), key, vector)
        joined = now.join(sums, [key, "cid"], "left")
        total = F.col("_n") + F.coalesce("n", F.lit(0))
        moved = F.zip_with("center", "sums", lambda c, s: (c * F.col("_n") + s) / total)
        now = cut(joined.select(key, "cid", F.when(F.col("n").isNull(), F.col("center")).otherwise(moved).alias("center"), total.alias("_n")))
    return now.drop("_n")
