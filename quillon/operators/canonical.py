"""Canonical order of the atoms of all molecules at once, and what follows from it: keys that are equal for equal graphs, and maps of atoms between two tables of graphs.

A molecule is a row with its atoms' colours and neighbours as arrays, so that refining colours needs no shuffle; molecules are small, as each came from one line or one residue. Rows meet only where the branches
of one molecule are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.molecules import directed
from quillon.plans.cut import cut, stored

#: What tells atoms apart in graphs as molecules.graphs makes them.
ATOM = ("z", "charge", "aromatic", "isotope", "hcount")
PART = ["mol", "part"]


def _let(value: Column, then) -> Column:
    """then(value), with value computed once."""
    return F.get(F.transform(F.array(value), then), 0)


def _until(start: Column, rounds: Column, step) -> Column:
    """Applies step (values to values) until it makes no more classes than there were, at most a number of times."""
    first = F.struct(start.alias("v"), F.lit(False).alias("done"))
    classes = lambda v: F.size(F.array_distinct(v))
    onward = lambda s: _let(step(s["v"]), lambda new: F.struct(new.alias("v"), (classes(new) == classes(s["v"])).alias("done")))
    return F.aggregate(F.sequence(F.lit(0), rounds), first, lambda s, _: F.when(s["done"], s).otherwise(onward(s)), lambda s: s["v"])


def _refined(colours: Column, near: Column) -> Column:
    """Colours split by the sorted colours and bonds of the neighbours until no class splits; once more after that, so that equal colours mean equal neighbours among these colours."""
    seen = lambda c, ns: F.array_sort(F.transform(ns, lambda n: F.xxhash64(n["kind"], F.get(c, n["to"]))))
    return _until(colours, F.size(colours), lambda c: F.transform(near, lambda ns, i: F.xxhash64(F.get(c, i), seen(c, ns))))


def _marked(colours: Column, u: Column) -> Column:
    return F.transform(colours, lambda c, i: F.when(i == u, F.xxhash64(c, F.lit("marked"))).otherwise(c))


def _tied(colours: Column) -> Column:
    """The least colour that two atoms have, null where all differ."""
    return F.array_min(F.filter(colours, lambda c: F.size(F.filter(colours, lambda o: o == c)) > 1))


def _same_under_swap(mine: Column, other: Column, near: Column) -> Column:
    """Whether the map from one branch to another is an automorphism: an atom goes to the only one of its colour, or stays where both branches give it the same colour."""
    only = lambda c: F.filter(F.transform(other, lambda o, j: F.when(o == c, j)), lambda j: j.isNotNull())
    goal = F.transform(mine, lambda c, i: _let(only(c), lambda js: F.when(F.get(other, i) == c, i).when(F.size(js) == 1, F.get(js, 0))))
    ends = lambda ns, to: F.array_sort(F.transform(ns, lambda n: F.struct(n["kind"], to(n["to"]).alias("to"))))
    kept = lambda m: F.forall(F.transform(near, lambda ns, i: ends(ns, lambda t: F.get(m, t)) == ends(F.get(near, F.get(m, i)), lambda t: t)), lambda x: F.coalesce(x, F.lit(False)))
    whole = lambda m: F.forall(m, lambda x: x.isNotNull()) & (F.size(F.array_distinct(m)) == F.size(m))
    return _let(goal, lambda m: F.when(whole(m), kept(m)).otherwise(False))


def _flat(atoms: DataFrame, bonds: DataFrame, by: tuple[str, ...], kinds: bool) -> DataFrame:
    """(mol, ids, near, c, shape): a row for each molecule, neighbours by their places in ids; shape is a hash of all but the ids, so that molecules whose atoms stand in the same places share it."""
    kind = F.xxhash64("kind") if kinds else F.lit(0).cast("long")
    ends = directed(bonds.where("src <> dst").select("mol", "src", "dst", kind.alias("kind"))).groupBy("mol").agg(F.array_sort(F.collect_set(F.struct("src", "dst", "kind"))).alias("ns"))
    colour = F.xxhash64(*by) if by else F.lit(0).cast("long")
    own = atoms.groupBy("mol").agg(F.array_sort(F.collect_set(F.struct("atom", colour.alias("c")))).alias("a"))
    one = own.withColumn("a", F.filter("a", lambda x, i: (i == 0) | (x["atom"] != F.get("a", i - 1)["atom"])))  # of a repeated atom the least colour
    place = lambda ids, x: (F.array_position(ids, x) - 1).cast("int")
    none = F.array().cast("array<struct<to:int,kind:bigint>>")
    of = lambda x: F.filter("ns", lambda n: (n["src"] == x) & F.array_contains("ids", n["dst"]))
    near = F.transform("ids", lambda x: F.coalesce(F.transform(of(x), lambda n: F.struct(place(F.col("ids"), n["dst"]).alias("to"), n["kind"].alias("kind"))), none))
    rows = one.join(ends.hint("merge"), "mol", "left").withColumn("ids", F.transform("a", lambda x: x["atom"])).select("mol", "ids", near.alias("near"), F.transform("a", lambda x: x["c"]).alias("c"))
    return rows.withColumn("shape", F.struct(F.xxhash64("near", "c").alias("p"), F.xxhash64(F.lit("shape"), "c", "near").alias("q")))


def _packed(flat: DataFrame) -> DataFrame:
    """(mol, part, ids, near, core, colours): a row for each connected part of the rows of _flat."""
    place = lambda ids, x: (F.array_position(ids, x) - 1).cast("int")
    # parts: each atom takes the least place among its own and its neighbours' until none changes
    least = lambda v: F.transform("near", lambda ns, i: F.array_min(F.concat(F.array(F.get(v, i)), F.transform(ns, lambda n: F.get(v, n["to"])))))
    places = F.transform("ids", lambda x, i: i)
    root = F.aggregate("ids", F.struct(places.alias("v"), F.lit(False).alias("done")), lambda s, _: F.when(s["done"], s).otherwise(_let(least(s["v"]), lambda new: F.struct(new.alias("v"), (new == s["v"]).alias("done")))), lambda s: s["v"])
    split = flat.withColumn("root", root).select("*", F.explode(F.array_distinct("root")).alias("part"))
    at = split.withColumn("at", F.filter(F.transform("root", lambda r, i: F.when(r == F.col("part"), i)), lambda i: i.isNotNull()))
    pick = lambda col: F.transform("at", lambda i: F.get(col, i))
    parts = at.select("mol", "part", pick("ids").alias("ids"), F.transform("at", lambda i: F.transform(F.get("near", i), lambda n: F.struct(place(F.col("at"), n["to"]).alias("to"), n["kind"].alias("kind")))).alias("near"), pick("c").alias("c"))
    # the core: what is left when atoms with fewer than two neighbours are taken off again and again
    inner = lambda v: F.transform("near", lambda ns, i: F.get(v, i) & (F.size(F.array_distinct(F.transform(F.filter(ns, lambda n: F.get(v, n["to"])), lambda n: n["to"]))) > 1))
    all_in = F.transform("ids", lambda x: F.lit(True))
    core = F.aggregate("ids", F.struct(all_in.alias("v"), F.lit(False).alias("done")), lambda s, _: F.when(s["done"], s).otherwise(_let(inner(s["v"]), lambda new: F.struct(new.alias("v"), (new == s["v"]).alias("done")))), lambda s: s["v"])
    known = cut(parts.withColumn("core", core))
    return known.select("mol", "part", "ids", "near", "core", _refined(F.transform("c", lambda c, i: F.xxhash64(c, F.get("core", i))), F.col("near")).alias("colours"))


def _settled(colours: Column, near: Column) -> Column:
    """Breaks the ties of trees, any way, as atoms of one colour there can change places: the first of the least tied colour is marked, and so on until all differ."""
    next_ = lambda c: _let(_tied(c), lambda t: F.when(t.isNull(), c).otherwise(_refined(_marked(c, F.array_position(c, t).cast("int") - 1), near)))
    return F.aggregate(colours, colours, lambda c, _: next_(c))


def _parts(flat: DataFrame) -> DataFrame:
    """(mol, part, key, order): of each part a hash and the atoms in canonical order."""
    in_core = F.filter(F.transform("colours", lambda c, i: F.when(F.get("core", i), c)), lambda c: c.isNotNull())
    left = cut(_packed(flat).withColumn("path", F.array().cast("array<int>")).withColumn("tie", _tied(in_core)))
    done = []
    while True:
        done.append(left.where("tie is null").drop("tie", "core"))
        left = left.where("tie is not null")
        if left.isEmpty():
            break
        members = F.filter(F.transform("colours", lambda c, i: F.when(c == F.col("tie"), i)), lambda i: i.isNotNull())
        tried = cut(left.select("*", F.explode(members).alias("u")).withColumn("colours", _refined(_marked(F.col("colours"), F.col("u")), F.col("near"))))
        least = tried.withColumn("sign", F.xxhash64(F.array_sort("colours"))).withColumn("best", F.min("sign").over(Window.partitionBy(*PART))).where("sign = best")
        first = F.first("colours").over(Window.partitionBy(*PART, "path").orderBy("u").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        lead = F.min("u").over(Window.partitionBy(*PART, "path"))
        fresh = least.withColumn("lead", lead).withColumn("led", first).where((F.col("u") == F.col("lead")) | ~_same_under_swap(F.col("led"), F.col("colours"), F.col("near")))
        left = cut(fresh.select("mol", "part", "ids", "near", "core", "colours", F.concat("path", F.array("u")).alias("path")).withColumn("tie", _tied(in_core)))
    leaves = done[0]
    for more in done[1:]:
        leaves = leaves.union(more)
    one = leaves.groupBy(*PART).agg(F.min_by(F.struct("ids", "near", "colours"), "path").alias("l")).select("mol", "part", "l.*")
    signed = one.withColumn("key", F.sha2(F.array_join(F.array_sort("colours"), ","), 256))
    final = cut(signed.withColumn("colours", _settled(F.col("colours"), F.col("near"))))
    pairs = F.array_sort(F.arrays_zip("colours", "ids"))
    return final.select("mol", "part", "key", F.transform(pairs, lambda p: p["ids"]).alias("order"))


def canonical(atoms: DataFrame, bonds: DataFrame, by: tuple[str, ...] = ATOM, kinds: bool = True) -> DataFrame:
    """(mol, key, order): for each molecule a key, equal for graphs that differ only in the numbers and order of their atoms, and its atoms in an order that shows it: the map from one graph to another of the
    same key, place by place, keeps the columns by, the bonds and, if kinds, their kinds.

    atoms has mol, atom and by, bonds mol, src, dst and kind; directions don't count, loops and repeated bonds count once, bonds of unknown atoms not at all. Colours are refined by neighbours. Where atoms of the
    rings stay tied, each of the least tied colour is tried; tries that refine worse, and those that an automorphism takes to the first, are left; the rest go on together until all ring atoms differ. Ties
    outside rings are broken any way. Connected parts go their own ways and are put together in the order of their keys. Colours are 64-bit hashes, so keys are right as long as no two of them clash. Molecules
    without atoms have no row; of atoms repeated with different columns one counts; a null mol joins nothing and loses its bonds. Tries are as many as the symmetry of rings asks for: six for a lone ring of six, sixty for a ball of sixty, very many only for
    regular graphs that no molecule has. All of this is done once for each shape, that is, for molecules whose atoms, by their numbers, stand in the same places; their rows are kept as Parquet in the shared folder. These
    files are small where rows are alike, so Spark would take them for tables to broadcast: they are joined by sorting, here and below.
    """
    rows = stored(_flat(atoms, bonds, by, kinds))
    shapes = stored(rows.groupBy("shape").agg(F.first("near").alias("near"), F.first("c").alias("c")).select(F.col("shape").alias("mol"), F.transform("c", lambda x, i: i).alias("ids"), "near", "c"))
    whole = _parts(shapes).groupBy("mol").agg(F.array_sort(F.collect_list(F.struct("key", "part", "order"))).alias("p"))
    keys = whole.select(F.col("mol").alias("shape"), F.sha2(F.array_join(F.transform("p", lambda p: p["key"]), ";"), 256).alias("key"), F.flatten(F.transform("p", lambda p: p["order"])).alias("places"))
    return rows.select("mol", "ids", "shape").join(stored(keys).hint("merge"), "shape").select("mol", "key", F.transform("places", lambda i: F.get("ids", i)).alias("order"))


def places(orders: DataFrame) -> DataFrame:
    """(mol, atom, place, key): canonical as a row for each atom, places from 0."""
    return orders.select("mol", "key", F.posexplode("order").alias("place", "atom")).select("mol", "atom", "place", "key")


def template_maps(pairs: DataFrame, templates: DataFrame, targets: DataFrame) -> DataFrame:
    """(template, target, atoms): for each of the pairs (template, target; a ligand and the residues of its structure) whose graphs are one but for numbers the map, an array of (template_atom, target_atom) by
    place; both sides are of canonical, with the same by and kinds. Other pairs, such as those whose counts differ, have no row; repeated pairs are repeated."""
    left = templates.select(F.col("mol").alias("template"), "key", F.col("order").alias("_a"))
    right = targets.select(F.col("mol").alias("target"), F.col("key").alias("_key"), F.col("order").alias("_b"))
    fit = pairs.select("template", "target").join(left.hint("merge"), "template").join(right.hint("merge"), "target").where("key = _key")
    return fit.select("template", "target", F.transform("_a", lambda a, i: F.struct(a.alias("template_atom"), F.get("_b", i).alias("target_atom"))).alias("atoms"))


def best_targets(maps: DataFrame, contacts: DataFrame) -> DataFrame:
    """(template, target, contact_n, atoms): of the targets that fit a template the one with most contacts, the least of equals; contacts has target and residue, a row or more for each residue that it touches.
    A target without contacts has 0."""
    n = contacts.groupBy("target").agg(F.size(F.collect_set("residue")).cast("long").alias("contact_n"))
    known = maps.join(n.hint("merge"), "target", "left").withColumn("contact_n", F.coalesce("contact_n", F.lit(0).cast("long")))
    best = known.groupBy("template").agg(F.max_by(F.struct("target", "contact_n", "atoms"), F.struct("contact_n", (-F.col("target")).alias("t"))).alias("b"))
    return best.select("template", "b.*")
