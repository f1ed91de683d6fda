"""Molecules as tables of atoms and bonds, all of them at once: graphs from lines of text, rings, ring systems, scaffolds, patterns of atoms."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import molecules as P
from quillon.functions import packed as R
from quillon.functions import smiles as S
from quillon.plans.cut import cut, stored

BOND = ["mol", "src", "dst"]
RINGED = ["ring_size", "arom_nbrs", "fused_id"]


class Molecules(NamedTuple):
    """status: mol and fault (null if sound). atoms: mol, atom, symbol, z, aromatic, charge, isotope, hcount, degree. bonds: mol, src, dst, kind, way, ring (size of the smallest ring, null outside)."""

    status: DataFrame
    atoms: DataFrame
    bonds: DataFrame


def packed_graphs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(mol, fault, atoms, bonds): the molecules of graphs, a row for each line, atoms and bonds as arrays of structs. Nothing is shuffled and nothing kept."""
    read = df.select(F.col(id_col).alias("mol"), F.arrow_udf(S.found, S.FOUND)(F.col(text_col)).alias("p"))
    numbered = F.transform("p.atoms", lambda a, i: F.struct(i.alias("atom"), *[a[c].alias(c) for c in ("symbol", "z", "aromatic", "charge", "isotope", "hcount", "degree")]))
    return read.select("mol", "p.fault", numbered.alias("atoms"), F.col("p.bonds").alias("bonds"))


def packed(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """(mol, atoms, bonds): a row for each molecule, from tables of both. Bonds of molecules without atoms are left out, and so are those of a null mol."""
    group = lambda df, name: df.groupBy("mol").agg(F.collect_list(F.struct(*[c for c in df.columns if c != "mol"])).alias(name))
    some = group(bonds, "bonds")
    none = F.array().cast(some.schema["bonds"].dataType)
    return group(atoms, "atoms").join(some.hint("merge"), "mol", "left").withColumn("bonds", F.coalesce("bonds", none))


def unpacked(rows: DataFrame, column: str) -> DataFrame:
    """(mol and the fields of an array of structs), a row for each of its members."""
    return rows.select("mol", F.explode(column).alias("_x")).select("mol", "_x.*")


def ringed_atoms(df: DataFrame, id_col: str, text_col: str, columns: tuple[str, ...] = tuple(S.ATOM_ROWS)) -> DataFrame:
    """(mol, columns): the atoms of graphs with ring_features, from lines in one pass: no array of atoms goes between Python and Spark. Lines are sorted within their partitions, so that equal ones meet in a
    batch, where each is parsed once. Nothing is shuffled and nothing kept."""
    lines = df.select(F.col(id_col).alias("mol"), F.col(text_col).alias("line")).sortWithinPartitions("line")
    kinds = [f"mol {lines.schema['mol'].dataType.simpleString()}", *[f"{c} {S.ATOM_ROWS[c]}" for c in columns]]
    return lines.mapInArrow(S.atom_rows(columns), ", ".join(kinds))


def faults(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(mol, fault) of each line, as of graphs."""
    return df.select(F.col(id_col).alias("mol"), F.arrow_udf(S.faults, "string")(F.col(text_col)).alias("fault"))


def graphs(df: DataFrame, id_col: str, text_col: str) -> Molecules:
    """The molecules that lines of text stand for; ids become mol, one row for each.

    fault is "null" for a null line, "atom" where brackets or an element can't be read, and else as in smiles.found; faulty lines have no atoms. A bond without a sign is aromatic between two
    aromatic atoms that share a ring, else single. Hydrogens of atoms without brackets follow from valences, aromaticity from the letters: Kekulé forms aren't made aromatic. Repeated rows of an id
    repeat its atoms, so ids should be distinct. Lines are parsed once, and kept as Parquet in the shared folder.
    """
    rows = stored(packed_graphs(df, id_col, text_col))
    return Molecules(rows.select("mol", "fault"), unpacked(rows, "atoms"), unpacked(rows, "bonds"))


def directed(bonds: DataFrame) -> DataFrame:
    """Each bond from both of its ends."""
    rest = [c for c in bonds.columns if c not in BOND]
    return bonds.select("mol", "src", "dst", *rest).union(bonds.select("mol", F.col("dst").alias("src"), F.col("src").alias("dst"), *rest))


def with_rings(bonds: DataFrame) -> DataFrame:
    """bonds and ring, the size of the smallest ring that a bond is in, null for none. The bonds of a molecule meet as one row; loops and repeated bonds don't count."""
    old = [c for c in bonds.columns if c not in ("mol", "ring")]
    rows = bonds.groupBy("mol").agg(F.collect_list(F.struct(*old)).alias("b"))
    sized = rows.withColumn("r", F.arrow_udf(R.ring_sizes, "array<int>")(F.col("b.src").cast("array<bigint>"), F.col("b.dst").cast("array<bigint>")))
    ring = F.when(F.col("mol").isNotNull(), F.get("r", F.col("i"))).alias("ring")
    return sized.select("mol", "r", F.posexplode("b").alias("i", "b")).select("mol", *[F.col(f"b.{c}").alias(c) for c in old], ring).select(*[c for c in bonds.columns if c != "ring"], "ring")


def shortest_cycles(bonds: DataFrame) -> DataFrame:
    """(mol, src, dst, ring), src < dst: for each bond that lies on a cycle, the length of a shortest one."""
    return with_rings(bonds.where("src <> dst").select("mol", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()).where("ring is not null")


def packed_ring_features(rows: DataFrame) -> DataFrame:
    """rows (as of packed) whose atoms have ring_size, arom_nbrs and fused_id too, as of ring_features."""
    ids = lambda c: F.col(c).cast("array<bigint>")
    found = rows.withColumn("_r", F.arrow_udf(R.atom_rings, "array<struct<ring_size:int,arom_nbrs:int,fused_id:int>>")(ids("atoms.atom"), F.col("atoms.aromatic"), ids("bonds.src"), ids("bonds.dst"), F.col("bonds.ring").cast("array<int>")))
    names = [f.name for f in rows.schema["atoms"].dataType.elementType if f.name not in RINGED]
    joined = F.zip_with("atoms", "_r", lambda a, r: F.struct(*[a[c].alias(c) for c in names], *[r[c].alias(c) for c in RINGED]))
    return found.withColumn("atoms", joined).drop("_r")


def ring_features(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """atoms (mol, atom, aromatic ...) and ring_size (the smallest ring, 0 outside), arom_nbrs (aromatic neighbours) and fused_id (0 outside, else the number of the ring system in the molecule, from 1 by
    the smallest atom); bonds have ring, as of with_rings. Rings that share an atom are one system."""
    return unpacked(packed_ring_features(packed(atoms, bonds.select(*BOND, "ring"))), "atoms")


def scaffolds(bonds: DataFrame, keep_double: bool = True) -> DataFrame:
    """The bonds of each molecule's scaffold: its rings and what links them; a molecule without rings has none.

    The bonds of a molecule meet as one row, where atoms with one bond are taken off until none is left. What then hangs on the scaffold by a double bond is put back, unless keep_double is false.
    """
    old = [c for c in bonds.columns if c != "mol"]
    return packed_scaffolds(bonds.groupBy("mol").agg(F.collect_list(F.struct(*old)).alias("bonds")), keep_double).select(*bonds.columns)


def packed_scaffolds(rows: DataFrame, keep_double: bool = True) -> DataFrame:
    """The same from rows with bonds, as of packed."""
    ids = lambda c: F.col(c).cast("array<bigint>")
    marked = rows.withColumn("_s", F.arrow_udf(R.scaffold_bonds, "array<int>")(ids("bonds.src"), ids("bonds.dst"))).select("mol", F.explode(F.arrays_zip("bonds", "_s")).alias("_x")).select("mol", "_x.bonds.*", "_x._s")
    return marked.where((F.col("_s") == 2) | ((F.col("_s") == 1) & (F.col("kind") == "DOUBLE")) if keep_double else F.col("_s") == 2).drop("_s")


def scaffold_keys(atoms: DataFrame, scaffold: DataFrame, rounds: int = 8, generic: bool = False) -> DataFrame:
    """(mol, scaffold): a hash of each scaffold, equal for scaffolds that differ only in the numbers of atoms; molecules without one have no row.

    Colours of atoms (element, charge, aromaticity; all the same if generic) are refined by the sorted colours and bonds of the neighbours, rounds times; the key is a hash of the sorted colours. Scaffolds
    that refinement can't tell apart, which are rare among molecules, share a key.
    """
    kind = F.lit("") if generic else F.col("kind")
    steps = directed(scaffold.select(*BOND, kind.alias("kind")))
    own = F.lit(0) if generic else F.xxhash64("z", "charge", "aromatic")
    now = steps.select("mol", F.col("src").alias("atom")).distinct().join(atoms, ["mol", "atom"]).select("mol", "atom", own.cast("long").alias("colour"))
    for _ in range(rounds):
        sent = steps.join(now.select("mol", F.col("atom").alias("dst"), "colour"), ["mol", "dst"]).groupBy("mol", F.col("src").alias("atom")).agg(F.array_sort(F.collect_list(F.xxhash64("kind", "colour"))).alias("near"))
        now = cut(now.join(sent, ["mol", "atom"]).select("mol", "atom", F.xxhash64("colour", "near").alias("colour")))
    return now.groupBy("mol").agg(F.xxhash64(F.array_sort(F.collect_list("colour"))).alias("scaffold"))


class Pattern(NamedTuple):
    """A small graph to look for: conditions of its atoms, in SQL over columns of atoms (z, aromatic, charge, hcount, degree, and total, degree and hydrogens together), bonds (atom, atom, kinds), and
    patterns none of which may hold at the first atom."""

    name: str
    atoms: tuple[str, ...]
    bonds: tuple[tuple[int, int, tuple[str, ...]], ...] = ()
    never: tuple[Pattern, ...] = ()


ANY, DOUBLE, SINGLE = ("SINGLE", "AROMATIC"), ("DOUBLE",), ("SINGLE",)
_C, _O, _N, _S, _P, _CARBON = "z = 6 and not aromatic", "z = 8 and not aromatic", "z = 7 and not aromatic", "z = 16 and not aromatic", "z = 15 and not aromatic", "z = 6"

#: The functional groups, in order. A bond without a sign is single or aromatic.
GROUPS = (
    Pattern("Hydroxyl", (f"{_O} and total = 2 and hcount = 1",)),
    Pattern("Alcohol", (f"{_C} and total = 4", f"{_O} and total = 2 and hcount = 1"), ((0, 1, ANY),)),
    Pattern("Amine", (f"{_N} and total = 3 and hcount in (0, 1, 2)",), (), (Pattern("", (_N, _C, _O), ((0, 1, ANY), (1, 2, DOUBLE))),)),
    Pattern("Amide", (_C, _O, _N), ((0, 1, DOUBLE), (0, 2, ANY))),
    Pattern("Carboxyl", (_C, _O, f"{_O} and (total = 2 and hcount = 1 or charge = -1)"), ((0, 1, DOUBLE), (0, 2, ANY))),
    Pattern("Carbonyl", (f"{_C} and total = 3", _O), ((0, 1, DOUBLE),)),
    Pattern("Aldehyde", (f"{_C} and total = 3 and hcount = 1", _O, _CARBON), ((0, 1, DOUBLE), (0, 2, ANY))),
    Pattern("Ketone", (f"{_C} and total = 3", _O, _CARBON), ((0, 1, DOUBLE), (0, 2, ANY))),
    Pattern("Ester", (_C, _O, _O, _CARBON), ((0, 1, DOUBLE), (0, 2, ANY), (2, 3, ANY))),
    Pattern("Ether", (f"{_O} and degree = 2", _CARBON, _CARBON), ((0, 1, ANY), (0, 2, ANY))),
    Pattern("Phenol", ("z = 6 and aromatic", f"{_O} and hcount = 1"), ((0, 1, ANY),)),
    Pattern("Aromatic", ("aromatic",)),
    Pattern("HeteroAromaticN", ("z = 7 and aromatic",)),
    Pattern("Halogen", ("z in (9, 17, 35, 53) and not aromatic",)),
    Pattern("Sulfonyl", (_S, _O, _O, "z in (7, 8) and not aromatic"), ((0, 1, DOUBLE), (0, 2, DOUBLE), (0, 3, ANY))),
    Pattern("Thiol", (f"{_S} and total = 2 and hcount = 1",)),
    Pattern("Disulfide", (_S, _S), ((0, 1, SINGLE),)),
    Pattern("Phosphate", (_P, _O, _O, _O, _O), ((0, 1, DOUBLE), (0, 2, ANY), (0, 3, ANY), (0, 4, ANY))),
)

#: Who gives and who takes hydrogen bonds, by a plain rule, not by a toolkit's file of features: N, O and S with a hydrogen give; O and S with a free pair take, and N without a positive charge whose pair is not
#: shared with a ring or with a double bond beside it.
HYDROGEN_BONDS = (
    Pattern("Donor", ("z in (7, 8, 16) and hcount > 0 and charge >= 0",)),
    Pattern("Acceptor", ("(z in (8, 16) and total < 3 or z = 7 and total < 4 and not (aromatic and total = 3)) and charge <= 0",), (), (Pattern("", (_N, "z in (6, 16)", "z in (7, 8, 16)"), ((0, 1, SINGLE), (1, 2, DOUBLE))), Pattern("", (_N, "aromatic"), ((0, 1, SINGLE),)))),
)


def _asked(patterns: tuple[Pattern, ...]) -> list[str]:
    return sorted({c for p in patterns for q in (p, *p.never) for c in q.atoms})


def _searched(rows: DataFrame, patterns: tuple[Pattern, ...], search: Callable) -> Column:
    """What a search of functions.packed finds in rows as of packed: conditions are evaluated by Spark, ways along the bonds within the rows."""
    conditions = _asked(patterns)
    own = lambda c: re.sub(r"\b(z|aromatic|charge|hcount|degree)\b", r"a.\1", re.sub(r"\btotal\b", "(degree + hcount)", c))
    held = F.array(*[F.expr(f"transform(atoms, a -> coalesce({own(c)}, false))") for c in conditions])
    ids = lambda c: F.col(c).cast("array<bigint>")
    return search(conditions)(ids("atoms.atom"), held, ids("bonds.src"), ids("bonds.dst"), F.col("bonds.kind"))


def packed_group_counts(rows: DataFrame, patterns: tuple[Pattern, ...] = GROUPS) -> DataFrame:
    """(mol, counts): how many atoms of each molecule are part of a match of each pattern, from rows as of packed."""
    return rows.select("mol", _searched(rows, patterns, lambda c: R.counts_of(patterns, c)).alias("counts"))


class Matcher:
    """Looks for patterns in all molecules, each of them a row: from the atom whose condition holds least often on, each time over the bond to the rarest atom yet to come."""

    def __init__(self, atoms: DataFrame, bonds: DataFrame):
        self.rows = stored(packed(atoms.select("mol", "atom", "z", "aromatic", "charge", "hcount", "degree"), bonds.select(*BOND, "kind")))

    def matches(self, pattern: Pattern) -> DataFrame:
        """(mol, a0, a1 ...): every way in which different atoms meet the conditions and bonds, symmetric ones too. Patterns are connected."""
        found = self.rows.select("mol", "atoms", F.explode(_searched(self.rows, (pattern,), lambda c: R.matches_of(pattern, c))).alias("w"))
        return found.select("mol", *[F.get("atoms", F.get("w", k))["atom"].alias(f"a{k}") for k in range(len(pattern.atoms))])

    def flags(self, patterns: tuple[Pattern, ...] = GROUPS) -> DataFrame:
        """(mol, atom, flags): for each atom an array of 0 and 1, whether it is part of a match of each pattern."""
        found = self.rows.select("mol", F.arrays_zip(F.col("atoms.atom").alias("atom"), _searched(self.rows, patterns, lambda c: R.flags_of(patterns, c)).alias("flags")).alias("x"))
        return found.select("mol", F.explode("x").alias("x")).select("mol", "x.atom", "x.flags")


def scaffold_clusters(rows: DataFrame, mol: str, keys: DataFrame) -> DataFrame:
    """rows and cluster, the scaffold of a row's molecule as text, for splits that keep clusters on one side; a molecule without one is a cluster of its own."""
    found = rows.join(keys.select(F.col("mol").alias(mol), "scaffold"), mol, "left")
    return found.withColumn("cluster", F.when(F.col("scaffold").isNull(), F.concat(F.lit("mol:"), F.col(mol).cast("string"))).otherwise(F.hex("scaffold"))).drop("scaffold")


def bond_rows(bonds: DataFrame) -> DataFrame:
    """bonds (as of graphs) and conjugated and features, the 24 numbers of functions.molecules.bond_features.

    Conjugated are aromatic bonds, single bonds both of whose ends have a double, triple or aromatic one, and double and triple bonds beside such a single one; free pairs don't count. No bond has a stereo
    form, as lines give directions only.
    """
    ends = directed(bonds.select(*BOND, "kind"))
    full = ends.where("kind in ('DOUBLE', 'TRIPLE', 'AROMATIC')").select("mol", F.col("src").alias("atom")).distinct()
    at = lambda atoms, end: atoms.select("mol", F.col("atom").alias(end))
    links = bonds.where("kind = 'SINGLE'").select(*BOND).join(at(full, "src"), ["mol", "src"], "left_semi").join(at(full, "dst"), ["mol", "dst"], "left_semi")
    linked = links.select("mol", F.explode(F.array("src", "dst")).alias("atom")).distinct()
    flagged = bonds.join(links.select(*BOND, F.lit(True).alias("_single")), BOND, "left")
    for end in ("src", "dst"):
        flagged = flagged.join(linked.select("mol", F.col("atom").alias(end), F.lit(True).alias(f"_{end}")), ["mol", end], "left")
    beside = F.coalesce("_src", "_dst", F.lit(False)) & F.col("kind").isin("DOUBLE", "TRIPLE")
    known = flagged.withColumn("conjugated", (F.col("kind") == "AROMATIC") | F.coalesce("_single", F.lit(False)) | beside)
    rings = F.when(F.col("ring").isNotNull(), F.array("ring")).otherwise(F.array().cast("array<int>"))
    features = P.bond_features(F.col("kind"), F.col("kind") == "AROMATIC", F.col("conjugated"), rings, F.lit("STEREONONE"), F.col("way"))
    return known.withColumn("features", features).select(*bonds.columns, "conjugated", "features")


#: The kinds of atoms that count two steps away, and their weights.
TWO_STEPS = ((1, (7,)), (3, (8,)), (9, (16, 9, 17, 35)))


def two_step_codes(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """(mol, atom, code) for atoms with others two steps away: 0, 1 or more of each kind among these, as 0, 1, 2, times the kind's weight."""
    one = cut(directed(bonds.where("src <> dst").select(*BOND)).distinct())
    two = one.join(one.select("mol", F.col("src").alias("dst"), F.col("dst").alias("far")), ["mol", "dst"]).where("far <> src").select("mol", "src", "far").distinct()
    away = two.join(one.withColumnRenamed("dst", "far"), ["mol", "src", "far"], "left_anti").join(atoms.select("mol", F.col("atom").alias("far"), "z"), ["mol", "far"])
    code = sum((w * F.least(F.lit(2), F.sum(F.col("z").isin(*zs).cast("int"))) for w, zs in TWO_STEPS), F.lit(0))
    return away.groupBy("mol", F.col("src").alias("atom")).agg(code.cast("int").alias("code"))


def atom_rows(g: Molecules) -> DataFrame:
    """(mol, atom, row): the 79 numbers of each atom of functions.molecules.atom_row, all found from the graph.

    Hybrids are by bonds alone: 2 with a triple bond, or two double ones at carbon or nitrogen, 3 for aromatic atoms and others with a double bond but for phosphorus and sulphur, else 4; what free pairs do
    beside double bonds isn't seen.
    """
    double = F.sum((F.col("kind") == "DOUBLE").cast("int"))
    kinds = directed(g.bonds.select(*BOND, "kind")).groupBy("mol", F.col("src").alias("atom")).agg(double.alias("_double"), F.sum((F.col("kind") == "TRIPLE").cast("int")).alias("_triple"))
    flags = Matcher(g.atoms, g.bonds).flags((*GROUPS, *HYDROGEN_BONDS)).withColumnRenamed("flags", "_flags")
    atoms = ring_features(g.atoms, g.bonds).join(kinds, ["mol", "atom"], "left").join(two_step_codes(g.atoms, g.bonds), ["mol", "atom"], "left").join(flags, ["mol", "atom"])
    env = P.bond_environment(cut(atoms), bond_rows(g.bonds), "mol", "atom", "src", "dst", "features")
    c, n = F.col, lambda name: F.coalesce(name, F.lit(0))
    hybrid = F.when((n("_triple") > 0) | ((n("_double") > 1) & c("z").isin(6, 7)), 2).when(c("aromatic") | ((n("_double") > 0) & ~c("z").isin(15, 16)), 3).otherwise(4)
    base = [c("z"), c("degree"), c("charge"), hybrid, c("aromatic").cast("int"), (c("ring_size") > 0).cast("int"), c("hcount")]
    groups, last = len(GROUPS), [F.get("_flags", len(GROUPS)), F.get("_flags", len(GROUPS) + 1), c("ring_size"), c("arom_nbrs"), c("fused_id"), n("code")]
    return env.select("mol", "atom", P.atom_row(base, F.slice("_flags", 1, groups), *last, c("env")).alias("row"))
