"""Queries of molecules. A molecule for each order: every line item adds a fragment to a line of text, which is parsed; and small graphs of seven nodes, which have rings of all sizes up to seven."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import canonical as C
from quillon.operators import homology as H
from quillon.operators import molecules as M
from quillon.plans.common import table
from quillon.plans.cut import stored

#: Fragments: their text, the atom that the next one is joined to, atoms as (z, aromatic, charge, hydrogens where the text gives them), bonds as (atom, atom, kind, smallest ring, on the way through).
FRAGMENTS = (
    ("C", 0, ((6, 0, 0, None),), ()),
    ("c1ccccc1", 5, ((6, 1, 0, None),) * 6, tuple((i, j, "AROMATIC", 6, 0) for i, j in ((0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (0, 5)))),
    ("C(=O)O", 2, ((6, 0, 0, None), (8, 0, 0, None), (8, 0, 0, None)), ((0, 1, "DOUBLE", None, 0), (0, 2, "SINGLE", None, 1))),
    ("N", 0, ((7, 0, 0, None),), ()),
    ("C1CC2CCC1C2", 6, ((6, 0, 0, None),) * 7, tuple((i, j, "SINGLE", 5, 0) for i, j in ((0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (0, 5), (5, 6), (2, 6)))),
    ("[N+](C)(C)", 0, ((7, 0, 1, 0), (6, 0, 0, None), (6, 0, 0, None)), ((0, 1, "SINGLE", None, 0), (0, 2, "SINGLE", None, 0))),
    ("C%12CC%12", 2, ((6, 0, 0, None),) * 3, tuple((i, j, "SINGLE", 3, 0) for i, j in ((0, 1), (1, 2), (0, 2)))),
    ("S(=O)(=O)", 0, ((16, 0, 0, None), (8, 0, 0, None), (8, 0, 0, None)), ((0, 1, "DOUBLE", None, 0), (0, 2, "DOUBLE", None, 0))),
    ("C(Cl)", 0, ((6, 0, 0, None), (17, 0, 0, None)), ((0, 1, "SINGLE", None, 0),)),
    ("OP(=O)(O)", 1, ((8, 0, 0, None), (15, 0, 0, None), (8, 0, 0, None), (8, 0, 0, None)), ((0, 1, "SINGLE", None, 1), (1, 2, "DOUBLE", None, 0), (1, 3, "SINGLE", None, 0))),
    ("c1ccc2[nH]ccc2c1", 8, tuple((7 if i == 4 else 6, 1, 0, 1 if i == 4 else None) for i in range(9)), tuple((i, j, "AROMATIC", r, 0) for i, j, r in ((0, 1, 6), (1, 2, 6), (2, 3, 6), (3, 4, 5), (4, 5, 5), (5, 6, 5), (6, 7, 5), (3, 7, 5), (7, 8, 6), (0, 8, 6)))),
)


def _lines(spark, d):
    """(mol, line): each order's fragments, its line items by number, part and supplier."""
    li = table(spark, d, "lineitem")
    which = ((F.col("l_partkey") + F.col("l_suppkey") + F.col("l_linenumber")) % len(FRAGMENTS)).cast("int")
    parts = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", which.alias("k"))))
    texts = F.array(*[F.lit(f[0]) for f in FRAGMENTS])
    return li.groupBy(F.col("l_orderkey").alias("mol")).agg(parts.alias("p")).select("mol", F.array_join(F.transform("p", lambda x: F.get(texts, x["k"])), "").alias("line"))


def _graphs(spark, d):
    return M.packed_graphs(_lines(spark, d), "mol", "line")


def _small(spark, d):
    """A graph of seven nodes for each order, every line item an edge."""
    li = table(spark, d, "lineitem")
    node = lambda c: (F.col(c) % 7).cast("int")
    return li.select(F.col("l_orderkey").alias("mol"), node("l_suppkey").alias("src"), node("l_partkey").alias("dst"))


def molecule_atoms(spark, d):
    """Atoms of the parsed molecules, with hydrogens by valence, and ring features."""
    found = M.ringed_atoms(_lines(spark, d), "mol", "line", ("atom", "z", "aromatic", "charge", "degree", "hcount", "ring_size", "arom_nbrs", "fused_id"))
    return found.withColumn("aromatic", F.col("aromatic").cast("int"))


def molecule_bonds(spark, d):
    return M.unpacked(_graphs(spark, d), "bonds").select("mol", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "kind", "ring")


def molecule_faults(spark, d):
    """How many lines are sound, and the faults of the others: the last sign of every fifth order's line is cut off, every seventh gets one more."""
    mol, line = F.col("mol"), F.col("line")
    broken = F.when(mol % 5 == 0, F.expr("left(line, length(line) - 1)")).when(mol % 7 == 0, F.concat(line, F.element_at(F.array(*[F.lit(x) for x in (")", "=", "?", "[Xx]", "1", "(")]), (mol % 6 + 1).cast("int")))).otherwise(line)
    return M.faults(_lines(spark, d).select("mol", broken.alias("line")), "mol", "line").groupBy("fault").agg(F.count("*").alias("n"))


def small_ring_bonds(spark, d):
    """The smallest ring of each bond of the seven-node graphs."""
    return M.with_rings(_small(spark, d).where("src <> dst").select("mol", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())


def small_ring_atoms(spark, d):
    """Ring size, aromatic neighbours and ring system of each node of the seven-node graphs; odd nodes count as aromatic."""
    bonds = M.with_rings(_small(spark, d))
    atoms = bonds.select("mol", F.explode(F.array("src", "dst")).alias("atom")).distinct().withColumn("aromatic", F.col("atom") % 2 == 1)
    return M.ring_features(atoms, bonds).select("mol", "atom", "ring_size", "arom_nbrs", "fused_id")


def murcko_scaffold(spark, d):
    """The bonds of every molecule's scaffold, with what hangs on it by a double bond."""
    return M.packed_scaffolds(_graphs(spark, d)).select("mol", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "kind")


def small_scaffold(spark, d):
    """Rings and links of the seven-node graphs."""
    plain = _small(spark, d).where("src <> dst").select("mol", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct().withColumn("kind", F.lit("SINGLE"))
    return M.scaffolds(plain).select("mol", "src", "dst")


def functional_groups(spark, d):
    """Atoms of each of the 18 groups in each molecule, and those that give and take hydrogen bonds."""
    patterns = (*M.GROUPS, *M.HYDROGEN_BONDS)
    found = M.packed_group_counts(_graphs(spark, d).where(F.size("atoms") > 0), patterns)
    return found.select("mol", *[F.get("counts", k).alias(p.name.lower()) for k, p in enumerate(patterns)])


def _edges(spark, d, nodes: int):
    """Bonds of a graph of few nodes for each order, its line items, without loops; some are repeated."""
    li = table(spark, d, "lineitem")
    a, b = (F.col("l_suppkey") % nodes).cast("int"), (F.col("l_partkey") % nodes).cast("int")
    return li.where(a != b).select(F.col("l_orderkey").alias("mol"), F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")).withColumn("kind", F.lit("SINGLE"))


def _ends(bonds):
    return bonds.select("mol", F.explode(F.array("src", "dst")).alias("atom"))


def isomorphism_classes(spark, d):
    """For the six-node graph of each order the first order whose graph differs from it in numbers only."""
    bonds = _edges(spark, d, 6)
    keys = C.canonical(_ends(bonds), bonds, (), kinds=False)
    return keys.select("mol", "key").join(keys.groupBy("key").agg(F.min("mol").alias("first_mol")).hint("merge"), "key").select("mol", "first_mol")


def _templates(spark, d):
    """A graph of seven nodes for each order and three targets: two with other numbers, one without the last bond; (templates and targets with their bonds as arrays, maps)."""
    rows = stored(_edges(spark, d, 7).groupBy("mol").agg(F.array_sort(F.collect_set(F.struct("src", "dst"))).alias("b")))
    of = lambda f: F.transform("b", lambda x: F.struct(*[f(x[c]).cast("int").alias(c) for c in ("src", "dst")]))
    kinds = (of(lambda c: (c * 3 + 1) % 7), of(lambda c: (c * 5 + 2) % 7 + 10), F.slice("b", F.lit(1), F.size("b") - 1))
    targets = rows.select("mol", F.posexplode(F.array(*kinds)).alias("k", "b")).where(F.size("b") > 0).select((F.col("mol") * 4 + F.col("k")).alias("mol"), "b")
    pairs = rows.select(F.col("mol").alias("template"), F.explode(F.array(*[F.col("mol") * 4 + k for k in range(3)])).alias("target"))
    bonds = lambda x: M.unpacked(x, "b").withColumn("kind", F.lit("SINGLE"))
    key = lambda x: C.canonical(_ends(bonds(x)), bonds(x), ())
    return rows, targets, C.template_maps(pairs, key(rows), key(targets))


def template_match(spark, d):
    """The bonds that each map keeps."""
    rows, targets, maps = _templates(spark, d)
    known = maps.join(targets.select(F.col("mol").alias("target"), F.col("b").alias("t")).hint("merge"), "target").join(rows.select(F.col("mol").alias("template"), "b").hint("merge"), "template")
    pair = lambda x, y: F.struct(F.least(x, y).alias("x"), F.greatest(x, y).alias("y"))
    mapped = known.withColumn("m", F.map_from_entries("atoms")).withColumn("b", F.transform("b", lambda e: pair(F.element_at("m", e["src"]), F.element_at("m", e["dst"]))))
    kept = F.array_intersect("b", F.transform("t", lambda e: pair(e["src"], e["dst"])))
    return mapped.select("template", "target", F.size("b").cast("long").alias("n_bonds"), F.size(kept).cast("long").alias("n_kept"))


def best_ligand(spark, d):
    """Of an order's targets that fit the one whose line items have most suppliers; items touch targets by their number."""
    _, _, maps = _templates(spark, d)
    contacts = table(spark, d, "lineitem").select((F.col("l_orderkey") * 4 + F.col("l_linenumber") % 3).alias("target"), (F.col("l_suppkey") % 50).alias("residue"))
    return C.best_targets(maps, contacts).select("template", "target", "contact_n", F.size("atoms").alias("n_atoms"))


def _sequences(spark, d):
    """A sequence of letters for each customer: families of three share one, of which each has a quarter of the letters changed and a few cut off at the start."""
    c, alphabet = table(spark, d, "customer").select("c_custkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "c_custkey"), F.lit("ACDEFGHIKLMNPQRSTVWY")  # keys fit one task, sequences are more
    letter = lambda h: F.substr(alphabet, (F.pmod(h, F.lit(20)) + 1).cast("int"), F.lit(1))
    family, own = F.floor(F.col("c_custkey") / 3), F.col("c_custkey")
    at = lambda i: F.when(F.pmod(F.xxhash64(F.lit("change"), own, i), F.lit(4)) == 0, letter(F.xxhash64(own, i))).otherwise(letter(F.xxhash64(F.lit("family"), family, i)))
    return c.select("c_custkey", F.array_join(F.transform(F.sequence((own % 7 + 1).cast("int"), F.lit(120)), at), "").alias("seq"))


def homology_hits(spark, d):
    """Hits of every hundredth customer's sequence among all of them."""
    s = _sequences(spark, d)
    found = H.search(s.where("c_custkey % 100 = 0"), s, "c_custkey", "seq")
    return found.select("query", "target", F.round("pident", 6).alias("pident"), "alnlen", F.round("qcov", 6).alias("qcov"), F.round("tcov", 6).alias("tcov"), F.round("bits", 6).alias("bits"))


QUERIES = {f.__name__: f for f in (molecule_atoms, molecule_bonds, molecule_faults, small_ring_bonds, small_ring_atoms, murcko_scaffold, small_scaffold, functional_groups, isomorphism_classes, template_match, best_ligand, homology_hits)}


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


_MOL = f"""
frag(k, n, tail) AS (VALUES {_values((k, len(f[2]), f[1]) for k, f in enumerate(FRAGMENTS))}),
fatom(k, i, z, aromatic, charge, h) AS (VALUES {_values((k, i, *a) for k, f in enumerate(FRAGMENTS) for i, a in enumerate(f[2]))}),
fbond(k, a, b, kind, ring, way) AS (VALUES {_values((k, *b) for k, f in enumerate(FRAGMENTS) for b in f[3])}),
item AS (SELECT l_orderkey AS mol, (l_partkey + l_suppkey + l_linenumber) % {len(FRAGMENTS)} AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS place FROM lineitem),
placed AS (SELECT mol, place, item.k, n, tail, sum(n) OVER (PARTITION BY mol ORDER BY place) - n AS off, n > 2 AND ring IS NOT NULL AS ringed FROM item JOIN frag USING (k) LEFT JOIN (SELECT k, max(ring) AS ring FROM fbond GROUP BY k) USING (k)),
link AS (SELECT mol, place, off + tail AS src, lead(off) OVER (PARTITION BY mol ORDER BY place) AS dst FROM placed),
bond AS (SELECT mol, place, CAST(off + a AS INTEGER) AS src, CAST(off + b AS INTEGER) AS dst, kind, CAST(ring AS INTEGER) AS ring, way, 0 AS joint FROM placed JOIN fbond USING (k)
  UNION ALL SELECT mol, place, src, dst, 'SINGLE', NULL, 1, 1 FROM link WHERE dst IS NOT NULL),
ends AS (SELECT mol, src AS atom, dst AS other, kind, ring FROM bond UNION ALL SELECT mol, dst, src, kind, ring FROM bond),
sums AS (SELECT mol, atom, count(*) AS degree, sum(CASE kind WHEN 'DOUBLE' THEN 2 ELSE 1 END) AS o, coalesce(min(ring), 0) AS ring_size FROM ends GROUP BY ALL),
raw AS (SELECT mol, place, off + i AS atom, z, aromatic, charge, h FROM placed JOIN fatom USING (k)),
atoms AS (SELECT mol, place, CAST(atom AS INTEGER) AS atom, z, aromatic, charge, coalesce(degree, 0) AS degree, coalesce(ring_size, 0) AS ring_size, coalesce(h, CASE
  WHEN aromatic = 1 THEN greatest(0, 3 - coalesce(o, 0))
  WHEN z = 6 THEN greatest(0, 4 - coalesce(o, 0)) WHEN z = 7 THEN CASE WHEN coalesce(o, 0) <= 3 THEN 3 - coalesce(o, 0) ELSE greatest(0, 5 - o) END
  WHEN z = 8 THEN greatest(0, 2 - coalesce(o, 0)) WHEN z = 15 THEN CASE WHEN coalesce(o, 0) <= 3 THEN 3 - coalesce(o, 0) ELSE greatest(0, 5 - o) END
  WHEN z = 16 THEN CASE WHEN coalesce(o, 0) <= 2 THEN 2 - coalesce(o, 0) WHEN o <= 4 THEN 4 - o ELSE greatest(0, 6 - o) END ELSE greatest(0, 1 - coalesce(o, 0)) END) AS hcount
  FROM raw LEFT JOIN sums USING (mol, atom))"""
_SMALL = """
e AS (SELECT DISTINCT l_orderkey AS mol, least(l_suppkey % 7, l_partkey % 7) AS src, greatest(l_suppkey % 7, l_partkey % 7) AS dst FROM lineitem WHERE l_suppkey % 7 <> l_partkey % 7),
two AS (SELECT mol, src, dst FROM e UNION ALL SELECT mol, dst, src FROM e),
walk AS (SELECT mol, src AS a, dst AS b, src AS node, 0 AS d FROM e
  UNION SELECT w.mol, a, b, two.dst, d + 1 FROM walk w JOIN two ON w.mol = two.mol AND w.node = two.src WHERE d < 6 AND w.node <> b AND NOT (least(two.src, two.dst) = a AND greatest(two.src, two.dst) = b)),
ringed AS (SELECT mol, a AS src, b AS dst, min(CASE WHEN node = b THEN d + 1 END) AS ring FROM walk GROUP BY ALL)"""
#: A bond is of the scaffold if it lies in a ring, or if each of its ends reaches a ring without it.
_CORE = """
reach AS (SELECT mol, src AS a, dst AS b, src AS root, src AS node FROM e UNION SELECT mol, src, dst, dst, dst FROM e
  UNION SELECT r.mol, a, b, root, two.dst FROM reach r JOIN two ON r.mol = two.mol AND r.node = two.src WHERE NOT (least(two.src, two.dst) = a AND greatest(two.src, two.dst) = b)),
inring AS (SELECT DISTINCT mol, unnest([src, dst]) AS node FROM ringed WHERE ring IS NOT NULL),
sides AS (SELECT DISTINCT mol, a, b, root FROM reach SEMI JOIN inring USING (mol, node))"""


_G = "near AS (SELECT mol, ends.atom, ends.kind, o.atom AS other, o.z, o.aromatic, o.charge, o.hcount, o.degree FROM ends JOIN atoms o ON ends.mol = o.mol AND ends.other = o.atom)"


def _part(name: str, rows: str) -> str:
    """The atoms of a group in each molecule: rows gives lists of the atoms of matches."""
    return f"{name} AS (SELECT mol, count(DISTINCT atom) AS n FROM (SELECT mol, unnest(m) AS atom FROM ({rows})) GROUP BY mol)"


_OXO = "JOIN near d ON a.mol = d.mol AND a.atom = d.atom AND d.kind = 'DOUBLE' AND d.z = 8 AND d.aromatic = 0"
_AT = lambda n, kind, cond: f"JOIN near {n} ON a.mol = {n}.mol AND a.atom = {n}.atom AND {n}.kind {kind} AND {cond.replace('@', n)}"
_ONE = "IN ('SINGLE', 'AROMATIC')"
_OH = "@.z = 8 AND @.aromatic = 0 AND @.degree + @.hcount = 2 AND @.hcount = 1"
_SQL_GROUPS = {
    "hydroxyl": "SELECT mol, [atom] AS m FROM atoms a WHERE " + _OH.replace("@", "a"),
    "alcohol": f"SELECT a.mol, [a.atom, x.other] AS m FROM atoms a {_AT('x', _ONE, _OH)} WHERE a.z = 6 AND a.aromatic = 0 AND a.degree + a.hcount = 4",
    "amine": f"SELECT a.mol, [a.atom] AS m FROM atoms a WHERE z = 7 AND aromatic = 0 AND degree + hcount = 3 AND hcount < 3 AND NOT EXISTS (SELECT 1 FROM near c JOIN near o ON c.mol = o.mol AND c.other = o.atom WHERE c.mol = a.mol AND c.atom = a.atom AND c.kind {_ONE} AND c.z = 6 AND c.aromatic = 0 AND o.kind = 'DOUBLE' AND o.z = 8 AND o.aromatic = 0)",
    "amide": f"SELECT a.mol, [a.atom, d.other, x.other] AS m FROM atoms a {_OXO} {_AT('x', _ONE, '@.z = 7 AND @.aromatic = 0')} WHERE a.z = 6 AND a.aromatic = 0",
    "carboxyl": f"SELECT a.mol, [a.atom, d.other, x.other] AS m FROM atoms a {_OXO} {_AT('x', _ONE, '@.z = 8 AND @.aromatic = 0 AND (@.degree + @.hcount = 2 AND @.hcount = 1 OR @.charge = -1)')} WHERE a.z = 6 AND a.aromatic = 0",
    "carbonyl": f"SELECT a.mol, [a.atom, d.other] AS m FROM atoms a {_OXO} WHERE a.z = 6 AND a.aromatic = 0 AND a.degree + a.hcount = 3",
    "aldehyde": f"SELECT a.mol, [a.atom, d.other, x.other] AS m FROM atoms a {_OXO} {_AT('x', _ONE, '@.z = 6')} WHERE a.z = 6 AND a.aromatic = 0 AND a.degree + a.hcount = 3 AND a.hcount = 1",
    "ketone": f"SELECT a.mol, [a.atom, d.other, x.other] AS m FROM atoms a {_OXO} {_AT('x', _ONE, '@.z = 6')} WHERE a.z = 6 AND a.aromatic = 0 AND a.degree + a.hcount = 3",
    "ester": f"SELECT a.mol, [a.atom, d.other, x.other, y.other] AS m FROM atoms a {_OXO} {_AT('x', _ONE, '@.z = 8 AND @.aromatic = 0 AND @.other <> d.other')} JOIN near y ON y.mol = x.mol AND y.atom = x.other AND y.kind {_ONE} AND y.z = 6 AND y.other <> a.atom WHERE a.z = 6 AND a.aromatic = 0",
    "ether": f"SELECT a.mol, [a.atom, x.other, y.other] AS m FROM atoms a {_AT('x', _ONE, '@.z = 6')} {_AT('y', _ONE, '@.z = 6 AND @.other <> x.other')} WHERE a.z = 8 AND a.aromatic = 0 AND a.degree = 2",
    "phenol": f"SELECT a.mol, [a.atom, x.other] AS m FROM atoms a {_AT('x', _ONE, '@.z = 8 AND @.aromatic = 0 AND @.hcount = 1')} WHERE a.z = 6 AND a.aromatic = 1",
    "aromatic": "SELECT mol, [atom] AS m FROM atoms WHERE aromatic = 1",
    "heteroaromaticn": "SELECT mol, [atom] AS m FROM atoms WHERE aromatic = 1 AND z = 7",
    "halogen": "SELECT mol, [atom] AS m FROM atoms WHERE z IN (9, 17, 35, 53)",
    "sulfonyl": f"SELECT a.mol, [a.atom, d.other, x.other, y.other] AS m FROM atoms a {_OXO} {_AT('x', '= ' + repr('DOUBLE'), '@.z = 8 AND @.other <> d.other')} {_AT('y', _ONE, '@.z IN (7, 8) AND @.aromatic = 0')} WHERE a.z = 16",
    "donor": "SELECT mol, [atom] AS m FROM atoms WHERE z IN (7, 8, 16) AND hcount > 0 AND charge >= 0",
    "acceptor": f"SELECT a.mol, [a.atom] AS m FROM atoms a WHERE (z IN (8, 16) AND degree + hcount < 3 OR z = 7 AND degree + hcount < 4 AND NOT (aromatic = 1 AND degree + hcount = 3)) AND charge <= 0 AND NOT (z = 7 AND aromatic = 0 AND (EXISTS (SELECT 1 FROM near c JOIN near o ON c.mol = o.mol AND c.other = o.atom WHERE c.mol = a.mol AND c.atom = a.atom AND c.kind = 'SINGLE' AND c.z IN (6, 16) AND o.kind = 'DOUBLE' AND o.z IN (7, 8, 16)) OR EXISTS (SELECT 1 FROM near c WHERE c.mol = a.mol AND c.atom = a.atom AND c.kind = 'SINGLE' AND c.aromatic = 1)))",
    "thiol": "SELECT mol, [atom] AS m FROM atoms WHERE z = 16 AND aromatic = 0 AND degree + hcount = 2 AND hcount = 1",
    "disulfide": f"SELECT a.mol, [a.atom, x.other] AS m FROM atoms a {_AT('x', '= ' + repr('SINGLE'), '@.z = 16')} WHERE a.z = 16",
    "phosphate": f"SELECT a.mol, [a.atom, d.other, x.other, y.other, w.other] AS m FROM atoms a {_OXO} {_AT('x', _ONE, '@.z = 8')} {_AT('y', _ONE, '@.z = 8 AND @.other <> x.other')} {_AT('w', _ONE, '@.z = 8 AND @.other NOT IN (x.other, y.other)')} WHERE a.z = 15",
}

def _edge_sql(nodes: int) -> str:
    a, b = f"l_suppkey % {nodes}", f"l_partkey % {nodes}"
    return f"e AS (SELECT DISTINCT l_orderkey AS mol, least({a}, {b}) AS src, greatest({a}, {b}) AS dst FROM lineitem WHERE {a} <> {b})"


ORACLES = {
    "molecule_atoms": f"WITH RECURSIVE {_MOL}, near AS (SELECT ends.mol, ends.atom, count(*) AS n FROM ends JOIN atoms o ON ends.mol = o.mol AND ends.other = o.atom AND o.aromatic = 1 GROUP BY ALL), ringed AS (SELECT mol, place, dense_rank() OVER (PARTITION BY mol ORDER BY place) AS fused_id FROM placed WHERE ringed) SELECT mol, atom, z, aromatic, charge, degree, hcount, ring_size, coalesce(n, 0) AS arom_nbrs, coalesce(fused_id, 0) AS fused_id FROM atoms LEFT JOIN near USING (mol, atom) LEFT JOIN ringed USING (mol, place)",
    "molecule_bonds": f"WITH {_MOL} SELECT mol, least(src, dst) AS src, greatest(src, dst) AS dst, kind, ring FROM bond",
    "molecule_faults": f"""WITH {_MOL}, last AS (SELECT mol, k FROM item QUALIFY place = max(place) OVER (PARTITION BY mol))
SELECT CASE WHEN mol % 5 = 0 THEN [NULL, 'ring', NULL, NULL, 'ring', 'branch', 'token', 'branch', 'branch', 'branch', 'ring'][k + 1] WHEN mol % 7 = 0 THEN ['branch', 'bond', 'token', 'atom', 'ring', 'branch'][mol % 6 + 1] END AS fault, count(*) AS n FROM last GROUP BY 1""",
    "small_ring_bonds": f"WITH RECURSIVE {_SMALL} SELECT mol, src, dst, ring FROM ringed",
    "small_ring_atoms": f"""WITH RECURSIVE {_SMALL},
r2 AS (SELECT mol, src, dst, ring FROM ringed WHERE ring IS NOT NULL UNION ALL SELECT mol, dst, src, ring FROM ringed WHERE ring IS NOT NULL),
comp AS (SELECT DISTINCT mol, src AS atom, src AS c FROM r2 UNION SELECT comp.mol, r2.dst, c FROM comp JOIN r2 ON comp.mol = r2.mol AND comp.atom = r2.src),
root AS (SELECT mol, atom, min(c) AS c FROM comp GROUP BY ALL), ids AS (SELECT mol, atom, dense_rank() OVER (PARTITION BY mol ORDER BY c) AS fused_id FROM root),
size AS (SELECT mol, src AS atom, min(ring) AS ring_size FROM r2 GROUP BY ALL),
node AS (SELECT DISTINCT l_orderkey AS mol, unnest([l_suppkey % 7, l_partkey % 7]) AS atom FROM lineitem),
near AS (SELECT mol, src AS atom, count(*) AS n FROM two WHERE dst % 2 = 1 GROUP BY ALL)
SELECT mol, atom, coalesce(ring_size, 0) AS ring_size, coalesce(n, 0) AS arom_nbrs, coalesce(fused_id, 0) AS fused_id FROM node LEFT JOIN size USING (mol, atom) LEFT JOIN near USING (mol, atom) LEFT JOIN ids USING (mol, atom)""",
    "murcko_scaffold": f"""WITH {_MOL}, span AS (SELECT mol, min(place) AS first, max(place) AS last FROM placed WHERE ringed GROUP BY mol)
SELECT mol, least(src, dst) AS src, greatest(src, dst) AS dst, kind FROM bond JOIN span USING (mol)
WHERE ring IS NOT NULL OR joint = 1 AND place >= first AND place < last OR joint = 0 AND place > first AND place < last AND (way = 1 OR kind = 'DOUBLE')""",
    "small_scaffold": f"WITH RECURSIVE {_SMALL}, {_CORE} SELECT mol, src, dst FROM ringed WHERE ring IS NOT NULL UNION SELECT mol, a, b FROM sides GROUP BY mol, a, b HAVING count(*) = 2",
    "functional_groups": f"WITH {_MOL}, {_G.replace('SELECT mol,', 'SELECT ends.mol,')}, " + ", ".join(_part(n, q) for n, q in _SQL_GROUPS.items()) + ", mols AS (SELECT DISTINCT mol FROM atoms) SELECT mol, " + ", ".join(f"coalesce({n}.n, 0) AS {n}" for n in _SQL_GROUPS) + " FROM mols " + " ".join(f"LEFT JOIN {n} USING (mol)" for n in _SQL_GROUPS),
    "isomorphism_classes": f"""WITH {_edge_sql(6)}, digit AS (SELECT unnest(range(6)) AS x),
perm AS (SELECT [a.x, b.x, c.x, d.x, e.x, f.x] AS p FROM digit a JOIN digit b ON b.x <> a.x JOIN digit c ON c.x NOT IN (a.x, b.x) JOIN digit d ON d.x NOT IN (a.x, b.x, c.x) JOIN digit e ON e.x NOT IN (a.x, b.x, c.x, d.x) JOIN digit f ON f.x NOT IN (a.x, b.x, c.x, d.x, e.x)),
graph AS (SELECT mol, list((src, dst) ORDER BY src, dst) AS es FROM e GROUP BY mol), own AS (SELECT DISTINCT es FROM graph),
form AS (SELECT es, min(list_sum(list_transform(es, lambda q: CAST(1 AS BIGINT) << CAST(least(p[q[1] + 1], p[q[2] + 1]) * 6 + greatest(p[q[1] + 1], p[q[2] + 1]) AS BIGINT)))) AS k FROM own, perm GROUP BY es)
SELECT mol, min(mol) OVER (PARTITION BY k) AS first_mol FROM graph JOIN form USING (es)""",
    "template_match": f"WITH {_edge_sql(7)}, n AS (SELECT mol, count(*) AS n FROM e GROUP BY mol) SELECT mol AS template, mol * 4 + k AS target, n AS n_bonds, n AS n_kept FROM n, (SELECT unnest([0, 1]) AS k)",
    "best_ligand": f"""WITH {_edge_sql(7)}, n AS (SELECT mol, count(DISTINCT x) AS n_atoms FROM (SELECT mol, unnest([src, dst]) AS x FROM e) GROUP BY mol),
c AS (SELECT l_orderkey AS mol, l_linenumber % 3 AS k, count(DISTINCT l_suppkey % 50) AS contact_n FROM lineitem GROUP BY ALL),
t AS (SELECT mol, k, n_atoms, coalesce(contact_n, 0) AS contact_n FROM n CROSS JOIN (SELECT unnest([0, 1]) AS k) LEFT JOIN c USING (mol, k))
SELECT mol AS template, mol * 4 + k AS target, contact_n, n_atoms FROM t QUALIFY row_number() OVER (PARTITION BY mol ORDER BY contact_n DESC, k) = 1""",
}
