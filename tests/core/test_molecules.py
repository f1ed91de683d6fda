"""Molecules: lines of text, rings, scaffolds and patterns against hand-written graphs and plain searches."""

import itertools
import random

import pytest

from quillon.operators import molecules as M

LINES = [
    # line, fault, bonds as (a, b, kind), hydrogens, charges
    ("", None, [], [], []),
    ("C", None, [], [4], [0]),
    ("CC(=O)O", None, [(0, 1, "SINGLE"), (1, 2, "DOUBLE"), (1, 3, "SINGLE")], [3, 0, 0, 1], [0, 0, 0, 0]),
    ("c1ccccc1-c1ccncc1", None, [(0, 1, "AROMATIC"), (1, 2, "AROMATIC"), (2, 3, "AROMATIC"), (3, 4, "AROMATIC"), (4, 5, "AROMATIC"), (0, 5, "AROMATIC"), (5, 6, "SINGLE"), (6, 7, "AROMATIC"), (7, 8, "AROMATIC"), (8, 9, "AROMATIC"), (9, 10, "AROMATIC"), (10, 11, "AROMATIC"), (6, 11, "AROMATIC")], [1, 1, 1, 1, 1, 0, 0, 1, 1, 0, 1, 1], [0] * 12),
    ("c1ccccc1c1ccccc1", None, None, [1, 1, 1, 1, 1, 0, 0, 1, 1, 1, 1, 1], [0] * 12),
    ("[NH4+].[Cl-]", None, [], [4, 0], [1, -1]),
    ("C%10CC%10", None, [(0, 1, "SINGLE"), (1, 2, "SINGLE"), (0, 2, "SINGLE")], [2, 2, 2], [0] * 3),
    ("C1CC1C1CC1", None, [(0, 1, "SINGLE"), (1, 2, "SINGLE"), (0, 2, "SINGLE"), (2, 3, "SINGLE"), (3, 4, "SINGLE"), (4, 5, "SINGLE"), (3, 5, "SINGLE")], [2, 2, 1, 1, 2, 2], [0] * 6),
    ("N#CC=CC", None, [(0, 1, "TRIPLE"), (1, 2, "SINGLE"), (2, 3, "DOUBLE"), (3, 4, "SINGLE")], [0, 0, 1, 1, 3], [0] * 5),
    ("F/C=C/Br", None, [(0, 1, "SINGLE"), (1, 2, "DOUBLE"), (2, 3, "SINGLE")], [0, 1, 1, 0], [0] * 4),
    ("[13C@H](N)([O-])[Fe+2]", None, [(0, 1, "SINGLE"), (0, 2, "SINGLE"), (0, 3, "SINGLE")], [1, 2, 0, 0], [0, 0, -1, 2]),
    ("C=1CCCCC=1", None, [(0, 1, "SINGLE"), (1, 2, "SINGLE"), (2, 3, "SINGLE"), (3, 4, "SINGLE"), (4, 5, "SINGLE"), (0, 5, "DOUBLE")], [1, 2, 2, 2, 2, 1], [0] * 6),
    ("CS(=O)(=O)C", None, [(0, 1, "SINGLE"), (1, 2, "DOUBLE"), (1, 3, "DOUBLE"), (1, 4, "SINGLE")], [3, 0, 0, 0, 3], [0] * 5),
    ("c1cc[nH]c1", None, [(0, 1, "AROMATIC"), (1, 2, "AROMATIC"), (2, 3, "AROMATIC"), (3, 4, "AROMATIC"), (0, 4, "AROMATIC")], [1, 1, 1, 1, 1], [0] * 5),
    ("[Ca++]", None, [], [0], [2]),
    ("C(", "branch", None, None, None), ("C)", "branch", None, None, None), ("(C)", "branch", None, None, None), ("C1CC", "ring", None, None, None), ("C11", "ring", None, None, None), ("C12CC12", "ring", None, None, None), ("C=", "bond", None, None, None),
    ("=C", "bond", None, None, None), ("C==C", "bond", None, None, None), ("C=1CC#1", "ring", None, None, None), ("C?C", "token", None, None, None), ("[Zz]", "atom", None, None, None), ("[C", "token", None, None, None), ("[cl]", "atom", None, None, None), (None, "null", None, None, None),
]


@pytest.fixture(scope="module")
def graphs(spark):
    rows = [(i, line[0], "x") for i, line in enumerate(LINES)]
    return M.graphs(spark.createDataFrame(rows, "id long, line string, kind string"), "id", "line")


def test_lines(graphs):
    assert {r.mol: r.fault for r in graphs.status.collect()} == {i: line[1] for i, line in enumerate(LINES)}
    atoms, bonds = graphs.atoms.orderBy("mol", "atom").collect(), graphs.bonds.collect()
    for i, (line, fault, edges, h, charges) in enumerate(LINES):
        own = [r for r in atoms if r.mol == i]
        assert ([r.hcount for r in own], [r.charge for r in own]) == ((h, charges) if fault is None else ([], [])), line
        if edges is not None:
            assert {(min(r.src, r.dst), max(r.src, r.dst), r.kind) for r in bonds if r.mol == i} == set(edges), line
    single = [(r.src, r.dst) for r in bonds if r.mol == 4 and r.kind == "SINGLE"]
    assert single == [(5, 6)]  # no sign, but no ring either
    assert {r.way for r in bonds if r.mol == 9} == {"ENDUPRIGHT", "NONE"}
    assert [(r.isotope, r.z) for r in atoms if r.mol == 10] == [(13, 6), (None, 7), (None, 8), (None, 26)]


def random_graphs(rng, n):
    out = []
    for mol in range(n):
        size = rng.randint(1, 11)
        edges = {tuple(sorted(rng.sample(range(size), 2))) for _ in range(rng.randint(0, size + 4))} if size > 1 else set()
        out += [(mol, a, b) if rng.random() < 0.5 else (mol, b, a) for a, b in sorted(edges)]
    return out


def cycle(edges, a, b):
    """The length of a shortest cycle through a bond, by a plain search."""
    near, left = {}, [(a, 0)]
    for x, y in edges:
        if {x, y} != {a, b}:
            near.setdefault(x, []).append(y), near.setdefault(y, []).append(x)
    seen = {a}
    for x, d in left:
        if x == b:
            return d + 1
        for y in near.get(x, ()):
            if y not in seen:
                seen.add(y), left.append((y, d + 1))
    return None


def by_mol(edges):
    out = {}
    for mol, a, b in edges:
        out.setdefault(mol, []).append((a, b))
    return out


def test_rings_of_random_graphs(spark):
    edges = random_graphs(random.Random(1), 60) + [(100, k, (k + 1) % 30) for k in range(30)] + [(100, 40, 41), (101, 5, 5), (102, 1, 2), (102, 2, 1)]
    df = spark.createDataFrame(edges, "mol long, src int, dst int")
    bonds = M.with_rings(df)
    assert bonds.count() == len(edges)
    groups = by_mol(edges)
    for r in bonds.collect():
        assert r.ring == (cycle(groups[r.mol], r.src, r.dst) if r.src != r.dst else None), r
    atoms = df.select("mol", "src").union(df.select("mol", "dst")).distinct().toDF("mol", "atom").selectExpr("mol", "atom", "atom % 3 = 0 AS aromatic", "'extra' AS note")
    for r in M.ring_features(atoms, bonds).collect():
        own = [(a, b, cycle(groups[r.mol], a, b)) for a, b in groups[r.mol] if a != b]
        sizes = [c for a, b, c in own if c and r.atom in (a, b)]
        assert r.ring_size == min(sizes, default=0)
        assert r.arom_nbrs == len({(b if a == r.atom else a) for a, b, _ in own if r.atom in (a, b) and (b if a == r.atom else a) % 3 == 0})
        systems = {}
        for a, b, c in own:
            if c:
                joined = {a, b}.union(*[s for s in systems.values() if s & {a, b}])
                systems = {min(s): s for s in [*[s for s in systems.values() if not s & {a, b}], joined]}
        assert r.fused_id == next((k for k, root in enumerate(sorted(systems), 1) if r.atom in systems[root]), 0)


def test_scaffolds(spark):
    edges = random_graphs(random.Random(2), 50)
    found = {(r.mol, min(r.src, r.dst), max(r.src, r.dst)) for r in M.scaffolds(spark.createDataFrame(edges, "mol long, src int, dst int").selectExpr("*", "'SINGLE' AS kind")).collect()}
    wanted = set()
    for mol, own in by_mol(edges).items():
        left = {tuple(sorted(e)) for e in own}
        while True:
            degree = {}
            for e in left:
                for x in e:
                    degree[x] = degree.get(x, 0) + 1
            keep = {e for e in left if min(degree[e[0]], degree[e[1]]) > 1}
            if keep == left:
                break
            left = keep
        wanted |= {(mol, *e) for e in left}
    assert found == wanted


def test_scaffolds_of_lines(spark):
    lines = [("O=C1C=CC(C)C=C1CCN", {(0, 1), (1, 2), (2, 3), (3, 4), (4, 6), (6, 7), (1, 7)}), ("CCCC", set()), ("C1CC1CCC(=O)C1CC1", None), ("C1CC1CCC(=O)C1CC1", None), ("C1CC1C(=O)CCC1CC1", None), ("C1CC1CCC(O)C1CC1", None)]
    g = M.graphs(spark.createDataFrame([(i, x[0]) for i, x in enumerate(lines)], "id long, line string"), "id", "line")
    core = M.scaffolds(g.bonds)
    assert {tuple(sorted((r.src, r.dst))) for r in core.where("mol = 0").collect()} == lines[0][1] and core.where("mol = 1").count() == 0
    keys = {r.mol: r.scaffold for r in M.scaffold_keys(g.atoms, core).collect()}
    assert set(keys) == {0, 2, 3, 4, 5} and keys[2] == keys[3] == keys[4] != keys[5]  # the same scaffold written from either end
    clusters = M.scaffold_clusters(g.status.select("mol"), "mol", M.scaffold_keys(g.atoms, core)).collect()
    assert {r.mol: r.cluster for r in clusters}[1] == "mol:1" and len({r.cluster for r in clusters}) == 4


GROUP_LINES = [
    "CCO", "CC(=O)N", "CC(=O)O", "CC(=O)[O-]", "CC=O", "CC(=O)C", "CC(=O)OC", "COC", "Oc1ccccc1", "c1ccncc1", "CCl", "CS(=O)(=O)N", "CS", "CSSC", "COP(=O)(O)OC", "CN(C)C", "C[N+](C)(C)C", "NC(=O)c1ccccc1",
    "O=C1CCCC1", "c1ccc2[nH]ccc2c1", "OC(=O)CCSSCC(N)C(=O)OC", "FC(F)(F)S(=O)(=O)O",
]


def plain_matches(pattern, atoms, bonds):
    """All ways to place a pattern, trying every choice of atoms."""
    names = ("z", "aromatic", "charge", "hcount", "degree", "total")
    ok = [[a["atom"] for a in atoms if eval(c.replace(" = ", " == "), {}, {n: a[n] for n in names})] for c in pattern.atoms]
    kinds = {(x, y): k for a, b, k in bonds for x, y in ((a, b), (b, a))}
    found = {m for m in itertools.product(*ok) if len(set(m)) == len(m) and all(kinds.get((m[i], m[j])) in k for i, j, k in pattern.bonds)}
    return {m for m in found if not any(m[0] == n[0] for never in pattern.never for n in plain_matches(never, atoms, bonds))}


RING = M.Pattern("triangle", ("z = 6", "z = 6", "z = 6"), ((0, 1, M.ANY), (1, 2, M.ANY), (0, 2, M.ANY)))


def test_groups(spark):
    g = M.graphs(spark.createDataFrame([(i, x) for i, x in enumerate([*GROUP_LINES, "C1CC1CC1CC1", ""])], "id long, line string"), "id", "line")
    matcher, patterns = M.Matcher(g.atoms, g.bonds), (*M.GROUPS, *M.HYDROGEN_BONDS, RING)
    atoms = [r.asDict() | {"total": r.degree + r.hcount} for r in g.atoms.collect()]
    bonds = g.bonds.collect()
    flags = {(r.mol, r.atom): r.flags for r in matcher.flags(patterns).collect()}
    assert set(flags) == {(a["mol"], a["atom"]) for a in atoms}
    seen = [0] * len(patterns)
    for mol in {a["mol"] for a in atoms}:
        own, edges = [a for a in atoms if a["mol"] == mol], [(b.src, b.dst, b.kind) for b in bonds if b.mol == mol]
        for k, p in enumerate(patterns):
            hit = {x for m in plain_matches(p, own, edges) for x in m}
            seen[k] += len(hit)
            assert {a["atom"] for a in own if flags[mol, a["atom"]][k]} == hit, (mol, p.name)
    assert all(seen)
    assert {tuple(r)[1:] for r in matcher.matches(RING).collect()} == {m for base in ((0, 1, 2), (4, 5, 6)) for m in itertools.permutations(base)}


def test_no_molecules(spark):
    g = M.graphs(spark.createDataFrame([], "id long, line string"), "id", "line")
    assert g.atoms.count() == 0 and M.ring_features(g.atoms, g.bonds).count() == 0 and M.scaffolds(g.bonds).count() == 0
    assert M.Matcher(g.atoms, g.bonds).flags().count() == 0


def test_atom_rows(spark):
    lines = ["CC(=O)Nc1ccccc1", "C=CC=C", "[Na+]", "CC#N"]
    g = M.graphs(spark.createDataFrame(list(enumerate(lines)), "id long, line string"), "id", "line")
    rows = {(r.mol, r.atom): r.row for r in M.atom_rows(g).collect()}
    assert len(rows) == 18 and {len(r) for r in rows.values()} == {79}
    base = {k: r[:7] for k, r in rows.items()}  # z, degree, charge, hybrid, aromatic, in a ring, hydrogens
    assert base[0, 1] == [6, 3, 0, 3, 0, 0, 0] and base[0, 3] == [7, 2, 0, 4, 0, 0, 1] and base[0, 4] == [6, 3, 0, 3, 1, 1, 0] and base[2, 0] == [11, 0, 1, 4, 0, 0, 0] and base[3, 1] == [6, 2, 0, 2, 0, 0, 0]
    names = [p.name for p in M.GROUPS]
    on = lambda k: {names[i] for i, x in enumerate(rows[k][7:25]) if x}
    assert on((0, 3)) == {"Amide"} and on((0, 1)) == {"Amide", "Carbonyl", "Ketone"} and on((0, 4)) == {"Aromatic"}
    donor, acceptor, size, aromatic, system, code = zip(*[rows[k][25:31] for k in ((0, 3), (0, 2), (0, 4), (0, 0))], strict=True)
    assert (donor, acceptor, size, aromatic, system) == ((1, 0, 0, 0), (0, 1, 0, 0), (0, 0, 6, 0), (1, 0, 2, 0), (0, 0, 1, 0))
    assert code == (3, 1, 0, 4)  # two steps from N: O; from O: N; from the ring: C; from the methyl: O and N
    sums = lambda k: rows[k][31:55]
    assert sums((0, 1))[:9] == [2, 1, 0, 0, 0, 0, 0, 0, 0] and sums((0, 4))[:14] == [1, 0, 0, 2, 0, 0, 2, 2, 2, 0, 0, 0, 2, 0]
    assert sums((1, 1))[:8] == [1, 1, 0, 0, 0, 0, 0, 2] and sums((2, 0)) == [0] * 24  # butadiene is conjugated throughout
    assert sums((1, 0))[14] == 1 and sums((1, 0))[19] == 1  # no stereo form, no direction


def test_molecules_are_rows(spark):
    """Lines become atoms, rings, scaffolds and groups within their rows: nothing is shuffled or kept for it."""
    lines = spark.createDataFrame([(i, x) for i, x in enumerate([*GROUP_LINES, "C12.C12", "C1.C1", "C(C1)CC1"])], "id long, line string")
    rows = M.packed_graphs(lines, "id", "line")
    for df in (M.faults(lines, "id", "line"), M.unpacked(M.packed_ring_features(rows), "atoms"), M.packed_scaffolds(rows), M.packed_group_counts(rows)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    rings = [{(b.src, b.dst): b.ring for b in r.bonds} for r in rows.orderBy("mol").collect()[-3:]]
    assert rings == [{}, {(0, 1): None}, {(0, 1): 4, (0, 2): 4, (2, 3): 4, (1, 3): 4}]


def test_rows_of_atoms_from_lines(spark, monkeypatch):
    """Atoms in one pass are those of the arrays, for sound, faulty, empty, null and repeated lines, in batches of any size; a line is parsed once for a batch."""
    import pyarrow as pa

    from quillon.functions import smiles as S
    from quillon.plans import molecule_queries

    texts = [*GROUP_LINES, "C12.C12", "C1.C1", "C(C1)CC1", "[13CH3][NH3+].[Cl-]", "C(", "", None, "[Xx]", *GROUP_LINES]
    lines = spark.createDataFrame([(None if i == 3 else i // 2, x) for i, x in enumerate(texts)], "id long, line string")
    key = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    wanted = key(M.unpacked(M.packed_ring_features(M.packed_graphs(lines, "id", "line")), "atoms").select("mol", *S.ATOM_ROWS))
    found = M.ringed_atoms(lines, "id", "line")
    assert key(found) == wanted and key(M.ringed_atoms(lines.where("line is null"), "id", "line")) == []
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ArrowEvalPython" not in plan
    plan = molecule_queries.molecule_atoms(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan
    monkeypatch.setattr(S, "BATCH", 7)
    read, parse = [], S._read
    monkeypatch.setattr(S, "_read", lambda *a: read.append(1) or parse(*a))
    some = ["CCO", None, "c1ccccc1", "CCO", "CCO"]
    parts = list(S.atom_rows(("atom", "z", "ring_size"))([pa.RecordBatch.from_arrays([pa.array(list("abcde")), pa.array(some, pa.string())], ["mol", "line"])]))
    rows = [tuple(r.values()) for p in parts for r in p.to_pylist()]
    wanted = lambda m: [(m, 0, 6, 0), (m, 1, 6, 0), (m, 2, 8, 0)]
    assert rows == [*wanted("a"), *[("c", k, 6, 6) for k in range(6)], *wanted("d"), *wanted("e")] and len(read) == 2 and {len(p) for p in parts[:-1]} == {7}


def test_bonds_of_a_line_are_flat_numbers():
    """A line that is faulty late leaves none of its bonds among those of its batch; ends in two trees mark all bonds of the line, not those of others."""
    from quillon.functions import smiles as S

    bonds = ([], [], [], [])
    read = lambda line: S._read(every := S.TOKENS.findall(line), [S._kind(t) for t in every], bonds)
    assert [read(x) for x in ("CCO", "C1CC1C(", "C1CC1=", "CC1C", "C12CC12", "C.C1CC1", "C1.C1C")] == [None, "branch", "bond", "ring", "ring", None, None]
    assert list(zip(*bonds[:3])) == [(0, 1, ""), (1, 2, ""), (1, 2, ""), (2, 3, ""), (1, 3, ""), (0, 1, ""), (1, 2, "")] and set(bonds[3]) == {2, 3, 4, 5, 6}
