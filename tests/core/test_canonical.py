"""Canonical orders: relabelled graphs agree, different ones don't, and the maps keep atoms and bonds."""

import random

import pytest

from quillon.operators import canonical as C
from quillon.operators import molecules as M


def circulant(n, steps):
    return [(i, (i + s) % n) for i in range(n) for s in steps]


def grid(step):
    """Two strongly regular graphs of sixteen points: the rook's, and one that refinement can't tell from it."""
    return [(4 * a + b, 4 * ((a + x) % 4) + (b + y) % 4) for a in range(4) for b in range(4) for x, y in step]


PRISM5 = [(i, (i + 1) % 5) for i in range(5)] + [(5 + i, 5 + (i + 1) % 5) for i in range(5)] + [(i, 5 + i) for i in range(5)]
PETERSEN = [(i, (i + 1) % 5) for i in range(5)] + [(5 + i, 5 + (i + 2) % 5) for i in range(5)] + [(i, 5 + i) for i in range(5)]
CUBE = [(a, a ^ b) for a in range(8) for b in (1, 2, 4)]
HARD = {
    "hexagon": circulant(6, [1]), "triangles": [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5)], "k33": [(a, b) for a in range(3) for b in range(3, 6)],
    "prism": [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (0, 3), (1, 4), (2, 5)], "prism5": PRISM5, "petersen": PETERSEN, "cube": CUBE, "moebius": circulant(8, [1, 4]),
    "decalin": circulant(10, [1]) + [(0, 5)], "bicyclopentyl": [(i, (i + 1) % 5) for i in range(5)] + [(5 + i, 5 + (i + 1) % 5) for i in range(5)] + [(0, 5)],
    "rook": grid([(0, 1), (0, 2), (1, 0), (2, 0)]), "shrikhande": grid([(0, 1), (1, 0), (1, 1)]),
    "path": [(i, i + 1) for i in range(5)], "star": [(0, i) for i in range(1, 6)], "phenyls": [x for k in range(4) for x in [(24, 6 * k), *[(6 * k + i, 6 * k + (i + 1) % 6) for i in range(6)]]],
}


def tables(spark, graphs, rng):
    """graphs: (mol, colours by atom, bonds as (a, b, kind)); each as it is, and with its atoms numbered anew as the molecule after it."""
    atoms, bonds = [], []
    for mol, colours, edges in graphs:
        n = len(colours)
        for copy in (0, 1):
            to = list(range(n)) if copy == 0 else rng.sample(range(100, 100 + 3 * n), n)
            atoms += [(2 * mol + copy, to[i], c, "x") for i, c in enumerate(colours)]
            pairs = [(2 * mol + copy, to[a], to[b], k) if rng.random() < 0.5 or copy == 0 else (2 * mol + copy, to[b], to[a], k) for a, b, k in edges]
            bonds += rng.sample(pairs, len(pairs))
    rng.shuffle(atoms)
    return spark.createDataFrame(atoms, "mol long, atom int, z int, note string"), spark.createDataFrame(bonds, "mol long, src int, dst int, kind string")


def check_pairs(graphs, found):
    """The map between the two copies keeps colours, bonds and kinds."""
    atoms, bonds, orders = found
    colour = {(r.mol, r.atom): r.z for r in atoms.collect()}
    kinds = {(r.mol, *sorted((r.src, r.dst)), r.kind) for r in bonds.where("src <> dst").collect()}
    by = {r.mol: r for r in orders.collect()}
    for mol, colours, _ in graphs:
        a, b = by[2 * mol], by[2 * mol + 1]
        assert a.key == b.key, mol
        assert len(a.order) == len(set(a.order)) == len(colours)
        to = dict(zip(a.order, b.order, strict=True))
        assert all(colour[2 * mol, x] == colour[2 * mol + 1, y] for x, y in to.items())
        assert {(2 * mol + 1, *sorted((to[s], to[d])), k) for m, s, d, k in kinds if m == 2 * mol} == {e for e in kinds if e[0] == 2 * mol + 1}, mol
    return by


def test_hard_pairs(spark):
    graphs = [(i, [0] * (max(map(max, e)) + 1), [(a, b, "SINGLE") for a, b in e]) for i, e in enumerate(HARD.values())]
    atoms, bonds = tables(spark, graphs, random.Random(1))
    by = check_pairs(graphs, (atoms, bonds, C.canonical(atoms, bonds, ("z",))))
    assert len({r.key for r in by.values()}) == len(HARD)


def plain_key(colours, edges):
    """The least form over all numberings, by trying them all."""
    import itertools

    best = None
    for p in itertools.permutations(range(len(colours))):
        form = (tuple(c for _, c in sorted((p[i], c) for i, c in enumerate(colours))), tuple(sorted((*sorted((p[a], p[b])), k) for a, b, k in edges)))
        best = form if best is None or form < best else best
    return best


def test_random_graphs(spark):
    rng, graphs = random.Random(2), []
    for mol in range(60):
        n = rng.randint(1, 6)
        pairs = [(a, b) for a in range(n) for b in range(a) if rng.random() < 0.45]
        graphs.append((mol, [rng.choice((6, 6, 6, 7)) for _ in range(n)], [(a, b, rng.choice(("SINGLE", "SINGLE", "DOUBLE"))) for a, b in pairs]))
    atoms, bonds = tables(spark, graphs, rng)
    by = check_pairs(graphs, (atoms, bonds, C.canonical(atoms, bonds, ("z",))))
    plain = {mol: plain_key(c, e) for mol, c, e in graphs}
    for a in plain:
        for b in plain:
            assert (plain[a] == plain[b]) == (by[2 * a].key == by[2 * b].key)


@pytest.mark.parametrize("kinds", [True, False])
def test_lines_and_maps(spark, kinds):
    rows = [(0, "CC(=O)Oc1ccccc1C(=O)O"), (1, "OC(=O)c1ccccc1OC(C)=O"), (2, "CC(O)Oc1ccccc1C(=O)O"), (3, "[Na+].CC(=O)[O-]"), (4, "[O-]C(C)=O.[Na+]"), (5, "CC"), (6, "FC(F)(F)C(F)(F)F"), (7, "C(C(F)(F)F)(F)(F)F")]
    g = M.graphs(spark.createDataFrame(rows, "id long, line string"), "id", "line")
    orders = C.canonical(g.atoms, g.bonds) if kinds else C.canonical(g.atoms, g.bonds, ("z",), False)
    key = {r.mol: r.key for r in orders.collect()}
    assert key[0] == key[1] and key[3] == key[4] and key[6] == key[7]
    assert (key[0] == key[2]) == (not kinds)
    pairs = spark.createDataFrame([(0, k) for k in range(1, 8)] + [(9, 1), (0, None)], "template long, target long")
    maps = C.template_maps(pairs, orders, orders)
    assert {r.target for r in maps.collect()} == ({1} if kinds else {1, 2})
    contacts = spark.createDataFrame([(1, 5), (1, 5), (2, 5), (2, 6)], "target long, residue int")
    best = C.best_targets(maps, contacts).collect()
    assert [(r.template, r.target, r.contact_n, len(r.atoms)) for r in best] == [(0, 1, 1, 13) if kinds else (0, 2, 2, 13)]


def test_edge_cases(spark):
    atoms, bonds = "mol long, atom int, z int", "mol long, src int, dst int, kind string"
    assert C.canonical(spark.createDataFrame([], atoms), spark.createDataFrame([], bonds), ("z",)).count() == 0
    a = spark.createDataFrame([(1, 0, 6), (1, 0, 6), (1, 1, None), (2, 7, None), (2, 9, 6), (None, 0, 6), (3, 0, 6)], atoms)
    b = spark.createDataFrame([(1, 0, 1, None), (1, 1, 0, None), (1, 0, 0, "SINGLE"), (2, 9, 7, None), (2, 9, 50, "SINGLE"), (9, 0, 1, "SINGLE")], bonds)
    found = {r.mol: r for r in C.canonical(a, b, ("z",)).collect()}
    assert set(found) == {1, 2, 3, None}
    assert found[1].key == found[2].key and found[3].key == found[None].key != found[1].key
    assert [dict(zip(found[1].order, found[2].order))[k] for k in (0, 1)] == [9, 7]
    assert [(r.place, r.atom) for r in C.places(C.canonical(a, b, ("z",))).where("mol = 3").collect()] == [(0, 0)]


def test_graphs_of_one_shape_are_ordered_once(spark, monkeypatch):
    """A hundred paths of three atoms, whatever their numbers, are two shapes; only these are refined."""
    seen, parts = [], C._parts
    monkeypatch.setattr(C, "_parts", lambda flat: seen.append(flat.count()) or parts(flat))
    edges = [(k, 10 * k + a, 10 * k + b, "SINGLE") for k in range(100) for a, b in (((1, 2), (2, 3)) if k % 2 else ((1, 3), (2, 3), (3, 2)))]
    bonds = spark.createDataFrame(edges, "mol long, src long, dst long, kind string")
    atoms = bonds.selectExpr("mol", "explode(array(src, dst)) as atom")
    found = C.canonical(atoms, bonds, ()).collect()
    assert seen == [2] and len(found) == 100 and len({r.key for r in found}) == 1
    assert all(r.order[0] // 10 == r.mol and {x % 10 for x in r.order} == {1, 2, 3} for r in found)
    middle = {next(i for i, x in enumerate(r.order) if x % 10 == (2 if r.mol % 2 else 3)) for r in found}
    assert len(middle) == 1


def test_nothing_is_broadcast(spark):
    """Tables of alike molecules are small as files, however many rows they have; they are joined by sorting."""
    from quillon.plans import molecule_queries as Q

    for query in (Q.template_match, Q.best_ligand, Q.isomorphism_classes):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
