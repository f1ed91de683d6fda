"""Columns and tables of structures and molecules: predicates of atoms and residues, sequences, text blocks, features of bonds and atoms. Tables of atoms and bonds are inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.clean import recode
from quillon.plans.cut import finely

#: Residues and their letters.
LETTERS = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I", "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F",
    "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V", "MSE": "M", "SEC": "U", "PYL": "O", "ASX": "B", "GLX": "Z", "XLE": "J",
}
#: Names of water among the atoms of a ligand, and among residues.
WATER = ("HOH", "WAT", "DOD")
WATER_RESIDUES = ("HOH", "WAT", "H2O", "DOD")
#: Ions and additives that are no ligands.
IONS = ("NA", "K", "CL", "MG", "MN", "CA", "ZN", "FE", "CU", "CO", "NI", "SO4", "PO4", "GOL", "EDO", "PEG", "ACT", "FMT", "DMS")
HEAVY = 5


def letter(resname: Column) -> Column:
    """The letter of a residue in any case; X for others and for null."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in LETTERS.items() for x in pair]), F.upper(resname)), F.lit("X"))


def is_protein_residue(record: Column, resname: Column) -> Column:
    """An ATOM record of a residue with a letter."""
    return F.coalesce((record == "ATOM") & F.upper(resname).isin(*LETTERS), F.lit(False))


def ligand_residues(atoms: DataFrame, residue: list[str], record: str = "record", resname: str = "resname", element: str = "element", ions: tuple[str, ...] = IONS, least: int = HEAVY) -> DataFrame:
    """(residue ..., resname, heavy): residues of HETATM records that are neither water nor ions and have enough atoms other than hydrogen."""
    name = F.upper(F.trim(resname))
    other = atoms.where((F.col(record) == "HETATM") & ~name.isin(*WATER_RESIDUES) & ~name.isin(*ions))
    return other.groupBy(*residue, name.alias(resname)).agg(heavy_atoms(F.col(element)).alias("heavy")).where(F.col("heavy") >= least)


def heavy_atoms(element: Column) -> Column:
    """The number of rows whose element isn't hydrogen; a missing one counts."""
    return F.count(F.when(F.upper(F.coalesce(element, F.lit(""))) != "H", 1))


def residue_sequences(atoms: DataFrame, chain: list[str], number: str = "res_seq", record: str = "record", resname: str = "resname") -> DataFrame:
    """(chain ..., seq): letters of the protein residues of each chain by their numbers, each residue once."""
    residues = atoms.where(is_protein_residue(F.col(record), F.col(resname))).groupBy(*chain, number).agg(F.min(resname).alias("_name"))
    ordered = F.array_sort(F.collect_list(F.struct(number, letter(F.col("_name")).alias("l"))))
    return residues.groupBy(*chain).agg(F.array_join(F.transform(ordered, lambda x: x["l"]), "").alias("seq"))


def ligand_atoms(atoms: DataFrame, record: str = "record", resname: str = "resname", element: str = "element") -> DataFrame:
    """Atoms of HETATM records, without water and hydrogen; the readers give the first model only."""
    return atoms.where((F.col(record) == "HETATM") & ~F.upper(F.coalesce(resname, F.lit(""))).isin(*WATER) & (F.coalesce(element, F.lit("")) != "H"))


def _wide(width: int) -> tuple[int, int, int]:
    """Of a column that wide: the first number that it can't hold in decimals, how many more it holds in letters of one case, and what their base-36 numbers start from."""
    return 10**width, 26 * 36 ** (width - 1), 10 * 36 ** (width - 1)


def pdb_number(n: Column, width: int) -> Column:
    """A number in a fixed column: decimals, and from where they don't fit base 36 that starts with a letter (hybrid-36), first capital, then small; beyond that from the start again."""
    first, more, base = _wide(width)
    n = F.when(n < 0, n).otherwise(n % F.lit(first + 2 * more))
    in_36 = lambda x: F.conv(x.cast("long").cast("string"), 10, 36)
    return F.when(n < first, n.cast("string")).when(n < first + more, in_36(n - first + base)).otherwise(F.lower(in_36(n - first - more + base)))


def pdb_number_read(text: Column, width: int) -> Column:
    """The number that pdb_number wrote, null where there is none."""
    first, more, base = _wide(width)
    back = F.conv(text, 36, 10).cast("long") - base + first
    return F.when(text.rlike(f"^[A-Z][0-9A-Z]{{{width - 1}}}$"), back).when(text.rlike(f"^[a-z][0-9a-z]{{{width - 1}}}$"), back + more).otherwise(text.try_cast("int")).cast("int")


def pdb_line(record: Column, serial: Column, atom: Column, resname: Column, chain: Column, number: Column, x: Column, y: Column, z: Column, element: Column, plain: bool = False) -> Column:
    """A line of a PDB file, by the fixed columns of the format; serials over 99999 and numbers over 9999 as pdb_number says, or, if plain, in decimals all the same, which shift the columns after them."""
    fixed = (lambda n, width: n.cast("string")) if plain else pdb_number
    return F.format_string("%-6s%5s %-4s %3s %1s%4s    %8.3f%8.3f%8.3f  1.00  0.00          %2s", record, fixed(serial, 5), atom, resname, chain, fixed(number, 4), x, y, z, element)


def pdb_blocks(lines: DataFrame, groups: list[str], order: str, line: str) -> DataFrame:
    """(groups ..., block): the lines of each residue in order and an END."""
    ordered = F.array_sort(F.collect_list(F.struct(order, line)))
    return lines.groupBy(*groups).agg(F.concat(F.array_join(F.transform(ordered, lambda x: x[line]), "\n"), F.lit("\nEND\n")).alias("block"))


def two_bucket(n: Column) -> Column:
    """0, 1, and 2 for more."""
    return F.least(F.greatest(n, F.lit(0)), F.lit(2))


def element_place(z: Column, elements: list[int]) -> Column:
    """The place of an atomic number in a list, from 0; 0 for others."""
    return F.greatest(F.array_position(F.array(*[F.lit(e) for e in elements]), z) - 1, F.lit(0)).cast("long")


#: What the places of a bond's features stand for, in order; the last of each group is for all others.
KINDS = ("SINGLE", "DOUBLE", "TRIPLE", "AROMATIC", "DATIVE", None)
RINGS = (3, 4, 5, 6, None)
STEREO = (("STEREONONE",), ("STEREOCIS",), ("STEREOTRANS",), ("STEREOE", "STEREOZ"), None)
WAYS = (("NONE",), ("BEGINWEDGE", "ENDUPRIGHT"), ("BEGINDASH", "ENDDOWNRIGHT"), ("EITHERDOUBLE",), None)


def _one_hot(holds: list[Column]) -> Column:
    """An array with 1 at the first condition that holds, or at the place after them if none does: a choice among literals."""
    at = lambda k: F.array(*[F.lit(1e0 if i == k else 0e0) for i in range(len(holds) + 1)])
    found = F.when(holds[0], at(0))
    for k, h in enumerate(holds[1:], 1):
        found = found.when(h, at(k))
    return found.otherwise(at(len(holds)))


def bond_features(kind: Column, aromatic: Column, conjugated: Column, rings: Column, stereo: Column, way: Column) -> Column:
    """24 numbers: kind (6), aromatic, conjugated, in a ring, smallest ring of 3 to 6 or larger (5), stereo (5), direction (5). rings has the sizes of all rings of the bond, or of the smallest."""
    flag = lambda c: F.when(c, 1e0).otherwise(0e0)
    there = F.size(rings) > 0
    ring = F.when(there, _one_hot([F.array_contains(rings, n) for n in RINGS[:-1]])).otherwise(F.array(*[F.lit(0e0)] * len(RINGS)))
    of = lambda value, names: _one_hot([value.isin(*([n] if isinstance(n, str) else n)) for n in names[:-1]])
    return F.concat(of(kind, KINDS), F.array(flag(aromatic), flag(conjugated), flag(there)), ring, of(stereo, STEREO), of(way, WAYS))


def bond_environment(atoms: DataFrame, bonds: DataFrame, mol: str, atom: str, src: str, dst: str, features: str, size: int = 24) -> DataFrame:
    """atoms and env: sums and then maxima of the features of each atom's bonds; zeros for an atom without any."""
    finely(atoms.sparkSession)
    ends = bonds.select(F.col(mol).alias("_mol"), F.col(features).alias("_f"), F.explode(F.array(src, dst)).alias("_atom")).repartition("_mol", "_atom")  # features move as they are: sums and maxima are twice as wide
    env = ends.groupBy("_mol", "_atom").agg(F.array(*[F.sum(F.get("_f", k)) for k in range(size)], *[F.max(F.get("_f", k)) for k in range(size)]).alias("env"))
    joined = atoms.join(env.hint("merge"), (F.col(mol) == F.col("_mol")) & (F.col(atom) == F.col("_atom")), "left").drop("_mol", "_atom")
    return joined.withColumn("env", F.coalesce("env", F.array_repeat(F.lit(0e0), 2 * size)))


def atom_row(base: list[Column], groups: Column, donor: Column, acceptor: Column, ring: Column, aromatic_neighbours: Column, fused: Column, code: Column, env: Column) -> Column:
    """The 79 numbers of an atom: 7 of its own, 18 flags of groups, donor, acceptor, ring size, aromatic neighbours, fused ring, two-step code, and 48 of its bonds."""
    as_double = lambda c: c.cast("double")
    one = [as_double(c) for c in (donor, acceptor, ring, aromatic_neighbours, fused, code)]
    return F.concat(F.array(*[as_double(c) for c in base]), F.transform(groups, as_double), F.array(*one), env)


def edge_json(src: Column, dst: Column) -> Column:
    """Two lists of ends as JSON: [[src ...], [dst ...]]."""
    return F.to_json(F.array(src, dst))


def rows_json(rows: Column) -> Column:
    """Lists of numbers as JSON."""
    return F.to_json(rows)


def is_real(row: Column) -> Column:
    """Whether a row of features has anything but zeros."""
    return F.coalesce(F.exists(row, lambda x: F.abs(x) > 0), F.lit(False))


def element_recode(z: Column, table: dict[int, int]) -> Column:
    """An atomic number by a table, -2 for others."""
    return recode(z, table, -2)
