"""Readers of files: delimited text, JSON, molecule lists, index lines, FASTA, clusters, hits, structures, matrices. All give DataFrames; nothing is read by the driver itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillon.functions.clean import typed_affinity
from quillon.functions.molecules import pdb_number_read


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line): lines in the order of their file; each file is read whole by one task, as its format has an order."""
    files = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    return files.select("file", F.posexplode(F.split(F.regexp_replace("value", r"\r\n?", "\n"), "\n")).alias("line_no", "line"))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line): lines of text whose order doesn't matter; a large file is read by many tasks."""
    return spark.read.text(path).select(F.col("value").alias("line"))


def delimited(spark: SparkSession, path: str, schema: StructType | str | None = None, sep: str = ",", required: list[str] | None = None, multi_line: bool = False) -> DataFrame:
    """A table with a header (also gzip, by its name). Without a schema all columns are text. Missing required columns are an error.

    multi_line allows line breaks in quoted cells; each file is then read by one task.
    """
    reader = spark.read.option("header", True).option("sep", sep).option("encoding", "UTF-8").option("escape", '"').option("multiLine", multi_line)
    df = reader.schema(schema).csv(path) if schema is not None else reader.csv(path)
    if lacking := [c for c in required or [] if c not in df.columns]:
        raise ValueError(f"columns missing: {', '.join(lacking)}")
    return df


def json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One document per line; bad lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def events_of(log: DataFrame, event: str = "event") -> tuple[DataFrame, DataFrame]:
    """Rows of training, which have no event, and of validation, from one log."""
    return log.where(F.col(event).isNull()), log.where(F.col(event) == "valid")


def epoch_documents(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One JSON document per file, with the epoch in the file's name (-1 without one)."""
    df = spark.read.schema(schema).option("multiLine", True).json(path)
    return df.withColumn("epoch_of_file", epoch_of_name(F.input_file_name()))


def epoch_of_name(name: Column) -> Column:
    return F.coalesce(F.regexp_extract(name, r"epoch_?(\d+)", 1).try_cast("int"), F.lit(-1))


def molecule_list(lines: DataFrame, line: str = "line") -> DataFrame:
    """(smiles): from lines of many shapes. Blank and header lines are skipped; of a line with commas the first of its first two cells with a letter or a bond or bracket mark, else its first cell; of others the first word."""
    s = F.btrim(line, F.lit(" \t\r\n\x0b\x0c"))
    cells = F.transform(F.split(s, ","), lambda x: F.trim(x))  # trim itself would take the place for the characters to trim
    looks = lambda x: x.rlike(r"[#\[\]=()@+\\/\-]|\p{L}")
    of_cells = F.coalesce(F.get(F.filter(F.slice(cells, 1, 2), looks), 0), F.get(cells, 0))
    found = F.when(s.contains(","), of_cells).otherwise(F.get(F.split(s, r"\s+"), 0))
    return lines.where((s != "") & ~F.lower(s).rlike(r"^(smiles|chembl_id|id[,\t])")).select(found.alias("smiles")).where("smiles <> ''")


def affinity_index(lines: DataFrame, line: str = "line") -> DataFrame:
    """(id, kind, op, nanomolar, p): index lines of four words or more, the fourth an affinity; comments and others are left out."""
    words = F.split(F.trim(line), r"\s+")
    rows = lines.where(~F.trim(line).startswith("#") & (F.size(words) >= 4)).select(F.lower(words[0]).alias("id"), typed_affinity(words[3]).alias("a"))
    return rows.where("a IS NOT NULL").select("id", "a.*")


def fasta(lines: DataFrame, groups: list[str], order: str = "line_no", line: str = "line") -> DataFrame:
    """(id, seq): records of FASTA text, whose sequences may run over many lines."""
    w = Window.partitionBy(*groups).orderBy(order)
    head = F.trim(line).startswith(">")
    marked = lines.withColumn("_rec", F.sum(head.cast("int")).over(w)).where("_rec > 0")
    id_ = F.max(F.when(head, F.regexp_extract(line, r"^\s*>\s*(\S+)", 1)))
    parts = F.array_sort(F.collect_list(F.when(~head, F.struct(order, F.trim(line).alias("s")))))
    return marked.groupBy(*groups, "_rec").agg(id_.alias("id"), F.array_join(F.transform(parts, lambda p: p["s"]), "").alias("seq")).drop("_rec")


def cluster_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(rep, member) from tab-separated pairs."""
    return spark.read.option("sep", "\t").schema("rep string, member string").csv(path).where("member IS NOT NULL")


HITS = "query string, target string, pident double, alnlen int, qcov double, tcov double, evalue double, bits double"


def best_hits(spark: SparkSession, path: str) -> DataFrame:
    """The hit with the most bits of each query, the first target of equals; malformed lines are left out."""
    hits = spark.read.option("sep", "\t").option("mode", "DROPMALFORMED").schema(HITS).csv(path)
    w = Window.partitionBy("query").orderBy(F.desc("bits"), "target")
    return hits.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def structure_atoms(lines: DataFrame, groups: list[str], line: str = "line") -> DataFrame:
    """Atoms of PDB text: record, atom, resname, chain, res_seq, x, y, z, element, by the fixed columns of the format; the first model only."""
    at = lambda a, n: F.trim(F.substring(line, a, n))
    w = Window.partitionBy(*groups).orderBy("line_no")
    marked = lines.withColumn("_model", F.sum(F.col(line).startswith("MODEL").cast("int")).over(w))
    rows = marked.where((F.col("_model") <= 1) & F.col(line).rlike("^(ATOM  |HETATM)"))
    number = lambda a: at(a, 8).try_cast("double")
    return rows.select(*groups, at(1, 6).alias("record"), at(13, 4).alias("atom"), at(18, 3).alias("resname"), at(22, 1).alias("chain"), pdb_number_read(at(23, 4), 4).alias("res_seq"), number(31).alias("x"), number(39).alias("y"), number(47).alias("z"), at(77, 2).alias("element"))


def mmcif_atoms(lines: DataFrame, groups: list[str], line: str = "line") -> DataFrame:
    """The same from the atom table of mmCIF text, whose columns are found by their names."""
    wanted = {"group_PDB": "record", "label_atom_id": "atom", "label_comp_id": "resname", "auth_asym_id": "chain", "auth_seq_id": "res_seq", "Cartn_x": "x", "Cartn_y": "y", "Cartn_z": "z", "type_symbol": "element", "pdbx_PDB_model_num": "model"}
    w = Window.partitionBy(*groups).orderBy("line_no")
    heads = lines.where(F.col(line).startswith("_atom_site.")).withColumn("_at", F.row_number().over(w) - 1)
    names = heads.groupBy(*groups).agg(F.map_from_entries(F.collect_list(F.struct(F.regexp_extract(line, r"_atom_site\.(\S+)", 1), "_at"))).alias("_names"))
    rows = lines.where(F.col(line).rlike(r"^(ATOM|HETATM)\s")).withColumn("_cells", F.split(F.trim(line), r"\s+")).join(names, groups)
    cell = lambda name: F.get("_cells", F.try_element_at("_names", F.lit(name)))
    cast = {"res_seq": "int", "x": "double", "y": "double", "z": "double", "model": "int"}
    found = rows.select(*groups, *[(cell(n).try_cast(cast[a]) if a in cast else cell(n)).alias(a) for n, a in wanted.items()])
    return found.where("coalesce(model, 1) = 1").drop("model")


def sdf_molecules(spark: SparkSession, path: str) -> DataFrame:
    """(file, mol_no, title, n_atoms, n_bonds, atoms, bonds, fields) of SDF text in the V2000 form: atoms are (x, y, z, element), bonds (src, dst, order) from 0."""
    files = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    mols = files.select("file", F.posexplode(F.split("value", r"\$\$\$\$\r?\n?")).alias("mol_no", "text")).where(F.trim("text") != "")
    ls = F.split("text", r"\r?\n")
    n = lambda a: F.trim(F.substring(F.get("lines", 3), a, 3)).try_cast("int")
    rows = mols.select("file", "mol_no", "text", ls.alias("lines")).select("*", F.trim(F.get("lines", 0)).alias("title"), n(1).alias("n_atoms"), n(4).alias("n_bonds")).where("n_atoms IS NOT NULL AND n_bonds IS NOT NULL")
    num = lambda s, a: F.trim(F.substring(s, a, 10)).try_cast("double")
    atom = lambda s: F.struct(num(s, 1).alias("x"), num(s, 11).alias("y"), num(s, 21).alias("z"), F.trim(F.substring(s, 32, 3)).alias("element"))
    three = lambda s, a: F.trim(F.substring(s, a, 3)).try_cast("int")
    bond = lambda s: F.struct((three(s, 1) - 1).alias("src"), (three(s, 4) - 1).alias("dst"), three(s, 7).alias("order"))
    fields = F.regexp_extract_all("text", F.lit(r"(?s)>\s*<[^>]+>[^\n]*\n[^\n]*"), F.lit(0))
    pair = lambda f: F.struct(F.regexp_extract(f, r"<([^>]+)>", 1), F.trim(F.regexp_extract(f, r"\n([^\n]*)$", 1)))
    return rows.select("file", "mol_no", "title", "n_atoms", "n_bonds", F.transform(F.slice("lines", 5, F.col("n_atoms")), atom).alias("atoms"), F.transform(F.slice("lines", F.col("n_atoms") + 5, F.col("n_bonds")), bond).alias("bonds"), F.map_from_entries(F.transform(fields, pair)).alias("fields"))


def has_depth(atoms: Column) -> Column:
    """Whether all coordinates are finite and their deviation, over all of them together, is above 0.001."""
    all_of = F.flatten(F.transform(atoms, lambda a: F.array(a["x"], a["y"], a["z"])))
    finite = F.forall(all_of, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    mean = F.aggregate(all_of, F.lit(0e0), lambda s, c: s + c) / F.size(all_of)
    square = F.aggregate(all_of, F.lit(0e0), lambda s, c: s + (c - mean) * (c - mean)) / F.size(all_of)
    return F.coalesce((F.size(atoms) > 0) & finite & (F.sqrt(square) > 1e-3), F.lit(False))


def long_matrix(rows: DataFrame, columns: DataFrame, matrix: DataFrame) -> DataFrame:
    """(row_key, col_key, y) of a matrix given as (i, values), with tables (i, row_key) and (j, col_key); missing values (null, NaN) are left out."""
    cells = matrix.select("i", F.posexplode("values").alias("j", "y")).where(F.col("y").isNotNull() & ~F.isnan("y"))
    return cells.join(rows, "i").join(columns, "j").select("row_key", "col_key", "y")


def head(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows in an order: the head limit."""
    return df.orderBy(*order).limit(n)


def of_split(df: DataFrame, split: str, name: str | None = None) -> DataFrame:
    """All rows, or those of one split where a name is given."""
    return df if name is None else df.where(F.col(split) == name)


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, folder, name, size) of all files below a path; their contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("size"))
    return files.select("path", F.regexp_extract("path", r"([^/]*)/[^/]*$", 1).alias("folder"), F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "size")


def shards(files: DataFrame, pattern: str) -> DataFrame:
    """The files whose names match, in the order of their names; none is an error."""
    found = files.where(F.col("name").rlike(pattern))
    if found.isEmpty():
        raise ValueError(f"no shard matches {pattern}")
    return found.orderBy("name")


def structure_paths(ids: DataFrame, id_col: str, files: DataFrame) -> DataFrame:
    """ids and path: of the files called after an id, in capitals before small letters and plain before gzip, the first; null without any."""
    upper, lower = F.upper(id_col), F.lower(id_col)
    names = F.array(F.concat(upper, F.lit(".cif")), F.concat(upper, F.lit(".cif.gz")), F.concat(lower, F.lit(".cif")), F.concat(lower, F.lit(".cif.gz")))
    asked = ids.select(id_col, F.posexplode(names).alias("_at", "name")).join(files.select("name", "path"), "name")
    best = asked.groupBy(id_col).agg(F.min(F.struct("_at", "path")).alias("_b")).select(id_col, F.col("_b.path").alias("path"))
    return ids.join(best, id_col, "left")


#: Items of an mmCIF file that tell its resolution, in order.
RESOLUTION = ("_refine.ls_d_res_high", "_em_3d_reconstruction.resolution", "_reflns.d_resolution_high", "_refine_hist.d_res_high")


def resolutions(lines: DataFrame, groups: list[str], line: str = "line") -> DataFrame:
    """(groups ..., resolution): of the items in order the first with a number, from lines of an item and its value; null without any."""
    words = F.split(F.trim(line), r"\s+")
    value = F.get(words, 1).try_cast("double")
    first = [F.min(F.when((words[0] == item) & value.isNotNull(), F.struct("line_no", value.alias("v"))))["v"] for item in RESOLUTION]
    return lines.groupBy(*groups).agg(F.coalesce(*first).alias("resolution"))


def complex_pairs(files: DataFrame) -> DataFrame:
    """(folder, protein, ligand): of each folder its own protein, or else its pocket, with its own ligand; else any protein and ligand, the last by name."""
    own = F.lower("folder")
    name = lambda end: F.max(F.when(F.col("name") == F.concat(own, F.lit(end)), F.col("path")))
    last = lambda end: F.max_by("path", F.when(F.lower("name").endswith(end), F.col("name")))
    some = files.groupBy(own.alias("folder")).agg(name("_protein.pdb").alias("a"), name("_pocket.pdb").alias("b"), name("_ligand.sdf").alias("l"), last("_protein.pdb").alias("p"), last("_ligand.sdf").alias("m"))
    named = F.col("l").isNotNull() & F.coalesce("a", "b").isNotNull()
    found = some.select("folder", F.when(named, F.coalesce("a", "b")).otherwise(F.col("p")).alias("protein"), F.when(named, F.col("l")).otherwise(F.col("m")).alias("ligand"))
    return found.where("protein IS NOT NULL AND ligand IS NOT NULL")


def tar_members(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path, member, content) of the members of tar and tar.gz files whose names match. An archive is read by one task, as it can't be cut; its members are rows."""
    import pandas as pd

    def members(batches):
        import io
        import re
        import tarfile

        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    for m in tar:
                        if m.isfile() and re.search(pattern, m.name):
                            yield pd.DataFrame({"path": [path], "member": [m.name], "content": [tar.extractfile(m).read()]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(members, "path string, member string, content binary")


def tar_batches(members: DataFrame, member: str = "member") -> DataFrame:
    """(prefix, batches): the folder of the first member, by name, that is called attr_<number>.npy, and the sorted numbers of all such in it."""
    form = r"^(.*/)?attr_(\d+)\.npy$"
    named = members.where(F.col(member).rlike(form)).select(F.regexp_extract(member, form, 1).alias("prefix"), F.regexp_extract(member, form, 2).cast("int").alias("n"), F.col(member).alias("m"))
    return named.groupBy("prefix").agg(F.array_sort(F.collect_set("n")).alias("batches"), F.min("m").alias("m")).orderBy("m").limit(1).select("prefix", "batches")


def csr_edges(rows: DataFrame, groups: list[str], starts: str, ends_of: str, values: str) -> DataFrame:
    """(groups ..., src, dst, value) of matrices in compressed rows: src has the entries from its start to the next."""
    at = rows.select(*groups, F.posexplode(F.slice(starts, 1, F.size(starts) - 1)).alias("src", "_a"), F.col(starts).alias("_s"), F.col(ends_of).alias("_d"), F.col(values).alias("_v"))
    spans = at.withColumn("_b", F.get("_s", F.col("src") + 1)).where("_b > _a")
    each = spans.select(*groups, "src", F.explode(F.sequence("_a", F.col("_b") - 1)).alias("_k"), "_d", "_v")
    return each.select(*groups, "src", F.get("_d", "_k").alias("dst"), F.get("_v", "_k").alias("value"))


def merged(*settings: dict) -> dict:
    """Settings over one another, the last wins: for all, for a data set, for a model."""
    return {k: v for part in settings for k, v in (part or {}).items()}
