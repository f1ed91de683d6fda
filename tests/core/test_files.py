"""Sources, sinks and the stream, on files made here."""

from pyspark.sql import functions as F

from quillon.functions import molecules as P
from quillon.operators import codebook as C
from quillon.sources import files as S
from quillon.sources import logs as L
from quillon.sources import sinks as K
from quillon.streaming import codebook_stream as CS

MOL = "mol1\n  x\n\n  2  1  0\n    0.0000    1.0000    2.0000 C   0  0\n    1.0000    1.0000    3.5000 N   0  0\n  1  2  2  0\nM  END\n> <ID>\nM7\n\n$$$$\n"
ATOM = "ATOM      1  CA  ALA A   7      11.104   6.134  -6.504  1.00  0.00           C\n"
CIF = "loop_\n" + "".join(f"_atom_site.{c}\n" for c in "group_PDB type_symbol label_atom_id label_comp_id auth_asym_id auth_seq_id Cartn_x Cartn_y Cartn_z".split()) + "ATOM C CA ALA A 7 1.0 2.0 3.0\nHETATM O O HOH B 9 1.5 2.5 3.5\n#\n"


def put(folder, name, text):
    (folder / name).write_text(text)
    return str(folder / name)


def test_texts(spark, tmp_path):
    lines = lambda text: S.numbered_lines(spark, put(tmp_path, "f", text))
    assert [(r.id, r.seq) for r in S.fasta(lines(">p1 d\nACD\nEFG\n>p2\nKLM\n"), ["file"]).orderBy("id").collect()] == [("p1", "ACDEFG"), ("p2", "KLM")]
    assert [(r.id, r.kind, r.nanomolar) for r in S.affinity_index(lines("# c\n1abc 2.0 1999 Kd=12.5uM\nshort\n2DEF 1.0 2000 Ki7nM // x\n")).orderBy("id").collect()] == [("1abc", "Kd", 12500.0), ("2def", "Ki", 7.0)]
    assert sorted(r.smiles for r in S.molecule_list(lines("smiles\nCCO\nCc1 name\n17,CCN\nid_1!,CCF\n5,6\nid,smiles\n\n")).collect()) == ["5", "CCN", "CCO", "Cc1", "id_1!"]
    atoms = S.structure_atoms(lines("MODEL        1\n" + ATOM + "ENDMDL\nMODEL        2\n" + ATOM), ["file"]).collect()
    assert [(a.chain, a.res_seq, a.x, a.z, a.element) for a in atoms] == [("A", 7, 11.104, -6.504, "C")]
    atoms = S.mmcif_atoms(lines(CIF), ["file"]).orderBy("res_seq").collect()
    assert [(a.record, a.resname, a.chain, a.res_seq, a.y) for a in atoms] == [("ATOM", "ALA", "A", 7, 2.0), ("HETATM", "HOH", "B", 9, 2.5)]


def test_molecules(spark, tmp_path):
    m = S.sdf_molecules(spark, put(tmp_path, "m.sdf", MOL + MOL)).withColumn("deep", S.has_depth(F.col("atoms"))).collect()
    assert [(x.title, x.n_atoms, x.fields["ID"], x.deep, x.bonds[0].order) for x in m] == [("mol1", 2, "M7", True, 2)] * 2


def test_depth(spark):
    deep = lambda *atoms: spark.createDataFrame([([*atoms],)], "a array<struct<x:double,y:double,z:double>>").select(S.has_depth(F.col("a"))).first()[0]
    assert deep((0.0, 1.0, 2.0), (5.0, 1.0, 2.0)) and deep((0.0, 0.0, 1.0))
    assert not deep((1.0, 1.0, 1.0), (1.0, 1.0, 1.0)) and not deep((0.0, float("nan"), 2.0), (1.0, 2.0, 3.0)) and not deep((0.0, float("inf"), 2.0)) and not deep((0.0, None, 2.0)) and not deep()


def test_tables(spark, tmp_path):
    assert S.delimited(spark, put(tmp_path, "t.csv", 'a,b\n1,"x, y"\n2,\n'), required=["a"]).count() == 2
    hits = S.best_hits(spark, put(tmp_path, "h.tsv", "q\tt2\t1\t2\t1\t1\t0\t5\nq\tt1\t1\t2\t1\t1\t0\t9\nbad\n"))
    assert [(r.query, r.target) for r in hits.where("target IS NOT NULL").collect()] == [("q", "t1")]
    assert S.cluster_pairs(spark, put(tmp_path, "c.tsv", "r\tm\nr\tn\n")).count() == 2
    log = S.json_lines(spark, put(tmp_path, "l.jsonl", '{"step": 1}\n{"step": 2, "event": "valid"}\nnot json\n'), "step long, event string")
    train, valid = S.events_of(log)
    assert [r.step for r in train.where("step IS NOT NULL").collect()] == [1] and [r.step for r in valid.collect()] == [2]
    docs = S.epoch_documents(spark, put(tmp_path, "epoch_12.json", '{\n "a": 1}'), "a int")
    assert docs.first()["epoch_of_file"] == 12
    matrix = spark.createDataFrame([(0, [1.0, float("nan")]), (1, [None, 4.0])], "i int, values array<double>")
    rows = spark.createDataFrame([(0, "l0"), (1, "l1")], "i int, row_key string")
    cols = spark.createDataFrame([(0, "p0"), (1, "p1")], "j int, col_key string")
    assert sorted(tuple(r) for r in S.long_matrix(rows, cols, matrix).collect()) == [("l0", "p0", 1.0), ("l1", "p1", 4.0)]


def test_log_lines(spark):
    df = spark.createDataFrame([("t Silhouette Score (subsample): 6_1 -0.25, sample size 9, K_e 3",), ("x",)], "line string")
    assert L.silhouette_lines(df).first()["score"] == -0.25 and L.silhouette_lines(df, signed=False).count() == 0


def test_sinks(spark, tmp_path):
    K.fasta(spark.createDataFrame([("a", "A" * 100)], "id string, seq string"), str(tmp_path / "fa"), "id", "seq")
    assert [len(r.value) for r in spark.read.text(str(tmp_path / "fa")).collect()] == [2, 80, 20]
    df = spark.createDataFrame([(1, "a", "train"), (2, "b", "test")], "i int, c string, split string")
    K.by_split(df, str(tmp_path / "s"), "split", "c", ["i"], 1)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2
    K.delimited(df, str(tmp_path / "d"), ["c", "none"])
    assert spark.read.option("header", True).csv(str(tmp_path / "d")).columns == ["c", "none"]


def test_stream_is_as_the_batches(spark, tmp_path):
    points = spark.createDataFrame([(k, i, [float(i % 3), 1.0, float(k)]) for k in range(2) for i in range(40)], "label int, vec_id int, embedding array<double>")
    book = C.first_centers(points, "label", "vec_id", "embedding", 3)
    CS.start(book, str(tmp_path / "state"))
    points.where("vec_id < 20").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: CS.follow(spark.readStream.schema(points.schema).parquet(str(tmp_path / "in")), str(tmp_path / "state"), str(tmp_path / "cp"), "label", "embedding").awaitTermination()
    stream()
    points.where("vec_id >= 20").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream()
    state = C.start_state(book)
    for k, part in enumerate((points.where("vec_id < 20"), points.where("vec_id >= 20"))):
        state = C.ema_step(state, C.batch_sums(C.assign(part, state, "label", "embedding"), "label", "embedding"), "label", epoch=k)
    key = lambda df: sorted((r.label, r.cid, round(r.cs, 9), [round(x, 9) for x in r.center], r.last_ep) for r in df.collect())
    assert key(CS.state(spark, str(tmp_path / "state"), 1)) == key(state)


def test_wide_numbers_of_structures(spark, tmp_path):
    """Serials and numbers that decimals can't hold keep the columns of a line."""
    rows = [(99999, 9999), (100000, 10000), (150001, 12345), (43770015, 1223055), (43770016, 1223056), (1, -5)]
    df = spark.createDataFrame(rows, "s long, r int")
    line = P.pdb_line(F.lit("ATOM"), F.col("s"), F.lit("CA"), F.lit("ALA"), F.lit("A"), F.col("r"), F.lit(1.5), F.lit(-2.25), F.lit(3.0), F.lit("C"))
    lines = df.select(line.alias("line")).collect()
    assert {len(r.line) for r in lines} == {78} and [r.line[6:11] for r in lines[:2]] == ["99999", "A0000"] and lines[4].line[6:11] == "a0000"
    found = S.structure_atoms(df.select(F.lit("f").alias("file"), F.col("s").alias("line_no"), line.alias("line")), ["file"]).collect()
    assert sorted((r.res_seq, r.chain, r.x, r.y, r.z, r.element) for r in found) == sorted((r, "A", 1.5, -2.25, 3.0, "C") for _, r in rows)


def test_block_text_of_wide_serials(spark, tmp_path):
    """The query writes serials over 99999 and residue numbers over 9999 as its SQL does."""
    import duckdb

    from quillon.plans import structure_queries as Q

    rows = [(v, v % 3, [0.1 * (v % 7), -1.5, 0.25]) for v in (5, 149, 99999, 100000, 100001, 1499999, 1500000, 1500001)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    wanted = con.sql(Q.ORACLES["pdb_block_text"]).fetchall()
    assert sorted(tuple(r) for r in Q.pdb_block_text(spark, str(tmp_path)).select("structure", "chain", "res_seq", "block").collect()) == sorted(wanted) and len(wanted) == 7
