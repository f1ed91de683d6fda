"""Sources and sinks: every query writes rows of the tables as files of a format into the shared folder and reads them back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import clean as C
from quillon.functions import tokens as T
from quillon.operators import codebook as V
from quillon.operators import graph as G
from quillon.operators import splits as P
from quillon.plans.common import rounded, table
from quillon.plans.cut import new_path
from quillon.sources import arrays as A
from quillon.sources import files as S
from quillon.sources import sinks as K


def _text(df: DataFrame, value, folder: str = "", **options) -> str:
    """The path of files with the text of each row, over as many lines as it has."""
    path = new_path(df.sparkSession) + folder
    df.select(value.alias("value")).write.options(**options).text(path)
    return path


def _lines(spark, path: str) -> DataFrame:
    return S.numbered_lines(spark, path)


def csv_round_trip(spark, d):
    """A field that the table lacks, nulls and quoted cells."""
    p = table(spark, d, "part").withColumn("note", F.when(F.col("p_size") % 3 > 0, F.concat(F.lit('a "b", '), F.col("p_brand"))))
    path = new_path(spark)
    K.delimited(p, path, ["p_partkey", "p_name", "note", "p_retailprice", "none"])
    found = S.delimited(spark, path, "p_partkey long, p_name string, note string, p_retailprice double, none string", required=["p_partkey"])
    return found.select("p_partkey", "p_name", F.coalesce("note", F.lit("")).alias("note"), "p_retailprice", F.coalesce("none", F.lit("")).alias("none"))


def tsv_gz_scan(spark, d):
    path = new_path(spark)
    table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus").write.option("header", True).option("sep", "\t").option("compression", "gzip").csv(path)
    return S.delimited(spark, path, "o_orderkey long, o_orderpriority string, o_orderstatus string", sep="\t").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


def split_scan(spark, d):
    path = new_path(spark)
    table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 4 == 0, "valid").otherwise("train").alias("split")).write.option("header", True).csv(path)
    rows = S.delimited(spark, path, "p_partkey long, split string")
    return S.of_split(rows, "split", "valid").agg(F.count("*").alias("n_valid")).crossJoin(S.of_split(rows, "split").agg(F.count("*").alias("n_all")))  # one row with one row


def head_limit(spark, d):
    return S.head(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 100)


def _smiles(spark, d):
    k, n = F.col("p_partkey"), F.col("p_partkey").cast("string")
    line = (
        F.when(k % 6 == 0, F.concat(F.lit("C"), n, F.lit("  name "), n)).when(k % 6 == 1, F.concat(n, F.lit(",N=O"), n, F.lit(",x"))).when(k % 6 == 2, F.concat(n, F.lit(","), F.lit(n), F.lit(",CC")))
        .when(k % 6 == 3, F.lit("Smiles header")).when(k % 6 == 4, F.lit("   ")).otherwise(F.concat(F.lit("[O-]"), n))
    )
    return table(spark, d, "part"), line


def molecule_list_scan(spark, d):
    return S.molecule_list(S.text_lines(spark, _text(*_smiles(spark, d))))


def affinity_index_scan(spark, d):
    k, n = F.col("p_partkey"), F.col("p_partkey").cast("string")
    line = F.when(k % 5 == 0, F.concat(F.lit("# remark "), n)).when(k % 5 == 1, F.concat(F.lit("1AB"), n, F.lit(" 2.0 1999 Kd="), n, F.lit("uM // x"))).when(k % 5 == 2, F.concat(F.lit("2cd"), n, F.lit("   1.9  2001  ki"), n, F.lit(".5nM"))).when(k % 5 == 3, F.lit("short line")).otherwise(F.concat(n, F.lit(" 1 2 Kd=3M")))
    return rounded(S.affinity_index(S.text_lines(spark, _text(table(spark, d, "part"), line))), "nanomolar", "p")


def _molecule(spark, d):
    """SDF text of two atoms and a bond for each vector; in every fifth the atoms are one point, in every seventh one isn't a number."""
    e = table(spark, d, "embeddings")
    at = lambda i: F.when(F.col("vec_id") % 5 == 0, F.lit(1e0)).otherwise(F.round(F.get("embedding", i).cast("double") * 10, 4) + F.lit(0e0))
    first = F.when(F.col("vec_id") % 7 == 0, F.lit("       nan")).otherwise(F.format_string("%10.4f", at(0)))
    form = "mol%d\n  x\n\n  2  1  0\n%s%10.4f%10.4f C   0\n%10.4f%10.4f%10.4f N   0\n  1  2  2  0\nM  END\n> <ID>\nM%d\n\n$$$$"
    body = F.format_string(form, F.col("vec_id"), first, at(1), at(2), at(0), at(1), at(3), F.col("vec_id"))
    return S.sdf_molecules(spark, _text(e, body))


def sdf_scan(spark, d):
    m = _molecule(spark, d)
    return m.select("title", "n_atoms", F.col("bonds")[0]["order"].alias("bond"), F.col("atoms")[1]["element"].alias("second"), F.round(F.col("atoms")[1]["z"], 4).alias("z"), F.col("fields")["ID"].alias("id"))


def valid_in_space(spark, d):
    return _molecule(spark, d).select("title", S.has_depth(F.col("atoms")).alias("deep"))


def sdf_index(spark, d):
    """The last molecule of each name, by its id field: the lookup that later rows win."""
    m = _molecule(spark, d).withColumn("key", F.concat(F.lit("k"), F.substring("title", 4, 9).cast("int") % 50))
    return m.groupBy("key").agg(F.max(F.substring("title", 4, 9).cast("int")).cast("long").alias("last"))


def structure_scan(spark, d):
    """Atoms of PDB text, the first model only."""
    from quillon.plans.structure_queries import _atoms
    from quillon.functions import molecules as M

    a = _atoms(spark, d).where("element IS NOT NULL")
    line = M.pdb_line(F.col("record"), F.col("serial"), F.lit("CA"), F.upper("resname"), F.col("chain"), F.col("res_seq"), F.col("x"), F.col("y"), F.col("z"), F.upper("element"))
    whole = a.groupBy("structure").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("serial", line.alias("l")))), lambda x: x["l"]), "\n").alias("t"))
    path = _text(whole, F.concat(F.lit("MODEL        1\n"), F.col("t"), F.lit("\nENDMDL\nMODEL        2\n"), F.col("t"), F.lit("\nENDMDL")), maxRecordsPerFile=1)
    found = S.structure_atoms(_lines(spark, path), ["file"])
    return found.groupBy("record", "resname", "chain", "element").agg(F.count("*").alias("n"), F.round(F.sum("x"), 3).alias("x"), F.round(F.sum("z"), 3).alias("z"))


def mmcif_scan(spark, d):
    from quillon.plans.structure_queries import _atoms

    a = _atoms(spark, d).where("element IS NOT NULL")
    line = F.concat_ws(" ", "record", F.upper("element"), F.lit("CA"), F.upper("resname"), "chain", "res_seq", "x", "y", "z")
    head = "loop_\n" + "\n".join(f"_atom_site.{c}" for c in "group_PDB type_symbol label_atom_id label_comp_id auth_asym_id auth_seq_id Cartn_x Cartn_y Cartn_z".split())
    whole = a.groupBy("structure").agg(F.array_join(F.collect_list(line), "\n").alias("t"))
    path = _text(whole, F.concat(F.lit(f"data_x\n_refine.ls_d_res_high ?\n{head}\n"), F.col("t"), F.lit("\n#\n_reflns.d_resolution_high "), F.col("structure") + 1), maxRecordsPerFile=1)
    found = S.mmcif_atoms(_lines(spark, path), ["file"])
    return found.groupBy("record", "resname", "chain", "element").agg(F.count("*").alias("n"), F.round(F.sum("x"), 3).alias("x"), F.round(F.sum("z"), 3).alias("z"))


def resolution_lookup(spark, d):
    """Of four items the first with a number: some files have a question mark or nothing for the first."""
    k = F.col("n_nationkey")
    body = F.concat(F.lit("data_x\n_refine.ls_d_res_high "), F.when(k % 3 == 0, F.lit("?")).otherwise((k / 10).cast("string")), F.when(k % 2 == 0, F.concat(F.lit("\n_reflns.d_resolution_high "), (k + 1).cast("string"))).otherwise(""), F.lit("\n_cell.id x"))
    path = _text(table(spark, d, "nation").repartition(5), body, maxRecordsPerFile=1)
    return S.resolutions(_lines(spark, path), ["file"]).groupBy("resolution").agg(F.count("*").alias("n"))


def structure_paths(spark, d):
    """Files under four spellings of an id, some lacking."""
    files = table(spark, d, "part").where("p_partkey % 7 <> 0").select(F.explode(F.expr("CASE p_partkey % 3 WHEN 0 THEN array(concat('1A', p_partkey, '.cif.gz'), concat('1a', p_partkey, '.cif')) WHEN 1 THEN array(concat('1a', p_partkey, '.cif.gz')) ELSE array(concat('1A', p_partkey, '.cif'), concat('1A', p_partkey, '.cif.gz')) END")).alias("name"))
    ids = table(spark, d, "part").select(F.concat(F.lit("1a"), "p_partkey").alias("id"))
    return S.structure_paths(ids, "id", files.withColumn("path", F.concat(F.lit("/m/"), F.col("name"))))


def complex_pairs(spark, d):
    rows = table(spark, d, "part").select(F.concat(F.lit("C"), "p_partkey").alias("folder"), F.expr("CASE p_partkey % 4 WHEN 0 THEN array(concat('c', p_partkey, '_protein.pdb'), concat('c', p_partkey, '_pocket.pdb'), concat('c', p_partkey, '_ligand.sdf')) WHEN 1 THEN array(concat('c', p_partkey, '_pocket.pdb'), concat('c', p_partkey, '_ligand.sdf'), 'z_protein.pdb') WHEN 2 THEN array('a_protein.pdb', 'b_Protein.pdb', 'q_ligand.sdf') ELSE array('only_protein.pdb') END").alias("names"))
    files = rows.select("folder", F.explode("names").alias("name")).withColumn("path", F.concat_ws("/", "folder", "name"))
    return S.complex_pairs(files)


def shard_listing(spark, d):
    path = new_path(spark)
    table(spark, d, "nation").withColumn("batch", F.col("n_nationkey") % 5).select("n_name", "batch").coalesce(1).write.partitionBy("batch").text(path)
    return S.shards(S.listing(spark, path), r"^part-.*txt$").select("folder", "size")


def tar_batches(spark, d):
    names = table(spark, d, "part").select(F.explode(F.array(F.concat(F.lit("run/attr_"), F.col("p_partkey") % 40, F.lit(".npy")), F.concat(F.lit("run/adj_"), F.col("p_partkey"), F.lit(".npy")), F.concat(F.lit("z/attr_"), F.col("p_partkey"), F.lit(".npy")))).alias("member"))
    return S.tar_batches(names).select("prefix", F.to_json("batches").alias("batches"))


def fasta_round_trip(spark, d):
    """Sequences over lines of 80 letters."""
    b = table(spark, d, "benchmark").select(F.concat(F.lit("s"), "item_id").alias("id"), F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("seq")).where("seq <> ''")
    path = new_path(spark)
    K.fasta(b, path, "id", "seq")
    return S.fasta(_lines(spark, path), ["file"]).select("id", "seq")


def unique_fasta(spark, d):
    p = table(spark, d, "part").select(F.regexp_replace("p_brand", "[^A-Za-z0-9]", "").alias("seq"))
    path = new_path(spark)
    K.unique_fasta(p, path, "seq")
    return S.fasta(_lines(spark, path), ["file"]).select("id", "seq")


def cluster_map_build(spark, d):
    """Representatives and members by id, to sequences, numbered by where a cluster is first seen."""
    from quillon.operators.losses import first_seen_ids

    pairs = table(spark, d, "supplier").select(F.concat(F.lit("r"), "s_nationkey").alias("rep"), F.concat(F.lit("m"), "s_suppkey").alias("member"), "s_suppkey")
    path = new_path(spark)
    pairs.select("rep", "member").write.option("sep", "\t").csv(path)
    read = S.cluster_pairs(spark, path).withColumn("at", F.substring("member", 2, 20).cast("long"))
    return read.join(first_seen_ids(read, "rep", "at").withColumnRenamed("id", "cluster"), "rep").select("member", "cluster")


def cluster_map_sink(spark, d):
    path = new_path(spark)
    K.delimited(table(spark, d, "supplier"), path, ["s_name", "s_nationkey"])
    return S.delimited(spark, path, "s_name string, s_nationkey int")


def best_hits(spark, d):
    """The hit with the most bits of each query; lines that can't be read are left out."""
    li = table(spark, d, "lineitem")
    good = F.concat_ws("\t", F.concat(F.lit("q"), "l_suppkey"), F.concat(F.lit("t"), "l_partkey"), F.lit("90.0\t100\t0.9\t0.8\t0.001"), (F.col("l_extendedprice") * 100).cast("long").cast("string"))
    path = _text(li, F.when(F.col("l_linenumber") == 4, F.lit("q1\tt1\tnot a number\tx")).otherwise(good))
    return S.best_hits(spark, path).select("query", "target", F.col("bits").cast("long").alias("bits"))


def overlap_best_hits(spark, d):
    """The best hit of each query in each of three splits, and the guide that follows, without what is dropped."""
    li = table(spark, d, "lineitem").withColumn("split", F.element_at(F.array(F.lit("train"), F.lit("valid"), F.lit("final")), (F.col("l_orderkey") % 3 + 1).cast("int")))
    best = li.where("l_quantity > 48").groupBy("l_partkey").pivot("split", ["train", "valid", "final"]).agg(F.max(F.struct("l_extendedprice", "l_suppkey")))
    rows = best.select("l_partkey", *[F.col(f"{s}.l_suppkey").alias(s) for s in ("train", "valid", "final")], P.guide_split(F.col("train").isNotNull(), F.col("valid").isNotNull(), F.col("final").isNotNull()).alias("guide"))
    path = new_path(spark)
    K.guide_rows(rows, path, "guide")
    return S.delimited(spark, path, "l_partkey long, train long, valid long, final long, guide string")


def json_lines_scan(spark, d):
    """Lines of JSON, of which some can't be read."""
    e = table(spark, d, "events")
    line = F.when(F.col("event_id") % 10 == 0, F.lit("{not json")).otherwise(F.to_json(F.struct("event_id", F.round("value", 2).alias("value"))))
    found = S.json_lines(spark, _text(e, line), "event_id long, value double").where("event_id IS NOT NULL")
    return rounded(found.agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"), F.sum("value").alias("total")), "total", digits=2)


def log_event_routing(spark, d):
    e = table(spark, d, "events")
    line = F.to_json(F.struct(F.col("event_id").alias("step"), F.when(F.col("event_id") % 4 == 0, "valid").when(F.col("event_id") % 4 == 1, "start").alias("event")))
    train, valid = S.events_of(S.json_lines(spark, _text(e, line), "step long, event string"))
    return train.select(F.lit("train").alias("part"), "step").union(valid.select(F.lit("valid").alias("part"), "step")).groupBy("part").agg(F.count("*").alias("n"), F.sum("step").alias("steps"))


def epoch_documents(spark, d):
    """One JSON document a file, over many lines, the epoch in its folder's name; the best epoch by a metric under either of two names."""
    from quillon.sources.logs import metric

    n = table(spark, d, "nation")
    path = new_path(spark)
    doc = F.format_string('{\n "%s": {"auroc": %d}\n}', F.when(F.col("n_nationkey") % 2 == 0, "valid").otherwise("valid_metrics"), F.col("n_nationkey") * 7 % 11)
    n.select(F.concat(F.lit("epoch_"), F.format_string("%03d", F.col("n_nationkey"))).alias("run"), doc.alias("doc")).write.partitionBy("run").text(path)
    docs = S.epoch_documents(spark, path + "/*", "valid struct<auroc:double>, valid_metrics struct<auroc:double>")
    whole = F.to_json(F.struct("valid", "valid_metrics"))
    return docs.select(F.col("epoch_of_file").cast("long").alias("epoch"), metric(whole, ["valid_metrics", "valid"], "auroc").alias("auroc"))


def union_of_runs(spark, d):
    """Rows of two runs with different columns as one table."""
    a = table(spark, d, "supplier").select(F.lit("a").alias("run"), F.col("s_suppkey").alias("epoch"), F.col("s_acctbal").alias("auroc"))
    b = table(spark, d, "customer").select(F.lit("b").alias("run"), F.col("c_custkey").alias("epoch"), F.col("c_nationkey").cast("double").alias("f1"))
    return a.unionByName(b, allowMissingColumns=True).groupBy("run").agg(F.count("*").alias("n"), F.count("auroc").alias("with_auroc"), F.count("f1").alias("with_f1"))


def dataset_concat(spark, d):
    """Shards of two folders read as one table."""
    one, two = new_path(spark), new_path(spark)
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    o.where("o_orderstatus = 'F'").write.option("header", True).csv(one)
    o.where("o_orderstatus <> 'F'").write.option("header", True).csv(two)
    return S.delimited(spark, [one, two], "o_orderkey long, o_orderstatus string").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


def split_sinks(spark, d):
    """A folder for each split; of each the rows, and whether clusters lie together in their files."""
    p = table(spark, d, "part").select("p_partkey", "p_brand", F.when(F.col("p_size") < 5, "valid").otherwise("train").alias("split"))
    path = new_path(spark)
    K.by_split(p, path, "split", "p_brand", ["p_partkey"], 3)
    back = spark.read.parquet(path).withColumn("file", F.input_file_name())
    files = back.groupBy("split", "p_brand").agg(F.countDistinct("file").alias("files"), F.count("*").alias("n"))
    return files.groupBy("split").agg(F.sum("n").alias("n"), F.max("files").alias("files_of_a_cluster"))


def annotated_sink(spark, d):
    path = new_path(spark)
    s = table(spark, d, "supplier")
    K.delimited(s, path, s.columns)
    return rounded(S.delimited(spark, path, s.schema), "s_acctbal", digits=2).select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")


def batched_sink(spark, d):
    """Batches of a thousand rows, a folder each, and their sizes."""
    from quillon.plans.prefix import numbered

    rows = numbered(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], "at").withColumn("batch", F.floor(F.col("at") / 1000))
    path = new_path(spark)
    K.batched(rows, path, "batch")
    return spark.read.parquet(path).groupBy(F.col("batch").cast("long").alias("batch")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


def epoch_dump(spark, d):
    """Vectors, assignments and centres of an epoch by key, written and read again."""
    from quillon.plans.vector_queries import _assigned

    path = new_path(spark)
    K.batched(_assigned(spark, d).select("label", "vec_id", "cid", F.col("embedding").cast("array<double>").alias("v")), path, "label")
    return spark.read.parquet(path).groupBy(F.col("label").cast("long").alias("label"), "cid").agg(F.count("*").alias("n"), F.sum("vec_id").cast("long").alias("ids"))


def json_sink(spark, d):
    path = new_path(spark)
    K.json_documents(table(spark, d, "nation"), path)
    return spark.read.schema("n_nationkey int, n_name string, n_regionkey int").json(path)


def log_append(spark, d):
    path = new_path(spark)
    e = table(spark, d, "events").select("event_id", "event_type")
    for kind in ("click", "view"):
        K.append_log(e.where(F.col("event_type") == kind), path)
    return spark.read.schema("event_id long, event_type string").json(path).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


def sized_keys_text(spark, d):
    """A dict literal of codebook sizes, and what its lines are read as again, with their places."""
    n = table(spark, d, "lineitem").groupBy(F.concat_ws("_", F.col("l_suppkey") % 50, "l_returnflag").alias("key")).agg(F.count("*").alias("n"))
    path = new_path(spark)
    K.sized_keys(n.withColumn("size", T.codebook_size(F.col("n"))), path, "key", "size", "n")
    lines = _lines(spark, path)
    return T.dict_entries(lines, "line").select("key", "size", F.col("line_no").cast("long").alias("place"))


def split_manifest(spark, d):
    path = new_path(spark)
    K.split_manifest(P.share_split(table(spark, d, "supplier").select("s_name"), ["s_name"], 0.13, 3), path, "s_name", "split", 3, 0.13)
    return spark.read.schema("seed int, valid_ratio double, n_total long, n_train long, n_valid long, train array<string>, valid array<string>").json(path).select("seed", "valid_ratio", "n_total", "n_train", "n_valid", F.array_join("valid", " ").alias("valid"))


def vocabulary_json(spark, d):
    path = new_path(spark)
    K.vocabulary(T.vocabulary(table(spark, d, "benchmark"), T.chars(F.col("text"))), path)
    doc = spark.read.schema("stoi map<string,long>, tokens array<string>, pad_id int, unk_id int, vocab_size long").json(path)
    return doc.select("pad_id", "unk_id", "vocab_size", F.col("stoi")["a"].alias("of_a"), F.get("tokens", F.col("stoi")["a"].cast("int")).alias("back"))


def epoch_mean_csv(spark, d):
    path = new_path(spark)
    rows = table(spark, d, "events").groupBy((F.col("event_id") % 40).alias("epoch")).agg(F.avg(F.col("event_id") % 1000).alias("mean"))
    K.epoch_means(rows, path)
    return S.delimited(spark, path, "epoch long, mean string")


def config_merge(spark, d):
    """Settings for all, for a data set and for a model, the last wins."""
    settings = S.merged({"lr": "0.1", "dim": "64"}, {"lr": "0.2"}, {"dim": "16", "epochs": "3"})
    return spark.createDataFrame(sorted(settings.items()), "name string, value string")


def csr_edges(spark, d):
    """Compressed rows of a small matrix for each order, and its entries."""
    li = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 4).cast("int").alias("src"), "l_partkey", "l_linenumber")
    flat = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("src", "l_partkey", "l_linenumber"))).alias("e"))
    starts = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.size(F.filter("e", lambda x: x["src"] < k)))
    rows = flat.select("l_orderkey", starts.alias("starts"), F.transform("e", lambda x: x["l_partkey"]).alias("to"), F.transform("e", lambda x: x["l_linenumber"]).alias("v"))
    return S.csr_edges(rows, ["l_orderkey"], "starts", "to", "v").select("l_orderkey", F.col("src").cast("long").alias("src"), "dst", F.col("value").cast("long").alias("value"))


def ligand_token_parse(spark, d):
    p = table(spark, d, "part")
    cell = F.when(F.col("p_partkey") % 3 == 0, F.concat_ws(",", "p_size", F.lit("x"), "p_partkey")).when(F.col("p_partkey") % 3 == 1, F.concat_ws("  ", F.lit(" "), "p_size", "p_partkey")).otherwise("")
    return p.select("p_partkey", F.to_json(T.ints(cell)).alias("ids"))


def token_parse_json(spark, d):
    p = table(spark, d, "part")
    cell = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("["), F.col("p_size"), F.lit(", "), F.col("p_partkey"), F.lit("]"))).otherwise(F.concat_ws(" ", "p_size", "p_partkey"))
    return p.select("p_partkey", F.to_json(T.ints_or_json(cell)).alias("ids"))


def unknown_to_mask(spark, d):
    token = F.when(F.col("p_partkey") % 5 == 0, F.lit(-1)).otherwise(F.col("p_size"))
    return table(spark, d, "part").groupBy(T.unknown_to_mask(token, 99).cast("long").alias("token")).agg(F.count("*").alias("n"))


def column_resolve(spark, d):
    p = table(spark, d, "part")
    found = [C.resolve_column(p.columns, wanted) for wanted in (["brand", "P_Brand"], ["retail"], ["nothing", "SIZE"], ["none"])]
    return spark.createDataFrame([(i, c) for i, c in enumerate(found)], "i long, resolved string")


def index_clamp(spark, d):
    return table(spark, d, "part").groupBy(C.clamp(F.col("p_size") - 5, 0, 20).cast("long").alias("i")).agg(F.count("*").alias("n"))


def edge_offsets(spark, d):
    return G.edge_offsets(table(spark, d, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n")), "s_nationkey", "n")


def state_restore(spark, d):
    """A codebook's state written as a version and read again, keys and all."""
    from quillon.plans.vector_queries import _centers
    from quillon.streaming import codebook_stream as CS

    path = new_path(spark)
    CS.start(_centers(spark, d), path)
    return CS.state(spark, path, -1).groupBy("label").agg(F.count("*").alias("k"), F.max("last_ep").cast("long").alias("last_ep"))


def long_matrix(spark, d):
    """A matrix with missing cells to rows of keys."""
    e = table(spark, d, "embeddings")
    cell = F.transform("embedding", lambda x, i: F.when((i + F.col("vec_id")) % 3 == 0, F.lit(float("nan"))).when((i + F.col("vec_id")) % 3 == 1, x.cast("double")))
    rows = e.select(F.col("vec_id").alias("i"), F.concat(F.lit("r"), "vec_id").alias("row_key"))
    cols = spark.range(64).select(F.col("id").cast("int").alias("j"), F.concat(F.lit("c"), "id").alias("col_key"))
    return rounded(S.long_matrix(rows, cols, e.select(F.col("vec_id").alias("i"), cell.alias("values"))), "y")


def array_shards(spark, d):
    """Vectors as npy files, a file for each column and a thousand rows, and what a task reads of their ranges."""
    path = new_path(spark)
    A.write(table(spark, d, "embeddings").where("embedding IS NOT NULL").select("vec_id", "embedding", F.coalesce("label", F.lit(-1)).alias("label")), path)
    back = A.read(spark, path, "shard string, row long, vec_id long, label int, embedding array<float>", task_bytes=100_000)
    total = F.aggregate("embedding", F.lit(0e0), lambda s, x: s + x.cast("double"))
    return rounded(back.select("vec_id", "label", total.alias("total"), (F.col("row") < 1000).alias("in_shard")), "total")


def array_archives(spark, d):
    """Texts' and sources' lengths as npz files, of which only one column is read; then more shards after these."""
    path, docs = new_path(spark), table(spark, d, "documents")
    rows = docs.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n_chars"), F.array(F.length("lang"), F.length("source")).alias("pair")).withColumn("pair", F.transform("pair", lambda x: F.coalesce(x, F.lit(0))))
    A.write(rows, path, "npz", rows=5000)
    A.write(rows.where("n_chars > 500"), path, "npz", rows=5000, mode="append")
    return A.read(spark, path, "doc_id long, n_chars int", "npz").groupBy("doc_id", "n_chars").agg(F.count("*").alias("n"))


def keyed_stream(spark, d):
    """Centres that follow a stream, a state for each label: the vectors of even ids are one step, those of odd ids the next, and a row without a vector closes it."""
    from quillon.operators.codebook import first_centers
    from quillon.streaming import keyed_state as KS

    p = table(spark, d, "embeddings").select("label", "vec_id", "embedding")
    steps = p.select("label", (F.col("vec_id") % 2).cast("long").alias("step"), F.col("embedding").cast("array<double>").alias("embedding"))
    ends = p.select("label").distinct().select("label", F.lit(2).cast("long").alias("step"), F.lit(None).cast("array<double>").alias("embedding"))
    path, out, marks = new_path(spark), new_path(spark), new_path(spark)
    steps.union(ends).write.parquet(path)
    KS.use_rocks(spark)
    states = KS.follow(spark.readStream.schema(steps.schema).parquet(path), first_centers(p, "label", "vec_id", "embedding", 4), "label", "step", "embedding")
    states.writeStream.format("parquet").option("checkpointLocation", marks).option("path", out).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(out)
    return rounded(last.select("label", "step", "cid", "n", "cs", "ue", "last_ep", F.get("center", 0).alias("c0"), F.get("center", 63).alias("c63"), "late"), "cs", "ue", "c0", "c63")


def parse_once(spark, d):
    """Costly work once for each distinct value: the memoised and the parallel parse."""
    from quillon.operators.joins import map_distinct

    rows = table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").cast("string").alias("key"))
    return map_distinct(rows, "key", lambda keys: keys.withColumn("parsed", F.sha1("key"))).groupBy("parsed").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (csv_round_trip, tsv_gz_scan, split_scan, head_limit, molecule_list_scan, affinity_index_scan, sdf_scan, valid_in_space, sdf_index, structure_scan, mmcif_scan, resolution_lookup, structure_paths, complex_pairs, shard_listing, tar_batches, fasta_round_trip, unique_fasta, cluster_map_build, cluster_map_sink, best_hits, overlap_best_hits, json_lines_scan, log_event_routing, epoch_documents, union_of_runs, dataset_concat, split_sinks, annotated_sink, batched_sink, epoch_dump, json_sink, log_append, sized_keys_text, split_manifest, vocabulary_json, epoch_mean_csv, config_merge, csr_edges, ligand_token_parse, token_parse_json, unknown_to_mask, column_resolve, index_clamp, edge_offsets, state_restore, long_matrix, array_shards, array_archives, keyed_stream, parse_once)}

_NAMED = "CASE WHEN {k} % 6 = 0 THEN 'C' || {k} WHEN {k} % 6 = 1 THEN 'N=O' || {k} WHEN {k} % 6 = 2 THEN CAST({k} AS VARCHAR) WHEN {k} % 6 = 5 THEN '[O-]' || {k} END"
_STRUCT = "upper(resname) AS resname, chain, upper(element) AS element, count(*) AS n, round(sum(x), 3) AS x, round(sum(z), 3) AS z FROM ato WHERE element IS NOT NULL GROUP BY record, resname, chain, upper(element)"


def _keyed_sql() -> str:
    """Two steps of the moving centres; a step is the same SQL over the centres, counts and usage before it."""
    from quillon.plans.vector_queries import _CEN

    parts = [f"{_CEN}, s0 AS (SELECT label, cid, CAST(c AS DOUBLE[]) AS c, 1e0 AS cs, 0e0 AS ue, -1 AS last_ep, 0 AS n FROM cen)"]
    for t in (0, 1):
        parts.append(f"""a{t} AS (SELECT p.label, p.vec_id, cid, p.v FROM pts p JOIN s{t} USING (label) WHERE vec_id % 2 = {t} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY list_dot_product(p.v, c) DESC, cid) = 1),
x{t} AS (SELECT label, cid, i, sum(v[i]) AS s, count(*) AS n FROM a{t}, range(1, 65) r(i) GROUP BY label, cid, i),
m{t} AS (SELECT o.*, r.i, coalesce(x.n, 0) AS k, 0.8e0 * cs * c[r.i] + 0.2e0 * coalesce(s, 0e0) AS ea FROM s{t} o CROSS JOIN range(1, 65) r(i) LEFT JOIN x{t} x ON x.label = o.label AND x.cid = o.cid AND x.i = r.i),
l{t} AS (SELECT *, sqrt(sum(ea * ea) OVER (PARTITION BY label, cid)) AS len FROM m{t}),
s{t + 1} AS (SELECT label, cid, list(CASE WHEN k > 0 THEN ea / len ELSE c[i] END ORDER BY i) AS c, 0.8e0 * max(cs) + 0.2e0 * max(k) AS cs, 0.97e0 * max(ue) + 0.03e0 * max(k) AS ue, CASE WHEN max(k) > 0 THEN {t} ELSE max(last_ep) END AS last_ep, max(k) AS n FROM l{t} GROUP BY label, cid)""")
    rows = " UNION ALL ".join(f"SELECT label, {t} AS step, cid, n, round(cs, 6) AS cs, round(ue, 6) AS ue, last_ep, round(c[1], 6) AS c0, round(c[64], 6) AS c63, 0 AS late FROM s{t + 1} WHERE {guard}" for t, guard in ((0, "true"), (1, "label IN (SELECT label FROM pts WHERE vec_id % 2 = 1)")))
    return "WITH " + ", ".join(parts) + " " + rows


def _oracles() -> dict[str, str]:
    from quillon.plans.structure_queries import _ATO
    from quillon.plans.table_queries import _h
    from quillon.plans.vector_queries import _ASS, _CEN

    atoms = f"WITH {_ATO} SELECT record, {_STRUCT}"
    return {
        "array_shards": "SELECT vec_id, coalesce(label, -1) AS label, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total, true AS in_shard FROM embeddings WHERE embedding IS NOT NULL",
        "array_archives": "SELECT doc_id, coalesce(length(text), 0) AS n_chars, CASE WHEN length(text) > 500 THEN 2 ELSE 1 END AS n FROM documents",
        "keyed_stream": _keyed_sql(),
        "csv_round_trip": "SELECT p_partkey, p_name, CASE WHEN p_size % 3 > 0 THEN 'a \"b\", ' || p_brand ELSE '' END AS note, p_retailprice, '' AS none FROM part",
        "tsv_gz_scan": "SELECT o_orderpriority, o_orderstatus, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY ALL",
        "split_scan": "SELECT count_if(p_partkey % 4 = 0) AS n_valid, count(*) AS n_all FROM part",
        "head_limit": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100",
        "molecule_list_scan": f"SELECT smiles FROM (SELECT {_NAMED.format(k='p_partkey')} AS smiles FROM part) WHERE smiles IS NOT NULL",
        "affinity_index_scan": "WITH p AS (SELECT CASE p_partkey % 5 WHEN 1 THEN '1ab' || p_partkey WHEN 2 THEN '2cd' || p_partkey END AS id, CASE p_partkey % 5 WHEN 1 THEN 'Kd' ELSE 'ki' END AS kind, CASE p_partkey % 5 WHEN 1 THEN '=' ELSE '' END AS op, CASE p_partkey % 5 WHEN 1 THEN p_partkey * 1e3 ELSE p_partkey + 0.5e0 END AS nm FROM part WHERE p_partkey % 5 IN (1, 2)) SELECT id, kind, op, round(nm, 6) AS nanomolar, round(-log10(nm * 1e-9), 6) AS p FROM p",
        "sdf_scan": "SELECT 'mol' || vec_id AS title, 2 AS n_atoms, 2 AS bond, 'N' AS second, CASE WHEN vec_id % 5 = 0 THEN 1e0 ELSE round(round(CAST(embedding[4] AS DOUBLE) * 10, 4) + 0e0, 4) END AS z, 'M' || vec_id AS id FROM embeddings",
        "valid_in_space": "SELECT 'mol' || vec_id AS title, vec_id % 5 <> 0 AND vec_id % 7 <> 0 AS deep FROM embeddings",
        "sdf_index": "SELECT 'k' || vec_id % 50 AS key, CAST(max(vec_id) AS BIGINT) AS last FROM embeddings GROUP BY 1",
        "structure_scan": atoms,
        "mmcif_scan": atoms,
        "resolution_lookup": "SELECT CASE WHEN n_nationkey % 3 <> 0 THEN n_nationkey / 10e0 WHEN n_nationkey % 2 = 0 THEN CAST(n_nationkey + 1 AS DOUBLE) END AS resolution, count(*) AS n FROM nation GROUP BY 1",
        "structure_paths": "SELECT '1a' || p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN '/m/1A' || p_partkey || '.cif.gz' WHEN p_partkey % 3 = 1 THEN '/m/1a' || p_partkey || '.cif.gz' ELSE '/m/1A' || p_partkey || '.cif' END AS path FROM part",
        "complex_pairs": "SELECT 'c' || p_partkey AS folder, CASE p_partkey % 4 WHEN 0 THEN 'C' || p_partkey || '/c' || p_partkey || '_protein.pdb' WHEN 1 THEN 'C' || p_partkey || '/c' || p_partkey || '_pocket.pdb' ELSE 'C' || p_partkey || '/b_Protein.pdb' END AS protein, CASE WHEN p_partkey % 4 < 2 THEN 'C' || p_partkey || '/c' || p_partkey || '_ligand.sdf' ELSE 'C' || p_partkey || '/q_ligand.sdf' END AS ligand FROM part WHERE p_partkey % 4 < 3",
        "shard_listing": "SELECT 'batch=' || n_nationkey % 5 AS folder, CAST(sum(length(n_name) + 1) AS BIGINT) AS size FROM nation GROUP BY 1",
        "tar_batches": "SELECT 'run/' AS prefix, '[' || string_agg(CAST(b AS VARCHAR), ',' ORDER BY b) || ']' AS batches FROM (SELECT DISTINCT p_partkey % 40 AS b FROM part)",
        "fasta_round_trip": "SELECT * FROM (SELECT 's' || item_id AS id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS seq FROM benchmark) WHERE seq <> ''",
        "unique_fasta": "SELECT 'seq_' || (row_number() OVER (ORDER BY seq) - 1) AS id, seq FROM (SELECT DISTINCT regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g') AS seq FROM part)",
        "cluster_map_build": "WITH f AS (SELECT s_nationkey, row_number() OVER (ORDER BY min(s_suppkey)) - 1 AS cluster FROM supplier GROUP BY 1) SELECT 'm' || s_suppkey AS member, cluster FROM supplier JOIN f USING (s_nationkey)",
        "cluster_map_sink": "SELECT s_name, s_nationkey FROM supplier",
        "best_hits": "SELECT 'q' || l_suppkey AS query, 't' || l_partkey AS target, CAST(trunc(l_extendedprice * 100) AS BIGINT) AS bits FROM lineitem WHERE l_linenumber <> 4 QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY trunc(l_extendedprice * 100) DESC, 't' || l_partkey) = 1",
        "overlap_best_hits": "WITH b AS (SELECT l_partkey, ['train', 'valid', 'final'][l_orderkey % 3 + 1] AS split, max(struct_pack(p := l_extendedprice, s := l_suppkey)).s AS s FROM lineitem WHERE l_quantity > 48 GROUP BY 1, 2), w AS (SELECT l_partkey, max(s) FILTER (WHERE split = 'train') AS train, max(s) FILTER (WHERE split = 'valid') AS valid, max(s) FILTER (WHERE split = 'final') AS final FROM b GROUP BY 1) SELECT *, CASE WHEN valid IS NULL AND final IS NULL THEN 'guide_train' ELSE 'guide_test' END AS guide FROM w WHERE NOT (train IS NOT NULL AND (valid IS NOT NULL OR final IS NOT NULL))",
        "json_lines_scan": "SELECT count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids, round(sum(round(value, 2)), 2) AS total FROM events WHERE event_id % 10 <> 0",
        "log_event_routing": "SELECT CASE event_id % 4 WHEN 0 THEN 'valid' ELSE 'train' END AS part, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS steps FROM events WHERE event_id % 4 <> 1 GROUP BY 1",
        "epoch_documents": "SELECT CAST(n_nationkey AS BIGINT) AS epoch, CAST(n_nationkey * 7 % 11 AS DOUBLE) AS auroc FROM nation",
        "union_of_runs": "SELECT 'a' AS run, count(*) AS n, count(s_acctbal) AS with_auroc, 0 AS with_f1 FROM supplier UNION ALL SELECT 'b', count(*), 0, count(*) FROM customer",
        "dataset_concat": "SELECT o_orderstatus, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY 1",
        "split_sinks": "SELECT CASE WHEN p_size < 5 THEN 'valid' ELSE 'train' END AS split, count(*) AS n, 1 AS files_of_a_cluster FROM part GROUP BY 1",
        "annotated_sink": "SELECT s_suppkey, s_name, s_nationkey, round(s_acctbal, 2) AS s_acctbal FROM supplier",
        "batched_sink": "SELECT CAST(place // 1000 AS BIGINT) AS batch, count(*) AS n, min(o_orderkey) AS first FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS place FROM orders) GROUP BY 1",
        "epoch_dump": f"WITH {_ASS} SELECT CAST(label AS BIGINT) AS label, cid, count(*) AS n, CAST(sum(vec_id) AS BIGINT) AS ids FROM ass GROUP BY ALL",
        "json_sink": "SELECT * FROM nation",
        "log_append": "SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events WHERE event_type IN ('click', 'view') GROUP BY 1",
        "sized_keys_text": "WITH k AS (SELECT (l_suppkey % 50) || '_' || l_returnflag AS key, l_suppkey % 50 AS z, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT key, CAST(CASE WHEN n <= 30 THEN 1 ELSE ceil(n / 30e0) END AS BIGINT) AS size, row_number() OVER (ORDER BY z, key) AS place FROM k",
        "split_manifest": f"WITH r AS (SELECT s_name, row_number() OVER (ORDER BY {_h(3, 's_name')}, s_name) AS rn, count(*) OVER () AS n FROM supplier), v AS (SELECT *, rn <= greatest(1, round(n * 0.13e0)) AS valid FROM r) SELECT 3 AS seed, 0.13e0 AS valid_ratio, count(*) AS n_total, count_if(NOT valid) AS n_train, count_if(valid) AS n_valid, string_agg(s_name, ' ' ORDER BY s_name) FILTER (WHERE valid) AS valid FROM v",
        "vocabulary_json": "WITH t AS (SELECT DISTINCT unnest(string_split(text, '')) AS c FROM benchmark), v AS (SELECT c, row_number() OVER (ORDER BY c) + 3 AS id FROM t) SELECT 0 AS pad_id, 3 AS unk_id, count(*) + 4 AS vocab_size, max(CASE WHEN c = 'a' THEN id END) AS of_a, 'a' AS back FROM v",
        "epoch_mean_csv": "SELECT event_id % 40 AS epoch, printf('%.6f', avg(event_id % 1000)) AS mean FROM events GROUP BY 1",
        "config_merge": "SELECT * FROM (VALUES ('lr', '0.2'), ('dim', '16'), ('epochs', '3')) v(name, value)",
        "csr_edges": "SELECT l_orderkey, l_suppkey % 4 AS src, l_partkey AS dst, CAST(l_linenumber AS BIGINT) AS value FROM lineitem",
        "ligand_token_parse": "SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN '[]' ELSE '[' || p_size || ',' || p_partkey || ']' END AS ids FROM part",
        "token_parse_json": "SELECT p_partkey, '[' || p_size || ',' || p_partkey || ']' AS ids FROM part",
        "unknown_to_mask": "SELECT CASE WHEN p_partkey % 5 = 0 THEN 99 ELSE p_size END AS token, count(*) AS n FROM part GROUP BY 1",
        "column_resolve": "SELECT * FROM (VALUES (0, 'p_brand'), (1, 'p_retailprice'), (2, 'p_size'), (3, NULL)) v(i, resolved)",
        "index_clamp": "SELECT greatest(0, least(19, p_size - 5)) AS i, count(*) AS n FROM part GROUP BY 1",
        "edge_offsets": "SELECT s_nationkey, CAST(sum(n) OVER (ORDER BY s_nationkey) - n AS BIGINT) AS offset FROM (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1)",
        "state_restore": f"WITH {_CEN} SELECT label, count(*) AS k, -1 AS last_ep FROM cen GROUP BY label",
        "long_matrix": "SELECT 'r' || vec_id AS row_key, 'c' || j AS col_key, round(CAST(embedding[j + 1] AS DOUBLE), 6) AS y FROM embeddings, range(64) r(j) WHERE (j + vec_id) % 3 = 1",
        "parse_once": "SELECT sha1(CAST(l_partkey AS VARCHAR)) AS parsed, count(*) AS n FROM lineitem GROUP BY 1",
    }


ORACLES = _oracles()
