"""Reports of codebooks, metric blocks, splits, samples, masks and collation over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import clean as N
from quillon.functions import tokens as K
from quillon.operators import aggregates as A
from quillon.operators import codebook as C
from quillon.operators import metrics as M
from quillon.operators import splits as S
from quillon.operators import training as T
from quillon.plans.common import SCORED, interactions, rounded, scored, table
from quillon.plans.vector_queries import _assigned, _centers, _points
from quillon.sources import logs as L


# Codebooks


def _shares(spark, d):
    """A share for each part, as if parts were keys."""
    n = table(spark, d, "lineitem").groupBy("l_partkey", "l_returnflag").agg(F.count("*").alias("cs"))
    return C.max_share(n.withColumn("ue", F.col("cs") * 2e0), "l_partkey")


def max_share_quantiles(spark, d):
    return rounded(C.share_report(_shares(spark, d)), "mean", "std", "p50", "p75", "p90", "p95", "p99", "most")


def worst_keys(spark, d):
    return rounded(C.worst_keys(_shares(spark, d).withColumn("max_share", F.round("max_share", 6)), "l_partkey"), "max_share")


def dead_statistics(spark, d):
    n = table(spark, d, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.count("*").alias("n"))
    state = n.select("l_suppkey", F.when(F.col("n") % 3 == 0, 0e0).when(F.col("n") % 3 == 1, 0.05e0).otherwise(2e0).alias("cs"), (F.col("n") % 2).alias("ever"))
    return rounded(C.dead_report(state, "l_suppkey"), "dead_share", "near_dead_share")


def epoch_report(spark, d):
    """What the last batch of an epoch tells: keys, their centres, the mean share, and the size of the vocabulary with its two specials."""
    shares, k = _shares(spark, d), table(spark, d, "lineitem").groupBy("l_partkey").agg(F.countDistinct("l_returnflag").alias("k"))
    found = shares.join(k, "l_partkey").agg(F.count("*").alias("n_keys"), F.sum("k").alias("centers"), F.avg("max_share").alias("mean"), (F.sum("k") + 2).alias("vocab"))
    return rounded(found, "mean")


def median_deviation(spark, d):
    return rounded(C.median_deviation(_points(spark, d), "label", "embedding"), "sigma")


def compact_clusters(spark, d):
    used = _assigned(spark, d).where("label % 2 = cid % 2").groupBy("label", "cid").agg(F.count("*").alias("n"))
    book = _centers(spark, d).join(used, ["label", "cid"], "left").select("label", "cid", F.coalesce("n", F.lit(0)).alias("n"))
    return C.compacted(book, "label").select("label", F.col("cid").cast("long").alias("cid"), "n")


def codebook_fill(spark, d):
    """Four centres to seven, by repeating them and by copying the first."""
    book = _centers(spark, d)
    parts = [C.filled(book, "label", 7, mode).withColumn("mode", F.lit(mode)) for mode in ("repeat", "first")]
    return rounded(parts[0].union(parts[1]).select("mode", "label", "cid", F.get("center", 3).alias("c3")), "c3")


def codebook_fill_data(spark, d):
    """As codebook_fill, with points of the key, chosen by a hash."""
    found = C.filled(_centers(spark, d), "label", 7, "data", _points(spark, d), "vec_id", "embedding")
    return found.groupBy("label").agg(F.count("*").alias("k"), F.countDistinct("center").alias("distinct_centers"))


def codebook_fill_points(spark, d):
    """The centres of codebook_fill_data."""
    found = C.filled(_centers(spark, d), "label", 7, "data", _points(spark, d), "vec_id", "embedding")
    return rounded(found.select("label", F.col("cid").cast("long").alias("cid"), F.get("center", 3).alias("c3")), "c3")


def codebook_init(spark, d):
    """Centres of a fresh codebook; each key has as many as asked for, padded where it has fewer points."""
    few = _points(spark, d).where("label > 0").unionByName(_points(spark, d).where("label = 0 AND vec_id < 30"))
    return C.init_codebook(few, "label", "vec_id", "embedding", 8, 2).groupBy("label").agg(F.count("*").alias("k"), F.countDistinct("cid").alias("ids"), F.countDistinct("center").alias("distinct_centers"))


def code_lookup(spark, d):
    rows = _assigned(spark, d).select("vec_id", "label", F.when(F.col("vec_id") % 5 == 0, F.lit(99)).otherwise(F.col("cid")).alias("cid"))
    return rounded(C.codes_of(rows, _centers(spark, d), "label").select("vec_id", F.get("center", 0).alias("c0")), "c0")


def quantized_output(spark, d):
    """Centres in place of points; points of unknown keys stay as they are."""
    book = _centers(spark, d).where("label < 7")
    found = C.quantized(_points(spark, d), C.assign(_points(spark, d), book, "label", "embedding"), book, "label", "vec_id", "embedding")
    return rounded(found.select("vec_id", F.get("out", 0).alias("o0"), F.get("out", 63).alias("o63")), "o0", "o63")


def existing_keys(spark, d):
    keys = table(spark, d, "part").select(F.concat_ws("_", "p_size", "p_brand").alias("key")).distinct()
    known = keys.where("length(key) % 2 = 0").select(N.safe_key(F.col("key")).alias("safe"))
    mapping = keys.where("key LIKE '1%'").select("key", F.lit("k_12_Brand_12").alias("safe"))
    return C.existing_key(keys, known, mapping)


def split_largest(spark, d):
    found = C.split_largest(_assigned(spark, d), "label", "vec_id", "embedding", 6)
    return found.groupBy("label", F.col("cid").cast("long").alias("cid")).agg(F.count("*").alias("n"))


def equivalence_agreement(spark, d):
    return rounded(C.equivalence_agreement(table(spark, d, "lineitem"), "l_partkey", "l_linenumber"), "loss")


def same_type_loss_by_batch(spark, d):
    """The loss of each batch of a hundred vectors."""
    p = _points(spark, d).withColumn("batch", F.floor(F.col("vec_id") / 100).cast("long"))
    return rounded(C.same_type_loss(p, "label", "vec_id", "embedding", batch="batch"), "loss", digits=8)


def same_type_loss(spark, d):
    return rounded(C.same_type_loss(_points(spark, d), "label", "vec_id", "embedding"), "loss", digits=8)


def gaussian_mixture(spark, d):
    """Soft clustering by Spark's Gaussian mixture over the first four components."""
    p = _points(spark, d).select("vec_id", F.slice("embedding", 1, 4).alias("v"))
    return C.gaussian_mixture(p, "vec_id", "v", 3).groupBy("cid").agg(F.count("*").alias("n"))


def mini_batch_kmeans(spark, d):
    found = C.mini_batches(_points(spark, d), _centers(spark, d), "label", "vec_id", "embedding", 3)
    return found.groupBy("label").agg(F.count("*").alias("k"))


# Metrics


def _logits(spark, d):
    return scored(spark, d).withColumn("logit", F.round((F.col("score") - 0.5e0) * 6, 3))


def logit_metric_block(spark, d):
    return rounded(M.logit_block(_logits(spark, d), "logit", "label", 0.4), "auroc", "average_precision", "f1", "prob_mean", "prob_std")


def ranking_cls_metrics(spark, d):
    return rounded(M.ranking_cls(_logits(spark, d), "logit", "label", "event_id"), "auroc", "average_precision", "ef1", "ef5", "ef10")


def affinity_ranking_metrics(spark, d):
    return rounded(M.affinity_ranking(scored(spark, d), "score", "truth", F.col("event_type") != "error", "event_id"), "spearman", "pearson", "ndcg20", "ndcg50", "ndcg100")


def argmax_accuracy(spark, d):
    e = table(spark, d, "embeddings").select(F.slice("embedding", 1, 10).alias("s"), "label")
    return rounded(M.argmax_accuracy(e, "s", "label"), "accuracy")


def best_epoch_by_loss(spark, d):
    """The epoch of each run with the least loss below the start of 100, the first of equals."""
    e = table(spark, d, "events").select("user_id", "event_id", F.col("value").alias("loss")).where("loss < 100")
    return A.argmax_row(e.withColumn("gain", -F.col("loss")), ["user_id"], "gain", "event_id").select("user_id", "event_id", "loss")


def best_hyper_parameter(spark, d):
    runs = table(spark, d, "lineitem").groupBy("l_returnflag", F.concat_ws("_", F.col("l_partkey") % 12 * 100, F.col("l_suppkey") % 3 * 16).alias("name")).agg(F.max("l_extendedprice").alias("best"))
    return A.argmax_row(runs, ["l_returnflag"], "best", "name")


def composite_name_order(spark, d):
    """Names of a size and a width, in the order of these numbers."""
    from quillon.plans.prefix import numbered

    names = table(spark, d, "part").select(F.concat_ws("_", F.col("p_partkey") % 12 * 100, F.col("p_size") % 5 * 16).alias("name")).distinct()
    part = lambda k: F.split("name", "_")[k].cast("long")
    return numbered(names.withColumn("k", part(0)).withColumn("w", part(1)), ["k", "w"], "place").select("name", "place")


# Statistics


def token_stats(spark, d):
    return A.token_stats(table(spark, d, "lineitem"), "l_partkey")


def frequent_classes(spark, d):
    return A.frequent_classes(table(spark, d, "part"), "p_size", 40).groupBy("p_size").agg(F.count("*").alias("n"))


def values_by_position(spark, d):
    key = F.concat_ws("_", "p_brand", "p_type", F.col("p_size") % 7)
    return A.values_at(table(spark, d, "part").select(key.alias("key")), "key", (1, 2, 5))


def last_epoch_records(spark, d):
    return A.last_epoch(table(spark, d, "events").select((F.col("event_id") % 13).alias("epoch"), "event_id"), "epoch")


def epoch_boxes(spark, d):
    return rounded(A.boxes(table(spark, d, "events").select((F.col("event_id") % 13).alias("epoch"), "value"), "epoch", "value"), "q25", "q50", "q75")


def top_score_filter(spark, d):
    s = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.round(F.avg("l_discount") * 6, 6).alias("score"), F.count("*").alias("n"), F.countDistinct("l_linenumber").alias("k"))
    return A.top_scores(s, "score", "n", "k", "l_partkey", 20, 3)


def row_shares(spark, d):
    n = table(spark, d, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.count("*").alias("n"))
    return rounded(A.row_shares(n, "l_suppkey", "n"), "share")


def one_hot_encode(spark, d):
    p = table(spark, d, "part")
    types = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
    return p.groupBy(F.array_join(F.transform(A.one_hot(F.col("p_type"), types), lambda x: x.cast("string")), "").alias("code")).agg(F.count("*").alias("n"))


def raw_count_load(spark, d):
    p, k = table(spark, d, "part"), F.col("p_partkey")
    line = F.when(k % 4 == 0, F.format_string("t Silhouette Score (subsample): 6_%d 0.50, sample size %d, K_e 3", F.col("p_size"), k)).when(k % 4 == 1, F.format_string(' "6_%d": %d,', F.col("p_size"), k)).when(k % 4 == 2, F.format_string("6_%d %d", F.col("p_size"), k)).otherwise("[VQ_COMMIT] 3 of 4 x")
    return L.raw_counts(p.select(line.alias("line")))


def per_batch_stats(spark, d):
    """Lengths, tokens and unknown tokens of each batch."""
    t = table(spark, d, "conversations").select((F.col("conv_id") % 9).alias("batch"), F.split(F.trim("text"), r"\s+").alias("w"))
    found = t.groupBy("batch").agg(F.min(F.size("w")).cast("long").alias("least"), F.avg(F.size("w")).alias("mean"), F.max(F.size("w")).cast("long").alias("most"), F.sum(F.size(F.filter("w", lambda x: F.length(x) < 3))).alias("unknown"))
    return rounded(found, "mean")


# Cleaning


def usable_rows(spark, d):
    p = table(spark, d, "part")
    seq, lig = F.when(F.col("p_partkey") % 5 > 0, F.col("p_name")), F.when(F.col("p_partkey") % 7 > 0, F.col("p_brand")).otherwise("  ")
    tok = F.when(F.col("p_size") > 20, F.col("p_size").cast("string")).otherwise("")
    return p.groupBy(N.usable(seq, lig).alias("plain"), N.usable(seq, lig, tok).alias("with_tokens")).agg(F.count("*").alias("n"))


def regressor_rows(spark, d):
    k = F.col("p_partkey")
    row = N.regressor_row((k % 2).cast("string"), F.when(k % 3 == 0, "").when(k % 3 == 1, "x").otherwise("1.0"), F.when(k % 4 == 0, "bad").otherwise(F.col("p_retailprice").cast("string")))
    return table(spark, d, "part").select("p_partkey", row.alias("r")).select("p_partkey", "r.label", "r.dist_ok", "r.y", "r.y_ok")


def key_whitelist(spark, d):
    key = F.when(F.col("p_partkey") % 9 == 0, F.lit("x_1")).otherwise(F.concat_ws("_", "p_size", F.lit("0")))
    return table(spark, d, "part").groupBy(N.key_allowed(key, [6, 7, 8, 16]).alias("allowed")).agg(F.count("*").alias("n"))


def metric_coercion(spark, d):
    """Missing metrics as minus infinity, so that they lose, and as NaN, which is then counted."""
    k = F.col("event_id")
    cell = F.when(k % 4 == 0, "null").when(k % 4 == 1, "").otherwise(F.round("value", 2).cast("string"))
    e = table(spark, d, "events").select("user_id", cell.alias("c"))
    found = e.groupBy("user_id").agg(F.max(N.number_or(F.col("c"), float("-inf"))).alias("best"), F.count(F.when(F.isnan(N.number_or(F.col("c"), float("nan"))), 1)).alias("lacking"))
    return found.withColumn("best", F.when(F.col("best") > float("-inf"), F.col("best")))


def state_key_filter(spark, d):
    return table(spark, d, "part").where(N.without_prefixes(F.col("p_brand"), ["Brand#1", "Brand#22"])).groupBy("p_brand").agg(F.count("*").alias("n"))


def superscripts(spark, d):
    return table(spark, d, "part").select("p_partkey", N.superscript(F.col("p_partkey") - 50).alias("s"))


def ids_to_text(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_partkey")).alias("ids"))
    return li.select("l_orderkey", N.join_ids(F.col("ids")).alias("text"))


def filled_lines(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(N.filled_lines(F.col("text"))).cast("long").alias("n"))


def feature_shape_check(spark, d):
    k = F.col("p_partkey")
    row = lambda n: F.array_repeat(F.lit(1.0), n)
    rows = F.when(k % 5 == 0, F.array().cast("array<array<double>>")).when(k % 5 == 1, F.array(row(3), row(4))).when(k % 5 == 2, F.array(row(4), row(4))).when(k % 5 == 3, F.array_repeat(row(3), 120)).otherwise(F.array_repeat(row(3), F.col("p_size")))
    return table(spark, d, "part").groupBy(N.shape_fault(rows, 3, 100).alias("fault")).agg(F.count("*").alias("n"))


def dict_literal(spark, d):
    text = F.concat(F.lit("X = {'a_1': "), F.col("p_size"), F.lit(", 'b-"), F.col("p_partkey"), F.lit("' : 7, # 'c': x\n}"))
    return K.dict_entries(table(spark, d, "part").select("p_partkey", text.alias("t")), "t").select("p_partkey", "key", "size")


# Splits and samples


def tiny_components(spark, d):
    sizes = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    return S.tiny_dropped(sizes, "n", 600)


def epoch_shards(spark, d):
    """Ten shards of an epoch without repeats, and, of five, twelve with."""
    n = table(spark, d, "nation").select("n_name", "n_nationkey")
    once = S.epoch_shards(n, "n_name", 10, 2, 7).withColumn("kind", F.lit("once"))
    return once.union(S.epoch_shards(n.where("n_nationkey < 5"), "n_name", 12, 2, 7).withColumn("kind", F.lit("again")))


def contiguous_slices(spark, d):
    """Train, valid and test as slices, which don't overlap."""
    return S.slices(table(spark, d, "supplier").select("s_suppkey"), ["s_suppkey"], {"train": 7, "valid": 2, "test": -1})


def index_split(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey")
    a, b = S.index_split(s, ["s_suppkey"], 0.2), S.index_split(s, ["s_suppkey"], 0.2, 5)
    return a.withColumnRenamed("first", "in_order").join(b.withColumnRenamed("first", "by_hash"), "s_suppkey")


def graph_split(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 10 < 2, "train").when(F.col("s_suppkey") % 10 == 2, "valid").otherwise("test").alias("part"))
    return S.graph_split(s, "s_suppkey", "part", 0.2, 11)


def class_sample_without(spark, d):
    """Three of each class, without forbidden rows."""
    p = table(spark, d, "part")
    allowed = p.join(p.where("p_size < 20").select("p_partkey"), "p_partkey", "left_anti")
    return S.per_class(allowed, "p_brand", 3, 9, ["p_partkey"]).select("p_brand", "p_partkey")


def sampled_groups(spark, d):
    li = table(spark, d, "lineitem")
    return S.sampled_groups(li, "l_orderkey", 5, 20, 1).groupBy("l_orderkey").agg(F.count("*").alias("n"))


def guide_sample(spark, d):
    """A thousand rows where there are more."""
    return S.sample_rows(table(spark, d, "orders").select("o_orderkey"), 1000, 42, ["o_orderkey"]).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


def sample_with_repeats(spark, d):
    """Forty rows of twenty-five: each pick is by a hash."""
    return S.sampled_again(table(spark, d, "nation").select("n_nationkey"), 40, 3, ["n_nationkey"])


def seeded_order(spark, d):
    """A seeded shuffle as the place of each row."""
    from quillon.plans.prefix import numbered

    s = table(spark, d, "supplier").select("s_suppkey").withColumn("h", S.seeded(4, "s_suppkey"))
    return numbered(s, ["h", "s_suppkey"], "place").select("s_suppkey", "place")


def short_ids(spark, d):
    """The first sixteen digits of SHA-1 of a text."""
    return table(spark, d, "part").select("p_partkey", F.substring(F.sha1("p_name"), 1, 16).alias("id"))


def distinct_sorted(spark, d):
    from quillon.plans.prefix import numbered

    return numbered(table(spark, d, "part").select("p_name").distinct(), ["p_name"], "place")


def existing_sequences(spark, d):
    part = lambda k: table(spark, d, "lineitem").where(f"l_orderkey % 3 = {k}").select(F.when(F.col("l_linenumber") == 1, " ").otherwise(F.concat(F.lit(" p"), "l_partkey")).alias("seq"))
    found = S.existing_values([("train", part(0)), ("valid", part(1)), ("final", part(2))], "seq")
    return found.select("seq", F.array_join("splits", " ").alias("splits"), "last")


def unused_positions(spark, d):
    """Positions that nothing covers keep their own value."""
    li = table(spark, d, "lineitem").where("l_quantity > 45").groupBy("l_partkey").agg(F.max("l_quantity").alias("q"))
    p = table(spark, d, "part")
    return p.join(li, p["p_partkey"] == li["l_partkey"], "left").select("p_partkey", F.coalesce("q", F.col("p_size").cast("double")).alias("value"), F.col("q").isNull().alias("unused"))


def dataset_statistics(spark, d):
    """Rows, share of positives, distinct entities, and over entities the mean, median and deviation of their sizes, by split."""
    rows = interactions(spark, d).withColumn("split", F.col("ord") % 3).withColumn("label", (F.col("y") >= 25).cast("int"))
    whole = rows.groupBy("split").agg(F.count("*").alias("pairs"), F.avg("label").alias("pos_rate"), F.countDistinct("prot").alias("prots"), F.countDistinct("lig").alias("ligs"))
    sizes = A.two_level(rows, ["split"], "lig", F.count("*")).select("split", "mean", "median", "std", "least", "most")
    return rounded(whole.join(sizes, "split"), "pos_rate", "mean", "median", "std")


# Masks and collation


def _vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double")).alias("f"))


def continuous_masking(spark, d):
    """Shares and sums of masked features in the three modes."""
    parts = []
    for mode in ("learned", "zero", "noise"):
        m = T.mask_continuous(_vectors(spark, d), "f", ["vec_id"], F.col("label") > 0, 0.3, mode, 5)
        total = lambda c: F.round(F.sum(F.aggregate(c, F.lit(0e0), lambda s, x: s + x)), 5)
        parts.append(m.groupBy("masked").agg(F.count("*").alias("n"), total("input").alias("inputs"), total("label").alias("labels")).withColumn("mode", F.lit(mode)))
    return parts[0].union(parts[1]).union(parts[2])


def reconstruction_metrics(spark, d):
    v = _vectors(spark, d).withColumn("p", F.transform("f", lambda x: F.round(x, 1)))
    return rounded(T.reconstruction(v, "p", "f", F.col("vec_id") % 3 == 0), "mae", "rmse")


def masked_mean_max(spark, d):
    v = _vectors(spark, d).withColumn("pad", F.transform("f", lambda x, i: (i + F.col("vec_id")) % 4 > F.col("vec_id") % 5))
    return rounded(v.select("vec_id", T.masked_mean(F.col("f"), F.col("pad")).alias("mean"), T.masked_max(F.col("f"), F.col("pad")).alias("most")), "mean", "most")


def top_share_mask(spark, d):
    w = T.top_mask(F.transform("embedding", lambda x: F.round(x.cast("double"), 2)), 0.1)
    n = lambda w: F.size(F.filter(w, lambda x: x != 0)).cast("long")
    both = F.get(F.transform(F.array(w), lambda w: F.struct(n(w).alias("kept"), F.round(F.aggregate(w, F.lit(0e0), lambda s, x: s + x), 4).alias("total"))), 0)
    return table(spark, d, "embeddings").select("vec_id", both.alias("x")).select("vec_id", "x.kept", "x.total")


def contact_top_loss(spark, d):
    pairs = table(spark, d, "events").select("user_id", "event_id", "value", (F.col("event_type") == "purchase").alias("contact"))
    return rounded(T.contact_loss(pairs, "user_id", "value", "contact", ["event_id"]), "loss")


def cursor_slices(spark, d):
    """A stream of tokens dealt to batches in order."""
    from quillon.plans.prefix import numbered

    stream = numbered(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "place")
    need = table(spark, d, "orders").where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("batch"), (F.col("o_orderkey") % 4).alias("need"))
    taken = T.cursor_slices(stream, "place", need, "batch", "need")
    return taken.groupBy("batch").agg(F.count("*").alias("n"), F.min("place").alias("first"), F.sum("l_partkey").alias("tokens"))


def global_atom_numbers(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    found = T.atom_numbers(li, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])
    return found.groupBy("l_orderkey").agg(F.min("atom_id").alias("first"), F.max("atom_id").alias("last"))


def node_numbers(spark, d):
    nodes = table(spark, d, "supplier").select("s_nationkey", "s_suppkey")
    return T.node_numbers(nodes, "s_nationkey", "s_suppkey")


def ragged_access(spark, d):
    """Molecules of flat batches by their offsets."""
    li = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.array_sort(F.collect_list("l_partkey")).alias("flat"))
    n = F.size("flat")
    rows = li.withColumn("offsets", F.array(F.lit(0), F.floor(n / 3).cast("int"), F.floor(n / 3).cast("int"), n))
    return T.ragged_rows(rows, "offsets", "flat").select("l_suppkey", F.col("at").cast("long").alias("at"), F.size("values").cast("long").alias("n"), F.coalesce(F.aggregate("values", F.lit(0).cast("long"), lambda s, x: s + x), F.lit(0)).alias("total"))


def normalised_features(spark, d):
    z = T.normalised(_vectors(spark, d), "f", F.col("label") < 7)
    return rounded(z.select("vec_id", F.get("z", 0).alias("z0"), F.get("z", 3).alias("z3")), "z0", "z3")


def shard_line_index(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("file"), F.split("text", "\n").alias("rows"))
    return T.shard_index(rows, "file", "rows").select("file", F.col("at").cast("long").alias("at"), F.length("value").cast("long").alias("length"))


def interaction_collate(spark, d):
    """Samples of a batch filled up, and their edges moved past the nodes of the samples before."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_partkey")).alias("tokens"))
    s = li.withColumn("edges", F.transform(F.sequence(F.lit(0), F.size("tokens") - 1), lambda i: F.struct(i.alias("src"), ((i + 1) % F.size("tokens")).alias("dst")))).withColumn("batch", F.floor(F.col("l_orderkey") / 16))
    c = T.collated(s, "batch", "l_orderkey", "tokens", "edges", -7)
    return c.select("l_orderkey", F.size("ids").cast("long").alias("width"), "length", F.size(F.filter("ids", lambda x: x == -7)).cast("long").alias("pads"), F.array_min(F.transform("shifted", lambda e: e["src"])).alias("first"), F.array_max(F.transform("shifted", lambda e: e["dst"])).alias("last"))


def distance_bias_collate(spark, d):
    """Biases from distances where the label, the flag and the size allow it."""
    p = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 2).alias("label"), (F.col("p_partkey") % 3).alias("ok"), F.lit(3).alias("size"))
    prof = table(spark, d, "part").where("p_partkey % 5 <> 0").select("p_partkey", F.transform(F.sequence(F.lit(1), F.when(F.col("p_partkey") % 7 == 0, 4).otherwise(3)), lambda i: (i * F.col("p_size") / 10).cast("double")).alias("distances"))
    found = T.distance_bias(p, prof, "p_partkey", "label", "ok", "size", 4.0, 8.0)
    return found.select("p_partkey", F.round(F.aggregate("bias", F.lit(0e0), lambda s, x: s + x), 6).alias("total"))


def noise_mix(spark, d):
    return rounded(table(spark, d, "part").select("p_partkey", T.noise_mix(F.col("p_retailprice"), 0.25, 9, F.col("p_partkey")).alias("x")), "x")


QUERIES = {f.__name__: f for f in (max_share_quantiles, worst_keys, dead_statistics, epoch_report, median_deviation, compact_clusters, codebook_fill, codebook_fill_data, codebook_fill_points, codebook_init, code_lookup, quantized_output, existing_keys, split_largest, equivalence_agreement, same_type_loss, same_type_loss_by_batch, gaussian_mixture, mini_batch_kmeans, logit_metric_block, ranking_cls_metrics, affinity_ranking_metrics, argmax_accuracy, best_epoch_by_loss, best_hyper_parameter, composite_name_order, token_stats, frequent_classes, values_by_position, last_epoch_records, epoch_boxes, top_score_filter, row_shares, one_hot_encode, raw_count_load, per_batch_stats, usable_rows, regressor_rows, key_whitelist, metric_coercion, state_key_filter, superscripts, ids_to_text, filled_lines, feature_shape_check, dict_literal, tiny_components, epoch_shards, contiguous_slices, index_split, graph_split, class_sample_without, sampled_groups, guide_sample, sample_with_repeats, seeded_order, short_ids, distinct_sorted, existing_sequences, unused_positions, dataset_statistics, continuous_masking, reconstruction_metrics, masked_mean_max, top_share_mask, contact_top_loss, cursor_slices, global_atom_numbers, node_numbers, ragged_access, normalised_features, shard_line_index, interaction_collate, distance_bias_collate, noise_mix)}


def _oracles() -> dict[str, str]:
    from quillon.plans.table_queries import _h
    from quillon.plans.vector_queries import _ASS, _CEN, _DIST, _PTS

    u = lambda seed, salt, key: f"(('0x' || substring(sha1('{seed}|{salt}:' || {key}), 1, 13))::BIGINT / 4503599627370496e0)"
    normal = lambda seed, key: f"(sqrt(-2 * ln(1 - {u(seed, 'radius', key)})) * cos(2 * pi() * {u(seed, 'angle', key)}))"
    shares = "n AS (SELECT l_partkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL), s AS (SELECT l_partkey, max(n) / CAST(sum(n) AS DOUBLE) AS p, count(*) AS k FROM n GROUP BY l_partkey)"
    logits = f"{SCORED}, lo AS (SELECT *, 1 / (1 + exp(-round((score - 0.5e0) * 6, 3))) AS p FROM scored)"
    auc = "(SELECT (sum(CASE WHEN label = 1 THEN rk ELSE 0e0 END) - sum(label) * (sum(label) + 1) / 2e0) / (sum(label) * sum(1 - label)) FROM (SELECT label, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2e0 AS rk FROM lo))"
    ap = "(SELECT sum(pos * CAST(tp AS DOUBLE) / k) / sum(pos) FROM (SELECT pos, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(n) OVER (ORDER BY p DESC) AS k FROM (SELECT p, sum(label) AS pos, count(*) AS n FROM lo GROUP BY p)))"
    ef = lambda f: f"(SELECT (sum(CASE WHEN rn <= k THEN label ELSE 0 END) / CAST(max(k) AS DOUBLE)) / avg(label) FROM (SELECT label, rn, greatest(1, CAST(round_even(n * {f}e0, 0) AS BIGINT)) AS k FROM (SELECT label, row_number() OVER (ORDER BY p DESC, event_id) AS rn, count(*) OVER () AS n FROM lo)))"
    ndcg = lambda k: f"round(sum(CASE WHEN place <= {k} THEN gain / log2(place + 1) ELSE 0e0 END) / sum(CASE WHEN best <= {k} THEN gain / log2(best + 1) ELSE 0e0 END), 6) AS ndcg{k}"
    vec = "v AS (SELECT vec_id, label, list_transform(embedding[1:4], lambda x: CAST(x AS DOUBLE)) AS f FROM embeddings)"
    masked = lambda mode, value: f"SELECT masked, count(*) AS n, round(sum(CASE WHEN masked THEN {value} ELSE list_sum(f) END), 5) AS inputs, round(sum(CASE WHEN masked THEN list_sum(f) END), 5) AS labels, '{mode}' AS mode FROM m GROUP BY masked"
    noise = " + ".join(normal(5, f"vec_id || ':{i}'") for i in range(4))
    return {
        "max_share_quantiles": f"WITH {shares} SELECT count(*) AS n_keys, round(avg(p), 6) AS mean, round(stddev_pop(p), 6) AS std, {', '.join(f'round(quantile_cont(p, {q / 100}), 6) AS p{q}' for q in (50, 75, 90, 95, 99))}, round(max(p), 6) AS most FROM s",
        "worst_keys": f"WITH {shares} SELECT l_partkey, round(p, 6) AS max_share FROM s ORDER BY 2 DESC, 1 LIMIT 20",
        "dead_statistics": "WITH n AS (SELECT l_suppkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL) SELECT l_suppkey, count(*) AS k, count_if(n % 3 = 0) AS dead, count_if(n % 3 < 2) AS near_dead, count_if(n % 2 = 1) AS ever_used, round(count_if(n % 3 = 0) / CAST(count(*) AS DOUBLE), 6) AS dead_share, round(count_if(n % 3 < 2) / CAST(count(*) AS DOUBLE), 6) AS near_dead_share FROM n GROUP BY l_suppkey",
        "epoch_report": f"WITH {shares} SELECT count(*) AS n_keys, CAST(sum(k) AS BIGINT) AS centers, round(avg(p), 6) AS mean, CAST(sum(k) + 2 AS BIGINT) AS vocab FROM s",
        "median_deviation": f"WITH {_PTS}, m AS (SELECT label, i, avg(v[i]) AS m FROM pts, range(1, 65) r(i) GROUP BY ALL), c AS (SELECT label, list(m ORDER BY i) AS c FROM m GROUP BY label) SELECT label, count(*) AS n, round(quantile_cont(sqrt({_DIST.format(a='v', b='c')}), 0.5), 6) AS sigma FROM pts JOIN c USING (label) GROUP BY label",
        "compact_clusters": f"WITH {_ASS}, n AS (SELECT label, cid, count(*) AS n FROM ass WHERE label % 2 = cid % 2 GROUP BY ALL) SELECT label, row_number() OVER (PARTITION BY label ORDER BY cid) - 1 AS cid, n FROM n",
        "codebook_fill": f"WITH {_CEN}, k AS (SELECT label, CAST(count(*) AS INTEGER) AS n FROM cen GROUP BY label), w AS (SELECT 'repeat' AS mode UNION ALL SELECT 'first'), a AS (SELECT mode, label, CAST(j AS INTEGER) AS cid, CASE WHEN j < n THEN j WHEN mode = 'repeat' THEN j % n ELSE 0 END AS f FROM k, w, range(7) r(j)) SELECT mode, a.label, a.cid, round(c[4], 6) AS c3 FROM a JOIN cen ON cen.label = a.label AND cen.cid = a.f",
        "code_lookup": f"WITH {_ASS} SELECT vec_id, CASE WHEN vec_id % 5 <> 0 THEN round(c[1], 6) END AS c0 FROM ass",
        "quantized_output": f"WITH {_ASS} SELECT vec_id, round(CASE WHEN label < 7 THEN c[1] ELSE v[1] END, 6) AS o0, round(CASE WHEN label < 7 THEN c[64] ELSE v[64] END, 6) AS o63 FROM ass",
        "existing_keys": "WITH k AS (SELECT DISTINCT p_size || '_' || p_brand AS key FROM part), r AS (SELECT key, 'k_' || regexp_replace(key, '[^0-9A-Za-z_]', '_', 'g') AS safe FROM k), known AS (SELECT safe FROM r WHERE length(key) % 2 = 0) SELECT key, CASE WHEN key LIKE '1%' AND 'k_12_Brand_12' IN (SELECT safe FROM known) THEN 'k_12_Brand_12' WHEN safe IN (SELECT safe FROM known) THEN safe END AS safe FROM r",
        "split_largest": f"WITH {_ASS}, n AS (SELECT label, cid, count(*) AS n FROM ass GROUP BY ALL), r AS (SELECT *, count(*) OVER w AS used, max(cid) OVER w AS top, row_number() OVER (PARTITION BY label ORDER BY n DESC, cid) AS rn FROM n WINDOW w AS (PARTITION BY label)), ch AS (SELECT label, cid, top + rn AS neu FROM r WHERE n > 5 AND rn <= 6 - used), i AS (SELECT a.label, a.cid, a.vec_id, a.v, neu FROM ass a JOIN ch ON ch.label = a.label AND ch.cid = a.cid), m AS (SELECT label, cid, j, avg(v[j]) AS m FROM i, range(1, 65) r(j) GROUP BY ALL), mm AS (SELECT label, cid, list(m ORDER BY j) AS mu FROM m GROUP BY ALL), d AS (SELECT i.*, sqrt({_DIST.format(a='v', b='mu')}) AS d FROM i JOIN mm USING (label, cid)), moved AS (SELECT vec_id, neu FROM (SELECT *, quantile_cont(d, 0.5) OVER (PARTITION BY label, cid) AS md FROM d) WHERE d > md) SELECT label, CAST(coalesce(neu, cid) AS BIGINT) AS cid, count(*) AS n FROM ass LEFT JOIN moved USING (vec_id) GROUP BY 1, 2",
        "equivalence_agreement": "WITH n AS (SELECT l_partkey, l_linenumber AS c, count(*) AS n FROM lineitem GROUP BY ALL), t AS (SELECT l_partkey, sum(n) AS t FROM n GROUP BY 1 HAVING sum(n) > 1), p AS (SELECT a.l_partkey, sum(a.n * b.n * abs(a.c - b.c)) / max(CAST(t.t AS DOUBLE) * t.t) AS d FROM n a JOIN n b ON a.l_partkey = b.l_partkey JOIN t ON t.l_partkey = a.l_partkey GROUP BY 1) SELECT count(*) AS groups, round(sum(d) / (count(*) + 1e-6), 6) AS loss FROM p",
        "same_type_loss_by_batch": f"WITH {_PTS}, q AS (SELECT a.vec_id // 100 AS batch, a.label = b.label AS same, {_DIST.format(a='a.v', b='b.v')} AS d FROM pts a JOIN pts b ON a.vec_id // 100 = b.vec_id // 100) SELECT batch, round(avg(CASE WHEN same THEN d + 1 ELSE exp(-d) END) / 10000, 8) AS loss FROM q GROUP BY batch",
        "same_type_loss": f"WITH {_PTS}, q AS (SELECT a.label = b.label AS same, {_DIST.format(a='a.v', b='b.v')} AS d FROM pts a, pts b) SELECT round(avg(CASE WHEN same THEN d + 1 ELSE exp(-d) END) / 10000, 8) AS loss FROM q",
        "logit_metric_block": f"WITH {logits} SELECT round({auc}, 6) AS auroc, round({ap}, 6) AS average_precision, round((SELECT 2e0 * count_if(p >= 0.4e0 AND label = 1) / (count_if(p >= 0.4e0) + sum(label)) FROM lo), 6) AS f1, 0.4e0 AS threshold, round((SELECT avg(p) FROM lo), 6) AS prob_mean, round((SELECT stddev_pop(p) FROM lo), 6) AS prob_std",
        "ranking_cls_metrics": f"WITH {logits} SELECT round({auc}, 6) AS auroc, round({ap}, 6) AS average_precision, round({ef(0.01)}, 6) AS ef1, round({ef(0.05)}, 6) AS ef5, round({ef(0.1)}, 6) AS ef10",
        "affinity_ranking_metrics": f"WITH {SCORED}, r AS (SELECT score, truth, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2e0 AS rp, rank() OVER (ORDER BY truth) + (count(*) OVER (PARTITION BY truth) - 1) / 2e0 AS rt, row_number() OVER (ORDER BY truth, event_id) - 1 AS up, row_number() OVER (ORDER BY score DESC, event_id) AS place, count(*) OVER () AS n FROM scored WHERE event_type <> 'error'), g AS (SELECT *, pow(2e0, up / CAST(n - 1 AS DOUBLE)) - 1 AS gain, n - up AS best FROM r) SELECT count(*) AS aff_n, round(corr(rp, rt), 6) AS spearman, round(corr(score, truth), 6) AS pearson, {ndcg(20)}, {ndcg(50)}, {ndcg(100)} FROM g",
        "argmax_accuracy": "SELECT round(avg(CASE WHEN list_position(embedding[1:10], list_max(embedding[1:10])) - 1 = label THEN 1e0 ELSE 0e0 END), 6) AS accuracy FROM embeddings",
        "best_epoch_by_loss": "SELECT user_id, event_id, value AS loss FROM events WHERE value < 100 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) = 1",
        "best_hyper_parameter": "WITH r AS (SELECT l_returnflag, (l_partkey % 12 * 100) || '_' || (l_suppkey % 3 * 16) AS name, max(l_extendedprice) AS best FROM lineitem GROUP BY ALL) SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY best DESC, name) = 1",
        "composite_name_order": "SELECT k || '_' || w AS name, row_number() OVER (ORDER BY k, w) - 1 AS place FROM (SELECT DISTINCT p_partkey % 12 * 100 AS k, p_size % 5 * 16 AS w FROM part)",
        "token_stats": "SELECT min(l_partkey) AS least, max(l_partkey) AS most, count(DISTINCT l_partkey) AS distinct_tokens, count(*) AS n FROM lineitem",
        "frequent_classes": "SELECT p_size, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 40",
        "values_by_position": "WITH k AS (SELECT string_split(p_brand || '_' || p_type || '_' || p_size % 7, '_') AS f FROM part), v AS (SELECT DISTINCT CAST(p AS INTEGER) AS place, f[p + 1] AS v FROM k, (VALUES (1), (2), (5)) t(p) WHERE p < len(f)) SELECT place, count(*) AS n, string_agg(v, ' ' ORDER BY v) AS found FROM v GROUP BY place",
        "last_epoch_records": "SELECT event_id % 13 AS epoch, event_id FROM events WHERE event_id % 13 = (SELECT max(event_id % 13) FROM events)",
        "epoch_boxes": "SELECT event_id % 13 AS epoch, count(*) AS n, min(value) AS least, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.75), 6) AS q75, max(value) AS most FROM events GROUP BY 1",
        "top_score_filter": "WITH s AS (SELECT l_partkey, round(avg(l_discount) * 6, 6) AS score, count(*) AS n, count(DISTINCT l_linenumber) AS k FROM lineitem GROUP BY 1 HAVING count(*) >= 20 AND count(DISTINCT l_linenumber) >= 3), r AS (SELECT *, score >= 0.35e0 AS strict, score >= 0.25e0 AS loose FROM s) SELECT * FROM (SELECT *, 'best' AS \"end\" FROM r ORDER BY score DESC, l_partkey LIMIT 30) UNION ALL SELECT * FROM (SELECT *, 'worst' AS \"end\" FROM r ORDER BY score, l_partkey LIMIT 30)",
        "row_shares": "WITH n AS (SELECT l_suppkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL) SELECT *, round(n / CAST(sum(n) OVER (PARTITION BY l_suppkey) AS DOUBLE), 6) AS share FROM n",
        "one_hot_encode": "SELECT CASE p_type WHEN 'ECONOMY' THEN '100000' WHEN 'LARGE' THEN '010000' WHEN 'MEDIUM' THEN '001000' WHEN 'PROMO' THEN '000100' WHEN 'SMALL' THEN '000010' WHEN 'STANDARD' THEN '000001' ELSE '000000' END AS code, count(*) AS n FROM part GROUP BY 1",
        "raw_count_load": "SELECT '6_' || p_size AS key, CAST(sum(p_partkey) AS BIGINT) AS n FROM part WHERE p_partkey % 4 < 3 GROUP BY 1",
        "per_batch_stats": "WITH t AS (SELECT conv_id % 9 AS batch, regexp_split_to_array(trim(text), '\\s+') AS w FROM conversations) SELECT batch, min(len(w)) AS least, round(avg(len(w)), 6) AS mean, max(len(w)) AS most, CAST(sum(len(list_filter(w, lambda x: length(x) < 3))) AS BIGINT) AS unknown FROM t GROUP BY batch",
        "usable_rows": "SELECT p_partkey % 5 > 0 AND p_partkey % 7 > 0 AS plain, p_partkey % 5 > 0 AND p_partkey % 7 > 0 AND p_size > 20 AS with_tokens, count(*) AS n FROM part GROUP BY 1, 2",
        "regressor_rows": "SELECT p_partkey, CAST(p_partkey % 2 AS DOUBLE) AS label, CASE WHEN p_partkey % 3 = 2 THEN 1 ELSE 0 END AS dist_ok, CASE WHEN p_partkey % 4 > 0 THEN p_retailprice END AS y, CASE WHEN p_partkey % 4 > 0 THEN 1 ELSE 0 END AS y_ok FROM part",
        "key_whitelist": "SELECT p_partkey % 9 <> 0 AND p_size IN (6, 7, 8, 16) AS allowed, count(*) AS n FROM part GROUP BY 1",
        "metric_coercion": "SELECT user_id, max(CASE WHEN event_id % 4 > 1 THEN round(value, 2) END) AS best, count_if(event_id % 4 < 2) AS lacking FROM events GROUP BY user_id",
        "state_key_filter": "SELECT p_brand, count(*) AS n FROM part WHERE NOT starts_with(p_brand, 'Brand#1') AND NOT starts_with(p_brand, 'Brand#22') GROUP BY 1",
        "superscripts": "SELECT p_partkey, translate(CAST(p_partkey - 50 AS VARCHAR), '0123456789-', '⁰¹²³⁴⁵⁶⁷⁸⁹⁻') AS s FROM part",
        "ids_to_text": "SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ' ' ORDER BY l_partkey) AS text FROM lineitem GROUP BY 1",
        "filled_lines": "SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) <> '')) AS n FROM documents",
        "feature_shape_check": "SELECT CASE p_partkey % 5 WHEN 0 THEN 'empty' WHEN 1 THEN 'ragged' WHEN 2 THEN 'width' WHEN 3 THEN 'long' END AS fault, count(*) AS n FROM part GROUP BY 1",
        "dict_literal": "SELECT p_partkey, 'a_1' AS key, CAST(p_size AS BIGINT) AS size FROM part UNION ALL SELECT p_partkey, 'b-' || p_partkey, 7 FROM part",
        "tiny_components": "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) >= 600",
        "codebook_fill_points": f"WITH {_CEN}, pick AS (SELECT label, v, row_number() OVER (PARTITION BY label ORDER BY {_h(0, 'vec_id')}, vec_id) - 1 AS r FROM pts), n AS (SELECT label, count(*) AS n FROM cen GROUP BY label) SELECT label, cid, round(c[4], 6) AS c3 FROM cen UNION ALL SELECT label, n + r, round(v[4], 6) FROM n JOIN pick USING (label) WHERE r < 7 - n",
        "epoch_shards": f"WITH r AS (SELECT n_name, row_number() OVER (ORDER BY {_h(9, 'n_name')}, n_name) - 1 AS pick FROM nation), q AS (SELECT n_name, row_number() OVER (ORDER BY {_h(9, 'n_name')}, n_name) - 1 AS place FROM nation WHERE n_nationkey < 5) SELECT pick, n_name, 'once' AS kind FROM r WHERE pick < 10 UNION ALL SELECT id, n_name, 'again' FROM range(12) t(id) JOIN q ON place = {_h(9, chr(39) + 'again:' + chr(39) + ' || id')} % 5",
        "contiguous_slices": "SELECT s_suppkey, CASE WHEN rn <= 7 THEN 'train' WHEN rn <= 9 THEN 'valid' ELSE 'test' END AS part FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS rn FROM supplier)",
        "index_split": f"SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) <= trunc(count(*) OVER () * 0.2e0) AS in_order, row_number() OVER (ORDER BY {_h(5, 's_suppkey')}, s_suppkey) <= trunc(count(*) OVER () * 0.2e0) AS by_hash FROM supplier",
        "graph_split": f"WITH s AS (SELECT s_suppkey, CASE WHEN s_suppkey % 10 < 2 THEN 'train' WHEN s_suppkey % 10 = 2 THEN 'valid' ELSE 'test' END AS part FROM supplier), t AS (SELECT s_suppkey, row_number() OVER (ORDER BY {_h(11, 's_suppkey')}, s_suppkey) <= trunc(count(*) OVER () * 0.2e0) AS hid FROM s WHERE part = 'test') SELECT s.s_suppkey, part, CASE WHEN hid IS NULL THEN part WHEN hid THEN 'test_ind' ELSE 'test_tran' END AS role FROM s LEFT JOIN t ON s.s_suppkey = t.s_suppkey",
        "class_sample_without": f"SELECT p_brand, p_partkey FROM part WHERE p_size >= 20 QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY {_h(9, 'p_partkey')}, p_partkey) <= 3",
        "sampled_groups": f"SELECT l_orderkey, n FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) >= 5) ORDER BY {_h(1, 'l_orderkey')}, l_orderkey LIMIT 20",
        "guide_sample": f"SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM (SELECT o_orderkey FROM orders ORDER BY {_h(42, 'o_orderkey')}, o_orderkey LIMIT 1000)",
        "sample_with_repeats": f"WITH q AS (SELECT n_nationkey, row_number() OVER (ORDER BY {_h(3, 'n_nationkey')}, n_nationkey) - 1 AS place FROM nation) SELECT id AS pick, n_nationkey FROM range(40) t(id) JOIN q ON place = {_h(3, chr(39) + 'again:' + chr(39) + ' || id')} % 25",
        "seeded_order": f"SELECT s_suppkey, row_number() OVER (ORDER BY {_h(4, 's_suppkey')}, s_suppkey) - 1 AS place FROM supplier",
        "short_ids": "SELECT p_partkey, substring(sha1(p_name), 1, 16) AS id FROM part",
        "distinct_sorted": "SELECT p_name, row_number() OVER (ORDER BY p_name) - 1 AS place FROM (SELECT DISTINCT p_name FROM part)",
        "existing_sequences": "WITH r AS (SELECT DISTINCT 'p' || l_partkey AS seq, l_orderkey % 3 AS k FROM lineitem WHERE l_linenumber <> 1) SELECT seq, string_agg(['train', 'valid', 'final'][k + 1], ' ' ORDER BY k) AS splits, ['train', 'valid', 'final'][max(k) + 1] AS last FROM r GROUP BY seq",
        "unused_positions": "WITH m AS (SELECT l_partkey, max(l_quantity) AS q FROM lineitem WHERE l_quantity > 45 GROUP BY 1) SELECT p_partkey, coalesce(q, CAST(p_size AS DOUBLE)) AS value, q IS NULL AS unused FROM part LEFT JOIN m ON l_partkey = p_partkey",
        "dataset_statistics": "WITH r AS (SELECT l_orderkey % 3 AS split, l_suppkey, l_partkey, CASE WHEN l_quantity >= 25 THEN 1 ELSE 0 END AS y FROM lineitem), e AS (SELECT split, l_partkey, CAST(count(*) AS DOUBLE) AS n FROM r GROUP BY ALL), z AS (SELECT split, round(avg(n), 6) AS mean, round(quantile_cont(n, 0.5), 6) AS median, round(stddev_samp(n), 6) AS std, min(n) AS least, max(n) AS most FROM e GROUP BY split) SELECT * FROM (SELECT split, count(*) AS pairs, round(avg(y), 6) AS pos_rate, count(DISTINCT l_suppkey) AS prots, count(DISTINCT l_partkey) AS ligs FROM r GROUP BY split) JOIN z USING (split)",
        "continuous_masking": f"WITH {vec}, m AS (SELECT *, label > 0 AND {u(5, 'mask', 'vec_id')} < 0.3e0 AS masked FROM v) {masked('learned', 'list_sum(f)')} UNION ALL {masked('zero', '0e0')} UNION ALL {masked('noise', noise)}",
        "reconstruction_metrics": f"WITH {vec}, x AS (SELECT unnest(f) AS t FROM v WHERE vec_id % 3 = 0) SELECT round(avg(abs(round(t, 1) - t)), 6) AS mae, round(sqrt(avg((round(t, 1) - t) * (round(t, 1) - t))), 6) AS rmse, count(*) AS masked_values, (SELECT count(*) FROM v WHERE vec_id % 3 = 0) AS masked_rows FROM x",
        "masked_mean_max": f"WITH {vec}, k AS (SELECT vec_id, [x FOR x, i IN f IF (i - 1 + vec_id) % 4 <= vec_id % 5] AS x FROM v) SELECT vec_id, round(coalesce(list_avg(x), 0e0), 6) AS mean, round(coalesce(list_max(x), 0e0), 6) AS most FROM k",
        "top_share_mask": "WITH w AS (SELECT vec_id, i, round(CAST(embedding[i] AS DOUBLE), 2) AS x FROM embeddings, range(1, 65) r(i)), k AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) <= 7) SELECT vec_id, count_if(x <> 0) AS kept, round(sum(x), 4) AS total FROM k GROUP BY vec_id",
        "contact_top_loss": "WITH f AS (SELECT avg(value) AS m, greatest(stddev_pop(value), 1e-6) AS s FROM events), x AS (SELECT user_id, event_id, event_type = 'purchase' AS c, (value - m) / s AS x FROM events, f), b AS (SELECT user_id, avg(ln(1 + exp(-x))) AS p FROM (SELECT * FROM x WHERE c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY x DESC, event_id) <= 8) GROUP BY 1), r AS (SELECT user_id, avg(ln(1 + exp(x))) AS q FROM x WHERE NOT c GROUP BY 1) SELECT round(avg(p + 0.3e0 * coalesce(q, 0e0)), 6) AS loss FROM b LEFT JOIN r USING (user_id)",
        "cursor_slices": "WITH s AS (SELECT l_partkey, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS place FROM lineitem), b AS (SELECT o_orderkey AS batch, CAST(sum(o_orderkey % 4) OVER (ORDER BY o_orderkey) AS BIGINT) AS b, o_orderkey % 4 AS n FROM orders WHERE o_orderkey % 5 = 0) SELECT batch, count(*) AS n, min(place) AS first, CAST(sum(l_partkey) AS BIGINT) AS tokens FROM b JOIN s ON place >= b.b - b.n AND place < b.b GROUP BY batch",
        "global_atom_numbers": "SELECT l_orderkey, min(i) AS first, max(i) AS last FROM (SELECT l_orderkey, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS i FROM lineitem) GROUP BY 1",
        "node_numbers": "SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS node_id FROM supplier",
        "ragged_access": "WITH f AS (SELECT l_suppkey, list(l_partkey ORDER BY l_partkey) AS a, count(*) AS n FROM lineitem GROUP BY 1), o AS (SELECT *, n // 3 AS k FROM f) SELECT l_suppkey, p AS at, CASE p WHEN 0 THEN k WHEN 1 THEN 0 ELSE n - k END AS n, CAST(CASE p WHEN 0 THEN coalesce(list_sum(a[1:k]), 0) WHEN 1 THEN 0 ELSE coalesce(list_sum(a[k + 1:n]), 0) END AS BIGINT) AS total FROM o, range(3) r(p)",
        "normalised_features": f"WITH {vec}, g AS (SELECT avg(f[1]) AS m0, stddev_pop(f[1]) + 1e-6 AS s0, avg(f[4]) AS m3, stddev_pop(f[4]) + 1e-6 AS s3 FROM v WHERE label < 7) SELECT vec_id, round((f[1] - m0) / s0, 6) AS z0, round((f[4] - m3) / s3, 6) AS z3 FROM v, g",
        "shard_line_index": "WITH l AS (SELECT doc_id AS file, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS r FROM documents) SELECT file, i - 1 AS at, length(r[i]) AS length FROM (SELECT file, r, unnest(range(1, len(r) + 1)) AS i FROM l)",
        "interaction_collate": "WITH s AS (SELECT l_orderkey, l_orderkey // 16 AS batch, count(*) AS n FROM lineitem GROUP BY 1), w AS (SELECT *, max(n) OVER (PARTITION BY batch) AS m, CAST(coalesce(sum(n) OVER (PARTITION BY batch ORDER BY l_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS b FROM s) SELECT l_orderkey, m AS width, n AS length, m - n AS pads, b AS first, b + n - 1 AS last FROM w",
        "distance_bias_collate": "WITH p AS (SELECT p_partkey, p_size, p_partkey % 2 = 1 AND p_partkey % 3 = 1 AND p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 AS gate FROM part) SELECT p_partkey, round(CASE WHEN gate THEN " + " + ".join(f"CASE WHEN {i} * p_size / 10e0 > 8 THEN 0e0 ELSE exp(-({i} * p_size / 10e0) / 4e0) END" for i in (1, 2, 3)) + " ELSE 0e0 END, 6) AS total FROM p",
        "noise_mix": f"SELECT p_partkey, round(0.75e0 * p_retailprice + 0.25e0 * {normal(9, 'p_partkey')}, 6) AS x FROM part",
    }


ORACLES = _oracles()
