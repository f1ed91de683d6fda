"""Cleaning, parsing and token queries. Text cells of measurements are made from numbers of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import clean as C
from quillon.functions import tokens as T
from quillon.plans.common import interactions, rounded, table


def label_binarize(spark, d):
    rows = interactions(spark, d).withColumn("label", C.binarize(F.col("y"), 25.0))
    return rows.groupBy("prot", "label").agg(F.count("*").alias("n"))


def _cells(spark, d):
    """A messy text cell for each part."""
    p, n = table(spark, d, "part"), F.col("p_partkey").cast("string")
    cell = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit(" >1,"), n)).when(F.col("p_partkey") % 5 == 1, F.concat(F.lit("-"), n)).when(F.col("p_partkey") % 5 == 2, F.lit("")).when(F.col("p_partkey") % 5 == 3, F.concat(F.lit("<= ~"), n, F.lit(".5"))).otherwise(F.lit("abc"))
    return p.select("p_partkey", "p_brand", "p_size", "p_type", "p_name", cell.alias("cell"))


_CELLS = """cells AS (SELECT p_partkey, p_brand, p_size, p_type, p_name, CASE p_partkey % 5 WHEN 0 THEN ' >1,' || p_partkey WHEN 1 THEN '-' || p_partkey WHEN 2 THEN '' WHEN 3 THEN '<= ~' || p_partkey || '.5' ELSE 'abc' END AS cell FROM part),
nums AS (SELECT *, CASE WHEN v > 0 AND isfinite(v) THEN v END AS num FROM (SELECT *, TRY_CAST(replace(regexp_replace(trim(cell), '^[<>~=\\s]+', ''), ',', '') AS DOUBLE) AS v FROM cells))"""


def numeric_clean(spark, d):
    return _cells(spark, d).select("p_partkey", C.number(F.col("cell")).alias("num"), C.first_number(F.col("cell")).alias("first_num"))


def affinity_pvalue(spark, d):
    return rounded(_cells(spark, d).select("p_partkey", C.p_value(C.number(F.col("cell"))).alias("p")), "p")


def typed_affinity_parse(spark, d):
    """Cells such as "Kd=12.5uM", "ki 3 nM" and "EC50~2.0pM", without an operator too, and some that can't be read: other kinds, a bare M, two points."""
    pick = lambda *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("p_partkey") % len(xs) + 1).cast("int"))
    cell = F.concat(pick("Kd", "KI", "ic50", "EC50", "none"), pick("=", "", " ", ">=", "~", "==< "), F.col("p_size").cast("string"), pick(".5", "", ".25.5", ".125", "", ".", "0"), pick("uM", "nM", " pM", "mM", "M", "UM", "NM", "kM"))
    found = table(spark, d, "part").select("p_partkey", C.typed_affinity(cell).alias("a"))
    return rounded(found.select("p_partkey", "a.kind", "a.op", F.col("a.nanomolar").alias("nanomolar"), F.col("a.p").alias("p")), "nanomolar", "p")


def first_valid_column(spark, d):
    rows = _cells(spark, d)
    found = rows.select("p_partkey", C.first_valid({"cell": F.col("cell"), "size": F.when(F.col("p_size") > 25, F.col("p_size").cast("string")), "name": F.col("p_name")}).alias("f"))
    return found.select("p_partkey", "f.kind", "f.value")


def seq_clean(spark, d):
    docs = table(spark, d, "benchmark").select("item_id", F.regexp_replace("text", "[^A-Za-z ]", "").alias("s"))
    return docs.select("item_id", F.length(C.sequence(F.col("s"), foreign=0.3)).cast("long").alias("length"))


def id_list_parse(spark, d):
    cell = F.concat_ws(", ", F.concat(F.lit("1ab"), F.col("p_size") % 10), F.concat(F.lit("2xY"), F.col("p_partkey") % 10), F.lit("toolong"), F.lit("3_ab"), F.concat(F.lit("1ab"), F.col("p_size") % 10))
    rows = table(spark, d, "part").select("p_partkey", cell.alias("cell"))
    return rows.select("p_partkey", F.array_join(C.id_list(F.col("cell")), " ").alias("ids"), F.array_join(C.sorted_id_list(F.col("cell")), " ").alias("sorted_ids"))


def value_recode(spark, d):
    codes = {"PROMO": 0, "ECONOMY": 1, "STANDARD": 2}
    return table(spark, d, "part").groupBy(C.recode(F.col("p_type"), codes).alias("code")).agg(F.count("*").alias("n"))


def safe_key(spark, d):
    key = F.concat_ws("_", F.col("p_size") - 10, F.col("p_brand"))
    return table(spark, d, "part").select(C.safe_key(key).alias("safe")).distinct()


def reject_reasons(spark, d):
    why = C.reason([("small", F.col("p_size") < 5), ("cheap", F.col("p_retailprice") < 950), ("promo", F.col("p_type") == "PROMO")])
    return table(spark, d, "part").groupBy(why.alias("reason")).agg(F.count("*").alias("n")).withColumn("share", F.round(F.col("n") / F.sum("n").over(_all()), 6))


def _all():
    from pyspark.sql import Window

    return Window.partitionBy()  # over one row for each reason


def stable_hash(spark, d):
    return table(spark, d, "part").select("p_partkey", C.stable_hash(F.col("p_partkey").cast("string"), 123).alias("h"))


def regex_tokenize_counts(spark, d):
    words = table(spark, d, "documents").select(F.explode(T.regex_tokens(F.col("text"))).alias("token"))
    return words.groupBy("token").agg(F.count("*").alias("n"))


def char_vocab(spark, d):
    return T.vocabulary(table(spark, d, "benchmark"), T.chars(F.col("text")))


def encode_with_unk(spark, d):
    vocab = {c: i + 4 for i, c in enumerate("abcdefghijklm ")}
    ids = T.encode(T.chars(F.col("text")), vocab, unknown=3, cls=2, longest=32)
    return table(spark, d, "benchmark").select("item_id", F.array_join(F.transform(ids, lambda x: x.cast("string")), " ").alias("ids"))


def _turns(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.split(F.trim("text"), r"\s+").alias("words"))


def ragged_offsets(spark, d):
    return T.ragged(_turns(spark, d), "conv_id", "turn", "words").select("conv_id", "turn", "offset", "length")


def pad_and_mask_lengths(spark, d):
    from pyspark.sql import Window

    rows = _turns(spark, d).withColumn("longest", F.max(F.size("words")).over(Window.partitionBy("conv_id")))
    ids = rows.withColumn("ids", T.padded(F.transform("words", lambda w: F.length(w)), F.col("longest"), 0))
    return ids.select("conv_id", "turn", F.size("ids").cast("long").alias("width"), F.size(F.filter("ids", lambda x: x == 0)).cast("long").alias("pads"))


def mlm_mask_shares(spark, d):
    rows = table(spark, d, "events").select("event_id", (F.col("event_id") % 97).alias("token"))
    found = T.masked(rows, "token", ["event_id"], 97, 98, 0.3, seed=7)
    kind = F.when(F.col("label") < 0, "kept out").when(F.col("input") == 98, "mask").when(F.col("input") == F.col("label"), "same").otherwise("random")
    return found.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.sum("input").alias("sum_input"), F.sum("label").alias("sum_label"))


def codebook_size_rules(spark, d):
    n = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    return n.select("l_partkey", "n", T.codebook_size(F.col("n"), 3).alias("size_a"), T.codebook_size_by_bands(F.col("n")).alias("size_b"))


def common_tokens(spark, d):
    words = lambda df: F.array_distinct(F.split(F.lower("text"), r"[^a-z]+"))
    b = table(spark, d, "benchmark").select("item_id", words(None).alias("a"))
    other = b.select((F.col("item_id") - 1).alias("item_id"), F.col("a").alias("b"))
    return b.join(other, "item_id").select("item_id", F.size(F.filter(F.array_intersect("a", "b"), lambda x: x != "")).cast("long").alias("n_common"))


QUERIES = {f.__name__: f for f in (label_binarize, numeric_clean, affinity_pvalue, typed_affinity_parse, first_valid_column, seq_clean, id_list_parse, value_recode, safe_key, reject_reasons, stable_hash, regex_tokenize_counts, char_vocab, encode_with_unk, ragged_offsets, pad_and_mask_lengths, mlm_mask_shares, codebook_size_rules, common_tokens)}

_U = "(('0x' || substring(sha1('7|{salt}:' || event_id), 1, 13))::BIGINT / 4503599627370496e0)"
ORACLES = {
    "label_binarize": "SELECT l_suppkey AS prot, CASE WHEN l_quantity >= 25 THEN 1 ELSE 0 END AS label, count(*) AS n FROM lineitem GROUP BY ALL",
    "numeric_clean": f"WITH {_CELLS} SELECT p_partkey, num, TRY_CAST(nullif(regexp_extract(cell, '(\\d+(?:\\.\\d+)?)', 1), '') AS DOUBLE) AS first_num FROM nums",
    "affinity_pvalue": f"WITH {_CELLS} SELECT p_partkey, round(-log10(num * 1e-9), 6) AS p FROM nums",
    "typed_affinity_parse": """WITH c AS (SELECT p_partkey, ['Kd', 'KI', 'ic50', 'EC50', 'none'][p_partkey % 5 + 1] || ['=', '', ' ', '>=', '~', '==< '][p_partkey % 6 + 1] || p_size || ['.5', '', '.25.5', '.125', '', '.', '0'][p_partkey % 7 + 1] || ['uM', 'nM', ' pM', 'mM', 'M', 'UM', 'NM', 'kM'][p_partkey % 8 + 1] AS cell FROM part),
 x AS (SELECT p_partkey, regexp_extract(cell, '(?i)(Kd|Ki|IC50|EC50)\\s*([<>=~]*)\\s*([0-9.]+)\\s*([munp]?M)', ['k', 'o', 'v', 'u']) AS a FROM c),
 v AS (SELECT p_partkey, a.k AS kind, a.o AS op, TRY_CAST(nullif(a.v, '') AS DOUBLE) * CASE lower(a.u) WHEN 'mm' THEN 1e6 WHEN 'um' THEN 1e3 WHEN 'nm' THEN 1e0 WHEN 'pm' THEN 1e-3 END AS nm FROM x)
 SELECT p_partkey, CASE WHEN nm IS NOT NULL THEN kind END AS kind, CASE WHEN nm IS NOT NULL THEN op END AS op, round(nm, 6) AS nanomolar, round(CASE WHEN nm > 0 THEN -log10(nm * 1e-9) END, 6) AS p FROM v""",
    "first_valid_column": f"WITH {_CELLS} SELECT p_partkey, CASE WHEN num IS NOT NULL THEN 'cell' WHEN p_size > 25 THEN 'size' END AS kind, coalesce(num, CASE WHEN p_size > 25 THEN CAST(p_size AS DOUBLE) END) AS value FROM nums",
    "seq_clean": "WITH s AS (SELECT item_id, regexp_replace(upper(regexp_replace(text, '[^A-Za-z ]', '', 'g')), '\\s+', '', 'g') AS s FROM benchmark) SELECT item_id, CASE WHEN length(s) BETWEEN 50 AND 1022 AND length(regexp_replace(s, '[ACDEFGHIKLMNPQRSTVWY]', '', 'g')) / CAST(length(s) AS DOUBLE) <= 0.3e0 THEN length(s) END AS length FROM s",
    "id_list_parse": "SELECT p_partkey, '1AB' || (p_size % 10) || ' 2XY' || (p_partkey % 10) AS ids, '1AB' || (p_size % 10) || ' 2XY' || (p_partkey % 10) AS sorted_ids FROM part",
    "value_recode": "SELECT CASE p_type WHEN 'PROMO' THEN 0 WHEN 'ECONOMY' THEN 1 WHEN 'STANDARD' THEN 2 ELSE -2 END AS code, count(*) AS n FROM part GROUP BY ALL",
    "safe_key": "WITH k AS (SELECT DISTINCT regexp_replace((p_size - 10) || '_' || p_brand, '[^0-9A-Za-z_]', '_', 'g') AS s FROM part) SELECT DISTINCT CASE WHEN regexp_matches(s, '^[A-Za-z_]') THEN s ELSE 'k_' || s END AS safe FROM k",
    "reject_reasons": "SELECT CASE WHEN p_size < 5 THEN 'small' WHEN p_retailprice < 950 THEN 'cheap' WHEN p_type = 'PROMO' THEN 'promo' ELSE 'ok' END AS reason, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share FROM part GROUP BY 1",
    "stable_hash": "SELECT p_partkey, ('0x' || substring(sha1('123|' || p_partkey), 1, 15))::BIGINT AS h FROM part",
    "regex_tokenize_counts": "SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, 'Cl|Br|Si|Se|Na|Li|Mg|Ca|Al|@@?|=|#|\\(|\\)|\\[|\\]|\\.|/|\\\\|[A-Z][a-z]?')) AS token FROM documents) GROUP BY token",
    "char_vocab": "WITH t AS (SELECT DISTINCT unnest(string_split(text, '')) AS token FROM benchmark) SELECT token, row_number() OVER (ORDER BY token) + 3 AS id FROM t UNION ALL SELECT * FROM (VALUES ('[PAD]', 0), ('[MASK]', 1), ('[CLS]', 2), ('[UNK]', 3))",
    "encode_with_unk": "SELECT item_id, list_aggregate(list_transform(list_concat([2], list_transform(string_split(text, ''), lambda c: CASE WHEN c = ' ' THEN 17 WHEN c BETWEEN 'a' AND 'm' THEN ascii(c) - 93 ELSE 3 END))[1:32], lambda x: CAST(x AS VARCHAR)), 'string_agg', ' ') AS ids FROM benchmark",
    "ragged_offsets": "SELECT conv_id, turn, coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS offset, n AS length FROM (SELECT conv_id, turn, len(regexp_split_to_array(trim(text), '\\s+')) AS n FROM conversations)",
    "pad_and_mask_lengths": "SELECT conv_id, turn, max(n) OVER (PARTITION BY conv_id) AS width, max(n) OVER (PARTITION BY conv_id) - n AS pads FROM (SELECT conv_id, turn, len(regexp_split_to_array(trim(text), '\\s+')) AS n FROM conversations)",
    "mlm_mask_shares": f"""WITH u AS (SELECT event_id, event_id % 97 AS token, {_U.format(salt='pick')} AS p, {_U.format(salt='how')} AS h, {_U.format(salt='token')} AS t FROM events),
 m AS (SELECT CASE WHEN p >= 0.3e0 THEN token WHEN h < 0.8e0 THEN 98 WHEN h < 0.9e0 THEN floor(t * 97) ELSE token END AS input, CASE WHEN p < 0.3e0 THEN token ELSE -100 END AS label FROM u)
 SELECT CASE WHEN label < 0 THEN 'kept out' WHEN input = 98 THEN 'mask' WHEN input = label THEN 'same' ELSE 'random' END AS kind, count(*) AS n, CAST(sum(input) AS BIGINT) AS sum_input, CAST(sum(label) AS BIGINT) AS sum_label FROM m GROUP BY kind""",
    "codebook_size_rules": "SELECT l_partkey, n, CAST(greatest(1, least(3, CASE WHEN n <= 30 THEN 1 ELSE ceil(n / 30e0) END)) AS BIGINT) AS size_a, CAST(CASE WHEN n <= 30 THEN 1 WHEN n < 1000 THEN ceil(n / 100e0) ELSE ceil(n / 30e0) END AS BIGINT) AS size_b FROM (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey)",
    "common_tokens": "WITH w AS (SELECT item_id, list_distinct(regexp_split_to_array(lower(text), '[^a-z]+')) AS a FROM benchmark) SELECT x.item_id, len(list_filter(list_intersect(x.a, y.a), lambda t: t <> '')) AS n_common FROM w x JOIN w y ON y.item_id = x.item_id + 1",
}
