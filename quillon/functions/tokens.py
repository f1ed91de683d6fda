"""Columns and tables of token sequences: tokenising, vocabularies, encoding, padding, ragged layouts, masking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.clean import stable_hash
from quillon.plans.prefix import numbered

#: The order of alternatives of the atom tokeniser.
ATOM_TOKENS = r"(Cl|Br|Si|Se|Na|Li|Mg|Ca|Al|@@?|=|#|\(|\)|\[|\]|\.|/|\\|[A-Z][a-z]?)"
#: Tokens that stand for no text, in the order of their ids.
SPECIALS = ("[PAD]", "[MASK]", "[CLS]", "[UNK]")


def regex_tokens(text: Column, pattern: str = ATOM_TOKENS) -> Column:
    """All matches in order; what matches nothing is left out."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def ints(text: Column) -> Column:
    """Numbers parted by commas or white space; what is none is left out."""
    parts = F.filter(F.split(F.regexp_replace(text, ",", " "), r"\s+"), lambda x: x != "")
    return F.filter(F.transform(parts, lambda x: x.try_cast("int")), lambda x: x.isNotNull())


def ints_or_json(text: Column) -> Column:
    """As ints, or a JSON list where the text starts with a bracket."""
    return F.when(F.trim(text).startswith("["), F.from_json(text, "array<int>")).otherwise(ints(text))


def vocabulary(df: DataFrame, tokens: Column, specials: tuple[str, ...] = SPECIALS) -> DataFrame:
    """(token, id): distinct tokens in order after the specials. Only the distinct tokens are sorted, by ranges."""
    distinct = df.select(F.explode(tokens).alias("token")).distinct()
    ranked = numbered(distinct, ["token"], "id", len(specials))
    special = df.sparkSession.createDataFrame(list(enumerate(specials)), "id long, token string").select("token", "id")
    return special.union(ranked)


def encode(tokens: Column, vocab: dict[str, int], unknown: int, cls: int | None = None, longest: int | None = None) -> Column:
    """Ids of tokens, unknown ones as such, after cls, cut to the longest length."""
    table = F.create_map(*[F.lit(x) for pair in vocab.items() for x in pair])
    ids = F.transform(tokens, lambda t: F.coalesce(F.try_element_at(table, t), F.lit(unknown)))
    ids = F.concat(F.array(F.lit(cls)), ids) if cls is not None else ids
    return F.slice(ids, 1, longest) if longest is not None else ids


def padded(ids: Column, length: Column | int, pad: int) -> Column:
    """An array of the given length, filled up or cut."""
    length = F.lit(length) if isinstance(length, int) else length
    return F.slice(F.concat(ids, F.array_repeat(F.lit(pad), F.greatest(F.lit(0), length - F.size(ids)))), F.lit(1), length)


def ragged(df: DataFrame, batch: str, order: str, tokens: str) -> DataFrame:
    """df and, by batch in order, the first place of each row's tokens in the flat sequence, and their number."""
    before = Window.partitionBy(batch).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    counted = df.withColumn("length", F.size(tokens).cast("long"))
    return counted.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))


def unknown_to_mask(token: Column, mask_id: int) -> Column:
    return F.when(token < 0, mask_id).otherwise(token)


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) fixed by the seed and the parts."""
    return stable_hash(F.concat_ws(":", *[p.cast("string") for p in parts]), seed, 13) / F.lit(float(16**13))


def masked(df: DataFrame, token: str, keys: list[str], base_vocab: int, mask_id: int, prob: float = 0.3, seed: int = 0, keep: Column | None = None) -> DataFrame:
    """df (a row per token) and input and label for masked language modelling.

    Of the tokens that keep allows, a part prob is chosen and has its label; of these 80 % become the mask, 10 % a random token, 10 % stay. Others have the label -100.
    The draws are fixed by the seed and the keys, whatever the partitions.
    """
    u = lambda salt: uniform(seed, F.lit(salt), *[F.col(k) for k in keys])
    chosen = (u("pick") < prob) & (keep if keep is not None else F.lit(True))
    how, other = u("how"), F.floor(u("token") * base_vocab).cast("long")
    value = F.when(~chosen, F.col(token)).when(how < 0.8, F.lit(mask_id)).when(how < 0.9, other).otherwise(F.col(token))
    return df.withColumn("input", value.cast("long")).withColumn("label", F.when(chosen, F.col(token)).otherwise(F.lit(-100)).cast("long"))


def masked_text(df: DataFrame, token: str, keys: list[str], vocab: int, mask_id: int, kept: tuple[int, ...], prob: float = 0.15, seed: int = 0) -> DataFrame:
    """As masked, for tokens of text: padding and first tokens (kept) are never chosen, and a random token may be any of the vocabulary, specials too."""
    return masked(df, token, keys, vocab, mask_id, prob, seed, ~F.col(token).isin(*kept))


def codebook_size(n: Column, largest: int | None = None) -> Column:
    """One centre for 30 rows or fewer, else one for each 30 begun; at most the largest."""
    k = F.when(n <= 30, 1).otherwise(F.ceil(n / F.lit(30e0)))
    return (F.greatest(F.lit(1), F.least(F.lit(largest), k)) if largest else k).cast("long")


def codebook_size_by_bands(n: Column) -> Column:
    """One centre for 30 rows or fewer, one for each 100 begun below 1000, one for each 30 begun from there."""
    return F.when(n <= 30, 1).when(n < 1000, F.ceil(n / F.lit(100e0))).otherwise(F.ceil(n / F.lit(30e0))).cast("long")


def dict_entries(df: DataFrame, text: str) -> DataFrame:
    """df, a row for each 'key': number of a dict literal in its text, with key and size."""
    pairs = F.explode(F.regexp_extract_all(text, F.lit(r"'[^']+'\s*:\s*\d+"), F.lit(0)))
    part = lambda k: F.regexp_extract("_pair", r"'([^']+)'\s*:\s*(\d+)", k)
    return df.withColumn("_pair", pairs).select(*df.columns, part(1).alias("key"), part(2).cast("long").alias("size"))
