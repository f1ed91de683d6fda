"""Columns that clean and parse text cells of measurement tables. A cell that can't be read gives null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Nanomolar in a unit.
UNITS = {"m": 1e6, "u": 1e3, "n": 1e0, "p": 1e-3}
#: Letters of the amino acids.
AMINO = "ACDEFGHIKLMNPQRSTVWY"


def number(cell: Column) -> Column:
    """A positive number: without leading comparison signs and without thousands commas; else null."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(cell), r"^[<>~=\s]+", ""), ",", "")
    value = bare.try_cast("double")
    return F.when((value > 0) & ~F.isnan(value) & (value < float("inf")), value)


def first_number(cell: Column) -> Column:
    """The first run of digits with an optional fraction."""
    return F.regexp_extract(cell, r"(\d+(?:\.\d+)?)", 1).try_cast("double")


def p_value(nanomolar: Column) -> Column:
    """Minus the decimal logarithm of a concentration; null unless positive."""
    return F.when(nanomolar > 0, -F.log10(nanomolar * F.lit(1e-9)))


#: Kind, operator, number and unit of an affinity in text.
AFFINITY = r"(?i)(Kd|Ki|IC50|EC50)\s*([<>=~]*)\s*([0-9.]+)\s*([munp]?M)"


def typed_affinity(cell: Column) -> Column:
    """A struct of kind and op (as written), nanomolar and p from text such as "Kd=12.5uM" or "ki 3 nM"; null where there is none, and for a bare M, whose size isn't told."""
    part = lambda k: F.regexp_extract(cell, AFFINITY, k)
    unit = F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])
    nanomolar = part(3).try_cast("double") * F.try_element_at(unit, F.regexp_replace(F.lower(part(4)), "m$", ""))
    return F.when(nanomolar.isNotNull(), F.struct(part(1).alias("kind"), part(2).alias("op"), nanomolar.alias("nanomolar"), p_value(nanomolar).alias("p")))


def first_valid(columns: dict[str, Column]) -> Column:
    """A struct (kind, value) of the first column, in order, that holds a positive number."""
    return F.coalesce(*[F.when(number(c).isNotNull(), F.struct(F.lit(name).alias("kind"), number(c).alias("value"))) for name, c in columns.items()])


def sequence(cell: Column, shortest: int = 50, longest: int = 1022, foreign: float = 0.1, alphabet: str = AMINO) -> Column:
    """Capital letters without white space; null unless letters only, of a sound length, and with few letters outside the alphabet."""
    s = F.regexp_replace(F.upper(F.trim(cell)), r"\s+", "")
    odd = F.length(F.regexp_replace(s, f"[{alphabet}]", "")) / F.length(s)
    return F.when(s.rlike(r"^\p{L}+$") & F.length(s).between(shortest, longest) & (odd <= foreign), s)


def id_list(cell: Column) -> Column:
    """Distinct four-character codes in order, from text parted by commas, semicolons or white space."""
    return F.filter(F.array_distinct(F.split(F.upper(cell), r"[,\s;]+")), lambda x: x.rlike("^[A-Z0-9]{4}$"))


def sorted_id_list(cell: Column) -> Column:
    """Distinct codes of a digit and three ASCII letters or digits between word boundaries, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(cell, F.lit(r"\b[0-9][A-Za-z0-9]{3}\b"), F.lit(0)), F.upper)))


def binarize(value: Column, threshold: float) -> Column:
    """1 from the threshold on, else 0; NaN is 0, null stays null."""
    return F.when(value.isNull(), None).when(F.isnan(value), 0).when(value >= threshold, 1).otherwise(0)


def recode(value: Column, table: dict, default=-2) -> Column:
    """The table's entry for a value, or the default."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), value), F.lit(default))


def safe_key(key: Column) -> Column:
    """Other characters than ASCII letters and digits become "_"; "k_" goes before a key that starts with neither a letter nor "_"."""
    s = F.regexp_replace(key, "[^0-9A-Za-z_]", "_")
    return F.when(s.rlike("^[A-Za-z_]"), s).otherwise(F.concat(F.lit("k_"), s))


def clamp(value: Column, low: int, size: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(size - 1), value))


def reason(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that holds; "ok" if none does."""
    found = F.lit("ok")
    for name, holds in reversed(rules):
        found = F.when(F.coalesce(holds, F.lit(False)), name).otherwise(found)
    return found


def stable_hash(text: Column, seed: int, digits: int = 15) -> Column:
    """The first hexadecimal digits of the SHA-1 of "seed|text" as a number; up to 15 fit a long, 16 give a decimal."""
    kind = "bigint" if digits <= 15 else "decimal(20,0)"
    return F.conv(F.substring(F.sha1(F.concat_ws("|", F.lit(str(seed)), text).cast("binary")), 1, digits), 16, 10).cast(kind)


def resolve_column(columns: list[str], candidates: list[str]) -> str | None:
    """The column that a candidate names: first exactly, then as a part, in any case."""
    lower = {c.lower(): c for c in reversed(columns)}
    for candidate in candidates:
        if candidate.lower() in lower:
            return lower[candidate.lower()]
    return next((c for candidate in candidates for c in columns if candidate.lower() in c.lower()), None)


def usable(sequence_: Column, ligand: Column, tokens: Column | None = None) -> Column:
    """Whether a row has a sequence and a ligand that aren't blank, and tokens where they are needed."""
    there = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    both = there(sequence_) & there(ligand)
    return both if tokens is None else both & there(tokens)


def regressor_row(label: Column, ok: Column, y: Column) -> Column:
    """A struct of label, dist_ok (0 where it can't be read), y (null where it can't be read) and y_ok."""
    number_of = y.try_cast("double")
    return F.struct(label.try_cast("double").alias("label"), F.coalesce(ok.try_cast("double").cast("int"), F.lit(0)).alias("dist_ok"), number_of.alias("y"), number_of.isNotNull().cast("int").alias("y_ok"))


def key_allowed(key: Column, allowed: list[int]) -> Column:
    """Whether the number that a key begins with is among the allowed ones."""
    return F.coalesce(F.split(key, "_")[0].try_cast("int").isin(*allowed), F.lit(False))


def number_or(cell: Column, default: float) -> Column:
    """A cell as a number, or the default: minus infinity or NaN for missing metrics."""
    return F.coalesce(cell.try_cast("double"), F.lit(default))


def without_prefixes(names: Column, prefixes: list[str]) -> Column:
    """Whether a name begins with none of the prefixes."""
    found = F.lit(False)
    for p in prefixes:
        found = found | names.startswith(p)
    return ~found


def superscript(number_: Column) -> Column:
    """Digits and signs as superscripts."""
    return F.translate(number_.cast("string"), "0123456789+-", "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻")


def join_ids(ids: Column) -> Column:
    """Numbers parted by blanks."""
    return F.array_join(F.transform(ids, lambda x: x.cast("string")), " ")


def filled_lines(text: Column) -> Column:
    """The trimmed lines of a text that aren't blank."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\r\x0b\x0c"))), lambda x: x != "")


def shape_fault(rows: Column, width: int, longest: int) -> Column:
    """What is wrong with a matrix of features, an array of arrays: "empty", "ragged", "width" or "long"; null if nothing is."""
    sizes = F.array_distinct(F.transform(rows, lambda r: F.size(r)))
    return F.when(F.coalesce(F.size(rows), F.lit(0)) <= 0, "empty").when(F.size(sizes) > 1, "ragged").when(sizes[0] != width, "width").when(F.size(rows) > longest, "long")


def first_sequence(columns: list[Column], **bounds) -> Column:
    """The first of some cells, in order, that holds a sound sequence."""
    return F.coalesce(*[sequence(c, **bounds) for c in columns])
