"""Scalar projections and filters. Columns in, columns out; a value that cannot be read is NULL unless strict."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Operand kinds by code, generic symbol prefixes, name patterns that lead to unresolved symbols.
OPERAND_KINDS = ["void", "reg", "mem", "phrase", "displ", "imm", "far", "near"]
GENERIC_PREFIXES = ["qword", "dword", "word", "byte", "unk", "off", "stru", "asc", "loc", "sub"]
GENERIC_NAME = f"^(?:{'|'.join(GENERIC_PREFIXES)})_[0-9A-Fa-f]+$"
STRUCTURE_DISPLACEMENT_LIMIT = 0x10000


def _or_fail(value: Column, text: Column, strict: bool) -> Column:
    if not strict:
        return value
    return F.when(value.isNull() & (F.trim(text) != ""), F.raise_error(F.concat(F.lit("not an integer: "), text)).cast("bigint")).otherwise(value)


def parse_hex(text: Column, strict: bool = False) -> Column:
    """A hexadecimal integer, `0x` allowed, unsigned 64-bit values by their bit pattern."""
    digits = F.regexp_extract(F.trim(text), r"^(?:0[xX])?([0-9A-Fa-f]{1,16})$", 1)
    return _or_fail(F.when(digits != "", F.conv(digits, 16, -10)).cast("bigint"), text, strict)


def parse_decimal(text: Column, strict: bool = False) -> Column:
    """A decimal integer; with `0x` a hexadecimal one."""
    value = F.when(F.lower(F.trim(text)).startswith("0x"), parse_hex(text)).otherwise(F.when(F.trim(text).rlike(r"^[+-]?[0-9]+$"), F.trim(text).try_cast("bigint")))
    return _or_fail(value, text, strict)


def parse_auto(text: Column, strict: bool = False) -> Column:
    """An integer in the base that its prefix tells: `0x`, `0o`, `0b` or decimal without leading zeros."""
    t = F.lower(F.trim(text))
    value = (
        F.when(t.startswith("0x"), parse_hex(text))
        .when(t.rlike("^0o[0-7]+$"), F.conv(F.substring(t, 3, 64), 8, 10).try_cast("bigint"))
        .when(t.rlike("^0b[01]+$"), F.conv(F.substring(t, 3, 64), 2, 10).try_cast("bigint"))
        .when(t.rlike(r"^[+-]?(0+|[1-9][0-9]*)$"), t.try_cast("bigint"))
    )
    return _or_fail(value, text, strict)


def render_rva(rva: Column) -> Column:
    return F.coalesce(F.concat(F.lit("0x"), F.hex(rva)), F.lit(""))


def parse_version(text: Column) -> Column:
    """struct(major, minor, build, sub) of up to four dotted numbers; Spark compares structs field by field."""
    parts = F.split(text, r"\.")
    return F.struct(*(F.coalesce(F.get(parts, F.lit(i)).try_cast("int"), F.lit(0)).alias(n) for i, n in enumerate(("major", "minor", "build", "sub"))))


def render_version(version: Column) -> Column:
    return F.concat_ws("-", *(version[n].cast("string") for n in ("major", "minor", "build", "sub")))


def pack_version(version: Column) -> Column:
    """major, minor: 8 bits each, build: 12, sub: 4, from the top."""
    part = lambda n, mask, shift: F.shiftleft(version[n].cast("bigint").bitwiseAND(F.lit(mask)), shift)
    return part("major", 0xFF, 24).bitwiseOR(part("minor", 0xFF, 16)).bitwiseOR(part("build", 0xFFF, 4)).bitwiseOR(part("sub", 0xF, 0))


def clean_text(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit("\0"), F.lit(""))


def pair_name(name: Column) -> Column:
    """A symbol name for the comparison of pairs: addresses become #, purely generic names nothing."""
    named = F.regexp_replace(F.lower(clean_text(name)), r"^(?:j_|nullsub_|sub_)[0-9a-f]+$", "")
    return F.regexp_replace(F.regexp_replace(named, r"0x[0-9a-f]+|[0-9a-f]{7,}", "#"), r"(?U)\s+", "")


def reference_name(name: Column) -> Column:
    """A symbol name for the comparison of references: only a-z, 0-9 and _."""
    named = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), f"^(?:{'|'.join(GENERIC_PREFIXES)})_[0-9a-f]+$", "")
    return F.regexp_replace(F.regexp_replace(named, r"[0-9a-f]{7,}", "#"), r"[^a-z0-9_]+", "")


def is_generic(name: Column) -> Column:
    return F.coalesce(name, F.lit("")).rlike(GENERIC_NAME) | (F.coalesce(name, F.lit("")) == "")


def segment_class(name: Column) -> Column:
    # fixed values: the words of segment names and their classes
    low = F.lower(F.coalesce(name, F.lit("")))
    has = lambda *words: reduce(Column.__or__, [low.contains(w) for w in words])
    return F.when(has("text"), "code").when(has("idata", "extern"), "import").when(has("rdata", "const"), "readonly").when(has("data", "bss"), "data").otherwise(low)


def sanitize(name: Column, extended: bool = True) -> Column:
    """An identifier of a type name; extended: only letters, digits and _ are left, and it is never empty nor begins with a digit."""
    kept = F.translate(F.replace(clean_text(name), F.lit("`anonymous namespace'"), F.lit("")), " &'*-`", "")
    kept = F.translate(kept, "(),:<>", "______")
    if not extended:
        return kept
    kept = F.regexp_replace(kept, "[^A-Za-z0-9_]", "_")
    return F.when(kept == "", "anonymous").when(kept.rlike("^[0-9]"), F.concat(F.lit("_"), kept)).otherwise(kept)


def decode_type_string(text: Column) -> Column:
    """`.?AVInner@Outer@@` as Outer::Inner; NULL if it is no such string or names nothing."""
    body = F.filter(F.split(F.substring(text, 5, F.length(text) - 6), "@"), lambda p: p != "")
    return F.when(text.startswith(".?A") & text.endswith("@@") & (F.length(text) >= 7) & (F.size(body) > 0), F.array_join(F.reverse(body), "::"))


# What pseudocode is freed of, in this order.
PSEUDOCODE = (
    (r"(?ms)//.*?$|/\*.*?\*/", " "),
    (r"(?U)\b(?:sub|loc|off|unk|byte|word|dword|qword|xmmword)_[0-9A-Fa-f]+\b", "SYMBOL"),
    (r"(?U)\b(?:0x[0-9A-Fa-f]+|[0-9]+(?:LL|i64|ui64|u)?)\b", "NUMBER"),
    (r"(?U)\b(?:v|a|result|this)[0-9]*\b", "VAR"),
    (r"(?U)\s+", ""),
)


def normalize_pseudocode(text: Column) -> Column:
    """Pseudocode without comments, names of addresses, numbers, temporaries and white space, lower case."""
    out = F.coalesce(text, F.lit(""))
    for pattern, by in PSEUDOCODE:
        out = F.regexp_replace(out, pattern, by)
    return F.lower(out)


def mnemonic_sequence(instructions: Column) -> Column:
    """The leading words of an array of instructions, lower case, joined by spaces; lines without one are left out."""
    lead = F.transform(F.coalesce(instructions, F.array().cast("array<string>")), lambda i: F.regexp_extract(i, r"(?U)^\s*([A-Za-z][A-Za-z0-9]*)", 1))
    return F.lower(F.array_join(F.filter(lead, lambda m: m != ""), " "))


def operand_kinds(codes: Column) -> Column:
    """Names of operand codes up to the first void."""
    stop = F.array_position(codes, F.lit(0))
    used = F.when(stop > 0, F.slice(codes, F.lit(1), stop.cast("int") - 1)).otherwise(codes)
    names = F.array(*map(F.lit, OPERAND_KINDS))
    return F.transform(used, lambda c: F.coalesce(F.get(names, c.cast("int")), F.lit("other")))


def signature(mnemonic: Column, codes: Column) -> Column:
    return F.concat(mnemonic, F.lit(":"), F.array_join(operand_kinds(codes), ","))


def displacement_class(value: Column, operand: Column) -> Column:
    """stack, object or NULL (too far, or relative to the instruction pointer) of a signed 64-bit displacement."""
    low = F.lower(F.coalesce(operand, F.lit("")))
    near = (value >= -STRUCTURE_DISPLACEMENT_LIMIT) & (value <= STRUCTURE_DISPLACEMENT_LIMIT)
    return F.when(near, F.when(low.contains("rsp") | low.contains("rbp"), "stack").when(~low.contains("rip"), "object"))


def use_kind(line: Column) -> Column:
    return F.when(line.contains("func_t"), "function").otherwise("data_or_global")


def complete_pairs(pairs: DataFrame, first: int | None = None) -> DataFrame:
    """Pairs with both addresses and both ids; the first n by row if n is given (a smoke run's own limit)."""
    whole = pairs.dropna(subset=["og_rva", "og_id", "ae_rva", "ae_id"])
    return whole.orderBy("row").limit(first) if first else whole


def search_names(names: DataFrame, patterns: list[str]) -> DataFrame:
    """One row per (name, pattern): the pattern stands in the raw or demangled name, underscores and case aside."""
    bare = lambda c: F.replace(F.lower(c), F.lit("_"), F.lit(""))
    hit = F.filter(F.array(*map(F.lit, patterns)), lambda p: F.contains(bare(F.concat_ws(" ", "raw_name", "demangled")), bare(p)))
    return names.select("*", F.explode(hit).alias("pattern"))


def matching_patterns(names: DataFrame, column: str, patterns: list[str]) -> DataFrame:
    """Names with the array of patterns that they contain, case aside; names without any are left out."""
    hit = F.filter(F.array(*map(F.lit, patterns)), lambda p: F.contains(F.lower(F.col(column)), F.lower(p)))
    return names.withColumn("patterns", hit).where(F.size("patterns") > 0)
