"""Scalar text functions: Column in, Column out, built-in expressions only.

Missing text is '' inside the engine, never null. Patterns are Java's; (?U) gives \\w, \\s and \\b
their Unicode meaning and (?iu) folds Cyrillic letters too.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.functions import vocab as V

NUMBER = r"(\d+(?:[.,]\d+)?)"
STANDARD_NUMBER = r"\d[\d.]*(?:-\d+)?"


def clean(c) -> Column:
    """Trimmed, lower-case, '' for null."""
    return F.lower(F.trim(F.coalesce(_c(c).cast("string"), F.lit(""))))


def text(c) -> Column:
    return F.coalesce(_c(c).cast("string"), F.lit(""))


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def first(*options: Column) -> Column:
    """The first that is not empty, else ''. Each is computed once at most: nullif() computes what it is given twice within a lambda."""
    return F.coalesce(*[let(o, lambda x: F.when(x != "", x)) for o in options], F.lit(""))


def joined_cells(*cells) -> Column:
    """The cells that hold something, trimmed, with a space between them."""
    return F.concat_ws(" ", *[F.nullif(F.trim(text(c)), F.lit("")) for c in cells])


def number(s: Column) -> Column:
    return F.regexp_replace(s, ",", ".").try_cast("double")


def group(c: Column, pattern: str, n: int = 1) -> Column:
    """A group of the first match, '' without one."""
    return F.regexp_extract(c, pattern, n)


def let(value: Column, then) -> Column:
    """then(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def matched(t: Column, pattern: str, groups: int) -> Column:
    """The groups of a pattern that spans the whole text, 1-based in an array; an array of one without a match."""
    mark = "\u0001"
    return F.split(F.regexp_replace(t, pattern, "".join(f"{mark}${i + 1}" for i in range(groups))), mark)


def lookup(pairs: dict[str, str], key: Column) -> Column:
    """Value of the key in a fixed table, null without one."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), key)


def spellings(units: dict[str, list[str]]) -> dict[str, str]:
    return {s.lower().rstrip("."): unit for unit, forms in units.items() for s in forms}


def alternatives(words) -> str:
    """Alternation that prefers longer words."""
    return "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w)))


_COLUMN_SPELLINGS = {s.lower(): u for u, forms in V.COLUMN_UNITS.items() for s in forms}
_TAIL_SPELLINGS = spellings(V.TAIL_UNITS)
_COLUMN_ALT, _TAIL_ALT = alternatives(_COLUMN_SPELLINGS), alternatives(_TAIL_SPELLINGS)


# Quantities and units


def normalize_uom(c) -> Column:
    """Canonical unit of a unit's spelling; null if unknown."""
    return lookup(_COLUMN_SPELLINGS, F.regexp_replace(clean(c), r"\.+$", ""))


def header_uom(c) -> Column:
    """Unit named in a column's header: the last token that is one."""
    tokens = F.split(F.lower(text(c)), r"[\s,().;]+")
    units = F.filter(F.transform(tokens, lambda t: lookup(_COLUMN_SPELLINGS, t)), lambda u: u.isNotNull())
    return F.try_element_at(units, F.lit(-1))


def parse_qty_uom(c) -> Column:
    """struct<qty, uom, rest>: the first `number unit` anywhere, and the text without it and its empty brackets."""
    p = rf"(?siuU)^(.*?){NUMBER}\s*({_COLUMN_ALT})\.?(?=\s|$|[,;)])(.*)$"

    def found(t, g):
        before, after = F.regexp_replace(g[1], r"(?U)\s+$", ""), F.regexp_replace(g[4], r"(?U)^\s+", "")
        boxed = before.endswith("(") & after.startswith(")")
        rest = F.concat_ws(
            " ",
            F.nullif(F.when(boxed, F.regexp_replace(before, r"(?U)\s*\($", "")).otherwise(before), F.lit("")),
            F.nullif(F.when(boxed, F.regexp_replace(after, r"(?U)^\)\s*", "")).otherwise(after), F.lit("")),
        )
        return F.struct(number(g[2]).alias("qty"), lookup(_COLUMN_SPELLINGS, F.lower(g[3])).alias("uom"), rest.alias("rest"))

    return let(text(c), lambda t: let(matched(t, p, 4), lambda g: F.when(F.size(g) == 5, found(t, g)).otherwise(_nothing(t, "rest"))))


def _nothing(t: Column, rest: str) -> Column:
    return F.struct(F.lit(None).cast("double").alias("qty"), F.lit(None).cast("string").alias("uom"), t.alias(rest))


def qty_uom_suffix(c) -> Column:
    """struct<qty, uom, rest>: `(number unit)` or ` number unit` at the end."""
    p = rf"(?siuU)^(.*?)(?:\(\s*{NUMBER}\s*({_COLUMN_ALT})\.?\s*\)|\s+{NUMBER}\s*({_COLUMN_ALT})\.?)\s*$"

    def found(g):
        return F.struct(number(first(g[2], g[4])).alias("qty"), lookup(_COLUMN_SPELLINGS, F.lower(first(g[3], g[5]))).alias("uom"), F.regexp_replace(g[1], r"(?U)\s+$", "").alias("rest"))

    return let(text(c), lambda t: let(matched(t, p, 5), lambda g: F.when(F.size(g) == 6, found(g)).otherwise(_nothing(t, "rest"))))


def tail_quantity(c) -> Column:
    """struct<clean, qty, uom, multiplier, expr, reason>: quantity and unit at the end of a line.

    `N тыс. unit` counts thousands; then `N unit`; a number before another short word is a reason to
    look, and no unit is ever assumed.
    """
    thousand = rf"(?siuU)^(.*?)((?<!\S){NUMBER}\s+тыс\.?\s*(\w+)\.?\s*)$"
    plain = rf"(?siuU)^(.*?)((?<!\S){NUMBER}\s*({_TAIL_ALT})\.?\s*)$"
    unknown = rf"(?siuU)^(.*?)((?<!\S){NUMBER}\s+([а-яёa-zA-Z]{{2,12}})\.?\s*)$"
    no = F.lit(None).cast("string")

    def made(clean, qty, unit, times, expr, reason):
        return F.struct(clean.alias("clean"), qty.cast("double").alias("qty"), unit.alias("uom"), F.lit(times).alias("multiplier"), expr.alias("expr"), reason.alias("reason"))

    def known(g, times):
        return made(F.regexp_replace(g[1], r"(?U)\s+$", ""), number(g[3]) * times, lookup(_TAIL_SPELLINGS, F.lower(g[4])), times, F.trim(g[2]), no)

    def choose(t):
        none = F.lit(None)
        lost = lambda g: made(t, none, no, 1, F.trim(g[2]), F.lit(V.UNKNOWN_UNIT))
        third = let(matched(t, unknown, 4), lambda g: F.when(F.size(g) == 5, lost(g)).otherwise(made(t, none, no, 1, no, no)))
        second = let(matched(t, plain, 4), lambda g: F.when(F.size(g) == 5, known(g, 1)).otherwise(third))
        return let(
            matched(t, thousand, 4),
            lambda g: F.when(F.size(g) != 5, second).when(lookup(_TAIL_SPELLINGS, F.lower(g[4])).isNotNull(), known(g, 1000)).otherwise(lost(g)),
        )

    return let(F.trim(F.regexp_replace(text(c), r"[ \t]+", " ")), choose)


def strip_tail_phrase(c, phrases: list[str]) -> Column:
    """struct<clean, phrase>: without the longest of the phrases that ends the text, whatever its case."""
    t = F.trim(text(c))
    own = [p for p in sorted(phrases, key=len, reverse=True) if p.strip()]
    out = F.struct(t.alias("clean"), F.lit(None).cast("string").alias("phrase"))
    for p in reversed(own):
        cut = F.rtrim(t.substr(F.lit(1), F.length(t) - len(p.strip())))
        out = F.when(F.lower(t).endswith(p.strip().lower()), F.struct(cut.alias("clean"), F.lit(p).alias("phrase"))).otherwise(out)
    return out


def preprocess_row(name, qty_cell=None, uom_cell=None, header_unit=None, phrases: list[str] | None = None, combined: bool | Column = False) -> Column:
    """struct<cleaned_name, qty, uom, source, fail_reason, tail_qty_expr, tail_phrase_cut, qty_multiplier>.

    Quantity: its column, else the name's tail. Unit: with the quantity, else its column, else the
    header. A quantity without a unit stays; a unit without a quantity goes.
    """
    none = F.lit(None).cast("string")
    qty_cell = text(qty_cell) if qty_cell is not None else F.lit("")
    uom_cell = text(uom_cell) if uom_cell is not None else F.lit("")
    header_unit = F.nullif(text(header_unit), F.lit("")) if header_unit is not None else none
    plain = F.when(~(combined if isinstance(combined, Column) else F.lit(combined)), number(F.regexp_replace(qty_cell, "[ \u00a0]", "")))

    def columns(both):
        together = plain.isNull() & both["qty"].isNotNull() & both["uom"].isNotNull()
        qty = F.coalesce(plain, F.when(together, both["qty"]))
        own = F.when(qty.isNotNull() & ~together & (uom_cell != ""), normalize_uom(uom_cell))
        return F.struct(qty.alias("qty"), F.when(together, both["uom"]).alias("joined"), own.alias("own"), F.when(qty.isNotNull(), header_unit).alias("header"))

    def done(name, col, tail):
        from_tail = col["qty"].isNull() & tail["qty"].isNotNull() & tail["uom"].isNotNull()
        qty = F.when(from_tail, tail["qty"]).otherwise(col["qty"])
        uom = F.when(from_tail, tail["uom"]).otherwise(F.coalesce(col["joined"], col["own"], col["header"]))
        source = (
            F.when(from_tail, V.FROM_NAME).when(qty.isNull(), V.NOT_FOUND).when(col["joined"].isNotNull(), V.FROM_COLUMN).when(col["own"].isNotNull(), V.FROM_UNIT_COLUMN)
            .when(col["header"].isNotNull(), V.FROM_HEADER).otherwise(V.NOT_FOUND)
        )
        left = F.when(col["qty"].isNull(), tail["clean"]).otherwise(name)
        return let(strip_tail_phrase(left, phrases or []), lambda cut: F.struct(
            F.trim(F.regexp_replace(F.when(cut["phrase"].isNotNull(), cut["clean"]).otherwise(left), r"[ \t]+", " ")).alias("cleaned_name"),
            qty.alias("qty"), F.when(qty.isNotNull(), uom).alias("uom"), source.alias("source"), tail["reason"].alias("fail_reason"),
            tail["expr"].alias("tail_qty_expr"), cut["phrase"].alias("tail_phrase_cut"), F.when(from_tail, tail["multiplier"]).otherwise(1).alias("qty_multiplier"),
        ))

    return let(F.trim(text(name)), lambda n: let(let(parse_qty_uom(qty_cell), columns), lambda col: let(tail_quantity(n), lambda tail: done(n, col, tail))))


def join_thousands(c) -> Column:
    """Numbers without the spaces between thousands."""
    return F.regexp_replace(text(c), r"(?U)(?<=\d)\s+(?=\d{3}\b)", "")


def dash_quantity(c) -> Column:
    """struct<name, qty, uom>: `name - N unit`, split at the last dash whose right side is only that."""

    def split_at(t, sep, otherwise):
        def judge(right):
            left = F.trim(t.substr(F.lit(1), F.length(t) - F.length(right) - len(sep)))
            return let(parse_qty_uom(join_thousands(F.trim(right))), lambda got: F.when(
                t.contains(sep) & (left != "") & got["qty"].isNotNull() & got["uom"].isNotNull() & (got["rest"] == ""),
                F.struct(left.alias("name"), got["qty"].alias("qty"), got["uom"].alias("uom")),
            ).otherwise(otherwise))

        return let(F.substring_index(t, sep, -1), judge)

    def judge_all(t):
        out = F.struct(t.alias("name"), F.lit(None).cast("double").alias("qty"), F.lit(None).cast("string").alias("uom"))
        for sep in ("-", "—", " - ", " — "):
            out = split_at(t, sep, out)
        return out

    return let(text(c), judge_all)


def is_note(c) -> Column:
    return text(c).rlike("(?iuU)^(?:" + "|".join(V.NOTE_STARTS) + ")")


def format_qty(c) -> Column:
    """At most three decimals, without trailing zeros; '' for nothing."""
    return F.when(_c(c).isNull() | F.isnan(_c(c).cast("double")), "").otherwise(F.regexp_replace(F.format_string("%.3f", F.round(_c(c).cast("double"), 3)), r"\.?0+$", ""))


# Sizes, names and keys


def clean_escapes(c) -> Column:
    t = F.regexp_replace(text(c), r"_x[0-9A-Fa-f]{4}_", " ")
    t = F.regexp_replace(t, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    return F.trim(F.regexp_replace(t, "  +", " "))


def extraction_text(c) -> Column:
    """Lower case with metric and size separators in Latin letters and points in numbers."""
    t = F.regexp_replace(F.lower(text(c)), r"м(\d)", "m$1")
    t = F.translate(t, "х×", "xx")
    t = F.regexp_replace(t, r"(\d)\*(\d)", "$1x$2")
    t = F.regexp_replace(t, r"(\d),(\d)", "$1.$2")
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def normalize_size(c) -> Column:
    """`М12 × 80 мм` -> `M12X80`."""
    t = F.upper(F.translate(clean_escapes(c), "МмХх×", "MmXxX"))
    t = F.regexp_replace(t, r"(?U)M[\s\-]+(\d)", "M$1")
    t = F.translate(t, ",", ".")
    t = F.regexp_replace(t, r"(?U)\s*MM\s*$", "")
    t = F.regexp_replace(t, r"(?U)\s*X\s*", "X")
    return F.translate(t, " ", "")


def size_tokens(c) -> Column:
    """Numbers of a normalised size."""
    t = F.regexp_replace(F.lower(text(c)), "^m", "")
    return F.transform(F.regexp_extract_all(t, F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1)), lambda x: x.cast("double"))


def sizes_close(a: Column, b: Column, tolerance: float = 0.02) -> Column:
    """Whether two lists of numbers agree, sorted, each within the tolerance of the larger."""
    pairs = F.zip_with(F.array_sort(a), F.array_sort(b), lambda x, y: F.coalesce(F.abs(x - y) <= tolerance * F.greatest(x, y), F.lit(False)))
    return (F.size(a) == F.size(b)) & (F.size(a) > 0) & F.forall(pairs, lambda ok: ok)


def short_number(x: Column) -> Column:
    """A number as text, without a fraction of zero."""
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def size_key(c) -> Column:
    """Sorted numbers of a size, joined by x; '' without any."""
    return F.array_join(F.transform(F.array_sort(size_tokens(normalize_size(c))), short_number), "x")


def volume_ml(c) -> Column:
    t = text(c)
    ml = group(t, rf"(?iuU){NUMBER}\s*(?:мл|ml)\b", 1)
    litres = group(t, rf"(?iuU){NUMBER}\s*(?:л(?!ента)|литр[а-яё]*|litr[a-z]*)\b", 1)
    return F.coalesce(number(F.nullif(ml, F.lit(""))), number(F.nullif(litres, F.lit(""))) * 1000)


def keywords(c) -> Column:
    """Distinct words of three letters or more, sorted, without stop words."""
    words = F.regexp_extract_all(F.lower(clean_escapes(c)), F.lit("([а-яёa-z]{3,})"), F.lit(1))
    return F.array_sort(F.array_except(words, F.array(*[F.lit(w) for w in V.STOP_WORDS])))


def similarity_text(c) -> Column:
    """The text that similarity is measured on."""
    t = F.translate(F.lower(text(c)), "ёх×*", "еxxx")
    t = F.regexp_replace(t, r"(\d),(\d)", "$1.$2")
    t = F.regexp_replace(t, r"(?U)(\d)\s*мм\.?(?=\s|$)", "$1")
    t = F.translate(t, "-_", "  ")
    t = F.regexp_replace(t, r"(?U)[^а-яa-z0-9\s.x]", " ")
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def char_ngrams(c, n: int = 4) -> Column:
    """Distinct character n-grams, spaces as _; a shorter text is its own n-gram and '' has none."""
    grams = lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - (n - 1), F.lit(1))), lambda i: t.substr(i, F.lit(n)))
    return let(F.translate(_c(c), " ", "_"), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.array_distinct(grams(t))))


def word_tokens(name, item_type=None, size=None, standard=None) -> Column:
    """Words, TYPE:/SIZE:/STD: marks and character triples as one token set."""
    t = F.translate(F.lower(text(name)), "ё", "е")
    t = F.trim(F.regexp_replace(F.regexp_replace(t, r"(?U)[^а-яёa-z0-9\s.x]", " "), r"(?U)\s+", " "))
    words = F.array_except(F.filter(F.split(t, " "), lambda w: F.length(w) >= 2), F.array(*[F.lit(w) for w in V.TOKEN_STOP_WORDS]))
    marks = [F.when(v != "", F.concat(F.lit(m), v)) for m, v in (("TYPE:", clean(item_type) if item_type is not None else F.lit("")), ("SIZE:", normalize_size(size) if size is not None else F.lit("")), ("STD:", F.coalesce(standard_key(standard), F.lit("")) if standard is not None else F.lit("")))]
    return F.array_union(F.array_union(words, F.array_compact(F.array(*marks))), F.transform(char_ngrams(t, 3), lambda g: F.translate(g, "_", " ")))


def name_key(c) -> Column:
    """Name for exact duplicate search: no units, only letters, digits, points and spaces."""
    t = F.translate(F.lower(text(c)), "ёх×*", "еxxx")
    t = F.regexp_replace(t, r"(\d),(\d)", "$1.$2")
    t = F.regexp_replace(t, r"(?iu)(?<![а-яa-z])(?:мм|шт\.?)(?![а-яa-z])", " ")
    t = F.regexp_replace(t, r"(?U)[^а-яa-z0-9\s.]", " ")
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def canonical_key(item_type, standard: Column, size) -> Column:
    """`type=..|std=..|size=..`, without the parts that are empty."""
    parts = [("type=", clean(item_type)), ("std=", text(standard)), ("size=", size_key(size))]
    return F.concat_ws("|", *[F.when(v != "", F.concat(F.lit(k), v)) for k, v in parts])


def fingerprint(fields: dict[str, Column]) -> Column:
    """First 16 hex digits of the sha1 of the fields that are not empty, in fixed order."""
    parts = [(k, clean(fields[k])) for k in V.FINGERPRINT_FIELDS if k in fields]
    return F.substring(F.sha1(F.concat_ws("|", *[F.when(v != "", F.concat(F.lit(f"{k}="), v)) for k, v in parts]).cast("binary")), 1, 16)


def is_kit(c) -> Column:
    t = F.lower(text(c))
    marks = F.lit(False)
    for m in V.KIT_MARKERS:
        marks = marks | t.contains(m)
    return marks | t.rlike(r"(?iuU)[а-яёa-z]\s*\+\s*[а-яёa-z]")


# Standards


def standards(c) -> Column:
    """array<struct<at, key>> of the standards in a text, by place, each key once; an ISO number inside `ГОСТ Р ИСО` counts as ГОСТ."""
    t = text(c)
    gost = rf"(?:ГОСТ|гост|GOST|gost)\s*(?:[Рр]\s*(?:ИСО|исо|ISO)\s*)?({STANDARD_NUMBER})"
    din = rf"[Dd][Ii][Nn]\s*({STANDARD_NUMBER})"
    iso = rf"(?:ISO|iso|ИСО|исо)\s*({STANDARD_NUMBER})"
    # ISO numbers that belong to ГОСТ Р are blanked out, which keeps the places of the others.
    own = F.regexp_replace(t, r"((?:ГОСТ|гост|GOST|gost)\s*[Рр]\s*)(?:ISO|iso|ИСО|исо)", "$1___")

    def found(source, pattern, system):
        full = F.regexp_extract_all(source, F.lit(f"({pattern})"), F.lit(1))
        numbers = F.regexp_extract_all(source, F.lit(pattern), F.lit(1))
        return F.zip_with(full, numbers, lambda whole, n: F.struct(F.concat(F.lit(f"{system}-"), n).alias("key"), whole.alias("whole")))

    hits = F.concat(found(t, gost, "GOST"), found(t, din, "DIN"), found(own, iso, "ISO"))
    placed = F.transform(hits, lambda h: F.struct(F.position(h["whole"], t).alias("at"), h["key"].alias("key")))
    once = lambda ordered, keys: F.filter(ordered, lambda h, i: F.array_position(keys, h["key"]) == i + 1)
    return let(F.array_sort(placed), lambda ordered: let(F.transform(ordered, lambda h: h["key"]), lambda keys: once(ordered, keys)))


def standard_keys(c) -> Column:
    return F.transform(standards(c), lambda h: h["key"])


def standard_key(c) -> Column:
    """Key of the standard a text is, or of the first one in it; null without one."""
    return F.try_element_at(standard_keys(F.trim(text(c))), F.lit(1))


def canonical_standard(c) -> Column:
    """Key by the text's beginning, blanks as dashes; null for another beginning or nothing after it."""
    def key(rest, system):
        return let(rest, lambda r: F.when(r != "", F.concat(F.lit(f"{system}-"), r)))

    def judge(t):
        out = F.lit(None).cast("string")
        for prefix, system in reversed(V.STANDARD_PREFIXES):
            rest = F.regexp_replace(F.regexp_replace(F.trim(t.substr(F.lit(len(prefix) + 1), F.length(t))), r"(?U)\s+", "-"), "^-+|-+$", "")
            out = F.when(F.lower(t).startswith(prefix), key(rest, system)).otherwise(out)
        return out

    return let(F.trim(text(c)), judge)


def display_standard(c) -> Column:
    """`GOST-7798-70` -> `ГОСТ 7798-70`; other keys get a space for their first dash."""
    k = text(c)
    return F.when(k.startswith("GOST-"), F.concat(F.lit("ГОСТ "), k.substr(F.lit(6), F.length(k)))).otherwise(F.regexp_replace(k, "^([^-]*)-", "$1 "))


def standard_kind_code(c) -> Column:
    """struct<kind, code> for a look-up in the standards directory; null if it is none. `ГОСТ Р ИСО n` is an ISO number."""
    t = F.trim(text(c))
    out = F.lit(None).cast("struct<kind:string,code:string>")
    for kind, p in (("ISO", r"^ГОСТ\s+Р\s+ИСО\s+(\S+)$"), ("GOST", r"^ГОСТ\s+(\S+)$"), ("ISO", r"^(?i)ISO\s+(\S+)$"), ("DIN", r"^(?i)DIN\s+(\S+)$")):
        out = F.when(t.rlike(p), F.struct(F.lit(kind).alias("kind"), group(t, p, 1).alias("code"))).otherwise(out)
    return out


def rewrite_standard(c, key: Column, other: Column) -> Column:
    """The text with a standard's display form replaced by that of an analogue."""
    return F.replace(text(c), display_standard(key), display_standard(other))


def render_name(template: str, fields: dict[str, Column]) -> Column:
    """A name from a template of {field}s; {standard} is the first of gost, iso and din; blanks are collapsed."""
    values = {k: text(v) for k, v in fields.items()}
    values["standard"] = first(*[values[k] for k in ("gost", "iso", "din") if k in values])
    parts = re.split(r"(\{\w+\})", template)
    out = F.concat(F.lit(""), *[values.get(p[1:-1], F.lit("")) if re.fullmatch(r"\{\w+\}", p) else F.lit(p) for p in parts if p])
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))
