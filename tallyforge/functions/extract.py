"""Field extraction from item texts: fixed patterns and rule tables compiled into column expressions.

Rules are rows of data. compile_* turns the active ones, in their order, into one expression that
stops at the first match, so a projection over any number of rows needs no join and no UDF.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import text as T
from tallyforge.functions import vocab as V


@dataclass(frozen=True)
class Rule:
    """A detection rule. kind: coating, strength or size; match: contains, exact or regex; template and size_kind serve sizes."""

    id: int
    kind: str
    pattern: str
    match: str
    code: str
    name: str
    priority: int = 0
    active: bool = True
    size_kind: str = "custom"
    template: str = ""


@dataclass(frozen=True)
class ItemType:
    """A product type of the dictionary, with other words for it."""

    name: str
    aliases: tuple[str, ...] = ()
    active: bool = True


@dataclass(frozen=True)
class Dictionary:
    rules: tuple[Rule, ...] = ()
    types: tuple[ItemType, ...] = ()

    def of(self, kind: str) -> list[Rule]:
        return sorted((r for r in self.rules if r.kind == kind and r.active and _valid(r)), key=lambda r: (-r.priority, r.id))


def vocabulary(dictionary: Dictionary) -> list[str]:
    """All names and other words of the active product types, in lower case; what column profiles look for."""
    return sorted({w.lower() for t in dictionary.types if t.active for w in (t.name, *t.aliases)})


MOST_RULES = 10_000


def rules_of(table: DataFrame) -> tuple[Rule, ...]:
    """Rules from a table with the columns of Rule; rule tables are configuration and small, and one of more than MOST_RULES rows is an error."""
    names = Rule.__dataclass_fields__
    rows = table.limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    return tuple(Rule(**{k: r[k] for k in names if k in r and r[k] is not None}) for r in (row.asDict() for row in rows))


_GROUP = re.compile(r"\(\?P<(\w+)>")
_TOKEN = re.compile(r"""
    (?P<escape>\\.) | (?P<cls>\[\^?\]?(?:\\.|[^\]\\])*\]) | \(\?P<(?P<name>\w+)> | \(\?P=(?P<back>\w+)\) | (?P<comment>\(\?\#[^)]*\)) | \(\?(?P<flags>[aiLmsux]+)(?=[):-])
    | \{(?P<least>\d*)(?P<comma>,?)(?P<most>\d*)\} | (?P<brace>\{) | (?P<other>.)
""", re.X | re.S)


def java(pattern: str) -> str:
    """A pattern of Python's syntax in Java's: groups are named g1, g2, ... in their order, comments go, brackets within classes are escaped."""
    named = {n: f"g{i}" for i, n in enumerate(_GROUP.findall(pattern), 1)}

    def put(m: re.Match) -> str:
        if m["name"]:
            return f"(?<{named[m['name']]}>"
        if m["back"]:
            return f"\\k<{named.get(m['back'], m['back'])}>"
        if m["comment"]:
            return ""
        if m["flags"]:
            kept = m["flags"].translate(str.maketrans("", "", "aLu"))
            return f"(?{kept}" if kept or m.string[m.end()] != ")" else "(?:"
        if m["cls"]:
            head = 2 if m["cls"].startswith("[^") else 1
            body = re.sub(r"\\.|\[|\]|&&", lambda x: x[0] if x[0][0] == "\\" else "&\\&" if x[0] == "&&" else "\\" + x[0], m["cls"][head:-1], flags=re.S)
            return m["cls"][:head] + body + "]"
        if m["escape"]:
            return "\\z" if m["escape"] == "\\Z" else m["escape"]
        if m["comma"] is not None:
            least, most = m["least"], m["most"]
            return "{0," + most + "}" if not least and m["comma"] and most else m[0] if least else "\\" + m[0]
        return "\\{" if m["brace"] else m[0]

    return _TOKEN.sub(put, pattern)


def _valid(rule: Rule) -> bool:
    """Whether both Python and, where a session runs, Java read a rule's pattern; one that is none never matches."""
    if rule.match != "regex":
        return True
    try:
        re.compile(rule.pattern)
    except re.error:
        return False
    spark = SparkSession.getActiveSession()
    if spark is None or not hasattr(spark, "_jvm"):
        return True
    own = rule.pattern if rule.kind == "size" else rule.pattern.lower()
    return java_reads("(?U)" + java(own))


@lru_cache(maxsize=20_000)
def java_reads(pattern: str) -> bool:
    """Whether Java takes a pattern."""
    try:
        SparkSession.getActiveSession()._jvm.java.util.regex.Pattern.compile(pattern)
    except IllegalArgumentException:
        return False
    return True


def rule_matches(rule: Rule, t: Column) -> Column:
    """Whether a rule's pattern is in a lower-case text."""
    pattern = rule.pattern.lower()
    if rule.match == "regex":
        return t.rlike("(?U)" + java(pattern))
    if rule.match == "exact":
        return F.array_contains(F.split(t, r"(?U)[\s,;/()]+"), pattern)
    return t.contains(pattern)


def detect(c, rules: list[Rule], value: str = "name") -> Column:
    """Name (or code, or id) of the first rule that matches; '' without one."""
    t = F.lower(T.text(c))
    out = F.lit("")
    for r in reversed(rules):
        out = F.when(rule_matches(r, t), F.lit(str(getattr(r, value)))).otherwise(out)
    return out


def size_text(c) -> Column:
    return F.translate(F.regexp_replace(F.translate(T.text(c), "МмХх×", "Mmxxx"), r"(\d)\*(\d)", "$1x$2"), ",", ".")


_SIZE_GROUPS = ("d", "l", "w", "t", "pitch", "tol")
_SIZE_TYPE = "struct<size_norm:string,diameter:string,length:string,width:string,thickness:string,size_kind:string>"


def detect_size(c, rules: list[Rule]) -> Column:
    """struct<size_norm, diameter, length, width, thickness, size_kind> of the first size rule that matches, else null.

    A rule's named groups fill its template. A diameter gets the template's prefix, or M if it is a
    whole number without a letter.
    """

    def made(rule: Rule, t: Column) -> Column:
        place = re.compile(rule.pattern).groupindex
        p = "(?iu)" + java(rule.pattern)
        got = {g: F.regexp_extract(t, p, place[g]) if g in place else F.lit("") for g in _SIZE_GROUPS}
        raw = F.regexp_extract(t, p, 0)
        norm = raw
        if rule.template:
            parts = re.split(r"(\{\w+\})", rule.template)
            norm = F.concat(F.lit(""), *[got.get(x[1:-1], raw if x == "{raw}" else F.lit("")) if re.fullmatch(r"\{\w+\}", x) else F.lit(x) for x in parts if x])
        d = got["d"]
        if rule.size_kind in ("diameter", "diameter_length", "thread"):
            at = rule.template.find("{d}")
            prefix = rule.template[:at] if at > 0 else ""
            if prefix:
                d = F.when((d != "") & ~F.upper(d).startswith(prefix.upper()), F.concat(F.lit(prefix), d)).otherwise(d)
            else:
                d = F.when((d != "") & ~d.contains(".") & ~F.upper(d).rlike("^[MDØ]"), F.concat(F.lit("M"), d)).otherwise(d)
        return F.struct(norm.alias("size_norm"), d.alias("diameter"), got["l"].alias("length"), got["w"].alias("width"), got["t"].alias("thickness"), F.lit(rule.size_kind).alias("size_kind"))

    def choose(t: Column) -> Column:
        out = F.lit(None).cast(_SIZE_TYPE)
        for r in reversed(rules):
            if r.match == "regex":
                hit, value = t.rlike("(?iu)" + java(r.pattern)), made(r, t)
            else:
                low = F.lower(t)
                hit = rule_matches(r, low)
                raw = F.lit(r.pattern.lower())
                value = F.struct(raw.alias("size_norm"), F.lit("").alias("diameter"), F.lit("").alias("length"), F.lit("").alias("width"), F.lit("").alias("thickness"), F.lit(r.size_kind).alias("size_kind"))
            out = F.when(hit, value).otherwise(out)
        return out

    return T.let(size_text(c), choose)


_TAILS = "|".join(V.STRENGTH_TAILS)


# The patterns of standards, coatings, strengths and coded names in the extractors below.


def strip_strength(c: Column) -> Column:
    """Without a strength code at the end: `M20x45.58` -> `M20x45`."""
    return F.regexp_replace(c, rf"\.({_TAILS})(?!\d)$", "")


def with_metric_prefix(c: Column) -> Column:
    """M before a bare `NxL` of whole numbers."""
    return F.when(c.rlike(r"(?i)^\d+x\d"), F.concat(F.lit("M"), c)).otherwise(c)


def sizes(c, dictionary: Dictionary) -> Column:
    """struct<diameter, length, width, thickness, size>: by rules, else by fixed patterns."""
    def fixed(t):
        bare = T.group(t, r"(?<!\d[.,])(?<!\d)(\d{1,2})x\d{1,4}(?!\.\d)", 1)
        whole = F.regexp_replace(T.group(t, r"(?<!\d[.,])(?<!\d)(\d{1,3}x\d{1,4})(?!\.\d)", 1), "^(.)", "M$1")
        screw = T.group(t, r"(\d+\.\d+)x\d+", 1)

        def made(metric, d, length):
            size = F.when((d != "") & (length != ""), F.concat(d, F.lit("x"), length)).when((metric == "") & (length != "") & (screw != ""), F.concat(screw, F.lit("x"), length)).otherwise(whole)
            return F.struct(d.alias("diameter"), length.alias("length"), size.alias("size"))

        with_length = lambda m, d: T.let(T.group(t, r"x(\d+)", 1), lambda length: made(m, d, length))
        with_diameter = lambda m: T.let(T.first(m, bare), lambda d: T.let(F.when(d != "", F.concat(F.lit("M"), d)).otherwise(""), lambda d: with_length(m, d)))
        return T.let(T.group(t, r"(?<![a-z.])m\s*(\d{1,2})(?!\d)", 1), with_diameter)

    def join(ruled, length, plain):
        return F.struct(
            T.first(ruled["diameter"], plain["diameter"]).alias("diameter"), T.first(length, plain["length"]).alias("length"),
            T.first(ruled["width"]).alias("width"), T.first(ruled["thickness"]).alias("thickness"),
            F.when(ruled.isNotNull(), strip_strength(with_metric_prefix(ruled["size_norm"]))).otherwise(plain["size"]).alias("size"),
        )

    # The fixed patterns are searched only where rules leave something open.
    def ruled_first(ruled, length):
        known = (ruled["diameter"] != "") & (length != "")
        return T.let(F.when(~F.coalesce(known, F.lit(False)), T.let(T.extraction_text(c), fixed)), lambda plain: join(ruled, length, plain))

    return T.let(detect_size(c, dictionary.of("size")), lambda ruled: T.let(strip_strength(ruled["length"]), lambda length: ruled_first(ruled, length)))


def screw_diameter(c) -> Column:
    """Decimal diameter of `4.2x16`, unless the text has a metric one."""
    t = T.extraction_text(c)
    return F.when(t.rlike(r"(?<![a-z.])m\s*\d{1,2}(?!\d)"), "").otherwise(T.group(t, r"(\d+\.\d+)x\d+", 1))


def thread_type(c, dictionary: Dictionary) -> Column:
    return F.when(sizes(c, dictionary)["diameter"] != "", "метрическая").when(screw_diameter(c) != "", "саморез").otherwise("")


def _coded(t: Column, n: int) -> Column:
    return T.group(t, r"(?<![a-z])m\d{1,2}(?:x\d+)?\.(\d{1,3})\.(\d{3})(?!\d)", n)


def strength(c, dictionary: Dictionary) -> Column:
    """Strength class: rules, `8.8`, `8 8`, a code at the end of a size, a coded name."""
    def fixed(t):
        spaced = F.when(t.rlike(r"(?U)\b12\s+9\b"), "12.9").when(t.rlike(r"(?U)\b10\s+9\b"), "10.9").when(t.rlike(r"(?U)\b8\s+8\b"), "8.8").otherwise("")
        tail = F.coalesce(T.lookup(V.STRENGTH_TAILS, T.group(t, rf"\.({_TAILS})(?!\d)", 1)), F.lit(""))
        coded = F.coalesce(T.lookup({**V.STRENGTH_TAILS, **V.CODED_STRENGTHS}, _coded(t, 1)), F.lit(""))
        return T.first(T.group(t, r"(?<!\d)(8\.8|10\.9|12\.9)(?!\d)", 1), spaced, tail, coded)

    return T.first(detect(c, dictionary.of("strength")), T.let(T.extraction_text(c), fixed))


def coating(c, dictionary: Dictionary) -> Column:
    """Coating: rules, then words, then codes."""
    def fixed(t):
        words = (
            F.when(t.rlike(r"нерж|(?<![a-zа-яё0-9])[aа][24](?![a-zа-яё0-9])"), "нержавейка").when(t.rlike(r"(?U)оцинк|оц(?:\b|\.)|(?<![a-zа-яё])цинк"), "цинк")
            .when(t.contains("латун"), "латунь").when(t.contains("фосфат"), "фосфат").when(t.rlike(r"(?<![a-zа-яё])черн|оксид|ворон"), "оксид").when(t.rlike(r"\.016(?!\d)"), "цинк").otherwise("")
        )
        return T.first(words, F.coalesce(T.lookup(V.CODED_COATINGS, _coded(t, 2)), F.lit("")))

    return T.first(detect(c, dictionary.of("coating")), T.let(T.extraction_text(c), fixed))


def gost(c) -> Column:
    """ГОСТ with Р and ИСО as written; a bare `7798-70` counts if no DIN or ISO number is there."""
    p = r"(?:гост|gost)\s*(р\s*)?(?:(исо|iso)\s*)?(\d+[-.]?\d*)"

    def pick(t):
        n = T.group(t, p, 3)
        kind = F.when((T.group(t, p, 1) != "") & (T.group(t, p, 2) != ""), "ГОСТ Р ИСО ").when(T.group(t, p, 1) != "", "ГОСТ Р ").otherwise("ГОСТ ")
        bare = F.when(~t.rlike(r"(?:din|iso|исо)\s*\d"), T.group(t, r"(?<!\d)(\d{4,5}-\d{2})(?!\d)", 1)).otherwise("")
        return F.when(n != "", F.concat(kind, n)).when(bare != "", F.concat(F.lit("ГОСТ "), bare)).otherwise("")

    return T.let(T.extraction_text(c), pick)


def iso(c) -> Column:
    def pick(t):
        within = lambda n: F.regexp_like(t, F.concat(F.lit(r"(?:гост|gost)\s*(?:р\s*)?(?:исо|iso)\s*"), n))
        return T.let(T.group(t, r"(?:iso|исо)\s*(\d+)", 1), lambda n: F.when((n == "") | within(n), "").otherwise(F.concat(F.lit("ISO "), n)))

    return T.let(T.extraction_text(c), pick)


def din(c) -> Column:
    return T.let(T.group(T.extraction_text(c), r"din\s*(\d+)", 1), lambda n: F.when(n != "", F.concat(F.lit("DIN "), n)).otherwise(""))


def tail_code(c) -> Column:
    return T.group(T.text(c), r"\.\d{2,3}\.\d{2,3}", 0)


def wrench_size(c) -> Column:
    return T.group(T.extraction_text(c), r"(?<![a-z])s(\d{1,3})(?!\d)", 1)


def item_type(c, dictionary: Dictionary) -> Column:
    """Dictionary words whole, then as parts, in the dictionary's order; then fixed stems."""
    low = F.lower(T.text(c))
    terms = [(t.name, w.lower()) for t in dictionary.types if t.active for w in (t.name, *t.aliases)]
    whole, part = F.lit(""), F.lit("")
    for name, word in reversed(terms):
        whole = F.when(low.rlike(rf"(?U)\b{re.escape(word)}\b"), F.lit(name)).otherwise(whole)
        part = F.when(low.contains(word), F.lit(name)).otherwise(part)
    stems, t = F.lit(""), T.extraction_text(c)
    for stem, name in reversed(V.TYPE_STEMS):
        stems = F.when(t.contains(stem), F.lit(name)).otherwise(stems)
    return T.first(whole, part, stems)


def column_strength(c, dictionary: Dictionary) -> Column:
    """Strength from a column of its own, where 8, 10 and 12 stand for 8.8, 10.9 and 12.9."""
    t = T.extraction_text(c)
    short = F.when(t.isin("8", "8.0"), "8.8").when(t.isin("10", "10.0"), "10.9").when(t.isin("12", "12.0"), "12.9").otherwise("")
    return T.first(T.group(t, r"(?<!\d)(8\.8|10\.9|12\.9)(?!\d)", 1), short, strength(c, dictionary))


def column_standard(c) -> Column:
    """struct<gost, iso, din> from a column of its own; a bare number is a ГОСТ."""
    g, i, d, t = gost(c), iso(c), din(c), T.extraction_text(c)
    bare = (g == "") & (i == "") & (d == "") & t.rlike(r"^\d+[-.]?\d*$")
    return F.struct(F.when(bare, F.concat(F.lit("ГОСТ "), t)).otherwise(g).alias("gost"), i.alias("iso"), d.alias("din"))


def row_features(df: DataFrame, name: str = "name") -> DataFrame:
    """df with `features`: item type, size as written and as numbers, the first ten keywords and the volume of each row."""
    size = T.clean("size")
    return df.withColumn("features", F.struct(
        T.clean("item_type").alias("item_type"), size.alias("size_raw"), T.size_tokens(T.normalize_size(size)).alias("size_tokens"),
        F.slice(T.keywords(name), 1, 10).alias("keywords"), T.volume_ml(name).alias("volume_ml"),
    ))


FIELDS = ("diameter", "length", "width", "thickness", "size", "strength", "coating", "gost", "iso", "din", "tail_code", "wrench_size", "screw_diameter", "thread_type", "item_type")


def extractor(name: str, c, dictionary: Dictionary) -> Column:
    """Expression for one field of FIELDS."""
    if name in ("diameter", "length", "width", "thickness", "size"):
        return sizes(c, dictionary)[name]
    plain = {"gost": gost, "iso": iso, "din": din, "tail_code": tail_code, "wrench_size": wrench_size, "screw_diameter": screw_diameter}
    ruled = {"strength": strength, "coating": coating, "thread_type": thread_type, "item_type": item_type}
    return plain[name](c) if name in plain else ruled[name](c, dictionary)


SIZE_FIELDS = ("diameter", "length", "width", "thickness", "size")


def with_fields(df: DataFrame, text: str, dictionary: Dictionary) -> DataFrame:
    """df with all FIELDS; the five size fields come from one search of the text."""
    out = df.withColumn("__sizes", sizes(text, dictionary))
    plain = {f: extractor(f, text, dictionary) for f in FIELDS if f not in SIZE_FIELDS and f != "thread_type"}
    thread = F.when(F.col("__sizes.diameter") != "", "метрическая").when(screw_diameter(text) != "", "саморез").otherwise("")
    return out.withColumns({**{f: F.col(f"__sizes.{f}") for f in SIZE_FIELDS}, **plain, "thread_type": thread}).drop("__sizes")


def confidence(fields: dict[str, Column]) -> Column:
    """0 to 5: diameter, length, strength, coating, and ГОСТ or DIN."""
    known = [fields[k] != "" for k in ("diameter", "length", "strength", "coating")] + [(fields["gost"] != "") | (fields["din"] != "")]
    return sum((k.cast("int") for k in known[1:]), known[0].cast("int"))


def confidence_status(score: Column) -> Column:
    return F.when(score >= 4, "ok").when(score >= 2, "review").otherwise("manual")


def transform(df: DataFrame, fields: list[str], dictionary: Dictionary, text: str = "raw_text") -> DataFrame:
    """df with the chosen fields, confidence and status.

    A field takes what its own column says (strength_raw, standard_raw) only where the text says
    nothing, and the note last. Unknown field names are left out. Catalyst computes only what is read.
    """
    base = with_fields(df, text, dictionary)
    have = set(df.columns)
    filled = {}
    for f in ("strength", "gost", "iso", "din"):
        more = []
        if f == "strength" and "strength_raw" in have:
            more.append(column_strength("strength_raw", dictionary))
        if f != "strength" and "standard_raw" in have:
            more.append(column_standard("standard_raw")[f])
        if "note_raw" in have:
            more.append(extractor(f, "note_raw", dictionary))
        filled[f] = T.first(F.col(f), *more)
    score = confidence({f: F.col(f) for f in FIELDS})
    merged = base.withColumn("confidence", score).withColumn("status", confidence_status(F.col("confidence"))).withColumns(filled)
    return merged.select(*df.columns, *[f for f in fields if f in FIELDS], "confidence", "status")


def line_record(df: DataFrame, dictionary: Dictionary, text: str = "raw_text") -> DataFrame:
    """df with all fields of a line and its normal forms: type_norm, size_norm, std_norm, tokens_norm."""
    out = with_fields(df, text, dictionary)
    return out.withColumns({
        "type_norm": T.clean("item_type"), "size_norm": T.normalize_size("size"),
        "std_norm": F.coalesce(T.canonical_standard(T.first(F.col("gost"), F.col("iso"), F.col("din"))), F.lit("")), "tokens_norm": T.similarity_text(text),
    })


def of_texts(df: DataFrame, text: str, add) -> DataFrame:
    """df with the columns that add() gives a table of its different texts: what is costly is done once a text, however many rows have it.

    add() gets one column, `text`, and returns it with its own. Rows without a text are kept.
    """
    made = add(df.select(text).distinct())
    own = [c for c in made.columns if c != text]
    made = made.withColumnRenamed(text, "__text")
    return df.join(made, F.col(text).eqNullSafe(F.col("__text"))).select(*df.columns, *own)


# The signs of an item in a quote's line.


def classify_line(c) -> Column:
    """Class of a quote's line: item, header, total, requisites or garbage; a line with signs of an item is an item."""
    def judge(t):
        low = F.lower(t)
        words = F.size(F.filter(F.split(t, r"(?U)\s+"), lambda w: w != ""))
        names = "|".join(sorted(map(re.escape, V.ITEM_WORDS), key=len, reverse=True))
        item = (
            t.rlike(r"(?iuU)(?:^|\s|/)(?:[Mm][Мм]?\s*\d+|\d+(?:[.,]\d+)?[xх×]\d+|[dDдД]\s*\d+|\d+\s*мм)")
            | t.rlike(r"(?iuU)\b(?:DIN|ГОСТ\s*Р?\s*(?:ИСО)?|GOST|ISO|EN\s*\d|ТУ)\s*[\-\s]?\d") | t.rlike(rf"(?iuU)\b({names})\b")
        )
        has = lambda ws: low.rlike("|".join(map(re.escape, ws)))
        headers = sum((low.contains(w).cast("int") for w in V.HEADER_WORDS[1:]), low.contains(V.HEADER_WORDS[0]).cast("int"))
        return (
            F.when(t == "", "garbage").when(item, "item").when(words <= 1, "garbage").when(has(V.TOTAL_WORDS), "total").when(headers >= 3, "header")
            .when(has(V.REQUISITE_WORDS), "requisites").when(has(V.DATE_WORDS), "requisites").when(has(V.TAX_WORDS), "total").when(words <= 2, "garbage").otherwise("item")
        )

    return T.let(F.trim(T.text(c)), judge)


def parse_names(df: DataFrame, dictionary: Dictionary, name: str = "name", position: str = "pos") -> DataFrame:
    """Fields of catalogue names, each distinct name (whatever its case) once, at its first position; empty names go."""
    from pyspark.sql import Window

    first = F.row_number().over(Window.partitionBy(T.clean(name)).orderBy(position))
    return line_record(df.where(T.clean(name) != "").withColumn("__n", first).where("__n = 1").drop("__n"), dictionary, name)
