"""Queries of scalar functions and extractors over texts that are made from the parts table.

Each text has one of several shapes, by the part's key; the SQL says what each shape is to give.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import extract as X
from tallyforge.functions import seeds
from tallyforge.functions import text as T
from tallyforge.functions import vocab as V
from tallyforge.plans.base import register, table
from tallyforge.sources import readers, sinks

QUERIES, ORACLES = {}, {}
query = register(QUERIES, ORACLES)


def case(*options: str, key: str = "p_partkey") -> str:
    """The option of a key's remainder, in SQL that both engines read."""
    return f"CASE {key} % {len(options)} " + " ".join(f"WHEN {i} THEN {o}" for i, o in enumerate(options)) + " END"


def shapes(spark, d, *options: str):
    """p_partkey, p_name and a text of one of the shapes."""
    return table(spark, d, "part").select("p_partkey", "p_name", F.expr(case(*options)).alias("t"))


_TAILS = ["p_name || ' 2 тыс. шт'", "p_name || '  5 кг.'", "p_name || ' 7,5 м'", "p_name || ' 12 foo'", "p_name", "p_name || ' 3 тыс. foo'", "p_name || ' 4pcs'"]


@query(f"""SELECT p_partkey, {case("p_name", "p_name", "p_name", "p_name || ' 12 foo'", "p_name", "p_name || ' 3 тыс. foo'", "p_name")} AS clean,
  {case("2000.0", "5.0", "7.5", "NULL", "NULL", "NULL", "4.0")}::DOUBLE AS qty, {case("'шт'", "'кг'", "'м'", "NULL", "NULL", "NULL", "'шт'")} AS uom,
  {case("1000", "1", "1", "1", "1", "1", "1")}::BIGINT AS multiplier, {case("'2 тыс. шт'", "'5 кг.'", "'7,5 м'", "'12 foo'", "NULL", "'3 тыс. foo'", "'4pcs'")} AS expr,
  {case("NULL", "NULL", "NULL", f"'{V.UNKNOWN_UNIT}'", "NULL", f"'{V.UNKNOWN_UNIT}'", "NULL")} AS reason FROM part""")
def tail_quantity(spark, d):
    return shapes(spark, d, *_TAILS).select("p_partkey", T.tail_quantity("t").alias("x")).select("p_partkey", "x.clean", "x.qty", "x.uom", F.col("x.multiplier").cast("long").alias("multiplier"), "x.expr", "x.reason")


@query(f"""SELECT p_partkey, {case("10.0", "5.0", "NULL", "2.5", "1.0")}::DOUBLE AS qty, {case("'шт'", "'кг'", "NULL", "'л'", "'компл'")} AS uom,
  {case("p_name || ' red'", "p_name", "p_name", "p_name || ' , x'", "p_name || ' tail'")} AS rest FROM part""")
def quantity_anywhere(spark, d):
    """The first number with a unit, wherever it is, and the text without it and its brackets."""
    t = shapes(spark, d, "p_name || ' (10 шт) red'", "'5 кг ' || p_name", "p_name", "p_name || ' 2,5 л, x'", "p_name || ' 1 комплект tail'")
    return t.select("p_partkey", T.parse_qty_uom("t").alias("x")).select("p_partkey", "x.*")


@query(f"""SELECT p_partkey, {case("10.0", "3.0", "NULL", "NULL", "2.5")}::DOUBLE AS qty, {case("'шт'", "'м²'", "NULL", "NULL", "'кг'")} AS uom,
  {case("p_name", "p_name", "p_name || ' 5 кг red'", "p_name", "p_name")} AS rest FROM part""")
def quantity_suffix(spark, d):
    t = shapes(spark, d, "p_name || ' (10 шт.)'", "p_name || ' 3 кв.м'", "p_name || ' 5 кг red'", "p_name", "p_name || ' 2,5кг '")
    return t.select("p_partkey", T.qty_uom_suffix("t").alias("x")).select("p_partkey", "x.*")


@query(f"""SELECT p_partkey, {case("p_name", "p_name", "p_name", "p_name")} AS clean, {case("NULL", "'under order'", "'order'", "'Asap!'")} AS phrase FROM part""")
def tail_phrase(spark, d):
    t = shapes(spark, d, "p_name", "p_name || ' UNDER Order '", "p_name || ' order'", "p_name || ' asap!'")
    return t.select("p_partkey", T.strip_tail_phrase("t", ["order", "under order", "Asap!", " "]).alias("x")).select("p_partkey", "x.*")


@query(f"""SELECT p_partkey, {case("p_name", "p_name", "p_name", "p_name", "p_name", "p_name || ' 7 foo'", "p_name", "p_name")} AS name,
  {case("1200.0", "3.0", "4.0", "6.0", "8.0", "NULL", "9.0", "NULL")}::DOUBLE AS qty, {case("NULL", "'кг'", "'шт'", "'м'", "'шт'", "NULL", "'л'", "NULL")} AS uom,
  {case(*(f"'{s}'" for s in (V.NOT_FOUND, V.FROM_UNIT_COLUMN, V.FROM_COLUMN, V.FROM_HEADER, V.FROM_NAME, V.NOT_FOUND, V.FROM_UNIT_COLUMN, V.NOT_FOUND)))} AS source,
  {case("false", "false", "false", "false", "false", "true", "false", "false")} AS failed, {case("NULL", "NULL", "NULL", "NULL", "NULL", "NULL", "NULL", "'in stock'")} AS cut FROM part""")
def row_quantity(spark, d):
    """Quantity and unit of a row from its cells, its header or its name."""
    t = table(spark, d, "part").select("p_partkey", *[F.expr(case(*o)).alias(c) for c, o in {
        "n": ["p_name", "p_name", "p_name", "p_name", "p_name || ' 8 шт'", "p_name || ' 7 foo'", "p_name || ' 5 шт'", "p_name || ' in stock'"], "q": ["'1 200'", "'3'", "'4 шт'", "'6'", "''", "''", "'9'", "''"],
        "u": ["''", "'Кг.'", "''", "''", "'кг'", "'кг'", "'литр'", "''"], "h": ["''", "''", "''", "'м'", "''", "''", "''", "'кг'"]}.items()])
    p = t.select("p_partkey", T.preprocess_row("n", "q", "u", "h", ["in stock"]).alias("p"))
    # A name's own quantity stays in the name where the cells have one.
    name = F.when(F.col("p_partkey") % 8 == 6, F.regexp_replace("p.cleaned_name", " 5 шт$", "")).otherwise(F.col("p.cleaned_name"))
    return p.select("p_partkey", name.alias("name"), "p.qty", "p.uom", "p.source", F.col("p.fail_reason").isNotNull().alias("failed"), F.col("p.tail_phrase_cut").alias("cut"))


_CELLS = {
    "thous_in_uom": ("''", "p_size || ' тыс. шт'", "''", "p_size * 1000.0", "'шт'"), "thous_mult": ("p_size || ''", "'тыс. шт'", "''", "p_size * 1000.0", "'шт'"), "thous_in_qty": ("p_size || ' тыс. кг'", "''", "''", "p_size * 1000.0", "'кг'"),
    "uom_before_qty": ("''", "'шт ' || p_size", "''", "p_size", "'шт'"), "direct": ("p_size || ',5'", "'КГ.'", "''", "p_size + 0.5", "'кг'"), "ocr_junk_uom": ("p_size || ''", "'N шт'", "''", "p_size", "'шт'"),
    "num_uom_in_uom_col": ("''", "p_size || ' м'", "''", "p_size", "'м'"), "split_qty_col": ("p_size || ' рулонов'", "''", "''", "p_size", "'рул'"), "header_hint": ("p_size || ''", "''", "'Кол-во, шт'", "p_size", "'шт'"), "not_found": ("'много'", "'?'", "''", "NULL", "NULL"),
}


@query(f"""SELECT p_partkey, {case(*(c[3] for c in _CELLS.values()))}::DOUBLE AS qty, {case(*(c[4] for c in _CELLS.values()))} AS uom, {case(*(f"'{k}'" for k in _CELLS))} AS source FROM part""")
def cell_quantity(spark, d):
    """Quantity and unit of recognised cells, in all the ways they get mixed up."""
    cells = [F.expr(case(*(c[i] for c in _CELLS.values()))).alias(n) for i, n in enumerate(("q", "u", "h"))]
    x = table(spark, d, "part").select("p_partkey", *cells).select("p_partkey", readers.cell_quantity(F.col("q"), F.col("u"), F.col("h")).alias("x"))
    return x.select("p_partkey", "x.*")


@query(f"""SELECT p_partkey, {case("p_name", "p_name", "p_name || ' - 12'", "p_name || '-' || p_size", "p_name")} AS name, {case("5.0", "12000.0", "NULL", "2.0", "NULL")}::DOUBLE AS qty, {case("'шт'", "'кг'", "NULL", "'м'", "NULL")} AS uom, {case("'5 1200x'", "'12000'", "'1 20'", "'1000000'", "'1x 000'")} AS joined FROM part""")
def dash_quantity(spark, d):
    """`name - N unit`, and numbers with spaces between thousands."""
    t = shapes(spark, d, "p_name || ' - 5 шт'", "p_name || '—12 000 кг'", "p_name || ' - 12'", "p_name || '-' || p_size || ' — 2 м'", "p_name")
    joined = T.join_thousands(F.expr(case("'5 1200x'", "'12 000'", "'1 20'", "'1 000 000'", "'1x 000'")))
    return t.select("p_partkey", T.dash_quantity("t").alias("x"), joined.alias("joined")).select("p_partkey", "x.*", "joined")


@query(f"""SELECT p_partkey, {case("'12'", "'0.5'", "'1.235'", "'100'", "'0'", "''")} AS shown FROM part""")
def quantity_shown(spark, d):
    return table(spark, d, "part").select("p_partkey", T.format_qty(F.expr(case("12.0D", "0.5D", "1.23456D", "100.000D", "0.0D", "CAST(NULL AS DOUBLE)"))).alias("shown"))


@query(f"""SELECT p_partkey, {case("p_size", "p_size * 1000", "2500", "NULL", "750", "NULL")}::DOUBLE AS ml FROM part""")
def volumes(spark, d):
    """Millilitres, or else litres times 1000."""
    t = shapes(spark, d, "p_name || ' ' || p_size || ' мл'", "p_name || ' ' || p_size || 'л'", "p_name || ' 2,5 литра'", "p_name || ' 3 лента'", "p_name || ' 750ml 2 л'", "p_name")
    return t.select("p_partkey", T.volume_ml("t").alias("ml"))


@query(f"""SELECT p_partkey, {case("p_name || ' x'", "p_name", "'a b'", "p_name")} AS clean, {case("p_name || '_x000d_x'", "'м ' || p_name || ' m8x20'", "'a b'", "p_name || ' 2x3.5'")} AS prepared FROM part""")
def escapes_and_preparation(spark, d):
    """Escapes of workbooks removed, and texts prepared for extraction."""
    t = shapes(spark, d, "p_name || '_x000D_x'", "p_name || CHR(1)", "'a    b'", "' ' || p_name || ' '")
    other = F.expr(case("p_name || '_x000D_x'", "'М ' || p_name || ' М8х20'", "'A  b '", "p_name || ' 2*3,5'"))
    return t.select("p_partkey", T.clean_escapes("t").alias("clean"), T.extraction_text(other).alias("prepared"))


_GRAMS = "list_distinct(list_transform(generate_series(1, greatest(length({t}) - {k}, 1)), lambda i: substr({t}, i, {k} + 1)))"


@query(f"""WITH p AS (SELECT p_partkey, lower(p_name) AS t, split_part(p_name, ' ', 2) AS ty, 'M' || p_size || 'X20' AS z, 'DIN-' || (931 + p_partkey % 4) AS s FROM part)
SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(list_concat(string_split(t, ' '), ['TYPE:' || ty, 'SIZE:' || z, 'STD:' || s]), {_GRAMS.format(t='t', k=2)}))), '|') AS tokens FROM p""")
def word_tokens(spark, d):
    """Words, marks and triples of characters as one set."""
    p = table(spark, d, "part")
    tokens = T.word_tokens("p_name", F.get(F.split("p_name", " "), F.lit(1)), F.concat(F.lit("М"), F.col("p_size").cast("string"), F.lit(" х 20")), F.concat(F.lit("DIN "), (F.col("p_partkey") % 4 + 931).cast("string")))
    return p.select("p_partkey", F.array_join(F.array_sort(tokens), "|").alias("tokens"))


@query(f"""WITH p AS (SELECT p_partkey, replace(p_name || CASE WHEN p_partkey % 3 = 0 THEN ' din ' || (931 + p_partkey % 4) ELSE '' END || CASE WHEN p_partkey % 5 = 0 THEN ' special' ELSE '' END
    || CASE WHEN p_partkey % 3 <> 0 THEN ' din ' || (931 + p_partkey % 4) ELSE '' END, ' ', '_') AS t, split_part(p_name, ' ', 2) AS ty, 'M' || p_size || 'X20' AS z, 'DIN-' || (931 + p_partkey % 4) AS s FROM part)
SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat({_GRAMS.format(t='t', k=3)}, ['TYPE:' || CASE WHEN p_partkey % 5 = 0 THEN 'special' ELSE ty END, 'SIZE:' || z, 'STD:' || lower(s)]))), '|') AS tokens FROM p""")
def item_tokens(spark, d):
    """Character n-grams of a name, with the type and the standard it lacks, and marks."""
    from tallyforge.operators import similarity as S

    k = F.col("p_partkey")
    std = (k % 4 + 931).cast("string")
    name = F.concat("p_name", F.when(k % 3 == 0, F.concat(F.lit(" DIN-"), std)).otherwise(""))
    kind = F.when(k % 5 == 0, "Special").otherwise(F.get(F.split("p_name", " "), F.lit(1)))
    tokens = S.item_tokens(name, kind, F.concat(F.lit("M"), F.col("p_size").cast("string"), F.lit("x20")), F.lower(F.concat(F.lit("DIN-"), std)))
    return table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(tokens), "|").alias("tokens"))


_STANDARDS = {"'ГОСТ 7798-70'": ("GOST-7798-70", "GOST", "7798-70"), "'din  933'": ("DIN-933", "DIN", "933"), "'ISO 4017'": ("ISO-4017", "ISO", "4017"), "'ГОСТ Р ИСО 4014'": ("GOST-ИСО-4014", "ISO", "4014"), "'ТУ 14-4'": (None, None, None), "'DIN'": (None, None, None)}
_said = lambda i: case(*("NULL" if x[i] is None else f"'{x[i]}'" for x in _STANDARDS.values()))


@query(f"""SELECT p_partkey, {_said(0)} AS canonical, {_said(1)} AS kind, {_said(2)} AS code, {case("'ГОСТ ' || p_size", "'DIN ' || p_size || '-7'", "'X'")} AS shown,
  {case("p_name || ' ISO 4017 x'", "p_name || ' DIN 931'", "p_name")} AS rewritten FROM part""")
def standard_forms(spark, d):
    """Canonical and display forms, kind and code of standards, and texts with an analogue's in its place."""
    t = shapes(spark, d, *_STANDARDS)
    t = t.join(table(spark, d, "part").select("p_partkey", F.expr(case("'GOST-' || p_size", "'DIN-' || p_size || '-7'", "'X'")).alias("k"), F.expr(case("p_name || ' DIN 933 x'", "p_name || ' DIN 933'", "p_name")).alias("raw"), F.expr(case("'ISO-4017'", "'DIN-931'", "'DIN-931'")).alias("other")), "p_partkey")
    both = T.standard_kind_code(F.col("t"))
    return t.select("p_partkey", T.canonical_standard("t").alias("canonical"), both["kind"].alias("kind"), both["code"].alias("code"), T.display_standard("k").alias("shown"), T.rewrite_standard("raw", F.lit("DIN-933"), F.col("other")).alias("rewritten"))


@query(f"""SELECT p_partkey, {case("true", "true", "false", "false", "true")} AS kit, {case("p_name || ' note'", "p_name || ' x'", "p_name", "p_name || ' 1 2'", "p_name")} AS joined FROM part""")
def kits_and_joined_cells(spark, d):
    t = shapes(spark, d, "'Комплект ' || p_name", "p_name || ' + nut'", "p_name || ' 5+6'", "p_name", "p_name || ' в сборе'")
    cells = [F.expr(case(*o)).alias(c) for c, o in {"a": ["p_name"] * 5, "b": ["' note '", "'x'", "''", "'1'", "NULL"], "c": ["''", "NULL", "' '", "'2'", "''"]}.items()]
    return t.select("p_partkey", "p_name", T.is_kit("t").alias("kit")).select("p_partkey", "kit", *cells).select("p_partkey", "kit", T.joined_cells("a", "b", "c").alias("joined"))


# Texts of goods in the default dictionary's language, one shape after the other: the text, then what its fields are to be.
_GOODS = [
    ("'Болт М' || p_size || 'х45 ГОСТ 7798-70 кл. пр. 8.8 цинк'", {"item_type": "болт", "diameter": "M#", "length": "45", "size": "M#x45", "strength": "8.8", "coating": "цинк", "gost": "ГОСТ 7798-70", "thread_type": "метрическая"}),
    ("'Диск ' || (p_size + 100) || 'x1.6x22.2 мм'", {"item_type": "диск", "diameter": "^", "length": "1", "width": "22.2", "thickness": "1.6", "size": "M^x1.6x22.2", "screw_diameter": "1.6", "thread_type": "метрическая"}),
    ("'Саморез 4.2x' || p_size || ' DIN 7982'", {"item_type": "саморез", "diameter": "4.2", "length": "#", "size": "4.2x#", "screw_diameter": "4.2", "din": "DIN 7982", "thread_type": "метрическая"}),
    ("'Гайка М' || p_size || ' ГОСТ Р ИСО 4032 A2-70'", {"item_type": "гайка", "diameter": "M#", "size": "M#", "strength": "A2-70", "coating": "нержавейка", "gost": "ГОСТ Р ИСО 4032", "thread_type": "метрическая"}),
    ("'Шайба ' || p_size || ' ISO 7089 черн.'", {"item_type": "шайба", "coating": "без покрытия", "iso": "ISO 7089"}),
    ("'Болт ГОСТ Р 7796 М' || p_size || 'х50.58.016 S27'", {"item_type": "болт", "diameter": "M#", "length": "50", "size": "M#x50", "strength": "5.8", "coating": "цинк", "gost": "ГОСТ Р 7796", "tail_code": ".58.016", "wrench_size": "27", "thread_type": "метрическая"}),
    ("'Винт 7798-70 латунь'", {"item_type": "винт", "coating": "латунь", "gost": "ГОСТ 7798-70"}),
    ("'Анкер М' || p_size || '.88 оксид'", {"item_type": "анкер", "diameter": "M#", "strength": "8.8", "coating": "оксид", "thread_type": "метрическая"}),
    ("'Шпилька м' || p_size || '-6g класс прочности 10,9'", {"item_type": "шпилька", "diameter": "M#", "size": "M#-6g", "strength": "10.9", "thread_type": "метрическая"}),
]
_FIELDS = ["item_type", "diameter", "length", "width", "thickness", "size", "strength", "coating", "gost", "iso", "din", "tail_code", "wrench_size", "screw_diameter", "thread_type"]


def _expected(field: str) -> str:
    """The field of each shape in SQL; # is the part's size and ^ that with 100 added."""
    said = lambda v: "replace(replace('" + v + "', '#', p_size::VARCHAR), '^', (p_size + 100)::VARCHAR)"
    return case(*(said(want.get(field, "")) for _, want in _GOODS))


@query(f"""SELECT p_partkey, {', '.join(f'{_expected(f)} AS {f}' for f in _FIELDS)} FROM part""")
def goods_fields(spark, d):
    """Every field of texts of goods by the default rules: sizes of three numbers, screws, standards in all forms, codes."""
    t = shapes(spark, d, *(g for g, _ in _GOODS))
    return X.with_fields(t, "t", seeds.default_dictionary()).select("p_partkey", *_FIELDS)


@query(f"""SELECT p_partkey, {case("'12.9'", "'8.8'", "'10.9'", "'8.8'", "''")} AS strength, {case("'ГОСТ 7798'", "''", "''", "'ГОСТ 125'", "''")} AS gost, {case("''", "'ISO 4017'", "''", "''", "''")} AS iso, {case("''", "''", "'DIN 933'", "''", "''")} AS din,
  {case("'M20x45'", "'M20x45'", "'4.2x16'", "'M12x80'", "'20'")} AS size FROM part""")
def raw_columns(spark, d):
    """Strengths and standards from columns of their own, and sizes without strength codes and with their M."""
    cells = {"s": ["'12'", "'8.0'", "'10'", "'8,8'", "'x'"], "k": ["'ГОСТ 7798'", "'ISO 4017'", "'DIN 933'", "'125'", "''"], "z": ["'M20x45.58'", "'20x45'", "'4.2x16'", "'12x80.109'", "'20'"]}
    t = table(spark, d, "part").select("p_partkey", *[F.expr(case(*o)).alias(c) for c, o in cells.items()])
    std = X.column_standard("k")
    return t.select("p_partkey", X.column_strength("s", seeds.default_dictionary()).alias("strength"), std["gost"].alias("gost"), std["iso"].alias("iso"), std["din"].alias("din"), X.strip_strength(X.with_metric_prefix(F.col("z"))).alias("size"))


@query(f"""SELECT p_partkey, {case("'zinc'", "'none'", "'stainless'", "''", "'chrome'")} AS coating, {case("'8.8'", "'A2-70'", "''", "'12.9'", "'4.6'")} AS strength,
  {case("'Ø' || p_size", "'M' || p_size", "p_size || 'x' || 20", "'d' || p_size", "''")} AS size, {case("'diameter'", "'diameter'", "'diameter_length'", "'diameter'", "NULL")} AS size_kind FROM part""")
def rule_detection(spark, d):
    """Codes of the first rules that match, by regular expression, whole word or part."""
    t = shapes(spark, d, "'Zinc 8.8 Ø ' || p_size", "'б/п a2-70 М' || p_size", "'нерж ' || p_size || ' х 20'", "'d' || p_size || ' 12,9'", "'хром 4.6'")
    own = seeds.default_dictionary()
    z = X.detect_size("t", own.of("size"))
    return t.select("p_partkey", X.detect("t", own.of("coating"), "code").alias("coating"), X.detect("t", own.of("strength")).alias("strength"), F.coalesce(z["size_norm"], F.lit("")).alias("size"), z["size_kind"].alias("size_kind"))


@query(f"""SELECT p_partkey, split_part(p_name, ' ', 2) AS item_type, lower('M' || p_size || 'x20') AS size_raw, p_size || ',20' AS size_tokens, array_to_string(list_sort([split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)]), ' ') AS keywords, {case("NULL", "p_size")}::DOUBLE AS volume_ml FROM part""")
def row_features(spark, d):
    """What a match looks at in a row, for its diagnostics."""
    n = F.expr(case("'The ' || p_name", "p_name || ' ' || p_size || ' ml'"))
    p = table(spark, d, "part").select("p_partkey", n.alias("name"), F.upper(F.get(F.split("p_name", " "), F.lit(1))).alias("item_type"), F.expr("'M' || p_size || 'x20'").alias("size"))
    f = X.row_features(p).select("p_partkey", "features.*")
    return f.select("p_partkey", "item_type", "size_raw", F.array_join(F.transform("size_tokens", lambda x: x.cast("int").cast("string")), ",").alias("size_tokens"), F.array_join("keywords", " ").alias("keywords"), "volume_ml")


@query("SELECT unnest(['болт', 'болта', 'болты', 'болтов', 'винт', 'винта', 'винты', 'винтов']) AS word, 'bolt or screw' AS known UNION ALL SELECT DISTINCT split_part(p_name, ' ', 2), 'part' FROM part")
def type_vocabulary(spark, d):
    """All names and other words of product types: of the first two default ones, and of the parts."""
    own = seeds.default_dictionary().types[:2]
    first = spark.createDataFrame([(w, "bolt or screw") for w in X.vocabulary(X.Dictionary(types=own))], "word string, known string")
    kinds = sorted(r["w"] for r in table(spark, d, "part").select(F.get(F.split("p_name", " "), F.lit(1)).alias("w")).distinct().collect())  # eight
    return first.unionByName(spark.createDataFrame([(w, "part") for w in X.vocabulary(X.Dictionary(types=tuple(X.ItemType(k) for k in kinds)))], "word string, known string"))


@query("SELECT lower(p_name) AS name, min(p_partkey) AS first, split_part(min(p_name), ' ', 2) AS item_type FROM part GROUP BY 1")
def distinct_names(spark, d):
    """Names whatever their case once, at their first place."""
    from tallyforge.plans.base import DICTIONARY

    k = F.col("p_partkey")
    p = table(spark, d, "part").select(k.alias("pos"), F.when(k % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("name"))
    got = X.parse_names(p.unionByName(p.select("pos", F.lit(" ").alias("name"))), DICTIONARY)
    return got.select(F.lower("name").alias("name"), F.col("pos").alias("first"), "item_type")


@query("""SELECT doc_id, 'txt_' || substr(sha256(coalesce(text, '')), 1, 12) AS text_key, substr(sha256(encode(coalesce(text, ''))), 1, 16) AS file_key,
  'txt_' || substr(sha256(coalesce(text, '')), 1, 12) || '_' || substr(sha256('diameter,size'), 1, 8) AS download_key FROM documents""")
def content_keys(spark, d):
    t = table(spark, d, "documents").select("doc_id", T.text("text").alias("t"))
    key = sinks.text_key_of(F.col("t"))
    return t.select("doc_id", key.alias("text_key"), sinks.file_key_of(F.encode("t", "UTF-8")).alias("file_key"), sinks.download_key_of(key, ["size", "diameter"]).alias("download_key"))


_LINES = {
    "'  '": "garbage", "'Всего к оплате ' || p_size": "total", "'Наименование Цена Сумма Код'": "header", "'ИНН ' || p_partkey || ' банк'": "requisites", "'Накладная от 5 мая'": "requisites", "'В т.ч. НДС 20 процентов'": "total", "p_name || ' M' || p_size": "item",
    "'ok'": "garbage", "'two words'": "garbage", "'three plain words'": "item", "'Итого DIN 933'": "item", "'Оплата: шайба'": "item", "'Артикул код номер'": "header", "'Адрес: улица ' || p_size": "requisites", "'5х20 оплата'": "item",
}


@query(f"""SELECT p_partkey, {case(*(f"'{c}'" for c in _LINES.values()))} AS line_class FROM part""")
def quote_line_classes(spark, d):
    """Lines of quotes of every class; signs of an item outweigh all others."""
    return shapes(spark, d, *_LINES).select("p_partkey", X.classify_line("t").alias("line_class"))
