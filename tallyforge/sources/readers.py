"""Readers of order files: delimited text, workbooks, free text and recognised documents."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from itertools import islice
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.functions import text as T
from tallyforge.functions import vocab as V
from tallyforge.operators.graph import ship

#: Rows of a workbook given at a time.
ROWS = 10_000
GRID = "file string, sheet string, row_index int, cells array<string>"


def sniff_delimiter(sample: str) -> str:
    """The most frequent of , ; tab and | in the first 4096 characters."""
    counts = {d: sample[:4096].count(d) for d in ",;\t|"}
    return max(counts, key=lambda d: counts[d]) if any(counts.values()) else ","


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """Grid (file, row_index, cells) of delimited files: rows are numbered in each file, and quoted cells may hold delimiters and line breaks.

    Each file's encoding (UTF-8, with or without a mark, else cp1251) and delimiter are found from the
    file itself; what reaches the driver is a few lines of each. A file with quotes over several lines
    cannot be split, so a file is read by one task.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"), F.monotonically_increasing_id().alias("n"))
    w = Window.partitionBy("file").orderBy("n")
    first = lines.withColumn("r", F.row_number().over(w)).where("r <= 20").groupBy("file").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("sample"))
    broken = lines.groupBy("file").agg(F.max(~F.is_valid_utf8("line")).alias("broken"))
    kinds: dict[tuple[bool, str], list[str]] = {}
    for r in first.join(broken, "file").collect():
        kinds.setdefault((r["broken"], sniff_delimiter(r["sample"])), []).append(r["file"])
    grids = [_separated(spark, sorted(files), sep, old) for (old, sep), files in sorted(kinds.items())]
    if not grids:
        return spark.createDataFrame([], "file string, row_index int, cells array<string>")
    out = grids[0]
    for g in grids[1:]:
        out = out.unionByName(g)
    return out


# What each byte from 0x80 on is in cp1251; Spark's own reader does not know that encoding, but keeps bytes as ISO 8859-1.
_LATIN = "".join(map(chr, range(0x80, 0x100)))
_CYRILLIC = "".join(bytes([b]).decode("cp1251", "replace") for b in range(0x80, 0x100))


def _separated(spark: SparkSession, files: list[str], sep: str, cyrillic: bool) -> DataFrame:
    most = spark.read.text(files).agg(F.max(F.size(F.split("value", re.escape(sep))))).first()[0] or 1  # cells of a line at most
    schema = ", ".join(f"c{i} string" for i in range(most))
    read = spark.read.schema(schema).options(sep=sep, encoding="ISO-8859-1" if cyrillic else "UTF-8", quote='"', escape='"', multiLine=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True).csv(files)
    said = lambda c: F.translate(c, _LATIN, _CYRILLIC) if cyrillic else c
    rows = read.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("n"), F.array(*[F.trim(said(F.coalesce(f"c{i}", F.lit("")))) for i in range(most)]).alias("cells"))
    # Cells after a row's last one that holds something are not kept.
    width = F.array_max(F.transform("cells", lambda c, i: F.when(c != "", i + 1).otherwise(0)))
    rows = rows.withColumn("cells", F.slice("cells", F.lit(1), width)).withColumn("row_index", F.row_number().over(Window.partitionBy("file").orderBy("n")) - 1)
    mark = F.transform("cells", lambda c, i: F.when(i == 0, F.regexp_replace(c, "^\ufeff\"?|\"$", "")).otherwise(c))
    return rows.select("file", "row_index", F.when(F.col("row_index") == 0, mark).otherwise(F.col("cells")).alias("cells"))


def client_rows(grid: DataFrame) -> DataFrame:
    """row_index, name, qty, unit: columns by words of the first row (a later one of a role wins; the name is column 0 by default); rows without a name go."""
    from tallyforge.sources.profile import head, norm_cell

    first = head(grid, 1)
    roles = {"name": 0}
    for i, h in enumerate(norm_cell(c) for c in (first[0] if first else [])):
        if any(w in h for w in ("наимен", "name", "товар", "номенклат")):
            roles["name"] = i
        elif any(w in h for w in ("кол", "qty", "quantity")):
            roles["qty"] = i
        elif any(w in h for w in ("ед", "unit", "uom")):
            roles["unit"] = i
    cell = lambda r: F.trim(F.coalesce(F.get("cells", F.lit(roles[r])), F.lit(""))) if r in roles else F.lit("")
    return grid.where("row_index > 0").select("row_index", cell("name").alias("name"), T.number(cell("qty")).alias("qty"), F.nullif(cell("unit"), F.lit("")).alias("unit")).where("name <> ''")


def _workbook(data: bytes, every: bool = False) -> Iterator[tuple[str, int, list[str | None]]]:
    """(sheet, row, cells) of an .xlsx file's active sheet, or of every one; merged cells have the value of their first one."""
    main = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    link = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    place = lambda ref: (int(re.sub(r"\D", "", ref)) - 1, sum((ord(c) - 64) * 26**i for i, c in enumerate(reversed(re.sub(r"\d", "", ref)))) - 1)
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            with z.open("xl/sharedStrings.xml") as part:
                shared = ["".join(t.text or "" for t in si.iter(f"{main}t")) for si in _elements(part, f"{main}si")]
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        target = {}
        if "xl/_rels/workbook.xml.rels" in z.namelist():
            target = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = [(s.get("name"), "xl/" + target.get(s.get(link), f"worksheets/sheet{k}.xml").removeprefix("/xl/")) for k, s in enumerate(book.find(f"{main}sheets"), 1)]
        view = book.find(f"{main}bookViews/{main}workbookView")
        active = int(view.get("activeTab", 0)) if view is not None else 0
        for name, sheet in sheets if every else sheets[active : active + 1]:
            rising, last = True, 0
            with z.open(sheet) as part:
                for e in _elements(part, f"{main}row"):
                    here = {place(c.get("r"))[0] + 1 for c in e.iter(f"{main}c")}
                    rising, last = rising and len(here) < 2 and min(here, default=last + 1) > last, max(here, default=last)
            if rising:
                yield from ((name, r, cells) for r, cells in _streamed(z, sheet, shared, place, main))
                continue
            # Rows that do not rise are gathered.
            root = ElementTree.fromstring(z.read(sheet))
            values: dict[tuple[int, int], str] = {}
            for c in root.iter(f"{main}c"):
                v, kind = c.find(f"{main}v"), c.get("t")
                if kind == "inlineStr":
                    text = "".join(t.text or "" for t in c.iter(f"{main}t"))
                elif v is None:
                    continue
                else:
                    text = shared[int(v.text)] if kind == "s" else v.text
                values[place(c.get("r"))] = text
            for m in root.iter(f"{main}mergeCell"):
                (r0, c0), (r1, c1) = map(place, m.get("ref").split(":"))
                if (r0, c0) in values:
                    for r in range(r0, r1 + 1):
                        for c in range(c0, c1 + 1):
                            values.setdefault((r, c), values[r0, c0])
            width = max((c for _, c in values), default=-1) + 1
            for r in range(max((r for r, _ in values), default=-1) + 1):
                yield name, r, [values.get((r, c)) for c in range(width)]


def _elements(part, tag: str) -> Iterator[ElementTree.Element]:
    """The elements of a tag, one at a time: what was read, and all outside of them, is forgotten."""
    path, within = [], 0
    for event, e in ElementTree.iterparse(part, ("start", "end")):
        if event == "start":
            path.append(e)
            within += e.tag == tag
            continue
        path.pop()
        if e.tag == tag:
            yield e
            within -= 1
        if path and not within:
            path[-1].remove(e)


def _streamed(z: zipfile.ZipFile, sheet: str, shared: list[str], place, main: str) -> Iterator[tuple[int, list[str | None]]]:
    """(row, cells) of a sheet whose rows rise, read three times: its merged cells, its size, its rows. One row is held, and the merged cells."""
    with z.open(sheet) as part:
        merged = [tuple(map(place, m.get("ref").split(":"))) for m in _elements(part, f"{main}mergeCell")]
    starts: dict[int, list[int]] = {}
    for i, ((r0, _), _) in enumerate(merged):
        starts.setdefault(r0, []).append(i)

    def said():
        with z.open(sheet) as part:
            for e in _elements(part, f"{main}row"):
                row, r = {}, None
                for c in e.iter(f"{main}c"):
                    r, at = place(c.get("r"))
                    v = c.find(f"{main}v")
                    if c.get("t") == "inlineStr":
                        row[at] = "".join(t.text or "" for t in c.iter(f"{main}t"))
                    elif v is not None:
                        row[at] = shared[int(v.text)] if c.get("t") == "s" else v.text
                if row:
                    yield r, row

    def whole():
        """Every row that holds something, with its merged cells; the first of these that covers a cell counts."""
        own, after = said(), 0
        ahead = next(own, None)
        active: dict[int, str] = {}
        waiting = sorted(starts, reverse=True)
        while ahead or active or waiting:
            r = after if active else min([*([ahead[0]] if ahead else []), *waiting[-1:]])
            row = {}
            if ahead and ahead[0] == r:
                row, ahead = ahead[1], next(own, None)
            new = starts[waiting.pop()] if waiting and waiting[-1] == r else []
            for i in sorted([*active, *new]):
                (_, c0), (r1, c1) = merged[i]
                if i not in active:
                    if c0 not in row:
                        continue
                    active[i] = row[c0]
                for c in range(c0, c1 + 1):
                    row.setdefault(c, active[i])
                if r >= r1:
                    del active[i]
            if row:
                yield r, row
            after = r + 1

    width = max((max(row) for _, row in whole()), default=-1) + 1
    at = 0
    for r, row in whole():
        yield from ((i, [None] * width) for i in range(at, r))
        yield r, [row.get(c) for c in range(width)]
        at = r + 1


def workbook_rows(files: DataFrame, every_sheet: bool = False) -> DataFrame:
    """Grid rows of the .xlsx files in files(path, content): the active sheet's, or every sheet's. A workbook's file is held, its rows are read as a stream."""
    def run(batches):
        for b in batches:
            for name, data in zip(b.column(0), b.column(1)):
                name, rows = name.as_py(), _workbook(data.as_py(), every_sheet)
                while got := list(islice(rows, ROWS)):
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(got), pa.string()), pa.array([s for s, _, _ in got], pa.string()), pa.array([r for _, r, _ in got], pa.int32()), pa.array([c for _, _, c in got], pa.list_(pa.string()))], ["file", "sheet", "row_index", "cells"])

    ship(files.sparkSession)
    return files.select("path", "content").mapInArrow(run, GRID)


def read_workbooks(spark: SparkSession, path: str, every_sheet: bool = False) -> DataFrame:
    """Grid rows of .xlsx files, one task for some files."""
    return workbook_rows(spark.read.format("binaryFile").load(path), every_sheet)


def text_rows(docs: DataFrame, doc: str = "doc_id", text: str = "text", phrases: list[str] | None = None) -> DataFrame:
    """Order rows of free texts: doc, row_number, name, qty, uom, source, source_line, note_raw.

    A `Количество: N unit` line belongs to the last other line above it; numbered lines and
    `name - N unit` split; service lines become the document's note; any other line is a position.
    Windows are by document.
    """
    w = Window.partitionBy(doc).orderBy("i")
    lines = docs.select(doc, F.posexplode(F.split(T.text(text), r"\r\n|[\n\r]")).alias("i", "line")).withColumn("line", F.trim("line")).where("line <> ''")
    label = T.group(F.col("line"), r"(?iuU)^(?:количество|кол(?:[.\-\s]?во)?)\s*:?\s*(.+)", 1)
    lines = lines.withColumn("lab", F.when(label != "", T.parse_qty_uom(T.join_thousands(label))))
    said = F.col("lab.qty").isNotNull() & F.col("lab.uom").isNotNull()
    # The first line of a document has nothing above it to belong to.
    lines = lines.withColumn("is_label", F.coalesce(said, F.lit(False)) & (F.row_number().over(w) > 1))
    # Labels that follow a position, up to the next position: the last one counts.
    lines = lines.withColumn("g", F.sum(F.when(F.col("is_label"), 0).otherwise(1)).over(w))
    own = Window.partitionBy(doc, "g")
    lines = lines.withColumn("q", F.max(F.when(F.col("is_label"), F.struct("i", F.col("lab.qty").alias("qty"), F.col("lab.uom").alias("uom")))).over(own)).where("NOT is_label")
    numbered = T.group(F.col("line"), r"(?s)^\d+[.)]\s+(.+)", 1)
    lines = lines.withColumn("body", T.first(F.trim(numbered), F.col("line"))).withColumn("numbered", numbered != "").withColumn("dash", T.dash_quantity("body"))
    has = F.col("q").isNotNull() | F.col("dash.qty").isNotNull()
    lines = lines.withColumn("note", ~has & ~F.col("numbered") & T.is_note("line"))
    lines = lines.withColumn("notes", F.array_sort(F.collect_list(F.when(F.col("note"), F.struct("i", "line"))).over(Window.partitionBy(doc)))).where("NOT note")
    lines = lines.withColumns({"p": T.preprocess_row(F.when(F.col("numbered"), F.col("dash.name")).otherwise(F.col("line")), phrases=phrases), "cut": T.strip_tail_phrase(F.when(F.col("q").isNotNull(), F.col("line")).otherwise(F.col("dash.name")), phrases or [])})
    return lines.select(
        doc, F.row_number().over(w).alias("row_number"), F.when(has, F.col("cut.clean")).otherwise(F.col("p.cleaned_name")).alias("name"),
        F.when(F.col("q").isNotNull(), F.col("q.qty")).when(has, F.col("dash.qty")).otherwise(F.col("p.qty")).alias("qty"),
        F.when(F.col("q").isNotNull(), F.col("q.uom")).when(has, F.col("dash.uom")).otherwise(F.col("p.uom")).alias("uom"),
        F.when(has, "из текста").otherwise(F.col("p.source")).alias("qty_uom_source"), F.col("line").alias("source_line"), F.array_join(F.transform("notes", lambda n: n["line"]), "; ").alias("note_raw"),
    )


def parse_line(c) -> Column:
    """struct<name, qty, unit> of one line: `unit N` at its end, else `N unit`; without either the line is the name."""
    units = T.alternatives(T.spellings(V.TAIL_UNITS))
    tidy = lambda s: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"\s*[,\-]+\s*$", ""), r"^\s*[,\-]+\s*", ""), r"\s{2,}", " "))
    a, b = rf"(?siuU)^(.*?)(?<=\s)({units})\.?\s+{T.NUMBER}\s*$", rf"(?siuU)^(.*?)(?<=\s){T.NUMBER}\s*({units})\.?\s*$"
    unit = lambda g: T.lookup(T.spellings(V.TAIL_UNITS), F.lower(g))
    made = lambda n, q, u: F.struct(n.alias("name"), q.alias("qty"), u.alias("unit"))

    def choose(t):
        plain = made(t, F.lit(None).cast("double"), F.lit(None).cast("string"))
        second = T.let(T.matched(t, b, 3), lambda g: F.when(F.size(g) == 4, made(tidy(g[1]), T.number(g[2]), unit(g[3]))).otherwise(plain))
        return T.let(T.matched(t, a, 3), lambda g: F.when(F.size(g) == 4, made(tidy(g[1]), T.number(g[3]), unit(g[2]))).otherwise(second))

    return T.let(F.trim(F.regexp_replace(F.regexp_replace(T.text(c), "\t", " "), " {2,}", " ")), choose)


def list_rows(docs: DataFrame, doc: str = "doc_id", text: str = "text", numbered: bool = True) -> DataFrame:
    """Lines that end in a quantity and unit: doc, line_no, raw_line, name, qty, uom, multiplier; numbering is cut off first if `numbered`."""
    lines = docs.select(doc, F.posexplode(F.split(T.text(text), r"\r\n|[\n\r]")).alias("line_no", "raw_line"))
    body = F.regexp_replace(F.trim("raw_line"), r"^\s*\d+(?:\.\d+)*[.)]?\)?\s+", "") if numbered else F.trim("raw_line")
    got = lines.withColumn("t", T.tail_quantity(body)).where("t.qty IS NOT NULL AND t.uom IS NOT NULL")
    return got.select(doc, "line_no", "raw_line", F.trim(F.regexp_replace("t.clean", r"(?U)\s*[-–—:;,]+\s*$", "")).alias("name"), F.col("t.qty").alias("qty"), F.col("t.uom").alias("uom"), F.col("t.multiplier").alias("multiplier"))


def word_rows(words: DataFrame, page: str = "page", gap: float = 5.0) -> DataFrame:
    """Lines of a page from placed words(page, x, y, word): a new line where y grows by more than the gap; cells from left to right."""
    w = Window.partitionBy(page).orderBy("y", "x")
    islands = words.withColumn("line", F.sum(F.when(F.col("y") - F.lag("y").over(w) > gap, 1).otherwise(0)).over(w))
    return islands.groupBy(page, "line").agg(F.transform(F.sort_array(F.collect_list(F.struct("x", "word"))), lambda c: c["word"]).alias("cells"))


def grouped_words(words: DataFrame) -> DataFrame:
    """Recognised words(page, block, par, line, left, text) as lines."""
    return words.where(F.trim("text") != "").groupBy("page", "block", "par", "line").agg(F.concat_ws(" ", F.transform(F.sort_array(F.collect_list(F.struct("left", "text"))), lambda c: c["text"])).alias("line_text"))


def pdf_kind(pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    """TEXT_PDF if the first three pages(doc, page, text) hold 50 characters."""
    return pages.where("page < 3").groupBy(doc).agg(F.sum(F.length(F.trim(T.text("text")))).alias("chars")).withColumn("kind", F.when(F.col("chars") >= 50, "TEXT_PDF").otherwise("SCAN_PDF"))


def unwrapped(df: DataFrame, column: str = "content_base64") -> DataFrame:
    """df with the decoded bytes of a base64 column."""
    return df.withColumn("content", F.unbase64(column))


def case_lines(df: DataFrame, column: str = "input_data") -> DataFrame:
    """df with `lines`: a JSON list of texts, else the lines that are not empty."""
    plain = F.filter(F.transform(F.split(T.text(column), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    listed = F.when(F.trim(T.text(column)).startswith("["), F.from_json(column, "array<string>"))
    return df.withColumn("lines", F.coalesce(listed, plain))


# Documents as recognition services return them. The names of their fields.

_SEG = "struct<startIndex:string,endIndex:string>"
_LAYOUT = f"struct<textAnchor:struct<textSegments:array<{_SEG}>>,confidence:double>"
_CELL = f"struct<layout:{_LAYOUT}>"
_ROW = f"struct<cells:array<{_CELL}>>"
DOCUMENT = f"struct<text:string,pages:array<struct<tables:array<struct<headerRows:array<{_ROW}>,bodyRows:array<{_ROW}>>>,paragraphs:array<{_CELL}>,lines:array<{_CELL}>,blocks:array<{_CELL}>>>>"


def anchored(text: Column, layout: Column) -> Column:
    """The text of a layout's segments."""
    parts = F.transform(F.coalesce(layout["textAnchor"]["textSegments"], F.array()), lambda s: text.substr(F.coalesce(s["startIndex"].cast("int"), F.lit(0)) + 1, s["endIndex"].cast("int") - F.coalesce(s["startIndex"].cast("int"), F.lit(0))))
    return F.trim(F.regexp_replace(F.array_join(parts, ""), r"\s+", " "))


def ocr_tables(docs: DataFrame, doc: str = "doc_id", json: str = "json") -> DataFrame:
    """(doc, table_no, header array<array<string>>, body array<array<string>>, n_rows, fill, digits) of recognised documents."""
    d = docs.select(doc, F.from_json(json, DOCUMENT).alias("d")).select(doc, F.col("d.text").alias("t"), F.posexplode(F.flatten(F.transform("d.pages", lambda p: F.coalesce(p["tables"], F.array())))).alias("table_no", "x"))
    grid = lambda rows: F.transform(F.coalesce(rows, F.array()), lambda r: F.transform(F.coalesce(r["cells"], F.array()), lambda c: anchored(F.col("t"), c["layout"])))
    out = d.select(doc, "table_no", grid(F.col("x.headerRows")).alias("header"), grid(F.col("x.bodyRows")).alias("body"))
    cells = F.flatten(F.concat("header", "body"))
    filled = F.filter(cells, lambda c: c != "")
    return out.withColumns({"n_rows": F.size("header") + F.size("body"), "fill": F.coalesce(F.try_divide(F.size(filled), F.size(cells)), F.lit(0.0)), "digits": F.exists(filled, lambda c: c.rlike(r"\d"))})


def table_score() -> Column:
    """Rows x filled share, and 0.2 for digits."""
    return F.col("n_rows") * F.col("fill") + F.when(F.col("digits"), 0.2).otherwise(0.0)


def best_tables(tables: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Each document's best table, the first of equals, with is_product: its header names goods and numbers. Product tables come first, the one with most rows."""
    says = lambda words: F.exists(F.flatten("header"), lambda c: F.lower(c).rlike("|".join(map(re.escape, words))))
    scored = tables.withColumns({"score": table_score(), "is_product": says(V.PRODUCT_NAME_WORDS) & says(V.PRODUCT_NUMBER_WORDS)})
    order = Window.partitionBy(doc).orderBy(F.desc("is_product"), F.when(F.col("is_product"), -F.size("body")).otherwise(0), F.desc("score"), "table_no")
    return scored.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")


def column_role(h: Column) -> Column:
    """price_total, qty, unit, price_unit or name by a header's words, which are fixed values; null for others."""
    has = lambda *words: F.lower(h).rlike("|".join(map(re.escape, words)))
    return (
        F.when(has("сумма", "стоимость", "total", "amount"), "price_total").when(has("кол-во", "количество", "qty", "кол."), "qty").when(has("ед", "unit"), "unit")
        .when(has("цена", "price"), "price_unit").when(has("товар", "наименование", "product", "item", "услуги", "работы", "номенклатура"), "name")
    )


def structured_rows(tables: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, row_no, name, qty, unit, price_unit, price_total) of product tables, without summary rows and rows without a name."""
    t = tables.where("is_product").withColumn("roles", F.transform(F.get("header", F.lit(0)), column_role))
    rows = t.select(doc, "roles", F.posexplode("body").alias("row_no", "cells"))
    rows = rows.where(~F.array_join("cells", " ").rlike(V.SUMMARY_LINE))
    cell = lambda role: F.when(F.array_position("roles", role) > 0, F.get("cells", F.array_position("roles", role).cast("int") - 1))
    num = lambda role: T.number(F.translate(cell(role), "  ", ""))
    return rows.select(doc, "row_no", F.trim(cell("name")).alias("name"), num("qty").alias("qty"), F.nullif(F.trim(cell("unit")), F.lit("")).alias("unit"), num("price_unit").alias("price_unit"), num("price_total").alias("price_total")).where("name <> ''")


# Signs of goods in a recognised line.
_PRODUCT = r"(?iuU)(?:[МмMm]\d+|DIN\s*\d+|ГОСТ\s*[\dР]|(?:болт|гайка|шайба|винт|саморез|шпилька|анкер|дюбель|заклепка|гвоздь|электрод|сверло|диск|круг|хомут|фланец|муфта|труба)\b)"


def ocr_lines(docs: DataFrame, part: str = "paragraphs", doc: str = "doc_id", json: str = "json", products_only: bool = True) -> DataFrame:
    """(doc, line_no, line) of a document's paragraphs or lines: those that look like goods with a quantity, or all if none does."""
    d = docs.select(doc, F.from_json(json, DOCUMENT).alias("d")).select(doc, F.col("d.text").alias("t"), F.posexplode(F.flatten(F.transform("d.pages", lambda p: F.coalesce(p[part], F.array())))).alias("line_no", "x"))
    lines = d.select(doc, "line_no", anchored(F.col("t"), F.col("x.layout")).alias("line")).where("line <> ''")
    if not products_only:
        return lines
    units = T.alternatives(T.spellings(V.TAIL_UNITS))
    good = F.col("line").rlike(_PRODUCT) & F.col("line").rlike(rf"(?iuU)\d\s*(?:{units})\b")
    w = Window.partitionBy(doc)
    return lines.withColumn("good", good).withColumn("some", F.max("good").over(w)).where("good OR NOT some").drop("good", "some")


def ocr_confidence(docs: DataFrame, doc: str = "doc_id", json: str = "json") -> DataFrame:
    """Mean confidence of a document's blocks, per cent with one place; null without any."""
    blocks = docs.select(doc, F.explode_outer(F.flatten(F.transform(F.from_json(json, DOCUMENT)["pages"], lambda p: F.coalesce(p["blocks"], F.array())))).alias("b"))
    return blocks.groupBy(doc).agg(F.bround(F.avg("b.layout.confidence") * 100, 1).alias("confidence"))


def extract_document(docs: DataFrame, doc: str = "doc_id", json: str = "json", hint: str = "") -> DataFrame:
    """(doc, mode, row_no, cells): a product table, else the best table, else paragraphs, else lines; hints structured_text and free_text skip tables."""
    tables = best_tables(ocr_tables(docs, doc, json), doc)
    if hint not in ("structured_text", "free_text"):
        mode = F.when(F.col("is_product") & (F.size("body") > 0), "product_table").otherwise("table")
        found = tables.where("score > 0").select(doc, mode.alias("mode"), F.posexplode(F.when(mode == "product_table", F.col("body")).otherwise(F.concat("header", "body"))).alias("row_no", "cells"))
    else:
        found = tables.where("false").select(doc, F.lit("").alias("mode"), F.lit(0).alias("row_no"), F.array().cast("array<string>").alias("cells"))
    rest = docs.join(found.select(doc).distinct(), doc, "left_anti")
    for part, mode in (("paragraphs", "paragraph"), ("lines", "line")):
        more = ocr_lines(rest, part, doc, json, hint != "free_text").select(doc, F.lit(mode).alias("mode"), F.col("line_no").alias("row_no"), F.array("line").alias("cells"))
        found, rest = found.unionByName(more), rest.join(more.select(doc).distinct(), doc, "left_anti")
    return found


def cell_quantity(qty, uom, header=None) -> Column:
    """struct<qty, uom, source> of a recognised quantity cell and unit cell: thousands, unit first, plain, junk before the unit, both in one cell, unit in the header."""
    q, u = F.trim(T.text(qty)), F.trim(T.text(uom))
    names = {**T.spellings(V.TAIL_UNITS), "рул": "рул", "рулон": "рул", "рулонов": "рул"}
    alt = T.alternatives(names)
    unit = lambda c: T.lookup(names, F.regexp_replace(F.lower(F.trim(c)), r"\.+$", ""))
    made = lambda a, b, s: F.when(a.isNotNull() & b.isNotNull(), F.struct(a.alias("qty"), b.alias("uom"), F.lit(s).alias("source")))
    thousand = rf"(?iuU){T.NUMBER}\s+тыс\.?\s*(\w+)\.?\s*$"
    pair = rf"(?iuU)(?:^|\s){T.NUMBER}\s*({alt})\.?\s*$"
    get = lambda c, p, n: F.nullif(T.group(c, p, n), F.lit(""))
    reverse, junk = rf"(?iuU)^({alt})\.?\s+{T.NUMBER}\s*$", rf"(?iuU)^[NnАа№\-\s]+({alt})\.?\s*$"
    hinted = F.when(T.text(header) != "", T.lookup(names, F.lower(get(T.text(header), rf"(?iuU)(?<!\w)({alt})(?!\w)", 1)))) if header is not None else F.lit(None).cast("string")
    return F.coalesce(
        made(T.number(get(u, thousand, 1)) * 1000, unit(get(u, thousand, 2)), "thous_in_uom"), made(T.number(q) * 1000, unit(get(u, r"(?iuU)тыс\.?\s*(\w+)", 1)), "thous_mult"),
        made(T.number(get(q, thousand, 1)) * 1000, unit(get(q, thousand, 2)), "thous_in_qty"), made(T.number(get(u, reverse, 2)), unit(get(u, reverse, 1)), "uom_before_qty"),
        made(T.number(q), unit(u), "direct"), made(T.number(q), unit(get(u, junk, 1)), "ocr_junk_uom"), made(T.number(get(u, pair, 1)), unit(get(u, pair, 2)), "num_uom_in_uom_col"),
        made(T.number(get(q, pair, 1)), unit(get(q, pair, 2)), "split_qty_col"), made(T.number(q), hinted, "header_hint"),
        F.struct(F.lit(None).cast("double").alias("qty"), F.lit(None).cast("string").alias("uom"), F.lit("not_found").alias("source")),
    )
