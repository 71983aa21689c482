"""Delimited text as feature tables: delimiter sets, patterns, headers, type detection, point and WKT geometry.

Records are parsed by Spark's CSV reader where one delimiter character, one quote and one escape do, and by
``text`` with ``split`` or ``regexp_extract`` otherwise. Every column is read as text; types are detected by
one aggregate over the data, and columns are cast in the plan.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Signs and hemispheres that degrees may carry at one end, those that are negative, and the types that sidecar files name.
SIGNS, NEGATIVE = "+-NSEW", "-SW"
SIDECAR = {"integer": "int", "int": "int", "integer64": "bigint", "longlong": "bigint", "long": "bigint", "int8": "bigint", "real": "double", "double": "double", "float": "double", "string": "string", "text": "string", "date": "date", "time": "string", "datetime": "timestamp"}


def header_names(raw: list[str | None], most: int = 64) -> list[str]:
    """Trimmed and cut names; blank ones become field_N, names equal but for case get _1, _2."""
    out: list[str] = []
    taken: set[str] = set()
    for k, name in enumerate(raw, 1):
        base = (name or "").strip()[:most] or f"field_{k}"
        pick, n = base, 0
        while pick.lower() in taken:
            n += 1
            pick = f"{base}_{n}"
        taken.add(pick.lower())
        out.append(pick)
    return out


def file_order() -> list[Column]:
    """Where a record stands: its file, the split's start and the order inside the split."""
    return [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__seq")]


def widest(spark: SparkSession, path: str, delimiter: str, encoding: str) -> int:
    """The most cells that a line can hold, by its delimiters."""
    n = spark.read.option("encoding", encoding).text(path).agg(F.max(F.length("value") - F.length(F.replace("value", F.lit(delimiter), F.lit(""))))).first()[0]
    return (n or 0) + 1


def cell_patterns(delimiters: str, quotes: str) -> tuple[str, list[str], str]:
    """Patterns of a delimiter, of a cell inside each of the quotes, and of a cell without any."""
    inside = lambda chars: "".join(re.escape(c).replace("^", "\\^").replace("]", "\\]") for c in chars)
    d = f"[{inside(delimiters)}]"
    return d, [f"{q}[^{q}]*+(?:{q}{q}[^{q}]*+)*{q}" for q in map(re.escape, quotes)], f"[^{inside(delimiters + quotes)}]*"


def valid_line(delimiters: str, quotes: str) -> Column:
    """Whether a line is a record: quotes open a cell, blanks aside, and close it; nothing but blanks follows, and no quote stands inside a cell that has begun without."""
    d, quoted, plain = cell_patterns(delimiters, quotes)
    cell = f"(?:{'|'.join([*(f'\\s*{q}\\s*' for q in quoted), plain])})"
    return F.col("line").rlike(f"^{cell}(?:{d}{cell})*$")


def split_cells(delimiters: str, quotes: str) -> Column:
    """A line's cells by any of several delimiters, which count as text inside quotes (any of several, each closed by its like); doubled quotes inside are one."""
    if not quotes:
        return F.split("line", cell_patterns(delimiters, "")[0], -1)
    d, quoted, _ = cell_patterns(delimiters, quotes)
    rest = "[^" + d[1:-1] + "]*"
    # each cell with the delimiter before it; a delimiter put before the line gives the first one too
    cells = F.regexp_extract_all(F.concat(F.lit(delimiters[0]), F.col("line")), F.lit(f"{d}({'|'.join([*(f'\\s*{q}{rest}' for q in quoted), rest])})"), 1)

    def bare(c: Column) -> Column:
        out = c
        for q, pattern in zip(quotes, quoted):
            e = re.escape(q)
            out = F.when(c.rlike(f"^\\s*{pattern}\\s*$"), F.replace(F.regexp_replace(F.regexp_replace(c, f"^\\s*{e}", ""), f"{e}\\s*$", ""), F.lit(q + q), F.lit(q))).otherwise(out)
        return out

    return F.transform(cells, bare)


def invalid_records(spark: SparkSession, path: str, delimiters: str = ",", quote: str = '"', encoding: str = "UTF-8") -> int:
    """How many lines ``read`` with ``strict`` leaves out."""
    lines = spark.read.option("encoding", encoding).text(path).select(F.regexp_replace("value", "\r$", "").alias("line"))
    return lines.filter(~valid_line(delimiters, quote)).count()


def read(spark: SparkSession, path: str, delimiters: str = ",", quote: str = '"', escape: str = '"', header: bool = True, skip_lines: int = 0, trim: bool = False, skip_empty: bool = False, max_fields: int = 0, encoding: str = "UTF-8", pattern: str | None = None, types: str = "detect", decimal_point: str = ".", names: list[str] | None = None, strict: bool = False) -> DataFrame:
    """A table of the files' records with ``fid`` first. Blank records are left out, short ones padded with null; cells beyond the header's get fields of their own.

    Each file has its own header and its own ``skip_lines`` before it; the names are those of the first file. Line breaks
    inside quotes need a single delimiter and no ``skip_lines``. ``whitespace`` as ``delimiters`` cuts at runs of blanks and tabs.
    ``pattern``: a regular expression that delimits fields; one that starts with ``^`` keeps only lines that it matches and gives its groups.
    ``quote`` may hold several characters; then, and with ``strict``, a record is a line. ``strict`` leaves out records with text behind a closing
    quote, with a quote inside a cell that began without, or with one that is not closed (``invalid_records`` counts them).
    ``types``: ``detect`` (by a ``.csvt`` file beside the data where there is one, else by the cells), ``text``, or a sidecar line.
    """
    if delimiters == "whitespace":
        pattern, trim = r"[ \t]+", True
    if pattern is None and len(delimiters) == 1 and len(quote) < 2 and not strict and not skip_lines:
        n = widest(spark, path, delimiters, encoding)
        reader = spark.read.option("sep", delimiters).option("quote", quote).option("escape", escape).option("multiLine", True).option("encoding", encoding).option("header", False)
        rows = reader.schema(", ".join(f"c{k} string" for k in range(n))).csv(path)
        cells = F.array(*rows.columns)
        last = F.array_max(F.transform(F.sequence(F.lit(1), F.size("cells")), lambda k: F.when(F.element_at("cells", k).isNotNull(), k).otherwise(0)))
        rows = rows.select(*file_order(), cells.alias("cells")).withColumn("cells", F.slice("cells", 1, last))
    else:
        text = spark.read.option("encoding", encoding).text(path).select(*file_order(), F.regexp_replace("value", "\r$", "").alias("line"))
        if skip_lines:
            place = F.row_number().over(Window.partitionBy("__file").orderBy("__block", "__seq"))
            first = text.filter("__block = 0").select("__file", "__block", "__seq").withColumn("__place", place).filter(F.col("__place") <= skip_lines)
            text = text.join(first, ["__file", "__block", "__seq"], "left_anti")
        if pattern and pattern.startswith("^"):
            groups = re.compile(pattern).groups
            cells = F.array(*(F.regexp_extract("line", pattern, k + 1) for k in range(groups)))
            rows = text.filter(F.col("line").rlike(pattern)).withColumn("cells", cells).drop("line")
        else:
            text = text.filter(valid_line(delimiters, quote)) if strict and not pattern else text
            line = F.trim("line") if delimiters == "whitespace" else F.col("line")
            rows = text.withColumn("line", line).withColumn("cells", F.split("line", pattern, -1) if pattern else split_cells(delimiters, quote)).drop("line")
    if trim:
        rows = rows.withColumn("cells", F.transform("cells", lambda c: F.trim(c)))
    if skip_empty:
        rows = rows.withColumn("cells", F.filter("cells", lambda c: F.coalesce(c, F.lit("")) != ""))
    rows = rows.filter(F.exists("cells", lambda c: F.coalesce(c, F.lit("")) != ""))
    if header and names is None:
        place = F.struct("__block", "__seq")
        heads = rows.groupBy("__file").agg(F.min_by("cells", place).alias("head"), F.min(place).alias("at"))
        top = heads.orderBy("__file").first()
        names = header_names(list(top["head"])) if top else []
        heads = heads.select("__file", "at.*")  # a row for each file
        rows = rows.join(heads, ["__file", "__block", "__seq"], "left_anti")
    width = rows.agg(F.max(F.size("cells"))).first()[0] or 0
    names = names or []
    if width > len(names):
        names = header_names([*names, *[None] * (width - len(names))])
    names = names[:max_fields] if max_fields else names
    cols = [F.when(F.try_element_at("cells", F.lit(k + 1)) != "", F.try_element_at("cells", F.lit(k + 1))).alias(n) for k, n in enumerate(names)]
    out = rows.select(F.col("__seq").alias("fid"), *cols)
    if types == "detect":
        types = sidecar_line(spark, path) or types
    return detected(out, names, decimal_point) if types == "detect" else out if types == "text" else typed(out, sidecar_types(types, len(names)), names, decimal_point)


def sidecar_line(spark: SparkSession, path: str) -> str | None:
    """The first line of the ``.csvt`` file beside a data file, through the same file system; None where there is none."""
    jvm = spark.sparkContext._jvm
    beside = jvm.org.apache.hadoop.fs.Path(re.sub(r"\.\w+$", "", path) + ".csvt")
    if not beside.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(beside):
        return None
    row = spark.read.text(beside.toString()).first()
    return row["value"] if row else None


def number(c: Column, decimal_point: str = ".") -> Column:
    return F.regexp_replace(c, re.escape(decimal_point), ".") if decimal_point != "." else c


def detected(df: DataFrame, names: list[str], decimal_point: str = ".", keep: tuple[str, ...] = ()) -> DataFrame:
    """int, then bigint, then double, then text; empty cells don't count and a column without any value stays text."""
    if not names:
        return df
    q = [f"`{n}`" for n in names]
    fits = lambda n, kind, pat: F.coalesce(F.min((F.col(n).isNull() | (number(F.col(n), decimal_point).rlike(pat) & number(F.col(n), decimal_point).try_cast(kind).isNotNull())).cast("int")), F.lit(1))
    whole, real = r"^\s*[-+]?\d+\s*$", r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"
    row = df.agg(*(F.struct(F.count(n).alias("n"), fits(n, "int", whole).alias("i"), fits(n, "bigint", whole).alias("l"), fits(n, "double", real).alias("d")).alias(f"t{k}") for k, n in enumerate(q))).first()
    kinds = ["string" if not t["n"] else "int" if t["i"] else "bigint" if t["l"] else "double" if t["d"] else "string" for t in row]
    return typed(df, kinds, names, decimal_point, keep)


def typed(df: DataFrame, kinds: list[str], names: list[str], decimal_point: str = ".", keep: tuple[str, ...] = ()) -> DataFrame:
    kinds = kinds + ["string"] * (len(names) - len(kinds))
    return df.select("fid", *keep, *((F.col(f"`{n}`") if k == "string" else F.trim(number(F.col(f"`{n}`"), decimal_point)).try_cast(k)).alias(n) for n, k in zip(names, kinds)))


def sidecar_types(line: str, width: int) -> list[str]:
    """Types of a ``.csvt`` line such as ``"Integer","Real(10.2)"``; unknown ones are text."""
    found = [re.sub(r"\(.*\)", "", x).strip().strip('"').lower() for x in re.findall(r'"[^"]*"|[^,]+', line)]
    return [SIDECAR.get(x, "string") for x in found][:width]


def degrees(c: Column) -> Column:
    """Decimal degrees of a number or of degrees, minutes and seconds with a sign or letter at one end; null for both ends or neither form.

    The sign is taken off, the numbers are taken out of the rest and each is checked for its range; of what stands
    between them only separators are allowed.
    """
    t = F.upper(F.trim(c))
    ends = [F.substring(t, 1, 1), F.substring(t, -1, 1)]
    signed = [F.lit(SIGNS).contains(e) & (e != "") for e in ends]
    body = F.when(signed[0], F.substr(t, F.lit(2))).otherwise(t)
    body = F.trim(F.when(signed[1], F.substr(body, F.lit(1), F.length(body) - 1)).otherwise(body))
    found = F.regexp_extract_all(body, F.lit("[0-9.]+"), 0)
    rest = F.regexp_replace(body, "[0-9.]+", "")
    value = lambda k: F.try_element_at(found, F.lit(k)).try_cast("double")
    whole = lambda k: ~F.coalesce(F.try_element_at(found, F.lit(k)), F.lit("")).contains(".")
    n = F.size(found)
    fine = n.between(1, 3) & body.rlike("^[0-9]") & ~F.upper(rest).rlike("[A-Z+-]") & whole(1) & whole(2)
    fine = fine & (F.length(F.try_element_at(found, F.lit(1))) <= 3) & F.coalesce(value(2) < 60, F.lit(True)) & F.coalesce(value(3) < 60, F.lit(True))
    size = value(1) + F.coalesce(value(2), F.lit(0.0)) / 60 + F.coalesce(value(3), F.lit(0.0)) / 3600
    sign = F.when((signed[0] & F.lit(NEGATIVE).contains(ends[0])) | (signed[1] & F.lit(NEGATIVE).contains(ends[1])), -1.0).otherwise(1.0)
    return F.coalesce(c.try_cast("double"), F.when(fine & ~(signed[0] & signed[1]), sign * size))


def bare_wkt(c: Column) -> Column:
    """Well-known text without what stands before it: ``SRID=...;`` or a number."""
    t = F.trim(c)
    t = F.when(F.upper(t).startswith("SRID="), F.trim(F.substring_index(t, ";", -1))).otherwise(t)
    first = F.substring_index(t, " ", 1)
    return F.when(first.try_cast("long").isNotNull(), F.trim(F.substr(t, F.length(first) + 1))).otherwise(t)


def with_xy(df: DataFrame, x: str, y: str, dms: bool = False, decimal_point: str = ".") -> DataFrame:
    """Point geometry from two columns: rows with both empty stay without a point, unreadable ones go."""
    raw = [F.col(f"`{c}`").cast("string") for c in (x, y)]
    val = [degrees(c) if dms else number(c, decimal_point).try_cast("double") for c in raw]
    both_empty = F.coalesce(raw[0], F.lit("")).eqNullSafe("") & F.coalesce(raw[1], F.lit("")).eqNullSafe("")
    out = df.withColumns({"__x": val[0], "__y": val[1], "__none": both_empty}).filter(F.col("__none") | (F.col("__x").isNotNull() & F.col("__y").isNotNull()))
    keep = [c for c in df.columns if c not in ("x", "y")]
    return out.select(*(F.col(f"`{c}`") for c in keep), F.col("__x").alias("x"), F.col("__y").alias("y"))


def with_wkt(df: DataFrame, column: str) -> DataFrame:
    """``wkt, kind, x, y`` from WKT: prefixes removed; x and y are the centroid over all parts: the mean of points, the length-weighted middle of lines, the area-weighted centroid of polygons, whose holes count against them."""
    wkt = bare_wkt(F.col(f"`{column}`"))
    kind = F.upper(F.regexp_extract(wkt, r"^([A-Za-z]+)", 1))
    spelled = F.regexp_extract_all(F.regexp_replace(wkt, r"^[A-Za-z ]+", ""), F.lit(r"\(*\s*([^()]+)"), 0)
    part = lambda s: F.transform(F.split(F.regexp_replace(s, "[()]", " "), ","), lambda p: F.transform(F.slice(F.split(F.trim(p), r"\s+"), 1, 2), lambda v: v.try_cast("double")))
    # a ring that opens with two brackets or more is an outer one, others are holes
    parts = F.transform(F.filter(spelled, lambda s: s.rlike("[0-9]")), lambda s: F.struct(part(s).alias("p"), s.startswith("((").alias("outer")))
    out = df.withColumn("wkt", wkt).withColumn("kind", kind).withColumn("__parts", parts)
    pieces = lambda r: F.transform(F.sequence(F.lit(1), F.greatest(F.size(r["p"]) - 1, F.lit(1))), lambda i: F.struct(F.element_at(r["p"], i).alias("a"), F.element_at(r["p"], F.least(i + 1, F.size(r["p"]))).alias("b")))
    length = lambda e: F.sqrt(F.pow(e["a"][0] - e["b"][0], F.lit(2.0)) + F.pow(e["a"][1] - e["b"][1], F.lit(2.0)))
    cross = lambda e: e["a"][0] * e["b"][1] - e["b"][0] * e["a"][1]
    added = lambda items, f: F.aggregate(items, F.lit(0.0), lambda acc, e: acc + f(e))

    def over_rings(f) -> Column:
        """Sums over outer rings less those over holes, whichever way the rings turn."""
        turned = lambda r: F.when(added(pieces(r), cross) < 0, -1.0).otherwise(1.0) * F.when(r["outer"], 1.0).otherwise(-1.0)
        return F.aggregate("__parts", F.lit(0.0), lambda acc, r: acc + turned(r) * added(pieces(r), f))

    over_lines = lambda f: F.aggregate("__parts", F.lit(0.0), lambda acc, r: acc + added(pieces(r), f))
    every = F.flatten(F.transform("__parts", lambda r: r["p"]))
    where = []
    for k in (0, 1):
        point = F.try_divide(added(every, lambda p: p[k]), F.size(every).cast("double"))  # noqa: B023
        line = F.try_divide(over_lines(lambda e: length(e) * (e["a"][k] + e["b"][k]) / 2), over_lines(length))  # noqa: B023
        poly = F.try_divide(over_rings(lambda e: cross(e) * (e["a"][k] + e["b"][k])), 3 * over_rings(cross))  # noqa: B023
        where.append(F.when(kind.contains("POLYGON"), F.coalesce(poly, point)).when(kind.contains("LINE"), F.coalesce(line, point)).otherwise(point))
    keep = [c for c in df.columns if c not in ("x", "y", "wkt", "kind")]
    return out.select(*(F.col(f"`{c}`") for c in keep), "wkt", "kind", where[0].alias("x"), where[1].alias("y"))


def xy_fields(df: DataFrame) -> tuple[str, str] | None:
    """Two numeric columns whose names differ by x and y."""
    numeric = {n.lower(): n for n, t in df.dtypes if t in ("int", "bigint", "double", "float")}
    for low, name in numeric.items():
        for k, ch in enumerate(low):
            if ch == "x" and (other := numeric.get(low[:k] + "y" + low[k + 1 :])):
                return name, other
    for a, b in (("lon", "lat"), ("longitude", "latitude"), ("easting", "northing")):
        if a in numeric and b in numeric:
            return numeric[a], numeric[b]
    return None
