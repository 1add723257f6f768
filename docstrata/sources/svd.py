"""Register descriptions in XML (S13, S14, F9-F17): four tables, and Markdown made of them."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ParseError
from ..functions.registers import DASH, access_code, bit_range, field_reset, hex_format, parse_int
from ..functions.text import content_hash, make_doc_id, stem, strip
from ..session import scratch
from .files import LIMITS

#: One row a device, nested; all numbers as written.
DEVICE = (
    "path string, name string, description string, cpu string, revision string, error string, peripherals array<struct<pos:int,name:string,description:string,base:string,"
    "derived:string,registers:array<struct<pos:int,name:string,description:string,offset:string,size:string,access:string,reset:string,"
    "fields:array<struct<pos:int,name:string,description:string,offset:string,width:string,access:string>>>>>>"
)
HEAD = 65_536


def _text(e: ET.Element, tag: str) -> str | None:
    found = e.find(tag)
    return found.text.strip() if found is not None and found.text is not None else None


def _number(text: str | None) -> int | None:
    try:
        return int(text, 0) if text else None
    except ValueError:
        return int(text) if text.isdigit() else None


def _copies(e: ET.Element) -> Iterator[tuple[str, int]]:
    """Suffix and offset of each copy that an element with a dimension stands for; one of it without."""
    n, step = _number(_text(e, "dim")) or 0, _number(_text(e, "dimIncrement")) or 0
    if not n:
        yield "", 0
        return
    index = _text(e, "dimIndex") or ""
    names = [x.strip() for x in index.split(",")] if "," in index else [str(i) for i in range(n)]
    if "-" in index and "," not in index:
        a, b = (x.strip() for x in index.split("-", 1))
        names = [str(i) for i in range(int(a), int(b) + 1)] if a.isdigit() and b.isdigit() else [chr(c) for c in range(ord(a[0]), ord(b[0]) + 1)]
    for i in range(n):
        yield (names[i] if i < len(names) else str(i)), i * step


def _named(name: str | None, suffix: str) -> str | None:
    return name.replace("[%s]", suffix).replace("%s", suffix) if name else name


def _fields(e: ET.Element, inherited: dict) -> list[dict]:
    out = []
    for f in e.iterfind("fields/field"):
        offset, width, span = _text(f, "bitOffset"), _text(f, "bitWidth"), _text(f, "bitRange")
        low, high = (_text(f, "lsb"), _text(f, "msb")) if not span else reversed(span.strip("[]").split(":"))
        if offset is None and low is not None and high is not None:
            offset, width = low, str((_number(high) or 0) - (_number(low) or 0) + 1)
        for suffix, by in _copies(f):
            at = offset if not by or _number(offset) is None else str(_number(offset) + by)
            out.append({"pos": len(out), "name": _named(_text(f, "name"), suffix), "description": _text(f, "description"), "offset": at, "width": width, "access": _text(f, "access") or inherited["access"]})
    return out


def _registers(e: ET.Element, base: int, prefix: str, inherited: dict) -> Iterator[dict]:
    """plain registers of a peripheral or cluster, copies and nested clusters included."""
    own = {k: _text(e, t) or inherited[k] for k, t in (("size", "size"), ("access", "access"), ("reset", "resetValue"))}
    parts = e.find("registers") if e.tag == "peripheral" else e
    for x in parts if parts is not None else ():
        if x.tag not in ("register", "cluster"):
            continue
        for suffix, by in _copies(x):
            name, at = _named(_text(x, "name"), suffix), _number(_text(x, "addressOffset"))
            if x.tag == "cluster":
                yield from _registers(x, base + (at or 0) + by, f"{prefix}{name}_", own)
            else:
                mine = {k: _text(x, t) or own[k] for k, t in (("size", "size"), ("access", "access"), ("reset", "resetValue"))}
                yield {"name": f"{prefix}{name}", "description": _text(x, "description"), "offset": None if at is None else str(base + at + by), **mine, "fields": _fields(x, mine)}


class _Rows:
    """Registers as columns, which become Arrow arrays a few thousand at a time, so that no file is held as objects."""

    COLUMNS = ("name", "description", "offset", "size", "access", "reset")
    FIELDS = ("pos", "name", "description", "offset", "width", "access")
    MOST = 5_000

    def __init__(self, kind: pa.ListType):
        self.kind = kind.value_type
        self.n, self.made = 0, []
        self._start()

    def _start(self) -> None:
        self.columns, self.fields, self.ends = {k: [] for k in self.COLUMNS}, {k: [] for k in self.FIELDS}, [0]

    def add(self, register: dict) -> None:
        for k, column in self.columns.items():
            column.append(register[k])
        for f in register["fields"]:
            for k, column in self.fields.items():
                column.append(f[k])
        self.ends.append(len(self.fields["pos"]))
        if len(self.ends) > self.MOST:
            self._flush()

    def _flush(self) -> None:
        listed = self.kind.field("fields").type
        inner = pa.StructArray.from_arrays([pa.array(self.fields[f.name], f.type) for f in listed.value_type], fields=list(listed.value_type))
        fields = pa.ListArray.from_arrays(pa.array(self.ends, pa.int32()), inner, type=listed)
        n = len(self.ends) - 1
        own = {k: pa.array(v, pa.string()) for k, v in self.columns.items()} | {"pos": pa.array(range(self.n, self.n + n), pa.int32()), "fields": fields}
        self.made.append(pa.StructArray.from_arrays([own[f.name] for f in self.kind], fields=list(self.kind)))
        self.n += n
        self._start()

    def whole(self, inherited: dict) -> pa.StructArray:
        """All registers; what they and their clusters do not say is the peripheral's or device's."""
        self._flush()
        filled = lambda c, k: c if inherited[k] is None else c.fill_null(inherited[k])
        out = []
        for a in self.made:
            columns = {f.name: a.field(f.name) for f in self.kind}
            listed = columns["fields"]
            kind = listed.type.value_type
            inner = pa.StructArray.from_arrays([filled(listed.values.field(f.name), "access") if f.name == "access" else listed.values.field(f.name) for f in kind], fields=list(kind))
            columns |= {k: filled(columns[k], k) for k in ("size", "access", "reset")} | {"fields": pa.ListArray.from_arrays(listed.offsets, inner, type=listed.type)}
            out.append(pa.StructArray.from_arrays([columns[f.name] for f in self.kind], fields=list(self.kind)))
        return pa.concat_arrays(out)


_GIVEN = (("size", "size"), ("access", "access"), ("reset", "resetValue"))


def _parsed(source, kind: pa.StructType) -> tuple[ET.Element, list[dict]]:
    """The root without its peripherals, and these, read in one pass: each register or cluster goes once it has been read."""
    above: list[ET.Element] = []
    found, rows, first = [], None, None
    root = None
    for event, e in ET.iterparse(source, ("start", "end")):
        if event == "start":
            above.append(e)
            if root is None:
                root = e
            if len(above) == 3 and e.tag == "peripheral":
                rows, first = _Rows(kind.field("registers").type), None
            elif len(above) == 4 and e.tag == "registers" and first is None:
                first = e
            continue
        above.pop()
        if [x.tag for x in above[:3]] != ["device", "peripherals", "peripheral"][: len(above)]:
            continue
        if len(above) == 4 and above[3].tag == "registers":
            if above[3] is first and e.tag in ("register", "cluster"):
                one = ET.Element("registers")
                one.append(e)
                for r in _registers(one, 0, "", dict.fromkeys(k for k, _ in _GIVEN)):
                    rows.add(r)
            above[3].remove(e)
        elif len(above) == 2 and e.tag == "peripheral":
            base = _text(e, "baseAddress")
            own = {k: _text(e, t) for k, t in _GIVEN}
            for suffix, by in _copies(e):
                at = base if not by else str((_number(base) or 0) + by)
                found.append({"name": _named(_text(e, "name"), suffix), "description": _text(e, "description"), "base": at, "derived": e.get("derivedFrom"), "rows": rows, "own": own})
            above[1].remove(e)
    return root, found


def read_device(path: str, content, kind: pa.Schema) -> pa.RecordBatch:
    """One file (a buffer or null) as a row; the error in place of the device if it is no safe or whole description."""
    peripheral = kind.field("peripherals").type.value_type

    def row(name=None, description=None, cpu=None, revision=None, error=None, peripherals=None) -> pa.RecordBatch:
        of = {"path": path, "name": name, "description": description, "cpu": cpu, "revision": revision, "error": error}
        inner = peripherals if peripherals is not None else pa.array([], peripheral)
        whole = pa.ListArray.from_arrays(pa.array([0, len(inner)], pa.int32()), inner, type=kind.field("peripherals").type)
        return pa.RecordBatch.from_arrays([whole if f.name == "peripherals" else pa.array([of[f.name]], f.type) for f in kind], schema=kind)

    if content is None:
        return row(error="ParseError: too large")
    head = content.slice(0, min(HEAD, content.size)).to_pybytes().decode("utf-8", "ignore")
    if "<!DOCTYPE" in head or "<!ENTITY" in head:
        return row(error="ParseError: document types and entities are not allowed")
    try:
        device, found = _parsed(pa.BufferReader(content), peripheral)
    except ET.ParseError as e:
        return row(error=f"ParseError: {e}")
    if device.tag != "device":
        return row(error="ParseError: no device")
    inherited = {k: _text(device, t) for k, t in _GIVEN}
    made: dict[int, pa.StructArray] = {}
    for p in found:
        if id(p["rows"]) not in made:
            made[id(p["rows"])] = p["rows"].whole({k: p["own"][k] or inherited[k] for k in inherited})
    listed = [made[id(p["rows"])] for p in found]
    ends = [0]
    for x in listed:
        ends.append(ends[-1] + len(x))
    registers = peripheral.field("registers").type
    inner = pa.concat_arrays(listed) if listed else pa.array([], registers.value_type)
    columns = {k: pa.array([p[k] for p in found], pa.string()) for k in ("name", "description", "base", "derived")}
    columns |= {"pos": pa.array(range(len(found)), pa.int32()), "registers": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), inner, type=registers)}
    whole = pa.StructArray.from_arrays([columns[f.name] for f in peripheral], fields=list(peripheral))
    return row(_text(device, "name"), _text(device, "description"), _text(device, "cpu/name"), _text(device, "cpu/revision"), None, whole)


def read_devices(files: DataFrame) -> DataFrame:
    """A row for each file of (path, length, content); a task holds one file at a time, as Arrow arrays."""
    kinds = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(kinds)
        for b in batches:
            for p, c in zip(*b.columns):
                yield read_device(p.as_py(), c.as_buffer(), schema)

    from pyspark.sql.types import StructType

    kinds = StructType.fromDDL(DEVICE)
    content = F.when(F.col("length") <= LIMITS["svd"], F.col("content"))
    return files.select("path", content.alias("content")).mapInArrow(run, kinds)


def _once(devices: DataFrame) -> DataFrame:
    """Devices as a table in the shared folder, so that files are parsed once however often they are read."""
    where = scratch(devices.sparkSession, "devices")
    devices.write.parquet(where)
    return devices.sparkSession.read.schema(devices.schema).parquet(where)


def peripheral_type():
    """Type of a device's peripherals, without the array."""
    from pyspark.sql.types import StructType

    return StructType.fromDDL(DEVICE)["peripherals"].dataType.elementType


def _sources(p: DataFrame) -> DataFrame:
    """(path, pos, d_at, r_at): where a derived peripheral's description and registers stand, itself or the nearest that it derives from.

    Narrow rows, of those that derive and of their bases, follow their links and the links of
    those, so the way that is left halves in each round; each is written before
    the next. Links that are left once as many have been followed as any file has
    peripherals go in a circle, which is an error.
    """
    spark = p.sparkSession
    rows = p.select("path", "pos", "name", "derived", F.when(F.col("description").isNotNull(), F.col("pos")).alias("d_at"), F.when(F.size("registers") > 0, F.col("pos")).alias("r_at"))
    first = rows.groupBy("path", F.col("name").alias("derived")).agg(F.min("pos").alias("next"))
    nodes = rows.join(first, ["path", "derived"], "left").select("path", "pos", "d_at", "r_at", "next")
    where, n, most = scratch(spark, "derived"), 0, None
    while True:
        at = f"{where}-{n}"
        nodes.write.parquet(at)
        nodes = spark.read.schema(nodes.schema).parquet(at)
        left = nodes.where("next is not null").select("path").limit(1).collect()
        if not left:
            return nodes.drop("next")
        most = most or nodes.groupBy("path").count().agg(F.max("count")).first()[0]
        if 2**n > most:
            raise ParseError(f"{left[0]['path']}: peripherals derive from one another in a circle")
        further = nodes.select("path", F.col("pos").alias("next"), F.col("d_at").alias("_d"), F.col("r_at").alias("_r"), F.col("next").alias("_next"))
        nodes = nodes.join(further, ["path", "next"], "left").select("path", "pos", F.coalesce("d_at", "_d").alias("d_at"), F.coalesce("r_at", "_r").alias("r_at"), F.col("_next").alias("next"))
        n += 1


def peripheral_table(devices: DataFrame) -> DataFrame:
    """Peripherals with what a derived one takes from its base filled in (F17), along chains of any length.

    The files are parsed once, into a table in the shared folder. Of several
    peripherals of a name the first is the base; one that derives from none that is there keeps what it has.
    Only derived peripherals take part in joins.
    """
    return _filled(_once(devices))


def _filled(devices: DataFrame) -> DataFrame:
    """:func:`peripheral_table` of devices that are written."""
    p = devices.select(F.coalesce("name", stem(F.col("path"))).alias("chip"), "path", F.explode("peripherals").alias("p")).select("chip", "path", "p.*")
    base = p.select("path", "pos", "description", "registers")
    told, held = (base.select("path", F.col("pos").alias(k), F.col(c).alias(f"_{c}")) for k, c in (("d_at", "description"), ("r_at", "registers")))
    own, derived = p.where("derived is null"), p.where("derived is not null")
    filled = derived.join(_sources(p), ["path", "pos"]).join(told, ["path", "d_at"], "left").join(held, ["path", "r_at"], "left")
    filled = filled.withColumns({"description": F.col("_description"), "registers": F.coalesce("_registers", "registers")}).select(*p.columns)
    out = own.unionByName(filled).withColumn("base_address", parse_int(F.col("base"))).withColumnRenamed("derived", "derived_from")
    return out.select("chip", "path", "pos", "name", "description", "derived_from", "registers", "base_address")


def register_table(peripherals: DataFrame) -> DataFrame:
    r = peripherals.select("chip", "path", F.col("name").alias("peripheral"), F.explode("registers").alias("r"))
    return r.select(
        "chip", "path", "peripheral", "r.pos", "r.name", "r.description", parse_int(F.col("r.offset")).alias("address_offset"), parse_int(F.col("r.size")).cast("int").alias("size"),
        "r.access", parse_int(F.col("r.reset")).alias("reset_value"), "r.fields",
    )


def field_table(registers: DataFrame) -> DataFrame:
    f = registers.select("chip", "path", "peripheral", F.col("name").alias("register"), "reset_value", F.explode("fields").alias("f"))
    return f.select(
        "chip", "path", "peripheral", "register", "reset_value", "f.pos", "f.name", "f.description", parse_int(F.col("f.offset")).cast("int").alias("bit_offset"),
        parse_int(F.col("f.width")).cast("int").alias("bit_width"), "f.access",
    )


def _lines(*parts) -> Column:
    return F.concat_ws("\n", *parts)


def _listed(order: list[Column], line: Column, name: str) -> Column:
    """Lines of a group in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*[c.alias(f"o{n}") for n, c in enumerate(order)], line.alias("line")))), lambda x: x["line"]), "\n").alias(name)


def _cell(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit(""))


def render_devices(devices: DataFrame) -> DataFrame:
    """(path, content): a device as Markdown, its peripherals by name, registers by offset, fields from the top bit down."""
    return _rendered(_once(devices))


def _rendered(devices: DataFrame) -> DataFrame:
    peripherals = _filled(devices)
    registers = register_table(peripherals)
    fields = field_table(registers)
    offset, width = F.coalesce("bit_offset", F.lit(0)), F.greatest(F.coalesce(F.nullif("bit_width", F.lit(0)), F.lit(1)), F.lit(1))
    row = F.concat(
        F.lit("| "), F.col("name"), F.lit(" | "), bit_range(offset, width), F.lit(" | "), access_code(F.col("access")), F.lit(" | "),
        field_reset(F.col("reset_value"), offset, width), F.lit(" | "), _cell(F.col("description")), F.lit(" |"),
    )
    tables = fields.groupBy("path", "peripheral", "register").agg(_listed([-(offset + width - 1), F.col("pos")], row, "rows"))
    title = F.concat(F.lit("### "), F.col("register"), F.lit(" Fields\n\n| Field | Bits | Access | Reset | Description |\n|-------|------|--------|-------|-------------|\n"), F.col("rows"), F.lit("\n"))
    tables = tables.select("path", "peripheral", F.col("register").alias("name"), title.alias("fields_text"))
    at = F.coalesce("address_offset", F.lit(0))
    summary = F.concat(
        F.lit("| "), F.col("name"), F.lit(" | "), hex_format(F.col("address_offset"), 4), F.lit(" | "), F.coalesce(F.col("size").cast("string"), F.lit(DASH)), F.lit(" | "),
        access_code(F.col("access")), F.lit(" | "), hex_format(F.col("reset_value"), 8), F.lit(" | "), _cell(F.col("description")), F.lit(" |"),
    )
    joined = registers.drop("fields").join(tables, ["path", "peripheral", "name"], "left")
    detail = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("fields_text").isNotNull(), F.struct(at.alias("o"), F.col("pos").alias("p"), F.col("fields_text").alias("t"))))), lambda x: x["t"]), "\n")
    by_peripheral = joined.groupBy("path", F.col("peripheral").alias("name")).agg(_listed([at, F.col("pos")], summary, "summary"), detail.alias("detail"))
    p = peripherals.drop("registers").join(by_peripheral, ["path", "name"], "left")
    body = F.when(F.col("summary").isNull(), F.lit("*No registers defined.*\n")).otherwise(
        F.concat(F.lit("### Registers\n\n| Register | Offset | Size | Access | Reset | Description |\n|----------|--------|------|--------|-------|-------------|\n"), F.col("summary"), F.lit("\n"), F.when(F.col("detail") != "", F.concat(F.lit("\n"), F.col("detail"))).otherwise(F.lit("")))
    )
    facts = _lines(
        F.when(F.col("base_address").isNotNull(), F.concat(F.lit("**Base Address:** `"), hex_format(F.col("base_address"), 8), F.lit("`"))),
        F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit("**Description:** "), strip(F.col("description")))),
    )
    block = F.concat(F.lit("---\n\n## "), F.col("name"), F.lit("\n\n"), F.when(facts != "", F.concat(facts, F.lit("\n"))).otherwise(""), F.lit("\n"), body)
    text = p.groupBy("path").agg(_listed([F.col("name"), F.col("pos")], block, "all"))
    cpu = F.when(F.col("cpu").isNotNull(), F.concat(F.lit("**CPU:** "), F.col("cpu"), F.coalesce(F.concat(F.lit(", revision "), F.col("revision")), F.lit(""))))
    head = _lines(F.concat(F.lit("# "), F.col("name"), F.lit(" Register Map\n")), F.concat(F.lit("**Device:** "), F.col("name")), F.when(F.col("description").isNotNull(), F.concat(F.lit("**Description:** "), F.col("description"))), cpu, F.lit(""))
    return devices.where("error is null").join(text, "path", "left").select("path", F.concat(head, F.lit("\n"), F.coalesce("all", F.lit("*No peripherals defined.*\n"))).alias("content"))


def parse_files(files: DataFrame) -> DataFrame:
    """S13 as documents."""
    devices = _once(read_devices(files))
    count = F.aggregate("peripherals", F.lit(0), lambda s, p: s + F.size(p["registers"]))
    text = _rendered(devices).withColumnRenamed("content", "_text")
    rows = devices.join(text, "path", "left").join(files.select(F.col("path").alias("_p"), F.col("content").alias("_raw")), F.col("path") == F.col("_p"), "left")
    chip = F.coalesce("name", stem(F.col("path")))
    facts = F.create_map(F.lit("peripheral_count"), F.size("peripherals").cast("string"), F.lit("register_count"), count.cast("string"), F.lit("cpu"), F.coalesce("cpu", F.lit("")))
    return rows.select(
        make_doc_id(F.col("path")).alias("doc_id"), F.coalesce("_text", F.lit("")).alias("content"), F.lit("svd").alias("doc_type"), F.concat(chip, F.lit(" Register Map")).alias("title"),
        F.col("path").alias("source_path"), chip.alias("chip"), facts.alias("metadata"), F.lit("svd").alias("format"), content_hash(F.col("_raw")).alias("hash"), "error",
    )


def first_in_document(rows: DataFrame, key: list[str]) -> DataFrame:
    """Of rows that share a key, the one that comes first in the file."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("pos"))).where("_n = 1").drop("_n")
