"""Symbol indexes: a protobuf reader for the wire format, flat tables of the index, and their resolution by joins.

Read: the tool, documents, occurrences (three encodings of a range), symbol information and relationships. A symbol is
`scheme manager name version descriptor`; local symbols belong to one document and are left out. Where scopes of a
document share a symbol, each definition is an entity of its own, and nothing refers to any of them.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.identity import EXTERNAL, canonical_id
from ..operators.ordinals import numbered
from .contract import Cohort, ExtractionError, Normalized, Provider, evidence_of
from .scopes import NESTED, PLACES, Source, nested

DEFINITION, IMPORT, READ = 1, 2, 8
FAMILY_GAP = 25
# Kinds of the index format that name a type of entity; others go by the descriptor's last mark.
KINDS = {
    "INTERFACE": (21, 42, 53, 56), "CLASS": (7, 49, 11, 59, 33, 75, 85, 84, 54, 55, 3), "NAMESPACE": (30,), "MODULE": (29, 35, 36, 64), "FUNCTION": (17, 25),
    "METHOD": (26, 66, 9, 80, 76, 69, 74, 67, 68, 70, 71, 18, 45, 72, 34, 47), "VARIABLE": (61, 15, 41, 79, 81, 82, 77, 78, 13, 8, 12), "FILE": (16,),
}
# Names of the kinds, by number.
KIND_NAMES = (
    "UnspecifiedKind Array Assertion AssociatedType Attribute Axiom Boolean Class Constant Constructor DataFamily Enum EnumMember Event Fact Field File Function Getter Grammar Instance Interface Key Lang Lemma Macro "
    "Method MethodReceiver Message Module Namespace Null Number Object Operator Package PackageObject Parameter ParameterLabel Pattern Predicate Property Protocol Quasiquoter SelfParameter Setter Signature Subscript "
    "String Struct Tactic Theorem ThisParameter Trait Type TypeAlias TypeClass TypeFamily TypeParameter Union Value Variable Contract Error Library Modifier AbstractMethod MethodSpecification ProtocolMethod "
    "PureVirtualMethod TraitMethod TypeClassMethod Accessor Delegate MethodAlias SingletonClass SingletonMethod StaticDataMember StaticEvent StaticField StaticMethod StaticProperty StaticVariable - Extension Mixin Concept"
).split()


def fields(data: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    """(field, wire type, value) of a message; a malformed one is an error."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            if at >= len(data):
                raise ValueError("the message ends inside a number")
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if not byte & 128:
                return value
            shift += 7
            if shift > 63:
                raise ValueError("a number has more than 64 bits")

    while at < len(data):
        tag = varint()
        field, wire = tag >> 3, tag & 7
        if not field:
            raise ValueError("field 0")
        if wire == 0:
            yield field, wire, varint()
            continue
        size = varint() if wire == 2 else {1: 8, 5: 4}.get(wire)
        if size is None:
            raise ValueError(f"wire type {wire}")
        if at + size > len(data):
            raise ValueError("the message ends inside a field")
        raw = data[at : at + size]
        at += size
        yield field, wire, raw if wire == 2 else struct.unpack("<Q" if wire == 1 else "<I", raw)[0]


def packed(data: bytes) -> list[int]:
    out, value, shift = [], 0, 0
    for byte in data:
        value |= (byte & 127) << shift
        shift += 7
        if not byte & 128:
            out.append(value)
            value = shift = 0
    if shift:
        raise ValueError("the message ends inside a number")
    return out


def _range(m: dict[int, list]) -> tuple | None:
    """(first line, first column, last line, last column) of an occurrence: a message of four numbers, of three on one line, or packed ones."""
    if 9 in m or 8 in m:
        numbers = {f: v[-1][1] for f, v in _message(m[9 if 9 in m else 8][-1][1]).items()}
        values = [numbers.get(f, 0) for f in range(1, 5 if 9 in m else 4)]
    elif 1 in m:
        values = _numbers(m[1])
    else:
        return None
    if len(values) == 3:
        return values[0], values[1], values[0], values[2]
    if len(values) != 4:
        raise ValueError(f"a range of {len(values)} numbers")
    return tuple(values)


def _message(data: bytes) -> dict[int, list]:
    out: dict[int, list] = {}
    for field, wire, value in fields(data):
        out.setdefault(field, []).append((wire, value))
    return out


def _numbers(items: list) -> list[int]:
    return [x for wire, v in items for x in (packed(v) if wire == 2 else [v])]


def _text(m: dict[int, list], field: int, needed: bool = False) -> str:
    if field not in m:
        if needed:
            raise ValueError(f"field {field} is missing")
        return ""
    return m[field][-1][1].decode()


def _number(m: dict[int, list], field: int) -> int:
    return m[field][-1][1] if field in m else 0


def read_tool(data: bytes) -> str:
    """name@version of the program that made an index; `unknown` where it gives no name."""
    for _, raw in _message(data).get(1, [])[-1:]:
        for _, tool in _message(raw).get(2, [])[-1:]:
            m = _message(tool)
            if _text(m, 1):
                return f"{_text(m, 1)}@{_text(m, 2)}"
    return "unknown"


def read_index(data: bytes, root: str | Path | None = None) -> tuple[list, list, list, list]:
    """Rows of documents (path), occurrences (path, symbol, roles, range, indent, declares), symbols (path, symbol, kind, nth) and relationships (symbol, other, reference, implementation, type).

    indent and declares tell the source line of an occurrence, where root has it.
    """
    if not data:
        raise ValueError("the index is empty")
    documents, occurrences, symbols, relations = [], [], [], []
    for _, raw in _message(data).get(2, []):
        document = _message(raw)
        path = _text(document, 1, needed=True)
        documents.append((path,))
        source = Source(root, path)
        for _, o in document.get(2, []):
            m = _message(o)
            at = _range(m)
            occurrences.append((path, _text(m, 2), _number(m, 3), at, source.indent(*at[:2]) if at else None, bool(at and source.declares(*at[:2]))))
        for _, s in document.get(3, []):
            m = _message(s)
            symbols.append((path, _text(m, 1, needed=True), _number(m, 5), len(symbols)))
            for _, r in m.get(4, []):
                x = _message(r)
                relations.append((_text(m, 1), _text(x, 1, needed=True), bool(_number(x, 2)), bool(_number(x, 3)), bool(_number(x, 4))))
    return documents, occurrences, symbols, relations


RANGE = "struct<line:int,column:int,end_line:int,end_column:int>"


def tables(spark: SparkSession, data: bytes, root: str | Path | None = None) -> dict[str, DataFrame]:
    d, o, s, r = read_index(data, root)
    return {
        "documents": spark.createDataFrame(d, "path string"),
        "occurrences": spark.createDataFrame(o, f"path string, symbol string, roles int, range {RANGE}, indent int, declares boolean"),
        "symbols": spark.createDataFrame(s, "path string, symbol string, kind int, nth int"),
        "relationships": spark.createDataFrame(r, "symbol string, other string, reference boolean, implementation boolean, type boolean"),
    }


def is_local(symbol: Column) -> Column:
    return (symbol == "local") | symbol.startswith("local ")


def parsed(symbol: Column) -> Column:
    """(manager, package, version, descriptor) of a symbol, `.` for nothing; null of one that has no five parts."""
    parts = F.split(symbol, " ", 5)
    part = lambda i: F.when(F.get(parts, i) == ".", "").otherwise(F.get(parts, i))
    return F.when((F.size(parts) == 5) & ~is_local(symbol), F.struct(part(1).alias("manager"), part(2).alias("package"), part(3).alias("version"), F.get(parts, 4).alias("descriptor")))


def base_type(kind: Column, symbol: Column) -> Column:
    out = F
    for name, kinds in KINDS.items():
        out = out.when(kind.isin(*kinds), name)
    last = F.substring_index(symbol, "/", -1)
    return (
        out.when(symbol.endswith("/"), "FILE").when(last.endswith(")"), None).when(last.endswith("()."), F.when(symbol.contains("#"), "METHOD").otherwise("FUNCTION"))
        .when(last.endswith("#"), "CLASS").when(last.endswith("."), "VARIABLE").when(last.endswith(":"), "MODULE")
    )


def kind_role(kind: Column) -> Column:
    names = F.array(*map(F.lit, KIND_NAMES))
    name = F.try_element_at(names, kind + 1)
    return F.when(kind == 0, None).otherwise(F.concat(F.lit("scip:"), F.when(name.isNull() | (name == "-"), F.concat(F.lit("kind-"), kind.cast("string"))).otherwise(name)))


def definitions(t: dict[str, DataFrame]) -> DataFrame:
    """path, symbol, range, family: where each symbol of a document is defined.

    A symbol with several records of information in a document is defined again: from its first definition on, the
    last occurrence of a run of which none lies more than FAMILY_GAP lines after the one before.
    """
    defined = t["occurrences"].where((F.col("roles").bitwiseAND(DEFINITION) != 0) & ~is_local(F.col("symbol")) & (F.col("symbol") != ""))
    again = t["symbols"].groupBy("path", "symbol").agg(F.count("*").alias("records")).where("records > 1").select("path", "symbol")
    seen = t["occurrences"].where((F.col("roles").bitwiseAND(DEFINITION | READ) != 0) & F.col("range").isNotNull() & ~F.col("symbol").endswith(")")).join(again, ["path", "symbol"], "left_semi")
    order = Window.partitionBy("path", "symbol").orderBy("range")
    is_def = F.col("roles").bitwiseAND(DEFINITION) != 0
    after = seen.withColumn("anchor", F.min(F.when(is_def, F.col("range"))).over(Window.partitionBy("path", "symbol"))).where("range >= anchor")
    gap = F.coalesce((F.col("range.line") - F.lag("range.line").over(order) > FAMILY_GAP).cast("int"), F.lit(0))
    family = after.withColumn("gap", gap).withColumn("island", F.sum("gap").over(order))
    last = family.where("island = 0").groupBy("path", "symbol").agg(F.max("range").alias("last"), F.min("anchor").alias("anchor")).where("last > anchor")
    first = defined.groupBy("path", "symbol").agg(F.min("range").alias("range"))
    return first.join(last.select("path", "symbol", "last"), ["path", "symbol"], "left").select("path", "symbol", F.coalesce("last", "range").alias("range"), F.col("last").isNotNull().alias("family"))


def nested_definitions(t: dict[str, DataFrame]) -> DataFrame:
    """NESTED: one row for each scope of a symbol that several scopes of a document define; a document is one task's."""
    symbol, defines = F.col("symbol"), F.col("roles").bitwiseAND(DEFINITION) != 0
    opens = (symbol.endswith("().") | symbol.endswith("#")) & (defines | F.col("declares"))
    rows = t["occurrences"].where((symbol != "") & ~is_local(symbol) & F.col("range").isNotNull()).withColumns({"descriptor": parsed(symbol)["descriptor"], "opens": opens, "defines": defines & ~symbol.endswith(")")})
    rows = rows.where("opens OR defines").select("*", "range.*").select(*(c.split()[0] for c in PLACES.split(", ")))
    return rows.groupBy("path").applyInPandas(nested, NESTED)


def resolved(t: dict[str, DataFrame], repository) -> DataFrame:
    """symbol, id, base_type, qualified_name, revision, inferred of every symbol that names an entity.

    Defined here: by its descriptor. Named by a relation or reference alone: as here where its version is this revision
    and its module a file of the index; else the library of its package.
    """
    local = t["symbols"].select("symbol").union(definitions(t).select("symbol")).distinct().withColumn("here", F.lit(True))
    kinds = t["symbols"].groupBy("symbol").agg(F.min_by("kind", "nth").alias("kind"))
    named = t["occurrences"].select("symbol").union(t["symbols"].select("symbol")).union(t["relationships"].select("other")).where(F.col("symbol") != "").distinct()
    rows = named.join(local, "symbol", "left").join(kinds, "symbol", "left").withColumn("p", parsed(F.col("symbol"))).where("p IS NOT NULL")
    dotted = F.replace(F.regexp_extract(F.col("p.descriptor"), "^`([^`]+)`", 1), F.lit("."), F.lit("/"))
    files = t["documents"].select(F.col("path").alias("file"), F.lit(True).alias("indexed")).distinct()
    rows = rows.withColumn("flat", F.concat(dotted, F.lit(".py"))).withColumn("package", F.concat(dotted, F.lit("/__init__.py")))
    for column in ("flat", "package"):
        rows = rows.join(files.select(F.col("file").alias(column), F.col("indexed").alias(f"{column}_there")), column, "left")
    kind = base_type(F.coalesce("kind", F.lit(0)), F.col("symbol"))
    inferred = F.col("here").isNull() & (F.col("p.version") == repository.head_revision) & (F.coalesce("flat_there", "package_there", F.lit(False))) & kind.isNotNull()
    own = F.coalesce("here", F.lit(False)) | inferred
    path = F.when(kind == "FILE", F.replace(F.regexp_replace("p.descriptor", "/$", ""), F.lit("`"), F.lit(""))).otherwise(F.col("p.descriptor"))
    library = F.concat(F.col("p.manager"), F.lit(":"), F.col("p.package"), F.lit("@"), F.col("p.version"))
    rows = rows.select("symbol", F.when(own, kind).otherwise("EXTERNAL_LIBRARY").alias("base_type"), F.when(own, path).otherwise(library).alias("qualified_name"), F.when(own, F.lit(repository.head_revision)).otherwise(EXTERNAL).alias("revision"), inferred.alias("inferred"), F.coalesce("kind", F.lit(0)).alias("kind")).where("base_type IS NOT NULL")
    return rows.withColumn("id", canonical_id(F.lit(repository.repository_id), F.col("revision"), F.col("base_type"), F.col("qualified_name")))


class SymbolIndexProvider(Provider):
    name, capabilities = "symbols", ("SYMBOL_DEFINITION", "SYMBOL_REFERENCE", "IMPLEMENTATION", "TYPE_RELATIONSHIP")

    def __init__(self, file: str = "index.scip"):
        self.file = file

    def eligible(self, repository) -> bool:
        return (Path(repository.path) / self.file).is_file()

    def extract(self, spark, repository, capabilities):
        try:
            data = (Path(repository.path) / self.file).read_bytes()
            payload, self.version = tables(spark, data, repository.path), read_tool(data)
        except (OSError, ValueError, UnicodeDecodeError, AttributeError, TypeError) as e:  # the last two: a field of another wire type
            raise ExtractionError(self.name, "UNAVAILABLE", f"{self.file}: {e}") from e
        return Cohort(self.name, self.version, repository.head_revision, [c for c in self.capabilities if c in capabilities]), payload

    def normalize(self, spark, repository, cohort, payload):
        from ..storage import keep

        t, names, apart = payload, keep(resolved(payload, repository)), keep(nested_definitions(payload))
        # Which of several scopes a reference means cannot be told: it is left out.
        sure = names.join(apart.select("symbol").distinct(), "symbol", "left_anti")
        file_id = canonical_id(F.lit(repository.repository_id), F.lit(repository.head_revision), F.lit("FILE"), F.col("path"))
        is_import = F.col("roles").bitwiseAND(IMPORT) != 0
        uses = t["occurrences"].where((F.col("roles").bitwiseAND(DEFINITION) == 0) & (F.col("symbol") != "") & ~is_local(F.col("symbol"))).select("path", "symbol", is_import.alias("imports")).distinct()
        uses = uses.where(F.lit(cohort.supports("SYMBOL_REFERENCE")))
        links = uses.join(sure.select("symbol", F.col("id").alias("object")), "symbol").select(file_id.alias("subject"), F.when(F.col("imports"), "IMPORTS").otherwise("REFERENCES").alias("predicate"), "object", F.lit("reference").alias("tag"))
        ends = t["relationships"].join(sure.select("symbol", F.col("id").alias("subject")), "symbol").join(sure.select(F.col("symbol").alias("other"), F.col("id").alias("object")), "other")
        for flag, predicate, tag, capability in (("implementation", "IMPLEMENTS", "implementation", "IMPLEMENTATION"), ("type", "REFERENCES", "type", "TYPE_RELATIONSHIP")):
            told = ends.where(F.col(flag) & F.lit(cohort.supports(capability)))
            links = links.unionByName(told.select("subject", F.lit(predicate).alias("predicate"), "object", F.lit(tag).alias("tag")).distinct())
        links = numbered(links, ["tag", "subject", "predicate", "object"], "nth")
        facts = links.select(F.concat(F.lit(f"symbols:{repository.head_revision}:"), "tag", F.lit(":"), F.col("nth").cast("string")).alias("evidence_id"), "subject", "predicate", "object", F.lit(1.0).alias("confidence"), F.lit(None).cast("string").alias("raw_reference"))
        files = uses.select(file_id.alias("id"), F.lit(repository.head_revision).alias("revision"), F.lit("FILE").alias("base_type"), F.col("path").alias("qualified_name"), F.array().cast("array<string>").alias("roles"), F.lit(None).cast(_location_type()).alias("at")).distinct()
        found = self._defined(t, names, sure, apart, repository) if cohort.supports("SYMBOL_DEFINITION") else files.limit(0)
        inferred = F.array_compact(F.array(F.when(F.col("inferred"), F.lit("scip:inferred-from-relationship-only"))))
        named = links.select(F.col("object").alias("id")).union(links.where("tag != 'reference'").select("subject")).distinct()
        other = sure.dropDuplicates(["id"]).join(named, "id", "left_semi").select("id", "revision", "base_type", "qualified_name", inferred.alias("roles"), F.lit(None).cast(_location_type()).alias("at"))
        rows = found.unionByName(other.unionByName(files).join(found.select("id"), "id", "left_anti"))
        name = F.coalesce(F.nullif(F.substring_index("qualified_name", "/", -1), F.lit("")), "qualified_name")
        rows = rows.select(F.col("id").alias("canonical_id"), F.col("revision").alias("repository_revision"), name.alias("name"), "qualified_name", "base_type", "roles", F.col("at").alias("source_location"))
        entities = rows.withColumns({"repository_id": F.lit(repository.repository_id), "language": F.lit(None).cast("string"), "lifecycle_status": F.lit("ACTIVE"), "provider_ids": F.create_map(F.lit(self.name), F.col("name")), "ordinal": F.lit(0)})
        return Normalized(entities, evidence_of(cohort, facts), cohort)

    def _defined(self, t, names, sure, apart, repository) -> DataFrame:
        """One row an entity that is defined here: the first place that its symbol, or its scope, gives."""
        place = F.struct("range.line", "range.column", "range.end_line", "range.end_column").alias("place")
        plain = definitions(t).select("path", "symbol", place, "family", F.col("range").isNull().alias("nowhere")).join(sure, "symbol").withColumn("scoped", F.lit(False))
        own = F.struct("line", "column", "end_line", "end_column").alias("place")
        scoped = apart.select("path", "symbol", "qualifier", own).join(names, "symbol")
        whole = F.when(F.col("qualifier").isNull(), F.col("qualified_name")).otherwise(F.concat(F.rtrim("qualifier", F.lit(".")), F.lit(".<locals>."), F.substring_index("qualified_name", "/", -1)))
        scoped = scoped.withColumn("qualified_name", whole).withColumn("id", canonical_id(F.lit(repository.repository_id), F.col("revision"), F.col("base_type"), F.col("qualified_name")))
        scoped = scoped.drop("qualifier").withColumns({"family": F.lit(False), "nowhere": F.lit(False), "scoped": F.lit(True)})
        row = F.struct("nowhere", "path", "place", "symbol", "family", "scoped", "kind", "revision", "base_type", "qualified_name")
        first = plain.drop("inferred").unionByName(scoped.drop("inferred")).groupBy("id").agg(F.min(row).alias("row")).select("id", "row.*")
        at = F.when(~F.col("nowhere"), F.struct(F.col("path").alias("file_path"), F.col("place.line").alias("start_line"), F.col("place.end_line").alias("end_line"), F.col("place.column").alias("start_column"), F.col("place.end_column").alias("end_column")))
        roles = F.array_compact(F.array(kind_role(F.col("kind")), F.when(F.col("family"), F.lit("scip:redefinition-family")), F.when(F.col("scoped"), F.lit("scip:nested-scope-disambiguated"))))
        return first.select("id", "revision", "base_type", "qualified_name", roles.alias("roles"), at.alias("at"))


def _location_type() -> str:
    return "struct<file_path:string,start_line:int,end_line:int,start_column:int,end_column:int>"
