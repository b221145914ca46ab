"""Readers: FASTA, flat files, labelled folders, CSV with a schema, and pages of a remote service."""

from __future__ import annotations

import importlib
import logging
import re
import time
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith
from pyspark.sql.types import StructType

from seqlens.operators import relational

FEATURES = "array<struct<type:string,qualifiers:map<string,array<string>>>>"
RECORD = f"accession string, name string, description string, organism string, seq string, comment string, structured_comment map<string,map<string,string>>, features {FEATURES}, reference_titles array<string>"


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """id, description (the whole header), seq, file of every record of the files at path; and the columns that folders are named by."""
    found = spark.read.option("lineSep", "\n>").text(path)
    raw = found.select("value", F.col("_metadata.file_name").alias("file"), *found.columns[1:])
    text = F.regexp_replace("value", "^>", "")
    head = F.regexp_replace(F.regexp_extract(text, r"^([^\n]*)", 1), "\r$", "")
    rows = raw.select(head.alias("description"), F.regexp_replace(F.regexp_replace(text, r"^[^\n]*", ""), r"\s", "").alias("seq"), *raw.columns[1:]).where(F.trim("description") != "")
    return rows.select(F.regexp_extract("description", r"^(\S*)", 1).alias("id"), "description", "seq", *raw.columns[1:])


def read_labelled_folder(spark: SparkSession, path: str, suffix: str = "_filtered", exclude: tuple[str, ...] = ("ST_unassigned",)) -> DataFrame:
    """FASTA files of a folder with label, the file's name without its suffix."""
    rows = read_fasta(spark, f"{path}/*{suffix}.fasta")
    return rows.withColumn("label", F.regexp_extract("file", rf"^(.*){suffix}\.fasta$", 1)).where(~F.col("label").isin(*exclude)).drop("file")


def read_table(spark: SparkSession, path: str, schema: str | StructType, multi_line: bool = True) -> DataFrame:
    """CSV with a header and quoted values; columns are taken by the schema, never guessed. Values may have several lines, for which each file is
    one task's; without multi_line large files are split."""
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", multi_line).csv(path)


_qualifier = re.compile(r'^/(\w+)(?:=(.*))?$', re.S)


def parse_flat(entry: str) -> dict | None:
    """A flat-file entry as a record; None for text that is none."""
    out: dict = {"accession": "", "name": "", "description": "", "organism": "", "seq": "", "comment": "", "structured_comment": {}, "features": [], "reference_titles": []}
    section, block, values = "", "", []
    pending: list[tuple[str, list[str]]] = []

    def close() -> None:
        text = " ".join(v.strip() for v in values).strip()
        if section == "DEFINITION":
            out["description"] = text.rstrip(".")
        elif section == "VERSION" and text:
            out["accession"] = text.split()[0]
        elif section == "ACCESSION" and text and not out["accession"]:
            out["accession"] = text.split()[0]
        elif section == "LOCUS" and text:
            out["name"] = text.split()[0]
        elif section == "ORGANISM" and values:
            out["organism"] = values[0].strip()
        elif section == "TITLE":
            out["reference_titles"].append(text)
        elif section == "COMMENT":
            kept = []
            nonlocal block
            for v in values:
                v = v.strip()
                if m := re.match(r"##(.*)-START##", v):
                    block = m[1]
                    out["structured_comment"][block] = {}
                elif re.match(r"##.*-END##", v):
                    block = ""
                elif block and "::" in v:
                    k, _, x = v.partition("::")
                    out["structured_comment"][block][k.strip()] = x.strip()
                elif not block:
                    kept.append(v)
            out["comment"] = "\n".join(kept).strip()

    for line in entry.split("\n"):
        if section == "FEATURES" and line[:5] == "     ":
            if line[5:6].strip():
                pending.append((line[5:21].strip(), []))
            elif pending and line.strip():
                lines = pending[-1][1]
                text = line.strip()
                if text.startswith("/") and not (lines and lines[-1].count('"') == 1):
                    lines.append(text)
                elif lines:
                    lines[-1] += ("" if lines[-1].startswith("/translation") else " ") + text
            continue
        if section == "ORIGIN" and line[:1] == " ":
            out["seq"] += re.sub(r"[^A-Za-z*-]", "", line).upper()
            continue
        key = line[:12].strip()
        if key and line.strip() != "//":
            close()
            section, values = key, [line[12:]]
        else:
            values.append(line[12:])
    close()
    for kind, lines in pending:
        qualifiers: dict[str, list[str]] = {}
        for text in lines:
            if m := _qualifier.match(text):
                qualifiers.setdefault(m[1], []).append((m[2] or "").strip('"').replace('""', '"'))
        out["features"].append({"type": kind, "qualifiers": qualifiers})
    return out if out["name"] or out["accession"] else None


def read_flat_files(spark: SparkSession, path: str) -> DataFrame:
    """Records of flat files: entries end with a line "//", and each is parsed on its own."""
    entries = spark.read.option("lineSep", "//\n").text(path)
    schema = spark.createDataFrame([], RECORD).schema
    kinds = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [r for t in batch.column(0).to_pylist() if t and (r := parse_flat(t))]
            yield pa.RecordBatch.from_arrays([pa.array([_pairs(r[f.name], f.type) for r in made], f.type) for f in kinds], schema=kinds)

    return entries.mapInArrow(run, schema)


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _pairs(value: object, kind: pa.DataType) -> object:
    """Dicts as lists of pairs where Arrow has a map."""
    if pa.types.is_map(kind):
        return [(k, _pairs(v, kind.item_type)) for k, v in value.items()]
    if pa.types.is_list(kind):
        return [_pairs(v, kind.value_type) for v in value]
    if pa.types.is_struct(kind):
        return {f.name: _pairs(value[f.name], f.type) for f in kind}
    return value


# Predicates of a search, as text for a remote service and as a filter of columns.

#: What a record on the gene must say anywhere, and what its title must not.
GENE_TERMS = ["18S", "SSU", "small subunit", "18S ribosomal", "SSU rRNA", "ribosomal RNA", "rRNA", "rDNA"]
NOT_IN_TITLE = ["whole genome", "complete genome", "WGS", "shotgun", "mitochondrial", "mitochondrion"]
#: Fixed values of the narrow search.
NARROW_TITLE = ["18S", "SSU", "small subunit", "ribosomal RNA", "rRNA", "rDNA"]
NARROW_ANYWHERE = ["18S ribosomal", "SSU rRNA"]


def _terms(terms: list[str], field: str) -> str:
    return " OR ".join(f'"{t}"[{field}]' for t in terms)


def broad_query(genus: str) -> str:
    return f"{genus}[Organism] AND ({_terms(GENE_TERMS, 'All Fields')}) NOT ({_terms(NOT_IN_TITLE, 'Title')})"


def label_titles(label: str) -> list[str]:
    """How titles name a label."""
    n = (re.search(r"\d+", label) or [label])[0]
    if label.startswith("NMAST"):
        n = label.replace("NMAST", "")
        return [f"NMAST{n}", f"non-mammalian avian ST{n}", f"avian subtype {n}"]
    return [f"subtype {n}", f"ST{n}", f"ST {n}"]


def narrow_query(genus: str, label: str) -> str:
    gene = f"{_terms(NARROW_TITLE, 'Title')} OR {_terms(NARROW_ANYWHERE, 'All Fields')}"
    return f"{genus}[Organism] AND ({_terms(label_titles(label), 'Title')}) AND ({gene}) NOT ({_terms(NOT_IN_TITLE[:4], 'Title')})"


def contains_any(c: Column, terms: list[str]) -> Column:
    low = F.lower(c)
    found = F.lit(False)
    for t in terms:
        found = found | F.contains(low, F.lit(t.lower()))
    return found


def matches_broad(anywhere: Column, title: Column, terms: list[str] | None = None, excluded: list[str] | None = None) -> Column:
    """The broad search as a filter, which Catalyst pushes to where the rows come from."""
    return contains_any(anywhere, terms or GENE_TERMS) & ~contains_any(title, excluded or NOT_IN_TITLE)


# Pages of a remote service.


def with_retries(fetch: Callable[[], list], retries: int = 3, wait: Callable[[float], None] = time.sleep) -> list | None:
    """fetch(), tried again after 1, 2, 4 ... seconds; None if all tries fail."""
    for attempt in range(retries + 1):
        try:
            return fetch()
        except Exception:  # noqa: BLE001 - a service may fail in any way; a page that stays away is skipped
            if attempt < retries:
                wait(2.0**attempt)
    return None


def request_interval(key: str | None) -> float:
    """Seconds between requests: a service lets callers with a key ask more often."""
    return 0.11 if key else 0.4


class Pages(InputPartition):
    """Pages that one task asks for, one after the other, from its own first place in the common schedule on."""

    def __init__(self, starts: list[int], size: int, total: int, first: int = 0, step: int = 1, began: float = 0.0):
        self.starts, self.size, self.total, self.first, self.step, self.began = starts, size, total, first, step, began


def told(f: Filter) -> tuple[str, str, object] | None:
    """A filter of one column as (column, operation, value), if a service can be asked so."""
    negated, f = (True, f.child) if isinstance(f, Not) else (False, f)
    names = {EqualTo: "=", In: "in", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", StringContains: "contains", StringStartsWith: "startswith", StringEndsWith: "endswith"}
    if len(getattr(f, "attribute", ())) != 1 or type(f) not in names:
        return None
    return f.attribute[0], ("not " if negated else "") + names[type(f)], f.value


class PagedReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.names = dict(options), [f.name for f in schema]
        self.retries, self.parallel = int(self.options.get("retries", "3")), max(1, int(self.options.get("parallel", "1")))
        self.interval = float(self.options.get("interval", request_interval(self.options.get("apikey"))))
        self.asked: list[tuple[str, str, object]] = []

    def service(self):
        module, _, name = self.options["service"].partition(":")
        made = getattr(importlib.import_module(module), name)(self.options)
        if self.asked:
            made.where(self.asked)
        return made

    def partitions(self) -> list[Pages]:
        size, most = int(self.options.get("batchsize", "100")), int(self.options.get("maxrecords", "10000"))
        counted = with_retries(lambda: [self.service().count()], self.retries)
        if counted is None:
            raise OSError("the service doesn't tell its number of records")
        if counted[0] > most:
            logging.getLogger(__name__).warning("%d records match, %d are asked for (maxrecords)", counted[0], most)
        total = min(counted[0], most)
        starts, now = list(range(0, total, size)), time.time()
        return [Pages(own, size, total, i, self.parallel, now) for i in range(self.parallel) if (own := starts[i :: self.parallel])] or [Pages([], size, total)]

    def read(self, pages: Pages) -> Iterator[tuple]:
        """All tasks share one schedule of times, an interval apart, of which each has its own; one that is late takes its next. So tasks never ask in the same interval,
        whenever they start (clocks of the machines being alike)."""
        turn = pages.first
        for start in pages.starts:
            turn = next_turn(turn, pages.step, time.time() - pages.began, self.interval)
            time.sleep(max(0.0, pages.began + turn * self.interval - time.time()))
            turn += pages.step
            got = with_retries(lambda: self.service().fetch(start, min(pages.size, pages.total - start)), self.retries)  # noqa: B023
            if got is None:
                lost = f"records from {start} on are missing: all tries failed"
                if self.options.get("onlost", "fail") == "fail":
                    raise OSError(lost)
                logging.getLogger(__name__).warning(lost)
            for row in got or []:
                yield tuple(row.get(n) for n in self.names)


class AskingReader(PagedReader):
    """One that tells the service the filters that it answers."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802 - named by the interface
        """The filters that the service answers go with every request; the others stay with Spark."""
        answers = set(getattr(self.service(), "operations", ()))
        for f in filters:
            own = told(f)
            if own and own[1] in answers:
                self.asked.append(own)
            else:
                yield f


def next_turn(turn: int, step: int, passed: float, interval: float) -> int:
    """The first of turn, turn + step, turn + 2 step ... that is not over when so many seconds of the schedule have passed."""
    late = passed / interval - turn if interval else 0.0
    return turn + step * max(0, -int(-late // step))


class PagedRecords(DataSource):
    """format("paged"): the pages of a service. Options: service ("module:factory", made from the options, with count() and
    fetch(start, size); with where(filters) too if it names operations, those of "=", "in", ">", ">=", "<", "<=", "contains", "startswith", "endswith" and each after "not " that it answers: filters
    are (column, operation, value)), pushfilters ("true" where spark.sql.python.filterPushdown.enabled is set, without which Spark refuses), batchsize, maxrecords, retries, interval (seconds between requests, of all tasks together), apikey, parallel (tasks
    that ask at once, 1 unless given), onlost (a page of which all tries fail: "fail", or "skip" with a warning)."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return self.options.get("schema", "accession string, description string, seq string")

    def reader(self, schema: StructType) -> PagedReader:
        return (AskingReader if self.options.get("pushfilters") == "true" else PagedReader)(self.options, schema)


def pages(rows: DataFrame, order: list[Column], size: int = 100, most: int | None = None) -> DataFrame:
    """rows with place (from 1, in an order that names no row twice) and page (from 1), the first `most` of them if given: what a search with a cursor gives, page by page.

    Places are given range by range, so no task holds them all; a page is then a filter on a number."""
    placed = relational.ranked(rows, order, "place")
    kept = placed if most is None else placed.where(F.col("place") <= most)
    return kept.withColumn("page", F.floor((F.col("place") - 1) / size) + 1)


def by_accession(rows: DataFrame, accessions: list[str]) -> DataFrame:
    """The records of a list of accessions, the last of each."""
    own = rows.where(F.col("accession").isin(list(dict.fromkeys(accessions))))
    return own.groupBy("accession").agg(F.max_by(F.struct(*[c for c in own.columns if c != "accession"]), "ord").alias("r")).select("accession", "r.*")
