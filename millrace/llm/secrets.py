"""Secret scans over an incremental blob ledger.

A blob is one distinct text, addressed by its SHA-256.  The ledger is a folder
of two tables: scans (blob, rule_version, spans) and versions (blob, path,
version), where each historical version of each path was seen.  A scan adds
only the (blob, rule_version) pairs that no earlier one has, of this process
or another: a later version with the same text, another copy of it or another
run costs its hash, and a new rule version scans each blob once.  Findings are
joined back to every row, or to every path and version, that has the blob.

An update is written under a name of its own and then renamed, so a reader sees
it whole or not at all, and several writers do not disturb each other; what two
of them scan at the same time is there twice and counts once.

Copies are folded before texts are shuffled (a partial aggregate keeps one
text per blob and task), and the join back carries no texts.  A blob that holds
a third of the rows meets its findings by a salted join.

Columns whose names the ledger uses itself are left alone.  Rules (fixed values): kinds assign, access and hex as the contract words them,
and ``pem``, the header of a private key.  Spans are half-open ranges of code
points.  Null texts count as empty and have no findings; repeated rows get
equal rows.
"""

from __future__ import annotations

import re
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

RULE_VERSION = "1"
#: The kinds in the order in which equal starts are listed.
BASE = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(?:(?i:(password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # a maximal run of 24 or more is what is left of all maximal runs
_PEM = re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----")
SALTS = 16


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of every span, sorted."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    if "-----BEGIN" in text:
        out += [(m.start(), 3, m.end()) for m in _PEM.finditer(text)]
    return sorted(out)


KINDS = (*BASE, "pem")
_SPANS = "array<struct<kind:string,start:int,stop:int>>"


def address(text: str = "text") -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def addressed(docs: DataFrame) -> DataFrame:
    """docs with the address of their text."""
    return docs.withColumn("blob", address())


def _scan_blobs(blobs: DataFrame, version: str) -> DataFrame:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches):
        for batch in batches:
            spans = [[{"kind": KINDS[k], "start": a, "stop": b} for a, k, b in scan(t or "")] for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("blob"), pa.array([version] * len(spans), pa.string()), pa.array(spans, kind)], ["blob", "rule_version", "spans"])

    return common.map_arrow(blobs.select("blob", "text"), run, f"blob string, rule_version string, spans {_SPANS}")


_SCANS = f"blob string, rule_version string, spans {_SPANS}"
_VERSIONS = "blob string, path string, version string"


class Ledger:
    """The ledger under ``path``, with what earlier runs have left there."""

    def __init__(self, spark, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _store(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _parts(self, table: str) -> list[str]:
        store, folder = self._store(table)
        return sorted(x.getPath().toString() for x in store.listStatus(folder) if x.getPath().getName().startswith("part-")) if store.exists(folder) else []

    def _table(self, table: str, schema: str) -> DataFrame:
        parts = self._parts(table)
        return self.spark.read.schema(schema).parquet(*parts) if parts else self.spark.createDataFrame([], schema)

    def _commit(self, rows: DataFrame, table: str) -> str:
        name = uuid.uuid4().hex
        store, hidden = self._store(f"_writing-{name}")
        rows.write.parquet(f"{self.path}/_writing-{name}")
        _, target = self._store(f"{table}/part-{name}")
        store.mkdirs(target.getParent())
        if not store.rename(hidden, target):
            raise OSError(f"could not commit {target}")
        return target.toString()

    def read(self) -> DataFrame:
        """blob, rule_version, spans of every scan."""
        return self._table("scans", _SCANS)

    def versions(self) -> DataFrame:
        """blob, path, version of every text that an update with ``path`` has seen."""
        return self._table("versions", _VERSIONS)

    def update(self, docs: DataFrame, version: str = RULE_VERSION, path: str | None = None, history: str = "1") -> int:
        """Scan what is new in docs; returns the number of blobs scanned.

        With ``path``, the name of a column, each row's text is also recorded
        as version ``history`` of that path.
        """
        if path is not None:
            rows = docs.select(address().alias("blob"), F.col(path).cast("string").alias("path"), F.lit(history).alias("version")).distinct()
            self._commit(rows.join(self.versions(), ["blob", "path", "version"], "left_anti") if self._parts("versions") else rows, "versions")
        keyed = docs.select(address().alias("blob"), "text")
        if self._parts("scans"):
            known = self.read().filter(F.col("rule_version") == version).select("blob")
            unseen = common.materialise(keyed.select("blob").distinct().join(known, "blob", "left_anti"), "ledger-unseen")  # addresses only
            if unseen.isEmpty():
                return 0
            keyed = keyed.join(unseen, "blob", "left_semi")
        blobs = keyed.groupBy("blob").agg(F.first("text").alias("text"))
        return self.spark.read.parquet(self._commit(_scan_blobs(blobs, version), "scans")).count()

    def findings(self, rows: DataFrame, version: str = RULE_VERSION, blob: str = "blob", spans: str = "spans") -> DataFrame:
        """rows, which have a column ``blob``, with their spans; only blobs with findings travel, each to every salt."""
        key, salt = "__ledger_blob", "__ledger_salt"
        found = self.read().filter((F.col("rule_version") == version) & (F.size("spans") > 0)).select(F.col("blob").alias(key), F.col("spans").alias("__ledger_spans")).dropDuplicates([key])
        found = found.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        parts = [n for n, t in rows.dtypes if "map<" not in t and "variant" not in t]
        salted = rows.withColumn(key, F.col(blob)).withColumn(salt, F.pmod(F.xxhash64(*[F.col(f"`{n}`") for n in parts]), F.lit(SALTS)).cast("int"))
        return salted.join(found, [key, salt], "left").select(*[F.col(f"`{n}`") for n in rows.columns], F.coalesce("__ledger_spans", F.array().cast(_SPANS)).alias(spans))

    def occurrences(self, version: str = RULE_VERSION) -> DataFrame:
        """blob, path, version, spans of every historical version that has findings."""
        return self.findings(self.versions(), version).filter(F.size("spans") > 0)


def redact(docs: DataFrame, ledger: Ledger, mark: str = "[REDACTED]", version: str = RULE_VERSION) -> DataFrame:
    """docs with every span that the ledger finds replaced by ``mark``, overlapping spans as one, and n_chars, if there is one, set anew."""
    ledger.update(docs, version)
    names = docs.columns
    found = ledger.findings(docs.withColumn("__blob", address()), version, "__blob", "__spans").drop("__blob")

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            sizes = batch.column("n_chars").to_pylist() if "n_chars" in names else [0] * len(texts)
            for k, spans in enumerate(batch.column("__spans").to_pylist()):
                if spans:
                    text, parts, at = texts[k], [], 0
                    for a, b in sorted((x["start"], x["stop"]) for x in spans):
                        if a >= at:
                            parts += [text[at:a], mark]
                        at = max(at, b)
                    texts[k] = "".join([*parts, text[at:]])
                    sizes[k] = len(texts[k])
            cols = {c: batch.column(c) for c in names} | {"text": pa.array(texts, pa.string())}
            if "n_chars" in names:
                cols["n_chars"] = pa.array(sizes, batch.schema.field("n_chars").type)
            yield pa.record_batch([cols[c] for c in names], names)

    return common.map_arrow(found, run, ", ".join(f"`{n}` {t}" for n, t in docs.dtypes))


def op7_secrets(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    path = common.fresh_path(spark, "ledger")
    Ledger(spark, path).update(docs, path="doc_id", history="1")
    ledger = Ledger(spark, path)  # as a later run would open it: of the next version's texts only new ones are scanned, and here there are none
    ledger.update(docs, path="doc_id", history="2")
    found = ledger.findings(addressed(docs).select("doc_id", "blob"))
    joined = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("bigint")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined("spans").alias("spans"))
