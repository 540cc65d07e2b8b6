"""Secret scan with corpus-wide ownership frequency.

Each text is matched against the base kinds (assign, access, hex) and against
wider token shapes. Every matched value is hashed; over the whole corpus the
hash is aggregated by distinct repository and distinct owner. A value held by
few owners looks live; one that many owners carry is a copied example. Base
spans always stay; a wider candidate adds an ``owned`` span only if its value is
owner-specific.

Defined results: null or empty text has no spans; repeated rows are scanned one
by one; a null owner or repository counts as one unnamed owner; an empty table
gives no rows. Offsets are code points, the end is exclusive.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskline.llm.common import materialize, unused

KINDS = ["assign", "access", "hex", "owned"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Wider shapes: prefixed service tokens, signed web tokens, credentials in an address.
WIDER = re.compile(r"(?<![A-Za-z0-9])(?:(?:gh[pousr]|glpat|xox[abprs]|sk|pk|rk)[-_][A-Za-z0-9_-]{16,}"
                   r"|AIza[A-Za-z0-9_-]{30,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}(?:\.[A-Za-z0-9_-]+)?"
                   r"|(?<=://)[^\s:/@]{1,64}:[^\s:/@]{6,128}(?=@))")
KEYWORDS = ("password", "passwd", "secret", "token", "api")
SPANS = "array<struct<kind:int,start:int,stop:int,value:string>>"


def find_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, value) of all candidates, by start and then kind."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(0, m.start(), m.end(), m.group(2)) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    if "AKIA" in text:
        out += [(1, m.start(), m.end(), m.group()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(2, m.start(), m.end(), m.group()) for m in HEX.finditer(text)]
    if "_" in text or "-" in text or "eyJ" in text or "://" in text:
        out += [(3, m.start(), m.end(), m.group()) for m in WIDER.finditer(text)]
    return sorted((k, s, e, hashlib.sha256(v.encode("utf-8", "surrogatepass")).hexdigest()[:32])
                  for k, s, e, v in out)


def _scan(batches):
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()),
                               ("value", pa.string())]))
    for b in batches:
        spans = [[dict(kind=k, start=s, stop=e, value=v) for k, s, e, v in find_spans(t or "")]
                 for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column("row"), b.column("doc_id"), b.column("repo"), b.column("owner"), pa.array(spans, kind)],
            ["row", "doc_id", "repo", "owner", "found"])


def candidates(docs: DataFrame, repo_col: str = "source", owner_col: str = "source") -> DataFrame:
    """One row per document: row (unique number), doc_id, repo, owner, found (all candidate spans)."""
    d = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id",
                    F.coalesce(F.col(repo_col).cast("string"), F.lit("")).alias("repo"),
                    F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"), "text")
    id_type = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(_scan, f"row long, doc_id {id_type}, repo string, owner string, found {SPANS}")


def ownership(found: DataFrame) -> DataFrame:
    """value -> number of distinct repositories and owners and of uses.

    Combined by (value, repo, owner) before the value is counted: a value in a
    third of all documents reaches the second shuffle once per owner and repository.
    """
    uses = found.select("repo", "owner", F.explode("found.value").alias("value"))
    each = uses.groupBy("value", "repo", "owner").agg(F.count(F.lit(1)).alias("n"))
    by_owner = each.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("repos"), F.sum("n").alias("n"))
    return by_owner.groupBy("value").agg(F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repos"),
                                         F.sum("n").alias("uses"))


def scan_secrets(docs: DataFrame, repo_col: str = "source", owner_col: str = "source",
                 max_owners: int = 2) -> DataFrame:
    """row, doc_id, spans: array of (kind, start, stop, owners, live), ordered by start and kind.

    ``live`` is true for values of at most ``max_owners`` owners.
    """
    found = materialize(candidates(docs, repo_col, owner_col), "secret-candidates")
    held = ownership(found)
    spans = (found.select("row", F.explode("found").alias("s"))
             .select("row", "s.kind", "s.start", "s.stop", "s.value").join(held, "value")
             .withColumn("live", F.col("owners") <= max_owners)
             .where((F.col("kind") < 3) | F.col("live")))
    by_row = spans.groupBy("row").agg(F.sort_array(F.collect_list(
        F.struct("start", "kind", "stop", "owners", "repos", "live"))).alias("spans"))
    empty = F.array().cast("array<struct<start:int,kind:int,stop:int,owners:long,repos:long,live:boolean>>")
    return (found.select("row", "doc_id").join(by_row, "row", "left")
            .withColumn("spans", F.coalesce("spans", empty)))


def _named(spans):
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(kind, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def secret_digest(scanned: DataFrame) -> DataFrame:
    """The contract's columns from ``scan_secrets``."""
    base = F.filter("spans", lambda s: s["kind"] < 3)
    of_kind = lambda k: F.filter("spans", lambda s: s["kind"] == k)
    count = [F.size(of_kind(k)).cast("long").alias(f"n_{n}") for k, n in enumerate(KINDS[:3])]
    return scanned.select("doc_id", *count, F.sha2(_named(base).cast("binary"), 256).alias("base_sha256"),
                          _named(F.col("spans")).alias("spans"),
                          F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"))


def redact(docs: DataFrame, mask: str = "[secret]", max_owners: int = 2, **scan) -> DataFrame:
    """``docs`` with the live-looking spans of each text replaced by ``mask``; no row is dropped.

    Widely copied examples stay. Overlapping spans are masked once; n_chars, where present, follows the text.
    """
    found = materialize(candidates(docs, **scan), "secret-candidates")
    live = ownership(found).where(F.col("owners") <= max_owners).select("value")
    hits = (found.select("doc_id", F.explode("found.value").alias("value")).distinct()
            .join(live, "value").groupBy("doc_id").agg(F.collect_list("value").alias("live")))

    columns = docs.columns
    values_of, id_of = unused(docs, "live_values"), unused(docs, "live_id")

    def masked(batches):
        for b in batches:
            out = []
            for t, values in zip(b.column("text").to_pylist(), b.column(values_of).to_pylist()):
                if values:
                    parts, at, known = [], 0, set(values)
                    for start, stop in sorted((s, e) for _, s, e, v in find_spans(t or "") if v in known):
                        if start >= at:
                            parts += [t[at:start], mask]
                        at = max(at, stop)
                    t = "".join(parts) + t[at:] if parts else t
                out.append(t)
            cols = {n: b.column(n) for n in columns}
            cols["text"] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    right = hits.select(F.col("doc_id").alias(id_of), F.col("live").alias(values_of))
    joined = docs.join(right, docs["doc_id"].eqNullSafe(right[id_of]), "left").drop(id_of)
    out = joined.mapInArrow(masked, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) \
        if "n_chars" in docs.columns else out
