"""Secret scan with multipart credential linking.

Strong patterns are reported as they are. Weak candidates (an access identifier, an unnamed
random-looking string, an endpoint) mean little alone; they are reported only where all
three parts occur together: an interval join finds, within a scope (text between blank lines), the
secrets that have an identifier and an endpoint within ``reach`` characters, and then the
identifiers and endpoints of those secrets. The joins are semi joins, so no pairs come out.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickframe.operators.series import settle

KINDS = ("assign", "access", "hex", "id", "secret", "endpoint")    # also their order at equal starts

_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ASSIGN_WORDS = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_ID = re.compile(r"(?:access_?key_?id|client_?id|account_?id|user_?name|user|login)[\"']?\x20*[:=]\x20*[\"']?"
                 r"([A-Za-z0-9._@-]{4,})", re.I | re.A)
_SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
_ENDPOINT = re.compile(r"https?://[^\s\"'<>]+|(?:endpoint|host|server)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?::\d+)?",
                       re.I | re.A)
_BLANK = re.compile(r"\n[ \t\r]*\n")

_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
_PART = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("scope", pa.int64())])


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the strong patterns, in order."""
    out = []
    low = text.lower()
    if any([w in low for w in _ASSIGN_WORDS]):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def _outside(taken: list[tuple[int, int]]):
    """A test whether [start, end) meets none of these spans, by bisection over their union."""
    starts, ends = [], []
    for a, b in sorted(taken):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)

    def free(start: int, end: int) -> bool:
        k = bisect_left(starts, end) - 1
        return k < 0 or ends[k] <= start
    return free


def weak_parts(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(kind number, start, end, scope) of the parts that may belong together; none unless all do occur."""
    low = text.lower()
    if not ("://" in low or "endpoint" in low or "host" in low or "server" in low):
        return []
    ends = sorted((m.start(), m.end()) for m in _ENDPOINT.finditer(text))
    ids = [(3, m.start(), m.end()) for m in _ID.finditer(text)] if ends else []
    keys = [(1, a, b) for a, k, b in base if k == 1]
    if not ends or not (ids or keys):
        return []
    strong = [(a, b) for a, _, b in base]
    free = _outside([*strong, *((a, b) for _, a, b in ids), *ends])
    found = [(4, m.start(), m.end()) for m in _SECRET.finditer(text)
             if re.search("[a-z]", m[0]) and re.search("[A-Z]", m[0]) and re.search("[0-9]", m[0])
             and free(m.start(), m.end())]
    if not found:
        return []
    free = _outside(strong)
    ids = [x for x in ids if free(x[1], x[2])]
    cuts = [m.start() for m in _BLANK.finditer(text)]
    out, scope = [], 0
    for kind, a, b in sorted([*ids, *keys, *found, *((5, a, b) for a, b in ends)], key=lambda x: x[1]):
        while scope < len(cuts) and cuts[scope] <= a:
            scope += 1
        out.append((kind, a, b, scope))
    return out


def _scan(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans, parts = [], []
        for text in batch.column("text").to_pylist():
            base = base_spans(text) if text else []
            spans.append([{"kind": k, "start": a, "end": b} for a, k, b in base])
            parts.append([{"kind": k, "start": a, "end": b, "scope": s}
                          for k, a, b, s in (weak_parts(text, base) if text else [])])
        yield pa.RecordBatch.from_arrays(
            [batch.column("_key"), pa.array(spans, pa.list_(_SPAN)), pa.array(parts, pa.list_(_PART))],
            names=["_key", "base", "parts"])


def linked_parts(parts: DataFrame, reach: int) -> DataFrame:
    """``parts`` (key, kind, start, end, scope) → the weak ones whose complements are near.

    Distance is between the starts. Bins of ``reach`` characters carry the joins, so a long text
    or a scope of many parts spreads over many join keys.
    """
    here = parts.withColumn("bin", F.floor(F.col("start") / reach))
    spread = here.select("key", "scope", F.col("kind").alias("kind2"), F.col("start").alias("start2"),
                         F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin"))
    near = F.abs(F.col("start") - F.col("start2")) <= reach

    def beside(left: DataFrame, right: DataFrame) -> DataFrame:
        on = (F.col("l.key") == F.col("r.key")) & (F.col("l.scope") == F.col("r.scope")) & (F.col("l.bin") == F.col("r.bin"))
        return left.alias("l").join(right.alias("r"), on & near, "left_semi")

    secret = beside(beside(here.where("kind = 4"), spread.where("kind2 in (1, 3)")), spread.where("kind2 = 5"))
    again = secret.select("key", "scope", F.col("kind").alias("kind2"), F.col("start").alias("start2"),
                          F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin"))
    return secret.unionByName(beside(here.where("kind in (3, 5)"), again)).select("key", "kind", "start", "end")


def find_secrets(docs: DataFrame, *, reach: int = 400) -> DataFrame:
    """``docs`` with ``base`` and ``spans`` (arrays of kind, start, end in code points) added.

    ``base`` holds the strong spans, ``spans`` these and the linked weak parts, both by start
    and then kind. Null and empty texts have none. Repeated rows stay; equal texts are linked
    once. Other columns pass through; columns already called so are replaced. No rows give none.
    """
    docs = docs.drop("base", "spans")
    names, own = docs.columns, "_key"
    while own in names:
        own = f"_{own}"
    scanned = docs.withColumn(own, F.coalesce(F.md5("text"), F.lit("")))
    marks = settle(scanned.select(F.col(own).alias("_key"), "text").mapInArrow(_scan, (
        "_key string, base array<struct<kind:int,start:long,end:long>>, "
        "parts array<struct<kind:int,start:long,end:long,scope:long>>"))
        .where("size(base) > 0 or size(parts) > 0").dropDuplicates(["_key"]))
    parts = settle(marks.where("size(parts) > 0").select(F.col("_key").alias("key"), F.inline("parts")))
    weak = linked_parts(parts, reach).groupBy("key").agg(
        F.collect_list(F.struct("kind", "start", "end")).alias("weak"))
    found = marks.select("_key", "base").join(weak.withColumnRenamed("key", "_key"), "_key", "left")
    none = F.array().cast("array<struct<kind:int,start:long,end:long>>")
    found = found.select("_key", _named(F.col("base")).alias("base"),
                         _named(F.concat("base", F.coalesce("weak", none))).alias("spans"))
    empty = F.array().cast("array<struct<kind:string,start:long,end:long>>")
    return (scanned.join(found.withColumnRenamed("_key", own), own, "left")
            .select(*names, F.coalesce("base", empty).alias("base"), F.coalesce("spans", empty).alias("spans")))


def _named(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.transform(ordered, lambda s: F.struct(
        F.element_at(kinds, s["kind"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def redact(text: Column, spans: Column, mask: str = "[REDACTED]") -> Column:
    """The text with every span masked; overlapping spans are masked as one. Null stays null."""
    step = F.aggregate(
        spans, F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda done, s: F.when(s["start"] < done["at"], F.struct(
            done["out"].alias("out"), F.greatest(done["at"], s["end"]).alias("at")))
        .otherwise(F.struct(
            F.concat(done["out"], F.substr(text, (done["at"] + 1).cast("int"), (s["start"] - done["at"]).cast("int")), F.lit(mask)).alias("out"),
            s["end"].alias("at"))))
    whole = F.concat(step["out"], F.substr(text, (step["at"] + 1).cast("int")))
    return F.when(F.size(spans) > 0, whole).otherwise(text)
