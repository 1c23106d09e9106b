"""Secret scans over an incremental ledger of text versions.

Every version of a text is addressed by its SHA-256 digest. The ledger holds one row per pair of
digest and rule version, also for texts without findings. A scan takes the distinct digests of the
versions given, anti-joins the ledger, runs the rules on what is left, appends the outcome, and
joins the findings back to all places that hold the text. Copies are scanned once; a new rule
version scans every text once more.

Base kinds are ``assign``, ``access`` and ``hex``; ``pem``, ``jwt`` and ``forge`` are added. Places are code points,
the end exclusive. Matches are leftmost and do not overlap within a kind. A ``pem`` match is the whole block, from the
header over the body to the END line, or over all header fields and base64 lines that follow where there is no END line.
The SQL knows the header alone, so it agrees on texts without such blocks only.

Defined results: a null text is an empty text without findings; rows may repeat; an empty table gives
an empty result; other columns pass through ``redact`` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import work_path
from .common import shuffles_removed, written

RULE_VERSION = "4"
ASSIGN = (r"((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
          r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
MIN_VALUE = 12
PEM_HEADER = r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
# Header fields and lines of base64, also quoted, prefixed or with escaped line ends, as many as follow. A short run of base64
# counts where it is a line of its own. Atomic steps keep the stack of Java's matcher small.
_PEM_GAP = r"(?:[\s\"'+>#|,]|\\[nr])"
_PEM_BREAK = r"(?:\\[nr])*[\"']?[ \t+>#|,]*(?:[\r\n]|\\[nr])[\s+>#|]*[\"']?"
_PEM_LINE = rf"(?:{_PEM_GAP}++[A-Za-z0-9+/]{{16,}}+={{0,2}}|{_PEM_BREAK}[A-Za-z0-9+/]{{1,15}}+={{0,2}}(?=[ \t]*(?:[\r\n\"'\\,]|$)))"
_PEM_FIELD = rf"{_PEM_GAP}++[A-Z][A-Za-z]*-[A-Za-z]+: [A-Za-z0-9,-]+"
PEM = (PEM_HEADER + r"(?:[^-]*+(?>(?:-{1,4}[^-]++){1,256})*-----END [A-Z ]*PRIVATE KEY-----"
       + rf"|(?>(?:{_PEM_FIELD}){{1,256}})*+(?>(?:{_PEM_LINE}){{1,256}})++)?")
#: kind, pattern, and text that every match holds (None: any match must be searched for)
RULES = (
    ("assign", ASSIGN, None),
    ("access", r"AKIA[A-Z0-9]{14,}", "AKIA"),
    ("hex", r"[0-9a-f]{16,}", None),
    ("pem", PEM, "PRIVATE KEY-----"),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "eyJ"),
    ("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", "gh"),
)
BASE = ("assign", "access", "hex")


def address(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _matches(kind: str, pattern: str, holds: str | None) -> Column:
    """Null, or per match the text before it, its length and the length of its value."""
    text, p = F.col("text"), F.lit(pattern)
    value = F.regexp_extract_all(text, p, F.lit(2)) if kind == "assign" else F.regexp_extract_all(text, p, F.lit(0))
    zipped = F.arrays_zip(
        F.split(text, pattern, -1).alias("before"), F.regexp_extract_all(text, p, F.lit(0)).alias("found"), value.alias("value"))
    hit = text.rlike(pattern) if holds is None else F.contains(text, F.lit(holds)) & text.rlike(pattern)
    return F.when(hit, F.struct(F.lit(kind).alias("kind"), F.transform(zipped, lambda m: F.struct(
        F.length(m["before"]).cast("long").alias("before"), F.length(m["found"]).cast("long").alias("long"),
        F.length(m["value"]).alias("value_long"))).alias("places")))


def _spans(hits: DataFrame) -> DataFrame:
    """(blob, found) from (blob, kinds): the lengths between and of the matches, summed along each text."""
    parts = hits.select("blob", F.explode("kinds").alias("m")).select("blob", "m.kind", F.posexplode("m.places").alias("i", "p"))
    along = Window.partitionBy("blob", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    ends = parts.filter("p.long IS NOT NULL").select(
        "blob", "kind", "p.long", "p.value_long", F.sum(F.col("p.before") + F.col("p.long")).over(along).alias("end"))
    rank = F.array_position(F.array(*[F.lit(r[0]) for r in RULES]), F.col("kind"))
    good = ends.filter((F.col("kind") != "assign") | (F.col("value_long") >= MIN_VALUE))
    return good.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct(
        (F.col("end") - F.col("long")).alias("start"), rank.alias("rank"), "kind", "end",
        F.when(F.col("kind") == "assign", F.col("end") - F.col("value_long")).otherwise(F.col("end") - F.col("long")).alias("secret")))).alias("found"))


class BlobLedger:
    """Outcome of every (blob, rule version) scanned so far, in a folder that all executors see.

    A ledger opened on a folder goes on from what was written there to its end.
    """

    SCHEMA = "blob string, rules string, found array<struct<start: bigint, rank: bigint, kind: string, end: bigint, secret: bigint>>"

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, folder or work_path(spark, "blobs")
        done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/part=*/_SUCCESS")
        found = done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(done) or []
        self.parts = len(found)

    def rows(self) -> DataFrame | None:
        paths = [f"{self.folder}/part={i}" for i in range(self.parts)]
        return self.spark.read.schema(self.SCHEMA).parquet(*paths) if paths else None

    def scan(self, versions: DataFrame, rules: str = RULE_VERSION) -> DataFrame:
        """Scans the texts of ``versions`` that this rule version has not seen; returns all outcomes of it."""
        blobs = versions.select(address(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
        seen = self.rows()
        if seen is not None:
            blobs = blobs.join(seen.filter(F.col("rules") == rules).select("blob"), "blob", "left_anti")
        unseen = blobs.groupBy("blob").agg(F.first("text").alias("text"))
        # Written before they are summed up, so that every text is searched once.
        matched = F.filter(F.array(*[_matches(*r) for r in RULES]), lambda m: m.isNotNull())
        hits = written(unseen.select("blob", matched.alias("kinds")), "matches")
        found = _spans(hits)
        outcome = hits.select("blob").join(found, "blob", "left").select(
            "blob", F.lit(rules).alias("rules"), F.coalesce("found", F.array().cast(found.schema["found"].dataType)).alias("found"))
        with shuffles_removed(self.spark):
            outcome.write.mode("overwrite").parquet(f"{self.folder}/part={self.parts}")  # an unfinished part may lie there
        self.parts += 1
        return self.rows().filter(F.col("rules") == rules)


def findings(docs: DataFrame, ledger: BlobLedger | None = None, rules: str = RULE_VERSION) -> DataFrame:
    """``docs`` with ``__found``: the findings of its text, an empty array for none."""
    ledger = ledger or BlobLedger(docs.sparkSession)
    outcome = ledger.scan(docs.select("text"), rules).select(F.col("blob").alias("__blob"), F.col("found").alias("__found"))
    return docs.withColumn("__blob", address(F.col("text"))).join(outcome, "__blob", "left").drop("__blob")


def redact(docs: DataFrame, ledger: BlobLedger | None = None, mark: str = "[REDACTED]") -> DataFrame:
    """``docs`` with every secret that was found in ``text`` replaced; of an assignment only the value is.

    The text is cut at the spans of the findings; those that overlap become one.
    """
    place = lambda start, end: F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"))
    spans = F.array_sort(F.transform("__found", lambda s: place(s["secret"], s["end"])))
    none = F.array().cast("array<struct<start: bigint, end: bigint>>")
    joined = F.aggregate(spans, none, lambda held, s: F.when(
        F.size(held) == 0, F.array(s)).when(
        F.try_element_at(held, F.lit(-1))["end"] > s["start"],
        F.concat(F.slice(held, 1, F.size(held) - 1), F.array(place(
            F.try_element_at(held, F.lit(-1))["start"], F.greatest(F.try_element_at(held, F.lit(-1))["end"], s["end"]))))).otherwise(
        F.concat(held, F.array(s))))
    begins = F.concat(F.array(F.lit(0).cast("long")), F.transform("__spans", lambda s: s["end"]))
    pieces = F.transform(begins, lambda b, i: F.substring(
        F.col("text"), (b + 1).cast("int"), (F.coalesce(F.get("__spans", i)["start"], F.length("text").cast("long")) - b).cast("int")))
    found = findings(docs, ledger).withColumn("__spans", joined)
    return found.select(*[
        F.when(F.size("__found") > 0, F.array_join(pieces, mark)).otherwise(F.col("text")).alias(c) if c == "text" else F.col(c) for c in docs.columns])


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op2_secret_scan(docs: DataFrame) -> DataFrame:
    found = findings(docs.select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("__found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("__found", lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id", *[count(k) for k in BASE], F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("__found")).alias("spans"))


def _sql_kind(kind: str, pattern: str) -> str:
    value = f"regexp_extract_all(t, '{pattern}', 2)" if kind == "assign" else "m"
    return f"""
  SELECT doc_id, '{kind}' AS kind, {[r[0] for r in RULES].index(kind)} AS rank,
         unnest([struct_pack(
           s := CAST(list_sum([length(x) for x in p[1:i]]) + coalesce(list_sum([length(y) for y in m[1:i - 1]]), 0) AS BIGINT),
           n := length(m[i]), v := length(v[i])) for i in range(1, len(m) + 1)]) AS x
  FROM (SELECT doc_id, m, {value} AS v, string_split_regex(t, '{pattern}') AS p
        FROM (SELECT doc_id, t, regexp_extract_all(t, '{pattern}') AS m FROM texts) WHERE len(m) > 0)"""


_SQL_PATTERNS = [(k, PEM_HEADER if k == "pem" else p) for k, p, _ in RULES]
_SQL_KINDS = "\n  UNION ALL".join(_sql_kind(k, p.replace("'", "''").replace("\\\"", '"')) for k, p in _SQL_PATTERNS)
SQL = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({_SQL_KINDS}),
good AS (
  SELECT doc_id, kind, rank, x.s AS s, concat(kind, ':', x.s, ':', x.s + x.n) AS span
  FROM spans WHERE kind <> 'assign' OR x.v >= {MIN_VALUE}),
per_doc AS (
  SELECT doc_id, COUNT(*) FILTER (WHERE kind = 'assign') AS n_assign, COUNT(*) FILTER (WHERE kind = 'access') AS n_access,
         COUNT(*) FILTER (WHERE kind = 'hex') AS n_hex,
         string_agg(span, ',' ORDER BY s, rank) FILTER (WHERE rank < {len(BASE)}) AS base, string_agg(span, ',' ORDER BY s, rank) AS spans
  FROM good GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts t LEFT JOIN per_doc p ON t.doc_id = p.doc_id
"""
