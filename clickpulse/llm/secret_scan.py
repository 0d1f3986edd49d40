"""Secret scans (operator 5): an incremental ledger of scanned blobs.

Every version of every file is addressed by the SHA-256 of its content. A scan covers only pairs of blob and
rule version that the ledger doesn't hold yet. The ledger keeps what each scan found, so findings of all runs are joined
back to all paths that ever held a blob.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .spans import spans_of

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
PRIVATE_KEY = r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
HOST_TOKEN = r"(?:gh[pousr]_|glpat-|xox[abp]-)[A-Za-z0-9_-]{20,}+"


@dataclass(frozen=True)
class SecretRule:
    """A rule's ``version`` changes with its pattern, so that the ledger scans old blobs anew.

    ``least``: fewest characters of the pattern's last part, counted from the last ``: = " '`` or space that
    stands before it (0: whatever matches).
    """

    kind: str
    pattern: str
    version: int = 1
    least: int = 0
    base: bool = True

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"

    def spans(self, text: Column) -> Column:
        found = spans_of(text, self.pattern)
        if self.least:
            value = lambda s: F.regexp_extract(s["found"], f"^{self.pattern}$", 1)
            found = F.filter(found, lambda s: F.char_length(value(s)) >= self.least)
        return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(self.kind).alias("kind"), s["end"].alias("end"), s["found"].alias("found")))


#: In the order in which kinds are listed.
RULES = (
    SecretRule("assign", ASSIGN, least=6),
    SecretRule("access", ACCESS),
    SecretRule("hex", HEX),
    SecretRule("private_key", PRIVATE_KEY, base=False),
    SecretRule("host_token", HOST_TOKEN, base=False),
)
FOUND = "array<struct<start:int,kind:string,end:int,found:string>>"
LEDGER = f"blob string, rule string, spans {FOUND}"


def blob_of(text: Column) -> Column:
    """The content address of a text; null counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _in_order(spans: Column, rules: tuple[SecretRule, ...]) -> Column:
    """Spans by start, then in the order of ``rules``."""
    rank = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.kind, i)])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.element_at(rank, s["kind"]).alias("rank"), s.alias("span")))
    return F.transform(F.array_sort(keyed), lambda k: k["span"])


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[SecretRule, ...] = RULES, text: str = "text") -> DataFrame:
    """Scans each distinct blob of ``versions`` with the rules that ``ledger`` (see :func:`ledger_rows`) lacks for it.

    One row per blob with something to scan: ``blob``, ``rules`` (keys scanned now), ``spans`` (``start, kind, end, found``;
    by start, then in the order of ``rules``). Null texts are the empty blob, repeated rows one blob; an empty table
    gives no rows; other columns are ignored.
    """
    blobs = versions.select(blob_of(F.col(text)).alias("blob"), F.coalesce(text, F.lit("")).alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
    todo = F.array(*[F.lit(r.key) for r in rules])
    if ledger is not None:
        seen = ledger.where(F.col("rule").isin([r.key for r in rules])).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        blobs = blobs.join(seen, "blob", "left")
        todo = F.array_except(todo, F.coalesce("seen", F.array().cast("array<string>")))
    blobs = blobs.withColumn("rules", todo).where(F.size("rules") > 0)
    found = F.concat(*[F.when(F.array_contains("rules", r.key), r.spans(F.col("text"))).otherwise(F.array().cast(FOUND)) for r in rules])
    return blobs.select("blob", "rules", _in_order(found, rules).alias("spans"))


def ledger_rows(scanned: DataFrame) -> DataFrame:
    """``blob, rule, spans``: what a scan has covered and found, to be appended to the ledger; spans are empty where nothing was."""
    kind = F.substring_index("rule", "@", 1)
    return scanned.select("blob", F.explode("rules").alias("rule"), "spans").select("blob", "rule", F.filter("spans", lambda s: s["kind"] == kind).alias("spans"))


def findings_by_path(versions: DataFrame, ledger: DataFrame, rules: tuple[SecretRule, ...] = RULES, text: str = "text") -> DataFrame:
    """Joins findings back: every row of ``versions`` (its columns but the text) once, with ``blob`` and ``spans``.

    ``ledger``: the rows of all runs so far, this one's included. Only findings of the versions in ``rules`` count, so a new
    version supersedes an old one; pairs that two runs both hold count once. Blobs without findings, and those never
    scanned, have no spans. Findings are written before the join: that table is small, so Spark may broadcast it, and
    where it isn't, a blob that a third of all paths hold is one row of it and the paths can be split.
    """
    names = [c for c in versions.columns if c not in (text, "blob", "spans")]
    now = ledger.where(F.col("rule").isin([r.key for r in rules]) & (F.size("spans") > 0)).groupBy("blob", "rule").agg(F.first("spans").alias("spans"))
    found = cut(now.groupBy("blob").agg(_in_order(F.flatten(F.collect_list("spans")), rules).alias("spans")))  # a row for each rule at most
    return versions.select(*names, blob_of(F.col(text)).alias("blob")).join(found, "blob", "left").select(*names, "blob", F.coalesce("spans", F.array().cast(FOUND)).alias("spans"))
