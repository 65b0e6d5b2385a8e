"""Secret scans with an incremental ledger of blobs. DataFrame functions only.

Every text is a blob, known by its SHA-256. The ledger holds one row per blob and rule version that was scanned, with the
spans found. A scan looks only at pairs the ledger lacks, one copy of each blob, and findings are joined back to all
documents that hold the blob. A rule's version is the digest of its definition, so a changed rule is scanned anew.

Regular expressions give matches but no places; a match starts after the pieces that a split leaves before it and the
matches before it, so places are running sums of lengths over the rows of a blob's matches.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import columns_of, written


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of `pattern` whose `group` has at least `least` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False

    @property
    def version(self) -> str:
        return hashlib.sha256(f"{self.kind}\n{self.pattern}\n{self.group}\n{self.least}".encode()).hexdigest()[:16]


# The kinds that every scan has, in the order of their names in a list of spans. A run of 24 or more is
# what a run of any length leaves once short ones are dropped; the same holds for 16 or more after AKIA.
_KEYWORD = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in "(password|passwd|secret|token|api_?key)")
ASSIGN = _KEYWORD + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE_RULES = [Rule("assign", ASSIGN, 2, 6, True), Rule("access", "AKIA[A-Z0-9]{16,}", base=True), Rule("hex", "[0-9a-f]{24,}", base=True)]
ADDED_RULES = [
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
]
RULES = BASE_RULES + ADDED_RULES

# What is masked of a private key: all from BEGIN to END, or where END is missing, the lines in base64 that follow. All
# loops are possessive, which Java runs without recursion, so a long text needs no deep stack.
_GAP, _RUN = r"(?:\s|\\[nr])", r"[A-Za-z0-9+/]{16,}+={0,2}+"
_TO_END = r"(?:[^-]++|-(?!----(?:BEGIN|END) ))*+-----END [A-Z ]*PRIVATE KEY-----"
_LAST_LINE = r"(?:[ \t]*+(?:\R|\\[nr])[ \t]*+[A-Za-z0-9+/]{1,15}+={0,2}+[ \t]*+(?=[\r\n\\]|\z))?+"
_LINES = rf"(?:(?:\s*+(?:Proc-Type|DEK-Info):[^\r\n]*+)*+(?:{_GAP}*+{_RUN})++{_LAST_LINE})?+"
WHOLE_KEY = Rule("pem", f"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:{_TO_END}|{_LINES})")
MASKED_RULES = [WHOLE_KEY if rule.kind == WHOLE_KEY.kind else rule for rule in RULES]

LEDGER = "blob string, rule_version string, spans array<struct<start:long,end:long>>"


def blob_of(text: Column) -> Column:
    """The address of a text; a null text is the empty one."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: list[Rule] = RULES, text_col: str = "text") -> DataFrame:
    """Ledger rows for every pair of a blob in `docs` and a rule version that `ledger` lacks (all, without a ledger).

    Append them to the ledger to have the next scan skip them. Pairs without a finding have an empty list.
    """
    versions = F.array(*(F.lit(rule.version) for rule in rules))
    blobs = docs.select(blob_of(F.col(text_col)).alias("blob"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if ledger is None:
        todo = blobs.withColumn("todo", versions)
    else:
        seen = ledger.groupBy("blob").agg(F.collect_set("rule_version").alias("seen"))
        todo = blobs.join(seen, "blob", "left").withColumn("todo", F.array_except(versions, F.coalesce("seen", F.array().cast("array<string>"))))
        todo = todo.where(F.size("todo") > 0).drop("seen")
    todo = todo.dropDuplicates(["blob"])

    def looked_at(rule: Rule) -> Column:
        matches = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0))
        values = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(rule.group))
        found = F.arrays_zip(F.slice(F.split("text", rule.pattern), F.lit(1), F.size(matches)).alias("piece"), matches.alias("match"), values.alias("value"))
        lengths = F.transform(found, lambda x: F.struct(F.length(x["piece"]).cast("long").alias("before"), F.length(x["match"]).cast("long").alias("long"), F.length(x["value"]).alias("value")))
        none = F.array().cast("array<struct<before:bigint,long:bigint,value:int>>")
        hits = F.when(F.col("text").rlike(rule.pattern), lengths).otherwise(none)
        return F.when(F.array_contains("todo", rule.version), F.struct(F.lit(rule.version).alias("rule_version"), F.lit(rule.least).alias("least"), hits.alias("hits")))

    looked = todo.select("blob", F.explode(F.filter(F.array(*(looked_at(rule) for rule in rules)), lambda x: x.isNotNull())).alias("r")).select("blob", "r.*")
    rows = looked.select("blob", "rule_version", "least", F.posexplode_outer("hits").alias("place", "hit"))
    so_far = Window.partitionBy("blob", "rule_version").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("hit.before") + F.col("hit.long")).over(so_far))
    span = F.when(F.col("hit.value") >= F.col("least"), F.struct((F.col("end") - F.col("hit.long")).alias("start"), F.col("end").alias("end")))
    return rows.groupBy("blob", "rule_version").agg(F.array_sort(F.collect_list(span)).alias("spans"))


def findings(ledger: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """(blob, found) of every blob with a finding under the given rules: (start, order of the kind, end, kind), in order."""
    kinds = F.map_from_arrays(F.array(*(F.lit(r.version) for r in rules)), F.array(*(F.struct(F.lit(i).alias("n"), F.lit(r.kind).alias("kind")) for i, r in enumerate(rules))))
    rows = ledger.where(F.size("spans") > 0).withColumn("rule", F.element_at(kinds, F.col("rule_version")) if rules else F.lit(None)).where("rule IS NOT NULL")
    spans = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.col("rule.n").alias("n"), s["end"].alias("end"), F.col("rule.kind").alias("kind")))
    return rows.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list(spans))).alias("found"))


def scan_documents(docs: DataFrame, ledger: DataFrame | None = None, rules: list[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's id with `found`: its secrets as (start, n, end, kind) by start, then by the rules' order.

    Places are code points, ends exclusive. Null and empty texts have none; repeated rows, null ids and copies of a text are
    returned each with the findings of their blob. An empty table gives no rows.
    """
    new = written(scan(docs, ledger, rules, text_col))
    known = findings(new if ledger is None else ledger.unionByName(new), rules)
    none = F.array().cast("array<struct<start:bigint,n:int,end:bigint,kind:string>>")
    rows = docs.select(F.col(id_col), blob_of(F.col(text_col)).alias("blob"))
    return rows.join(known, "blob", "left").select(id_col, F.coalesce("found", none).alias("found"))


def written_spans(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def masked(text: Column, found: Column, mask: str = "[SECRET]") -> Column:
    """`text` with every stretch covered by findings replaced by `mask`."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def add(state: Column, x: Column) -> Column:
        apart = F.concat(state["out"], F.substring(text, state["at"].cast("int") + 1, (x["start"] - state["at"]).cast("int")), F.lit(mask))
        return F.struct(F.greatest(state["at"], x["end"]).alias("at"), F.when(x["start"] >= state["at"], apart).otherwise(state["out"]).alias("out"))

    rest = lambda state: F.concat(state["out"], F.substring(text, state["at"].cast("int") + 1, F.length(text)))
    return F.when(F.size(found) > 0, F.aggregate(found, start, add, rest)).otherwise(text)


def mask_secrets(docs: DataFrame, ledger: DataFrame | None = None, rules: list[Rule] = MASKED_RULES, text_col: str = "text") -> DataFrame:
    """`docs` with secrets masked in their texts; all rows stay, other columns are untouched but `n_chars`, which follows the text.

    A private key is masked with its body, while a scan with RULES places its first line only.
    """
    new = written(scan(docs, ledger, rules, text_col))
    known = findings(new if ledger is None else ledger.unionByName(new), rules).withColumnsRenamed({"blob": "__blob", "found": "__found"})
    rows = docs.join(known, blob_of(F.col(text_col)) == F.col("__blob"), "left")
    text = F.when(F.col("__found").isNull(), F.col(text_col)).otherwise(masked(F.col(text_col), F.col("__found")))
    rows = rows.withColumn(text_col, text)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("__found").isNull(), F.col("n_chars")).otherwise(F.length(text_col).cast(docs.schema["n_chars"].dataType)))
    return rows.select(*columns_of(docs))
