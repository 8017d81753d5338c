"""Secret scans with an incremental blob ledger.

Every version of a text is addressed by its content (SHA-256). Only pairs of blob and rule version
that the ledger lacks are scanned, once each however many paths hold them; the findings, old and
new, are joined back to all paths. Only DataFrame operations.

Matches are leftmost and do not overlap within a kind; positions are code points, end exclusive.

Defined results: a null text is an empty one; an empty text has no findings; a text of any length is
scanned whole, its cost in proportion to its length and matches; spans are ordered by start, those
of one start by kind; repeated rows and copies share a blob and each get its findings; null keys are
kept; an empty table gives no rows; scan() ignores columns beyond those named and redacted() keeps
them, whatever their names.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from .common import exists, fresh, let, materialize, running, sized

#: What marks the ends of a match. A text's own marks become the other one, which no rule matches.
MARK, OTHER = "\x01", "\x02"
#: Findings that are broadcast: so many blobs with so many spans (12 bytes each) at most.
BROADCAST_ROWS, BROADCAST_SPANS = 200_000, 2_000_000
#: Characters of a piece of a text that is redacted.
CUT = 4096
SPANS = "array<struct<start:int,kind:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    """A kind of secret. If group is set, a match counts only if that group has at_least characters.

    Patterns must not match the marks, and a match taken alone must match in the same way (no
    look-around).
    """

    kind: str
    pattern: str
    group: int = 0
    at_least: int = 0


#: Fixed values of the contract. The runs of access and hex with their least length in the pattern
#: are those that remain once shorter matches are dropped, as a rest of a dropped run is shorter still.
BASE_RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: What the method adds to the base: further kinds, each with its own spans.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{30,}"),
)
RULES = BASE_RULES + MORE_RULES


def rule_version(rules: tuple[Rule, ...]) -> str:
    """Changes with any rule, so that old findings are not taken for those of new rules."""
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def _found(text: Column, rule: Rule, order: int) -> Column:
    """The spans of one rule in a text without MARK: the text is cut at its matches, and the pieces' lengths summed."""
    pieces = F.split(F.regexp_replace(text, F.lit(f"(?:{rule.pattern})"), F.lit(f"{MARK}$0{MARK}")), MARK, -1)

    def emit(s: Column, piece: Column) -> Column:
        good = s["is"]
        if rule.at_least:
            good = good & (F.length(F.regexp_extract(piece, rule.pattern, rule.group)) >= rule.at_least)
        return F.struct(s["end"].alias("start"), F.lit(order).alias("kind"), (s["end"] + F.length(piece)).alias("end"), good.alias("good"))

    start = F.struct(F.lit(0).alias("end"), F.lit(False).alias("is"))
    step = lambda s, piece: F.struct((s["end"] + F.length(piece)).alias("end"), (~s["is"]).alias("is"))
    cut = running(pieces, start, step, emit, "struct<start:int,kind:int,end:int,good:boolean>")
    spans = F.transform(F.filter(cut, lambda s: s["good"]), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return F.when(F.regexp_like(text, F.lit(rule.pattern)), spans).otherwise(F.array().cast(SPANS))


def unmarked(text: Column) -> Column:
    """The text without MARK and of the same length."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit(MARK), F.lit(OTHER))


def scan_text(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All spans of an unmarked text by start, then kind as listed."""
    return F.sort_array(F.flatten(F.array(*[_found(text, rule, k) for k, rule in enumerate(rules)])))


def written(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def address(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def ledger_of(spark: SparkSession, source: str) -> str:
    """The folder of the ledger that the registered queries keep for a source of texts, in the shared folder."""
    return f"{shared_dir(spark)}/secret-ledger-{hashlib.sha256(source.encode()).hexdigest()[:16]}"


def read_ledger(spark: SparkSession, ledger: str, version: str) -> DataFrame:
    """(blob, spans) of all blobs that were scanned under a rule version."""
    folder = f"{ledger}/version={version}"
    if exists(spark, folder):
        return spark.read.schema(f"blob string, spans {SPANS}").parquet(folder)
    return spark.createDataFrame([], f"blob string, spans {SPANS}")


def unseen(texts: DataFrame, blobs: DataFrame, seen: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(blob, spans) of the blobs (blob, k) that are not among those seen.

    Of the rows of a blob one is scanned: the one with the least key. Texts move once, to the tasks
    that scan them; a blob with very many paths is one row after its keys are combined in the map tasks.
    """
    chosen = blobs.join(seen.select("blob"), "blob", "left_anti")
    body = texts.select(F.col(key).alias("k0"), address(F.col(text)).alias("b0"), F.col(text).alias("text"))
    one = body.join(chosen.hint("shuffle_hash"), (F.col("blob") == F.col("b0")) & F.col("k").eqNullSafe(F.col("k0")))
    found = one.select("blob", unmarked(F.col("text")).alias("text")).select("blob", scan_text(F.col("text"), rules).alias("spans"))
    return found.groupBy("blob").agg(F.first("spans").alias("spans"))


def findings(texts: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(paths, found): paths (key, blob) of all rows, and (blob, spans) of their blobs, from the ledger once it has what was new.

    A ledger is a folder of (blob, spans) for each rule version; a blob without findings is kept with
    no spans, as scanned. Runs only append; what two runs at once have both scanned counts once.
    """
    spark, version = texts.sparkSession, rule_version(rules)
    paths = materialize(texts.select(F.col(key), address(F.col(text)).alias("blob")), "paths", wide=True)
    blobs = materialize(paths.groupBy("blob").agg(F.min(key).alias("k")), "blobs", wide=True)
    new = unseen(texts, blobs, read_ledger(spark, ledger, version), rules, key, text)
    sized(new, paths).write.mode("append").parquet(f"{ledger}/version={version}")
    found = read_ledger(spark, ledger, version).join(blobs.select("blob"), "blob", "left_semi").groupBy("blob").agg(F.first("spans").alias("spans"))
    # written before it is joined, so that a blob with very many paths can be split
    return paths, materialize(found, "findings", wide=True)


def scan(texts: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, blob, spans) for every row; spans is an array of (start, kind, end), kind counted from 0 as rules are listed."""
    paths, found = findings(texts, ledger, rules, key, text)
    return paths.join(found, "blob", "left").select(key, "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def redact(text: Column, spans: Column, by: str = "[secret]") -> Column:
    """The text with each of its spans, overlaps merged, replaced. The text is taken in pieces of CUT characters, so that no span counts them from the start."""
    source = F.coalesce(text, F.lit(""))
    emit = lambda at, span: F.struct(at.alias("from"), span["start"].alias("to"), (span["start"] >= at).alias("fresh"))
    gaps = F.filter(running(spans, F.lit(0), lambda at, span: F.greatest(at, span["end"]), emit, "struct<from:int,to:int,fresh:boolean>"), lambda g: g["fresh"])
    last = F.aggregate(spans, F.lit(0), lambda at, span: F.greatest(at, span["end"]))

    def between(pieces: Column, start: Column, end: Column) -> Column:
        i, j = F.floor(start / CUT).cast("int"), F.floor(end / CUT).cast("int")
        piece = lambda k: F.coalesce(F.get(pieces, k), F.lit(""))
        within = F.substring(piece(i), start % CUT + 1, end - start)
        across = F.concat(F.substring(piece(i), start % CUT + 1, F.lit(CUT)), F.array_join(F.slice(pieces, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substring(piece(j), F.lit(1), end % CUT))
        return F.when(i == j, within).otherwise(across)

    def joined(pieces: Column) -> Column:
        kept = F.concat(F.transform(gaps, lambda g: between(pieces, g["from"], g["to"])), F.array(between(pieces, last, F.length(source))))
        return F.array_join(kept, by)

    return let(F.regexp_extract_all(source, F.lit("(?s).{1,%d}" % CUT), F.lit(0)), joined)


def redacted(texts: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text", size: str = "n_chars") -> DataFrame:
    """texts with the same columns, secrets in text replaced, and size, where there is such a column, the new number of characters.

    Only rows with findings are changed; they are found by content, so texts do not move while the
    findings are few.
    """
    _, found = findings(texts, ledger, rules, key, text)
    found = found.where(F.size("spans") > 0)
    rows, spans = found.agg(F.count("*"), F.sum(F.size("spans"))).first()
    small = rows <= BROADCAST_ROWS and (spans or 0) <= BROADCAST_SPANS
    blob, own, at, new = fresh(texts, "blob", "address", "spans", "new")
    found = found.select(F.col("blob").alias(blob), F.col("spans").alias(at))
    joined = texts.withColumn(own, address(F.col(text))).join(F.broadcast(found) if small else found, F.col(own) == F.col(blob), "left")
    marked = joined.withColumn(new, F.when(F.col(at).isNotNull(), redact(F.col(text), F.col(at))))
    changed = {text: F.coalesce(new, text)}
    if size in texts.columns:
        changed[size] = F.coalesce(F.length(new), size).cast(texts.schema[size].dataType)
    return marked.select(*[changed.get(c, F.col(c)).alias(c) for c in texts.columns])
