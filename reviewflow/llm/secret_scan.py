"""Secret scans with an incremental ledger of blobs.

Every text is addressed by the SHA-256 of its content. A ledger keeps, for each
blob, the rule versions it was scanned with and what they found; a run scans only
pairs of blob and rule version that are not in it, each blob once however many
documents hold it, and joins the findings back to all of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewflow.llm import spans
from reviewflow.llm.common import hot_keys, spread_join
from reviewflow.session import stored, work_folder

FINDINGS = "array<struct<rule:string,kind:string,start:int,end:int>>"
LEDGER = f"blob string, rules array<string>, findings {FINDINGS}"


@dataclass(frozen=True)
class Rule:
    """A pattern with a version; ``hints`` are lower-case texts of which a matching text holds one.

    Matches are leftmost and do not overlap; one shorter than ``least``, measured
    in ``group``, is dropped.
    """

    kind: str
    version: int
    pattern: str
    hints: tuple[str, ...] = ()
    least: int = 0
    group: int = 0

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


# Fixed patterns. Possessive quantifiers and the length in ``hex`` change no match:
# what follows them cannot begin with what they hold.
BASE = (
    Rule("assign", 1, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)""",
         ("passw", "secret", "token", "api"), 8, 1),
    Rule("access", 1, r"AKIA[A-Z0-9]++", ("akia",), 16),
    Rule("hex", 1, r"[0-9a-f]{32,}+", (), 32),
)
#: Formats that name their issuer, so that ordinary text does not hold them.
MORE = (
    Rule("pem", 1, r"-----BEGIN (?:(?!PRIVATE)[A-Z]++ )*+PRIVATE KEY-----[A-Za-z0-9+/=\s]++-----END (?:(?!PRIVATE)[A-Z]++ )*+PRIVATE KEY-----", ("private key",)),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+", ("eyj",)),
    Rule("forge", 1, r"gh[pousr]_[A-Za-z0-9]{36,}+", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("chat", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}+", ("xox",)),
    Rule("login", 1, r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,200}+:[^\s/:@]{3,200}+@[A-Za-z0-9.-]++", ("://",)),
)
RULES = BASE + MORE


def blobs(docs: DataFrame) -> DataFrame:
    """doc (doc_id, null as the least long), blob and text of each row; a null text is empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select(
        "doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc"), F.sha2("text", 256).alias("blob"), "text"
    )


def _findings(rule: Rule) -> Column:
    """The matches of a rule that are long enough."""
    passed = F.col(rule.kind)
    if rule.least:
        passed = F.filter(passed, lambda s: F.length(F.regexp_extract(s["text"], rule.pattern, rule.group)) >= rule.least)
    return F.transform(passed, lambda s: F.struct(
        F.lit(rule.name).alias("rule"), F.lit(rule.kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")
    ))


def _scan(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Ledger rows of ``rows`` (blob, text, done), scanned with the rules not in ``done``."""
    rows = rows.withColumn("low", F.lower("text"))
    patterns: dict[str, tuple[str, Column | None]] = {}
    for rule in rules:
        due = ~F.array_contains("done", rule.name)
        hint = F.lit(True)
        if rule.hints:
            hint = F.lit(False)
            for text in rule.hints:
                hint = hint | F.contains("low", F.lit(text))
        patterns[rule.kind] = (rule.pattern, due & hint)
    found = spans.find(rows, "text", patterns)
    parts = []
    for rule in rules:
        parts.append(_findings(rule))
    names = F.array(*[F.lit(r.name) for r in rules])
    return found.select("blob", F.array_except(names, "done").alias("rules"), F.concat(*parts).cast(FINDINGS).alias("findings"))


def update_ledger(docs: DataFrame, ledger_path: str, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """Scan what the ledger lacks, append it, and return (the ledger, addresses of ``docs``).

    Of the documents that hold an unseen blob only the one with the least id is
    read again; its text alone is moved.
    """
    spark = docs.sparkSession
    at = stored(blobs(docs).select("doc_id", "doc", "blob"), "blob-addresses")
    known = at.groupBy("blob").agg(F.min("doc").alias("doc"))
    ledger = read_ledger(spark, ledger_path)
    names = F.array(*[F.lit(r.name) for r in rules])
    seen = F.flatten(F.collect_list("rules"))
    done = ledger.groupBy("blob").agg(F.array_distinct(seen).alias("done"))
    due = known.join(done, "blob", "left").withColumn("done", F.coalesce("done", F.array().cast("array<string>")))
    due = due.where(F.size(F.array_except(names, "done")) > 0)
    texts = blobs(docs).join(due.hint("shuffle_hash"), ["doc", "blob"]).select("blob", "text", "done")
    _scan(texts, rules).write.mode("append").parquet(ledger_path)
    return read_ledger(spark, ledger_path), at


def read_ledger(spark, path: str) -> DataFrame:
    """The ledger, empty when nothing has been written yet."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(path)


def scan(docs: DataFrame, ledger_path: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row of ``docs``: doc_id, blob, findings (rule, kind, start, end; by start).

    Without a path the ledger is new. Null texts are empty, a null doc_id is kept
    as such, identical rows each get the findings; other columns are not read.
    Offsets are code points, ends exclusive.
    """
    ledger, at = update_ledger(docs, ledger_path or work_folder(docs.sparkSession, "blob-ledger"), rules)
    current = [r.name for r in rules]
    hits = ledger.where(F.size("findings") > 0).groupBy("blob").agg(F.flatten(F.collect_list("findings")).alias("findings"))
    # A blob that two rows with one id hold was scanned twice, with equal findings.
    hits = hits.withColumn("findings", F.array_distinct(F.filter("findings", lambda f: f["rule"].isin(current))))
    counts = at.groupBy("blob").agg(F.count("*").alias("n"))
    found = spread_join(at, hits, ["blob"], hot_keys(counts, ["blob"], at.count()), F.col("doc"), "left")
    return found.select("doc_id", "blob", F.coalesce("findings", F.array().cast(FINDINGS)).alias("findings"))
