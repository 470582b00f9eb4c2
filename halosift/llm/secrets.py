r"""Secret scan with multipart credential linking, in DataFrame operations only.

Strong parts are always reported: ``assign`` (a secret's name with its value),
``access`` (an access identifier) and ``hex`` (a long hexadecimal run). Weak
parts say little alone: ``key`` (a long run of letters and digits of mixed
kinds), ``login`` (a user's name with its value) and ``endpoint`` (an address).
They are reported only next to a complementary part, at most ``SCOPE`` code
points away: a key next to an identifier (access, login) or an endpoint, a login
or an endpoint next to a secret (assign, hex, key).

All matches become rows (document, kind, start, end); starts are running sums of
the lengths of gaps and matches, since the pattern functions give texts and not
places. The interval join meets in cells of ``SCOPE`` code points: each weak
part goes to the cells it reaches, each complementary part to the cells it
covers, and a semi-join in each cell asks for an overlap, so no pairs are made.
The same part is never its own partner.

Null and empty texts have no parts. Rows that are equal in doc_id and text are
alike and get the same result; a null doc_id is a value like others. Other
columns do not matter to `report`. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halosift.llm.tables import pin

SCOPE = 200
# The patterns of the strong parts.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
LEAST_VALUE = 12
KEY = r"[A-Za-z0-9+/_-]{24,}"
LOGIN = r"""(?i:(user|username|user_name|login|client_id|account))["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]+)"""
ENDPOINT = r"""(?i:https?|ftp|ssh|postgres|postgresql|mysql|mongodb|redis|amqp)://[^\x20\x09-\x0D"'<>]+"""

#: kind, pattern, group whose length counts (0: none), in the order of report.
KINDS = [("assign", ASSIGN, 2), ("access", ACCESS, 0), ("hex", HEX, 0), ("key", KEY, 0), ("login", LOGIN, 2), ("endpoint", ENDPOINT, 0)]
STRONG = ("assign", "access", "hex")
IDENTIFIERS, SECRETS = ("access", "login"), ("assign", "hex", "key")


def _matches(text: Column, kind: str, pattern: str, group: int) -> Column:
    """Array of (n, kind, gap before, length, whether it counts, whether letters and digits mix)."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    each = F.transform(
        F.arrays_zip(found.alias("m"), F.slice(gaps, 1, F.size(found)).alias("g"), value.alias("v")),
        lambda x, i: F.struct(
            i.alias("n"), F.lit(kind).alias("kind"), F.length(x["g"]).alias("gap"), F.length(x["m"]).alias("size"),
            (F.length(x["v"]) >= (LEAST_VALUE if kind == "assign" else 1)).alias("counts"),
            (x["m"].rlike("[0-9]") & x["m"].rlike("[A-Z]") & x["m"].rlike("[a-z]") if kind == "key" else F.lit(True)).alias("mixed"),
        ))
    return F.when(text.rlike(pattern), each)


def keys() -> list[Column]:
    """Two hashes that name a document: of its id and of its text."""
    return [F.xxhash64("doc_id").alias("k1"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("k2")]


def parts(docs: DataFrame) -> DataFrame:
    """(k1, k2, kind, start, end) of all strong and weak parts, one for equal rows."""
    empty = "array<struct<n:int,kind:string,gap:int,size:int,counts:boolean,mixed:boolean>>"
    text = F.col("text")
    every = F.concat(*[F.coalesce(_matches(text, *k), F.array().cast(empty)) for k in KINDS])
    rows = docs.select(*keys(), F.explode(every).alias("x")).select("k1", "k2", "x.*").dropDuplicates(["k1", "k2", "kind", "n"])
    before = Window.partitionBy("k1", "k2", "kind").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap").cast("long") + F.col("size")).over(before)
    rows = rows.withColumn("end", end).withColumn("start", F.col("end") - F.col("size"))
    return rows.filter("counts AND mixed").select("k1", "k2", "kind", "start", "end")


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak parts with a complementary part in their scope."""
    other = (F.when(F.col("kind").isin("key"), F.array(F.lit("access"), F.lit("login"), F.lit("endpoint")))
             .otherwise(F.array(*map(F.lit, SECRETS))))
    cell = lambda x: F.floor(x / scope)
    weak = found.filter(~F.col("kind").isin(*STRONG)).withColumn("wants", other)
    weak = weak.withColumn("cell", F.explode(F.sequence(cell(F.greatest(F.col("start") - scope, F.lit(0))), cell(F.col("end") + scope))))
    near = found.select("k1", "k2", F.col("kind").alias("its_kind"), F.col("start").alias("its_start"), F.col("end").alias("its_end"))
    near = near.withColumn("cell", F.explode(F.sequence(cell(F.col("its_start")), cell(F.col("its_end") - 1))))
    meets = [weak[c] == near[c] for c in ("k1", "k2", "cell")]
    on = meets[0] & meets[1] & meets[2] & F.array_contains("wants", F.col("its_kind")) & (
        F.col("its_start") < F.col("end") + scope) & (F.col("its_end") > F.col("start") - scope) & ~(
        (F.col("its_start") < F.col("end")) & (F.col("its_end") > F.col("start")))
    return weak.join(near, on, "left_semi").select("k1", "k2", "kind", "start", "end").distinct()


def _listed(spans: Column) -> Column:
    """kind:start:end, by start and then by the order of kinds."""
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])))


def report(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row per document: counts of strong parts, base_sha256 of theirs, spans of all parts."""
    docs = docs.select("doc_id", "text")
    found = pin(parts(docs))
    spans = found.filter(F.col("kind").isin(*STRONG)).unionByName(linked(found, scope))
    order = F.array_position(F.array(*[F.lit(k) for k, _, _ in KINDS]), F.col("kind"))
    one = F.struct("start", order.alias("o"), "kind", "end")
    strong = F.col("kind").isin(*STRONG)
    count = lambda kind: F.count(F.when(F.col("kind") == kind, 1))
    per = spans.groupBy("k1", "k2").agg(
        *[count(k).alias(f"n_{k}") for k in STRONG],
        _listed(F.collect_list(F.when(strong, one))).alias("base"), _listed(F.collect_list(one)).alias("spans"))
    rows = docs.select("doc_id", *keys()).join(per, ["k1", "k2"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.select("doc_id", *[zero(f"n_{k}") for k in STRONG],
                       F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))
