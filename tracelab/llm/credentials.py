"""Secret scan with multipart credential linking, in DataFrame functions alone.

Base kinds are reported wherever they stand. Weak kinds (an account name, a mixed token, a short assigned value, an
endpoint) mean little alone; one is reported only if at most SCOPE code points stand between it and a part that
completes it, however long the parts are: an identifier with a secret, a secret with an identifier or an endpoint, an
endpoint with a secret. Weak parts that overlap a base span are left out.

Texts stay where they are scanned; only positions are shuffled. The interval join is a sweep over each text: every weak
part asks, at its end and SCOPE further, for the farthest end of the completing parts that began before. A part takes
part twice at most, however many parts a document has.

Null text counts as empty. Repeated rows are scanned one by one. A document without spans has a row with zeros.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelab.llm.common import free_name, text_of
from tracelab.session import durable

# The base patterns.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}

SCOPE = 256
KINDS = ("assign", "access", "hex", "account", "mixed", "short", "endpoint")
BASE = KINDS[:3]
ROLE = {"assign": "secret", "access": "id", "hex": "secret", "account": "id", "mixed": "secret", "short": "secret", "endpoint": "endpoint"}
ACCOUNT = r"""(?i:(?:access_?key_?id|client_?id|account|user_?name|login))["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}"""
MIXED = r"[A-Za-z0-9+/_-]{20,}"
ENDPOINT = r"""(?i:https?|jdbc:[a-z]+|postgres|mysql|amqp|redis)://[^\s"'<>]+"""
_MIXED_TOO = r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])"


def _items(text: Column, kind: str, pattern: str, present: Column) -> Column:
    """Matches of a pattern in order: what stands between them is measured by splitting at them."""
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.transform(
        F.arrays_zip(gaps.alias("gap"), hits.alias("hit")),
        lambda x, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("place"), F.char_length(x["gap"]).alias("gap"), x["hit"].alias("hit")
        ),
    )
    return F.when(present, pairs)


def parts(docs: DataFrame) -> DataFrame:
    """(row, doc_id, content, kind, role, begin, end, base) of all parts; a document without one has a row of nulls.

    `row` numbers the rows of docs; `content` is a hash of doc_id and text. Base spans are final, weak ones candidates.
    """
    text = F.col("text")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text_of().alias("text"))
    found = F.concat(
        *[
            F.coalesce(_items(text, kind, pattern, present), F.array().cast("array<struct<kind:string,place:int,gap:int,hit:string>>"))
            for kind, pattern, present in (
                # maximal runs of one class: a shorter run can't hold a longer match, so the least length may be asked here
                ("assign", ASSIGN, text.rlike(ASSIGN)),
                ("access", r"AKIA[A-Z0-9]{16,}", text.contains("AKIA")),
                ("hex", r"[0-9a-f]{24,}", text.rlike(r"[0-9a-f]{24}")),
                ("account", ACCOUNT, text.rlike(ACCOUNT)),
                ("mixed", MIXED, text.rlike(MIXED)),
                ("endpoint", ENDPOINT, text.contains("://")),
            )
        ]
    )
    rows = rows.select("row", "doc_id", F.xxhash64("doc_id", "text").alias("content"), F.explode_outer(found).alias("item"))
    rows = rows.select("row", "doc_id", "content", "item.*").withColumn("long", F.char_length("hit"))
    before = Window.partitionBy("row", "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum(F.col("gap") + F.coalesce("long", F.lit(0))).over(before), F.lit(0)) + F.col("gap")
    value = F.regexp_extract("hit", ASSIGN, 2)
    kind = F.when((F.col("kind") == "assign") & (F.char_length(value) < LEAST["assign"]), F.lit("short"))
    kind = kind.when((F.col("kind") == "mixed") & ~F.col("hit").rlike(_MIXED_TOO), F.lit(None)).otherwise(F.col("kind"))
    rows = rows.withColumn("begin", begin).withColumn("end", F.col("begin") + F.col("long"))
    rows = rows.withColumn("kind", F.when(F.col("hit").isNotNull(), kind))
    role = F.create_map(*[F.lit(x) for pair in ROLE.items() for x in pair])[F.col("kind")]
    return rows.select(
        "row", "doc_id", "content", "kind", role.alias("role"), "begin", "end", F.coalesce(F.col("kind").isin(*BASE), F.lit(False)).alias("base")
    )


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak parts (row, kind, begin, end) that a complementary part, `scope` code points away at most, completes."""
    spans = found.where("kind is not null")
    earlier = Window.partitionBy("row").orderBy("begin").rangeBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy("row").orderBy("begin").rangeBetween(0, Window.unboundedFollowing)
    own_end, own_begin = F.when(F.col("base"), F.col("end")), F.when(F.col("base"), F.col("begin"))
    covered = (F.coalesce(F.max(own_end).over(earlier), F.lit(0)) > F.col("begin")) | (
        F.coalesce(F.min(own_begin).over(later), F.col("end")) < F.col("end")
    )
    spans = spans.withColumn("covered", covered & ~F.col("base")).where("not covered")
    # a part is near if it begins by end + scope and ends no earlier than begin - scope
    steps = F.array(
        F.struct(F.col("begin").alias("at"), F.lit(False).alias("asks")),
        F.struct((F.col("end") + scope).alias("at"), F.lit(True).alias("asks")),
    )
    steps = spans.withColumn("step", F.explode(F.when(F.col("base"), F.slice(steps, 1, 1)).otherwise(steps)))
    steps = steps.select("*", "step.at", "step.asks")
    so_far = Window.partitionBy("row").orderBy("at").rangeBetween(Window.unboundedPreceding, 0)

    def farthest(role: str) -> Column:
        return F.max(F.when(~F.col("asks") & (F.col("role") == role), F.col("end"))).over(so_far).alias(f"{role}_end")

    def close(role: str) -> Column:
        return F.coalesce(F.col(f"{role}_end") >= F.col("begin") - scope, F.lit(False))

    completed = F.when(F.col("role") == "secret", close("id") | close("endpoint")).otherwise(close("secret"))
    weak = steps.select("*", *[farthest(r) for r in ("id", "secret", "endpoint")]).where("asks")
    return weak.where(completed).select("row", "doc_id", "content", "kind", "begin", "end")


def _order() -> Column:
    return F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])[F.col("kind")]


def reported(docs: DataFrame) -> DataFrame:
    """(row, doc_id, content, kind, begin, end, base): all spans to report, and a row of nulls per row of docs."""
    found = durable(parts(docs))  # positions only: they are read three times
    base = found.where("base").select("row", "doc_id", "content", "kind", "begin", "end", "base")
    weak = linked(found).withColumn("base", F.lit(False))
    rows = found.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("content").alias("content"))
    empty = rows.select("row", "doc_id", "content", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("long").alias("begin"), F.lit(None).cast("long").alias("end"), F.lit(False).alias("base"))
    return base.unionByName(weak).unionByName(empty)


def scan(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked."""
    rows = reported(docs).withColumn("mark", F.concat_ws(":", "kind", F.col("begin").cast("string"), F.col("end").cast("string")))
    span = F.struct("begin", _order().alias("order"), "end", "mark")
    joined = lambda c: F.array_join(F.transform(F.sort_array(F.col(c)), lambda x: x["mark"]), ",")
    lists = rows.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        *[F.count_if(F.col("base") & (F.col("kind") == k)).alias(f"n_{k}") for k in BASE],
        F.count_if(~F.col("base") & F.col("kind").isNotNull()).alias("n_linked"),
        F.collect_list(F.when(F.col("base"), span)).alias("base"),
        F.collect_list(F.when(F.col("kind").isNotNull(), span)).alias("all"),
    )
    return lists.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(joined("base"), 256).alias("base_sha256"), joined("all").alias("spans"), "n_linked"
    )


def masked(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """docs with every reported span of `text` replaced by `mask`; other columns and rows stay."""
    spans = reported(docs).where("kind is not null").select("doc_id", "content", "begin", "end").distinct()
    order = Window.partitionBy("doc_id", "content").orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.coalesce(F.col("begin") >= F.max("end").over(order), F.lit(True)).cast("int")
    run = Window.partitionBy("doc_id", "content").orderBy("begin", "end")
    runs = spans.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(run))
    runs = runs.groupBy("doc_id", "content", "run").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    doc, content, found, hashed = (free_name(docs, c) for c in ("_doc", "_content", "_cuts", "_hash"))
    cuts = runs.groupBy("doc_id", "content").agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias(found))
    cuts = cuts.select(F.col("doc_id").alias(doc), F.col("content").alias(content), found)
    rows = docs.withColumn(hashed, F.xxhash64("doc_id", text_of()))
    both = rows.join(cuts, (rows[hashed] == cuts[content]) & rows["doc_id"].eqNullSafe(cuts[doc]), "left")
    begin = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(found, i - 1)["end"]).cast("int")
    end = lambda i: F.coalesce(F.get(found, i)["begin"].cast("int"), F.char_length("text"))
    pieces = F.transform(F.sequence(F.lit(0), F.size(found)), lambda i: F.substring(F.col("text"), begin(i) + 1, end(i) - begin(i)))
    text = F.when(F.col(found).isNull(), F.col("text")).otherwise(F.array_join(pieces, mask))
    return both.withColumn("text", text).select(*docs.columns)
