"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions alone.

Tokens are summed per cell (source, language, topic). Each round scales the cells' weights to the target share of
every value of one dimension after another. A cell's documents are then kept with probability
min(1, c * weight / tokens), where c is set so that the expected tokens are `share` of all; a document's draw is a
hash of its doc_id, so a repeated run keeps the same ones.

The weights follow the targets, the kept tokens only as far as no cell reaches probability 1: what is cut off there goes
to all other cells by the common c and is not raked again. `achieved` returns the kept shares beside their targets.

Tokens are runs of characters other than white space. Null text counts as empty; null source, language or topic is a
value of its own ("(none)"). Repeated rows are drawn alike. A cell without tokens keeps the factor c. The sums are made
per task before they are shuffled, so a source with a third of all rows is no heavier than another; the cells meet the
documents by a broadcast only below a counted size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelab.llm.common import free_name, text_of
from tracelab.session import durable

DIMENSIONS = ("source", "lang", "topic")
ROUNDS, SCALINGS = 12, 12
CELLS_BROADCAST = 50_000
WORD = r"[^ \t\n\r\x0b\f]+"
#: A document's topic is the one whose words occur most often in it, the first on a tie, "prose" without any.
TOPICS = {
    "legal": ("license", "copyright", "warranty", "permission"),
    "credentials": ("token", "password", "secret", "api_key"),
    "contact": ("@", "phone", "email", "call"),
}
OTHER = "prose"


def topic_of(text: Column, topics: dict[str, tuple[str, ...]] = TOPICS) -> Column:
    low = F.lower(text)
    hits = {
        name: sum(((F.octet_length(low) - F.octet_length(F.replace(low, F.lit(w), F.lit("")))) / len(w) for w in words), F.lit(0.0))
        for name, words in topics.items()
    }
    most = F.greatest(*hits.values(), F.lit(0.0))
    out = F.when(most == 0, OTHER)
    for name, n in hits.items():
        out = out.when(n == most, name)
    return out


def measured(docs: DataFrame, topics: dict[str, tuple[str, ...]] = TOPICS) -> DataFrame:
    """doc_id, source, lang, topic, tokens."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit("(none)")).alias(c) for c in ("source", "lang")]
    rows = docs.select("doc_id", *named, text_of().alias("text"))
    return rows.select(
        "doc_id", "source", "lang", topic_of(F.col("text"), topics).alias("topic"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("tokens")
    )


def cell_totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n_docs"))


def tempered(cells: DataFrame, dimension: str, power: float = 0.5) -> DataFrame:
    """(value, share): target shares proportional to the tokens of each value to a power under 1."""
    sums = cells.groupBy(F.col(dimension).alias("value")).agg(F.pow(F.sum("tokens").cast("double"), power).alias("raw"))
    return sums.select("value", F.coalesce(F.try_divide("raw", F.sum("raw").over(Window.partitionBy(F.lit(0)))), F.lit(0.0)).alias("share"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """cells with `weight`: tokens scaled until each dimension's shares are those of its target (value, share).

    A value without a target gets none; one without tokens can't be reached. Each round is written, so that plans
    stay short.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    rows = cells.withColumn("weight", F.col("tokens").cast("double"))
    for name, target in targets.items():
        goal = target.select(F.col("value").alias(name), (F.col("share") * float(total)).alias(f"goal_{name}"))
        rows = rows.join(goal, name, "left").fillna(0.0, [f"goal_{name}"])
    rows = durable(rows)
    for _ in range(rounds):
        for name in targets:
            now = F.sum("weight").over(Window.partitionBy(name))
            rows = rows.withColumn("weight", F.coalesce(F.try_divide(F.col("weight") * F.col(f"goal_{name}"), now), F.lit(0.0)))
        rows = durable(rows)
    return rows.select(*cells.columns, "weight")


def probabilities(raked: DataFrame, share: float, scalings: int = SCALINGS) -> DataFrame:
    """raked with `probability`; c is found by scaling the cells below 1 again until no further cell reaches 1."""
    rows = raked.withColumn("factor", F.coalesce(F.try_divide("weight", "tokens"), F.lit(1.0)))
    c = 1.0
    total = rows.agg(F.sum("tokens")).first()[0] or 0
    for _ in range(scalings):
        full = F.col("factor") * c >= 1
        sums = rows.agg(F.sum(F.when(full, F.col("tokens"))).alias("full"), F.sum(F.when(~full, F.col("weight"))).alias("rest")).first()
        if not sums["rest"]:
            break
        c = max(0.0, share * total - (sums["full"] or 0)) / sums["rest"]
    return rows.withColumn("probability", F.least(F.lit(1.0), F.col("factor") * F.lit(c))).drop("factor")


def draw(doc_id: Column, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on doc_id and the seed alone; null ids draw as one."""
    name = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("double") / float(1 << 52)


def chances(docs: DataFrame, share: float = 0.6, power: float = 0.5, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """(source, lang, topic, probability) of each cell, stored; targets default to tempered shares."""
    cells = durable(cell_totals(measured(docs)))
    targets = targets or {d: durable(tempered(cells, d, power)) for d in DIMENSIONS}
    return durable(probabilities(rake(cells, targets), share).select(*DIMENSIONS, F.round("probability", 6).alias("probability")))


def _met(rows: DataFrame, cells: DataFrame) -> DataFrame:
    n = cells.limit(CELLS_BROADCAST + 1).count()
    # every row has its cell; an inner join would test the derived topic for null and so derive it twice
    return rows.join(F.broadcast(cells) if n <= CELLS_BROADCAST else cells, list(DIMENSIONS), "left")


def sampled(docs: DataFrame, share: float = 0.6, power: float = 0.5, seed: int = 0, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """Per document: doc_id, source, lang, topic, tokens, probability, kept."""
    both = _met(measured(docs), chances(docs, share, power, targets))
    return both.select("doc_id", *DIMENSIONS, "tokens", "probability", (draw(F.col("doc_id"), seed) < F.col("probability")).alias("kept"))


def kept_rows(docs: DataFrame, share: float = 0.6, power: float = 0.5, seed: int = 0) -> DataFrame:
    """The rows of docs, with their columns, that the sample keeps."""
    names = {c: free_name(docs, f"_{c}") for c in DIMENSIONS}
    chance = free_name(docs, "_probability")
    cells = chances(docs, share, power)
    keyed = docs
    for c in ("source", "lang"):
        keyed = keyed.withColumn(names[c], F.coalesce(F.col(c).cast("string"), F.lit("(none)")))
    keyed = keyed.withColumn(names["topic"], topic_of(text_of()))
    cells = cells.withColumnsRenamed(names).withColumnRenamed("probability", chance)
    n = cells.limit(CELLS_BROADCAST + 1).count()
    both = keyed.join(F.broadcast(cells) if n <= CELLS_BROADCAST else cells, list(names.values()), "left")
    # documents without an id are told apart by their texts
    return both.where(draw(F.coalesce("doc_id", F.xxhash64("text")), seed) < F.col(chance)).select(*docs.columns)


def achieved(docs: DataFrame, share: float = 0.6, power: float = 0.5, seed: int = 0, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """(dimension, value, target, available, achieved, reachable): shares of the tokens wanted, in docs, and kept.

    `reachable` tells if docs has the tokens of that value that its target asks for at `share` of all tokens.
    """
    rows = sampled(docs, share, power, seed, targets)
    cells = durable(rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens"), F.sum(F.when(F.col("kept"), F.col("tokens")).otherwise(0)).alias("kept")))
    targets = targets or {d: tempered(cells, d, power) for d in DIMENSIONS}
    total = cells.agg(F.sum("tokens").alias("tokens"), F.sum("kept").alias("kept")).first()
    part = lambda c: F.coalesce(F.try_divide(F.col(c), F.lit(float(total[c] or 0))), F.lit(0.0))
    out = None
    for d, target in targets.items():
        sums = cells.groupBy(F.col(d).alias("value")).agg(F.sum("tokens").alias("tokens"), F.sum("kept").alias("kept"))
        both = sums.join(target.select("value", F.col("share").alias("target")), "value", "full").fillna(0, ["tokens", "kept", "target"])
        both = both.select(
            F.lit(d).alias("dimension"), "value", "target", part("tokens").alias("available"), part("kept").alias("achieved"),
            (F.col("target") * share <= part("tokens") + 1e-9).alias("reachable"),
        )
        out = both if out is None else out.unionByName(both)
    return out


def mixture_sql(share: float = 0.6, power: float = 0.5, seed: int = 0, docs: str = "documents") -> str:
    """The same in DuckDB SQL: a step of common table expressions for each scaling."""

    def hits(words: tuple[str, ...]) -> str:
        return " + ".join(f"(strlen(low) - strlen(replace(low, '{w}', ''))) / {len(w)}.0" for w in words)

    counts = ", ".join(f"{hits(w)} AS h_{name}" for name, w in TOPICS.items())
    most = "greatest(" + ", ".join(f"h_{n}" for n in TOPICS) + ", 0)"
    topic = f"CASE WHEN {most} = 0 THEN '{OTHER}' " + " ".join(f"WHEN h_{n} = {most} THEN '{n}'" for n in TOPICS) + " END"
    keys = ", ".join(DIMENSIONS)
    steps = [
        f"r0 AS (SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang, coalesce(text, '') AS text, lower(coalesce(text, '')) AS low FROM {docs})",
        f"r1 AS (SELECT doc_id, source, lang, len(regexp_extract_all(text, '{WORD}'))::BIGINT AS tokens, {counts} FROM r0)",
        f"r AS MATERIALIZED (SELECT doc_id, source, lang, tokens, {topic} AS topic FROM r1)",
        f"w0 AS MATERIALIZED (SELECT {keys}, sum(tokens)::BIGINT AS tokens, sum(tokens)::DOUBLE AS weight, (SELECT sum(tokens)::DOUBLE FROM r) AS total FROM r GROUP BY {keys})",
    ]
    for d in DIMENSIONS:
        steps.append(f"g_{d} AS MATERIALIZED (SELECT {d}, raw / sum(raw) OVER () AS share FROM (SELECT {d}, power(sum(tokens)::DOUBLE, {power}) AS raw FROM w0 GROUP BY {d}))")
    k = 0
    for _ in range(ROUNDS):
        for d in DIMENSIONS:
            now = f"sum(weight) OVER (PARTITION BY {d})"
            steps.append(
                f"w{k + 1} AS MATERIALIZED (SELECT {keys}, tokens, total, CASE WHEN now > 0 THEN weight * (share * total) / now ELSE 0 END AS weight "
                f"FROM (SELECT *, {now} AS now FROM w{k}) JOIN g_{d} USING ({d}))"
            )
            k += 1
    steps.append(f"f AS MATERIALIZED (SELECT {keys}, tokens, weight, total, CASE WHEN tokens > 0 THEN weight / tokens ELSE 1.0 END AS factor FROM w{k})")
    steps.append("c0 AS MATERIALIZED (SELECT 1.0::DOUBLE AS c)")
    for i in range(SCALINGS):
        steps.append(
            f"c{i + 1} AS MATERIALIZED (SELECT CASE WHEN coalesce(sum(weight) FILTER (factor * c < 1), 0) = 0 THEN max(c) ELSE greatest(0, {share} * max(total) - coalesce(sum(tokens) FILTER (factor * c >= 1), 0)) / sum(weight) FILTER (factor * c < 1) END AS c FROM f, c{i})"
        )
    chance = f"round(least(1.0, factor * (SELECT c FROM c{SCALINGS})), 6)"
    uniform = f"('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':{seed}'), 1, 13))::BIGINT / {float(1 << 52)}"
    return (
        "WITH " + ",\n".join(steps) + f"\nSELECT doc_id, {', '.join('r.' + d for d in DIMENSIONS)}, r.tokens, {chance} AS probability, {uniform} < {chance} AS kept "
        f"FROM r JOIN f USING ({keys})"
    )
