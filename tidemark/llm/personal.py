"""Personal data in texts: e-mail and IP addresses, card and phone numbers by their form, and more of them by where they stand.

Bootstrapping: what has the form of a kind is a seed. The words around seeds are lexical patterns; looser strings (numbers, addresses
without a dot or written out) are instances that may be of a kind, and share patterns with seeds and with each other. In rounds, a
pattern's confidence follows from the instances that it stands by, an instance's score from its patterns, and instances above a threshold
count for patterns in the next round. Accepted instances are spans wherever they stand, and so are seeds' values written otherwise.

The graph is made of distinct (pattern, instance) pairs, so copies of a text weigh no more than one, and its counts are partial
aggregates before any shuffle. Confidences are whole millionths, so that sums do not depend on their order. DataFrame functions only.

Java matches patterns by backtracking, so those used here are forms of the plain ones that match the same in linear time: possessive runs,
which begin where a run begins or a match has ended, and lazy ones that stop where the plain ones would.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, written

KINDS = ("email", "ip", "card", "phone")
LOCAL, DOMAIN = "A-Za-z0-9._%+-", "A-Za-z0-9-"
RUN = rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++"
#: Base patterns as they are run, and as they are meant (fixed values).
FAST = {
    "email": rf"{RUN}@[{DOMAIN}]++\.[{DOMAIN}][{DOMAIN}.]*?(?=\.(?![{DOMAIN}])|[^{DOMAIN}.]|\z)",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9][0-9 -]*?(?<=[0-9])(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
AT, DOT = r" ?[(\[](?:at|AT)[)\]] ?", r" ?[(\[](?:dot|DOT)[)\]] ?"
#: Instances: addresses with or without a dot, or written out, and numbers of two digits or more.
NUMBER = r"[+(]?[0-9][0-9 ().:-]*[0-9]"
LOOSE_FAST = rf"{RUN}(?:@|{AT})[{DOMAIN}]++(?:(?:\.|{DOT})[{DOMAIN}]++){{0,8}}|{NUMBER}"
LOOSE = rf"[{LOCAL}]+(?:@|{AT})[{DOMAIN}]+(?:(?:\.|{DOT})[{DOMAIN}]+){{0,8}}|{NUMBER}"
#: Parts of at most 255, with any zeros before them.
IP_PARTS = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})){3}$"
DOTTED = r"^[0-9]+\.[0-9]+\.[0-9][0-9.]*$"
#: Characters on either side that words of a pattern are taken from.
CONTEXT = 40
#: Rounds; least confidence of a pattern and score of an instance (millionths); instances that may be of the kind count a quarter
#: against a pattern, and two imagined ones count against it too.
ROUNDS, STRONG, ACCEPTED, UNKNOWN_PARTS, PRIOR = 3, 800_000, 500_000, 4, 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def valid(kind: str, value: Column) -> Column:
    """Whether a match is of its kind."""
    if kind == "ip":
        return value.rlike(IP_PARTS)
    if kind == "card":
        digits = F.translate(value, " -", "")
        return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(F.translate(value, "+ ().-", "")).between(8, 15)
    return F.lit(True)


def matches(text: Column, kind: str, pattern: str) -> Column:
    """Array of structs: kind, number, characters between it and the match before, value, and what stands around it. Splitting at matches gives
    what lies between them."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    n = F.size(found)
    # an expression within a function of elements would be evaluated for each of them, so lists are joined element by element
    between = F.when(n > 0, F.split(text, pattern, -1)).otherwise(F.array(F.lit("")))
    around = F.arrays_zip(found.alias("value"), F.slice(between, 1, n).alias("gap"), F.slice(between, 2, n).alias("next"))

    def one(x: Column, i: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), i.alias("i"), F.length(x["gap"]).cast("long").alias("gap"), x["value"].alias("value"),
            F.right(x["gap"], F.lit(CONTEXT)).alias("before"), F.left(x["next"], F.lit(CONTEXT)).alias("after"),
        )

    return F.transform(around, one)


def found_in(docs: DataFrame) -> DataFrame:
    """rid, doc_id, matches: a row per row of ``docs`` (doc_id, text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    every = F.concat(*[matches(text, k, p) for k, p in [*FAST.items(), ("", LOOSE_FAST)]])
    return docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", every.alias("matches"))


def norm(value: Column) -> Column:
    """What of a value tells identifiers apart: the digits of a number, but dotted numbers as they are; addresses in lower case with signs for words."""
    address = F.regexp_replace(F.regexp_replace(F.translate(value, UPPER, LOWER), AT, "@"), DOT, ".")
    return F.when(address.contains("@"), address).when(value.rlike(DOTTED), value).otherwise(F.translate(value, "+ ().:-", ""))


def may_be(kind: str) -> Column:
    """Whether an instance (by its norm) may be of a kind."""
    digits = F.length("norm")
    number = F.col("norm").rlike("^[0-9]+$")
    return {"email": F.contains("norm", F.lit("@")), "ip": F.col("norm").rlike(DOTTED), "card": number & digits.between(12, 19), "phone": number & digits.between(7, 15)}[kind]


def words_around() -> list[Column]:
    """l1, l2, r1: the word before, the two before, and the word after; digits as zeros. Where there is none, the text begins or ends."""
    folded = lambda c: F.filter(F.split(F.translate(F.col(c), UPPER + "123456789", LOWER + "0" * 9), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    l1, l2, r1 = F.get(F.reverse(folded("before")), F.lit(0)), F.get(F.reverse(folded("before")), F.lit(1)), F.get(folded("after"), F.lit(0))
    edge = lambda c: F.coalesce(c, F.lit(""))
    return [edge(l1).alias("l1"), F.concat_ws(" ", edge(l2), edge(l1)).alias("l2"), edge(r1).alias("r1")]


def located(found: DataFrame) -> DataFrame:
    """rid, kind ('' for instances), start, end, norm, l1, l2, r1 of matches that are valid, and of instances that touch no base match of any
    kind and no letter or digit. Positions are sums within a row's matches, made where its matches are, whatever their number."""
    m = found.select("rid", F.explode("matches").alias("m")).select("rid", "m.*").repartition("rid")
    size = F.length("value").cast("long")
    before = W.partitionBy("rid", "kind").orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    m = m.withColumn("end", F.sum(F.col("gap") + size).over(before)).withColumn("start", F.col("end") - size)
    good = F.lit(False)
    for k in KINDS:
        good = good | ((F.col("kind") == k) & valid(k, F.col("value")))
    alone = (F.col("kind") == "") & ~F.right("before", F.lit(1)).rlike("[A-Za-z0-9]") & ~F.left("after", F.lit(1)).rlike("[A-Za-z0-9]")
    m = m.where(good | alone)
    # both ways as running values: a frame that ends with the partition is made anew for each row
    keys, earlier = ("start", "end", "kind"), (W.unboundedPreceding, -1)
    reached = F.max(F.when(F.col("kind") != "", F.col("end"))).over(W.partitionBy("rid").orderBy(*keys).rowsBetween(*earlier))
    begun = F.min(F.when(F.col("kind") != "", F.col("start"))).over(W.partitionBy("rid").orderBy(*[F.col(k).desc() for k in keys]).rowsBetween(*earlier))
    m = m.withColumns({"reached": F.coalesce(reached, F.lit(0)), "begun": F.coalesce(begun, F.col("end"))})
    m = m.where((F.col("kind") != "") | ((F.col("reached") <= F.col("start")) & (F.col("begun") >= F.col("end"))))
    return m.select("rid", "kind", "start", "end", norm(F.col("value")).alias("norm"), *words_around())


def patterns() -> Column:
    """Of a context, one a row: the word before, the two before, the word after, and both."""
    return F.explode(F.array(F.concat(F.lit("< "), "l1"), F.concat(F.lit("<< "), "l2"), F.concat(F.lit("> "), "r1"), F.concat(F.lit("<> "), "l1", F.lit(" "), "r1")))


def graph(spans: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From ``located``: known (norm, and for each kind whether it is a seed); uses (unknown instances with their contexts, how many of these the
    instance has, and kinds that it may be of); counts (pattern, and for each kind seeds, unknown and other instances)."""
    known = spans.where("kind <> ''").groupBy("norm").agg(*[F.max((F.col("kind") == k).cast("int")).alias(f"is_{k}") for k in KINDS])
    contexts = spans.select("norm", "l1", "l2", "r1").distinct()
    uses = contexts.join(known, "norm", "left").select("norm", "l1", "l2", "r1", *[F.coalesce(f"is_{k}", F.lit(0)).alias(f"is_{k}") for k in KINDS], *[may_be(k).cast("int").alias(f"may_{k}") for k in KINDS])
    uses = written(uses, "uses")
    none = " + ".join(f"is_{k}" for k in KINDS) + " = 0"
    edges = uses.select("norm", patterns().alias("pattern"), *[f"is_{k}" for k in KINDS], *[f"may_{k}" for k in KINDS]).distinct()
    sums = []
    for k in KINDS:
        sums += [F.sum(f"is_{k}").alias(f"seeds_{k}"), F.sum(F.when(F.expr(none), F.col(f"may_{k}")).otherwise(0)).alias(f"unknown_{k}")]
    counts = edges.groupBy("pattern").agg(*sums, F.count("*").alias("n"))
    unknown = uses.where(none).drop(*[f"is_{k}" for k in KINDS])
    n_uses = unknown.groupBy("norm").agg(F.count("*").alias("n_uses"))
    return known, written(unknown.join(n_uses, "norm"), "unknown"), written(counts.where(" + ".join(f"seeds_{k}" for k in KINDS) + " > 0"), "patterns")


def confident(counts: DataFrame, gained: DataFrame | None) -> DataFrame:
    """pattern, kind, conf of the strong patterns. ``gained``: pattern, kind, n, score (a sum of millionths) of accepted instances."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"seeds_{k}").alias("seeds"), F.col(f"unknown_{k}").alias("unknown"), "n") for k in KINDS])).alias("c")
    table = counts.select("pattern", each).select("pattern", "c.*").where("seeds > 0").withColumnsRenamed({"n": "of"})
    if gained is None:
        table = table.withColumns({"score": F.lit(0).cast("long"), "more": F.lit(0).cast("long")})
    else:
        table = table.join(gained.withColumnsRenamed({"n": "more"}), ["pattern", "kind"], "left").na.fill(0)
    conf = f"((seeds * 1000000 + score) * {UNKNOWN_PARTS}) div (of * {UNKNOWN_PARTS} - (unknown - more) * {UNKNOWN_PARTS - 1} + {PRIOR * UNKNOWN_PARTS})"
    return table.select("pattern", "kind", F.expr(conf).alias("conf")).where(F.col("conf") >= STRONG)


def bootstrapped(uses: DataFrame, counts: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """norm, kind, score of accepted instances."""
    kinds = F.array_compact(F.array(*[F.when(F.col(f"may_{k}") == 1, k) for k in KINDS]))
    ways = uses.where(" + ".join(f"may_{k}" for k in KINDS) + " > 0").select("norm", "l1", "l2", "r1", "n_uses", kinds.alias("kinds"), patterns().alias("pattern"))
    accepted = gained = None
    for _ in range(rounds):
        strong = written(confident(counts, gained), "strong")
        best = ways.join(strong, "pattern").where(F.array_contains("kinds", F.col("kind"))).groupBy("norm", "l1", "l2", "r1", "n_uses", "kind").agg(F.max("conf").alias("conf"))
        scored = best.groupBy("norm", "n_uses", "kind").agg(F.sum("conf").alias("conf")).select("norm", "kind", F.expr("conf div n_uses").alias("score")).where(F.col("score") >= ACCEPTED)
        place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
        one = scored.groupBy("norm").agg(F.max_by(F.struct("kind", "score"), F.struct("score", -place)).alias("b")).select("norm", "b.kind", "b.score")
        accepted = written(one, "accepted")
        if accepted.isEmpty():  # nor would later rounds find any
            break
        gained = ways.select("norm", "pattern").distinct().join(accepted, "norm").groupBy("pattern", "kind").agg(F.sum("score").alias("score"), F.count("*").alias("n"))
    return accepted


def extracted(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """From ``found_in``: rid, kind, start, end, base (whether by its form)."""
    spans = written(located(found), "spans")
    known, uses, counts = graph(spans)
    accepted = bootstrapped(uses, counts, rounds)
    again = F.coalesce(*[F.when((F.col(f"is_{k}") == 1) & may_be(k), k) for k in KINDS])
    again = known.select("norm", again.alias("as")).where("as IS NOT NULL")
    named = again.union(accepted.select("norm", "kind"))
    loose = spans.where("kind = ''").drop("kind").join(named, "norm").select("rid", F.col("as").alias("kind"), "start", "end", F.lit(False).alias("base"))
    return spans.where("kind <> ''").select("rid", "kind", "start", "end", F.lit(True).alias("base")).union(loose)


def _joined(only_base: bool) -> Column:
    spans = F.col("spans")
    if only_base:
        spans = F.filter(spans, lambda s: s["base"])
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["place"])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"], s["end"])), ",")


def personal_data(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``docs`` (doc_id, text; others are ignored) -> a row per row: doc_id, n_email, n_ip, n_card, n_phone, base (spans by form) and spans (all), each span
    as kind:start:end in code points, in the order of kinds and then of places.

    Null and empty texts have none. Rows that repeat a doc_id or a text are rows of their own, and count once in the graph. A text of any
    length is matched in linear time, its spans in rows of their own; of very long words around a span the nearest ``CONTEXT`` characters are a
    pattern. Ties between kinds of an instance go to the first kind. An empty table gives an empty result."""
    found = written(found_in(docs), "found")
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    spans = extracted(found, rounds).withColumn("place", place)
    by = spans.groupBy("rid").agg(*[F.count_if((F.col("kind") == k) & F.col("base")).alias(f"n_{k}") for k in KINDS], F.sort_array(F.collect_list(F.struct("place", "start", "end", "base"))).alias("spans"))
    by = by.select("rid", *[f"n_{k}" for k in KINDS], _joined(True).alias("base"), _joined(False).alias("spans"))
    return found.select("rid", "doc_id").join(by, "rid", "left").na.fill(0, [f"n_{k}" for k in KINDS]).na.fill("", ["base", "spans"]).drop("rid")


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls, ties and the like: see ``personal_data``."""
    out = personal_data(documents(spark, sf_dir))
    return out.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2("base", 256).alias("base_sha256"), "spans")


def _sql() -> str:
    found = " UNION ALL ".join(
        f"SELECT rid, '{k}' AS kind, unnest(range(1, len(m) + 1)) AS i, m, s FROM (SELECT rid, regexp_extract_all(text, '{p}') AS m, string_split_regex(text, '{p}') AS s FROM t)" for k, p in [*PLAIN.items(), ("", LOOSE)]
    )
    card = "translate(value, ' -', '')"
    digit = f"CAST(substr({card}, length({card}) - x, 1) AS INT)"
    luhn = f"list_sum(list_transform(range(length({card})), lambda x: CASE WHEN x % 2 = 0 THEN {digit} WHEN {digit} > 4 THEN 2 * {digit} - 9 ELSE 2 * {digit} END)) % 10 = 0"
    good = {"email": "TRUE", "ip": f"regexp_matches(value, '{IP_PARTS}')", "card": f"length({card}) BETWEEN 16 AND 19 AND {luhn}", "phone": "length(translate(value, '+ ().-', '')) BETWEEN 8 AND 15"}
    good = "CASE kind " + " ".join(f"WHEN '{k}' THEN {g}" for k, g in good.items()) + " ELSE NOT regexp_matches(right(bef, 1), '[A-Za-z0-9]') AND NOT regexp_matches(left(aft, 1), '[A-Za-z0-9]') END"
    folded = lambda c: f"list_filter(string_split_regex(translate({c}, '{UPPER}123456789', '{LOWER}000000000'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
    address = f"regexp_replace(regexp_replace(translate(value, '{UPPER}', '{LOWER}'), '{AT}', '@', 'g'), '{DOT}', '.', 'g')"
    number = "regexp_matches(norm, '^[0-9]+$') AND length(norm) BETWEEN"
    may = {"email": "contains(norm, '@')", "ip": f"regexp_matches(norm, '{DOTTED}')", "card": f"{number} 12 AND 19", "phone": f"{number} 7 AND 15"}
    patterns = "['< ' || l1, '<< ' || l2, '> ' || r1, '<> ' || l1 || ' ' || r1]"
    none = " + ".join(f"is_{k}" for k in KINDS) + " = 0"
    counts = " UNION ALL ".join(f"SELECT pattern, '{k}' AS kind, sum(is_{k}) AS seeds, CAST(sum(CASE WHEN {none} THEN may_{k} ELSE 0 END) AS BIGINT) AS unknown, count(*) AS n FROM edges GROUP BY pattern HAVING sum(is_{k}) > 0" for k in KINDS)
    place = "CASE kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(KINDS)) + " END"
    kinds = "CASE kind " + " ".join(f"WHEN '{k}' THEN may_{k}" for k in KINDS) + " END = 1"
    rounds = ["acc0 AS (SELECT NULL AS norm, '' AS kind, CAST(0 AS BIGINT) AS score WHERE FALSE)"]
    for r in range(1, ROUNDS + 1):
        rounds.append(f"""
gain{r} AS (SELECT pattern, kind, sum(score) AS score, count(*) AS more FROM (SELECT DISTINCT norm, pattern FROM ways) w JOIN acc{r - 1} USING (norm) GROUP BY pattern, kind),
strong{r} AS (SELECT * FROM (SELECT pattern, kind, ((seeds * 1000000 + coalesce(score, 0)) * {UNKNOWN_PARTS}) // (n * {UNKNOWN_PARTS} - (unknown - coalesce(more, 0)) * {UNKNOWN_PARTS - 1} + {PRIOR * UNKNOWN_PARTS}) AS conf
  FROM counts LEFT JOIN gain{r} USING (pattern, kind)) WHERE conf >= {STRONG}),
best{r} AS (SELECT norm, l1, l2, r1, n_uses, kind, max(conf) AS conf FROM ways JOIN strong{r} USING (pattern) WHERE {kinds} GROUP BY ALL),
score{r} AS (SELECT norm, kind, sum(conf) // n_uses AS score FROM best{r} GROUP BY norm, n_uses, kind HAVING sum(conf) // n_uses >= {ACCEPTED}),
acc{r} AS (SELECT norm, kind, CAST(score AS BIGINT) AS score FROM score{r} QUALIFY row_number() OVER (PARTITION BY norm ORDER BY score DESC, {place}) = 1)""")
    again = "CASE " + " ".join(f"WHEN is_{k} = 1 AND {may[k]} THEN '{k}'" for k in KINDS) + " END"
    return f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
f AS ({found}),
m0 AS (SELECT rid, kind, i, m[i] AS value, s[i] AS bef, s[i + 1] AS aft, sum(length(s[i]) + length(m[i])) OVER (PARTITION BY rid, kind ORDER BY i) AS "end" FROM f),
m1 AS (SELECT *, "end" - length(value) AS start FROM m0 WHERE {good}),
m2 AS (SELECT *, coalesce(max(CASE WHEN kind <> '' THEN "end" END) OVER (PARTITION BY rid ORDER BY start, "end", kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reached,
              coalesce(min(CASE WHEN kind <> '' THEN start END) OVER (PARTITION BY rid ORDER BY start, "end", kind ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), "end") AS begun FROM m1),
m3 AS (SELECT *, {address} AS address, {folded('bef')} AS lw, {folded('aft')} AS rw FROM m2 WHERE kind <> '' OR (reached <= start AND begun >= "end")),
spans AS (SELECT rid, kind, start, "end", CASE WHEN contains(address, '@') THEN address WHEN regexp_matches(value, '{DOTTED}') THEN value ELSE translate(value, '+ ().:-', '') END AS norm,
                 coalesce(lw[-1], '') AS l1, coalesce(lw[-2], '') || ' ' || coalesce(lw[-1], '') AS l2, coalesce(rw[1], '') AS r1 FROM m3),
known AS (SELECT norm, {', '.join(f"max(CAST(kind = '{k}' AS INT)) AS is_{k}" for k in KINDS)} FROM spans WHERE kind <> '' GROUP BY norm),
uses AS (SELECT DISTINCT s.norm, l1, l2, r1, {', '.join(f'coalesce(is_{k}, 0) AS is_{k}' for k in KINDS)}, {', '.join(f'CAST({m.replace("norm", "s.norm")} AS INT) AS may_{k}' for k, m in may.items())} FROM spans s LEFT JOIN known k ON s.norm = k.norm),
edges AS (SELECT DISTINCT norm, unnest({patterns}) AS pattern, * EXCLUDE (norm, l1, l2, r1) FROM uses),
counts AS ({counts}),
ways AS (SELECT *, unnest({patterns}) AS pattern FROM (SELECT *, count(*) OVER (PARTITION BY norm) AS n_uses FROM uses WHERE {none})),
{','.join(rounds)},
named AS (SELECT * FROM (SELECT norm, {again} AS kind FROM known) WHERE kind IS NOT NULL UNION ALL SELECT norm, kind FROM acc{ROUNDS}),
every AS (SELECT rid, kind, start, "end", TRUE AS base FROM spans WHERE kind <> '' UNION ALL SELECT rid, n.kind, start, "end", FALSE FROM spans JOIN named n ON spans.norm = n.norm WHERE spans.kind = ''),
listed AS (SELECT rid, {', '.join(f"count(*) FILTER (kind = '{k}' AND base) AS n_{k}" for k in KINDS)},
                  string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY {place}, start) FILTER (base) AS base,
                  string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY {place}, start) AS spans FROM every GROUP BY rid)
SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN listed USING (rid)
"""


OP13_SQL = _sql()
