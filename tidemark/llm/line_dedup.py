"""Repeated runs of lines, found by prefix doubling over sequences of line ids; later copies are deleted.

The corpus is the sequence of its lines that have a word, document after document by doc_id. A line goes if it lies in a run of
consecutive lines of one document that has ``MIN_WORDS`` words or more together and whose first copy in the corpus ends before the
run begins: a run that overlaps its own first copy is part of it and stays. Which lines that is can be told from shortest runs only:
every line of such a run also lies in one that cannot lose its last line, or in one that cannot lose its first, without falling under
``MIN_WORDS``; their length is at most ``MIN_WORDS``. The deleted shortest runs of a copy overlap and make up the maximal repeated run.

The suffix array is ordered by doubling: ``ranks(0)`` are those of the lines that occur twice or more (all others end a common
prefix and need no rank), ``ranks(k + 1)`` those of pairs of ranks(k) at distance 2**k. A rank is made by sorting the distinct
pairs over all tasks by range, so equal ranks are the intervals of suffixes whose longest common prefix is 2**k lines or more.
The interval of suffixes with a common prefix of n lines or more is that of two overlapping ranks of the largest 2**k <= n. Doubling
ends at the longest run that is asked for, or where no interval holds two suffixes. Only counts and first positions of an interval
are aggregated, never its members; rows of a common line are joined with tables of one row a key, which Spark splits where they are many.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, forget, has_word, tuned, whole, written

MIN_WORDS = 20


def lines_of(docs: DataFrame, min_words: int) -> DataFrame:
    """rid, doc_id, text -> rid, doc_id, tie (a hash of the text), seq (among lines with a word), line (among all), a, b (128 bits of the
    line's hash), and of the shortest runs that start or end here with ``min_words`` words: their lines, ahead and back (0: there is
    none), and among all lines the last of the one, ahead_end, and the first of the other, back_start."""
    names = ["rid", "doc_id", "tie", "seq", "line", "a", "b", "ahead", "back", "ahead_end", "back_start"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {k: [] for k in (*names, "hash")}
            for rid, doc, text in zip(batch.column("rid"), batch.column("doc_id"), batch.column("text"), strict=True):
                kept, counts, places = [], [], []
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                for i, line in enumerate(raw.split(b"\n")):
                    if n := len(line.split()):
                        kept.append(xxhash.xxh3_128_digest(line))
                        counts.append(n)
                        places.append(i)
                if not kept:
                    continue
                upto, places = np.concatenate(([0], np.cumsum(counts))), np.array(places)
                at, n = np.arange(len(kept)), len(kept)
                end = np.searchsorted(upto, upto[:-1] + min_words)  # the first sum that is high enough
                start = np.searchsorted(upto, upto[1:] - min_words, side="right") - 1
                out["rid"].append(np.full(n, rid.as_py()))
                out["doc_id"] += [doc.as_py()] * n
                out["tie"].append(np.full(n, xxhash.xxh3_64_intdigest(raw) - (1 << 63)))
                out["seq"].append(at)
                out["line"].append(places)
                out["hash"] += kept
                out["ahead"].append(np.where(end <= n, end - at, 0))
                out["back"].append(np.where(upto[1:] >= min_words, at + 1 - start, 0))
                out["ahead_end"].append(places[np.minimum(end, n) - 1])
                out["back_start"].append(places[np.maximum(start, 0)])
            if not out["seq"]:
                continue
            halves = np.frombuffer(b"".join(out["hash"]), "<i8").reshape(-1, 2)
            flat = {k: np.concatenate(out[k]).astype(np.int64 if k in ("rid", "tie") else np.int32) for k in names if k not in ("doc_id", "a", "b")}
            flat |= {"doc_id": pa.array(out["doc_id"], pa.int64()), "a": halves[:, 0].copy(), "b": halves[:, 1].copy()}
            yield pa.RecordBatch.from_arrays([pa.array(flat[k]) for k in names], names)

    return docs.select("rid", "doc_id", "text").mapInArrow(run, "rid long, doc_id long, tie long, seq int, line int, a long, b long, ahead int, back int, ahead_end int, back_start int")


def ranked(pairs: DataFrame) -> DataFrame:
    """Adds rank, the order of (a, b) among those that occur twice or more, and drops the others."""
    several = pairs.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1").select("a", "b")
    order = written(several.repartitionByRange("a", "b").sortWithinPartitions("a", "b").withColumn("rank", F.monotonically_increasing_id()), "ranks")
    out = written(pairs.join(order, ["a", "b"]).select("rid", "seq", "rank"), "level")
    forget(order)
    return out


def suffix_ranks(lines: DataFrame, longest: int) -> list[DataFrame]:
    """For k = 0, 1, ...: rid, seq, rank of the 2**k lines from there, where they occur more than once."""
    levels = [ranked(lines.select("rid", "seq", "a", "b"))]
    while 2 ** len(levels) <= longest:
        step = 2 ** (len(levels) - 1)
        last = levels[-1]
        after = last.select("rid", (F.col("seq") - step).alias("seq"), F.col("rank").alias("b"))
        level = ranked(last.withColumnRenamed("rank", "a").join(after, ["rid", "seq"]))
        if level.isEmpty():
            forget(level)
            break
        levels.append(level)
    return levels


def repeated_runs(lines: DataFrame, longest: int) -> DataFrame:
    """rid, start, end (among all lines of the text): the shortest runs whose first copy lies before them."""
    levels = suffix_ranks(lines, longest)
    found, kept = [], []
    who = ["rid", "doc_id", "tie"]
    ahead = lines.where("ahead > 0").select(*who, "seq", F.col("ahead").alias("n"), F.col("line").alias("start"), F.col("ahead_end").alias("stop"))
    # one that starts and ends with the shortest run is there already
    back = lines.where("back > 0").select(*who, (F.col("seq") - F.col("back") + 1).alias("seq"), F.col("back").alias("n"), F.col("back_start").alias("start"), F.col("line").alias("stop"))
    runs = ahead.union(back)
    for k, level in enumerate(levels):
        here = runs.where((F.col("n") >= 2**k) & (F.col("n") < 2 ** (k + 1)))
        first = level.select("rid", "seq", F.col("rank").alias("x"))
        second = level.select("rid", F.col("seq").alias("end"), F.col("rank").alias("y"))
        whole = here.join(first, ["rid", "seq"]).withColumn("end", F.col("seq") + F.col("n") - 2**k).join(second, ["rid", "end"])
        whole = written(whole.select(*who, "seq", "n", "start", "stop", "x", "y"), "runs")
        at = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tie", "rid", "seq")
        firsts = written(whole.groupBy("n", "x", "y").agg(F.min(at).alias("first"), F.max(at).alias("other")).where("first < other").select("n", "x", "y", "first"), "firsts")
        later = (at > F.col("first")) & ((F.col("rid") != F.col("first.rid")) | (F.col("seq") >= F.col("first.seq") + F.col("n")))
        found.append(whole.join(firsts, ["n", "x", "y"]).where(later).select("rid", "start", "stop"))
        kept += [whole, firsts]
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    out = written(out, "found")
    forget(*levels, *kept)
    return out


def without_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` (doc_id, text; others are carried in ``d``) -> a row per row: d, text, n_lines (with a word), n_deleted.

    What stays of a text keeps its order, blank lines included. Null texts stay null; texts without lines stay as they are.
    Null doc_ids come last in the corpus; rows with one doc_id come in the order of a hash of their texts, and of equal rows any one
    keeps its lines. Lines are equal if 128 bits of their hashes are. Texts may be of any length: a line costs one row. An empty
    table gives an empty result.
    """
    tuned(docs.sparkSession)
    held = written(docs.select(F.monotonically_increasing_id().alias("rid"), whole(docs)), "held")
    lines = written(lines_of(held.select("rid", "d.doc_id", "d.text"), min_words), "lines")
    runs = repeated_runs(lines, min_words)
    gone = runs.select("rid", F.explode(F.sequence("start", "stop")).alias("line"), F.lit(0).alias("n"))
    each = lines.groupBy("rid").agg(F.count("*").cast("int").alias("n")).select("rid", F.lit(None).cast("int").alias("line"), "n")
    changes = written(gone.union(each).groupBy("rid").agg(F.collect_set("line").alias("gone"), F.sum("n").alias("n_lines")), "changes")
    forget(lines, runs)
    own = F.split(F.col("d.text"), "\n")
    # texts are dealt out at every size: a broadcast of small changes would let the shuffle grow faster than the input
    joined = held.join(changes.hint("merge"), "rid", "left").select("d", "n_lines", F.when(F.size("gone") > 0, own).alias("lines"), "gone")
    # a run's span has blank lines in it, which stay
    joined = joined.withColumn("gone", F.filter("gone", lambda i: has_word(F.get("lines", i))))
    stay = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone"), lambda i: F.get("lines", i))
    text = F.when(F.col("lines").isNull(), F.col("d.text")).otherwise(F.array_join(stay, "\n"))
    return joined.select("d", text.alias("text"), F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.when(F.col("lines").isNotNull(), F.size("gone")), F.lit(0)).cast("long").alias("n_deleted"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls, ties and the like: see ``without_repeated_lines``."""
    return without_repeated_lines(documents(spark, sf_dir).select("doc_id", "text")).select("d.doc_id", "text", "n_lines", "n_deleted")


OP4_SQL = f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
a AS (SELECT rid, doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM t WHERE text IS NOT NULL),
l AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY i) AS seq, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS w FROM a WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
w AS (SELECT l.rid, l.doc_id, l.seq, n, string_agg(m.line, chr(10) ORDER BY m.seq) AS run
      FROM l, (SELECT unnest(range(1, {MIN_WORDS} + 1)) AS n) JOIN l m ON m.rid = l.rid AND m.seq >= l.seq AND m.seq < l.seq + n
      GROUP BY l.rid, l.doc_id, l.seq, n HAVING count(*) = n AND sum(m.w) >= {MIN_WORDS}),
r AS (SELECT *, first_value(rid) OVER o AS first_rid, first_value(seq) OVER o AS first_seq FROM w WINDOW o AS (PARTITION BY run ORDER BY doc_id NULLS LAST, rid, seq)),
g AS (SELECT DISTINCT rid, seq + o AS seq FROM (SELECT rid, seq, unnest(range(n)) AS o FROM r WHERE rid <> first_rid OR seq >= first_seq + n)),
k AS (SELECT a.rid, string_agg(a.line, chr(10) ORDER BY a.i) FILTER (WHERE g.seq IS NULL) AS text, count(l.seq) AS n_lines, count(g.seq) AS n_deleted
      FROM a LEFT JOIN l ON a.rid = l.rid AND a.i = l.i LEFT JOIN g ON g.rid = l.rid AND g.seq = l.seq GROUP BY a.rid)
SELECT t.doc_id, CASE WHEN t.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_deleted, 0) AS BIGINT) AS n_deleted
FROM t LEFT JOIN k ON t.rid = k.rid
"""
