"""Repeated runs of lines: prefix doubling over line ids, and deletion of later copies.

Lines become 128-bit ids. Class k of a position names the run of 2**k lines that starts there, and class k + 1 is
made from the classes k of the position and of the one 2**k lines on: the doubling step of a distributed suffix
array, in which only equality of ranks is kept, because the order among different runs decides nothing here. Two
classes k that overlap name any run of more than 2**k and up to 2**(k + 1) lines, so the positions that start with
one run of n lines, whatever n, are found by one key: they are the interval of the suffix array whose longest
common prefix is at least n lines. Each interval marks the run at all its positions but the first, in order of
(doc_id, line). Marked runs of a document overlap into its maximal repeated runs, and these are deleted.

Which runs are named: a line belongs to a repeated run of `min_chars` characters exactly if it belongs to a
shortest such run, that is one that falls below `min_chars` without its last line (the shortest from its start) or
without its first (the shortest to its end). For the part of the repeated run that holds the line and cannot be
shortened further is one of the two, and both can be told from the run's own lines, so all its copies are named
alike. Hence two keys for a line are enough for repeats of any number of lines. A line end counts one character,
so no shortest run has more than `min_chars` + 1 lines, and doubling ends where all runs of a document suffice.

Doubling happens inside a document's arrays, so the only shuffles are of fixed-size keys, once to find the
intervals and once to mark, and the join that brings the marks back to the texts. A line that a third of all
documents share is one key of a partial aggregate, and its positions are spread by the skew join.

Defined results: a null text stays null and has no lines; a null doc_id sorts first; rows with the same doc_id
and text are one document and get the same result; runs shorter than `min_chars`, counting the line ends
between them, stay; an empty table gives an empty table; other columns are carried along
(one named like an added column is replaced by it).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

MIN_CHARS = 50
KEY = ["n", "a", "b"]


def doubled(runs: Column, step: int) -> Column:
    """Classes of twice as many lines from those of `step` lines."""

    def pair(i: Column) -> Column:
        x, y = F.get(runs, i), F.get(runs, i + step)
        return F.struct(F.xxhash64(x["a"], y["a"]).alias("a"), F.xxhash64(x["b"], y["b"]).alias("b"), (x["n"] + y["n"]).alias("n"))

    none = F.slice(runs, 1, 0)
    return F.when(F.size(runs) > step, F.transform(F.sequence(F.lit(0), F.size(runs) - 1 - step), pair)).otherwise(none)


def line_classes(docs: DataFrame, min_chars: int) -> DataFrame:
    """(id, h, c): c[k] holds for each position the class of 2**k lines and their characters with line ends.

    Levels go on while a run of the level before is too short; later ones are empty.
    """

    def first(line: Column) -> Column:
        return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("second"), line).alias("b"), (F.length(line) + 1).alias("n"))

    rows = docs.select(common.id_key().alias("id"), F.xxhash64("text").alias("h"), F.split("text", "\n", -1).alias("lines")).where("lines IS NOT NULL")
    rows = rows.select("id", "h", F.transform("lines", first).alias("c0"))
    levels = (min_chars + 1).bit_length()
    for k in range(1, levels):
        before = F.col(f"c{k - 1}")
        short = F.exists(before, lambda x: x["n"] <= min_chars)
        rows = rows.withColumn(f"c{k}", F.when(short, doubled(before, 2 ** (k - 1))).otherwise(F.slice(before, 1, 0)))
    return rows.select("id", "h", F.array(*[f"c{k}" for k in range(levels)]).alias("c"))


def shortest_runs(min_chars: int) -> Column:
    """(pos, n, a, b) for the shortest runs of min_chars characters from each line, and to each line, each once."""
    levels = (min_chars + 1).bit_length()
    classes, lines = F.col("c"), F.get(F.col("c"), F.lit(0))
    steps = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(2**k).alias("size")) for k in reversed(range(levels))])
    # The level of the two classes that name a run of n lines.
    level_of = F.array(*[F.lit(max(0, (n - 1).bit_length() - 1)) for n in range(min_chars + 2)])
    size_of = F.array(*[F.lit(2 ** max(0, (n - 1).bit_length() - 1)) for n in range(min_chars + 2)])

    def too_few(first_of: Callable[[Column, Column], Column]) -> Column:
        """The most lines that are too short together, by binary descent over the levels; first_of: where a step starts."""
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("chars"))

        def step(acc: Column, s: Column) -> Column:
            chars = acc["chars"] + F.get(F.get(classes, s["k"]), first_of(acc["n"], s["size"]))["n"]
            return F.when(chars <= min_chars, F.struct((acc["n"] + s["size"]).alias("n"), chars.alias("chars"))).otherwise(acc)

        return F.aggregate(steps, start, step)

    def run(pos: Column, n: Column) -> Column:
        named = F.get(classes, F.get(level_of, n))
        x, y = F.get(named, pos), F.get(named, pos + n - F.get(size_of, n))
        return F.struct(pos.alias("pos"), n.alias("n"), F.xxhash64(x["a"], y["a"]).alias("a"), F.xxhash64(x["b"], y["b"]).alias("b"))

    def ahead(line: Column, i: Column) -> Column:
        few = F.when(line["n"] > min_chars, F.lit(0)).otherwise(too_few(lambda n, _: i + n)["n"])
        return F.struct(i.alias("pos"), (few + 1).alias("n"))

    def behind(line: Column, i: Column) -> Column:
        few = F.when(line["n"] <= min_chars, too_few(lambda n, size: i - n - size + 1))
        pos = i - few["n"]
        # Without its last line it must suffice too: else it is the shortest run from its start.
        longer = few["chars"] + F.get(lines, pos)["n"] - line["n"] > min_chars
        return F.struct(F.when(longer, pos).alias("pos"), (few["n"] + 1).alias("n"))

    from_start = F.filter(F.transform(lines, ahead), lambda x: x["pos"] + x["n"] <= F.size(lines))
    to_end = F.filter(F.transform(lines, behind), lambda x: x["pos"].isNotNull())
    return F.transform(F.concat(from_start, to_end), lambda x: run(x["pos"], x["n"]))


def repeated_runs(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """A row (id, h, gone) for each document with repeated lines; gone: their positions from 0, in order."""
    keys = line_classes(docs, min_chars).select("id", "h", F.explode(shortest_runs(min_chars)).alias("x"))
    keys = common.cut(keys.select("id", "h", "x.*"), "line-keys")
    where = F.struct("id", "h", "pos")
    intervals = common.cut(keys.groupBy(*KEY).agg(F.count("*").alias("times"), F.min(where).alias("first")).where("times > 1").drop("times"), "line-intervals")
    marked = keys.join(intervals, KEY).where(where > F.col("first"))
    runs = marked.groupBy("id", "h").agg(F.collect_list(F.struct("pos", "n")).alias("runs"))
    spread = F.flatten(F.transform("runs", lambda r: F.sequence(r["pos"], r["pos"] + r["n"] - 1)))
    return runs.select("id", "h", F.array_sort(F.array_distinct(spread)).alias("gone"))


def kept_lines(lines: Column, gone: Column) -> Column:
    """The lines whose positions are not in `gone`, as slices between neighbours of `gone`."""

    def gap(at: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(gone, i - 1)).otherwise(-1)
        return F.slice(lines, before + 2, at - before - 1)

    last = F.element_at(gone, -1)
    return F.concat(F.flatten(F.transform(gone, gap)), F.slice(lines, last + 2, F.size(lines) - last - 1))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with later copies of repeated runs deleted from text; n_lines and n_removed_lines are added."""
    docs = common.plain(docs, "n_lines", "n_removed_lines")
    runs = repeated_runs(docs, min_chars).toDF("__id", "__h", "__gone")
    held = docs.withColumns({"__key": common.id_key(), "__text_h": F.xxhash64("text")})
    out = held.join(runs, (F.col("__key") == F.col("__id")) & (F.col("__text_h") == F.col("__h")), "left").withColumn("__lines", F.split("text", "\n", -1))
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(kept_lines(F.col("__lines"), F.col("__gone")), "\n"))
    counts = {"n_lines": F.when(F.col("__lines").isNull(), 0).otherwise(F.size("__lines")).cast("long"), "n_removed_lines": F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")).cast("long")}
    return out.withColumns(counts | {"__kept": text}).select(*[F.col("__kept").alias("text") if c == "text" else F.col(c) for c in docs.columns], *counts)


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", F.col("n_removed_lines").alias("n_removed"), F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"))


#: All pairs of equal lines, their diagonals, and on these the whole runs of neighbours.
SQL = """
WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, generate_subscripts(lines, 1) - 1 AS pos, unnest(lines) AS line FROM split),
pairs AS (
  SELECT a.doc_id AS d1, b.doc_id AS d2, b.pos AS pos, b.pos - a.pos AS diagonal, length(b.line) AS n
  FROM lines a JOIN lines b ON a.line = b.line AND (a.doc_id < b.doc_id OR (a.doc_id = b.doc_id AND a.pos < b.pos))),
placed AS (SELECT *, pos - row_number() OVER (PARTITION BY d1, d2, diagonal ORDER BY pos) AS island FROM pairs),
runs AS (SELECT d2 AS doc_id, min(pos) AS first, max(pos) AS last FROM placed GROUP BY d1, d2, diagonal, island HAVING sum(n + 1) - 1 >= 50),
gone AS (SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS pos FROM (SELECT DISTINCT doc_id, first, last FROM runs)),
kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed,
    string_agg(CASE WHEN g.pos IS NULL THEN line END, chr(10) ORDER BY l.pos) AS text
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, md5(coalesce(k.text, '')) AS kept_md5
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
