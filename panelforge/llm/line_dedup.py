"""Line dedup: repeated runs of lines found with a suffix array, later copies deleted.

Native: DataFrame operations only.

Every non-blank line (trimmed) is a symbol; a document is a sequence of symbols. Suffixes
that begin with a line that occurs once are left aside, as nothing can repeat there.

1. Prefix doubling ranks the other suffixes by their first 1, 2, 4, ... lines: a rank is
   the place of (rank, rank of the suffix that many lines on) among all such pairs in
   sorted order, taken from a range-partitioned sort of the *distinct* pairs, so that no
   group of equal pairs is ever gathered. It goes on until no rank is shared. A suffix
   whose rank is its own is ready and keeps its list of ranks; documents of which all
   suffixes are ready leave the rounds.
2. The lists of ranks sort the suffixes: the suffix array, range-partitioned too.
3. Neighbours' longest common prefix (LCP): the ranks that two lists share give its
   highest power of two; the lists of the suffixes that many lines on give the next one,
   until they share nothing.
4. Stretches of neighbours whose LCP is at least ``min_lines`` are the intervals of runs
   that long. The earliest member of an interval stays; at each later one its
   ``min_lines`` lines are deleted, and as a longer repeated run is the union of its
   windows, later copies of maximal runs go whole. ``longest_run`` is the largest LCP
   a suffix of the document has: the length of its longest repeated run.

The first occurrence of any line is in no later copy, so no line is lost from the corpus.
Order of occurrences: document id (null first), then the text's hash, then place in the
document.

Defined cases: a null text stays null and has no lines; an empty text has none either;
rows equal in id and text are one document listed twice and get the same text; blank
lines take no part and stay; white space around a line does not count; a run may overlap
its own copy; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import materialise
from .common import kept_columns

MIN_LINES = 1
#: White space that is trimmed off a line.
SPACE = " \t\r\x0b\x0c"

_DOC = ["doc_id", "key"]


def _key(text: Column) -> Column:
    return F.xxhash64(text)


def line_symbols(docs: DataFrame) -> DataFrame:
    """doc_id, key, seq (place among non-blank lines), line_no, two hashes of the line."""
    lines = F.filter(
        F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("line_no"), F.trim(x, F.lit(SPACE)).alias("line"))),
        lambda s: s["line"] != "",
    )
    exploded = docs.where(F.col("text").isNotNull()).select(
        "doc_id", _key(F.col("text")).alias("key"), F.posexplode(lines).alias("seq", "s")
    )
    line = F.col("s.line")
    return exploded.select(
        "doc_id",
        "key",
        "seq",
        F.col("s.line_no").alias("line_no"),
        F.xxhash64(line).alias("a"),
        F.xxhash64(F.lit(1), line).alias("b"),
    )


def _numbered(classes: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The distinct ``classes`` with their place in the order of ``keys``."""
    return classes.orderBy(*keys).withColumn(name, F.monotonically_increasing_id())


def _place() -> Column:
    return F.struct("doc_id", "key", "seq")


def first_ranks(symbols: DataFrame) -> DataFrame:
    """Suffixes whose first line occurs more than once, ranked by it.

    ``active``: the rank may be shared. ``hist``: its ranks so far, one for each power of two.
    """
    repeated = symbols.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1").select("a", "b")
    ranks = _numbered(repeated, ["a", "b"], "rank")
    return (
        symbols.join(ranks, ["a", "b"])
        .select(*_DOC, "seq", "line_no", "rank", F.lit(True).alias("active"), F.array("rank").alias("hist"))
        .repartition(*_DOC)
        .dropDuplicates([*_DOC, "seq"])
    )


def doubled(state: DataFrame, step: int) -> DataFrame:
    """Ranks by a prefix twice as long, of the documents with a suffix that is not ready.

    ``was`` tells whether a suffix was active before; one that no longer is, is ready, and
    its new rank is its list's last.
    """
    by_doc = Window.partitionBy(*_DOC)
    there = by_doc.orderBy("seq").rangeBetween(step, step)
    seen = (
        state.withColumn("ahead", F.min("rank").over(there))
        .withColumn("goes", F.coalesce(F.min("active").over(there), F.lit(False)))
        .withColumn("any", F.max("active").over(by_doc))
        .where("any")
        .withColumn("ahead", F.when(F.col("active"), F.coalesce("ahead", F.lit(-1))).otherwise(F.lit(-1)))
    )
    pairs = seen.groupBy("rank", "ahead").agg((F.count("*") > 1).alias("several"), F.min(F.col("active") & F.col("goes")).alias("go"))
    named = _numbered(pairs, ["rank", "ahead"], "new")
    return seen.join(named, ["rank", "ahead"]).select(
        *_DOC,
        "seq",
        "line_no",
        F.col("new").alias("rank"),
        F.col("active").alias("was"),
        (F.col("go") & F.col("several")).alias("active"),
        F.when(F.col("active"), F.array_append("hist", F.col("new"))).otherwise(F.col("hist")).alias("hist"),
    )


def ranked_suffixes(docs: DataFrame) -> DataFrame:
    """doc_id, key, seq, line_no, hist: every suffix with a repeated first line when it is ready.

    All ranks of ``hist`` but the last are shared with some suffix of an equal prefix.
    """
    symbols = materialise(line_symbols(docs), "line-symbols")
    state, step, ready = materialise(first_ranks(symbols), "line-ranks"), 1, []
    while not state.where("active").isEmpty():
        state = materialise(doubled(state, step), "line-ranks")
        ready.append(state.where("was and not active").select(*_DOC, "seq", "line_no", "hist"))
        step *= 2
    return reduce(DataFrame.unionByName, ready) if ready else state.select(*_DOC, "seq", "line_no", "hist")


def suffix_array(suffixes: DataFrame) -> DataFrame:
    """The suffixes in order: ``part`` and ``at`` (order within all parts) are added, and the
    suffix before: ``before`` (doc_id, key, seq, hist)."""
    placed = materialise(
        suffixes.orderBy("hist", *_DOC, "seq").withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}),
        "suffixes",
    )
    here = F.struct(*_DOC, "seq", "hist")
    # One row for each partition of the sort: what the next partition's first row comes after.
    ends = placed.groupBy("part").agg(F.max_by(here, "at").alias("end"))
    ends = ends.select(F.lead("part").over(Window.orderBy("part")).alias("part"), "end").where("part is not null")
    inside = placed.withColumn("before", F.lag(here).over(Window.partitionBy("part").orderBy("at")))
    return inside.join(F.broadcast(ends), "part", "left").withColumn("before", F.coalesce("before", "end")).drop("end")


def _shared(a: Column, b: Column) -> Column:
    """How many leading ranks two lists share, the last one of each left out."""
    ranks = lambda x: F.slice(x, 1, F.size(x) - 1)
    return F.size(F.filter(F.zip_with(ranks(a), ranks(b), lambda x, y: x == y), lambda same: same))


def _length(shared: Column) -> Column:
    """The highest power of two that so many shared ranks stand for."""
    return F.when(shared > 0, F.call_function("shiftleft", F.lit(1), shared - 1)).otherwise(F.lit(0))


def _of_documents(lists: DataFrame, pairs: DataFrame) -> DataFrame:
    """The lists of the documents that some pair is in: a pair never leaves its two documents."""
    docs = [pairs.select(F.col(f"{side}_doc_id").alias("o_doc_id"), F.col(f"{side}_key").alias("o_key")) for side in "pq"]
    held = docs[0].unionByName(docs[1]).distinct()
    same = lists["doc_id"].eqNullSafe(held["o_doc_id"]) & (lists["key"] == held["o_key"])
    return lists.join(held, same, "left_semi")


def common_prefixes(array: DataFrame) -> DataFrame:
    """The suffix array with ``lcp``: how many lines a suffix shares with the one before, whose
    ``hist`` no longer matters then."""
    lcp = F.coalesce(_length(_shared(F.col("hist"), F.col("before.hist"))), F.lit(0))
    array = materialise(array.withColumns({"lcp": lcp, "before": F.col("before").dropFields("hist")}), "neighbours")
    lists = array.select(*_DOC, "seq", "hist")
    pairs = array.where("lcp > 1").select(
        "at",
        "lcp",
        *[F.col(c).alias(f"p_{c}") for c in _DOC],
        (F.col("seq") + F.col("lcp")).alias("p_seq"),
        *[F.col(f"before.{c}").alias(f"q_{c}") for c in _DOC],
        (F.col("before.seq") + F.col("lcp")).alias("q_seq"),
    )
    longer = []
    while True:
        for side in "pq":
            other = lists.select(*[F.col(c).alias(f"o_{c}") for c in [*_DOC, "seq"]], F.col("hist").alias(f"{side}_hist"))
            same = F.col(f"{side}_doc_id").eqNullSafe(F.col("o_doc_id"))
            for c in ("key", "seq"):
                same = same & (F.col(f"{side}_{c}") == F.col(f"o_{c}"))
            pairs = pairs.join(other, same).drop("o_doc_id", "o_key", "o_seq")
        more = _length(_shared(F.col("p_hist"), F.col("q_hist")))
        pairs = pairs.withColumn("more", more).where("more > 0")
        moved = {c: F.col(c) + F.col("more") for c in ("lcp", "p_seq", "q_seq")}
        pairs = materialise(pairs.withColumns(moved).drop("more", "p_hist", "q_hist"), "longer")
        if pairs.isEmpty():
            break
        longer.append(pairs.select("at", "lcp"))
        lists = materialise(_of_documents(lists, pairs), "lists")
    if not longer:
        return array
    longest = reduce(DataFrame.unionByName, longer).groupBy("at").agg(F.max("lcp").alias("longest"))
    return array.join(longest, "at", "left").withColumn("lcp", F.coalesce("longest", "lcp")).drop("longest")


def intervals(array: DataFrame, depth: int) -> DataFrame:
    """Adds ``interval``: the place of the first suffix of its stretch of LCPs of ``depth`` or more."""
    upto = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    starts = F.when(F.col("lcp") < depth, F.col("at"))
    # One row for each partition of the sort: the stretch that is open where it begins.
    last = array.groupBy("part").agg(F.max(starts).alias("last"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    opened = last.select("part", F.max("last").over(before).alias("opened"))
    inside = array.withColumn("interval", F.max(starts).over(upto))
    return inside.join(F.broadcast(opened), "part").withColumn("interval", F.coalesce("interval", "opened")).drop("opened")


def later_members(members: DataFrame) -> DataFrame:
    """doc_id, key, seq, line_no, later: whether an interval's member is not its earliest.

    The earliest are a table of their own, so that both sides of the join are plain
    exchanges and a hot interval's members can be split over tasks.
    """
    first = materialise(members.groupBy("interval").agg(F.min(_place()).alias("first")), "line-firsts")
    return members.join(first, "interval").select(*_DOC, "seq", "line_no", (_place() > F.col("first")).alias("later"))


def repeated_lines(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """doc_id, key, dead (sorted numbers of the lines to delete), longest_run, where a line repeats."""
    array = materialise(common_prefixes(suffix_array(ranked_suffixes(docs))).drop("hist"), "suffix-array")
    later = later_members(intervals(array, min_lines).select(*_DOC, "seq", "line_no", "interval"))
    if min_lines > 1:
        within = Window.partitionBy(*_DOC).orderBy("seq").rangeBetween(1 - min_lines, 0)
        later = later.withColumn("later", F.max("later").over(within))
    dead = later.where("later").select(*_DOC, "line_no", F.lit(0).alias("lcp"))
    found = array.where("lcp > 0")
    sides = found.select(*_DOC, "lcp").unionByName(found.select(*[F.col(f"before.{c}").alias(c) for c in _DOC], "lcp"))
    longest = sides.groupBy(*_DOC).agg(F.max("lcp").alias("lcp")).withColumn("line_no", F.lit(None).cast("int"))
    return (
        dead.unionByName(longest)
        .groupBy(*_DOC)
        .agg(F.sort_array(F.collect_set("line_no")).alias("dead"), F.max("lcp").alias("longest_run"))
    )


def _without_lines(text: Column, dead: Column) -> Column:
    """``text`` without the lines numbered in ``dead``: a mask of 0 and 1, one for each line."""
    mask = F.array_join(
        F.transform(
            dead,
            lambda d, j: F.concat(
                F.repeat(F.lit("0"), d - F.coalesce(F.get(dead, j - 1), F.lit(-1)) - 1), F.lit("1")
            ),
        ),
        "",
    )
    kept = F.zip_with(
        F.split(text, "\n", -1),
        F.split(mask, ""),
        lambda line, m: F.when(m == "1", F.lit(None)).otherwise(line),
    )
    return F.when(F.coalesce(F.size(dead), F.lit(0)) == 0, text).otherwise(F.array_join(kept, "\n"))


def _joined(docs: DataFrame, min_lines: int) -> DataFrame:
    """``docs`` as struct ``d`` with ``dead`` (empty where nothing goes) and ``longest_run``."""
    found = repeated_lines(kept_columns(docs, ["doc_id", "text"]), min_lines)
    left = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("d"))
    right = found.select(
        F.col("doc_id").alias("dead_doc"), F.col("key").alias("dead_key"), "dead", "longest_run"
    )
    same = F.col("d.doc_id").eqNullSafe(F.col("dead_doc")) & (
        _key(F.col("d.text")) == F.col("dead_key")
    )
    dead = F.when(F.col("d.text").isNotNull(), F.coalesce("dead", F.array().cast("array<int>")))
    return left.join(right, same, "left").select(
        "d", F.coalesce(dead, F.array().cast("array<int>")).alias("dead"), F.coalesce("longest_run", F.lit(0)).cast("long").alias("longest_run")
    )


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """doc_id, text without later copies, n_lines of the original, n_removed, removed, longest_run."""
    joined = _joined(kept_columns(docs, ["doc_id", "text"]), min_lines)
    text, dead = F.col("d.text"), F.col("dead")
    n_lines = F.coalesce(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1, F.lit(0))
    return joined.select(
        F.col("d.doc_id").alias("doc_id"),
        _without_lines(text, dead).alias("text"),
        n_lines.cast("long").alias("n_lines"),
        F.size(dead).cast("long").alias("n_removed"),
        F.array_join(dead.cast("array<string>"), ",").alias("removed"),
        "longest_run",
    )


#: The query's rows in DuckDB SQL, for documents whose ids are unique. Runs are matched pair by
#: pair of equal lines there, which is for small tables only.
ORACLE = """
WITH l0 AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
  FROM documents WHERE text IS NOT NULL
), trimmed AS (SELECT doc_id, line_no, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS t FROM l0
), l AS (
  SELECT doc_id, line_no, t, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS seq,
    row_number() OVER (PARTITION BY t ORDER BY doc_id, line_no) AS n
  FROM trimmed WHERE t <> ''
), pairs AS (
  SELECT a.doc_id AS d, b.doc_id AS e, a.seq, b.seq - a.seq AS gap
  FROM l a JOIN l b ON a.t = b.t AND (a.doc_id < b.doc_id OR a.doc_id = b.doc_id AND a.seq < b.seq)
), runs AS (
  SELECT d, e, count(*) AS run
  FROM (SELECT d, e, gap, seq - row_number() OVER (PARTITION BY d, e, gap ORDER BY seq) AS island FROM pairs) x
  GROUP BY d, e, gap, island
), longest AS (
  SELECT doc_id, max(run) AS longest_run FROM (SELECT d AS doc_id, run FROM runs UNION ALL SELECT e, run FROM runs) y GROUP BY doc_id
), kept AS (
  SELECT a.doc_id, string_agg(a.line, chr(10) ORDER BY a.line_no) FILTER (WHERE coalesce(l.n, 1) = 1) AS text,
    count(*) AS n_lines, count(*) FILTER (WHERE l.n > 1) AS n_removed,
    string_agg(CAST(a.line_no AS VARCHAR), ',' ORDER BY a.line_no) FILTER (WHERE l.n > 1) AS removed
  FROM l0 a LEFT JOIN l ON l.doc_id = a.doc_id AND l.line_no = a.line_no GROUP BY a.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text, coalesce(k.n_lines, 0) AS n_lines,
  coalesce(k.n_removed, 0) AS n_removed, coalesce(k.removed, '') AS removed, CAST(coalesce(g.longest_run, 0) AS BIGINT) AS longest_run
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id LEFT JOIN longest g ON g.doc_id = d.doc_id
"""


def dedup_documents(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """``docs`` with later copies of line runs cut from the texts; all rows and columns stay
    but those of documents of which nothing is left. ``n_chars`` follows the text."""
    joined = _joined(docs, min_lines)
    text, cut = _without_lines(F.col("d.text"), F.col("dead")), F.size("dead") > 0
    changed = {"text": text}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(cut, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("d.n_chars"))
    emptied = cut & (F.trim(text, F.lit(SPACE + "\n")) == "")
    return joined.where(~F.coalesce(emptied, F.lit(False))).select(
        *[changed.get(c, F.col(f"d.`{c}`")).alias(c) for c in docs.columns]
    )
