"""Line dedup: a segment-partition edit join over the lines of all documents.

A line goes if a line within ``edits`` edits of it (0 for exact copies) starts
earlier in the corpus, in the order of doc_id, then line number.  Lines are
judged on the input, not on what is left.

1. Exact copies fold into their first place by two 64-bit hashes, with map-side
   aggregation, so a line with a third of all rows is one row per task.
2. A distinct line of length L is cut into edits + 1 segments.  Two lines within
   ``edits`` edits share at least one segment at a place that differs by few
   characters, so each line also probes the segment indexes of the lengths
   L - edits .. L with the few substrings that the length difference and the
   segment number allow.  A bucket is (length, segment number, segment text).
3. Buckets of up to ``BUCKET`` rows give their pairs, without those whose letter
   counts already differ by more than the edits allow.  Larger ones are divided
   again: their members agree in the segment, so the same join runs on the rest
   of the line within the bucket, until no bucket is large or the rest is as
   short as the segments are many.  Nothing is capped.
4. Pairs are verified with banded bit-parallel edit distance.

Only DataFrame functions are used.

Defined results
* lines end at line feeds; lines of fewer than ``least`` code points (blank
  lines, brackets, list marks) always stay, unless ``fold_short``: then of exact
  copies that are not blank the first one stays;
* null text stays null; empty text stays empty; an empty table gives an empty result;
* a null doc_id sorts first, as an id of its own; rows that repeat a doc_id
  count as one document, judged line number by line number;
* ties: the line that starts first stays; extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_PATTERN, broadcast_if_small, written

EDITS = 2
LEAST = 16
BUCKET = 48
BLOCK = 16  # characters compared at once when shared ends are cut off
# Letter groups whose counts are compared before a pair is formed; any grouping is right.
LETTERS = ("e", "t", "a", "o", "i", "n", "s", "r", "h", "l", "d", "u", "cm", "gp", "fywb", "0123456789")


def slots(edits: int) -> list[tuple[int, int, int]]:
    """(length difference, segment 1.., shift) of every row a line has in the join.

    Shift 0 at difference 0 is the line's own segment (the index); the others are
    probes.  The ranges are those of multi-match-aware selection: the match must
    leave at most i - 1 edits to its left and edits + 1 - i to its right."""
    out = [(0, i, 0) for i in range(1, edits + 2)]
    for less in range(edits + 1):
        for i in range(1, edits + 2):
            low = max(-(i - 1), less - (edits + 1 - i))
            high = min(i - 1, less + (edits + 1 - i))
            out += [(less, i, s) for s in range(low, high + 1) if (less, s) != (0, 0)]
    return out


def _segment(length: Column, less: int, i: int, shift: int, edits: int) -> tuple[Column, Column]:
    """Start (from 0) and length of a slot's substring in a line of ``length``."""
    target = length - less
    begin = F.floor((target * (i - 1)) / (edits + 1)).cast("int")
    size = F.floor((target * i) / (edits + 1)).cast("int") - begin
    return begin + shift, size


def _keys(text: Column, length: Column, context: Column, edits: int, least: int) -> Column:
    """The bucket keys of a line in the order of ``slots``; null where a slot does not fit."""
    keys = []
    for less, i, shift in slots(edits):
        start, size = _segment(length, less, i, shift, edits)
        fits = (start >= 0) & (start + size <= length) & (length - less >= least)
        keys.append(F.when(fits, F.xxhash64(context, F.lit(i), length - less, F.substring(text, start + 1, size))))
    return F.array(*keys)


def lines(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(d, n, line): the lines of at least ``least`` code points; ``d`` is doc_id with null as the smallest long."""
    return (docs.select(_doc(), F.posexplode(F.split("text", "\n")).alias("n", "line"))
            .where(F.length("line") >= least))


def _doc() -> Column:
    return F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-2**63)).alias("d")


def distinct_lines(docs: DataFrame, edits: int, least: int) -> DataFrame:
    """(d, n, keys): the first place of every distinct line, with its bucket keys."""
    every = lines(docs, least).withColumn("len", F.length("line"))
    folded = (every.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"),
                           F.struct("d", "n", _keys(F.col("line"), F.col("len"), F.lit(0), edits, least).alias("keys"))
                           .alias("first"))
              .groupBy("h1", "h2").agg(F.min("first").alias("first")))
    return folded.select("first.*")


def short_lines(docs: DataFrame, least: int) -> DataFrame:
    """(d, n): the first place of every distinct line of under ``least`` code points that is not blank."""
    every = lines(docs, 1).where((F.length("line") < least) & F.col("line").rlike(WORD_PATTERN))
    return every.groupBy("line").agg(F.min(F.struct("d", "n")).alias("first")).select("first.*")


def _fetch(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(d, n, line) for the given places (d, n)."""
    wanted = written(places.groupBy("d").agg(F.collect_set("n").alias("ns")), "lines-wanted")
    size = wanted.agg(F.count("*").alias("c"), F.coalesce(F.sum(F.size("ns")), F.lit(0)).alias("s")).first()
    held = docs.select(_doc(), F.split("text", "\n").alias("all"))
    return (held.join(broadcast_if_small(wanted, size["c"] + size["s"], 32), "d")
            .select("d", F.explode("ns").alias("n"), "all").select("d", "n", F.get("all", F.col("n")).alias("line"))
            .distinct())


def _shared(rows: DataFrame) -> DataFrame:
    """Rows (key, index, slot, d, n, ...) of the buckets with an index row and another row; adds ``size``."""
    sizes = (rows.groupBy("key").agg(F.count("*").alias("size"), F.max("index").alias("has"))
             .where("size > 1 and has").select("key", "size"))
    return rows.join(sizes, "key")


def _bag(line: str) -> Column:
    """How often the letters of each group occur: an edit moves the counts by two at most."""
    return F.array(*[F.length(line) - F.length(F.translate(line, group, "")) for group in LETTERS])


def _pairs(rows: DataFrame, edits: int) -> DataFrame:
    """Candidate pairs of places: the index rows of a bucket with all its other rows."""
    a = rows.where("index").select("key", F.struct("d", "n").alias("a"), F.col("bag").alias("bag_a"))
    b = rows.select("key", F.struct("d", "n").alias("b"), F.col("bag").alias("bag_b"))
    apart = F.aggregate(F.zip_with("bag_a", "bag_b", lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x)
    left, right = a.withColumnRenamed("key", "ka"), b.withColumnRenamed("key", "kb")
    met = left.join(right, (F.col("ka") == F.col("kb")) & (F.col("a") != F.col("b")) & (apart <= 2 * edits))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def banded_distance(a: Column, b: Column, edits: int) -> Column:
    """Edit distance of two arrays of characters if at most ``edits``, else larger.

    One step for each character of ``b``.  The bits of a step are the rows of the
    band around the diagonal, 2 * edits + 1 of them: ``x`` has the rows whose
    character matches, ``vp`` and ``vn`` the rows whose value is one above or
    below the row before.  The distance follows the band's last row down to the
    end of ``a`` and then runs along it."""
    width = 2 * edits + 1
    big = lambda v: F.lit(v).cast("bigint")
    full = big((1 << width) - 1)
    flip = lambda v: v.bitwiseXOR(full)
    right = lambda v, n: F.call_function("shiftright", v, n)
    m = F.size(a)

    def matches(c: Column, j: Column) -> Column:
        rows = [F.when(F.get(a, j + (t - edits)) == c, big(1 << t)).otherwise(big(0)) for t in range(width)]
        out = rows[0]
        for r in rows[1:]:
            out = out + r
        return out

    def step(s: Column, x: Column) -> Column:
        j, vp, vn = s["j"], s["vp"], s["vn"]

        def after(d0: Column) -> Column:
            hp, hn, low = vn.bitwiseOR(flip(d0.bitwiseOR(vp))), d0.bitwiseAND(vp), F.shiftright(d0, 1)
            at = m - j + edits
            moved = F.when(j <= m - edits, big(1) - F.shiftright(d0, 2 * edits).bitwiseAND(big(1))).otherwise(
                right(hp, at).bitwiseAND(big(1)) - right(hn, at).bitwiseAND(big(1)))
            return F.struct((j + 1).alias("j"), hn.bitwiseOR(flip(low.bitwiseOR(hp))).alias("vp"),
                            low.bitwiseAND(hp).alias("vn"), (s["dist"] + moved).alias("dist"))

        carried = (x.bitwiseAND(vp) + vp).bitwiseAND(full)
        return _bind(carried.bitwiseXOR(vp).bitwiseOR(x).bitwiseOR(vn), after)

    start = F.struct(F.lit(1).alias("j"), big(((1 << width) - 1) - ((1 << edits) - 1)).alias("vp"), big(0).alias("vn"),
                     F.least(m, F.lit(edits)).cast("bigint").alias("dist"))
    return F.aggregate(F.transform(b, matches), start, step)["dist"]


def _shared_start(a: Column, b: Column) -> Column:
    """How many characters both lines start with, in whole blocks."""
    blocks = F.floor(F.least(F.length(a), F.length(b)) / BLOCK).cast("int")
    differ = F.filter(F.sequence(F.lit(0), blocks), lambda i: (i == blocks) | (
        F.substring(a, i * BLOCK + 1, F.lit(BLOCK)) != F.substring(b, i * BLOCK + 1, F.lit(BLOCK))))
    return F.get(differ, 0) * BLOCK


def _trimmed_distance(a: Column, b: Column, edits: int) -> Column:
    """Edit distance of two lines after cutting off what both start and end with.

    Each step is computed once and handed to the next as a lambda's variable."""
    lines_ = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    cut = lambda p, n: lines_(F.reverse(F.substring(p["x"], n + 1, F.length(p["x"]))),
                              F.reverse(F.substring(p["y"], n + 1, F.length(p["y"]))))
    once = lambda p, use: _bind(_shared_start(p["x"], p["y"]), lambda n: _bind(cut(p, n), use))
    return _bind(lines_(a, b), lambda p: once(p, lambda q: once(q, lambda r: _bind(
        lines_(_characters(r["x"]), _characters(r["y"])), lambda c: banded_distance(c["x"], c["y"], edits)))))


def _characters(line: Column) -> Column:
    return F.when(line == "", F.array().cast("array<string>")).otherwise(F.split(line, ""))


def verified(text: DataFrame, pairs: DataFrame, edits: int) -> DataFrame:
    """The pairs (a, b) within ``edits`` edits; ``text`` has their lines by place."""
    held = text.select(F.struct("d", "n").alias("at"), "line")
    left = held.select(F.col("at").alias("a"), F.col("line").alias("la"))
    right = held.select(F.col("at").alias("b"), F.col("line").alias("lb"))
    both = pairs.join(left, "a").join(right, "b").where(F.abs(F.length("la") - F.length("lb")) <= edits)
    return both.where(_trimmed_distance(F.col("la"), F.col("lb"), edits) <= edits).select("a", "b").distinct()


def near_pairs(docs: DataFrame, firsts: DataFrame, edits: int, least: int) -> DataFrame:
    """All links (a, b) between distinct lines, a earlier; places are structs (d, n)."""
    rows = (firsts.select("d", "n", F.posexplode("keys").alias("slot", "key")).where("key is not null")
            .withColumn("index", F.col("slot") <= edits))
    level = written(_shared(rows), "lines-shared")
    text = written(_fetch(docs, level.select("d", "n").distinct()).withColumn("bag", _bag("line")), "lines-text")
    level = written(level.join(text.withColumnRenamed("line", "rest"), ["d", "n"]), "lines-shared")
    candidates = _pairs(level.where(F.col("size") <= BUCKET), edits)
    while level.where(F.col("size") > BUCKET).limit(1).count():
        finer, ended = _divide(level.where(F.col("size") > BUCKET), edits)
        level = written(_shared(finer), "lines-shared")
        candidates = candidates.union(ended).union(_pairs(level.where(F.col("size") <= BUCKET), edits))
    return verified(text, written(candidates.distinct(), "lines-pairs"), edits)


def _divide(large: DataFrame, edits: int) -> tuple[DataFrame, DataFrame]:
    """The join within large buckets, on what is left of the lines without the shared segment.

    Index rows of a bucket have lines of one length (``target`` without the
    segment); its probes keep their own difference to it.  Gives the rows of the
    finer buckets, and the pairs of buckets whose rest is too short to be cut."""
    less_of, i_of, shift_of = (F.array(*[F.lit(s[k]) for s in slots(edits)]) for k in range(3))
    begin, size = f"(target * (i - 1)) div {edits + 1}", f"((target * i) div {edits + 1} - (target * (i - 1)) div {edits + 1})"
    cut = (large.select("key", "index", "slot", "d", "n", "bag", "rest")
           .withColumns({"target": F.length("rest") - F.get(less_of, F.col("slot")), "i": F.get(i_of, F.col("slot"))})
           .withColumns({"begin": F.expr(f"cast({begin} as int)") + F.get(shift_of, F.col("slot")),
                         "size": F.expr(f"cast({size} as int)")}))
    rest = written(cut.select("key", "index", "d", "n", "bag", (F.col("target") - F.col("size")).alias("target"),
                              F.expr("concat(substring(rest, 1, begin), substring(rest, begin + size + 1))").alias("rest")).distinct(),
                   "lines-rest")
    keys = _keys(F.col("rest"), F.length("rest"), F.col("key"), edits, 1)
    finer = (rest.where(F.col("target") > edits)
             .select("index", "d", "n", "bag", "rest", "target", F.posexplode(keys).alias("slot", "key"))
             .where(F.col("key").isNotNull() & (F.length("rest") - F.get(less_of, F.col("slot")) == F.col("target")))
             .select("key", (F.col("index") & (F.col("slot") <= edits)).alias("index"), "slot", "d", "n", "bag", "rest"))
    return finer, _pairs(rest.where(F.col("target") <= edits), edits)


def dedup(docs: DataFrame, edits: int = EDITS, least: int = LEAST, fold_short: bool = False) -> DataFrame:
    """``docs`` with kept_text, n_lines, n_removed and n_links (links of the lines that start in the document).

    ``fold_short`` also removes exact copies of shorter lines that are not blank."""
    firsts = written(distinct_lines(docs.select("doc_id", "text"), edits, least), "lines-first")
    links = written(near_pairs(docs.select("doc_id", "text"), firsts, edits, least), "lines-links")
    ends = links.select("a.*", F.lit(0).alias("gone")).union(links.select("b.*", F.lit(1).alias("gone")))
    judged = ends.groupBy("d", "n").agg(F.count("*").alias("links"), F.max("gone").alias("gone"))
    places = firsts.select("d", "n")
    if fold_short:
        places = places.union(short_lines(docs, least))
    kept = (places.join(judged, ["d", "n"], "left").groupBy("d")
            .agg(F.collect_list(F.when(F.coalesce("gone", F.lit(0)) == 0, F.col("n"))).alias("__kept"),
                 F.sum("links").alias("__links")))
    rows = docs.withColumn("__d", _doc()).withColumn("__lines", F.split("text", "\n"))
    joined = rows.join(kept.withColumnRenamed("d", "__d"), "__d", "left")
    always = lambda x: (F.length(x) < least) & (~x.rlike(WORD_PATTERN) if fold_short else F.lit(True))
    short = F.filter(F.sequence(F.lit(0), F.size("__lines") - 1), lambda i: always(F.get("__lines", i)))
    stay = joined.withColumn("__stay", F.array_sort(F.array_distinct(F.concat(
        short, F.coalesce("__kept", F.array().cast("array<int>"))))))
    # a repeated doc_id can name line numbers that this row does not have
    stay = stay.withColumn("__stay", F.filter("__stay", lambda i: i < F.size("__lines")))
    return (stay.withColumns({
        "kept_text": F.array_join(F.transform("__stay", lambda i: F.get("__lines", i)), "\n"),
        "n_lines": F.coalesce(F.size("__lines"), F.lit(0)).cast("bigint"),
        "n_removed": F.coalesce(F.size("__lines") - F.size("__stay"), F.lit(0)).cast("bigint"),
        "n_links": F.coalesce("__links", F.lit(0)).cast("bigint")})
        .drop("__d", "__lines", "__kept", "__links", "__stay"))
