"""Operator 8: removal of repeated runs of two or more lines, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

#: A boundary follows a line if the rolling hash over it and the line before is 0 modulo this: chunks of so many lines on average.
MEAN_LINES = 3
SALTS = 16
_LOWEST = -(1 << 63)


def with_runs(rows: DataFrame, mean_lines: int = MEAN_LINES) -> DataFrame:
    """Add _lines, the lines of text, and _runs: (_at, _to, _in, _chunk) for each chunk and for pairs of neighbouring lines.

    A rolling hash over two line hashes chooses the boundaries of chunks: whether one stands before a line depends on the two lines
    before it alone, so an insertion moves no boundary beyond the next two lines. A chunk runs from its first line that isn't blank
    to its last, and has three such lines at least. A pair is a line that isn't blank and the next such line; _in is where the chunk
    around it begins, -1 over a boundary. A chunk of one pair is just that.
    """
    edge = f"pmod(xxhash64(get(_h, i - 2), get(_h, i - 1)), {mean_lines}) = 0"
    steps = {
        "_lines": r"split(text, '\n', -1)",
        "_h": "transform(_lines, x -> xxhash64(x))",
        "_solid": r"transform(_lines, x -> x rlike '\\S')",
        "_cuts": f"filter(sequence(0, size(_h) - 1), i -> i = 0 or {edge})",
        "_bounds": "transform(_cuts, (c, k) -> transform(array(coalesce(get(_cuts, k + 1), size(_h))), e -> struct(c as a, e as b, slice(_solid, c + 1, e - c) as s))[0])",
        "_chunks": "filter(transform(filter(_bounds, x -> array_contains(x.s, true)), x -> struct(cast(x.a + array_position(x.s, true) - 1 as int) as _at, cast(x.b - array_position(reverse(x.s), true) as int) as _to)), c -> c._at < c._to)",
        "_within": "flatten(transform(_chunks, c -> transform(array(filter(sequence(c._at, c._to), i -> get(_solid, i))), s -> concat(array(struct(c._at, c._to, c._at as _in, size(s) > 2 as _chunk)), if(size(s) > 2, transform(slice(s, 1, size(s) - 1), (x, k) -> struct(x as _at, s[k + 1] as _to, c._at as _in, false as _chunk)), cast(array() as array<struct<_at: int, _to: int, _in: int, _chunk: boolean>>))))[0]))",
        "_all": "filter(sequence(0, size(_h) - 1), i -> get(_solid, i))",
        "_over": f"filter(transform(slice(_all, 1, greatest(size(_all) - 1, 0)), (x, k) -> struct(x as _at, get(_all, k + 1) as _to, -1 as _in, false as _chunk)), p -> exists(sequence(p._at + 1, p._to), i -> {edge}))",
        "_runs": "concat(_within, _over)",
    }
    for name, expression in steps.items():
        rows = rows.withColumn(name, F.expr(expression))
    return rows.drop("_h", "_solid", "_cuts", "_bounds", "_chunks", "_within", "_all", "_over")


#: The bytes of a run p with the blank lines within.
_BODY = "array_join(slice(_lines, p._at + 1, p._to - p._at + 1), '\\n')"
#: The salt of a place, and all salts.
_SALT = f"pmod(xxhash64(_id, _hash, _at), {SALTS})"
_SALTS = f"explode(sequence(0, {SALTS - 1})) as _salt"


def repeated_lines(rows: DataFrame) -> DataFrame:
    """Row key (_id, _hash) and _gone, the numbers of the lines to remove, for rows of _id, _hash and text that lose any.

    1. Hashes of all chunks and pairs are counted without their bytes, and of equal ones the first by _id, _hash and place is noted;
       those seen once go at once.
    2. A chunk that is not the first with its hash answers for all pairs within: they are left out. Other pairs carry the match on
       over the boundaries, to where the repeated run ends, and find runs that are shorter than the chunks around them.
    3. The rows' texts are shuffled once, by row key, and the bytes of these runs are written to the shared folder.
    4. Those bytes are grouped; of equal ones the first stays, and all others that don't overlap it are found by a join on their
       hash, and on the bytes too where different ones share a hash.
    A run of lines stood before just if all of its pairs did, so that every repeated run of two lines or more is found whole; the
    first place of a pair never lies in a chunk that stood before. Joins by hash are salted, so that a run which a third of all rows
    have is spread out. (Two different chunks with equal hashes, 96 bits, would be kept with the pairs within.)
    """
    runs = "inline(transform(_runs, p -> struct(p._at, p._to, p._in, p._chunk, xxhash64({0}) as _key, if(p._chunk, hash({0}), 0) as _more)))".format(_BODY)
    marks = with_runs(rows).select("_id", "_hash", F.expr(runs)).withColumn("_salt", F.expr(_SALT))
    place = F.struct("_id", "_hash", "_at")
    seen = marks.groupBy("_key", "_more").agg(F.count("*").alias("_n"), F.min(place).alias("_first")).filter("_n > 1")
    found = marks.join(seen.select("_key", "_more", "_first", F.expr(_SALTS)), ["_key", "_more", "_salt"]).withColumn("_later", F.col("_chunk") & (place != F.col("_first")))
    chunks = found.groupBy("_id", "_hash", "_in").agg(F.max("_later").alias("_later"), F.collect_list(F.struct("_at", "_to", "_chunk")).alias("_found"))
    left = chunks.withColumn("_found", F.expr("if(_later and _in >= 0, filter(_found, p -> p._chunk), _found)"))
    places = left.groupBy("_id", "_hash").agg(F.flatten(F.collect_list("_found")).alias("_places"))
    placed = rows.join(places, ["_id", "_hash"]).withColumn("_lines", F.split("text", "\n", -1))
    bodies = placed.select("_id", "_hash", F.expr(f"inline(array_distinct(transform(_places, p -> struct(p._at, p._to, {_BODY} as _body))))"))
    bodies = stored(bodies, "bodies", clean=True).withColumn("_key", F.xxhash64("_body")).withColumn("_salt", F.expr(_SALT))
    first = bodies.groupBy("_body").agg(F.min(F.struct("_id", "_hash", "_at", "_to")).alias("_first"), F.count("*").alias("_n"))
    same = first.groupBy(F.xxhash64("_body").alias("_key")).agg(F.collect_list(F.struct("_body", "_first", "_n")).alias("_same"))
    first = same.select("_key", F.expr("inline(transform(_same, x -> struct(if(size(_same) > 1, x._body, null) as _only, x._first, x._n)))")).filter("_n > 1")
    again = bodies.join(first.select("_key", "_only", "_first", F.expr(_SALTS)), ["_key", "_salt"])
    again = again.filter("(_only is null or _only = _body) and (_id != _first._id or _hash != _first._hash or _at > _first._to)")
    return again.groupBy("_id", "_hash").agg(F.collect_set(F.struct("_at", "_to")).alias("_gone")).withColumn("_gone", F.expr("array_distinct(flatten(transform(_gone, p -> sequence(p._at, p._to))))"))


def dedup_lines(docs: DataFrame, drop_emptied: bool = True, count: str | None = "n_lines_removed") -> DataFrame:
    """docs without repeated runs of lines, with the columns of docs plus the lines removed; n_chars follows where it is there.

    Every run of two or more lines that aren't blank goes, with the blank lines within, wherever the same bytes stood before in docs,
    by doc_id, in the whole table (its own document included, but for a run that overlaps the first). The rest stays as it was, line
    for line. A document that keeps no line but blank ones goes, unless drop_emptied is False; texts that are empty or null from the
    start stay as they are. Rows with equal doc_id and text share one fate. A null doc_id counts as the lowest. An empty table gives
    an empty one. Texts may be of any length, with any number of lines, and docs may have any other columns: they travel as one
    struct, so that no name clashes. count is the name of the column with the lines removed, which takes the place of one of docs with
    that name; with None there is none, and docs keep all of theirs.
    """
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST).cast("long")).alias("_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("_hash")]
    gone = repeated_lines(docs.select(*key, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    both = docs.select(*key, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")).join(gone, ["_id", "_hash"], "left")
    cut = both.withColumn("_lines", F.when(F.col("_gone").isNotNull(), F.split("_row.text", "\n", -1))).withColumn("_left", F.expr("array_except(sequence(0, size(_lines) - 1), _gone)"))
    text = F.when(F.col("_gone").isNull(), F.col("_row.text")).otherwise(F.expr("array_join(transform(_left, i -> get(_lines, i)), '\\n')"))
    lost = F.when(F.col("_gone").isNull(), F.lit(0)).otherwise(F.size("_lines") - F.size("_left")).cast("long")
    # a generated row of its own: a filter on it isn't pushed into the lines' lambdas, where it would be worked out line by line
    out = cut.select("_row", F.inline(F.array(F.struct(text.alias("_text"), lost.alias("_lost")))))
    if drop_emptied:
        out = out.filter((F.col("_lost") == 0) | F.col("_text").rlike(r"\S"))
    new = {"text": F.col("_text"), "n_chars": F.when(F.col("_lost") > 0, F.length("_text").cast("long")).otherwise(F.col("_row.n_chars"))} if "n_chars" in docs.columns else {"text": F.col("_text")}
    kept = [new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns if c != count]
    return out.select(*kept, *([F.col("_lost").alias(count)] if count else []))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents without repeated runs of lines: doc_id, lines removed, characters left, and sha256 of the text left."""
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"), drop_emptied=False)
    text = F.coalesce("text", F.lit(""))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "n_lines_removed", F.length(text).cast("long").alias("n_chars"), F.sha2(text.cast("binary"), 256).alias("text_sha256"))
