"""Repeated passages by content-defined chunks of lines, in DataFrame functions only.

A rolling hash over the hashes of each two adjacent lines is taken along a text. A place whose rolling hash occurs
earlier in the table (in the order of doc_id, text hash and position) is an anchor, once the bytes of its two lines
are found to be equal; so is a line of more than `LONG` words that occurs earlier. Adjacent anchors join to a chunk:
it ends where the rolling hashes no longer repeat. Boundaries hence depend on the passage alone, wherever it stands
and whatever lines were put in or left out around it, and passages of two lines are found like those of many.
Chunks of `WORDS` words or more are removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contactmill.llm import common
from contactmill.session import stored

#: Hex digits of a line's MD5 that make its number, and the base of the rolling hash: no overflow in a long.
HEX = 12
BASE = 1021
#: A line of more words is an anchor by itself; a chunk of fewer words stays.
LONG = 50
WORDS = 20
#: Digests with more than this share of all repeated places are joined apart; there are at most so many of them.
HOT = 1000

_LINES = "split(__text, '\\n', -1)"
_HASHES = f"transform(__lines, l -> cast(conv(left(md5(l), {HEX}), 16, 10) as bigint))"
_COUNTS = "transform(__lines, l -> regexp_count(l, '[^\\\\x20\\\\x09-\\\\x0D]+'))"
#: Places of a text: its pairs of adjacent lines, then its long lines, whose digests are negative.
_PAIRS = (
    f"transform(h, (x, i) -> if(i = 0, null, named_struct('pos', i - 1, 'n', 2, 'digest', x * {BASE} + h[i - 1], "
    "'words', array(w[i - 1], w[i]))))"
)
_LONG = (
    f"transform(h, (x, i) -> if(w[i] <= {LONG}, null, "
    "named_struct('pos', i, 'n', 1, 'digest', -1 - x, 'words', array(w[i]))))"
)
_PIECE = "array_join(slice(__lines, {0}.pos + 1, {0}.n), '\\n')"

#: Lines under anchors in their order, the places in that list where a chunk begins, and the chunks.
_COVERED = (
    "array_sort(array_distinct(flatten(transform(__anchors, m -> "
    "transform(m.words, (x, i) -> named_struct('line', m.pos + i, 'words', x))))))"
)
_BEGINS = "filter(transform(c, (x, k) -> if(k > 0 and c[k - 1].line = x.line - 1, -1, k)), k -> k >= 0)"
_RUNS = "transform(b, (k, j) -> slice(c, k + 1, coalesce(get(b, j + 1), size(c)) - k))"
_CHUNKS = (
    "filter(transform(runs, u -> named_struct('first', u[0].line, 'n', size(u), "
    f"'words', aggregate(u, 0L, (t, x) -> t + x.words))), u -> u.words >= {WORDS})"
)
_REST = (
    "array_join(flatten(transform(sequence(0, size(__chunks)), j -> slice(__lines, "
    "1 + if(j = 0, 0, get(__chunks, j - 1).first + get(__chunks, j - 1).n), "
    "if(j = size(__chunks), size(__lines), get(__chunks, j).first) "
    "- if(j = 0, 0, get(__chunks, j - 1).first + get(__chunks, j - 1).n)))), '\\n')"
)


def _places(rows: DataFrame) -> DataFrame:
    """(id, key, pos, n, digest, words) of every pair of adjacent lines and every long line of ``__text``."""
    hashed = (
        rows.withColumn("__lines", F.expr(_LINES))
        .withColumn("h", F.expr(_HASHES))
        .withColumn("w", F.expr(_COUNTS))
    )
    place = F.explode(F.expr(f"array_compact(concat({_PAIRS}, {_LONG}))")).alias("place")
    return hashed.select("id", "key", place).select("id", "key", "place.*")


def _anchored(found: DataFrame, repeated: DataFrame) -> DataFrame:
    """Places with a repeated digest and the ``first`` place that has it.

    A digest with more than one in `HOT` of all repeated places is one of at most `HOT`. These are broadcast, so
    a passage that a third of all documents share is not joined in one task.
    """
    total = repeated.agg(F.sum("times").alias("total")).select("total").scalar()
    hot = repeated.where(F.col("times") * HOT > total).select("digest", "first")
    others = found.join(F.broadcast(hot.select("digest")), "digest", "left_anti")
    return found.join(F.broadcast(hot), "digest").unionByName(others.join(repeated.select("digest", "first"), "digest"))


def _spared(marked: DataFrame) -> DataFrame | None:
    """Marked places that are no anchors: the first ones of their own bytes, where a digest stands for several.

    The bytes of all places with a repeated digest are compared by grouping on them, with equal ones
    combined before the shuffle. None where each digest has one text, as is to be expected.
    """
    pieces = (
        marked.where("__marks is not null")
        .withColumn("__lines", F.expr(_LINES))
        .select("id", "key", "__lines", F.explode("__marks").alias("m"))
        .select("id", "key", "m.pos", "m.digest", F.expr(_PIECE.format("m")).alias("piece"))
    )
    texts = pieces.groupBy("digest", "piece").agg(F.min(F.struct("id", "key", "pos")).alias("first"))
    shared = texts.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    if shared.isEmpty():
        return None
    return texts.join(shared, "digest", "left_semi").groupBy(
        F.col("first.id").alias("spared_id"), F.col("first.key").alias("spared_key")
    ).agg(F.collect_set(F.struct("first.pos", "digest")).alias("spared"))


def _with_chunks(rows: DataFrame) -> DataFrame:
    """Rows with ``__text`` and ``__anchors``, and their __lines and __chunks (first line, lines, words) besides."""
    return (
        rows.withColumn("c", F.expr(_COVERED))
        .withColumn("b", F.expr(_BEGINS))
        .withColumn("runs", F.expr(_RUNS))
        .withColumn("__chunks", F.expr(_CHUNKS))
        .withColumn("__lines", F.expr(_LINES))
        .drop("c", "b", "runs")
    )


def without_repeated_chunks(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Documents without the chunks that occur earlier, with all columns and ``__removed_lines``.

    The first occurrence of a pair of lines stays, also within one document, unless another passage before it
    holds one of them; each line stays somewhere. Rows stay even where nothing of their text is left: then the text
    is empty. A text that loses nothing is returned as it is, null included; null and empty texts have no place
    that could repeat, and a text of one line has one if the line is long. Rows equal in doc_id and text count as
    one and get the same result. A null doc_id comes before all others. ``n_chars`` follows the text where the
    table has it. An empty table gives no rows. Other columns pass through, whatever their names.
    """
    common.prepare(spark)
    text = common.text_or_empty(F.col("__row.text"))
    packed = docs.select(F.struct("*").alias("__row")).select(
        "__row", F.col("__row.doc_id").alias("id"), F.xxhash64(text).alias("key")
    )
    found = stored(_places(packed.select("id", "key", text.alias("__text"))))
    repeated = stored(
        found.groupBy("digest")
        .agg(
            F.count("*").alias("times"),
            F.min(F.struct("id", "key", "pos")).alias("first"),
            F.max(F.struct("id", "key", "pos")).alias("last"),
        )
        .where("first <> last")
        .select("digest", "times", "first")
    )
    again = (F.struct("id", "key", "pos") != F.col("first")).alias("again")
    marks = (
        _anchored(found, repeated)
        .select("id", "key", F.struct("pos", "n", "digest", "words", again).alias("m"))
        .groupBy(F.col("id").alias("mark_id"), F.col("key").alias("mark_key"))
        .agg(F.collect_set("m").alias("__marks"))
    )
    # The text moves and is written once, in the row.
    marked = common.stored_texts(
        packed.join(
            marks.hint("shuffle_hash"),
            (F.col("key") == F.col("mark_key")) & F.col("id").eqNullSafe(F.col("mark_id")),
            "left",
        ).select("__row", "id", "key", "__marks")
    ).withColumn("__text", text)
    anchors = "filter(__marks, m -> m.again)"
    spared = _spared(marked)
    if spared is not None:
        marked = marked.join(
            spared, (F.col("key") == F.col("spared_key")) & F.col("id").eqNullSafe(F.col("spared_id")), "left"
        )
        kept = "coalesce(array_contains(spared, named_struct('pos', m.pos, 'digest', m.digest)), false)"
        anchors = f"filter(__marks, m -> m.again and not {kept})"
    rows = _with_chunks(marked.withColumn("__anchors", F.expr(anchors)))
    cut = F.coalesce(F.size("__chunks") > 0, F.lit(False))
    rows = rows.withColumn("__new", F.when(cut, F.expr(_REST)).otherwise(F.col("__row.text")))
    removed = F.when(cut, F.expr("aggregate(__chunks, 0, (total, u) -> total + u.n)")).otherwise(0)
    outputs = []
    for name in docs.columns:
        column: Column = F.col("__row").getField(name)
        if name == "text":
            column = F.col("__new")
        elif name == "n_chars":
            column = F.when(cut, F.char_length("__new")).otherwise(column).cast(docs.schema[name].dataType)
        outputs.append(column.alias(name))
    return rows.select(*outputs, removed.alias("__removed_lines"))
