"""Removal of lines that stand elsewhere, exactly or within a few edits. DataFrame functions only.

Equal lines are found by a 128-bit hash. Lines of at least `min_chars` characters are also joined by edit distance:
a line is cut into threshold + 1 segments, and two lines within the threshold share one of them unchanged. Segments
are indexed under the line's length and the segment's number; a line probes the index of every length that it may
match, at the few places where the segment can have moved to. Pairs that meet are verified by a banded bit-parallel
edit distance on what is left between their common beginning and end.

Each line is first verified against one partner, the smallest line that it meets. The links found make clusters,
and only index entries that still hold more than one cluster give pairs, so a large group of variants of one line
costs one check a line. Of each class of lines the first occurrence stays: smallest key, then first place.

Lines that a frequent-items summary names (a bounded number, broadcast) enter the index once, not once per
occurrence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.graph import components
from termloom.settings import stored

EDITS = 2
MIN_CHARS = 20
HOT_LINES, COUNTERS, HOT_COUNT = 512, 8192, 500
# Words of 64 bits in the filter that is broadcast before the texts of candidates move: a fixed size.
FILTER_WORDS = 1 << 17
# Classes of characters that are counted before pairs are made; any choice is right, frequent characters tell most.
CLASSES = ("a", "e", "i", "n", "o", "r", "s", "t", "hw", "dl", "uc", "gmb")
# Stands for a missing key; it is never smaller than a key.
NO_KEY = 2**63 - 1
# Common beginnings are measured with steps of these lengths; their sum is the longest text that there can be.
STEPS = [1 << i for i in range(30, -1, -1)]


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def signatures(lines: DataFrame, edits: int) -> DataFrame:
    """(line, key, indexed) for lines (line, body, size): the segments of each line of `size` characters, and its probes
    of lines not longer than itself. One short formula is applied to every (length difference, segment, shift), which
    the compiler takes better than one long row of them."""
    parts = edits + 1
    places = [
        (shorter, part, shift)
        for shorter in range(edits + 1)
        for part in range(parts)
        for shift in range(max(-part, shorter - (edits - part)), min(part, shorter + edits - part) + 1)
    ]
    names = ("shorter", "part", "shift")
    every = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, place, strict=True)]) for place in places])
    rows = lines.select("line", "body", "size", F.inline(every))
    part, shift, length = F.col("part"), F.col("shift"), F.col("size") - F.col("shorter")
    low = F.floor(length / parts).cast("int")
    # The last segments have one character more, as many as are left over.
    more = length - low * parts
    start = low * part + F.greatest(more - (F.lit(parts) - part), F.lit(0)) + shift
    width = low + (more >= F.lit(parts) - part).cast("int")
    inside = (start >= 0) & (start + width <= F.col("size")) & (length > 0)
    key = F.xxhash64(length, part, F.substring("body", start + 1, width))
    return rows.where(inside).select("line", key.alias("key"), ((F.col("shorter") == 0) & (shift == 0)).alias("indexed"))


def _common(a: Column, b: Column) -> Column:
    """Characters that two texts have in common at their beginning."""
    shorter = F.least(F.length(a), F.length(b))

    def longer(have, step):
        same = F.substring(a, have + 1, step) == F.substring(b, have + 1, step)
        return F.when((have + step <= shorter) & same, have + step).otherwise(have)

    return F.reduce(F.array(*[F.lit(s) for s in STEPS]), F.lit(0), longer)


def _let(value: Column, use) -> Column:
    """use(value), with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _banded(a: Column, b: Column, edits: int) -> Column:
    """Edit distance of two arrays of characters whose sizes differ by `edits` at most; more than `edits` if it is
    larger. Bit k of every vector is the row at distance k - edits from the diagonal."""
    top, mask = 2 * edits, (1 << (2 * edits + 1)) - 1
    rows = F.size(a)
    start = F.struct(
        _long(mask ^ ((1 << edits) - 1)).alias("vp"), _long(0).alias("vn"), F.least(rows, F.lit(edits)).cast("long").alias("distance")
    )

    def bit(vector, k):
        return F.shiftrightunsigned(vector, k).bitwiseAND(_long(1)) if isinstance(k, int) else F.call_function("shiftrightunsigned", vector, k).bitwiseAND(_long(1))

    def column(state, j):
        vp, vn = state["vp"], state["vn"]
        here = F.element_at(b, j)
        equal = _long(0)
        for k in range(top + 1):
            same = F.coalesce(F.get(a, j - 1 - edits + k) == here, F.lit(False))
            equal = equal + F.when(same, _long(1 << k)).otherwise(_long(0))

        def step(x):
            d0 = (x.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(x).bitwiseOR(vn).bitwiseAND(_long(mask))

            def rest(d):
                hp = vn.bitwiseOR(F.bitwise_not(d.bitwiseOR(vp))).bitwiseAND(_long(mask))
                hn = d.bitwiseAND(vp)
                half = F.shiftrightunsigned(d, 1)
                low = F.greatest(rows - j + F.lit(edits), F.lit(0)).cast("int")
                moved = F.when(j <= rows - edits, _long(1) - bit(d, top)).otherwise(bit(hp, low) - bit(hn, low))
                return F.struct(
                    hn.bitwiseOR(F.bitwise_not(half.bitwiseOR(hp))).bitwiseAND(_long(mask)).alias("vp"),
                    half.bitwiseAND(hp).alias("vn"),
                    (state["distance"] + moved).alias("distance"),
                )

            return _let(d0, rest)

        return _let(equal, step)

    return F.reduce(F.sequence(F.lit(1), F.size(b)), start, column, lambda s: s["distance"])


def edit_distance(a: Column, b: Column, edits: int) -> Column:
    """Insertions, deletions and replacements between two texts; more than `edits` if there are more."""

    def ends(texts):
        def tails(head):
            rest = F.struct(*[F.reverse(F.substring(texts[x], head + 1, F.length(texts[x]))).alias(x) for x in "ab"])
            return _let(rest, lambda r: _let(_common(r["a"], r["b"]), lambda tail: cores(r, tail)))

        return _let(_common(texts["a"], texts["b"]), tails)

    def cores(rest, tail):
        sizes = [F.length(rest[x]) - tail for x in "ab"]
        longest = F.greatest(*sizes)
        parts = F.struct(*[F.split(F.substring(rest[x], tail + 1, F.length(rest[x])), "").alias(x) for x in "ab"])
        banded = _let(parts, lambda p: _banded(p["a"], p["b"], edits))
        # The cores differ at both ends, so edits - 2 are left for what is `edits` or more from both ends of one
        # core, and of edits - 1 parts of that one stands unchanged in the other core.
        inner, pieces = sizes[0] - 2 * edits, edits - 1
        if pieces < 1:
            banded = _long(edits + 1)
        else:
            piece = F.floor(inner / pieces).cast("int")
            texts = [F.substring(rest[x], tail + 1, F.length(rest[x])) for x in "ab"]
            unchanged = [F.contains(texts[1], F.substring(texts[0], piece * i + (edits + 1), piece)) for i in range(pieces)]
            possible = inner < pieces
            for found in unchanged:
                possible = possible | found
            banded = F.when(possible, banded).otherwise(_long(edits + 1))
        return F.when((F.least(*sizes) == 0) | (longest <= 1), longest.cast("long")).otherwise(banded)

    distance = _let(F.struct(a.alias("a"), b.alias("b")), ends)
    return F.when(F.abs(F.length(a) - F.length(b)) > edits, _long(edits + 1)).otherwise(distance)


def _counts(body: Column) -> Column:
    """How often the characters of each class stand in a text."""
    rest = [F.length(F.translate(body, characters, "")) for characters in CLASSES]
    return F.struct(*[(F.length(body) - left).alias(f"c{i}") for i, left in enumerate(rest)])


def _may_be_near(a: Column, b: Column, edits: int) -> Column:
    """Necessary for two texts with these counts: an edit changes one character of at most two classes."""
    apart = F.lit(0)
    for i in range(len(CLASSES)):
        apart = apart + F.abs(a[f"c{i}"] - b[f"c{i}"])
    return apart <= 2 * edits


def _maybe(lines: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows of `lines` whose column line may be in `chosen`: a filter of fixed size, broadcast. It never loses one."""
    slot = F.pmod(F.xxhash64("line"), F.lit(64 * FILTER_WORDS))
    word, place = F.shiftright(slot, 6), slot.bitwiseAND(_long(63)).cast("int")
    bits = chosen.select(word.alias("word"), F.call_function("shiftleft", _long(1), place).alias("bit"))
    bits = bits.groupBy("word").agg(F.bit_or("bit").alias("bits"))
    kept = lines.withColumns({"word": word, "place": place}).join(F.broadcast(bits), "word")
    return kept.where(F.call_function("shiftrightunsigned", F.col("bits"), F.col("place")).bitwiseAND(_long(1)) == 1).drop("word", "place", "bits")


def _verify(pairs: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """Of the pairs (line, other), those within the threshold."""
    with_texts = pairs.join(texts, "line").join(texts.select(F.col("line").alias("other"), F.col("body").alias("other_body")), "other")
    return with_texts.where(edit_distance(F.col("body"), F.col("other_body"), edits) <= edits).select("line", "other")


def near_lines(lines: DataFrame, edits: int = EDITS) -> DataFrame:
    """line, root for every line that is within `edits` of another one: classes of the columns (line, body, size), where
    line is an even 64-bit number that stands for the text body of size characters. Rows may repeat."""
    spark = lines.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    top = lines.agg(F.expr(f"approx_top_k(line, {HOT_LINES}, {COUNTERS})").alias("top")).select(F.explode("top").alias("t"))
    hot = [(r["item"],) for r in top.select("t.item", "t.count").collect() if r["count"] > HOT_COUNT]  # at most HOT_LINES
    frequent = F.broadcast(spark.createDataFrame(hot, "line long"))
    once = lines.join(frequent, "line").groupBy("line").agg(F.min("body").alias("body"), F.min("size").alias("size"))
    entries = lines.join(frequent, "line", "left_anti").unionByName(once)

    # The lowest bit of the line's number says whether the entry is of the index.
    signed = signatures(entries, edits)
    signed = signed.select("key", F.col("line").bitwiseOR(F.col("indexed").cast("long")).alias("entry")).repartition(partitions, "key")
    line = F.col("entry").bitwiseAND(_long(-2))
    indexed = F.when(F.col("entry").bitwiseAND(_long(1)) == 1, line)
    keys = signed.groupBy("key").agg(F.min(indexed).alias("centre"), F.min(line).alias("a"), F.max(line).alias("b"))
    keys = keys.where("centre is not null and a <> b").select("key", "centre")
    met = stored(signed.join(keys.hint("shuffle_hash"), "key").select("key", "entry", "centre").distinct(), "met")

    member = met.select("key", "centre", line.alias("line"))
    candidates = member.select("line").distinct()
    # An inner join: a semi join would be moved below the filter and shuffle every line.
    texts = _maybe(lines, candidates).join(candidates, "line").groupBy("line").agg(F.min("body").alias("body"))
    texts = stored(texts, "line-texts")

    first = member.where("line <> centre").groupBy("line").agg(F.min("centre").alias("other"))
    links = stored(_verify(first, texts, edits), "line-links")
    clusters = stored(components(links, "line-clusters"), "line-clusters")

    roots = clusters.select(F.col("node").alias("line"), "root")
    owned = met.select("key", line.alias("line"), indexed.isNotNull().alias("indexed")).join(roots, "line", "left")
    owned = owned.withColumn("root", F.coalesce("root", "line"))
    several = owned.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("key")
    counts = texts.select("line", _counts(F.col("body")).alias("counts"))
    owned = stored(owned.join(several, "key").join(counts, "line"), "line-mixed")
    right = owned.where("indexed").select(
        "key", F.col("line").alias("other"), F.col("root").alias("other_root"), F.col("counts").alias("other_counts")
    )
    # A pair of two indexed lines is met from both sides; one is enough. Counts that are too far apart make no pair.
    wanted = F.expr("root <> other_root and line <> other and (not indexed or line > other)")
    pairs = owned.join(right, "key").where(wanted & _may_be_near(F.col("counts"), F.col("other_counts"), edits))
    pairs = pairs.select(F.greatest("line", "other").alias("line"), F.least("line", "other").alias("other")).distinct()
    between = _verify(pairs.join(first, ["line", "other"], "left_anti"), texts, edits)
    return components(links.unionByName(between), "line-classes").select(F.col("node").alias("line"), "root")


def line_dedup(
    docs: DataFrame, key: str = "doc_id", text: str = "text", edits: int = EDITS, min_chars: int = MIN_CHARS,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per row of `docs`: the key, n_lines, n_removed, kept (the text without the removed lines), kept_in (keys of
    the rows where the removed lines stay, sorted).

    Lines end at a line feed. Lines of white space only are never removed. Lines are of one class if they are equal, or if
    both have `min_chars` characters and are joined by steps of at most `edits` edits. Of a class the first occurrence
    stays: smallest key, then first in the text. Null counts as empty; an empty text is one empty line. Rows that repeat
    key and text are one document and keep the same lines; rows without a key come after all others. Lines of rows with
    one key but different texts count as different occurrences. An empty table gives no rows. Other columns are
    not read, except those named in `carry`, which come out in a struct `rest`.
    """
    if edits < 1 or min_chars <= edits:
        raise ValueError("edits is at least 1 and min_chars is larger")
    kind = docs.schema[key].dataType.simpleString()
    place = ["kid", "th"]
    rest = F.struct(*carry) if carry else F.struct(F.lit(None).cast("string").alias("none"))
    rows = docs.select(rest.alias("rest"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(key).cast("long"), _long(NO_KEY)).alias("kid"))
    rows = rows.withColumns({"th": F.xxhash64("text"), "lines": F.split("text", "\n")})
    # Sizes are worked out before the lines become rows, so that no later expression counts characters again.
    sized = F.transform("lines", lambda line: F.struct(line.alias("body"), F.length(line).alias("size")))
    lines = rows.select(*place, F.posexplode(sized).alias("at", "one")).select(*place, "at", "one.*").where(F.col("body").rlike("\\S"))
    even = F.xxhash64("body").bitwiseAND(_long(-2))
    named = lines.withColumns({"line": even, "more": F.xxhash64(F.lit("line"), F.col("body"))})

    classes = near_lines(named.where(F.col("size") >= min_chars).select("line", "body", "size"), edits)
    classes = stored(classes, "line-roots")

    seen = named.select("line", "more", F.struct("kid", "at", "th").alias("where"))
    firsts = seen.groupBy("line", "more").agg(F.min("where").alias("first"))
    owners = firsts.join(classes, "line")
    heads = owners.groupBy("root").agg(F.min("first").alias("head"))
    moved = owners.join(heads, "root").select("line", "more", "head")
    kept_at = firsts.join(moved, ["line", "more"], "left").select("line", "more", F.coalesce("head", "first").alias("stays"))
    gone = seen.join(kept_at, ["line", "more"]).where("where <> stays").select("where.*", F.nullif("stays.kid", _long(NO_KEY)).alias("owner"))
    lists = gone.groupBy(*place).agg(F.collect_set("at").alias("gone"), F.array_sort(F.collect_set("owner")).alias("kept_in"))

    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = rows.select(*place, "text", *(["rest"] if carry else [])).repartition(partitions, *place).join(lists.hint("shuffle_hash"), place, "left")
    body = F.split("text", "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(body) - 1), F.coalesce("gone", F.array().cast("array<int>")))
    return found.withColumn("body", body).select(
        F.nullif("kid", _long(NO_KEY)).cast(kind).alias(key),
        F.size("body").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get("body", i)), "\n")).alias("kept"),
        F.coalesce("kept_in", F.array().cast("array<long>")).alias("kept_in"),
        *(["rest"] if carry else []),
    )
