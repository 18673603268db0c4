"""Near-equal lines by SimHash and pigeonhole blocks, in DataFrame and SQL functions only."""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modspark.llm.cluster import linked, members_of
from modspark.llm.common import doc_key, passing, stored, texts_of
from modspark.session import BROADCAST_MAX_ROWS

SIMILARITY = 0.8
BLOCKS, KEPT = 4, 2  # of a line of many words
FEW_CHARS = 33  # up to here characters are blocks
FEW_WORDS, FEW_WORDS_FROM = 9, 26  # words are blocks, in lines of so many characters and more
MANY_WORDS = 9  # from here blocks hold several words
PLANES = (2, 3, 4, 5, 6, 8, 10)  # binary digits of a vote's count, as few as do
EVEN = 256  # length of the pieces of evenly cut lines
NEAR = (8, 64, 512, 2048)  # edits that are looked for first
PIECE, PIECES, MARK = 32, 256, 16  # least length and about the most of the pieces that two lines are cut into; length of what cuts stand at


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` made once, as a variable."""
    return F.element_at(F.transform(F.array(value), use), 1)


def normalised(line: Column) -> Column:
    """Lower case, digits as 0, single spaces."""
    low = reduce(lambda c, digit: F.replace(c, F.lit(digit), F.lit("0")), "123456789", F.lower(line))

    def spaced(low: Column) -> Column:
        odd = reduce(lambda a, b: a | b, (F.contains(low, F.lit(x)) for x in ("  ", "\t", "\x0b", "\f", "\r")))
        return F.trim(F.when(odd, F.regexp_replace(low, r"\s+", " ")).otherwise(low))

    return _let(low, spaced)


def _split(text: Column) -> Column:
    return F.split(text, "\n", -1)


def occurrences(docs: DataFrame) -> DataFrame:
    """One row per line that isn't blank: document, ``line_no`` and ``norm``, its normalised text."""
    # Lines are normalised before they become rows: a filter on a column is put before the column's own
    # work, which would then be done again for each place that names it.
    lines = F.transform(_split(F.col("text")), normalised)
    return docs.select("ord", "key", F.posexplode_outer(lines).alias("line_no", "norm")).where("norm <> ''")


def _voted(hashes: Column, planes: int) -> Column:
    """Bits that more than half of ``hashes`` have. All 64 counts go on together: plane k holds their k-th
    binary digits, and adding a hash ripples through the planes."""
    names = [f"p{k}" for k in range(planes)]
    zero = F.struct(*(F.lit(0).cast("long").alias(n) for n in names))

    def add(sums: Column, h: Column) -> Column:
        carry = [h]
        for n in names[:-1]:
            carry.append(carry[-1].bitwiseAND(sums[n]))
        return F.struct(*(sums[n].bitwiseXOR(c).alias(n) for n, c in zip(names, carry, strict=True)))

    def vote(sums: Column) -> Column:
        """Counts above half the number, digit by digit from the lowest."""
        half = F.size(hashes).cast("long")
        more = F.lit(0).cast("long")
        for k, n in enumerate(names):
            digit = -F.shiftright(half, k + 1).bitwiseAND(F.lit(1).cast("long"))
            more = sums[n].bitwiseAND(F.bitwise_not(digit)).bitwiseOR(F.bitwise_not(sums[n].bitwiseXOR(digit)).bitwiseAND(more))
        return more

    return F.aggregate(hashes, zero, add, vote)


def simhash(hashes: Column) -> Column:
    """The bits that more than half of the words' hashes have."""
    # Of very many words each bit is counted by itself: the plan of a vote grows with the square of the planes.
    bits = F.transform(
        F.sequence(F.lit(0), F.lit(63)),
        lambda k: F.when(
            2 * F.size(F.filter(hashes, lambda h: F.call_function("getbit", h, k) == 1)).cast("long") > F.size(hashes),
            F.call_function("shiftleft", F.lit(1).cast("long"), k),
        ).otherwise(F.lit(0).cast("long")),
    )
    out = F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    for planes in reversed(PLANES):
        out = F.when(F.size(hashes) < 2**planes, _voted(hashes, planes)).otherwise(out)
    return out


def word_hashes(norm: Column) -> Column:
    return F.transform(F.split(norm, " "), lambda w: F.xxhash64(w))


def _none() -> Column:
    return F.array().cast("array<long>")


def block_keys(hashes: Column) -> Column:
    """Of a line of many words: its different words are dealt to ``BLOCKS`` blocks by their hashes, each block has a
    SimHash, and each ``KEPT`` of the SimHashes are a key. Two lines whose different words lie in
    two blocks share one. Keys of blocks that hold under a quarter of the words are left out."""

    def keys(blocks: Column) -> Column:
        sims = F.transform(blocks, simhash)

        def made(sims: Column) -> Column:
            out = []
            for k, kept in enumerate(itertools.combinations(range(BLOCKS), KEPT)):
                words = reduce(lambda a, b: a + b, (F.size(F.get(blocks, F.lit(i))) for i in kept))
                out.append(F.when(words * 4 >= F.size(hashes), F.xxhash64(F.lit(k), *(F.get(sims, F.lit(i)) for i in kept))))
            return F.array_compact(F.array(*out))

        return _let(sims, made)

    dealt = F.transform(F.array(*(F.lit(b).cast("long") for b in range(BLOCKS))), lambda b: F.filter(hashes, lambda h: h.bitwiseAND(F.lit(BLOCKS - 1).cast("long")) == b))
    return _let(dealt, keys)


def _all_but_one_word(hashes: Column) -> Column:
    """A line of few words: each word is a block, and all of them, or all but one, are a key."""
    less = F.transform(hashes, lambda h, i: F.xxhash64(F.lit("words"), F.concat(F.slice(hashes, F.lit(1), i), F.slice(hashes, i + 2, F.lit(FEW_WORDS)))))
    return F.concat(F.array(F.xxhash64(F.lit("words"), hashes)), less)


def _all_but_one_character(norm: Column) -> Column:
    """A short line: each character is a block, and all of them, or all but one, are a key."""
    places = F.sequence(F.lit(1), F.length(norm))
    less = F.transform(places, lambda i: F.xxhash64(F.lit("chars"), F.concat(F.substring(norm, F.lit(1), i - 1), F.substring(norm, i + 1, F.lit(FEW_CHARS)))))
    # Shorter than 5, one edit is more than a fifth.
    return F.concat(F.array(F.xxhash64(F.lit("chars"), norm)), F.when(F.length(norm) >= 5, less).otherwise(_none()))


def line_keys(norm: Column) -> Column:
    """Keys of a normalised line; lines that share one are compared.

    Blocks are the characters of lines of up to 33 characters, the words of lines of up to 9 words (from 26
    characters on, so that neighbours in length share a kind), and of others four groups of words by SimHash.
    So these are always compared: short lines one character apart, lines of few words
    one word apart (changed, put in or left out), and, but for a few of a hundred lines of 9 to 20 words, lines of
    more words one word apart. Lines with changes in more places share a key by chance.
    """

    def keys(hashes: Column) -> Column:
        n, size = F.size(hashes), F.length(norm)
        chars = F.when(size <= FEW_CHARS, _all_but_one_character(norm)).otherwise(_none())
        words = F.when((size >= FEW_WORDS_FROM) & (n <= FEW_WORDS), _all_but_one_word(hashes)).otherwise(_none())
        blocks = F.when((size >= FEW_WORDS_FROM) & (n >= MANY_WORDS), _let(F.array_distinct(hashes), block_keys)).otherwise(_none())
        return F.array_distinct(F.concat(chars, words, blocks))

    return _let(word_hashes(norm), keys)


def line_classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Lines whose group has more than one: ``ord, key`` (document), ``line_no``, ``keep`` (the kept occurrence).

    Lines are one text when their normalised forms are equal (lower case, digits as 0, single
    spaces). Different texts are linked when they share a key (``line_keys``) and their edit similarity, 1 -
    distance / longer length, is at least ``similarity``. The group's first occurrence by (doc_id,
    line) is kept.
    """
    with passing(docs.sparkSession):
        return stored(_classes(docs, similarity), "line_classes", keep=True)


def _at_most(x: Column, y: Column, most: Column) -> Column:
    """True where ``x`` and ``y`` are seen to be at most ``most`` edits apart; false tells nothing.

    Both are cut at the same marks, of ``MARK`` characters of ``x`` that ``y`` has too, in order; the edits between
    their pieces add up to no fewer than theirs. Spark's ``levenshtein`` takes time by the square of the length, whatever
    the bound.
    """
    one = F.greatest(F.lit(PIECE), F.length(x).cast("int") / PIECES).cast("int")

    def edits(state: Column, to_x: Column, to_y: Column) -> Column:
        a = F.substring(x, state["x"], to_x - state["x"])
        b = F.substring(y, state["y"], to_y - state["y"])
        return F.when(a == b, 0).otherwise(F.levenshtein(a, b))

    def cut(state: Column, at: Column) -> Column:
        mark, due = F.substring(x, at, F.lit(MARK)), state["y"] + at - state["x"]

        def cut_at(found: Column) -> Column:
            # A mark far from where it is due is of another place.
            far = (found == 0) | (found - due > one + PIECE)
            new = F.struct(at.alias("x"), found.alias("y"), (state["n"] + edits(state, at, found)).alias("n"))
            return F.when(far | (state["n"] > most), state).otherwise(new)

        # Where it is due, or next to it: a repeated word has the mark all over.
        def place(after: Column) -> Column:
            before = F.call_function("locate", mark, y, F.greatest(state["y"] + 1, due - PIECE))
            return _let(F.when((after > 0) & (after - due <= PIECE), after).otherwise(before), cut_at)

        return _let(F.call_function("locate", mark, y, due), place)

    def whole(state: Column) -> Column:
        rest = edits(state, F.length(x) + 1, F.length(y) + 1)
        long_ = F.length(x) - state["x"] > 16 * one
        return F.when((state["n"] > most) | long_, False).otherwise(state["n"] + rest <= most)

    start = F.struct(F.lit(1).alias("x"), F.lit(1).alias("y"), F.lit(0).alias("n"))
    places = F.filter(F.sequence(F.lit(1), F.length(x), one), lambda at: (at > 1) & (at + MARK <= F.length(x)))
    return F.aggregate(places, start, cut, whole)


def _at_most_evenly(x: Column, y: Column, most: Column) -> Column:
    """The same for long lines of one thing over and over: both are cut into as many pieces of even lengths."""
    many = F.ceil(F.length(x) / EVEN).cast("int")

    def edits(n: Column, i: Column) -> Column:
        def piece(line: Column) -> Column:
            a, b = (F.floor(F.length(line).cast("long") * k / many).cast("int") for k in (i, i + 1))
            return F.substring(line, a + 1, b - a)

        return F.when(n > most, n).otherwise(n + F.levenshtein(piece(x), piece(y)))

    places = F.sequence(F.lit(0), many - 1)
    return (F.length(x) > 2 * EVEN) & (F.aggregate(places, F.lit(0), edits) <= most)


def _classes(docs: DataFrame, similarity: float) -> DataFrame:
    place = F.struct("ord", "key", "line_no").alias("place")
    seen = occurrences(docs).select(place, F.xxhash64("norm").alias("h1"), F.xxhash64(F.lit(1), "norm").alias("h2"), "norm")
    seen = stored(seen, "lines", compression="zstd")
    # A frequent line is counted before it is shuffled; its occurrences come back to it in a join that
    # Spark splits. Each different line is kept once, with its text.
    texts = seen.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.first("norm").alias("norm"), F.count(F.lit(1)).alias("n"))
    texts = stored(texts.withColumn("id", F.monotonically_increasing_id()), "line_texts", compression="zstd")
    members = members_of(texts.select("id", F.explode(line_keys(F.col("norm"))).alias("band")))
    bodies = texts.join(members.select("id").distinct(), "id", "left_semi")
    bodies = stored(bodies.select("id", "h1", "h2", "first", "n", "norm", F.length("norm").alias("size")), "line_bodies")

    def verified(pairs: DataFrame) -> DataFrame:
        few = pairs.count() <= BROADCAST_MAX_ROWS  # ids are single, so no join makes more rows than there are pairs
        told = F.broadcast if few else lambda rows: rows
        x = bodies.select(F.col("id").alias("a"), F.col("norm").alias("x"), F.col("size").alias("na"))
        y = bodies.select(F.col("id").alias("b"), F.col("norm").alias("y"), F.col("size").alias("nb"))
        near = y.drop("y").join(told(x.drop("x").join(told(pairs), "a")), "b").where(F.least("na", "nb") >= similarity * F.greatest("na", "nb") - 1e-9)
        near = near.select("a", "b", F.floor((1 - similarity) * F.greatest("na", "nb") + 1e-9).cast("int").alias("most"))
        if few:  # else all texts are shuffled for a few pairs
            y = y.join(F.broadcast(near.select("b")), "b", "left_semi")
        both = x.drop("na").join(told(near), "a").join(y.drop("nb"), "b")
        # -1: more edits than that. Most pairs are few edits apart, which a narrow band shows.
        close = F.expr("levenshtein(x, y, most) >= 0")
        for few in reversed(NEAR):
            close = F.when(F.expr(f"levenshtein(x, y, least(most, {few})) >= 0"), True).when(F.col("most") <= few, False).otherwise(close)
        # A line within a line is as many edits away as it is shorter, which was asked already.
        within = F.contains("x", F.col("y")) | F.contains("y", F.col("x"))
        sides = F.col("x"), F.col("y"), F.col("most")
        seen_near = F.when(_at_most(*sides), True).when(_at_most_evenly(*sides), True)
        return both.where(F.when(within, True).otherwise(seen_near.otherwise(close))).select("a", "b")

    _, roots = linked(members, verified)
    # Only texts that occur again, or have a near one, send word to their occurrences.
    groups = bodies.select("id", "h1", "h2", "first", "n").join(roots, "id")
    keep = groups.groupBy("root").agg(F.min("first").alias("keep"))
    near = groups.join(keep, "root").where((F.col("n") > 1) | (F.col("first") != F.col("keep"))).select("h1", "h2", "keep")
    alone = texts.where("n > 1").join(roots, "id", "left_anti").select("h1", "h2", F.col("first").alias("keep"))
    told = near.union(alone)
    return seen.select("place", "h1", "h2").join(told, ["h1", "h2"]).select("place.*", "keep")


def _numbered(docs: DataFrame) -> DataFrame:
    return texts_of(docs).select(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("ord"), doc_key().alias("key"), F.coalesce("text", F.lit("")).alias("text"))


def _removed(docs: DataFrame, similarity: float) -> DataFrame:
    lines = line_classes(docs, similarity)
    gone = lines.where(F.struct("ord", "key", "line_no") != F.col("keep"))
    return gone.groupBy("ord", "key").agg(F.array_sort(F.collect_set("line_no")).alias("removed_lines"))


def repeated_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Per document: ``doc_id, n_lines, n_removed, removed_lines`` (line numbers from 0, in order).

    Of each group of near-equal lines (see ``line_classes``) only the first by doc_id and line
    stays. Blank lines always stay. Null text is one empty line. A null doc_id comes after all
    others; rows repeated with doc_id and text are one document and lose the same lines. An empty
    table gives no rows. Columns besides ``doc_id`` and ``text`` are ignored.
    """
    rows = _numbered(docs)
    narrow = rows.select("ord", "key", F.size(_split(F.col("text"))).alias("n_lines"))
    out = narrow.join(_removed(rows, similarity), ["ord", "key"], "left")
    none = F.array().cast("array<int>")
    removed = F.coalesce("removed_lines", none).alias("removed_lines")
    return out.select(F.nullif("ord", F.lit(2**63 - 1)).alias("doc_id"), "n_lines", F.size(removed).alias("n_removed"), removed)


def dedup_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents without the lines that ``repeated_lines`` names; other columns as they are."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row)
    own = own.select(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("ord"), doc_key().alias("key"), "text", "row")
    out = own.join(_removed(_numbered(docs), similarity), ["ord", "key"], "left")
    kept = F.filter(_split(F.col("text")), lambda line, i: ~F.array_contains(F.col("removed_lines"), i))
    text = F.when(F.col("removed_lines").isNull(), F.col("text")).otherwise(F.concat_ws("\n", kept))
    return out.withColumn("text", text).select(*(F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))
