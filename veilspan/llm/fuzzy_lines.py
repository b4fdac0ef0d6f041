"""Removes repeated lines, exact and fuzzy ones, with built-in expressions, joins and aggregates only.

Lines are normalised; equal ones meet by digest. A distinct line of ``MIN_WORDS`` words or more gets
SimHash blocks: its words in order of their hashes, and from each of some fixed points in that order
one SimHash of the next three words (every bit as in two of the three hashes). By the pigeonhole
principle a few edits leave some blocks as they are, so lines meet where they share a block, and
link if their words are alike by edit distance. Under a block of few lines all are compared with
each other; under others with a few lines first, and those that this leaves apart meet all others
there that have one of their rarest words, as alike lines must, so that no link between lines that
share a block is lost. A parity sign of the words tells most unlike lines apart before their texts
are looked up. Of each connected group of lines the first occurrence stays.

One SimHash of a whole line does not do: at an edit similarity of 0.8 or more its bits scatter so
far that two of four blocks of it agree for 29 % of the pairs only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let
from .common import cut, removed, stored
from .components import components

#: Bytes of a word that tells lines apart.
LONG_WORD = 5
#: Shorter lines are compared by digest only.
MIN_WORDS = 5
SIMILARITY = 0.8
LINE_BITS = 31
#: Blocks of a line, each of three words from a point of its own: blocks that share no words are seldom lost together.
BLOCKS = 6
#: Lines of so many words have blocks of two neighbours, the first ones, and more of them.
SHORT_LINE, SHORT_BLOCKS = 24, 8
#: Longest line that one of them can be alike.
ALIKE_SHORT = 30
BLOCK_BITS = 44
#: Lines are compared for so many edits first.
FIRST_EDITS = 3
#: So many lines that share a block are sent to where the texts of all lines are; more are joined by a shuffle.
SENT_LINES = 1 << 20
#: Under a block of so many lines each is compared with all others there.
FEW_LINES = 16
#: Times that the lines under a larger block which are unlike the first are compared with the next, before all the rest are.
ROUNDS = 3
#: Words are ordered by how often those with the same so many bits of the hash occur.
CLASS_BITS = 16
#: Numbers of 64 bits in which each word of a line turns over one bit.
SIGN = 4
#: Such numbers that every line brings along, of its long words.
PARITIES = 3
#: So many lines that share a block and a rare word are compared in one task; more are dealt out.
DEALT = 1 << 10
#: Keys that each line brings along, the smallest ones, so that a pair comes out under the first key it shares only.
FIRST_KEYS = 16

#: All but a blank alone, which is what comes in its place.
BETWEEN_WORDS = r"[^\p{L}\p{N}\n](?:(?<! )[^\p{L}\p{N}\n]*+|[^\p{L}\p{N}\n]++)"
BLANKS = r"[\s\p{Z}\p{C}]+"
#: Characters of scripts without spaces, each of which counts as a word.
UNSPACED = r"([\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}])"


def normalised(text: Column) -> Column:
    """Lower case, with all but letters, digits and line ends as single spaces."""
    return F.regexp_replace(F.lower(text), BETWEEN_WORDS, " ")


#: Where such characters are, among others; one range, as scripts take several times as long to look up.
ABOUT_UNSPACED = r"[\x{E00}-\x{3FFFF}]"


def _words(body: Column) -> Column:
    """Words, and characters of scripts without spaces."""
    apart = F.array_remove(F.split(F.regexp_replace(body, UNSPACED, " $1 "), " "), "")
    spaced = F.split(body, " ")
    return F.when(F.octet_length(body) == F.length(body), spaced).when(body.rlike(ABOUT_UNSPACED), apart).otherwise(spaced)


def line_table(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Every line that is not blank: its place, digests, body, number of words, SimHash blocks and parity sign.

    Blocks (``b0``, ...) and the numbers of the sign (``s0``, ...) have columns of their own, which
    an aggregate keeps in place; arrays would be sorted.

    A line without letters and digits is its own body, less its blanks. Words and blocks are
    worked out column by column, as what stands within a lambda is interpreted, sorting above all.
    """
    bodies = F.zip_with(
        F.split(normalised(F.col(text)), "\n"),
        F.split(F.col(text), "\n"),
        lambda line, raw: F.when(F.trim(line) != "", F.trim(line)).otherwise(F.regexp_replace(raw, BLANKS, "")),
    )
    # an outer one, as for others all is worked out once more in a filter on empty arrays
    rows = docs.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.posexplode_outer(bodies).alias("line_no", "body"))
    body = F.col("body")
    # not split where there is nothing to compare
    enough = (F.octet_length(body) >= 2 * MIN_WORDS - 1) | (F.octet_length(body) > F.length(body))
    words = F.when(enough, _words(body)).otherwise(F.array(body))
    ordered = rows.filter("body <> ''").select("key", "line_no", "body", _in_order(words).alias("h"))
    placed = ordered.select("key", "line_no", "body", "h", _places(F.col("h")).alias("places"))
    columns = ["key", "line_no", "body", "h"]
    worked_out = placed.select(
        *columns,
        _parities(F.col("h"), F.col("places")).alias("sign"),
        _threes(F.col("h"), _starts(F.col("places"))).alias("threes"),
    )
    blocks = [*_pairs_of_words(F.col("h")), *[F.get("threes", F.lit(i)) for i in range(BLOCKS)]]
    return worked_out.select(
        "key",
        "line_no",
        F.xxhash64("body").alias("h1"),
        F.xxhash64(F.lit(1), "body").alias("h2"),
        "body",
        F.size("h").alias("n"),
        *[b.alias(f"b{i}") for i, b in enumerate(blocks)],
        *[F.get("sign", F.lit(i)).alias(f"s{i}") for i in range(PARITIES)],
    )


def _in_order(words: Column) -> Column:
    """Numbers of words in the one order that blocks follow: long words first, each kind by hash.

    Short words stand next to each other in many lines.
    """
    low, high = F.lit((1 << 63) - 1), F.lit(-1 << 63)
    return F.sort_array(
        F.transform(
            words,
            lambda w: F.when(F.octet_length(w) >= LONG_WORD, F.xxhash64(w).bitwiseOR(high)).otherwise(
                F.xxhash64(w).bitwiseAND(low)
            ),
        )
    )


def simhash_blocks(words: Column) -> Column:
    """Keys of a line's word blocks; none for lines of fewer than ``MIN_WORDS`` words."""
    return let(
        _in_order(words),
        lambda h: F.array_compact(F.concat(F.array(*_pairs_of_words(h)), _threes(h, _starts(_places(h))))),
    )


def _places(h: Column) -> Column:
    """Of ordered numbers, the places from which on they are not below each of the fixed points, and of short words."""
    points = [-(1 << 63) + k * ((1 << 63) // BLOCKS) for k in range(1, BLOCKS)] + [0]
    among = F.sort_array(F.concat(h, F.array(*map(F.lit, points))))
    return F.array(*[(F.array_position(among, F.lit(point)) - k).cast("int") for k, point in enumerate(points, 1)])


def _starts(places: Column) -> Column:
    return F.array_distinct(F.concat(F.array(F.lit(0)), F.slice(places, 1, BLOCKS - 1)))


_BLOCK_MASK = (1 << BLOCK_BITS) - 1


def _pairs_of_words(h: Column) -> list[Column]:
    """Keys of the blocks of two neighbours, null where there are none."""
    n = F.size(h)
    own = n.between(MIN_WORDS, ALIKE_SHORT)
    keys = [F.xxhash64(F.get(h, F.lit(i)), F.get(h, F.lit(i + 1))).bitwiseAND(F.lit(_BLOCK_MASK)) for i in range(SHORT_BLOCKS)]
    return [F.when(own & (n > i + 1), key) for i, key in enumerate(keys)]


def _threes(h: Column, starts: Column) -> Column:
    """Keys of the blocks of three words."""

    def three(i: Column) -> Column:
        a, b, c = (h[(i + j) % F.size(h)] for j in range(3))
        # of a word that occurs twice, two would be all that counts
        most = a.bitwiseAND(b).bitwiseOR(a.bitwiseOR(b).bitwiseAND(c))
        return F.when((a == b) | (b == c), F.xxhash64(a, b, c)).otherwise(most).bitwiseAND(F.lit(_BLOCK_MASK))

    none = F.array().cast("array<bigint>")
    return F.when(F.size(h) > SHORT_LINE, F.transform(starts, three)).otherwise(none)


def _parities(h: Column, places: Column) -> Column:
    """``PARITIES`` numbers in which every long word turns over a bit: an edit changes two bits at most.

    A word's number tells in which of them, as it lies between the same fixed points in all lines.
    """
    bounds = [F.lit(0), *[F.get(places, F.lit(BLOCKS * k // PARITIES - 1)) for k in range(1, PARITIES + 1)]]

    def turned(bits: Column, x: Column) -> Column:
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63).cast("long")).cast("int"))
        return bits.bitwiseXOR(bit)

    own = [F.slice(h, lo + 1, hi - lo) for lo, hi in zip(bounds, bounds[1:])]
    return F.array(*[F.aggregate(numbers, F.lit(0).cast("long"), turned) for numbers in own])


def _place(key: Column, line_no: Column) -> Column:
    """One number that orders occurrences by key, then line."""
    return key.cast("decimal(19,0)") * F.lit(1 << LINE_BITS).cast("decimal(10,0)") + line_no


#: Symbols of words lie outside the basic plane: those of five hexadecimal digits.
FIRST_SYMBOL, SYMBOLS = 0x10000, 0xF0000
#: More than there are codes, and places of words in two lines.
CODES = 1 << 20


def _code(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(SYMBOLS))


def _codes(body: Column) -> Column:
    """A number below ``SYMBOLS`` for each word."""
    return F.transform(_words(body), lambda w: _code(w).cast("int"))


def _symbols(codes: Column) -> Column:
    """A string with one character per code."""
    units = F.transform(codes, lambda c: F.hex(c + FIRST_SYMBOL))
    return F.decode(F.unhex(F.concat(F.lit("000"), F.array_join(units, "000"))), "UTF-32")


def _most(longest: Column) -> Column:
    """Edits that lines may differ by."""
    return F.floor(longest * F.lit(round(1 - SIMILARITY, 6)) + F.lit(1e-9)).cast("int")


def _near(a: Column, b: Column) -> Column:
    most = _most(F.greatest(F.length(a), F.length(b)))
    within = lambda edits: F.call_function("levenshtein", a, b, edits) >= 0
    # the time is that of the edits allowed, and most alike lines differ by a few
    return (F.abs(F.length(a) - F.length(b)) <= most) & (within(F.least(most, F.lit(FIRST_EDITS))) | within(most))


def _alike(x: str, y: str) -> Column:
    """Whether the words of lines ``x`` and ``y`` (symbols, codes, body) are alike.

    Two words with one symbol can only make lines look more alike; where the lines hold such
    words, symbols are given out anew, by the words' places among those of the two lines.
    """

    def exact(w: Column) -> Column:
        def anew(known: Column) -> Column:
            own = [_symbols(F.transform(w[s], lambda v: F.array_position(known, v) % 0xF0000)) for s in ("a", "b")]
            return (F.size(F.array_union(f"{x}.codes", f"{y}.codes")) == F.size(known)) | _near(*own)

        return let(F.array_union(w["a"], w["b"]), anew)

    words = F.struct(_words(F.col(f"{x}.body")).alias("a"), _words(F.col(f"{y}.body")).alias("b"))
    return F.when(_near(F.col(f"{x}.symbols"), F.col(f"{y}.symbols")), let(words, exact)).otherwise(F.lit(False))


def _bodies(ids: DataFrame, distinct: DataFrame, lines: DataFrame) -> DataFrame:
    """``id`` and ``body`` of the lines in ``ids``."""
    used = cut(ids.select("id").distinct().join(distinct.select("id", "h1", "h2"), "id"))
    used = F.broadcast(used) if used.count() <= SENT_LINES else used
    met = lines.select("h1", "h2", "body").join(used, ["h1", "h2"])
    return met.groupBy("id").agg(F.first("body").alias("body"))


def _verified(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """The alike ones of distinct pairs ``a``, ``b``."""
    pairs = cut(pairs)
    ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    ids = F.broadcast(ids) if ids.count() <= SENT_LINES else ids
    known = bodies.join(ids, "id", "left_semi").select("id", "body", "codes", _symbols(F.col("codes")).alias("symbols"))
    known = known.repartition("id")
    x, y = known.alias("x"), known.alias("y")
    met = pairs.join(x, F.col("x.id") == F.col("a")).join(y, F.col("y.id") == F.col("b"))
    return cut(met.filter(_alike("x", "y")).select("a", "b"))


def _ends(keyed: DataFrame) -> DataFrame:
    """``keyed`` (block, id, n) with the smallest and the largest id under the block, their lengths, and the lines' number.

    Blocks of one line are left out.
    """
    dealt = keyed.repartition("block")
    # numbers only, which are summed up in place; structs would be sorted
    ends = dealt.groupBy("block").agg(
        F.min("id").alias("first"), F.min_by("n", "id").alias("first_n"),
        F.max("id").alias("last"), F.max_by("n", "id").alias("last_n"), F.count("*").alias("k"),
    ).filter("first < last")
    return dealt.join(ends.hint("shuffle_hash"), "block")


def _members(distinct: DataFrame) -> DataFrame:
    """Lines that share a block with another: ``block``, ``id``, ``n``, and the rest as in ``_ends``."""
    keyed = distinct.select("id", "n", F.explode_outer("blocks").alias("block")).filter("block IS NOT NULL")
    return stored(_ends(keyed), "line-blocks")


def candidate_pairs(members: DataFrame) -> DataFrame:
    """Each line under a block with the smallest and the largest id there: distinct ``a`` > ``b``.

    Pairs whose lengths differ too much are left out.
    """
    ends = F.array(
        F.struct(F.col("first").alias("other"), F.col("first_n").alias("m")),
        F.struct(F.col("last").alias("other"), F.col("last_n").alias("m")),
    )
    fits = lambda e: (e["other"] != F.col("id")) & (F.abs(e["m"] - F.col("n")) <= _most(F.greatest(e["m"], "n")))
    pairs = members.select("id", F.inline(F.filter(ends, fits)))
    return pairs.select(F.greatest("id", "other").alias("a"), F.least("id", "other").alias("b")).distinct()


def _marks(distinct: DataFrame, lines: DataFrame) -> DataFrame:
    """``id``, ``n`` and the numbers of the sign, ``s0``, ..., of lines."""
    if "s0" in distinct.columns:
        return distinct.select("id", "n", *[f"s{i}" for i in range(PARITIES)])
    ordered = _bodies(distinct, distinct, lines).select("id", _in_order(_words(F.col("body"))).alias("h"))
    signs = ordered.select("id", F.size("h").alias("n"), _parities(F.col("h"), _places(F.col("h"))).alias("sign"))
    return signs.select("id", "n", *[F.get("sign", F.lit(i)).alias(f"s{i}") for i in range(PARITIES)])


def _can_be_alike(x: str, y: str) -> Column:
    """Whether neither the lengths nor the signs of ``x`` and ``y`` differ by more than alike lines' do."""
    most = _most(F.greatest(f"{x}.n", f"{y}.n"))
    bits = [F.bit_count(F.col(f"{x}.s{i}").bitwiseXOR(F.col(f"{y}.s{i}"))) for i in range(PARITIES)]
    return (F.abs(F.col(f"{x}.n") - F.col(f"{y}.n")) <= most) & (sum(bits[1:], bits[0]) <= 2 * most)


def _few_pairs(members: DataFrame, marks: DataFrame) -> DataFrame:
    """All pairs ``a`` > ``b`` of lines that share a block and can be alike, of blocks of few lines."""
    dealt = members.select("block", "id").join(marks, "id").repartition("block")
    fits = (F.col("x.block") == F.col("y.block")) & (F.col("x.id") > F.col("y.id")) & _can_be_alike("x", "y")
    met = dealt.alias("x").join(dealt.alias("y"), fits)
    return met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def _fitting(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """Those of the pairs that can be alike by their signs."""
    met = pairs.join(marks.alias("x"), F.col("x.id") == F.col("a")).join(marks.alias("y"), F.col("y.id") == F.col("b"))
    return met.filter(_can_be_alike("x", "y")).select("a", "b")


def _not_done(members: DataFrame, links: DataFrame) -> DataFrame:
    """Lines under a block that are alike neither the first nor the last: ``block``, ``id`` and ``n``."""
    inner = members.filter("id <> first AND id <> last")
    alike = links.select("a", "b")
    return (
        inner.join(alike.toDF("id", "first"), ["id", "first"], "left_anti")
        .join(alike.toDF("last", "id"), ["id", "last"], "left_anti")
        .select("block", "id", "n")
    )


def _across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Those of the pairs ``a``, ``b`` whose components differ."""
    own = [labels.select(F.col("id").alias(end), F.col("component").alias(f"of_{end}")) for end in ("a", "b")]
    met = pairs.join(own[0], "a", "left").join(own[1], "b", "left")
    return met.filter(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")


def _apart(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Lines under blocks whose lines are not all connected: ``block``, ``id``, ``n``, ``component``.

    Up to three lines under a block have all been compared.
    """
    labelled = members.select("block", "id", "n").join(labels, "id", "left")
    dealt = labelled.withColumn("component", F.coalesce("component", "id")).repartition("block")
    sides = dealt.groupBy("block").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("k"))
    sides = sides.filter("lo < hi AND k > 3").select("block")
    return cut(dealt.join(sides.hint("shuffle_hash"), "block"))


def _coded(bodies: DataFrame) -> DataFrame:
    """``id`` and ``codes``: alike lines have alike codes, so that nothing is lost by comparing these first."""
    return bodies.select("id", "codes" if "codes" in bodies.columns else _codes(F.col("body")).alias("codes"))


def _word_classes(coded: DataFrame) -> bytes:
    """A byte below 128 for the last ``CLASS_BITS`` bits of a word's code, the larger the more often they occur."""
    low = F.transform("codes", lambda c: c.bitwiseAND(F.lit((1 << CLASS_BITS) - 1)))
    classes = bytearray(1 << CLASS_BITS)
    for r in coded.select(F.explode_outer(low).alias("low")).filter("low IS NOT NULL").groupBy("low").count().toLocalIterator():
        classes[r["low"]] = min(127, 1 + int(4 * math.log2(r["count"])))
    return bytes(classes)


def _rarest(codes: Column, classes: bytes) -> Column:
    """One word more than may differ, the rarest first: lines that are alike have one of them in common.

    By the prefix principle: of lines of n and of up to n words, at least n less the edits are the same.
    """

    def number(c: Column) -> Column:
        at = c.bitwiseAND(F.lit((1 << CLASS_BITS) - 1)) + 1
        of = F.ascii(F.substring(F.lit(bytearray(classes)), at, F.lit(1)).cast("string"))
        return of * CODES + c

    ordered = F.sort_array(F.transform(codes, number))
    return F.array_distinct(F.slice(ordered, 1, _most(F.size(codes)) + 1))


def _sign(codes: Column) -> Column:
    """``SIGN`` numbers in which every word turns over a bit: an edit changes two bits at most."""

    def of(number: int) -> Column:
        def turned(bits: Column, c: Column) -> Column:
            bit = F.call_function("shiftleft", F.lit(1).cast("long"), c.bitwiseAND(F.lit(63)))
            own = F.shiftright(c, 6).bitwiseAND(F.lit(SIGN - 1)) == number
            return F.when(own, bits.bitwiseXOR(bit)).otherwise(bits)

        return F.aggregate(codes, F.lit(0).cast("long"), turned)

    return F.array(*[of(i) for i in range(SIGN)])


def _shared_keys(apart: DataFrame, coded: DataFrame, classes: bytes) -> DataFrame:
    """``id``, its component and ``at``: the keys (of a block and a rare word), with parts, that other components have."""
    own = coded.select("id", _rarest(F.col("codes"), classes).alias("rarest"))
    keyed = apart.join(own, "id").select("block", "id", "component", F.explode_outer("rarest").alias("w"))
    dealt = keyed.select(F.hash("block", "w").alias("key"), "id", "component").repartition("key")
    # all three columns, so that one exchange serves both sides of the join
    sides = dealt.groupBy("key").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"),
        F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("k"),
    ).filter("lo < hi AND first < last")
    sides = sides.select("key", F.expr(f"CAST(k div {DEALT} AS int)").alias("parts"))
    met = dealt.join(sides.hint("shuffle_hash"), "key")
    return met.groupBy("id").agg(F.first("component").alias("component"), F.collect_set(F.struct("key", "parts")).alias("at"))


def _pairs_met(apart: DataFrame, bodies: DataFrame) -> DataFrame:
    """Pairs as in ``_pairs_apart``, of which few come out more than once.

    A pair comes out where both lines have the smallest key they share; only those that share none
    of the first ``FIRST_KEYS`` of both come out under each key.
    """
    coded = _coded(bodies)
    shared = cut(_shared_keys(apart, coded, _word_classes(coded)))
    marked = coded.select("id", F.size("codes").alias("n"), _sign(F.col("codes")).alias("sign"))
    keys = F.slice(F.sort_array(F.col("at.key")), 1, FIRST_KEYS)
    met = cut(shared.join(marked, "id").select("id", "component", "n", "sign", keys.alias("keys"), "at"))
    each = met.select("id", "component", "n", "sign", "keys", F.inline("at"))
    one = each.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts") + 1).cast("int")).drop("parts").alias("x")
    other = each.withColumn("part", F.explode(F.sequence(F.lit(0), "parts"))).drop("parts").alias("y")
    most = _most(F.greatest("x.n", "y.n"))
    bits = [F.bit_count(F.col("x.sign")[i].bitwiseXOR(F.col("y.sign")[i])) for i in range(SIGN)]
    same = (F.col("x.key") == F.col("y.key")) & (F.col("x.part") == F.col("y.part"))
    other_line = (F.col("x.id") > F.col("y.id")) & (F.col("x.component") != F.col("y.component"))
    fits = (F.abs(F.col("x.n") - F.col("y.n")) <= most) & (sum(bits[1:], bits[0]) <= 2 * most)
    here = F.coalesce(F.array_min(F.array_intersect("x.keys", "y.keys")), F.col("x.key")) == F.col("x.key")
    return one.join(other, same & other_line & fits & here).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def _pairs_apart(apart: DataFrame, bodies: DataFrame) -> DataFrame:
    """All pairs ``a`` > ``b`` of lines of different components that share a block and can be alike."""
    return cut(_pairs_met(apart, bodies).distinct())


def fuzzy_links(distinct: DataFrame, lines: DataFrame) -> DataFrame:
    """Links (``a`` > ``b``) that connect all alike lines that share a block.

    Under a block of up to ``FEW_LINES``, each is compared with all others, by signs; then by words
    with the smallest that it can be alike, and with others where that leaves the two unconnected.
    Under a larger one, all
    are compared with the smallest and the largest id; those alike one of them are done for then.
    The others are compared likewise among themselves, ``ROUNDS`` times in all, so that large
    groups of alike lines cost a few comparisons for each. Of the lines under such a block that are
    not connected by then, each is compared with all others there that can be alike: that share one
    of its rarest words and of whose words not too many differ.
    """
    members = _members(distinct)
    marks = _marks(distinct, lines)
    few, large = members.filter(F.col("k") <= FEW_LINES), members.filter(F.col("k") > FEW_LINES)
    # all that is looked up again of lines under large blocks
    ids = cut(large.select("id").distinct())
    marked = cut(marks.join(ids, "id"))
    near, ends = cut(_few_pairs(few, marks)), cut(_fitting(candidate_pairs(large), marked))
    used = ids.unionByName(near.unionByName(ends).select(F.explode(F.array("a", "b")).alias("id")))
    bodies = _bodies(used, distinct, lines).select("id", "body", _codes(F.col("body")).alias("codes"))
    bodies = stored(bodies, "line-bodies")
    links = _verified(near.groupBy("a").agg(F.min("b").alias("b")).unionByName(ends).distinct(), bodies)
    rest = large
    for _ in range(1, ROUNDS):
        rest = cut(_ends(_not_done(rest, links)))
        pairs = candidate_pairs(rest).join(links, ["a", "b"], "left_anti")
        links = links.unionByName(_verified(_fitting(pairs, marked), bodies))
    labels = components(links, "a", "b")
    apart, left = _apart(large, labels), _across(near, labels)
    if not apart.isEmpty():
        left = left.unionByName(_pairs_apart(apart, bodies.join(ids, "id", "left_semi"))).distinct()
    links = links.unionByName(_verified(left, bodies))
    removed(members)
    removed(bodies)
    return links


def _distinct_lines(lines: DataFrame) -> DataFrame:
    place = _place(F.col("key"), F.col("line_no"))
    blocks, sign = [f"b{i}" for i in range(SHORT_BLOCKS + BLOCKS)], [f"s{i}" for i in range(PARITIES)]
    distinct = lines.groupBy("h1", "h2").agg(
        F.min(place).alias("place"), F.count("*").alias("times"), *[F.max(c).alias(c) for c in ["n", *blocks, *sign]]
    )
    rows = distinct.select("h1", "h2", "place", "times", "n", F.array_compact(F.array(*blocks)).alias("blocks"), *sign)
    return stored(rows.withColumn("id", F.monotonically_increasing_id()), "distinct-lines")


def _first_of_groups(distinct: DataFrame, lines: DataFrame) -> DataFrame:
    """``h1``, ``h2`` and the place that stays, ``kept``, of all lines that occur again."""
    found = components(fuzzy_links(distinct, lines), "a", "b")
    groups = found.unionByName(found.select(F.col("component").alias("id"), "component").distinct())
    grouped = cut(groups.join(distinct.select("id", "place"), "id"))
    kept = grouped.groupBy("component").agg(F.min("place").alias("kept"))
    kept = grouped.select("id", "component").join(kept, "component").select("id", "kept")
    again = distinct.join(kept, "id", "left").filter("times > 1 OR kept < place")
    return cut(again.select("h1", "h2", F.coalesce("kept", "place").alias("kept")))


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``removed`` (line numbers from 0, in order) of the documents that lose lines."""
    lines = stored(line_table(docs, key, text), "lines")
    distinct = _distinct_lines(lines)
    stays = _first_of_groups(distinct, lines)
    place = _place(F.col("key"), F.col("line_no"))
    again = lines.select("key", "line_no", "h1", "h2").join(stays, ["h1", "h2"]).filter(place != F.col("kept"))
    gone = cut(again.groupBy(F.col("key").alias(key)).agg(F.array_sort(F.collect_set("line_no")).alias("removed")))
    # the result needs neither; they would take disk while all texts are shuffled
    removed(lines)
    removed(distinct)
    return gone


def _with_removed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``docs`` with columns c0, c1, ... and ``removed``, the numbers of the lines that go; null if none do."""
    named = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    # the side with the numbers is the small one; texts need no sorting
    spare = repeated_lines(docs.select(key, text), key, text).select(F.col(key).alias("k"), "removed")
    return named.join(spare.hint("shuffle_hash"), F.col(f"c{docs.columns.index(key)}") == F.col("k"), "left")


def _rest(text: str) -> Column:
    """The text without the lines in ``removed``."""

    def without(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "removed")
        return F.array_join(F.transform(kept, lambda i: lines[i]), "\n")

    return F.when(F.col("removed").isNull(), F.col(text)).otherwise(let(F.split(text, "\n"), without))


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text``; all rows and columns stay.

    The occurrence that stays is the first by key and line number. Keys are whole numbers; rows
    that repeat a key are one document and lose the same lines, rows without a key and null or
    empty texts are left as they are, as are blank lines. Lines of fewer than ``MIN_WORDS`` words
    go as exact repeats only. An empty table gives an empty one. Columns may have any names.
    """
    place = docs.columns.index(text)
    columns = [_rest(f"c{i}") if i == place else F.col(f"c{i}") for i in range(len(docs.columns))]
    return _with_removed(docs, key, text).select(*[c.alias(name) for c, name in zip(columns, docs.columns, strict=True)])


def deduplicated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_lines, n_kept and the remaining ``text`` of every row; see ``without_repeats``.

    A null text has no lines; an empty one has one.
    """
    rows = _with_removed(docs.select(key, text), key, text)
    n_lines = F.when(F.col("c1").isNull(), 0).otherwise(F.size(F.split("c1", "\n"))).cast("long")
    gone = F.coalesce(F.array_size("removed"), F.lit(0))
    return rows.select(
        F.col("c0").alias(key), n_lines.alias("n_lines"), (n_lines - gone).alias("n_kept"), _rest("c1").alias(text)
    )
