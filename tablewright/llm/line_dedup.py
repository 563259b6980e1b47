"""Fuzzy line dedup in DataFrame functions only.

Lines are normalised (lower case, white space collapsed and trimmed) and known
by a 128-bit hash. A line's SimHash has blocks, and each block is voted on by
its own share of the line's words: of the distinct words of four letters and more
(all words, where there are fewer than three of these) the 32 with the least
hashes vote. They fall into classes by the highest bits of a second hash, and the 42 bits of a
block are the majority of the second hashes of the words in its class. So an edit reaches only the blocks of the words that it changes, and
by the pigeonhole principle lines that differ in fewer words than there are
blocks agree in a whole block. There are one, two, four or eight blocks, with the
number of voters; a line near the next number has both sets of blocks,
so that it meets shorter and longer neighbours. Lines that agree in a block are
joined on it; those whose edit similarity (1 - Levenshtein distance / length of
the longer) is at least the threshold are linked; of each connected group the
earliest occurrence, by key and line number, stays. Lines of up to 512
characters are compared by characters, longer ones by words, as the time that
characters take grows with the square of the length.

Few words tell little of a short line, so lines of up to SHORT characters have blocks of characters as well. If all edits between two lines lie
in one window, what is before and after it makes up the similarity, 4 / 5 of the longer line, and so one of three splits of two units fits on
both sides of it, a unit being 4 / 15 of the shorter line at most: no unit, one or both from the start of the line, and the rest from its end. Units
are taken from a ladder whose steps are as wide as the lengths of similar lines can differ; a line uses the step that
fits and the one below.

One SimHash over a whole line would not do: words that make up a fifth of a line
turn 13 of its 64 bits, and blocks that survive this are too short to keep
unlike lines apart. The recall of the blocks is measured in the tests against
all pairs of lines by edit similarity alone.

Links are sought in three rounds. First, of the lines with one block, each is
verified against the least of them (two lines: against each other); then only
lines of such a block whose groups are still apart are: all of them in a block of
up to 32 lines, in a larger one each against the least line of the first and of
the last other group. So a large group of near copies costs a few verifications a
line and block. Last, in larger blocks whose groups are apart even then, the lines
outside a block's largest group are verified against all lines of other groups whose
lengths fit, so that the groups are those that all pairs of each block have. Parts of
such a block are dealt to tasks and lines are compared where they meet: no
table of pairs is made, and lines that meet in several blocks are compared in one of
them. A large group costs as many comparisons as it has lines for each line outside it; between the lines
outside, comparisons (not rows) grow with the square of their number.

``block_words`` is the least number of words of a block that is joined on: a
word of four letters or more tells some 100 lines apart, so a table of 100 times
the lines asks for one word more if unlike lines are to meet as rarely.

Normalised lines are written once and read by column; they are never shuffled as a whole.
Texts are fetched for candidates only: a bit table of 65,536 rows, however large
the input, filters lines before the exact join. In the same way only texts that
may lose a line are shuffled.

Defined cases: a null text counts as empty; lines without a word are neither
compared nor removed; a very long line is hashed and compared whole, by its words;
rows that repeat both key and text count as one text and stay alike; a null key
is a key, the first; an emptied text is the empty text; an empty table gives an
empty result; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c
from .components import connected

#: Characters of lines that have blocks of characters: enough for one edit, up to where the words of a line vote in several blocks.
SHORT = (5, 110)
#: Characters of a unit: each step is at least 1.25 times the one before, and the first two are for the shortest lines.
LADDER = (1, 2, 3, 4, 5, 7, 9, 12, 15, 19, 24, 30)
#: Letters of a word that votes, words of a block, about, and voters of a line at most.
WORD_CHARS, BLOCK, VOTERS = 4, 4, 32
#: A line with so many words more would have the next number of blocks: it has both.
OVERLAP = 1.15
#: Votes of up to so many words are counted in lanes of four bits, 14 to a long; those of more in lanes of a byte.
LANES, MOST_WORDS = sum(1 << 4 * k for k in range(14)), 15
#: Votes of up to so many words are added one by one.
FEW_WORDS = 8
#: One in each byte of a long, and in each but the highest.
ONES, BYTES = sum(1 << 8 * k for k in range(8)), sum(1 << 8 * k for k in range(7))
#: Lines of a block up to which all are compared in the second round.
BLOCK_LINES = 32
#: Lines outside the largest group of a block, and lines of the block, that a task compares at a time in the last round.
OUTSIDE, INSIDE = 64, 256
#: Edit distances that are tried before the one that the threshold allows.
BANDS = (10, 30)
#: Characters beyond which edits are counted in words.
LONG_LINE = 512
#: First and number of the signs that stand for words (one unit of UTF-16 each).
SIGNS = (0x4E00, 20000)


def _rough(text: Column) -> Column:
    """Whether the text has white space beside single spaces and line ends."""
    return F.contains(text, F.lit("  ")) | F.contains(text, F.lit("\t")) | F.contains(text, F.lit("\r")) | F.contains(text, F.lit("\x0b")) | F.contains(text, F.lit("\f"))


def _lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id, version (a hash of the text), line_no, line (normalised), h1, h2 for every line with a word."""
    texts = c.id_texts(docs, key, text).select("doc_id", F.xxhash64("text").alias("version"), _rough(F.col("text")).alias("rough"), F.lower("text").alias("low"))
    lines = texts.select("doc_id", "version", "rough", F.posexplode(F.split("low", "\n")).alias("line_no", "raw"))
    line = F.trim(F.when(F.col("rough"), F.regexp_replace("raw", r"[\x20\t\r\x0b\f]+", " ")).otherwise(F.col("raw")))
    named = lines.select("doc_id", "version", "line_no", line.alias("line")).filter("line <> ''")
    return named.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), "line")})


def _blocks_of(words: str) -> Column:
    """The number of blocks of a line with so many voters."""
    return F.expr(f"case when {words} <= {BLOCK} then 1 when {words} <= {2 * BLOCK} then 2 when {words} <= {4 * BLOCK} then 4 else 8 end")


def block_keys(lines: DataFrame, block_words: int) -> DataFrame:
    """key (a block of a SimHash), h1, size (characters) of every line and each of its blocks; copies of a line repeat them."""
    # Arrays of words are not carried from one projection to the next, as each of them would write them again.
    long = F.filter(F.split("line", " "), lambda w: F.length(w) >= WORD_CHARS)
    known = lines.select("h1", "line", F.length("line").alias("size"), F.transform(long, lambda w: F.xxhash64(w)).alias("long"))
    hashes = F.array_distinct(F.when(F.size("long") < 3, F.transform(F.split("line", " "), lambda w: F.xxhash64(w))).otherwise(F.col("long")))
    shaped = known.select("h1", "size", hashes.alias("hashes"))
    voters = F.when(F.size("hashes") > VOTERS, F.slice(F.sort_array("hashes"), 1, VOTERS)).otherwise(F.col("hashes"))
    # Votes are sorted, and the highest three bits are the class: so the votes of a class, or of neighbouring ones, are a slice.
    shaped = shaped.select("h1", "size", F.sort_array(F.transform(voters, lambda x: F.xxhash64(x))).alias("sorted")).withColumn("m", F.size("sorted"))
    # Byte k has the number of votes in the classes up to k.
    upto = F.aggregate("sorted", F.lit(0).cast("long"), lambda s, v: s + F.call_function("shiftleft", F.lit(ONES), (8 * (F.shiftright(v, 61) + 4)).cast("int")))
    # Block k of n is known as n + k; the blocks of n and of 2 n together are those from n to 4 n - 1.
    # (No sequence is empty; explode() would add a filter that says so, and with it compute the votes again.)
    first, last = _blocks_of("m"), 2 * _blocks_of(f"cast(m * {OVERLAP} as int)") - 1
    each = shaped.withColumn("upto", upto).select("h1", "size", "sorted", "upto", F.explode_outer(F.sequence(first, last)).alias("block"))
    each = each.withColumn("n", F.expr("case when block < 2 then 1 when block < 4 then 2 when block < 8 then 4 else 8 end"))

    def before(k: str) -> Column:
        """The votes in the blocks before the one of that place."""
        return F.expr(f"case when {k} = 0 then 0 else cast(shiftrightunsigned(upto, 8 * {k} * cast(8 div n as int) - 8) & 255 as int) end")

    each = each.withColumns({"start": before("(block - n)"), "votes_n": before("(block - n + 1)") - before("(block - n)")})
    each = each.filter((F.col("votes_n") >= block_words) | (F.col("block") == 1))

    # The votes of a few words are added one by one: the function of a lambda is not compiled.
    def lanes(k: int, ones: int, most: int) -> Column:
        vote = lambda i: F.when(F.col("votes_n") > i, F.shiftrightunsigned(F.get("sorted", F.col("start") + i), k).bitwiseAND(F.lit(ones)))
        return sum((F.coalesce(vote(i), F.lit(0).cast("long")) for i in range(1, most)), F.coalesce(vote(0), F.lit(0).cast("long")))

    def summed(k: int, ones: int) -> Column:
        return F.aggregate(F.slice("sorted", F.col("start") + 1, F.col("votes_n")), F.lit(0).cast("long"), lambda s, v: s + F.shiftrightunsigned(v, k).bitwiseAND(F.lit(ones)))

    # A lane has more than half of n votes if adding 7 - n div 2 (in a byte: 127 - n div 2) sets its highest bit.
    bits = lambda lane: [(lane(k) + F.expr("7 - votes_n div 2") * F.lit(LANES)).bitwiseAND(F.lit(8 * LANES)) for k in range(3)]
    more = [(summed(k, BYTES) + F.expr("127 - votes_n div 2") * F.lit(BYTES)).bitwiseAND(F.lit(128 * BYTES)) for k in range(6)]
    few = F.when(F.col("votes_n") <= FEW_WORDS, F.xxhash64("block", *bits(lambda k: lanes(k, LANES, FEW_WORDS))))
    key = few.when(F.col("votes_n") <= MOST_WORDS, F.xxhash64("block", *bits(lambda k: summed(k, LANES)))).otherwise(F.xxhash64("block", *more))
    return each.select(key.alias("key"), "h1", "size")


def character_keys(lines: DataFrame) -> DataFrame:
    """key (of characters at both ends of a line), h1, size of every short line and each of its blocks."""
    short = lines.select("h1", "line", F.length("line").alias("size")).filter(F.col("size").between(*SHORT))
    fits = F.floor(F.col("size") * 4 / 15 + 1e-9)
    step = lambda below: F.coalesce(*[F.when(fits >= u, LADDER[max(k - below, 0)]) for k, u in reversed(list(enumerate(LADDER)))], F.lit(LADDER[0]))
    units = short.withColumns({"u": F.explode(F.array_distinct(F.array(step(0), step(1))))})
    ends = [F.xxhash64(F.lit(1000 + i), "u", F.expr(f"left(line, {i} * u)"), F.expr(f"right(line, {2 - i} * u)")) for i in range(3)]
    return units.select(F.explode(F.array(*ends)).alias("key"), "h1", "size")


def _signs(line: str) -> Column:
    """One sign for each word of a line."""
    code = F.transform(F.split(line, " "), lambda w: F.hex(F.lit(SIGNS[0]) + F.pmod(F.xxhash64(w), F.lit(SIGNS[1]))))
    return F.decode(F.unhex(F.array_join(code, "")), "UTF-16BE")


def _line_texts(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """h1, h2, line, words (their number), signs (one for each word), widest (letters of the longest word) of the lines with the wanted h1; short lines have no signs."""
    some = c.likely(lines.select("h1", "h2", "line"), "h1", wanted, "h1").distinct()  # before the join, so that a line with many copies is one row there
    return some.join(wanted, "h1", "left_semi").select("h1", "h2", "line", (F.length("line") - F.length(F.translate("line", " ", "")) + 1).alias("words"), *[F.when(F.length("line") > SHORT[1], x).alias(n) for n, x in (("signs", _signs("line")), ("widest", F.array_max(F.transform(F.split("line", " "), F.length))))])


def _side(texts: DataFrame, n: str) -> list[Column]:
    """What _near() needs of one line of a pair."""
    return [F.struct("h1", "h2").alias(f"{n}_id"), *[F.col(t).alias(f"{n}_{t}") for t in ("line", "words", "signs", "widest")]]


def _near(threshold: float) -> Column:
    """Whether the lines a and b, of different texts, have the edit similarity."""
    size = F.greatest(F.length("a_line"), F.length("b_line"))
    # levenshtein(x, y, k) is -1 beyond k and takes time in proportion to k: most pairs pass within a narrow band already.
    most = F.floor((1 - threshold) * size + 1e-9).cast("int")

    def within(x: Column, y: Column, bands: tuple[int, ...], most: Column) -> Column:
        found = [F.call_function("levenshtein", x, y, F.least(most, F.lit(band))) >= 0 for band in bands] + [F.call_function("levenshtein", x, y, most) >= 0]
        for more in found[1:]:
            found[0] = found[0] | more
        return found[0]

    # A short line that meets a long one gets its signs here, if the numbers of words fit.
    x, y = (F.coalesce(f"{n}_signs", _signs(f"{n}_line")) for n in "ab")
    most_words = F.floor((1 - threshold) * F.greatest("a_words", "b_words") + 1e-9).cast("int")
    words = (F.abs(F.col("a_words") - F.col("b_words")) <= most_words) & within(x, y, BANDS[:1], most_words)
    # So many words changed, added or taken away are so many times the longest word at most, in characters.
    few = F.call_function("levenshtein", F.col("a_signs"), F.col("b_signs"), F.floor(most / (F.greatest("a_widest", "b_widest") + 1)).cast("int")) >= 0
    chars = (F.abs(F.length("a_line") - F.length("b_line")) <= most) & (F.coalesce(few, F.lit(False)) | within(F.col("a_line"), F.col("b_line"), BANDS, most))
    return (F.col("a_id") != F.col("b_id")) & F.when(size > LONG_LINE, words).otherwise(chars)


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b: structs of h1, h2) of those given (a, b: h1) whose lines have the edit similarity."""
    x, y = (texts.select(F.col("h1").alias(n), *_side(texts, n)) for n in ("a", "b"))
    return pairs.join(x, "a").join(y, "b").filter(_near(threshold)).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))


def groups(lines: DataFrame, threshold: float, block_words: int) -> DataFrame:
    """node, component (structs of h1, h2) of the lines that are linked to others."""
    scratch: list[c.Stored] = []

    def stored(df: DataFrame, label: str, plain: bool = False) -> DataFrame:
        scratch.append(c.Stored(df, label, plain))
        return scratch[-1].df

    def done(result: DataFrame) -> DataFrame:
        for x in scratch:
            x.drop()
        return result

    keyed = stored(block_keys(lines, block_words).unionAll(character_keys(lines)), "blocks", plain=True)
    # Two lines at least; copies of a line are combined in the tasks, and only for the keys that lines share.
    shared = stored(keyed.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).filter("a < b"), "shared")
    alike = stored(c.likely(keyed, "key", shared, "key").distinct().join(shared.select("key"), "key"), "alike")
    ends = alike.groupBy("key").agg(F.count("*").alias("n"), F.min("h1").alias("a"), F.max("h1").alias("b"), F.min("size").alias("low"), F.max("size").alias("high"))
    ends = stored(ends, "sizes")
    two = ends.filter((F.col("n") == 2) & _fit("low", "high", threshold)).select("a", "b")
    many = ends.filter("n > 2").select("key", "n", F.col("a").alias("least"))
    members = stored(alike.join(many, "key").select("key", "n", "least", "h1", "size"), "members")
    star = members.filter("h1 <> least").select(F.col("least").alias("a"), F.col("h1").alias("b"))
    start = stored(two.unionAll(star).distinct(), "pairs")
    wanted = start.select(F.col("a").alias("h1")).unionAll(start.select("b")).distinct()
    texts = stored(_line_texts(lines, wanted), "line_texts")
    links = stored(_verified(start, texts, threshold), "links")
    once = connected(links)
    # Second round: the lines of one block that are not in one group yet.
    left = stored(_apart(members, once), "open")
    if left.isEmpty():
        return done(once)
    few = left.filter(F.col("n") <= BLOCK_LINES).select("key", "h1", "g")
    pairs = few.join(few.withColumnsRenamed({"h1": "y", "g": "gy"}), "key").filter("h1 < y and g <> gy").select(F.col("h1").alias("a"), F.col("y").alias("b"))
    crowd = left.filter(F.col("n") > BLOCK_LINES)
    for end in ("low", "high"):
        pairs = pairs.unionAll(crowd.filter(f"g <> {end}.g").select(F.least(f"{end}.h1", "h1").alias("a"), F.greatest(f"{end}.h1", "h1").alias("b")))
    known = start.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    tried = stored(pairs.distinct().join(known, ["a", "b"], "left_anti"), "tried")
    more = stored(_verified(tried, texts, threshold), "links")
    if not more.isEmpty():
        once = _merged(once, more, stored)
    # Last round: what is left in larger blocks, every pair.
    left = stored(_apart(members.filter(F.col("n") > BLOCK_LINES), once), "crowds")
    if left.isEmpty():
        return done(once)
    last = stored(_crossed(left, texts, threshold, stored), "links")
    return done(once if last.isEmpty() else _merged(once, last, stored))


def _merged(linked: DataFrame, links: DataFrame, stored: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """node, component of the groups so far and further links: only groups and lines that the links name are connected anew."""
    named = links.select(F.col("a").alias("node")).unionAll(links.select("b")).distinct()
    new = named.join(linked, "node", "left_anti").select("node", F.col("node").alias("component"))
    every = stored(linked.unionAll(new), "every")
    x, y = (every.select(F.col("node").alias(n), F.col("component").alias(f"g{n}")) for n in ("a", "b"))
    met = links.join(x, "a").join(y, "b").select(F.col("ga").alias("a"), F.col("gb").alias("b"))
    moved = connected(met).select(F.col("node").alias("component"), F.col("component").alias("to"))
    # Kept, as the result reads it when the scratch tables are gone.
    return c.stored(every.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "merged")


def _fit(low: str, high: str, threshold: float) -> Column:
    """Whether lines of so many characters can be near; lines that are compared by words always can."""
    return _fit_of(F.col(low), F.col(high), threshold)


def _fit_of(low: Column, high: Column, threshold: float) -> Column:
    return (high > LONG_LINE) | (high - low <= F.floor((1 - threshold) * high + 1e-9))


def _apart(members: DataFrame, linked: DataFrame) -> DataFrame:
    """The members of blocks that are not all in one group, with their group (g) and the least line of the first and of the last group (low, high)."""
    group = F.coalesce("component", F.struct(F.col("h1"), F.lit(None).cast("long").alias("h2")))
    placed = members.join(linked.withColumn("h1", F.col("node.h1")), "h1", "left").select("key", "n", "h1", "size", group.alias("g"))
    ends = placed.groupBy("key").agg(F.min(F.struct("g", "h1")).alias("low"), F.max(F.struct("g", "h1")).alias("high")).filter("low.g <> high.g")
    return placed.join(ends, "key")


def _crossed(lines: DataFrame, texts: DataFrame, threshold: float, stored: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """The links (a, b: structs of h1, h2) between all lines of one block that are in different groups.

    At least one line of such a pair is outside the largest group of the block. So parts of what is outside meet parts of the block.
    """
    sizes = lines.groupBy("key", "g").agg(F.count("*").alias("m"))
    main = sizes.groupBy("key").agg(F.max(F.struct("m", "g")).alias("main"), F.sum("m").alias("all"))
    blocks = main.select("key", F.col("main.g").alias("main"), F.ceil((F.col("all") - F.col("main.m")) / OUTSIDE).cast("int").alias("ps"), F.ceil(F.col("all") / INSIDE).cast("int").alias("qs"))
    own = lines.groupBy("h1").agg(F.collect_list("key").alias("keys"))  # a line has a bounded number of keys
    dealt = stored(lines.select("key", "h1", "size", "g").join(blocks, "key").join(own, "h1").join(texts, "h1").withColumn("signs", F.coalesce("signs", _signs("line"))), "dealt")
    part = lambda n: F.pmod(F.xxhash64(F.lit(2), "h1"), n).cast("int")
    side = lambda n: [*[F.col(t).alias(f"{n}_{t}") for t in ("h1", "size", "g", "keys")], *_side(dealt, n)]
    outside = dealt.filter("g <> main").select("key", part("ps").alias("p"), F.explode(F.sequence(F.lit(0), F.col("qs") - 1)).alias("q"), *side("a"))
    block = dealt.select("key", F.explode(F.sequence(F.lit(0), F.col("ps") - 1)).alias("p"), part("qs").alias("q"), (F.col("g") == F.col("main")).alias("b_main"), *side("b"))
    fits = _fit_of(F.least("a_size", "b_size"), F.greatest("a_size", "b_size"), threshold)
    met = F.expr("a_g <> b_g and (b_main or a_h1 < b_h1)") & fits & (F.array_min(F.array_intersect("a_keys", "b_keys")) == F.col("key")) & _near(threshold)
    return outside.join(block, ["key", "p", "q"]).filter(met).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))


def dedup(docs: DataFrame, threshold: float = 0.8, block_words: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows and columns, with the removed lines taken out of the text, and n_lines and n_removed."""
    lines = c.Stored(_lines(docs, key, text), "lines", plain=True).df
    linked = c.stored(groups(lines, threshold, block_words), "groups").select("node.h1", "node.h2", F.col("component.h1").alias("g1"), F.col("component.h2").alias("g2"))
    seen = lines.select("doc_id", "version", "line_no", "h1", "h2")
    repeated = seen.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1").select("h1", "h2")
    named = repeated.join(linked, ["h1", "h2"], "full").select("h1", "h2", F.coalesce("g1", "h1").alias("g1"), F.coalesce("g2", "h2").alias("g2"))
    named = c.stored(named, "repeated")
    some = c.stored(c.likely(seen, "h1", named, "h1").join(named, ["h1", "h2"]).select("doc_id", "version", "line_no", "g1", "g2"), "grouped")
    place = F.struct("doc_id", "version", "line_no")
    firsts = c.stored(some.groupBy("g1", "g2").agg(F.min(place).alias("first")), "firsts")
    gone = some.join(firsts, ["g1", "g2"]).filter(~place.eqNullSafe(F.col("first"))).groupBy(F.col("doc_id").alias("_key"), F.col("version").alias("_version")).agg(F.collect_set("line_no").alias("_gone"))
    gone = c.stored(gone, "gone")
    rows = c.marked(docs.withColumn("_text", c.text_of(text)).withColumn("_hash", F.xxhash64("_text")), "_hash", gone, "_version", "_maybe")
    touched = rows.filter("_maybe").join(gone, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_hash") == F.col("_version")), "left").withColumn("_gone", F.coalesce("_gone", F.array().cast("array<int>")))
    touched = touched.withColumn("_lines", F.split("_text", "\n"))
    left = F.array_join(F.filter("_lines", lambda x, k: ~F.array_contains("_gone", k)), "\n")
    cut = touched.select(*docs.columns, F.when(F.size("_gone") > 0, left).otherwise(F.col("_text")).alias("_text"), F.size("_lines").cast("long").alias("n_lines"), F.size("_gone").cast("long").alias("n_removed"))
    same = rows.filter("not _maybe").select(*docs.columns, "_text", F.size(F.split("_text", "\n")).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_removed"))
    return cut.unionAll(same).withColumn(text, F.col("_text")).drop("_text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(c.documents(spark, sf_dir).select("doc_id", "text"))
