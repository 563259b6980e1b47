"""Blocks of line dedup that are crowded or have many words."""

import string

from pyspark.sql import functions as F

from tablewright.llm import line_dedup


def named(spark, lines):
    return line_dedup._lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"), "doc_id", "text")


def test_all_near_lines_of_a_crowded_block_are_in_one_group(spark):
    # All lines share their ends. Those of a pair share nothing else but with the whole crowd; all other lines are two edits apart.
    abc = string.ascii_lowercase
    pairs = [[f"a{x}{c}{c}same" for x in "pq"] for c in abc[:10]]
    others = [f"a{abc[k]}{abc[i]}{abc[(i + k) % 26]}same" for k in (1, 2, 3) for i in range(26)]
    lines = named(spark, [*(x for p in pairs for x in p), *others])
    group = {r["line"]: r["component"] for r in line_dedup.groups(lines, 0.8, 3).join(lines.select("line", F.struct("h1", "h2").alias("node")), "node").collect()}
    assert all(p[0] in group and group[p[0]] == group.get(p[1]) for p in pairs)
    assert len(set(group.values())) == len(pairs) and not set(group) & set(others)
    kept = line_dedup.dedup(spark.createDataFrame(list(enumerate([*(x for p in pairs for x in p), *others])), "doc_id long, text string")).filter("n_removed = 0").count()
    assert kept == len(pairs) + len(others)


def test_blocks_of_many_words_have_keys(spark):
    words = spark.range(2000).select(F.format_string("word%d", "id").alias("w")).withColumn("h", F.xxhash64(F.xxhash64("w"))).filter(F.shiftright("h", 61) == -4).limit(20)
    words = [r["w"] for r in words.collect()]
    assert len(words) == 20 > line_dedup.MOST_WORDS
    lines = named(spark, [" ".join(words), " ".join(reversed(words))])
    keys = line_dedup.block_keys(lines, 3).groupBy("key").agg(F.count_distinct("h1").alias("n")).collect()
    assert keys and all(r["n"] == 2 for r in keys)


def test_no_table_of_a_crowded_block_grows_with_the_square_of_its_lines(spark, monkeypatch):
    # 300 lines share their ends and are two edits or more apart, which none of them may be: a table of pairs would have some 45,000 rows.
    abc = string.ascii_lowercase
    lines = named(spark, [f"a{abc[i]}{abc[(i + k) % 26]}{abc[(i + 3 * k) % 26]}same" for k in range(12) for i in range(26)][:300])
    rows = []

    class Counted(line_dedup.c.Stored):
        def __init__(self, *args, **options):
            super().__init__(*args, **options)
            rows.append(self.df.count())

    monkeypatch.setattr(line_dedup.c, "Stored", Counted)
    line_dedup.groups(lines, 0.8, 3).collect()
    assert max(rows) <= 20 * 300


def test_lines_outside_a_large_group_meet_all_of_it(spark, monkeypatch):
    # Parts of a few lines: the last round must find every link between the lines that are outside the largest group and all others.
    monkeypatch.setattr(line_dedup, "OUTSIDE", 3)
    monkeypatch.setattr(line_dedup, "INSIDE", 5)
    test_all_near_lines_of_a_crowded_block_are_in_one_group(spark)


def test_groups_of_the_second_round_can_be_read_when_no_block_is_crowded(spark):
    pairs = [[f"a{x}{c}{c}same" for x in "pq"] for c in string.ascii_lowercase[:3]]
    lines = named(spark, [x for p in pairs for x in p])
    group = {r["line"]: r["component"] for r in line_dedup.groups(lines, 0.8, 3).join(lines.select("line", F.struct("h1", "h2").alias("node")), "node").collect()}
    assert len(group) == 6 and all(group[p[0]] == group[p[1]] for p in pairs) and len(set(group.values())) == 3
