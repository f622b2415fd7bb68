"""Files: JSON records, delimited bags, matrices, XML dumps and stored tables."""

import bz2
import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from clueweave.operators import bags as B
from clueweave.operators import dictionary as D
from clueweave.operators import puzzles as Z
from clueweave.sources import bag_text, matrix, ranges, records, store

MINIMAL = {"title": "Mini", "author": "A", "words": [{"word": "CAT", "clue": "pet", "x": 0, "y": 0, "dir": "East"}]}
FULL = {
    "source": "S", "language": "eng", "title": "T", "url": "u", "date": "2015-05-06", "author": "B",
    "categories": ["cryptic"],
    "words": [
        {"word": "COD", "clue": "fish", "x": 0, "y": 0, "dir": "South"},
        {"word": "TEN", "clue": "number", "x": 2, "y": 0, "dir": "South"},
    ],
}
BARE = {**FULL, "title": "Bare", "categories": "straight"}


@pytest.fixture
def puzzle_dir(tmp_path):
    deep = tmp_path / "puzzles" / "deep"
    deep.mkdir(parents=True)
    (deep / "mini.json").write_text(json.dumps(MINIMAL, indent=2))
    (deep / "skipped.txt").write_text("not json")
    (tmp_path / "puzzles" / "two.json.bz2").write_bytes(bz2.compress(json.dumps([FULL, BARE]).encode()))
    return str(tmp_path / "puzzles")


def test_puzzle_files(spark, puzzle_dir):
    got = {r.title: r for r in records.read_puzzles(spark, puzzle_dir).collect()}
    assert set(got) == {"Mini", "T", "Bare"}
    assert got["Mini"].categories is None and got["Mini"].file_name == "mini.json"
    assert got["T"].categories == ["cryptic"] and got["Bare"].categories == ["straight"]
    assert B.clues(records.read_puzzles(spark, puzzle_dir)).count() == 5


def test_json_roundtrip_with_bounded_files(spark, tmp_path):
    entries = spark.range(25).select(
        F.concat(F.lit("w"), "id").alias("word"),
        F.when(F.col("id") % 2 == 0, F.array(F.lit("d"))).alias("definitions"),
    )
    path = str(tmp_path / "entries")
    records.write_json(entries.coalesce(1), path, per_file=10)
    files = [f for f in (tmp_path / "entries").iterdir() if f.name.endswith(".json.bz2")]
    assert len(files) == 3
    back = spark.read.schema(records.ENTRY).json(path)
    assert back.count() == 25 and back.where("definitions IS NOT NULL").count() == 13
    assert all(k not in bz2.decompress(files[0].read_bytes()).decode().splitlines()[1] for k in ("examples", "null"))


@pytest.mark.parametrize("nested", [False, True])
def test_array_files_are_bounded(spark, tmp_path, nested):
    entries = spark.range(25).select(F.repeat(F.lit("w"), F.col("id").cast("int")).alias("word"))
    path = str(tmp_path / "arrays")
    records.write_arrays(entries.coalesce(1), path, per_file=10, max_bytes=300, nested=nested, codec="none")
    files = [f for f in (tmp_path / "arrays").iterdir() if f.name.endswith(".txt")]
    assert len(files) > 2 and all(f.stat().st_size <= 310 for f in files)
    read = records.read_nested_entries(spark, path) if nested else records.read_entries(spark, path, "*.txt*")
    assert sorted(len(r.word) for r in read.collect()) == list(range(25))


def test_nested_arrays_are_flattened(spark, tmp_path):
    (tmp_path / "n").mkdir()
    (tmp_path / "n" / "a.json").write_text('[[{"word":"a"},{"word":"b"}],[{"word":"c","other":["x"]}]]')
    got = records.read_nested_entries(spark, str(tmp_path / "n")).orderBy("word").collect()
    assert [(r.word, r.other) for r in got] == [("a", None), ("b", None), ("c", ["x"])]


def test_bag_text_formats(spark, tmp_path):
    bags = spark.createDataFrame(
        [("clues", ["CAT", "DOG"], ["CAT", "DOG"], ["SMALL", "PETS"], ["SMALL", "PET"])],
        "category string, words array<string>, words_stem array<string>, defs array<string>, defs_stem array<string>",
    )
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    bag_text.write_v1(bags, one, files=1)
    bag_text.write_v2(bags, two)
    assert spark.read.text(one).first().value == "CAT,DOG-SMALL,PETS"
    assert spark.read.text(two).first().value == "CAT,DOG;CAT,DOG;SMALL,PETS;SMALL,PET"
    back = bag_text.read_v1(spark, one).first()
    assert (back.category, back.words, back.defs) == ("clues", ["CAT", "DOG"], ["SMALL", "PETS"])
    assert tuple(bag_text.read_v2(spark, two).first()) == (
        "clues", ["CAT", "DOG"], ["CAT", "DOG"], ["SMALL", "PETS"], ["SMALL", "PET"],
    )


def test_stem_index_cuts_at_first_comma(spark, tmp_path):
    path = str(tmp_path / "stems")
    bag_text.write_stem_index(spark.createDataFrame([("CAT", "cats,x")], "stem string, form string"), path)
    assert tuple(bag_text.read_stem_index(spark, path).first()) == ("CAT", "cats,x")


def test_matrix_files_with_and_without_header(spark, tmp_path):
    (tmp_path / "adj").mkdir()
    (tmp_path / "adj" / "a.csv").write_text("widfrom,widto,weight\n0,1,0.5\n1,0,1.0\n")
    (tmp_path / "idx").mkdir()
    (tmp_path / "idx" / "i.csv").write_text("wid,word\n0,CAT\n1,DOG\n")
    assert sorted(map(tuple, matrix.read_adjacency(spark, str(tmp_path / "adj")).collect())) == [(0, 1, 0.5), (1, 0, 1.0)]
    index = matrix.read_index(spark, str(tmp_path / "idx"))
    assert sorted(map(tuple, index.collect())) == [(0, "CAT"), (1, "DOG")]
    matrix.write_index(index, str(tmp_path / "out"))
    assert matrix.read_index(spark, str(tmp_path / "out")).count() == 2
    matrix.write_adjacency(matrix.read_adjacency(spark, str(tmp_path / "adj")), str(tmp_path / "out2"))
    assert matrix.read_adjacency(spark, str(tmp_path / "out2")).count() == 2


def test_sparse_and_reduced_lines(spark):
    lines = spark.createDataFrame(
        [("(3,[1,0,2],[0.5,9.0,1.0])",), ("(3,[2],[0.25])",), ("(0,[1],[1.0])",), ("junk",)], "value string"
    )
    assert sorted(map(tuple, matrix.parse_sparse(lines).collect())) == [(3, 1, 0.5), (3, 2, 1.25)]
    reduced = spark.createDataFrame([("(List(CAT),List(SMALL, PET),0.4)",)], "value string")
    assert tuple(matrix.parse_reduced(reduced).first()) == (["CAT"], ["SMALL", "PET"], 0.4)


def test_xml_dump_pages(spark, tmp_path):
    pages = "".join(
        f"<page><title>{t}</title><ns>{ns}</ns><revision><text xml:space='preserve'>{x}</text></revision></page>"
        for t, ns, x in (("cat", 0, "==English=="), ("Talk:cat", 1, "chat"), ("dog", 0, ""))
    )
    (tmp_path / "dump.xml").write_text(f"<mediawiki>{pages}</mediawiki>")
    got = {r.title: r.text for r in records.read_pages(spark, str(tmp_path / "dump.xml")).collect()}
    assert set(got) == {"cat", "dog"} and got["cat"] == "==English=="


def test_normalised_store(spark, puzzle_dir, tmp_path):
    puzzles = records.read_puzzles(spark, puzzle_dir).withColumn("cwid", F.monotonically_increasing_id())
    dictionary = D.build(B.clues(puzzles))
    tables = Z.normalise(puzzles, dictionary)
    neighbors = spark.createDataFrame([(0, 1, 5), (1, 0, 5)], "wid_from bigint, wid_to bigint, weight bigint")
    records.store_tables({**tables, "neighbors": neighbors}, str(tmp_path / "store"))
    back = records.load_tables(spark, str(tmp_path / "store"), [*tables, "neighbors"])
    assert back["items"].count() == 5 and back["words"].count() == 3
    assert {r.category for r in back["categories"].collect()} == {"cryptic", "straight"}
    assert back["items"].join(back["words"], "wid", "left_anti").count() == 0


def nested(rng, record, depth):
    text = json.dumps(record, ensure_ascii=rng.random() < 0.5, indent=rng.choice((None, 2)))
    return "[" * depth + text + "]" * depth


def hostile_records(n=300):
    rng = random.Random(2)
    strange = ['plain', 'a "quoted" word', "braces {{ }", '}{"', "back\\slash\\\\", '\\"', "", "é日\n", "[", "],["]
    return rng, [{"word": f"{rng.choice(strange)}{i}", "definitions": rng.sample(strange, rng.randrange(4))} for i in range(n)]


@pytest.mark.parametrize("size", [7, 64, 1000, 1 << 20])
def test_ranges_give_every_record_once(size):
    rng, made = hostile_records(60)
    text = ("[" + ", ".join(nested(rng, r, i % 6) for i, r in enumerate(made)) + "]\n" + json.dumps(made[0])).encode()
    found, inside, depth = [], 0, 0
    for begin in range(0, len(text), size):
        before = text[:begin]
        escapes = len(before) - len(before.rstrip(b"\\"))
        blocks = [text[i : i + 11] for i in range(begin, len(text), 11)]
        found += [json.loads(r) for r in ranges.cut(blocks, size, inside, depth, escapes)]
        part = text[begin : begin + size]
        turns, outside_opened, inside_opened = ranges.summary([part[i : i + 5] for i in range(0, len(part), 5)], escapes)
        depth += inside_opened if inside else outside_opened
        inside ^= turns
    assert found == made + made[:1] and (inside, depth) == (0, 0)


def test_one_large_file_is_read_by_many_tasks(spark, tmp_path):
    rng, made = hostile_records()
    (tmp_path / "big.json").write_text("[" + ",\n".join(nested(rng, r, i % 6) for i, r in enumerate(made)) + "]", encoding="utf-8")
    (tmp_path / "one.json").write_text(json.dumps(made[0]))
    (tmp_path / "empty.json").write_text("")
    size = (tmp_path / "big.json").stat().st_size
    read = ranges.read_json_records(spark, str(tmp_path), records.ENTRY, range_bytes=size // 12)
    assert ranges.planned(spark, str(tmp_path), size // 12).where("path LIKE '%big.json'").count() >= 12
    got = Counter((r.word, tuple(r.definitions)) for r in read.collect())
    assert got == Counter((m["word"], tuple(m["definitions"])) for m in [*made, made[0]])
    used = read.select(F.spark_partition_id().alias("p"), "word").groupBy("p").count().count()
    assert used >= 6


def test_compressed_file_is_one_range(spark, tmp_path):
    _, made = hostile_records(40)
    (tmp_path / "a.json.bz2").write_bytes(bz2.compress(json.dumps([[made]]).encode()))
    got = ranges.read_json_records(spark, str(tmp_path), records.ENTRY, range_bytes=50)
    assert sorted(r.word for r in got.collect()) == sorted(m["word"] for m in made)


def test_nested_entries_of_mixed_depth(spark, tmp_path):
    rng, made = hostile_records(50)
    (tmp_path / "a.json").write_text("[" + ",".join(nested(rng, r, i % 6) for i, r in enumerate(made)) + ", 3, null, \"x\", [[]]]")
    (tmp_path / "b.json").write_text(json.dumps(made[1]))
    (tmp_path / "c.json").write_text("not json")
    got = Counter((r.word, tuple(r.definitions)) for r in records.read_nested_entries(spark, str(tmp_path)).collect())
    assert got == Counter((m["word"], tuple(m["definitions"])) for m in [*made, made[1]])


@pytest.mark.parametrize("codec", ["none", "bz2"])
def test_dump_pages_are_split_inside_files(spark, tmp_path, codec):
    rng = random.Random(1)
    pages = [(f"T {i}", i % 3, "".join(rng.choice("ab<&\n é") for _ in range(rng.randrange(2000)))) for i in range(900)]
    body = "".join(
        f'<page><title>{t}</title><ns>{n}</ns><revision><text xml:space="preserve">{x.replace("&", "&amp;").replace("<", "&lt;")}</text></revision></page>\n'
        for t, n, x in pages
    )
    data = f"<mediawiki>\n{body}</mediawiki>".encode()
    (tmp_path / ("d.xml" + (".bz2" if codec == "bz2" else ""))).write_bytes(bz2.compress(data, 1) if codec == "bz2" else data)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(40_000))
    try:
        read = ranges.read_split_pages(spark, str(tmp_path))
        got = read.select(F.spark_partition_id().alias("p"), "title", "text").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.title, r.text) for r in got) == sorted((t, x) for t, n, x in pages if n == 0)
    assert len({r.p for r in got}) >= (4 if codec == "bz2" else 8)


def puzzle(url, words, **more):
    return {"source": "S", "url": url, "date": None, "categories": ["a", "", "a"], **more,
            "words": [{"word": w, "clue": f"{w}?", "x": i, "y": 0, "dir": "East"} for i, w in enumerate(words)]}


def test_store_grows_in_batches(spark, tmp_path):
    def batch(rows):
        return spark.createDataFrame([json.dumps(r) for r in rows], "string").select(
            F.from_json("value", records.PUZZLE.simpleString().replace("categories:string", "categories:array<string>")).alias("r")
        ).select("r.*")

    first = [puzzle("u1", ["CAT", "DOG", None]), puzzle("u2", ["EEL"], author="x"), puzzle("u1", ["CAT", "DOG", None])]
    second = [puzzle("u0", ["ANT", "EEL", "FOX"]), puzzle("u2", ["NEW"]), puzzle(None, []), puzzle(None, [])]
    path = str(tmp_path / "store")
    assert all(t.count() == 0 for t in store.load(spark, path).values())
    assert store.append(spark, path, batch(first)) == 1
    before = {n: {tuple(r) for r in t.collect()} for n, t in store.load(spark, path).items()}
    assert {r[1]: r[0] for r in before["words"]} == {"CAT": 0, "DOG": 1, "EEL": 2}
    (tmp_path / "store" / "data" / "words-9-left-behind").mkdir()  # by a failed append
    assert store.append(spark, path, batch(second)) == 2 and store.append(spark, path, batch(second)) == 3
    after = store.load(spark, path)
    assert all(before[n] <= {tuple(r) for r in t.collect()} for n, t in after.items())
    assert {r.word: r.wid for r in after["words"].collect()} == {"CAT": 0, "DOG": 1, "EEL": 2, "ANT": 3, "FOX": 4}
    assert {r.url: r.cwid for r in after["puzzles"].collect()} == {"u1": 0, "u2": 1, None: 2, "u0": 3}
    placed = after["items"].join(after["words"], "wid").join(after["puzzles"], "cwid")
    got = sorted((r.url, r.word, r.x, r.clue) for r in placed.collect())
    assert got == sorted([("u1", "CAT", 0, "CAT?"), ("u1", "DOG", 1, "DOG?"), ("u2", "EEL", 0, "EEL?"),
                          ("u0", "ANT", 0, "ANT?"), ("u0", "EEL", 1, "EEL?"), ("u0", "FOX", 2, "FOX?")])
    assert after["categories"].count() == 4
    # one batch of everything has the same content
    other = str(tmp_path / "other")
    store.append(spark, other, batch([*first, *second]))
    assert store.load(spark, other)["items"].count() in (6, 7)


def test_store_refuses_a_claimed_version(spark, tmp_path):
    (tmp_path / "manifest" / "v000001").mkdir(parents=True)
    rows = spark.createDataFrame([], records.PUZZLE).withColumn("categories", F.array("categories"))
    with pytest.raises(Exception, match="already exists"):
        store.append(spark, str(tmp_path), rows)
