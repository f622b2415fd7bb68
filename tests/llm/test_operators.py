"""Operators of the llm subpackage: hostile rows and brute-force comparisons on small fixtures."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from clueweave.llm import (
    components,
    decontaminate,
    embedding_dedup,
    license_scan,
    line_dedup,
    packing,
    quality,
    simhash_dedup,
    substring_dedup,
    token_store,
)
from clueweave.llm.encode import Encoder, default_path
from clueweave.llm.html_text import extract, main_text
from clueweave.session import get_session

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, point string, k1 int"
BYTE, WORD = default_path("byte_bpe_50k.json"), default_path("word_bpe_49k.json")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def spark():
    yield get_session("tests", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="6g")


def words(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(("tor", "el", "ba", "ni", "qua", "ser")) + str(rng.randrange(40)) for _ in range(n))


def texts():
    base = words(300, 1)
    odd = [None, "", " ", "\n\n", "One.", "a  b   c\t d", "é ß <|endoftext|> x", words(6000, 2)]
    near = [base, base, base.replace("tor1 ", "tor2 "), words(90, 3) + " " + base[200:900], "ab " * 700]
    laws = ["CC BY 4.0, cc-by! General  Public License", "All rights reserved. all rights, reserved"]
    return odd + near + laws + [words(40, s) for s in range(10, 30)]


@pytest.fixture(scope="module")
def docs(spark):
    """Null and repeated ids, repeated rows, extra columns named like the operators' own."""
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), "x", 1) for i, t in enumerate(texts())]
    rows += [rows[8], (None, "without id", "en", None, 1, "x", 2), (3, "same id", None, "s1", 1, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def collected(frame):
    return [tuple(r) for r in frame.collect()]


@pytest.mark.parametrize("path,cut", [(BYTE, "blank"), (WORD, "space")])
def test_chunks_give_the_ids_of_whole_texts(path, cut):
    plain, encoder = Tokenizer.from_file(path), Encoder(path, cut, kept=50)
    odd = ["a \n b", "x  ", " x", "x\n\n", "ΑΣ İ K", "don't We'LL", "½ a1b2", "é é", " a b", "文字。", "a!?b c|d"]
    given = [t or "" for t in texts()] + odd
    found = [ids.tolist() for t in given for ids in encoder.ids([t])]
    assert found == [plain.encode(t, add_special_tokens=False).ids for t in given]


@pytest.mark.parametrize("path,cut", [(BYTE, "blank"), (WORD, "space")])
def test_ids_of_random_unicode_texts(path, cut):
    rng, plain, encoder = random.Random(11), Tokenizer.from_file(path), Encoder(path, cut)
    ranges = [(32, 127), (0xA0, 0x250), (0x300, 0x370), (0x370, 0x530), (0x5D0, 0x700), (0x900, 0xA00), (0x1E00, 0x2070), (0x3040, 0x30FF), (0x4E00, 0x4F00), (0xAC00, 0xAD00), (0xFB00, 0xFB20), (0x1F600, 0x1F640)]

    def letter():
        kind = rng.random()
        if kind < 0.3:
            return rng.choice("abcdeISTİıßΣς .,!?&$ ")
        return chr(rng.randrange(*rng.choice(ranges)))

    given = ["".join(letter() for _ in range(rng.randrange(1, 14))) for _ in range(30_000)] + [" İ.", "SEVGİ.", "ΑΣ.", "ǰ!", "ŉ?"]
    exact = [e.ids for e in plain.encode_batch_fast(given, add_special_tokens=False)]
    found = [ids.tolist() for ids in encoder.ids(given)]
    assert [(t, f) for t, f, e in zip(given, found, exact) if f != e] == []


def test_packing_round_trip(docs, nothing):
    plain, pieces = Tokenizer.from_file(BYTE), packing.decompose(docs, BYTE, "blank", 0, 64).collect()
    assert len({p.sequence_id for p in pieces}) == len(pieces) == max(p.sequence_id for p in pieces) + 1
    assert all(p.length & (p.length - 1) == 0 and p.length <= 64 and p.offset == 0 for p in pieces)
    want = Counter()
    for row in docs.collect():
        ids, at = [*plain.encode(row.text or "", add_special_tokens=False).ids, 0], 0
        for n in packing.piece_lengths(len(ids), 64):
            want[row.doc_id, at, n, np.array(ids[at : at + n], "<u4").tobytes(), len(ids)] += 1
            at += n
    assert Counter((p.doc_id, p.start, p.length, bytes(p.ids), p.doc_tokens) for p in pieces) == want
    assert packing.decompose(nothing, BYTE, "blank").count() == 0


def test_token_store_round_trip(docs, nothing):
    plain = Tokenizer.from_file(WORD)
    store = token_store.write_store(docs, WORD, "space", 2)
    rows = sorted(collected(token_store.read_store(store)), key=lambda r: r[1])
    ids = {}
    for row in docs.collect():
        found = [*plain.encode(row.text or "", add_special_tokens=False).ids, 2]
        ids.setdefault(row.doc_id, []).append((len(found), zlib.crc32(np.array(found, "<u4").tobytes())))
    assert [r[0] for r in rows] == sorted((r.doc_id for r in docs.collect()), key=lambda i: (i is not None, i or 0))
    assert [r[1] for r in rows] == [sum(r[2] for r in rows[:i]) for i in range(len(rows))]
    assert sorted((r[0] or -1, r[2], r[3]) for r in rows) == sorted((i or -1, *x) for i, v in ids.items() for x in v)
    assert token_store.read_store(token_store.write_store(nothing, WORD, "space", 2)).count() == 0


@pytest.mark.parametrize("values", [[], [0], [7, 7, 7], [-3, 5, 10**12], list(range(0, 9000, 3))])
def test_elias_fano(values):
    data = token_store.EliasFano.of(np.array(values, dtype=np.int64)).to_bytes()
    found, used = token_store.EliasFano.read(memoryview(data))
    assert used == len(data) and found.values().tolist() == values
    assert [found.select(i) for i in range(len(values))] == values


def test_quality(spark, docs, nothing):
    rows = [(i, words(60, i) if i % 2 else "### $$$ &&& *** " * 20, "en", "s", 1, "", 0) for i in range(200)]
    given = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)], "doc_id bigint, quality int, toxic int")
    model = quality.fit(given, labels)
    scored = given.select("doc_id", quality.held_out(given.doc_id).alias("h"), quality.score(model, given.text).alias("s"))
    rows = scored.collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([(r.s >= quality.THRESHOLD) == r.doc_id % 2 for r in rows if r.h]) > 0.95
    assert all(0 <= r[0] <= 1 for r in docs.select(quality.score(model, docs.text)).collect())
    assert quality.fit(nothing, labels) is None
    assert {r[0] for r in docs.select(quality.score(None, docs.text)).collect()} == {0.5}


def test_decontamination(spark, docs, nothing):
    long, short = words(60, 77), "only three words"
    edited = long.split()
    edited[30] = "changed"
    far = long.split()[::2]
    rows = [(1, words(50, 5) + " " + long.upper() + ". " + words(20, 6)), (2, " ".join(edited)), (3, " ".join(far)),
            (4, f"x, {short}! y"), (5, None), (6, long), (6, long)]
    given = spark.createDataFrame(rows, "doc_id bigint, text string")
    items = spark.createDataFrame([(10, long), (11, short), (12, None), (13, "")], "item_id bigint, text string")
    for size in (1, 2000):
        found = sorted(collected(decontaminate.contaminated(given, items, size=size)))
        assert [(d, i) for d, i, *_ in found] == [(1, 10), (2, 10), (4, 11), (6, 10), (6, 10)]
        assert found[0][2:] == (1.0, 50, 60) and 0.8 <= found[1][2] < 1
        assert sorted(collected(decontaminate.remove(given, items, size=size).select("doc_id"))) == [(3,), (5,)]
    assert decontaminate.remove(docs, items.where("false")).count() == docs.count()
    assert decontaminate.contaminated(nothing, items).count() == 0


def test_decontamination_of_documents_shorter_than_an_item(spark):
    """All pairs by brute force: the best window, or the whole document if the item is longer."""
    long, tail, loop, small = words(100, 91).split(), words(30, 92).split(), ["ab", "cd"] * 30, words(9, 93).split()
    items = {10: long, 11: long[:60] + tail, 12: loop, 13: small, 14: ["only", "three", "words"], 15: small[:6]}
    given = [long[:n] for n in (99, 90, 82, 81, 80, 70, 4)] + [long[1:], long[5:95], long[:50] + long[51:]]
    given += [tail + long[:60], long[:60] + tail[:-1], loop[:-1], loop[:50], loop[:40], small[1:], small[:7], ["only", "three"], []]
    given += [long + tail, tail[:20] + long[:99]]

    def shingled(w, k):
        return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))

    want = set()
    for d, w in enumerate(given):
        for i, item in items.items():
            k, n = min(5, len(item)), min(len(item), len(w))
            pairs = [(shingled(w[at : at + n], k), shingled(item, k)) for at in range(len(w) - n + 1)]
            top = max(sum((a & b).values()) / sum((a | b).values()) for a, b in pairs)
            if top >= 0.8:
                want.add((d, i, top, n))
    rows = spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(given)], "doc_id int, text string")
    listed = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id int, text string")
    for size in (1, 2000):
        found = decontaminate.contaminated(rows, listed, size=size).collect()
        assert len(found) == len(want) and {(r.doc_id, r.item_id, r.similarity, r.n_words) for r in found} == want
        assert all(r.start_word == 0 for r in found if r.n_words < len(items[r.item_id]))
        kept = {r.doc_id for r in decontaminate.remove(rows, listed, size=size).collect()}
        assert kept == set(range(len(given))) - {d for d, *_ in want}
    assert {(0, 10), (7, 10), (9, 10), (11, 11), (12, 12)} <= {(d, i) for d, i, *_ in want}


def test_line_dedup(spark, docs, nothing):
    rows = [(i, f"own {i}\nshared\n\n few" if i < 4 else f"own {i}\nshared ", f"s{i}") for i in range(40)]
    given = spark.createDataFrame([*rows, (99, None, "s"), (98, "", None)], "doc_id bigint, text string, source string")
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup.drop_boilerplate(given, 10).collect()}
    assert got[0] == ("own 0\nshared\n\n few", 4, 0) and got[1] == ("own 1\n\n few", 4, 1)
    assert got[7] == ("own 7", 2, 1) and got[99] == (None, 0, 0) and got[98] == ("", 1, 0)
    kept = line_dedup.drop_boilerplate(docs, 10)
    assert set(docs.columns) < set(kept.columns) and kept.count() == docs.count()
    assert line_dedup.drop_boilerplate(nothing, 10).count() == 0


def test_substring_dedup(docs, nothing):
    length, seen = 40, Counter()
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    for _, t in rows:
        seen.update(t[i : i + length] for i in range(len(t) - length + 1))
    want = []
    for key, t in rows:
        gone = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        want.append((key, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept.decode(errors="replace")))
    order = lambda r: (r[0] is not None, r)
    for limits in ({}, {"shard_bytes": 500, "split_bytes": 300}):
        found = substring_dedup.remove_repeats(docs, length, **limits)
        assert all(r.n_removed == sum(b - a for a, b in r.spans) for r in found.collect())
        got = collected(found.drop("spans"))
        assert sorted(got, key=order) == sorted(want, key=order)
    assert substring_dedup.remove_repeats(nothing, length).count() == 0


def test_substring_dedup_of_a_hot_gram_with_many_classes(spark):
    """One passage stands in every text, each time with other neighbours."""
    rng, length = random.Random(9), 60
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = noise(55)
    shown = [noise(20) + passage + tail for tail in [noise(4) for _ in range(30)] for _ in range(2)]
    shown += [noise(rng.randrange(80)) + "é" * rng.randrange(3) + passage + noise(3) for _ in range(60)]
    seen = Counter(t.encode()[i : i + length] for t in shown for i in range(len(t.encode()) - length + 1))
    want = []
    for key, t in enumerate(shown):
        data = t.encode()
        gone = np.zeros(len(data), dtype=bool)
        for i in range(len(data) - length + 1):
            gone[i : i + length] |= seen[data[i : i + length]] > 1
        want.append((key, int(gone.sum())))
    given = spark.createDataFrame(list(enumerate(shown)), "doc_id bigint, text string")
    found = substring_dedup.remove_repeats(given, length, shard_bytes=2000, split_bytes=700)
    assert sorted((r.doc_id, r.n_removed) for r in found.collect()) == want


@pytest.mark.parametrize("letters", [1, 2, 5])
def test_suffix_array(letters):
    rng = np.random.default_rng(letters)
    symbols = rng.integers(0, letters, 700).astype(np.int16)
    order, _ = substring_dedup.suffix_array(symbols)
    listed = symbols.tolist()
    assert order.tolist() == sorted(range(700), key=lambda i: listed[i:])
    shared, before = substring_dedup.common_prefixes(symbols, order)
    for i, j in zip(order[1:], order):
        n = next((k for k in range(700) if max(i, j) + k >= 700 or listed[i + k] != listed[j + k]), 700)
        assert shared[i] == n and before[i] == j


def test_license_scan(docs, nothing):
    phrases = dict((label, phrase.split()) for label, phrase in license_scan.BASE)
    want = Counter()
    for text in {r.text or "" for r in docs.collect()}:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(AZ))
        for label, p in phrases.items():
            want.update((label, i) for i in range(len(w)) if w[i : i + len(p)] == p)
    found = license_scan.spans(docs, ["text"]).where("base")
    assert Counter((r.label, r.start) for r in found.collect()) == want and sum(want.values()) == 5
    assert license_scan.spans(nothing, ["text"]).count() == 0


def covered(w, phrase):
    """Share of the phrase's word pairs that a few words hold in order (longest common subsequence)."""
    pairs, own = list(zip(w, w[1:])), list(zip(phrase, phrase[1:]))
    table = [[0] * (len(own) + 1) for _ in range(len(pairs) + 1)]
    for i, a in enumerate(pairs):
        for j, b in enumerate(own):
            table[i + 1][j + 1] = max(table[i][j + 1], table[i + 1][j], table[i][j] + (a == b))
    return table[-1][-1] / len(own)


def test_license_lists(spark):
    """Further templates in lists and repetitive text, against all windows of each text."""
    mit, isc = license_scan.FURTHER[1][1], license_scan.FURTHER[13][1]
    given = [
        "CC BY, CC BY-SA, CC BY-NC", "cc by sa " * 3, "cc by sa cc by nc cc by nd " * 40, "cc by " * 50,
        "cc by, by sa", "by sa cc by", f"{mit} {mit}", mit.replace("free of", "free free of"), mit.replace("hereby ", ""),
        f"{mit[:40]} {mit[:40]} {mit}", "granted free of charge " * 9, f"{isc} cc by-nd {isc}", None, "",
    ]
    rows = spark.createDataFrame([(t,) for t in [*given, given[0]]], "text string")
    found = license_scan.spans(rows, ["text"]).where("not base").collect()
    assert len({(r.text, r.template, r.start, r.end) for r in found}) == len(found)
    exact, best = set(), {}
    for text in filter(None, given):
        w = text.lower().replace("-", " ").replace(",", " ").split()
        for n, (_, phrase) in enumerate(license_scan.FURTHER, len(license_scan.BASE)):
            p = phrase.split()
            size = len(p)
            exact |= {(text, n, i, i + size) for i in range(len(w)) if w[i : i + size] == p}
            top = max(covered(w[i : i + size + license_scan.SLACK], p) for i in range(len(w)))
            if top >= license_scan.COVER:
                best[text, n] = top
    assert exact == {(r.text, r.template, r.start, r.end) for r in found if r.coverage == 1 and r.end - r.start == len(license_scan.FURTHER[r.template - 3][1].split())}
    got = {}
    for r in found:
        got[r.text, r.template] = max(r.coverage, got.get((r.text, r.template), 0))
        w = r.text.lower().replace("-", " ").replace(",", " ").split()
        assert r.coverage == covered(w[r.start : r.end], license_scan.FURTHER[r.template - 3][1].split())
    assert got == best
    assert {r.label for r in found if r.text == given[0]} == {"cc-by-sa", "cc-by-nc"}
    assert [(r.start, r.end) for r in sorted(found, key=lambda r: r.start) if r.text == given[1]] == [(0, 3), (3, 6), (6, 9)]


def test_html(spark):
    page = (
        "<html><head><title>t</title><script>if (a < b) x('</p>')</script></head><body><nav><a href=x>menu</a></nav>"
        "<div class='Cookie-notice'>we use cookies</div><header>top</header><article><h1>Head &amp; more</h1>"
        "<p>First <b>bold</b>  text\n here.<p>Second &eacute; text, a long one to read.<div class=ad>buy</div></article>"
        "<section id=comments><p>A very long reader comment that goes on and on and on and on.</p></section>"
        "<footer>end</footer>"
    )
    assert main_text(page) == "Head & more\nFirst bold text here.\nSecond é text, a long one to read."
    assert [main_text(p) for p in (None, "", "plain words", "<p>a<p>b", "<", "<!-- x")][:4] == ["", "", "plain words", "a\nb"]
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    frame = spark.createDataFrame([(page,), (None,), (deep,)], "html string").select(extract("html").alias("t"))
    assert [r.t for r in frame.collect()][1:] == ["", "x"]


def brute_components(points, close):
    least = list(range(len(points)))
    while True:
        new = [min(least[j] for j in range(len(points)) if j == i or close(points[i], points[j])) for i in range(len(points))]
        if new == least:
            return least
        least = new


def test_simhash(docs, nothing):
    rows = docs.select("doc_id", "text").collect()
    prints = []
    for row in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (row.text or "").translate(AZ))
        s = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) > 3 else [" ".join(w)] * bool(w)
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        prints.append(sum((sum(x >> b & 1 for x in h) * 2 > len(h)) << b for b in range(64)))
    roots = brute_components(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for row, root in zip(rows, roots):
        if row.doc_id is not None:
            least[root] = min(least.get(root, row.doc_id), row.doc_id)
    want = Counter((r.doc_id, f"{p:016x}", least.get(root)) for r, p, root in zip(rows, prints, roots))
    assert Counter(collected(simhash_dedup.near_duplicates(docs))) == want
    kept = simhash_dedup.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(roots))
    assert simhash_dedup.near_duplicates(nothing).count() == 0 and simhash_dedup.keep_one(nothing).count() == 0


def test_vantage_point_trees_lose_no_link(spark):
    rng = random.Random(4)
    points = [rng.getrandbits(64) for _ in range(150)]
    for p in list(points):
        for _ in range(3):
            points.append(p ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6))))
    points = sorted(set(points))
    signed = [(p - (p >> 63 << 64),) for p in points]
    links = simhash_dedup.link_points(spark.createDataFrame(signed, "point bigint"), 4, shard=20, sample=200)
    found = dict(collected(components.components(links)))
    roots = brute_components(points, lambda a, b: (a ^ b).bit_count() <= 4)
    groups = lambda of: {frozenset(i for i in range(len(points)) if of[i] == r) for r in set(of)}
    assert groups([found.get(s, s) for (s,) in signed]) == groups(roots)


def test_embedding_dedup(spark):
    rng = np.random.default_rng(3)
    rows, centres = [], rng.standard_normal((12, 16))
    for i in range(240):
        v = centres[i % 12] + rng.standard_normal(16) * (0.02, 0.06, 0.1, 0.5)[i % 4]
        rows.append((i, [float(np.float32(x)) for x in v], i % 12 % 3))
    nan, inf = float("nan"), float("inf")
    rows += [(300, rows[0][1], 0), (300, rows[0][1], 0), (301, None, 0), (302, [0.0] * 16, 0), (303, [nan] * 16, 0),
             (304, [inf] + [1.0] * 15, 0), (305, rows[0][1], None), (306, [], 0), (307, [1.0, None], 0), (None, rows[1][1], 1)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    sound = lambda v: v and None not in v and np.isfinite(v).all() and np.any(v)
    close = lambda a, b: bool(
        a[2] is not None and a[2] == b[2] and sound(a[1]) and sound(b[1]) and len(a[1]) == len(b[1])
        and np.dot(a[1], b[1]) / np.linalg.norm(a[1]) / np.linalg.norm(b[1]) >= 0.98
    )
    roots = brute_components(rows, close)
    want = []
    for i, row in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if roots[j] == roots[i] and rows[j][0] is not None]
        n = sum(close(row, other) for j, other in enumerate(rows) if j != i)
        least = min(ids) if ids else None
        want.append((row[0], n, least, row[0] is not None and row[0] == least))
    for piece in (7, 4096):
        assert Counter(collected(embedding_dedup.near_duplicates(frame, piece=piece))) == Counter(want)
    assert embedding_dedup.near_duplicates(frame.where("false")).count() == 0


def test_deep_pages_take_linear_time_and_rows_stay_apart(spark, nothing):
    started = time.process_time()
    assert main_text("<div>" * 40_000 + "deep text") == "deep text"
    assert main_text("<b>" * 20_000 + "</i>" * 20_000 + "marks") == "marks"
    assert time.process_time() - started < 10
    page = "<body><article><p>One.</p><p>Two &amp; three.</p></article><footer>f</footer></body>"
    rows = [(1, page, "x"), (1, page, "x"), (None, None, None), (2, "", "y"), (3, "<p>" + "word " * 50_000, "z")]
    frame = spark.createDataFrame(rows, "page_id int, html string, text string")
    found = frame.select("page_id", extract("html").alias("found")).collect()
    assert [r.found for r in found][:4] == ["One.\nTwo & three."] * 2 + ["", ""]
    assert len(found[4].found) == 249_999
    assert frame.limit(0).select(extract("html")).count() == 0
