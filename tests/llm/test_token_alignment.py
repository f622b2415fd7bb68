"""Alignment of two tokenizers against a plain comparison of all ends."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
import sentencepiece
from tokenizers import Tokenizer

from clueweave.llm import token_alignment
from clueweave.llm.encode import default_path
from clueweave.session import get_session

BYTE, PIECE = default_path("byte_bpe_50k.json"), default_path("piece_bpe_32k.model")
SCHEMA = "doc_id bigint, text string, pair int, n string, chunk double"


@pytest.fixture(scope="module")
def spark():
    yield get_session("tests", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="6g")


def texts():
    rng = random.Random(5)
    syllables = ("tor", "el", "bä", "ni", "qua", "ñado", "réeux", "ß", "thing", "the ", "a ", " ", ". ", "\n", "12", "…", "日本", "🙂")
    odd = [None, "", " ", "  ", "\n\n", "a", "▁x", "x▁", "<|endoftext|> is text", "<s> </s> <unk> <0x41>", "\x00", "\t a\r\n", "é é", "=" * 500, "ab" * 3000, "x " * 2000]
    return odd + ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 400))) for _ in range(40)]


def rows():
    made = [(i, t, 1, "x", 0.5) for i, t in enumerate(texts())]
    return made + [made[20], (None, texts()[21], None, None, None), (2**62 + 1, texts()[22], 1, "", 1.0)]


def byte_map():
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def brute(given):
    """The contract word by word: groups from sets of ends, every linked occurrence pair listed."""
    a = Tokenizer.from_file(BYTE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    letters, out, holders = byte_map(), [], Counter()
    for doc_id, text, *_ in given:
        text = text or ""
        encoded = a.encode(" " + text, add_special_tokens=False)
        tokens = [
            [(i, len(bytes(letters[c] for c in t))) for i, t in zip(encoded.ids, encoded.tokens)],
            [(i, 1 if b.is_byte(i) else len(b.id_to_piece(i).replace("▁", " ").encode())) for i in b.encode(text)],
        ]
        spelt = [
            b"".join(bytes(letters[c] for c in t) for t in encoded.tokens),
            b"".join(bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in b.encode(text)),
        ]
        if not text or any(s != (" " + text).encode() for s in spelt):
            out.append((doc_id, [], [], 0, 0))
            continue
        ends = []
        for side in tokens:
            at, found = 0, []
            for _, size in side:
                at += size
                found.append(at)
            ends.append(found)
        groups = defaultdict(lambda: ([], []))
        common = sorted(set(ends[0]) & set(ends[1]))
        for k in (0, 1):
            g = 0
            for (i, _), end in zip(tokens[k], ends[k]):
                while common[g] < end:
                    g += 1
                groups[g][k].append(i)
        groups = [groups[g] for g in range(len(common))]
        links = [(x, y) for p, q in groups for x in p for y in q]
        holders.update(set(links))
        out.append((doc_id, groups, links, len(tokens[0]), len(tokens[1])))
    best = defaultdict(int)
    for (x, _), n in holders.items():
        best[x] = max(best[x], n)
    listed = []
    for doc_id, groups, links, n_a, n_b in out:
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        listed.append(
            (doc_id, n_a, n_b, len(groups), len(links), sum(holders[k] == best[k[0]] for k in links),
             sum(holders[k] for k in links), hashlib.sha256(text.encode()).hexdigest() if groups else "")
        )
    return listed


def test_report_equals_all_links(spark):
    given = rows()
    docs = spark.createDataFrame(given, SCHEMA).repartition(3)
    mine = token_alignment.link_report(docs, BYTE, PIECE)
    assert mine.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    expected = brute(given)
    assert Counter(map(tuple, mine.collect())) == Counter(expected)
    aligned = token_alignment.alignments(docs, BYTE, PIECE)
    sizes = [(r.doc_id, sum(r.a_sizes), sum(r.b_sizes), len(r.a_sizes)) for r in aligned.collect()]
    assert Counter(sizes) == Counter(r[:4] for r in expected)


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert token_alignment.link_report(docs, BYTE, PIECE).count() == 0


def test_common_ends_of_random_sequences():
    rng = random.Random(1)
    for _ in range(2000):
        n = rng.randrange(1, 60)
        p, q = rng.choice((0.2, 0.9, 1.0)), rng.choice((0.3, 0.95))
        a = sorted({n} | {x for x in range(1, n) if rng.random() < p})
        b = sorted({n} | {x for x in range(1, n) if rng.random() < q})
        common = sorted(set(a) & set(b))
        found = token_alignment.common_ends(a, b)
        assert [a[i] for i in found[0]] == common and [b[i] for i in found[1]] == common


def test_large_groups_are_paired_by_distinct_ids(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(2)
    sizes = (np.array([1, 3, 40, 2]), np.array([2, 5, 50, 1]))
    found = token_alignment.Alignment(rng.integers(0, 9, 46), rng.integers(0, 9, 58), *sizes)
    plain = token_alignment._merged(*token_alignment.linked(found))
    monkeypatch.setattr(token_alignment, "_LARGE_GROUP", 5)
    large = token_alignment._merged(*token_alignment.linked(found))
    assert all((x == y).all() for x, y in zip(plain, large)) and plain[1].sum() == (sizes[0] * sizes[1]).sum()
