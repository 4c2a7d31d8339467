"""Near-duplicate groups by minima, filter audit and collocations against plain versions."""

import random

import numpy as np
import pytest

from riskloom.llm import filters, minhash, phrases
from tests.llm import brute
from tests.llm.test_operators import SCHEMA, docs, empty, ids_and_texts, rows_of  # noqa: F401

ODD = "doc_id long, text string, lang string, node long, key long, fp string, part string, n string, `a.b` int"


def odd_table(spark, rows):
    """``rows`` of id, text and lang beside columns named like the operators' own."""
    return spark.createDataFrame([(*r, 1, 2, "x", "y", "z", 3) for r in rows], ODD).repartition(3)


def near_texts(rnd):
    """Chains of copies, many of them just above or below the limit."""
    texts = []
    for size, changes in ((60, (1, 2, 3)), (200, (4, 5, 6, 7, 9)), (600, (10, 15, 18, 22))):
        for _ in range(3):
            base = [f"w{rnd.randint(0, 9000)}" for _ in range(size)]
            for _ in range(12):
                words = list(base)
                for at in rnd.sample(range(size), rnd.choice(changes)):
                    words[at] = f"x{rnd.randint(0, 10**6)}"
                texts.append(" ".join(words))
    return texts


def test_minhash_odd_rows(docs, empty):  # noqa: F811
    got = rows_of(minhash.near_duplicates(docs), "doc_id", "n_shingles", "component_id", "kept")
    assert got == sorted(brute.jaccard_groups(ids_and_texts(docs)), key=repr)
    assert minhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("rounds, cell", [(2, 2048), (0, 3)])
def test_minhash_equals_brute(spark, rounds, cell, monkeypatch):
    monkeypatch.setattr(minhash, "ROUNDS", rounds)
    monkeypatch.setattr(minhash, "CELL", cell)
    rnd = random.Random(21)
    shared = " ".join(f"s{i}" for i in range(80))
    texts = near_texts(rnd) + [shared + " " + " ".join(f"u{rnd.randint(0, 10**6)}" for _ in range(n)) for n in (5, 15, 25, 60) for _ in range(4)]
    texts += [texts[3].upper(), "a b c", "A  b\tc", "a b", "", None, " \n"]
    rnd.shuffle(texts)
    rows = list(enumerate(texts))
    got = minhash.near_duplicates(odd_table(spark, [(*r, "en") for r in rows]))
    assert rows_of(got, "doc_id", "n_shingles", "component_id", "kept") == sorted(brute.jaccard_groups(rows), key=repr)


def test_bands_and_signatures():
    rnd = np.random.default_rng(5)
    near = far = 0
    for _ in range(60):
        one = rnd.integers(0, 2**64, 900, dtype=np.uint64)
        two = np.r_[one[100:], rnd.integers(0, 2**64, 100, dtype=np.uint64)]
        x, y = minhash.minima(one), minhash.minima(two)
        assert (minhash.band_keys(x) == minhash.band_keys(y)).any()
        a, b = minhash.signature(x), minhash.signature(y)
        differ = np.bitwise_count(((a[:4] ^ b[:4]) | (a[4:] ^ b[4:])).view(np.uint64)).sum()
        assert differ <= minhash.MOST_APART
        near += (x == y).sum()
        z = minhash.minima(rnd.integers(0, 2**64, 900, dtype=np.uint64))
        far += (x == z).sum()
    assert abs(near / 60 / minhash.HASHES - 0.8) < 0.02 and far < 60


def audit_rows(docs, labels):  # noqa: F811
    got = filters.filter_audit(docs, labels)
    return rows_of(got, "part", "filter_order", "step", *filters.COUNTS)


def test_filter_audit(spark, docs, empty):  # noqa: F811
    rnd = random.Random(8)
    texts = [" ".join(rnd.choice(["One", "two", "THREE", "f#ur", "five"]) + str(rnd.randint(0, m)) for _ in range(n)) for m in (3, 900) for n in (20, 150, 400)]
    rows = [(i, rnd.choice([*texts, None, ""]), rnd.choice(["en", "de", "", None])) for i in range(60)]
    rows += [rows[5], rows[5], (None, texts[0], "en"), (None, None, None), (7, texts[1], "fr")]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for i in range(0, 60, 2)] + [(4, 1, 1), (None, 1, 1), (900, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert audit_rows(odd_table(spark, rows), table) == brute.filter_orders(rows, labels)
    held = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    assert audit_rows(docs, table) == brute.filter_orders(held, labels)
    assert filters.filter_audit(empty, table).count() == 0
    assert audit_rows(docs, table.limit(0)) == brute.filter_orders(held, [])


def test_gray_walk_equals_subsets():
    counts = np.random.default_rng(3).integers(0, 50, (64, 3))
    states = filters.survivors(counts, 6)
    for active in range(64):
        assert (states[active] == counts[[m for m in range(64) if not m & active]].sum(axis=0)).all()


@pytest.mark.parametrize("bits, part", [(64, 40), (9, 1 << 20)])
def test_collocations(spark, empty, bits, part, monkeypatch):  # noqa: F811
    monkeypatch.setattr(phrases, "PART_BYTES", part)
    monkeypatch.setattr(phrases, "BLOCK_WORDS", 300)
    rnd = random.Random(9)
    words = "New york the of new York TIMES été 日本 a.b c\td 😀 x\x1cy\xa0z end\x0bof line\nbreak".split(" ")
    texts = [" ".join(rnd.choice(words) + rnd.choice(["", "", "", ",", "!"]) for _ in range(n)) for n in (1, 3, 40, 200, 900) * 4]
    rows = [(i, t, rnd.choice(["en", "de", None, "und", ""])) for i, t in enumerate(texts)]
    rows += [(1, None, "en"), (None, texts[4], None), rows[4], rows[4], (90, "", "xx"), (91, "big deal " * 700, "en")]
    for least, top in ((30, 2000), (5, 7)):
        got = phrases.collocations(odd_table(spark, rows), least=least, top=top, bits=bits)
        want = brute.phrase_ranks([r[1:] for r in rows], least=least, top=top)
        assert rows_of(got, "lang", "rank", "phrase", "a", "l", "r", "n", "score") == sorted(want, key=repr)
    assert phrases.collocations(empty).count() == 0
    two = phrases.collocations(odd_table(spark, rows), longest=2, least=10, bits=bits)
    assert rows_of(two, "lang", "rank", "phrase", "a", "l", "r", "n", "score") == sorted(
        brute.phrase_ranks([r[1:] for r in rows], longest=2, least=10), key=repr)
